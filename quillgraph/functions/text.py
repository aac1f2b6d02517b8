"""Column functions over strings: names, identifiers, titles, classification codes.

All are built-in expressions inside code generation, but for NFKC folding, which Spark has no
function for and which runs as an Arrow UDF.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: white space as ECMAScript's \s and trim() see it
WS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"

# fixed values: punctuation that a title key leaves out
TITLE_PUNCTUATION = r"[\u0021-\u002F\u003A-\u0040\u005B-\u0060\u007B-\u007E\u2000-\u206F\u3000-\u303F\uFF01-\uFF20\uFF3B-\uFF40\uFF5B-\uFF65]"

# fixed values: organisation types and the patterns that name them, in order of precedence
ORG_TYPES = [
    ("金控", "金融控股|金控", False),
    ("銀行", "商業銀行|銀行|信用合作社|農會信用部|Bank", True),
    ("保險", "人壽|產物保險|保險|再保|Insurance", True),
    ("證券投信", "證券|投信|投顧|期貨|資產管理|Securities", True),
    ("支付金流", "支付|金流|電子票證|悠遊卡|一卡通|Payment|Visa|Mastercard", True),
    ("學研", "大學|學院|研究院|研究所|工研院|資策會|University|Institute", True),
    ("科技資訊", "科技|資訊|電子|通訊|軟體|網路|數位|Technolog|Systems|Software", True),
]
PERSON, OTHER = "個人", "其他"
# fixed values: words by which a short name is no person's, and those of a university
CORPORATE_SUFFIX = r"公司|企業|集團|基金會|協會|Corp|Inc|Ltd|LLC|GmbH|Co\."
UNIVERSITY = ("大學", "大學|科技大學|技術學院|University")
# fixed values: institution view names of organisation types; whatever else there is becomes ACADEMIC
INSTITUTION_NAMES = {"銀行": "銀行", "金控": "金控", "保險": "保險", "證券投信": "證券投承", "支付金流": "支付金流", "科技資訊": "科技", "個人": "個人"}
ACADEMIC = "學研"


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def blank_to_null(c: Column) -> Column:
    t = js_trim(c)
    return F.when(t != "", t)


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def clean_applicant_name(raw: Column) -> Column:
    """The name up to the first ideographic or ASCII space, without a bracketed group at its end."""
    name = js_trim(F.regexp_extract(raw, r"^([^\u3000 ]*)", 1))
    return js_trim(F.regexp_replace(name, r"[（(][^）)]*[）)]$", ""))


# fixed values: company suffixes that a merge key unifies, in this order, and what they become
COMPANY_SUFFIXES = ["(股份)?有限公司$", r"CO\.?,?\s*LTD\.?$", r"(CORPORATION|CORP\.?|INC\.?|LLC\.?|LIMITED)$"]
COMPANY = "公司"


def normalize_applicant_name(raw: Column, fold: bool = True) -> Column:
    """A merge key, not for display: folded, without white space, upper case, company suffixes unified. fold=False: ASCII input, no UDF."""
    s = F.coalesce(raw, F.lit(""))
    s = F.upper(F.regexp_replace(nfkc(s) if fold else s, f"{WS}+", ""))
    for suffix in COMPANY_SUFFIXES:
        s = F.regexp_replace(s, suffix, COMPANY)
    return s


def _identifier(raw: Column, keep: str, strip_u: bool) -> Column:
    s = F.regexp_replace(F.upper(js_trim(F.coalesce(raw.cast("string"), F.lit("")))), "^TW", "")
    s = F.regexp_replace(s, f"[^{keep}]", "")
    s = F.regexp_replace(s, "U$", "") if strip_u else s
    return F.nullif(s, F.lit(""))


def normalize_application_number(raw: Column) -> Column:
    return _identifier(raw, "A-Z0-9", False)


def normalize_patent_number(raw: Column) -> Column:
    """As an application number, without a final U; the leading type letter stays."""
    return _identifier(raw, "A-Z0-9", True)


def normalize_reference(raw: Column) -> Column:
    """As a patent number, but a slash stays, so that foreign values stay visibly different."""
    return _identifier(raw, "A-Z0-9/", True)


def is_usable_reference(raw: Column) -> Column:
    """Whether a reference has printable ASCII only and something to compare."""
    s = js_trim(F.coalesce(raw.cast("string"), F.lit("")))
    return (s != "") & ~s.rlike(r"[^\x20-\x7E]") & normalize_reference(raw).isNotNull()


def normalize_title_key(raw: Column, fold: bool = True) -> Column:
    s = F.regexp_replace(F.coalesce(raw, F.lit("")), f"{WS}+", "")
    s = nfkc(s) if fold else s
    return F.upper(F.regexp_replace(s, TITLE_PUNCTUATION, ""))


# fixed values: shapes of a full classification code and of a bare subclass
_FULL = r"^([A-H]\d{2}[A-Z])-?(\d{1,4})/(\d{1,6})$"
_SUBCLASS = r"^[A-H]\d{2}[A-Z]$"


def _ipc_text(raw: Column) -> Column:
    s = F.upper(js_trim(F.coalesce(raw.cast("string"), F.lit(""))))
    s = F.regexp_replace(s, WS + r"*\((?:19|20)\d{2}\.\d{2}\)" + WS + "*$", "")
    s = F.regexp_replace(s, "[^A-Z0-9/]+$", "")
    return F.regexp_replace(s, f"{WS}+", "")


def normalize_ipc5(raw: Column) -> Column:
    """Key of a classification code: the main group without leading zeros, or a bare subclass; null if neither."""
    s = _ipc_text(raw)
    main = F.regexp_replace(F.regexp_extract(s, _FULL, 2), "^0+(?=.)", "")
    full = F.concat(F.regexp_extract(s, _FULL, 1), main, F.lit("/"), F.regexp_extract(s, _FULL, 3))
    return F.when(s.rlike(_FULL), full).when(s.rlike(_SUBCLASS), s)


def ipc_depth(key: Column) -> Column:
    return F.when(key.isNull(), F.lit(None).cast("int")).when(key.contains("/"), F.lit(5)).otherwise(F.lit(3))


def ipc_subclass(key: Column) -> Column:
    return F.nullif(F.regexp_extract(key, r"^([A-H]\d{2}[A-Z])", 1), F.lit(""))


def ipc_key_at_level(key: Column, level: int) -> Column:
    """Section, class, subclass, main group or full code; null where the key is malformed or not that deep."""
    shape = r"^([A-H]\d{2}[A-Z])(\d{0,4})(?:/(\d{1,6}))?$"
    known, main = key.rlike(shape), F.regexp_extract(key, shape, 2)
    subclass, group = F.regexp_extract(key, shape, 1), F.regexp_extract(key, shape, 3)
    if level in (1, 2, 3):
        return F.when(known, F.substring(key, 1, (1, 3, 4)[level - 1]))
    if level == 4:
        return F.when(known & (main != ""), F.concat(subclass, main))
    if level == 5:
        return F.when(known & (main != "") & (group != ""), key)
    raise ValueError("level must be 1..5")


def strip_bom(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\uFEFF\u200B-\u200F\u2060\uFFFE]+", "")


def stable_patent_id(patent_number: Column, application_number: Column, title: Column, abstract: Column, applicants: Column, filing_date: Column, fold: bool = True) -> Column:
    """SHA-1 of the first identity that a record has: patent number, application number, or its content; the title key is part of each."""
    pn, an, tk = normalize_patent_number(patent_number), normalize_application_number(application_number), normalize_title_key(title, fold)
    nothing = F.concat_ws("|", F.lit("noid"), tk, F.sha1(F.coalesce(abstract, F.lit(""))), F.array_join(F.array_sort(F.coalesce(applicants, F.array().cast("array<string>"))), ";"), F.coalesce(filing_date, F.lit("")))
    return F.sha1(F.when(pn.isNotNull(), F.concat_ws("|", F.lit("pn"), pn, tk)).when(an.isNotNull(), F.concat_ws("|", F.lit("an"), an, tk)).otherwise(nothing))


def split_applicants(c: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[；;]"), js_trim)
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def extract_country(raw: Column) -> Column:
    """Inside of the last bracketed group."""
    groups = F.regexp_extract_all(raw, F.lit(r"[（(]([^）)]+)[）)]"), F.lit(1))
    return F.nullif(js_trim(F.try_element_at(groups, F.lit(-1))), F.lit(""))


def classify_org_type(name: Column) -> Column:
    """The first organisation type whose pattern occurs; a short name without a corporate suffix is a person."""
    n = js_trim(name)
    out = F.when(n.isNull() | (n == ""), F.lit(OTHER))
    for kind, pattern, fold_case in ORG_TYPES:
        out = out.when(n.rlike(("(?i)" if fold_case else "") + pattern), F.lit(kind))
    return out.when((F.length(n) <= 4) & ~n.rlike("(?i)" + CORPORATE_SUFFIX), F.lit(PERSON)).otherwise(F.lit(OTHER))


def institution_type_of(name: Column) -> Column:
    """Universities first, then the organisation types under the view's names; everything else is academic."""
    kind = classify_org_type(name)
    out = F.when(js_trim(name).rlike("(?i)" + UNIVERSITY[1]), F.lit(UNIVERSITY[0]))
    for source, target in INSTITUTION_NAMES.items():
        out = out.when(kind == source, F.lit(target))
    return out.otherwise(F.lit(ACADEMIC))


def matches_keyword(keyword: str | None, *columns: Column) -> Column:
    """Whether any column holds the keyword, ignoring case; a blank keyword matches nothing."""
    needle = (keyword or "").strip().lower()
    if not needle:
        return F.lit(False)
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lit(needle)), F.lit(False))
    return out


def squeeze(c: Column) -> Column:
    """Trimmed, inner white space as one blank: how a concept is looked up."""
    return F.regexp_replace(js_trim(c), f"{WS}+", " ")


# ---------------------------------------------------------------- hashes


def fnv1a32(c: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units, as a long."""
    units = F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("(....)"), F.lit(1))
    step = lambda h, u: (h.bitwiseXOR(F.conv(u, 16, 10).cast("long")) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295))
    return F.aggregate(units, F.lit(2166136261), step)


def hex8(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def stable_edge_id(kind: str, *ends: Column) -> Column:
    """e:kind:hash of the JSON array of kind and ends."""
    return F.concat(F.lit(f"e:{kind}:"), hex8(fnv1a32(F.to_json(F.array(F.lit(kind), *[e.cast("string") for e in ends])))))


# ---------------------------------------------------------------- display


def scope_label(files: Column) -> Column:
    """How a panel's scope is shown: all files, one name, or a count."""
    return F.when(F.size(files) == 0, F.lit("all")).when(F.size(files) == 1, files[0]).otherwise(F.concat(files[0], F.lit(" +"), (F.size(files) - 1).cast("string")))
