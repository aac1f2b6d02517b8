"""Spreadsheets: a small .xlsx reader on the standard library, sheet choice, and the two patent formats.

Only the sheet that is asked for is parsed, row by row from the zip stream, so a workbook with a
sheet of a million formula rows costs nothing as long as nobody asks for that sheet.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillgraph.functions import numeric as N
from quillgraph.functions import text as X

# fixed values: recognised headers of format A by field, in order
FIELD_SYNONYMS = {
    "title": ["專利名稱(中)", "title", "專利名稱", "name", "題名"],
    "abstract": ["摘要", "abstract", "summary", "內容"],
    "applicant": ["申請人", "applicant", "assignee"],
    "filing_date": ["申請日", "filing_date", "application_date"],
    "application_number": ["申請號", "application_number"],
    "search_keyword": ["搜尋關鍵字", "search_keyword", "keyword"],
    "title_en": ["專利名稱(英)", "title_en"],
    "publication_number": ["公開公告號", "publication_number"],
    "publication_date": ["公開公告日", "publication_date"],
}
# fixed values: columns of format B
FORMAT_B = {"title": "專利名稱", "abstract": "摘要", "application_number": "申請號", "patent_number": "專利編號", "filing_date": "申請日", "publication_date": "公告/公開日", "cited_by_count": "被參考次數", "case_status": "案件狀態", "design_class": "設計分類號"}
FORMAT_B_SHEET, FORMAT_B_MIN_ROWS = "原始資料", 500
# fixed values: sheets that are never data
BLACKLIST, BLACKLIST_PREFIX, BLACKLIST_SUFFIX = {"發明人合併", "雷達圖分析", "IPC3分析", "IPC5分析"}, "專利件數分析", "別分析"
GROUPS = {"applicants": "申請人", "inventors": "發明人", "ipc5_raw": "IPC5", "references": "參考文獻"}

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


class Workbook:
    """Sheets of an .xlsx file by name."""

    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        self.sheets = {s.get("name"): targets[s.get(_REL)].lstrip("/").removeprefix("xl/") for s in book.iter(f"{_NS}sheet")}
        self._strings: list[str] | None = None

    def _shared(self) -> list[str]:
        if self._strings is None:
            self._strings = []
            if "xl/sharedStrings.xml" in self.zip.namelist():
                with self.zip.open("xl/sharedStrings.xml") as f:
                    for _, e in ElementTree.iterparse(f):
                        if e.tag == f"{_NS}si":
                            self._strings.append("".join(t.text or "" for t in e.iter(f"{_NS}t")))
                            e.clear()
        return self._strings

    def rows(self, sheet: str) -> Iterator[list[str]]:
        """Cell texts of each row; missing cells are empty."""
        with self.zip.open(f"xl/{self.sheets[sheet]}") as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag != f"{_NS}row":
                    continue
                out: list[str] = []
                for i, c in enumerate(e.iter(f"{_NS}c")):
                    ref = re.match("[A-Z]+", c.get("r") or "")
                    at = _column(ref[0]) if ref else i
                    out += [""] * (at - len(out))
                    out.append(self._value(c))
                e.clear()
                yield out

    def _value(self, c) -> str:
        if c.get("t") == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{_NS}t"))
        v = c.find(f"{_NS}v")
        text = (v.text or "") if v is not None else ""
        return self._shared()[int(text)] if c.get("t") == "s" and text else text

    def headers(self, sheet: str) -> list[str]:
        return [h.strip() for h in next(self.rows(sheet), [])]


def _column(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + ord(ch) - 64
    return n - 1


def blacklisted(sheet: str) -> bool:
    s = sheet.strip()
    return s in BLACKLIST or s.startswith(BLACKLIST_PREFIX) or s.endswith(BLACKLIST_SUFFIX)


def choose_sheet(book: Workbook) -> tuple[str, str] | None:
    """(format, sheet): the named data sheet, else a first sheet with format A's headers, else a long sheet with all of B's, else anything with abstracts."""
    names = list(book.sheets)
    if FORMAT_B_SHEET in names and "IPC5-1" in book.headers(FORMAT_B_SHEET):
        return "B", FORMAT_B_SHEET
    first = book.headers(names[0]) if names else []
    if "搜尋關鍵字" in first or "專利名稱(中)" in first:
        return "A", names[0]
    for name in names:
        if not blacklisted(name) and {"IPC5-1", "摘要", "專利名稱", "申請號"} <= set(book.headers(name)):
            filled = sum(any(c.strip() for c in r) for i, r in enumerate(book.rows(name)) if i)
            if filled > FORMAT_B_MIN_ROWS:
                return "B", name
    if "摘要" in first or "abstract" in [h.lower() for h in first]:
        return "A", names[0]
    return None


def column_map(headers: list[str]) -> dict[str, str]:
    """field -> header: the first synonym that some header equals, ignoring case and outer blanks."""
    normal = {}
    for h in headers:
        normal.setdefault(h.strip().lower(), h)
    return {field: normal[s.lower()] for field, synonyms in FIELD_SYNONYMS.items() for s in [next((s for s in synonyms if s.lower() in normal), None)] if s}


def numbered_columns(headers: list[str], prefix: str) -> list[str]:
    """Headers prefix1, prefix-2, ... in order of their numbers."""
    hits = [(int(m[1]), h) for h in headers if (m := re.fullmatch(rf"{re.escape(prefix)}-?(\d+)", h.strip()))]
    return [h for _, h in sorted(hits, key=lambda x: x[0])]


class XlsxReader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            yield from cells(partition.value.rsplit("/", 1)[-1], f.read())


def cells(file: str, data: bytes) -> Iterator[tuple]:
    """(file, format, sheet, row, values) of a workbook's data sheet; row 0 holds the headers. A workbook without one gives an error row."""
    book = Workbook(data)
    found = choose_sheet(book)
    if found is None:
        yield file, "?", "", 0, {"error": "; ".join(f"{s}: {', '.join(h for h in book.headers(s) if h)}" for s in book.sheets)}
        return
    headers: list[str] = []
    for i, r in enumerate(book.rows(found[1])):
        if not i:
            headers = [h.strip() for h in r]
        elif any(c.strip() for c in r):
            yield file, *found, i, {h: v for h, v in zip(headers, r, strict=False) if h}


CELLS = "file string, format string, sheet string, row int, cells map<string,string>"


class XlsxSource(DataSource):
    """spark.read.format("patent_xlsx").load(path) for files that all executors see under the path."""

    @classmethod
    def name(cls) -> str:
        return "patent_xlsx"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> XlsxReader:
        return XlsxReader([p for p in self.options["path"].split(",") if p])


def read_xlsx(spark: SparkSession, pattern: str) -> DataFrame:
    """Cells of all workbooks of a pattern, fetched by Spark's own binary reader, so that any store works; one workbook a task row."""

    def parse(it):
        import pyarrow as pa

        for batch in it:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = list(cells(path.rsplit("/", 1)[-1], data))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int32()))] + [pa.array([list(r[4].items()) for r in rows], pa.map_(pa.string(), pa.string()))],
                    names=["file", "format", "sheet", "row", "cells"],
                )

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInArrow(parse, CELLS)


def _first(synonyms: list[str]):
    lowered = F.map_from_entries(F.transform(F.map_entries("cells"), lambda e: F.struct(F.lower(X.js_trim(e["key"])).alias("key"), e["value"].alias("value"))))
    return X.blank_to_null(F.coalesce(*[lowered[F.lit(s.lower())] for s in synonyms]))


def _group(prefix: str):
    """Values of a numbered column group in order of the numbers, without blanks and repeats."""
    own = F.filter(F.map_entries("cells"), lambda e: e["key"].rlike(rf"^{re.escape(prefix)}-?\d+$"))
    ranked = F.array_sort(F.transform(own, lambda e: F.struct(F.regexp_extract(e["key"], r"(\d+)$", 1).cast("int").alias("n"), X.blank_to_null(e["value"]).alias("v"))))
    return F.array_distinct(F.array_compact(F.transform(ranked, lambda e: e["v"])))


def format_a(table: DataFrame) -> DataFrame:
    """Patent rows of format A; rows without a title or an abstract are left out. Dates stay as they are displayed."""
    a = table.filter(F.col("format") == "A")
    fields = {f: _first(s) for f, s in FIELD_SYNONYMS.items()}
    out = a.select("file", "row", *[c.alias(f) for f, c in fields.items()]).filter(F.col("title").isNotNull() & F.col("abstract").isNotNull())
    raw = F.col("applicant")
    names = F.filter(F.transform(X.split_applicants(raw), X.clean_applicant_name), lambda n: n != "")
    out = out.withColumn("applicant_raw", raw).withColumn("applicants", F.array_distinct(names)).withColumn("applicant", X.clean_applicant_name(F.coalesce(raw, F.lit(""))))
    return out.withColumn("abstract", X.strip_bom(F.col("abstract"))).withColumn("source_files", F.array("file"))


def format_b(table: DataFrame) -> DataFrame:
    """Patent rows of format B; rows without a patent number are dropped before anything is counted."""
    b = table.filter(F.col("format") == "B")
    one = lambda h: X.blank_to_null(F.col("cells")[F.lit(h)])
    out = b.select("file", "row", *[one(h).alias(f) for f, h in FORMAT_B.items()], *[_group(p).alias(f) for f, p in GROUPS.items()]).filter(F.col("patent_number").isNotNull())
    for d in ("filing_date", "publication_date"):
        out = out.withColumn(d, N.coerce_date(F.col(d)))
    keys = F.array_distinct(F.array_compact(F.transform("ipc5_raw", X.normalize_ipc5)))
    out = out.withColumn("ipc5", keys).withColumn("ipc_primary", X.normalize_ipc5(F.get("ipc5_raw", 0))).withColumn("ipc_depth", X.ipc_depth(F.col("ipc_primary")))
    out = out.withColumn("applicants", F.array_distinct(F.filter(F.transform("applicants", X.clean_applicant_name), lambda n: n != ""))).withColumn("applicant", F.coalesce(F.get("applicants", 0), F.lit("")))
    out = out.withColumn("references", F.array_distinct(F.array_compact(F.transform(F.filter("references", X.is_usable_reference), X.normalize_reference))))
    return out.withColumn("cited_by_count", F.try_to_number("cited_by_count", F.lit("999999999")).cast("int")).withColumn("abstract", X.strip_bom(F.coalesce("abstract", F.lit("")))).withColumn("source_files", F.array("file"))


def ipc_unparseable(rows: DataFrame) -> DataFrame:
    """(file, row, value) of classification codes that have no key."""
    return rows.select("file", "row", F.explode("ipc5_raw").alias("value")).filter(X.normalize_ipc5(F.col("value")).isNull())


def skipped(table: DataFrame) -> DataFrame:
    """(file, row, missing) of format A rows without a title or an abstract."""
    a = table.filter(F.col("format") == "A").select("file", "row", _first(FIELD_SYNONYMS["title"]).alias("t"), _first(FIELD_SYNONYMS["abstract"]).alias("a"))
    return a.filter(F.col("t").isNull() | F.col("a").isNull()).select("file", "row", F.when(F.col("t").isNull(), "title").otherwise("abstract").alias("missing"))


def ingest(table: DataFrame, dedupe: bool = True, fold: bool = True) -> DataFrame:
    """Patents of all files together: both formats by name, merged once over the union (or each row by itself)."""
    from quillgraph.operators import resolve

    rows = format_a(table).unionByName(format_b(table), allowMissingColumns=True).withColumn("row_id", F.concat_ws("#", "file", F.lpad(F.col("row").cast("string"), 9, "0")))
    if not dedupe:
        return rows.withColumn("patent_id", X.stable_patent_id(F.col("patent_number"), F.col("application_number"), F.col("title"), F.col("abstract"), F.col("applicants"), F.col("filing_date"), fold))
    st = resolve.staged(rows, fold)
    return resolve.merged(st, resolve.groups(st), fold)


def ingest_with_citations(table: DataFrame, dedupe: bool = True, fold: bool = True) -> tuple[DataFrame, DataFrame]:
    """(patents, citations): ingest(), then references resolved against the final patents, inside and outside of them apart."""
    from quillgraph.operators import citations

    return citations.with_references(ingest(table, dedupe, fold))


def file_summaries(rows: DataFrame) -> DataFrame:
    """(file, rows, with_year, with_ipc) of each file."""
    has_ipc = F.size("ipc5") > 0 if "ipc5" in rows.columns else F.lit(False)
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.count_if(N.filing_year(F.col("filing_date")).isNotNull()).alias("with_year"), F.count_if(F.coalesce(has_ipc, F.lit(False))).alias("with_ipc"))
