"""Entity resolution: which rows are the same patent, and what the merged row says.

Rows are the same by rule 1a (equal patent number and title key) or, where one side has no patent
number, 2a (equal application number and title key); the relation is closed over chains. Instead of
comparing pairs, rows link to key nodes: every row with a patent number to (pn, title), and all rows
of an (an, title) bucket to that key if the bucket holds a row without a patent number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import numeric as N
from quillgraph.functions import text as X
from quillgraph.operators.components import components
from quillgraph.shared import kept

# fixed values: severity of a case status by what it says; the most severe wins a merge
SEVERITY = [("核駁|不予專利|撤回|放棄|消滅|失效", 3), ("未審查|公開", 2)]


def staged(rows: DataFrame, fold: bool = True) -> DataFrame:
    """Adds pn, an (normalised numbers) and tk (title key) to rows with a row_id."""
    return rows.withColumn("pn", X.normalize_patent_number(F.col("patent_number"))).withColumn("an", X.normalize_application_number(F.col("application_number"))).withColumn("tk", X.normalize_title_key(F.col("title"), fold))


def pair_decision(a_pn: Column, a_an: Column, a_tk: Column, b_pn: Column, b_an: Column, b_tk: Column) -> Column:
    """1a, 1b, 1c, 2a, 2b, 2c or 3 for a pair of rows; the first rule that applies."""
    both_pn, both_an, tk = a_pn.isNotNull() & b_pn.isNotNull(), a_an.isNotNull() & b_an.isNotNull(), a_tk == b_tk
    return (
        F.when(both_pn & (a_pn == b_pn), F.when(tk, "1a").otherwise("1b")).when(both_pn, "1c").when(both_an & (a_an == b_an), F.when(tk, "2a").otherwise("2b")).when(both_an, "2c").otherwise("3")
    )


def groups(staged_rows: DataFrame) -> DataFrame:
    """(row_id, group_id) of all rows; group_id is the smallest row_id of the group. The normalised keys are read five times and written once."""
    staged_rows = kept(staged_rows.select("row_id", "pn", "an", "tk"), "keys")
    by_pn = staged_rows.filter(F.col("pn").isNotNull()).groupBy("pn", "tk").agg(F.min("row_id").alias("_u"))
    one = staged_rows.join(by_pn, ["pn", "tk"]).select(F.col("_u").alias("u"), F.col("row_id").alias("v"))
    by_an = staged_rows.filter(F.col("an").isNotNull()).groupBy("an", "tk").agg(F.min("row_id").alias("_u"), F.bool_or(F.col("pn").isNull()).alias("_bridge")).filter("_bridge").drop("_bridge")
    two = staged_rows.join(by_an, ["an", "tk"]).select(F.col("_u").alias("u"), F.col("row_id").alias("v"))
    comp = components(one.union(two))
    return staged_rows.select("row_id").join(comp, F.col("row_id") == comp["node"], "left").select("row_id", F.coalesce("component", "row_id").alias("group_id"))


def title_conflicts(staged_rows: DataFrame) -> DataFrame:
    """(pn, titles): patent numbers that carry several title keys (rule 1b)."""
    return staged_rows.filter(F.col("pn").isNotNull()).groupBy("pn").agg(F.array_sort(F.collect_set("tk")).alias("titles")).filter(F.size("titles") > 1)


def number_collisions(staged_rows: DataFrame) -> DataFrame:
    """(an, rows): application numbers shared by rows that may not merge directly (rules 1c and 2b)."""
    b = staged_rows.filter(F.col("an").isNotNull()).groupBy("an").agg(F.count_distinct("tk").alias("titles"), F.count_distinct("pn").alias("pns"), F.bool_or(F.col("pn").isNull()).alias("bare"), F.array_sort(F.collect_list("row_id")).alias("rows"))
    # different numbers collide by 1c; different titles by 2b as soon as one side has no number
    return b.filter((F.col("pns") > 1) | ((F.col("titles") > 1) & F.col("bare"))).select("an", "rows")


def unidentified(staged_rows: DataFrame) -> DataFrame:
    return staged_rows.filter(F.col("pn").isNull() & F.col("an").isNull()).select("row_id", "title")


def severity(status: Column) -> Column:
    out = F.when(status.rlike(SEVERITY[0][0]), SEVERITY[0][1])
    for pattern, level in SEVERITY[1:]:
        out = out.when(status.rlike(pattern), level)
    return out.otherwise(1)


def _text(name: str) -> Column:
    return F.when(F.col(name) != "", F.col(name))


def longest(name: str) -> Column:
    """The longest text, the smallest among equally long ones."""
    t = _text(name)
    return F.min_by(t, F.when(t.isNotNull(), F.struct((-F.length(t)).alias("n"), t.alias("t"))))


def earliest(name: str) -> Column:
    """The text with the earliest date; texts without a date do not count."""
    key = N.date_sort_key(F.col(name))
    return F.min_by(name, F.when(key.isNotNull(), F.struct(key.alias("k"), F.col(name).alias("t"))))


def union_of(name: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(name, F.array().cast("array<string>"))))))


def merged(rows: DataFrame, grouping: DataFrame, fold: bool = True) -> DataFrame:
    """One row for each group, field by field, whatever the order of the rows; `patent_id` is the content's hash, n_rows the group's size."""
    status = _text("case_status")
    number = F.coalesce(F.col("application_number"), F.lit(""))
    have = set(rows.columns)
    aggs = {
        "title": longest("title"), "abstract": longest("abstract"), "patent_number": longest("patent_number"), "application_number": F.min(_text("application_number")),
        "publication_number": F.min(_text("publication_number")), "title_en": longest("title_en"), "filing_date": earliest("filing_date"), "publication_date": earliest("publication_date"),
        "applicants": union_of("applicants"), "inventors": union_of("inventors"), "ipc5": union_of("ipc5"), "ipc5_raw": union_of("ipc5_raw"), "references": union_of("references"), "source_files": union_of("source_files"), "search_keywords": union_of("search_keywords"),
        "ipc_primary": F.min_by("ipc_primary", F.when(F.col("ipc_primary").isNotNull(), F.struct(number.alias("n"), F.coalesce("tk", F.lit("")).alias("t"), F.col("ipc_primary").alias("p")))),
        "applicant": longest("applicant"), "applicant_raw": longest("applicant_raw"), "search_keyword": longest("search_keyword"), "cited_by_count": F.max("cited_by_count"), "design_class": F.min(_text("design_class")),
        "case_status": F.min_by(status, F.when(status.isNotNull(), F.struct((-severity(status)).alias("s"), status.alias("t")))),
    }
    numbers = F.array_sort(F.collect_set(X.normalize_application_number(F.col("application_number"))))
    used = {k: v for k, v in aggs.items() if k in have}
    out = rows.join(grouping, "row_id").groupBy("group_id").agg(*[v.alias(k) for k, v in used.items()], F.count(F.lit(1)).alias("n_rows"), numbers.alias("application_numbers"), *([F.array_sort(F.collect_set(status)).alias("case_statuses")] if "case_status" in have else []))
    if {"applicant", "applicants"} <= have:
        out = out.withColumn("applicant", F.when((F.col("n_rows") > 1) & (F.size("applicants") > 0), F.array_join("applicants", "；")).otherwise(F.coalesce("applicant", F.lit(""))))
    nothing = F.lit(None).cast("string")
    column = lambda c: F.col(c) if c in have else nothing
    applicants = F.col("applicants") if "applicants" in have else F.array().cast("array<string>")
    return out.withColumn("patent_id", X.stable_patent_id(column("patent_number"), column("application_number"), column("title"), column("abstract"), applicants, column("filing_date"), fold))


def merge_warnings(merged_rows: DataFrame) -> DataFrame:
    """(kind, patent, detail): groups whose application numbers or case statuses disagree."""
    label = F.coalesce("patent_number", "application_number", "title")
    a = merged_rows.filter(F.size("application_numbers") > 1).select(F.lit("appno_conflicts").alias("kind"), label.alias("patent"), F.array_join("application_numbers", ",").alias("detail"))
    b = merged_rows.filter(F.size("case_statuses") > 1).select(F.lit("case_status_conflicts").alias("kind"), label.alias("patent"), F.array_join("case_statuses", ",").alias("detail"))
    return a.union(b)


def identity_conflicts(rows: DataFrame, grouping: DataFrame, fold: bool = True) -> DataFrame:
    """group_ids with two rows that share no normalised applicant, rows without applicants aside.

    Rows are reduced to distinct key sets first; a group disagrees if some set misses every other's
    keys, which holds for a pair exactly if it holds for two of its distinct sets.
    """
    keys = rows.select("row_id", F.explode("applicants").alias("a")).select("row_id", X.normalize_applicant_name(F.col("a"), fold).alias("k"))
    sets = keys.groupBy("row_id").agg(F.array_sort(F.collect_set("k")).alias("s")).join(grouping, "row_id").select("group_id", "s").distinct()
    all_sets = sets.groupBy("group_id").agg(F.collect_list("s").alias("ss")).filter(F.size("ss") > 1)
    apart = F.exists("ss", lambda x: F.exists("ss", lambda y: ~F.arrays_overlap(x, y)))
    return all_sets.filter(apart).select("group_id")


def warning_summary(warnings: DataFrame) -> DataFrame:
    return warnings.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind")


def date_warnings(rows: DataFrame, max_year: int) -> DataFrame:
    """(row_id, kind): filing years outside the valid range, and publications before their filing."""
    y, f, p = N.filing_year(F.col("filing_date")), N.date_sort_key(F.col("filing_date")), N.date_sort_key(F.col("publication_date"))
    a = rows.filter(y.isNotNull() & ~N.is_valid_year(y, max_year)).select("row_id", F.lit("date_out_of_range").alias("kind"))
    return a.union(rows.filter(p < f).select("row_id", F.lit("publication_before_filing").alias("kind")))
