"""Line dedup by site-relative frequency.

A line's ratio is the share of its host's pages that contain it. Lines whose ratio is above the
boilerplate ratio, on two pages or more, are dropped from every page of that host. Lines travel as 128-bit hashes; only
lines above the ratio are kept, and a host can have at most (lines a page) / ratio of those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import join_hosts, table

RATIO = 0.1
#: Pages that a line must be on to be boilerplate: below that it is not repeated.
LEAST = 2


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(line: Column) -> Column:
    """128 bits of a line without its outer blanks (U+0020; tabs and \r are part of a line); null for a blank line."""
    bare = F.trim(line)
    return F.when(bare != "", F.md5(bare))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = 1, host: str = "source") -> DataFrame:
    """(__host, __boiler): hashes above the ratio, an array bounded by (lines a page) / ratio.

    Counting is by distinct page: a line repeated on a page counts once there. A line exactly at the
    ratio stays. Counts are combined before the shuffle, whose key holds the line, so a huge host
    spreads over all tasks.
    """
    own = pages.select(F.col(host).alias("__host"), F.array_distinct(F.filter(F.transform(_lines(F.col("text")), _hash), lambda h: h.isNotNull())).alias("h"))
    totals = pages.groupBy(F.col(host).alias("__host")).agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages)
    counts = own.select("__host", F.explode("h").alias("h")).groupBy("__host", "h").agg(F.count(F.lit(1)).alias("n"))
    least = max(LEAST, int(ratio * min_pages))
    frequent = counts.filter(F.col("n") >= least)
    joined = frequent.alias("c").join(totals.alias("t"), F.col("c.__host").eqNullSafe(F.col("t.__host")))
    return joined.filter(F.col("n") > F.lit(ratio) * F.col("pages")).groupBy(F.col("c.__host").alias("__host")).agg(F.collect_set("h").alias("__boiler"))


def drop_lines(pages: DataFrame, ratio: float = RATIO, min_pages: int = 1, host: str = "source") -> DataFrame:
    """All rows and columns of pages, `text` without its host's boilerplate lines, and `n_lines`, `n_dropped` added.

    A line on a single page is never boilerplate; hosts of any size are cleaned unless min_pages says
    otherwise. On a host of fewer than 2 / ratio pages, two copies of a page lose their lines. Blank
    lines always stay. A null text stays null with 0 lines; rows with a null host form one host.
    Columns named n_lines or n_dropped are replaced; names that start with two underscores are taken.
    """
    found = boilerplate(pages, ratio, min_pages, host)
    base = pages.drop("n_lines", "n_dropped")
    names = [c for c in base.columns if c != "text"]
    joined = join_hosts(base, host, found, "left", F.size("__boiler"))
    lines = _lines(F.col("text"))
    # the host's lines are met once a page, by a set; what is left to look up is what the page itself has of them
    own = F.array_intersect(F.transform(lines, _hash), F.col("__boiler"))
    bound = joined.select(*[base[c] for c in names], F.col("text").alias("__text"), own.alias("__own"))
    lines = _lines(F.col("__text"))
    kept = F.when(F.coalesce(F.size("__own"), F.lit(0)) == 0, lines).otherwise(F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("__own"), _hash(x)), F.lit(False))))
    out = bound.withColumn("__kept", kept)
    n_lines = F.when(F.col("__text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    n_dropped = F.when(F.col("__text").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size("__kept")).cast("long")
    return out.select(*names, F.array_join("__kept", "\n").alias("text"), n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and the md5 of the text that stays, for every document; its source is its host."""
    done = drop_lines(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))
