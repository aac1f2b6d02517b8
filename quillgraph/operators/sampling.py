"""Stratified samples of patents by source file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stratum(sources: list[str], column: str = "source_files"):
    """The first uploaded source that a patent names; null if none."""
    known = list(dict.fromkeys(s for s in sources if s))
    order = F.array(*[F.lit(s) for s in known]) if known else F.array().cast("array<string>")
    return F.try_element_at(F.array_intersect(order, F.coalesce(column, F.array().cast("array<string>"))), F.lit(1))


def plan(patents: DataFrame, sources: list[str], cap: int) -> DataFrame:
    """(source_file, available, allocated): each source gives up to `cap`, nothing is redistributed; one source or none is one stratum."""
    many = len(dict.fromkeys(s for s in sources if s)) > 1
    s = stratum(sources) if many else F.lit(sources[0] if sources else None).cast("string")
    return patents.groupBy(s.alias("source_file")).agg(F.count(F.lit(1)).alias("available")).withColumn("allocated", F.least(F.lit(max(0, cap)).cast("long"), F.col("available")))


def sample(patents: DataFrame, sources: list[str], cap: int, seed: int = 0) -> DataFrame:
    """Patents with their source_file: of each stratum the `cap` smallest by a seeded hash of the id, the same at every run.

    Ranks stay within a stratum and only ranks up to the cap are kept while sorting.
    """
    many = len(dict.fromkeys(s for s in sources if s)) > 1
    s = stratum(sources) if many else F.lit(sources[0] if sources else None).cast("string")
    rank = F.row_number().over(Window.partitionBy("source_file").orderBy(F.md5(F.concat_ws(":", F.col("patent_id").cast("string"), F.lit(str(seed)))), "patent_id"))
    return patents.withColumn("source_file", s).withColumn("_r", rank).filter(F.col("_r") <= max(0, cap)).drop("_r")


def sample_size(asked: float | None, total: int, default: int = 50, most: int = 20_000) -> int:
    """A whole number between 0 and the total; without one, the default."""
    n = default if asked is None or asked != asked else int(asked)
    return max(0, min(n, total, most))
