"""Classification codes of patents: counts, tree, dominant code of a concept, colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import ipc_key_at_level

# fixed values: colours of classification codes by rank, and of a code without rank
IPC_COLOURS = ["#1d4ed8", "#0e7490", "#15803d", "#a16207", "#b45309", "#be185d", "#7c3aed", "#475569", "#0f766e", "#dc2626", "#4d7c0f", "#9333ea"]
NO_COLOUR = "#94a3b8"


def keys_of(ipc5: Column, level: int) -> Column:
    """Distinct keys of a patent at a level."""
    return F.array_distinct(F.array_compact(F.transform(F.coalesce(ipc5, F.array().cast("array<string>")), lambda k: ipc_key_at_level(k, level))))


def patent_keys(patents: DataFrame, level: int) -> DataFrame:
    """(patent_id, key), distinct."""
    return patents.select("patent_id", F.explode(keys_of(F.col("ipc5"), level)).alias("key"))


def counts(patents: DataFrame, level: int) -> DataFrame:
    """(key, n): patents of each key; sort by n descending, then key."""
    return patent_keys(patents, level).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def tree(patents: DataFrame, depth: int = 3) -> DataFrame:
    """(level, key, parent, n) for all levels up to depth; patents are read once, and a patent with several keys counts once for each."""

    def at(level: int) -> Column:
        return F.transform(keys_of(F.col("ipc5"), level), lambda k: F.struct(F.lit(level).alias("level"), k.alias("key")))

    every = F.array(*[at(level) for level in range(1, depth + 1)])
    each = patents.select(F.explode(F.flatten(every)).alias("e")).groupBy("e.level", "e.key").agg(F.count(F.lit(1)).alias("n"))
    parent = F.when(F.col("level") == 2, F.substring("key", 1, 1)).when(F.col("level") == 3, F.substring("key", 1, 3)).when(F.col("level") == 4, F.substring("key", 1, 4)).when(F.col("level") == 5, F.regexp_extract("key", "^([^/]+)/", 1))
    return each.select("level", "key", parent.alias("parent"), "n")


def selected(patents: DataFrame, level: int, keys: list[str]) -> DataFrame:
    """patent_ids with a key of the selection; an empty selection selects none."""
    if not keys:
        return patents.select("patent_id").limit(0)
    return patents.filter(F.arrays_overlap(keys_of(F.col("ipc5"), level), F.array(*[F.lit(k) for k in keys]))).select("patent_id")


def dominant(membership: DataFrame, patents: DataFrame, level: int) -> DataFrame:
    """(concept, key): the commonest key among a concept's patents, the smaller on a tie."""
    n = membership.join(patent_keys(patents, level), "patent_id").groupBy("concept", "key").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("concept").agg(F.min_by("key", F.struct((-F.col("n")).alias("n"), "key")).alias("key"))


def colours(keys: DataFrame, key: str = "key", palette: list[str] = IPC_COLOURS) -> DataFrame:
    """(key, colour) by sorted rank. Ranks are made over the distinct keys, of which a code scheme has a bounded number."""
    ranked = keys.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(key)) - 1)
    return ranked.select(key, F.element_at(F.array(*[F.lit(c) for c in palette]), (F.pmod("_r", F.lit(len(palette))) + 1).cast("int")).alias("colour"))
