"""Several views side by side: overlap counts and the difference view."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: colours, node shapes and edge dashes of the difference view by membership
DIFF_COLOURS = {"a": "#2563eb", "b": "#059669", "unique": "#f59e0b", "partial": "#8b5cf6", "shared": "#dc2626"}
DIFF_SHAPES = {"a": "triangle", "b": "square", "unique": "triangle", "partial": "square", "shared": "dot"}
DIFF_DASHES = {"a": "8,4", "b": "2,4", "unique": "8,4", "partial": "2,4", "shared": ""}


def tagged(views: list[DataFrame], column: str = "id") -> DataFrame:
    """(id, panel) of all views, panels from 1."""
    return reduce(DataFrame.union, [v.select(F.col(column).alias("id"), F.lit(i + 1).alias("panel")) for i, v in enumerate(views)]).distinct()


def membership(ids: DataFrame, panels: int) -> DataFrame:
    """(id, panels, membership): with two panels a, b or shared; with more unique, partial or shared. Empty scopes give no rows."""
    each = ids.groupBy("id").agg(F.array_sort(F.collect_list("panel")).alias("panels"))
    n = F.size("panels")
    kind = F.when(n >= 2, "shared").when(F.col("panels")[0] == 1, "a").otherwise("b") if panels <= 2 else F.when(n >= panels, "shared").when(n <= 1, "unique").otherwise("partial")
    return each.withColumn("membership", kind)


def coloured(members: DataFrame) -> DataFrame:
    """Adds colour, shape (of a node) and dashes (of an edge; empty: a full line) by membership."""
    for name, values in (("colour", DIFF_COLOURS), ("shape", DIFF_SHAPES), ("dashes", DIFF_DASHES)):
        members = members.withColumn(name, F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("membership")])
    return members


def difference(nodes: list[DataFrame], edges: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the difference view: rows by id over all panels, the first panel's where several have it, with panels, membership, colour, shape and dashes.

    Each frame has an `id`. Panels without rows count: a thing in every other panel is then not shared.
    """
    out = []
    for frames in (nodes, edges):
        marked = coloured(membership(tagged(frames), len(frames)))
        names = [c for c in frames[0].columns if c not in ("colour", "shape", "dashes", "panels", "membership")]
        out.append(union_first([f.select(*[c for c in names if c in f.columns]) for f in frames]).join(marked, "id"))
    return out[0], out[1]


def first_by_id(edges: DataFrame, order: str, key: str = "id") -> DataFrame:
    """The first edge of each id by `order`; later ones are repeats."""
    return edges.groupBy(key).agg(F.min_by(F.struct(*[c for c in edges.columns if c != key]), order).alias("_r")).select(key, "_r.*").select(*edges.columns)


def overlap(ids: DataFrame, panels: int) -> DataFrame:
    """(n_panels, n): how many ids are in exactly so many panels."""
    return ids.groupBy("id").agg(F.count(F.lit(1)).alias("n_panels")).groupBy("n_panels").agg(F.count(F.lit(1)).alias("n"))


def summary(ids: DataFrame, panels: int) -> DataFrame:
    """One row: union, shared by all, Jaccard (0 for an empty union), only in the first, only in the second."""
    each = ids.groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.min("panel").alias("p"))
    one = each.agg(
        F.count(F.lit(1)).alias("union_count"), F.count_if(F.col("k") == panels).alias("shared"), F.count_if((F.col("k") == 1) & (F.col("p") == 1)).alias("a_only"), F.count_if((F.col("k") == 1) & (F.col("p") == 2)).alias("b_only")
    )
    return one.withColumn("jaccard", F.when(F.col("union_count") > 0, F.col("shared") / F.col("union_count")).otherwise(F.lit(0.0)))


def union_first(frames: list[DataFrame], key: str = "id") -> DataFrame:
    """Rows by key over all panels, the first panel's row where several have it."""
    names = frames[0].columns
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [f.withColumn("_panel", F.lit(i)) for i, f in enumerate(frames)])
    best = every.groupBy(key).agg(F.min_by(F.struct(*[c for c in every.columns if c != key]), "_panel").alias("_r"))
    return best.select(key, "_r.*").drop("_panel").select(*names)


def shared_concepts(membership_: DataFrame, patents: DataFrame, files_a: list[str], files_b: list[str]) -> DataFrame | None:
    """One row: concepts only under the first files, only under the second, under both, and Jaccard; None if a side is empty."""
    if not [f for f in files_a if f] or not [f for f in files_b if f]:
        return None
    in_a, in_b = (F.arrays_overlap("source_files", F.array(*[F.lit(f) for f in fs if f])) for fs in (files_a, files_b))
    sides = membership_.join(patents.select("patent_id", in_a.alias("x"), in_b.alias("y")), "patent_id").groupBy("concept").agg(F.bool_or("x").alias("x"), F.bool_or("y").alias("y"))
    one = sides.agg(F.count_if(F.col("x") & ~F.col("y")).alias("a_only"), F.count_if(~F.col("x") & F.col("y")).alias("b_only"), F.count_if(F.col("x") & F.col("y")).alias("shared"))
    union = F.col("a_only") + F.col("b_only") + F.col("shared")
    return one.withColumn("union_count", union).withColumn("jaccard", F.when(union > 0, F.col("shared") / union).otherwise(F.lit(0.0)))


def hidden(members: DataFrame, edges: DataFrame, edge_members: DataFrame, classes: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hidden node ids, hidden edge ids): chosen classes, and edges that touch a hidden node."""
    nodes = members.filter(F.col("membership").isin(classes)).select("id")
    ends = edges.select(F.col("id").alias("edge"), F.explode(F.array("from", "to")).alias("id")).join(nodes, "id", "left_semi").select(F.col("edge").alias("id"))
    return nodes, edge_members.filter(F.col("membership").isin(classes)).select("id").union(ends).distinct()


def panel_cooccurrence(membership_: DataFrame, patents: DataFrame, scopes: list[list[str]]) -> DataFrame:
    """(panel, a, b, support) of all panels in one pass: patents go to each panel whose files they share, pairs are counted by panel."""
    panels = F.array_compact(F.array(*[F.when(F.lit(not s) | F.arrays_overlap("source_files", F.array(*[F.lit(f) for f in s]) if s else F.array().cast("array<string>")), F.lit(i + 1)) for i, s in enumerate(scopes)]))
    scoped = patents.select("patent_id", panels.alias("panels")).filter(F.size("panels") > 0)
    sets = membership_.groupBy("patent_id").agg(F.array_sort(F.collect_list("concept")).alias("s")).filter(F.size("s") > 1).join(scoped, "patent_id")
    each = sets.select("s", "panels", F.posexplode("s").alias("i", "a"))
    pairs = each.select("a", F.explode(F.slice("s", F.col("i") + 2, F.greatest(F.size("s") - F.col("i") - 1, F.lit(0)))).alias("b"), "panels")
    return pairs.select("a", "b", F.explode("panels").alias("panel")).groupBy("panel", "a", "b").agg(F.count(F.lit(1)).alias("support"))
