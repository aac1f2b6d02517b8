"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.shared import discard, fresh_dir, kept_in


#: Tasks that a node's neighbours are dealt to.
SALTS = 64


def _with_least(edges: DataFrame, node: str, other: str) -> DataFrame:
    """Edges with `m`, the least `other` of each `node`.

    A node may have any number of neighbours, so they are dealt to SALTS groups by the other end; a
    node's least comes back to its groups, at most SALTS rows, and joins there.
    """
    dealt = edges.withColumn("s", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    groups = dealt.groupBy(node, "s").agg(F.min(other).alias("m"))
    least = groups.groupBy(node).agg(F.min("m").alias("m"))
    return dealt.join(groups.select(node, "s").join(least, node), [node, "s"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, "u", "v").filter(F.col("v") > F.col("u")).select(F.least("u", "m").alias("u"), "v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    near = _with_least(edges, "v", "u")
    each = F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("u").alias("v")), F.struct(F.col("m").alias("u"), F.col("v").alias("v"))))
    return near.select(each.alias("e")).select("e.u", "e.v").filter(F.col("u") < F.col("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


#: Links that a file of a pass is to have at least, so that few links make few files and tasks.
ROWS = 200_000


def components(links: DataFrame, most: int = 100) -> DataFrame:
    """(node, component) of all nodes of the links (u, v); component: the smallest node reachable.

    Self-links give a node by itself, rows with a null end are left out, an empty table gives no
    rows. Each pass combines minima before its shuffles and is written to the shared folder, so the
    lineage stays short and no component is ever gathered in one place; the pass before is deleted.
    A star that does not settle within `most` passes raises an error.
    """
    folder = fresh_dir(links.sparkSession, "components")
    known = links.select("u", "v").filter(F.col("u").isNotNull() & F.col("v").isNotNull())
    base = kept_in(known.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{folder}/links")
    edges = base.filter(F.col("u") < F.col("v"))
    before, last = _mark(edges), None
    for i in range(most if before[0] else 0):
        tasks = max(8, before[0] // ROWS)
        edges = kept_in(_small_star(_large_star(edges)).coalesce(tasks), f"{folder}/{i}")
        if last is not None:
            discard(f"{folder}/{last}")
        now, last = _mark(edges), i
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    stars = edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
    centres = edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    alone = base.filter(F.col("u") == F.col("v")).select(F.col("u").alias("node"), F.col("u").alias("component"))
    linked = stars.union(centres)
    return linked.union(alone.join(linked, "node", "left_anti"))
