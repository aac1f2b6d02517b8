"""Subgraphs of a view: hops from a centre, hops from keyword matches, and what to say about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import matches_keyword
from quillgraph.shared import kept

MOST_HOPS = 3


def reach(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(id, hop) of nodes within `hops` of the seeds (id); edges (from, to) of any kind, both ways.

    The adjacency and each hop are written once, so a hop's plan does not repeat the ones before.
    """
    if not 0 <= hops <= MOST_HOPS:
        raise ValueError(f"hops must be 0..{MOST_HOPS}")
    both = edges.select(F.col("from").alias("id"), F.col("to").alias("next")).union(edges.select(F.col("to").alias("id"), F.col("from").alias("next"))).distinct()
    found = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    if not hops:
        return found
    both = kept(both, "adjacency")
    found = edge_of = kept(found, "hop")
    for h in range(1, hops + 1):
        nxt = edge_of.join(both, "id").select(F.col("next").alias("id")).distinct().join(found, "id", "left_anti").withColumn("hop", F.lit(h))
        nxt = kept(nxt, "hop") if h < hops else nxt
        found, edge_of = found.union(nxt), nxt
    return found


def induced(nodes: DataFrame, edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges inside the kept ids."""
    ids = keep.select("id").distinct()
    e = edges
    for end in ("from", "to"):
        e = e.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    return nodes.join(ids, "id", "left_semi"), e


def around(nodes: DataFrame, edges: DataFrame, centre, hops: int) -> tuple[DataFrame, DataFrame]:
    """The subgraph of a centre; an unknown centre leaves the view as it is."""
    seeds = nodes.filter(F.col("id") == F.lit(centre)).select("id")
    return (nodes, edges) if seeds.isEmpty() else induced(nodes, edges, reach(seeds, edges, hops))


def by_keyword(nodes: DataFrame, edges: DataFrame, keyword: str | None, hops: int) -> tuple[DataFrame, DataFrame]:
    """The subgraph of all nodes that match; no match, or a blank keyword, leaves the view as it is."""
    if not 0 <= hops <= 2:
        raise ValueError("hops must be 0..2")
    columns = [F.col(c) for c in ("label", "title", "abstract", "applicant") if c in nodes.columns]
    seeds = nodes.filter(matches_keyword(keyword, *columns)).select("id")
    return (nodes, edges) if seeds.isEmpty() else induced(nodes, edges, reach(seeds, edges, hops))


def search(nodes: DataFrame, keyword: str, most: int = 25) -> DataFrame:
    columns = [F.col(c) for c in ("label", "title", "abstract", "applicant") if c in nodes.columns]
    return nodes.filter(matches_keyword(keyword, *columns)).orderBy("label", "id").limit(most)


def neighbours(edges: DataFrame, centre) -> DataFrame:
    """(neighbour, jaccard, support): direct edges of the centre, most alike first, then best supported. One row for each edge."""
    ahead = F.col("from") == F.lit(centre)
    touching = edges.filter(ahead | (F.col("to") == F.lit(centre)))
    return touching.select(F.when(ahead, F.col("to")).otherwise(F.col("from")).alias("neighbour"), "jaccard", "support").orderBy(F.desc_nulls_last("jaccard"), F.desc_nulls_last("support"), "neighbour")


def adjacent(nodes: DataFrame, edges: DataFrame, centre, most: int = 12, order: str = "id") -> DataFrame:
    """The first `most` nodes, in the nodes' order, that share an edge with the centre."""
    near = neighbours(edges.select("from", "to", F.lit(None).cast("double").alias("jaccard"), F.lit(None).cast("long").alias("support")), centre).select(F.col("neighbour").alias("id")).distinct()
    return nodes.join(near, "id", "left_semi").orderBy(order).limit(most)


def metrics(edges: DataFrame, centre) -> DataFrame:
    """One row: direct edges and distinct neighbours."""
    return neighbours(edges, centre).agg(F.count(F.lit(1)).alias("direct_edges"), F.count_distinct("neighbour").alias("direct_neighbours"))


def community_composition(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("community_id").isNotNull()).groupBy("community_id").agg(F.count(F.lit(1)).alias("n"))
