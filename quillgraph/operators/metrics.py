"""Metrics of concept pairs in two units: patents, and institutions (applicants)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import numeric as N
from quillgraph.operators import network
from quillgraph.shared import discard, fresh_dir, kept_in


def incident_sums(edges: DataFrame, support: str) -> DataFrame:
    """(concept, total): summed support of each concept's edges."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("concept"), F.col(support).alias("s"))
    return ends.groupBy("concept").agg(F.sum("s").alias("total"))


def with_association(edges: DataFrame, support: str, name: str) -> DataFrame:
    """Adds the association strength of a support column: S c_ij / (c_i c_j) over the given edges.

    S is the sum of all edges' support. The totals by concept are an aggregate of the edges'
    ends; the overall sum is one row.
    """
    sums = incident_sums(edges, support)
    total = edges.agg(F.coalesce(F.sum(support), F.lit(0)).alias("_all"))
    ca, cb = (sums.select(F.col("concept").alias(c), F.col("total").alias(f"_c{c}")) for c in ("a", "b"))
    out = edges.join(ca, "a", "left").join(cb, "b", "left").crossJoin(F.broadcast(total))
    return out.withColumn(name, N.association(F.col("_all"), F.col(support), F.col("_ca"), F.col("_cb"))).drop("_ca", "_cb", "_all")


def unit_metrics(membership: DataFrame, ownership: DataFrame, total_patents: DataFrame | int | None = None, total_applicants: DataFrame | int | None = None, held: DataFrame | None = None) -> DataFrame:
    """Concept pairs with support, Jaccard, NPMI and association strength in patents and in applicants.

    Pairs are those that share a patent. total_patents and total_applicants, numbers or frames of one, are
    the denominators of the NPMI: a stored graph counts all patents and applicants, a filtered view its
    cohort and only applicants that hold a concept (the default here). Thresholds come after this, never before.

    The memberships, what applicants hold and the pairs are read several times and written once each;
    held: the applicants' concepts, if membership and they are written already.
    """
    folder = fresh_dir(membership.sparkSession, "units")
    if held is None:
        membership = kept_in(membership, f"{folder}/membership")
        held = kept_in(network.applicant_concepts(membership, ownership), f"{folder}/held")
    edges = network.cooccurrence(membership)
    holders = network.concept_applicants(held)
    shared = network.pairs_by_join(held, "applicant", "concept").withColumnRenamed("support", "support_applicants")
    na, nb = (holders.select(F.col("concept").alias(c), F.col("applicant_count").alias(f"applicants_{c}")) for c in ("a", "b"))
    edges = edges.join(shared, ["a", "b"], "left").join(na, "a", "left").join(nb, "b", "left").na.fill(0, ["support_applicants", "applicants_a", "applicants_b"])
    for name, given, counted in (("_np", total_patents, membership.agg(F.count_distinct("patent_id"))), ("_na", total_applicants, held.agg(F.count_distinct("applicant")))):
        # one row each
        edges = edges.withColumn(name, F.lit(given)) if isinstance(given, int) else edges.crossJoin(F.broadcast((counted if given is None else given).toDF(name)))

    def share(n: str, of: str):
        return F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(F.lit(0.0))

    edges = edges.select(
        "a", "b", "support", "jaccard", "support_applicants",
        N.jaccard(F.col("support_applicants"), F.col("applicants_a"), F.col("applicants_b")).alias("jaccard_applicants"),
        N.npmi(share("support", "_np"), share("frequency_a", "_np"), share("frequency_b", "_np")).alias("npmi"),
        N.npmi(share("support_applicants", "_na"), share("applicants_a", "_na"), share("applicants_b", "_na")).alias("npmi_applicants"),
    )
    edges = kept_in(edges, f"{folder}/pairs")
    discard(f"{folder}/membership")
    discard(f"{folder}/held")
    # both sums of each concept's edges at once; all edges' sum is half of theirs
    ends = edges.select(F.explode(F.array("a", "b")).alias("concept"), "support", "support_applicants")
    sums = kept_in(ends.groupBy("concept").agg(F.sum("support").alias("_s"), F.sum("support_applicants").alias("_t")), f"{folder}/sums")
    total = sums.agg((F.coalesce(F.sum("_s"), F.lit(0)) / 2).cast("long").alias("_ss"), (F.coalesce(F.sum("_t"), F.lit(0)) / 2).cast("long").alias("_tt"))
    ca, cb = (sums.select(F.col("concept").alias(c), F.col("_s").alias(f"_s{c}"), F.col("_t").alias(f"_t{c}")) for c in ("a", "b"))
    out = edges.join(ca, "a").join(cb, "b").crossJoin(F.broadcast(total))
    out = out.withColumn("association_strength", N.association(F.col("_ss"), F.col("support"), F.col("_sa"), F.col("_sb")))
    out = out.withColumn("association_strength_applicants", N.association(F.col("_tt"), F.col("support_applicants"), F.col("_ta"), F.col("_tb")))
    return out.select(*edges.columns, "association_strength", "association_strength_applicants")


def node_degrees(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """(node, degree, weighted_degree, in_degree, out_degree) of edges (from, to[, directed][, weight])."""
    w = F.coalesce(F.col(weight), F.lit(1.0)) if weight else F.lit(1.0)
    directed = F.coalesce(F.col("directed"), F.lit(False)) if "directed" in edges.columns else F.lit(False)
    ends = edges.select(F.explode(F.array(F.struct(F.col("from").alias("node"), F.lit(1).alias("out")), F.struct(F.col("to").alias("node"), F.lit(0).alias("out")))).alias("e"), w.alias("w"), directed.cast("int").alias("d"))
    return ends.groupBy("e.node").agg(
        F.count(F.lit(1)).alias("degree"), F.sum("w").alias("weighted_degree"), F.sum(F.col("d") * (1 - F.col("e.out"))).alias("in_degree"), F.sum(F.col("d") * F.col("e.out")).alias("out_degree")
    )


def max_support(edges: DataFrame, support: str = "support") -> DataFrame:
    return edges.agg(F.greatest(F.lit(1).cast("long"), F.coalesce(F.max(support), F.lit(1).cast("long"))).alias("max_support"))
