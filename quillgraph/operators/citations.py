"""Citations between patents, projected on concept pairs as evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import numeric as N
from quillgraph.functions.text import is_usable_reference, normalize_patent_number, normalize_reference


def resolve_references(patents: DataFrame) -> DataFrame:
    """(patent_id, reference, key, cited): each usable reference with the first patent of that number, itself excluded; cited is null outside the table."""
    refs = patents.select("patent_id", F.explode("references").alias("reference")).filter(is_usable_reference(F.col("reference"))).withColumn("key", normalize_reference(F.col("reference")))
    own = patents.select("patent_id", normalize_patent_number(F.col("patent_number")).alias("key")).filter(F.col("key").isNotNull())
    first = own.groupBy("key").agg(F.min("patent_id").alias("cited"))
    return refs.join(first, "key", "left").select("patent_id", "reference", "key", F.when(F.col("cited") != F.col("patent_id"), F.col("cited")).alias("cited"))


def split_references(patents: DataFrame) -> DataFrame:
    """(patent_id, internal, external): keys of references to other patents of the table, and of all the rest, sorted."""
    r = resolve_references(patents)
    return r.groupBy("patent_id").agg(F.array_sort(F.collect_set(F.when(F.col("cited").isNotNull(), F.col("key")))).alias("internal"), F.array_sort(F.collect_set(F.when(F.col("cited").isNull(), F.col("key")))).alias("external"))


def with_references(patents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patents, citations): `references` keeps what is in the table, `external_references` gets the rest (null where there is none); citations are (from_patent, to_patent).

    Numbers belong to the first patent of the table that has them; a patent does not cite itself.
    """
    found = split_references(patents)
    filled = lambda c: F.when(F.size(c) > 0, F.col(c))
    split = patents.drop("references", "external_references").join(found, "patent_id", "left").withColumn("references", filled("internal")).withColumn("external_references", filled("external")).drop("internal", "external")
    cited = resolve_references(patents).filter(F.col("cited").isNotNull()).select(F.col("patent_id").alias("from_patent"), F.col("cited").alias("to_patent")).distinct()
    return split, cited


def clean(citations: DataFrame) -> DataFrame:
    """Distinct (from_patent, to_patent) with both ends."""
    ok = lambda c: F.coalesce(F.col(c).cast("string") != "", F.lit(False))
    return citations.select("from_patent", "to_patent").filter(ok("from_patent") & ok("to_patent")).distinct()


def projected(citations: DataFrame, membership: DataFrame) -> DataFrame:
    """(from, to, n): citations between patents of two different concepts."""
    src, dst = membership.select(F.col("patent_id").alias("from_patent"), F.col("concept").alias("from")), membership.select(F.col("patent_id").alias("to_patent"), F.col("concept").alias("to"))
    return clean(citations).join(src, "from_patent").join(dst, "to_patent").filter(F.col("from") != F.col("to")).groupBy("from", "to").agg(F.count(F.lit(1)).alias("n"))


def with_reverse(counts: DataFrame) -> DataFrame:
    """(from, to, forward, reverse) of every cited direction; combined by unordered pair, with no self-join."""
    a, b = F.least("from", "to"), F.greatest("from", "to")
    both = counts.groupBy(a.alias("a"), b.alias("b")).agg(F.sum(F.when(F.col("from") == a, F.col("n")).otherwise(0)).alias("ab"), F.sum(F.when(F.col("from") == b, F.col("n")).otherwise(0)).alias("ba"))
    return both


def edge_evidence(edges: DataFrame, counts: DataFrame) -> DataFrame:
    """Directed edges (from, to, ...) with forward, reverse, state, citation_supported and citation_direction_conflict."""
    pairs = with_reverse(counts)
    e = edges.withColumn("a", F.least("from", "to")).withColumn("b", F.greatest("from", "to"))
    joined = e.join(pairs, ["a", "b"], "left")
    ahead = F.col("from") == F.col("a")
    forward, reverse = (F.coalesce(F.when(ahead, F.col(x)).otherwise(F.col(y)), F.lit(0)) for x, y in (("ab", "ba"), ("ba", "ab")))
    out = joined.withColumn("forward", forward).withColumn("reverse", reverse).withColumn("state", N.citation_state(F.col("forward"), F.col("reverse")))
    return out.withColumn("citation_supported", F.col("directed") & F.col("state").isin("aligned", "conflicting")).withColumn("citation_direction_conflict", F.col("directed") & (F.col("state") == "conflicting")).drop("a", "b", "ab", "ba")


def citation_only(counts: DataFrame, relation_pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """(from, to, forward, reverse, conflict) of cited pairs without a relation edge that medians can orient and citations support."""
    known = relation_pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = with_reverse(counts).join(known, ["a", "b"], "left_anti")
    ma, mb = (stats.select(F.col("concept").alias(c), F.col("median_year").alias(f"m{c}")) for c in ("a", "b"))
    side = N.orientation(F.col("ma"), F.col("mb"))
    out = pairs.join(ma, "a", "left").join(mb, "b", "left").filter(side.isNotNull())
    back = side == "b"
    pick = lambda x, y: F.when(back, F.col(y)).otherwise(F.col(x))
    out = out.select(pick("a", "b").alias("from"), pick("b", "a").alias("to"), pick("ab", "ba").alias("forward"), pick("ba", "ab").alias("reverse"))
    state = N.citation_state(F.col("forward"), F.col("reverse"))
    return out.filter(state.isin("aligned", "conflicting")).withColumn("conflict", state == "conflicting")


def previous_by(patents: DataFrame, key: str, order: list[str], back: int = 1) -> DataFrame:
    """(from_patent, to_patent): each patent cites the one `back` places before it under the key."""
    prior = F.lag("patent_id", back).over(Window.partitionBy(key).orderBy(*order))
    return patents.select(F.col("patent_id").alias("from_patent"), prior.alias("to_patent")).filter(F.col("to_patent").isNotNull())
