"""Facts and the concept network: memberships, synonyms, co-occurrence and semantic edges.

Facts are `membership(patent_id, concept)` and `ownership(patent_id, applicant)`, each row once.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import numeric as N
from quillgraph.functions.text import squeeze

#: Rows up to which the synonym dictionary is broadcast; a larger one is joined as Spark sees fit.
BROADCAST_ROWS = 100_000


def laid_out(facts: DataFrame, key: str = "patent_id") -> DataFrame:
    """Facts with all columns set, each once, hash-partitioned by the key.

    The distinct, the grouping by patent and the joins on it then share one shuffle, and equal
    subplans of a query are the same exchange, which Spark runs once.
    """
    return facts.dropna().repartition(key).distinct()


def memberships(extractions: DataFrame) -> DataFrame:
    """(patent_id, concept), distinct and squeezed, blank ones left out."""
    each = extractions.select("patent_id", F.explode("keywords").alias("k")).select("patent_id", squeeze(F.col("k")).alias("concept"))
    return laid_out(each.filter(F.col("concept") != ""))


def relations(extractions: DataFrame) -> DataFrame:
    """(patent_id, ordinal, source, target, relation, weight, reason, confidence)."""
    each = extractions.select("patent_id", F.posexplode("relations").alias("ordinal", "r"))
    return each.select("patent_id", "ordinal", "r.*")


# ---------------------------------------------------------------- synonyms


def synonym_map(groups: Iterable[tuple[str, list[str]]]) -> tuple[dict[str, str], list[str]]:
    """alias -> canonical of groups that come sorted by canonical, and warnings.

    Order decides: a group whose canonical is already mapped is dropped with all its aliases, and a
    taken alias is skipped.
    """
    out: dict[str, str] = {}
    warnings: list[str] = []
    for canonical, aliases in groups:
        own = " ".join(canonical.split())
        if not own:
            continue
        if own in out and out[own] != own:
            warnings.append(f"{own}: is an alias of {out[own]}; group dropped")
            continue
        out[own] = own
        for alias in aliases or []:
            a = " ".join(alias.split())
            if not a or a == own:
                continue
            if a in out:
                warnings.append(f"{a}: belongs to {out[a]}; not mapped to {own}")
            else:
                out[a] = own
    return out, warnings


def synonym_table(spark: SparkSession, groups: DataFrame, collation: str = "zh_Hant") -> tuple[DataFrame, list[str]]:
    """(alias, canonical) of curated groups (id, canonical, aliases), in the collation's order. The driver holds the dictionary, which people write."""
    rows = groups.select("canonical", "aliases").orderBy(F.collate("canonical", collation), "canonical").toLocalIterator()
    found, warnings = synonym_map((r["canonical"], r["aliases"]) for r in rows)
    return spark.createDataFrame(list(found.items()) or [], "alias string, canonical string"), warnings


def canonicalise(facts: DataFrame, synonyms: DataFrame, column: str = "concept") -> DataFrame:
    """facts with the column's canonical form, each row once: before any pairing."""
    lookup = synonyms.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_canonical"))
    lookup = F.broadcast(lookup) if lookup.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lookup
    own = squeeze(F.col(column))
    joined = facts.join(lookup, own == F.col("_alias"), "left")
    return joined.withColumn(column, F.coalesce("_canonical", own)).drop("_alias", "_canonical").distinct()


# ---------------------------------------------------------------- aggregates


def concept_frequency(membership: DataFrame) -> DataFrame:
    """(concept, frequency): distinct patents."""
    return membership.groupBy("concept").agg(F.count(F.lit(1)).alias("frequency"))


def concept_sources(membership: DataFrame) -> DataFrame:
    """(concept, frequency, source_patents)."""
    return membership.groupBy("concept").agg(F.count(F.lit(1)).alias("frequency"), F.array_sort(F.collect_list("patent_id")).alias("source_patents"))


def pairs_by(facts: DataFrame, key: str, item: str) -> DataFrame:
    """(a, b, support): distinct keys that hold both items, a < b.

    A key's items are gathered in one array (one shuffle, which the two sides of a self-join would
    both need), its pairs are made inside the row, and supports are combined before the second
    shuffle. Fit for keys with a bounded number of items, as concepts of a patent; use
    pairs_by_join for keys that may hold any number.
    """
    sets = facts.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("s")).filter(F.size("s") > 1)
    each = sets.select("s", F.posexplode("s").alias("i", "a"))
    both = each.select("a", F.explode(F.slice("s", F.col("i") + 2, F.greatest(F.size("s") - F.col("i") - 1, F.lit(0)))).alias("b"))
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("support"))


def pairs_by_join(facts: DataFrame, key: str, item: str) -> DataFrame:
    """As pairs_by, by a self-join on the key that adaptive execution can split where a key is hot."""
    left, right = facts.select(key, F.col(item).alias("a")), facts.select(key, F.col(item).alias("b"))
    return left.join(right, key).filter(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("support"))


def cooccurrence(membership: DataFrame, frequency: DataFrame | None = None) -> DataFrame:
    """(a, b, support, frequency_a, frequency_b, jaccard) of concept pairs, in patents."""
    freq = concept_frequency(membership) if frequency is None else frequency
    pairs = pairs_by(membership, "patent_id", "concept")
    fa, fb = (freq.select(F.col("concept").alias(c), F.col("frequency").alias(f"frequency_{c}")) for c in ("a", "b"))
    return pairs.join(fa, "a").join(fb, "b").select("a", "b", "support", "frequency_a", "frequency_b", N.jaccard(F.col("support"), F.col("frequency_a"), F.col("frequency_b")).alias("jaccard"))


def admissible(rels: DataFrame, membership: DataFrame) -> DataFrame:
    """Relations with all parts, two different ends, and both ends among the same patent's concepts."""
    src, dst = squeeze(F.col("source")), squeeze(F.col("target"))
    clean = rels.withColumn("source", src).withColumn("target", dst).filter((F.col("source") != "") & (F.col("target") != "") & (F.trim("relation") != "") & (F.col("source") != F.col("target")))
    for end in ("source", "target"):
        clean = clean.join(membership.select("patent_id", F.col("concept").alias(end)), ["patent_id", end], "left_semi")
    return clean


def semantic_edges(rels: DataFrame, with_evidence: bool = True) -> DataFrame:
    """(source, target, relation, support, weight, reason, confidence[, evidence]) of directed relations.

    support: distinct patents; weight: mean of the finite weights; reason and confidence: of the
    first evidence by (patent_id, ordinal), a missing ordinal after all others of its patent.
    """
    finite = F.when(~F.isnan("weight") & (F.abs("weight") < float("inf")), F.col("weight"))
    place = ["patent_id", F.col("ordinal").isNull().alias("unplaced"), "ordinal"]
    first = F.struct(*place)
    aggs = [F.count_distinct("patent_id").alias("support"), F.avg(finite).alias("weight"), F.min_by("reason", first).alias("reason"), F.min_by("confidence", first).alias("confidence")]
    if with_evidence:
        aggs.append(F.transform(F.sort_array(F.collect_list(F.struct(*place, "weight", "reason", "confidence"))), lambda e: F.struct(e["patent_id"].alias("patent_id"), e["weight"].alias("weight"), e["reason"].alias("reason"), e["confidence"].alias("confidence"))).alias("evidence"))
    return rels.groupBy("source", "target", "relation").agg(*aggs)


def applicant_patents(ownership: DataFrame) -> DataFrame:
    return ownership.groupBy("applicant").agg(F.count_distinct("patent_id").alias("patent_count"))


def applicant_concepts(membership: DataFrame, ownership: DataFrame) -> DataFrame:
    """(applicant, concept), distinct over all patents of the applicant."""
    return membership.join(ownership, "patent_id").select("applicant", "concept").distinct()


def concept_applicants(held: DataFrame) -> DataFrame:
    """(concept, applicant_count) of (applicant, concept)."""
    return held.groupBy("concept").agg(F.count(F.lit(1)).alias("applicant_count"))
