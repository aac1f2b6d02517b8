"""Graphs stored as JSON: reading, repair and rebuilding of old payloads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import community, network
from quillgraph.schema import EDGES, NODES

# fixed values: kinds of nodes, edges and confidence, and what stands for missing ones
NODE_TYPES = ("applicant", "patent", "concept")
EDGE_KINDS = ("structural", "cooccurrence", "semantic", "institution")
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
DEFAULT_COLOUR, PATENT_SIZE, DEFAULT_SIZE = "#BAB0AC", 18.0, 18.0
CONTAINS, FILED, TOGETHER = "包含", "申請了", "共同出現"
METHODOLOGY = {"cooccurrence_data": ("native", "reconstructed", "unavailable"), "semantic_provenance": ("complete", "partial", "unavailable"), "community_edge_weight": ("support_count", "association_strength")}

PAYLOAD = f"schema_version int, nodes array<struct<{NODES.replace(' string', ':string').replace(' double', ':double').replace(' long', ':bigint').replace(' int', ':int').replace(' array', ':array')}>>, edges array<struct<id:string,kind:string,`from`:string,`to`:string,relation:string,weight:double,support_count:bigint,jaccard:double,confidence:string,reason:string,source_patent:string,source_patents:array<string>,temporal_directed:boolean>>, methodology map<string,string>"


@dataclass
class StoredGraph:
    version: int
    nodes: DataFrame
    edges: DataFrame
    methodology: dict[str, str]


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each payload file."""
    return spark.read.schema(PAYLOAD).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))


def schema_version(v: int | None) -> int:
    return v if v in (3, 4) else 2


def _texts(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(c, F.array().cast("array<string>")))))


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def clean_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with an id, a label and a known type; colour, size and lists filled in."""
    ok = (F.coalesce("id", F.lit("")) != "") & (F.coalesce("label", F.lit("")) != "") & F.col("type").isin(*NODE_TYPES)
    out = nodes.filter(ok).withColumn("color", F.coalesce("color", F.lit(DEFAULT_COLOUR))).withColumn("source_patents", _texts(F.col("source_patents")))
    return out.withColumn("size", F.coalesce(finite(F.col("size")), F.when(F.col("type") == "patent", F.lit(PATENT_SIZE)).otherwise(F.lit(DEFAULT_SIZE))))


def edge_kind() -> Column:
    """The kind as given, else by what the edge joins and says."""
    concepts = F.col("from").startswith("concept:") & F.col("to").startswith("concept:")
    together = (F.col("relation") == TOGETHER) & (F.coalesce("support_count", F.lit(0)) != 0)
    return F.when(F.col("kind").isin(*EDGE_KINDS), F.col("kind")).when(~concepts, F.lit("structural")).when(together, F.lit("cooccurrence")).otherwise(F.lit("semantic"))


def clean_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an id, a relation and both ends among the nodes."""
    ids = nodes.select("id")
    out = edges.filter((F.coalesce("id", F.lit("")) != "") & (F.coalesce("relation", F.lit("")) != ""))
    for end in ("from", "to"):
        out = out.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    return out.withColumn("kind", edge_kind()).withColumn("confidence", F.when(F.col("confidence").isin(*CONFIDENCES), F.col("confidence"))).withColumn("source_patents", _texts(F.col("source_patents")))


def methodology(given: dict[str, str] | None, **defaults: str) -> dict[str, str]:
    """Each field as given if it is allowed, else its default."""
    given = given or {}
    return {k: given[k] if given.get(k) in allowed else defaults.get(k, allowed[0]) for k, allowed in METHODOLOGY.items()}


def normalise(payload: DataFrame) -> StoredGraph:
    """A payload's graph: versions 2 to 4 keep their network, anything older is rebuilt from its structural edges."""
    head = payload.select("schema_version", "methodology").first()
    version = head["schema_version"] if head else None
    nodes = clean_nodes(payload.select(F.explode("nodes").alias("n")).select("n.*"))
    edges = clean_edges(payload.select(F.explode("edges").alias("e")).select("e.*"), nodes)
    if version in (2, 3, 4):
        return StoredGraph(schema_version(version), nodes, edges, methodology(head["methodology"]))
    return rebuild(nodes, edges)


def rebuild(nodes: DataFrame, edges: DataFrame) -> StoredGraph:
    """The concept network of a payload without one, from its structural edges; relations keep only the sources that were seen."""
    structural = edges.filter(F.col("kind") == "structural")
    has = structural.filter((F.col("relation") == CONTAINS) & F.col("from").startswith("patent:") & F.col("to").startswith("concept:"))
    labels = nodes.filter(F.col("type") == "concept").select(F.col("id").alias("to"), "label")
    membership = has.join(labels, "to").select(F.regexp_replace("from", "^patent:", "").alias("patent_id"), F.col("label").alias("concept")).distinct()
    freq = network.concept_sources(membership)
    pairs = network.cooccurrence(membership)
    found = community.detect(freq.select("concept"), pairs)
    owned = structural.filter(F.col("relation") == FILED).groupBy(F.col("from").alias("id")).agg(F.count_distinct("to").alias("_owned"))
    from quillgraph.functions import numeric as N

    n = nodes.drop("frequency", "source_patents", "community_id", "patent_count").join(freq.withColumnRenamed("concept", "label"), "label", "left").join(found.withColumnRenamed("concept", "label"), "label", "left").join(owned, "id", "left")
    concept = F.col("type") == "concept"
    n = n.withColumn("frequency", F.when(concept, F.coalesce("frequency", F.lit(0)))).withColumn("patent_count", F.when(F.col("type") == "applicant", F.coalesce("_owned", F.lit(0))))
    n = n.withColumn("size", F.when(concept, N.concept_size(F.col("frequency"))).when(F.col("type") == "applicant", N.applicant_size(F.col("patent_count"))).otherwise(F.lit(PATENT_SIZE))).drop("_owned")
    together = pairs.select(F.concat(F.lit("concept:"), "a").alias("from"), F.concat(F.lit("concept:"), "b").alias("to"), F.lit(TOGETHER).alias("relation"), F.lit("cooccurrence").alias("kind"), F.col("support").alias("support_count"), "jaccard")
    semantic = edges.filter(F.col("kind") == "semantic").withColumn("source_patents", _texts(F.concat("source_patents", F.array("source_patent")))).withColumn("support_count", F.lit(None).cast("bigint"))
    every = structural.unionByName(together, allowMissingColumns=True).unionByName(semantic, allowMissingColumns=True)
    state = "unavailable" if membership.isEmpty() else "reconstructed"
    return StoredGraph(2, n, every, methodology(None, cooccurrence_data=state, semantic_provenance="unavailable" if semantic.isEmpty() else "partial"))


def as_graph(stored: StoredGraph):
    """The facts of a stored graph, for views: what its structural edges say."""
    from quillgraph.plans.views import Graph, facts_of
    from quillgraph.operators import temporal

    bare = lambda c, kind: F.regexp_replace(c, f"^{kind}:", "")
    membership, ownership = facts_of(stored.edges.filter(F.col("kind") == "structural"))
    patents = stored.nodes.filter(F.col("type") == "patent").select(bare("id", "patent").alias("patent_id"), "year", F.coalesce("source_files", F.array().cast("array<string>")).alias("source_files"), "ipc5")
    concepts = stored.nodes.filter(F.col("type") == "concept")
    groups = concepts.select(bare("id", "concept").alias("concept"), "community_id", "community_id_applicants") if {"community_id", "community_id_applicants"} <= set(concepts.columns) else None
    broken = []
    if {"temporal_directed"} <= set(stored.edges.columns):
        broken = temporal.legacy_cycles(stored.edges, concepts.select("id", "median_year"))
    return Graph(patents, membership, ownership, communities=groups, methodology=stored.methodology, broken_cycles=broken)
