"""Where graphs go: partitioned tables, JSON snapshots, CSV, an upload archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("patents", "membership", "ownership", "relations", "edges", "citations", "communities", "analyses")


def save(frames: dict[str, DataFrame], root: str, analysis_id: str) -> None:
    """Replaces an analysis in each table: one partition by analysis_id, all others stay."""
    for name, df in frames.items():
        if name not in TABLES:
            raise ValueError(f"no such table: {name}")
        out = df.drop("analysis_id").withColumn("analysis_id", F.lit(analysis_id))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("analysis_id").parquet(f"{root}/{name}")


def load(spark: SparkSession, root: str, analysis_id: str, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """The tables of an analysis, read by partition pruning; tables that were never written are left out."""
    from pyspark.errors import AnalysisException

    out = {}
    for name in names:
        try:
            out[name] = spark.read.parquet(f"{root}/{name}").filter(F.col("analysis_id") == analysis_id).drop("analysis_id")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return out


def membership_from_edges(edges: DataFrame, patents: DataFrame, concepts: DataFrame, applicants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(membership, ownership) of stored structural edges (from, to, relation) whose ends exist."""
    has = edges.filter(F.col("relation") == "包含").select(F.col("from").alias("patent"), F.col("to").alias("concept"))
    owns = edges.filter(F.col("relation") == "申請了").select(F.col("from").alias("applicant"), F.col("to").alias("patent"))
    p = patents.select(F.col("id").alias("patent"))
    m = has.join(p, "patent", "left_semi").join(concepts.select(F.col("id").alias("concept")), "concept", "left_semi").dropDuplicates(["patent", "concept"])
    o = owns.join(p, "patent", "left_semi").join(applicants.select(F.col("id").alias("applicant")), "applicant", "left_semi").dropDuplicates(["applicant", "patent"])
    return m, o


def snapshot(df: DataFrame, path: str) -> None:
    """JSON lines; the committer makes the folder appear whole or not at all."""
    df.write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays become texts joined by a semicolon."""
    flat = [F.array_join(F.transform(c, lambda x: x.cast("string")), ";").alias(c) if t.startswith("array") else F.col(c) if not t.startswith(("map", "struct")) else F.to_json(c).alias(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def archive(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, bytes, sha256) of uploaded files."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def valid_positions(positions: DataFrame, nodes: DataFrame, most: int = 50_000) -> bool:
    """Whether positions (id, x, y) name exactly the view's nodes, within the limit, with finite numbers."""
    finite = ~F.isnan("x") & ~F.isnan("y") & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    a = positions.join(nodes.select("id"), "id", "left_anti")
    b = nodes.select("id").join(positions, "id", "left_anti")
    return a.isEmpty() and b.isEmpty() and positions.filter(~F.coalesce(finite, F.lit(False))).isEmpty() and positions.limit(most + 1).count() <= most


def save_graph(g, root: str, analysis_id: str, status: str = "done") -> None:
    """Replaces an analysis: its facts, and a row of what is known of it as a whole."""
    frames = {n: df for n in ("patents", "membership", "ownership", "relations", "citations", "communities") if (df := getattr(g, n)) is not None}
    spark = g.patents.sparkSession
    about = spark.createDataFrame([(status, g.methodology, [e["edge_id"] for e in g.broken_cycles])], "status string, methodology map<string,string>, broken_cycles array<string>")
    save(frames | {"analyses": about}, root, analysis_id)


def load_graph(spark: SparkSession, root: str, analysis_id: str):
    """The graph of a stored analysis; None if it is unknown or not done."""
    from quillgraph.plans.views import Graph

    found = load(spark, root, analysis_id)
    about = found["analyses"].first() if "analyses" in found else None
    if about is None or about["status"] != "done":
        return None
    parts = {n: found.get(n) for n in ("relations", "citations", "communities")}
    # a table that other analyses have written is there, but empty for this one
    parts = {n: None if df is None or df.isEmpty() else df for n, df in parts.items()}
    return Graph(found["patents"], found["membership"], found["ownership"], **parts, methodology=about["methodology"] or {}, broken_cycles=[{"edge_id": x} for x in about["broken_cycles"] or []])


def known_ids(spark: SparkSession, root: str) -> set[str]:
    """Ids of stored analyses, from the partitions' names."""
    from pyspark.errors import AnalysisException

    try:
        return {r["analysis_id"] for r in spark.read.parquet(f"{root}/analyses").select("analysis_id").distinct().collect()}
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return set()


def import_folder(spark: SparkSession, pattern: str, root: str, force: bool = False) -> dict[str, list[str]]:
    """Stores each JSON payload of a folder as the analysis of its file name; known ids are skipped unless forced.

    Returns the ids imported, skipped and failed. A payload that cannot be read as a graph fails alone.
    """
    from quillgraph.sources import graph_json

    out: dict[str, list[str]] = {"imported": [], "skipped": [], "failed": []}
    known = set() if force else known_ids(spark, root)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(pattern).select("path").orderBy("path")
    for path in [r["path"] for r in files.collect()]:
        own = path.rsplit("/", 1)[-1].removesuffix(".json")
        if own in known:
            out["skipped"].append(own)
            continue
        payload = graph_json.read(spark, path)
        if payload.filter(F.col("nodes").isNotNull() & F.col("edges").isNotNull()).isEmpty():
            out["failed"].append(own)
            continue
        save_graph(graph_json.as_graph(graph_json.normalise(payload)), root, own)
        out["imported"].append(own)
    return out
