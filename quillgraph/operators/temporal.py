"""Years of concepts: order statistics, leave-one-out medians, direction, layout, cycle repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import numeric as N
from quillgraph.functions.text import fnv1a32


def concept_years(membership: DataFrame, patents: DataFrame, max_year: int) -> DataFrame:
    """(concept, year) of the valid years of a concept's patents; equal years stay."""
    years = patents.select("patent_id", "year").filter(N.is_valid_year(F.col("year"), max_year))
    return membership.join(years, "patent_id").select("concept", "year")


def year_stats(years: DataFrame) -> DataFrame:
    """First, quartile (nearest rank), median, last year, leave-one-out range of the median, and year counts of each concept.

    Counts by (concept, year) come first, so a concept's task sees as many rows as it has years,
    however many patents it has; order statistics are read off the running counts.
    """
    counts = years.groupBy("concept", "year").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("concept")
    run = counts.withColumn("upto", F.sum("c").over(w.orderBy("year"))).withColumn("n", F.sum("c").over(w))

    def at(rank):
        """The value of that rank, from 1; null outside."""
        return F.max(F.when((F.col("upto") >= rank) & (F.col("upto") - F.col("c") < rank), F.col("year")))

    n, half = F.col("n"), F.floor(F.col("n") / 2)
    stats = run.groupBy("concept").agg(
        F.min("year").alias("first_year"),
        at(F.ceil(n * F.lit(0.25))).alias("q1_year"),
        at(F.ceil(n * F.lit(0.75))).alias("q3_year"),
        F.max("year").alias("last_year"),
        F.max("n").alias("observations"),
        at(half).alias("_a"), at(half + 1).alias("_b"), at(half + 2).alias("_c"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("year").cast("string"), "c")))).alias("year_counts"),
    )
    odd = F.col("observations") % 2 == 1
    mean = lambda x, y: (F.col(x) + F.col(y)) / 2.0
    loo_min = F.when(F.col("observations") >= 2, F.when(odd, mean("_a", "_b")).otherwise(F.col("_a").cast("double")))
    loo_max = F.when(F.col("observations") >= 2, F.when(odd, mean("_b", "_c")).otherwise(F.col("_b").cast("double")))
    median = F.when(odd, F.col("_b").cast("double")).otherwise(mean("_a", "_b"))
    return stats.select("concept", "first_year", "q1_year", median.alias("median_year"), "q3_year", "last_year", loo_min.alias("median_loo_min"), loo_max.alias("median_loo_max"), "year_counts", "observations")


def time_window(stats: DataFrame) -> DataFrame:
    """One row: the first and the last of the concepts' first years."""
    return stats.agg(F.min("first_year").alias("window_from"), F.max("first_year").alias("window_to"))


def directed(edges: DataFrame, stats: DataFrame) -> DataFrame:
    """Edges (a, b, ...) as from, to, directed, delta_median: the earlier median points to the later; equal or unknown ones keep their order."""
    ma, mb = (stats.select(F.col("concept").alias(c), F.col("median_year").alias(f"median_{c}")) for c in ("a", "b"))
    rest = [c for c in edges.columns if c not in ("a", "b")]
    side = N.orientation(F.col("median_a"), F.col("median_b"))
    out = edges.join(ma, "a", "left").join(mb, "b", "left")
    back = F.coalesce(side == "b", F.lit(False))
    return out.select(
        F.when(back, F.col("b")).otherwise(F.col("a")).alias("from"), F.when(back, F.col("a")).otherwise(F.col("b")).alias("to"), side.isNotNull().alias("directed"), F.abs(F.col("median_a") - F.col("median_b")).alias("delta_median"), *rest
    )


def layout(nodes: DataFrame) -> DataFrame:
    """(id, x, y): one band for each distinct median, the unknown last; x from the id's hash.

    Bands are numbered on the distinct medians (a few hundred), not on the nodes.
    """
    ranks = nodes.select("median_year").filter(F.col("median_year").isNotNull()).distinct()
    bands = ranks.withColumn("band", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("median_year")) - 1)
    count = ranks.agg(F.count(F.lit(1)).alias("_n"))
    out = nodes.join(F.broadcast(bands), "median_year", "left").crossJoin(F.broadcast(count))
    return out.select("id", ((fnv1a32(F.col("id")) / F.lit(float(0xFFFFFFFF)) - 0.5) * 700).alias("x"), (F.coalesce("band", "_n") * 220).cast("long").alias("y"))


def cumulative_first_years(stats: DataFrame) -> DataFrame:
    """(year, concepts): concepts that had appeared by each first year, for playback."""
    per_year = stats.filter(F.col("first_year").isNotNull()).groupBy("first_year").agg(F.count(F.lit(1)).alias("n"))
    return per_year.select(F.col("first_year").alias("year"), F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("first_year")).alias("concepts"))


def break_cycles(edges: list[dict], most: int = 1_000_000) -> tuple[list[dict], list[dict]]:
    """(kept, demoted) directed edges of an imported graph: of each cycle found, the edge with the least support goes, then the least |delta|, then the smallest id.

    Cycles are met depth first, in the order of the edges. Graphs made here point from earlier to later
    medians and have no cycle; this repairs old payloads, documents of at most `most` edges, on the driver.
    """
    if len(edges) > most:
        raise ValueError(f"more than {most} edges")
    left = {e["edge_id"]: e for e in edges}
    demoted = []
    while cycle := _cycle(list(left.values())):
        worst = min(cycle, key=lambda e: (e["support"], abs(e["delta_median"]), e["edge_id"]))
        demoted.append(left.pop(worst["edge_id"]))
    return list(left.values()), demoted


def _cycle(edges: list[dict]) -> list[dict]:
    """The first cycle that a walk along the edges closes; empty if there is none."""
    out: dict = {}
    for e in edges:
        out.setdefault(e["source"], []).append(e)
    done: set = set()
    for start in out:
        if start in done:
            continue
        path, depth, turns = [], {start: 0}, [iter(out[start])]  # the walk's edges, nodes on it with their depth, edges still to try
        while turns:
            e = next(turns[-1], None)
            if e is None:
                turns.pop()
                node = path.pop()["target"] if path else start
                depth.pop(node, None)
                done.add(node)
            elif e["target"] in depth:
                return [*path[depth[e["target"]] :], e]
            elif e["target"] not in done:
                path.append(e)
                depth[e["target"]] = len(path)
                turns.append(iter(out.get(e["target"], [])))
    return []


def legacy_cycles(edges: DataFrame, medians: DataFrame, order: str = "id") -> list[dict]:
    """Edges of an imported graph (id, kind, from, to, support_count, temporal_directed) to show without direction, by break_cycles() over the directed co-occurrence edges; medians: (id, median_year)."""
    at = lambda end: medians.select(F.col("id").alias(end), F.coalesce("median_year", F.lit(0.0)).alias(f"_{end}"))
    own = edges.filter((F.col("kind") == "cooccurrence") & F.col("temporal_directed")).join(at("from"), "from", "left").join(at("to"), "to", "left")
    rows = own.orderBy(order).select("id", "from", "to", F.coalesce("support_count", F.lit(0)).alias("s"), (F.coalesce("_to", F.lit(0.0)) - F.coalesce("_from", F.lit(0.0))).alias("d")).collect()
    return break_cycles([{"edge_id": r["id"], "source": r["from"], "target": r["to"], "support": r["s"], "delta_median": r["d"]} for r in rows])[1]
