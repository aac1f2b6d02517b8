"""Which labels a figure of bounded size shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.metrics import node_degrees
from quillgraph.operators.ranks import ranked

# fixed values: label caps at column widths of 85 and 180 mm, dots per inch, mm per inch
CAP_NARROW, CAP_WIDE, FULL_LABELS_WIDE, DPI, MM_PER_INCH = 15, 35, 30, 300, 25.4
HUBS = 3


def between(mm: float, narrow: float, wide: float) -> float:
    return narrow + (mm - 85) / (180 - 85) * (wide - narrow)


def primary_label_cap(mm: float) -> int:
    return max(1, int(between(mm, CAP_NARROW, CAP_WIDE) + 0.5))


def mm_to_pixels(mm: float, dpi: int = DPI) -> int:
    return int(mm / MM_PER_INCH * dpi + 0.5)


def full_labels_blocked(n_nodes: int, mm: float) -> bool:
    return n_nodes > between(mm, 0, FULL_LABELS_WIDE)


def primary_labels(nodes: DataFrame, edges: DataFrame, cap: int) -> DataFrame:
    """(id, priority, degree): roots of the directed part, then the hubs, then each community's best, then the rest by degree.

    nodes: (id, community_id, frequency); a node keeps its first reason. Every class is ranked by
    limits on sorted rows, so no class is gathered beyond the cap.
    """
    d = node_degrees(edges).select(F.col("node").alias("id"), "degree", "in_degree", "out_degree")
    n = nodes.join(d, "id", "left").na.fill(0, ["degree", "in_degree", "out_degree"])
    by_degree = [F.desc("degree"), F.asc("id")]
    roots = n.filter((F.col("in_degree") == 0) & (F.col("out_degree") > 0)).orderBy(*by_degree).limit(cap).select("id", F.lit(1).alias("priority"), "degree", F.lit(0).alias("c"))
    hubs = n.orderBy(*by_degree).limit(min(cap, HUBS)).select("id", F.lit(2).alias("priority"), "degree", F.lit(0).alias("c"))
    score = F.col("degree") + F.coalesce("frequency", F.lit(0))
    best = n.filter(F.col("community_id").isNotNull()).groupBy("community_id").agg(F.min_by(F.struct("id", "degree"), F.struct((-score).alias("s"), "id")).alias("m"))
    reps = best.orderBy("community_id").limit(cap).select("m.id", F.lit(3).alias("priority"), "m.degree", F.col("community_id").alias("c"))
    fill = n.orderBy(*by_degree).limit(cap).select("id", F.lit(4).alias("priority"), "degree", F.lit(0).alias("c"))
    first = Window.partitionBy("id").orderBy("priority")
    every = roots.union(hubs).union(reps).union(fill).withColumn("_r", F.row_number().over(first)).filter(F.col("_r") == 1)
    # communities in their order, everything else by degree
    return every.orderBy("priority", F.when(F.col("priority") == 3, F.col("c")).otherwise(F.lit(0)), F.desc("degree"), "id").limit(cap).select("id", "priority", "degree")


def reveal_waves(nodes: DataFrame, waves: int, gap_ms: int, order: str = "id") -> DataFrame:
    """(id, delay_ms): nodes in `waves` groups by rank."""
    count = nodes.agg(F.count(F.lit(1)).alias("_all"))  # one row
    placed = ranked(nodes.select("id", *{order} - {"id"}), "_rank", order).crossJoin(F.broadcast(count))
    return placed.select("id", (F.floor(F.col("_rank") * waves / F.col("_all")) * gap_ms).cast("long").alias("delay_ms"))
