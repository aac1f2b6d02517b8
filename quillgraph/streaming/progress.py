"""Progress and cancellation of a running analysis, and incremental ingest (an extension)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@contextmanager
def job(spark: SparkSession, job_id: str, what: str = "") -> Iterator[None]:
    """Jobs started inside belong to the group job_id, which cancel() ends."""
    spark.sparkContext.setJobGroup(job_id, what or job_id, interruptOnCancel=True)
    try:
        yield
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def cancel(spark: SparkSession, job_id: str) -> None:
    spark.sparkContext.cancelJobGroup(job_id)


def progress(spark: SparkSession, job_id: str) -> dict[str, int]:
    """Tasks done, active and in all of the group's running stages."""
    tracker = spark.sparkContext.statusTracker()
    out = {"completed": 0, "active": 0, "total": 0}
    for j in tracker.getJobIdsForGroup(job_id):
        info = tracker.getJobInfo(j)
        for s in info.stageIds if info else []:
            stage = tracker.getStageInfo(s)
            if stage:
                out["completed"] += stage.numCompletedTasks
                out["active"] += stage.numActiveTasks
                out["total"] += stage.numTasks
    return out


def stream_memberships(extractions: DataFrame) -> DataFrame:
    """(patent_id, concept) of a stream of extraction results."""
    from quillgraph.functions.text import squeeze

    each = extractions.select("patent_id", F.explode("keywords").alias("k")).select("patent_id", squeeze(F.col("k")).alias("concept"))
    return each.filter(F.col("concept") != "")


def ingest(stream: DataFrame, path: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None):
    """Extension: appends each micro-batch's facts under batch_id=N, overwriting a batch that is delivered again, so facts count once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.distinct().write.mode("overwrite").parquet(f"{path}/batch_id={number}")
        if on_batch:
            on_batch(batch, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
