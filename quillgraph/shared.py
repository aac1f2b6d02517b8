"""The folder that driver and executors share, and results kept in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder where it is unset and all runs in one process (tests).

    On a cluster an unset folder is an error: executors would each write to a folder of their own.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a folder that driver and executors share is needed")
        found = f"file://{tempfile.mkdtemp(prefix='quillgraph-')}"
        sc.setCheckpointDir(found)
    return found


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the action inside ends: for results that are written and never computed again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def kept_in(df: DataFrame, path: str) -> DataFrame:
    """The rows as Parquet in that folder, read again, which cuts the lineage; shuffles that made them are dropped."""
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, what: str) -> DataFrame:
    """kept_in() a new folder of the shared folder."""
    return kept_in(df, fresh_dir(df.sparkSession, what))


def discard(uri: str) -> None:
    """Deletes a folder of intermediate results; nothing if it is not there."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")
    try:
        store.delete_dir(path)
    except FileNotFoundError:
        pass
