"""What the operators share: tables, the cluster's shared folder, and shuffles of packed blobs.

Heavy counting never sends one row per token through a shuffle. A map side packs sorted numpy
arrays into one blob for each target part, and a reduce side merges the blobs of its part. The
number of parts follows ``spark.sql.shuffle.partitions``, the knob that sizes a cluster's shuffles,
so what a part holds stays bounded when both grow with the input.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.shared import discard, fresh_dir, kept, kept_in

__all__ = ["discard", "fresh_dir", "kept_in"]

#: Bytes of text that the Python side looks at in one go.
CHUNK = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the data folder, read by Spark so that any store works."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows as Parquet in the shared folder, read again."""
    return kept(df, what)


#: Entries (rows, or what `weight` says) of a host table that are broadcast, about 64 bytes each, and the share of all rows from which a host is hot.
BROADCAST_ENTRIES, HOT_SHARE = 500_000, 1 / 1000
#: Tasks that share a hot host if even the hot hosts' table is too large to broadcast.
HOST_SALTS = 256


def join_hosts(docs: DataFrame, host: str, hosts: DataFrame, how: str, weight: Column | None = None) -> DataFrame:
    """docs joined (left or left_anti, null-safe) with a table that has one row for a host, `__host`.

    The host table is made first, so its size is known. A small one is broadcast and texts stay where
    they are. Of a large one only the rows of hot hosts (HOT_SHARE of all rows or more, so 1000 at
    most) are broadcast; the other documents are shuffled by host, where no host is large. Documents
    that meet no row of their host stay as `how` says. Columns named __host, __salt or __of are not allowed in docs.
    """
    spark = docs.sparkSession
    hosts = written(hosts, "hosts")
    entries = F.coalesce(F.sum(F.lit(1) if weight is None else weight), F.lit(0))
    if hosts.agg(entries).first()[0] <= BROADCAST_ENTRIES:
        return docs.join(F.broadcast(hosts), docs[host].eqNullSafe(hosts["__host"]), how)
    counts = written(docs.groupBy(F.col(host).alias("__host")).agg(F.count(F.lit(1)).alias("n")), "host-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    names = [r[0] for r in counts.filter(F.col("n") >= max(1, total * HOT_SHARE)).select("__host").collect()]  # at most 1 / HOT_SHARE
    hot_names = spark.createDataFrame([(x,) for x in names], counts.select("__host").schema)
    hot = hosts.join(F.broadcast(hot_names), hosts["__host"].eqNullSafe(hot_names["__host"]), "left_semi")
    cold = hosts.join(F.broadcast(hot_names), hosts["__host"].eqNullSafe(hot_names["__host"]), "left_anti")
    among = F.coalesce(F.col(host).isin([x for x in names if x is not None]), F.lit(None in names))
    rest = docs.filter(~among).join(cold, docs[host].eqNullSafe(cold["__host"]), how)
    if hot.agg(entries).first()[0] <= BROADCAST_ENTRIES:
        front = docs.filter(among).join(F.broadcast(hot), docs[host].eqNullSafe(hot["__host"]), how)
    else:
        salted = docs.filter(among).withColumn("__salt", F.pmod(F.xxhash64(*docs.columns), F.lit(HOST_SALTS)))
        spread = hot.withColumn("__of", F.explode(F.sequence(F.lit(0), F.lit(HOST_SALTS - 1))))
        front = salted.join(spread, salted[host].eqNullSafe(spread["__host"]) & (salted["__salt"] == spread["__of"]), how).drop("__salt", "__of")
    return rest.unionByName(front)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int | None = None, size: int = 8 << 20) -> Iterator[None]:
    """Batches to Python of at most so many rows and bytes, for the actions inside."""
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": str(size)} | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)} if rows else {})
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def parts_of(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ---------------------------------------------------------------- files in the shared folder


def open_fs(uri: str):
    """(pyarrow file system, path): local paths, file:, hdfs:, s3: and gs: folders alike."""
    from pyarrow import fs

    if "://" not in uri:
        uri = f"file://{uri.removeprefix('file:')}"
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, data: bytes) -> None:
    """Writes beside the target and moves, so that a task that runs again never leaves half a file."""
    from pyarrow import fs

    store, path = open_fs(uri)
    if isinstance(store, fs.LocalFileSystem):
        os.makedirs(os.path.dirname(path), exist_ok=True)
    else:
        store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


def get_file(uri: str) -> bytes | None:
    store, path = open_fs(uri)
    try:
        with store.open_input_stream(path) as f:
            return f.read()
    except FileNotFoundError:
        return None


def mapped(uri: str) -> np.ndarray:
    """The file as a memory-mapped byte array; on a store without local paths the bytes themselves."""
    from pyarrow import fs

    store, path = open_fs(uri)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype=np.uint8, mode="r").view(np.ndarray) if os.path.getsize(path) else np.empty(0, np.uint8)
    with store.open_input_stream(path) as f:
        return np.frombuffer(f.read(), np.uint8)


# ---------------------------------------------------------------- packed arrays


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; wide integers go byte plane by byte plane, which compresses better."""
    z, out = zstandard.ZstdCompressor(level=1), []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""
        body = z.compress(planes)
        out.append(a.dtype.str.encode().ljust(4) + len(a).to_bytes(8, "little") + len(body).to_bytes(8, "little") + body)
    return b"".join(out)


def narrow(a: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in the smallest unsigned type that holds them."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def steps(a: np.ndarray) -> np.ndarray:
    """Differences of whole numbers from 0 that never decrease; np.cumsum undoes it."""
    return narrow(np.diff(a, prepend=a.dtype.type(0)))


def unpack(blob: bytes) -> list[np.ndarray]:
    z, out, at = zstandard.ZstdDecompressor(), [], 0
    view = memoryview(blob)
    while at < len(view):
        kind = np.dtype(bytes(view[at : at + 4]).decode().strip())
        n, size = int.from_bytes(view[at + 4 : at + 12], "little"), int.from_bytes(view[at + 12 : at + 20], "little")
        body = view[at + 20 : at + 20 + size]
        at += 20 + size
        raw = np.frombuffer(z.decompress(body, max_output_size=max(1, n * kind.itemsize)), np.uint8) if n else np.empty(0, np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).reshape(-1).view(kind) if n else np.empty(0, kind))
    return out


def joined(blobs: list[bytes]) -> list[np.ndarray]:
    """The arrays of many blobs, each kind concatenated."""
    rows = [unpack(b) for b in blobs]
    return [np.concatenate(x) for x in zip(*rows, strict=True)] if rows else []


BLOBS = "part int, blob binary"


def batches(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "blob"])


def map_blobs(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[list[tuple[int, bytes]]]]) -> DataFrame:
    """make: from record batches to lists of (part, blob)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in make(it):
            if rows:
                yield batches(rows)

    return df.mapInArrow(run, BLOBS)


def reduce_blobs(blobs: DataFrame, merge: Callable[[int, list[bytes]], pa.Table], schema: str) -> DataFrame:
    """merge: from a part and its blobs to a table of the given schema."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        return merge(key[0].as_py(), group.column("blob").to_pylist())

    return blobs.groupBy("part").applyInArrow(run, schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null: empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def slices(n: int, sizes: Callable[[int], int], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most `limit` bytes, or of one row."""
    a = total = 0
    for i in range(n):
        size = sizes(i)
        if i > a and total + size > limit:
            yield a, i
            a, total = i, 0
        total += size
    if a < n:
        yield a, n
