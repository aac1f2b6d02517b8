"""Packed questions between slices of a table and parts of a key space.

A slice is a piece of the table whose rows and intermediate results lie in files of its own in the
shared folder; it is named by a random id that a written table lists. Slices send one packed message
to each part that they have a question for, parts answer in one message for each slice. Both sides
are grouped by value, never by the number of a task, so a lost executor changes nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillgraph.llm.common import pack, unpack

U = np.uint64
ASK = "part int, chunk int, slice string, blob binary"
Rows = list[tuple[int, int, str, bytes]]


def message(rows: Rows) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.binary())
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["part", "chunk", "slice", "blob"])


def runs(part: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, first, place after the last) of sorted parts."""
    own, first = np.unique(part, return_index=True)
    return list(zip(own.tolist(), first.tolist(), [*first[1:].tolist(), len(part)][: len(own)], strict=True))


def at_parts(asks: DataFrame, many: int, work: Callable[[int, list[str], list[list[np.ndarray]]], Rows]) -> DataFrame:
    """work(part, slices, their arrays) for every part, in about `many` tasks; what slices keep for themselves (part below 0) goes through."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        part, chunk = key[0].as_py(), key[1].as_py()
        if part < 0:
            return group.select(["part", "chunk", "slice", "blob"])
        return message([(p, chunk, s, b) for p, _, s, b in work(part, group.column("slice").to_pylist(), [unpack(b) for b in group.column("blob").to_pylist()])])

    return asks.repartition(max(1, many), "part", "chunk").groupBy("part", "chunk").applyInArrow(run, ASK)


def at_slices(answers: DataFrame, many: int, work: Callable[[str, list[np.ndarray], list[int], list[list[np.ndarray]]], pa.Table], schema: str = ASK) -> DataFrame:
    """work(slice, what it kept, parts that answered, their arrays) for every slice; notes, which have no slice, go through."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        name = key[0].as_py()
        parts, blobs = group.column("part").to_pylist(), group.column("blob").to_pylist()
        if not name:
            return message([(-1, 0, "", b) for b in blobs])
        rows = sorted((p, b) for p, b in zip(parts, blobs, strict=True))
        kept = [unpack(b) for p, b in rows if p < 0]
        return work(name, kept[0] if kept else [], [p for p, _ in rows if p >= 0], [unpack(b) for p, b in rows if p >= 0])

    return answers.repartition(max(1, many), "slice").groupBy("slice").applyInArrow(run, schema)


def column(answers: list[list[np.ndarray]], i: int, kind=np.int64) -> np.ndarray:
    return np.concatenate([a[i] for a in answers]).astype(kind) if answers else np.empty(0, kind)


def summed_column(answers: list[list[np.ndarray]], i: int, kind=np.int64) -> np.ndarray:
    return np.concatenate([np.cumsum(a[i], dtype=kind) for a in answers]) if answers else np.empty(0, kind)


def keep(parts: int, name: str, *arrays: np.ndarray) -> tuple[int, int, str, bytes]:
    """What a slice keeps until its next turn; it travels below part 0, where nobody looks at it."""
    return (-1 - zlib.crc32(name.encode()) % parts, 0, name, pack(*arrays))


def chunk_of(name: str, chunks: int) -> int:
    return zlib.crc32(name.encode()) % chunks


def part_of_hash(h: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of hashes, in order."""
    return (((h >> U(32)) * U(parts)) >> U(32)).astype(np.int64)


def low_edge(part: int, parts: int) -> int:
    """The smallest hash of a part."""
    return ((part << 32) + parts - 1) // parts << 32
