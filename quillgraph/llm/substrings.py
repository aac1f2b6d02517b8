"""Removal of long repeated substrings by sorted suffixes.

A byte goes if some 200-byte string over it starts anywhere else in the table. Sorting the suffixes
at every byte would move each text 200 times; here only suffixes at anchors are sorted. The anchor of
a 200-byte string is the last of its 40-grams with the smallest hash, so equal strings have their
anchor at the same place inside, and a run of overlapping strings shares one (81 on average).

1. Texts are cut into slices once, kept in the shared folder with their anchors. A slice lists its
   anchors' hashes, once each; it learns which of them occur twice anywhere.
2. For anchors with such a hash it sends the bytes around them, equal surroundings once.
3. A part sorts the suffixes at its anchors, forwards and (reversed) backwards, by deep-shallow
   sorting. Two strings are equal if, for the anchor's offset o in them, their right parts share
   200 - o bytes and their left parts o bytes: two class numbers read off the common prefixes.
4. Repeated offsets return to the slices, which mark the bytes.

Hashes only choose what is compared; what goes is decided on bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import deep_shallow
from quillgraph.llm.common import CHUNK, discard, fresh_dir, kept_in, mapped, narrow, pack, put_file, slices, steps, table, text_bytes, unpack
from quillgraph.llm.exchange import ASK, Rows, at_parts, at_slices, column, keep, low_edge, message, part_of_hash, runs, summed_column
from quillgraph.llm.scan import mix, prefix, run_hash

U = np.uint64
LENGTH = 200
GRAM = 40
SPAN = LENGTH - GRAM + 1
#: Bytes of text in a slice (a longer text is one slice), and of texts for each part.
SLICE, SHARE = 8 << 20, 32 << 20
_PLACE = 21  # bits of a position in a block of at most CHUNK + LENGTH bytes
_MASK = U((1 << _PLACE) - 1)


@dataclass
class Anchors:
    """Anchors of texts: hash, position, and the first and last string start that it serves, in the order of the starts."""

    hash: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _block(b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, at, low, high) of the strings in one block of joined texts, whose ends are given."""
    n = len(b)
    empty = (np.empty(0, U), *(np.empty(0, np.int64) for _ in range(3)))
    if n < LENGTH:
        return empty
    sums = prefix(b)
    grams = np.arange(n - GRAM + 1)
    hashes = run_hash(sums, grams, grams + GRAM)
    keys = np.full(-(-(n - GRAM + 1) // SPAN) * SPAN, np.iinfo(np.uint64).max, U)
    keys[: len(hashes)] = (hashes & ~_MASK) | (_MASK - grams.astype(U))
    rows = keys.reshape(-1, SPAN)
    before = np.minimum.accumulate(rows, axis=1).reshape(-1)
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = n - LENGTH + 1
    least = np.minimum(after[:starts], before[SPAN - 1 : SPAN - 1 + starts])
    step = np.zeros(starts + 1, np.int32)  # starts whose string would run over a text's end
    bad_from = np.clip(np.maximum(ends[:-1] - LENGTH + 1, np.concatenate([[0], ends[:-2]])), 0, starts) if len(ends) > 1 else np.empty(0, np.int64)
    bad_to = np.clip(ends[:-1], 0, starts) if len(ends) > 1 else np.empty(0, np.int64)
    np.add.at(step, bad_from, 1)
    np.add.at(step, bad_to, -1)
    s = np.flatnonzero(np.cumsum(step[:-1]) == 0)
    if not len(s):
        return empty
    at = (_MASK - (least[s] & _MASK)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)]))
    low, high, at = s[first], s[np.concatenate([first[1:] - 1, [len(s) - 1]])], at[first]
    # smallest hashes are chosen, so they lie at the low end; mixed again they spread evenly over the parts
    return mix(hashes[at] + U(1)), at, low, high


def anchors(texts: list[bytes]) -> tuple[Anchors, np.ndarray]:
    """Anchors of texts, with positions in their concatenation, and where the texts end there.

    A text above the block size is taken in blocks that overlap by a string, cut at fixed places.
    """
    ends = np.cumsum([len(t) for t in texts])
    b = np.frombuffer(b"".join(texts), np.uint8)
    if len(b) <= CHUNK:
        return Anchors(*_block(b, ends)), ends
    found = []
    for i, t in enumerate(texts):
        own = b[ends[i] - len(t) : ends[i]]
        for a in range(0, max(1, len(t) - LENGTH + 1), CHUNK):
            h, *where = _block(own[a : a + CHUNK + LENGTH - 1], np.array([min(len(t) - a, CHUNK + LENGTH - 1)]))
            found.append((h, *(x + a + ends[i] - len(t) for x in where)))
    return Anchors(*(np.concatenate(x) for x in zip(*found, strict=True))), ends


def cut(docs: DataFrame, folder: str) -> DataFrame:
    """(slice, bytes, blob) of docs (text, ...): each slice's texts, rows and anchors in files of its own.

    The blob has the slice's distinct anchor hashes and whether it has them twice. The result is to be
    written before use, so that only slices of tasks that ended count.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = text_bytes(batch.column(0))
            for a, b in slices(len(texts), lambda i: len(texts[i]), SLICE):  # noqa: B023
                name, own, found, base = uuid.uuid4().hex, texts[a:b], [], 0
                for x, y in slices(len(own), lambda i: len(own[i])):  # noqa: B023
                    some, ends = anchors(own[x:y])
                    found.append((some.hash, some.at + base, some.low + base, some.high + base))
                    base += int(ends[-1])
                h, at, low, high = (np.concatenate(c) for c in zip(*found, strict=True))
                keys, count = np.unique(h, return_counts=True)
                rows = pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns[1:]], names=batch.schema.names[1:])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(rows)
                put_file(f"{folder}/{name}-rows", sink.getvalue().to_pybytes())
                put_file(f"{folder}/{name}-text", zstandard.ZstdCompressor(level=1).compress(b"".join(own)))
                put_file(f"{folder}/{name}-anchors", pack(narrow(np.array([len(t) for t in own], np.int64)), h, steps(low), narrow(at - low), narrow(high - low)))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([base], pa.int64()), pa.array([pack(steps(keys), (count > 1).view(np.uint8))], pa.binary())], names=["slice", "bytes", "blob"])

    return docs.mapInArrow(run, "slice string, bytes long, blob binary")


class Slice:
    """A slice's texts, joined, where each ends, and its anchors."""

    def __init__(self, folder: str, name: str) -> None:
        sizes, self.hash, low, at, more = unpack(mapped(f"{folder}/{name}-anchors").tobytes())
        self.ends, self.low = np.cumsum(sizes, dtype=np.int64), np.cumsum(low, dtype=np.int64)
        self.at, self.high = self.low + at, self.low + more
        raw = mapped(f"{folder}/{name}-text").tobytes()
        self.text = zstandard.ZstdDecompressor().decompress(raw, max_output_size=max(1, int(self.ends[-1]) if len(self.ends) else 1))


def ask_hashes(listed: DataFrame, parts: int) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                gaps, twice = unpack(blob)
                h = np.cumsum(gaps, dtype=U)
                yield from message([*((p, 0, name, pack(steps(h[a:b] - U(low_edge(p, parts))), twice[a:b])) for p, a, b in runs(part_of_hash(h, parts))), keep(parts, name)]).to_batches()

    return listed.select("slice", "blob").mapInArrow(run, ASK)


def answer_hashes(part: int, names: list[str], asked: list[list[np.ndarray]]) -> Rows:
    """Which of each slice's hashes occur a second time, here or elsewhere."""
    keys, once = summed_column(asked, 0, U), 1 + column(asked, 1)
    _, number = np.unique(keys, return_inverse=True)
    often = (np.bincount(number, weights=once) > 1)[number]
    ends = np.cumsum([len(a[0]) for a in asked])
    return [(part, 0, s, pack(often[e - len(a[0]) : e].view(np.uint8))) for s, e, a in zip(names, ends.tolist(), asked, strict=True)]


def ask_surroundings(folder: str, parts: int):
    """The distinct surroundings of anchors whose hash is repeated; which anchors have which goes to a file of the slice."""

    def work(name: str, _: list, __: list[int], answers: list[list[np.ndarray]]) -> pa.Table:
        own, often = Slice(folder, name), column(answers, 0, bool)
        keys, number = np.unique(own.hash, return_inverse=True)
        chosen = np.flatnonzero(often[number])
        index: dict[tuple[int, bytes], int] = {}
        which = np.empty(len(chosen), np.int64)
        for j, (at, low, high) in enumerate(zip(own.at[chosen].tolist(), own.low[chosen].tolist(), own.high[chosen].tolist(), strict=True)):
            which[j] = index.setdefault((at - low, own.text[low : high + LENGTH]), len(index))
        put_file(f"{folder}/{name}-which", pack(narrow(chosen), narrow(which)))
        if not index:
            return message([keep(parts, name)])
        h = np.empty(len(index), U)
        h[which] = own.hash[chosen]
        many = np.bincount(which) > 1
        order = np.argsort(h, kind="stable")
        texts = list(index)
        rows = []
        for p, a, b in runs(part_of_hash(h[order], parts)):
            at = order[a:b]
            some = [texts[i] for i in at.tolist()]
            left, size = np.array([k for k, _ in some], np.int64), np.array([len(t) for _, t in some], np.int64)
            rows.append((p, 0, name, pack(steps(h[at] - U(low_edge(p, parts))), narrow(left), narrow(size), many[at].view(np.uint8), np.frombuffer(b"".join(t for _, t in some), np.uint8), narrow(at))))
        return message([*rows, keep(parts, name)])

    return work


def repeated_offsets(hashes: np.ndarray, left: np.ndarray, texts: list[bytes], weight: np.ndarray) -> np.ndarray:
    """For distinct surroundings (anchor at `left`), which offsets 0..SPAN-1 of the anchor belong to a string that occurs twice.

    A row of the result is a context, a column an offset o: the string from o bytes before the
    anchor. weight: how often the context occurs.
    """
    n = len(texts)
    _, group = np.unique(hashes, return_inverse=True)
    right_order, right_lcp = deep_shallow.sort([t[k:] for t, k in zip(texts, left.tolist(), strict=True)], group)
    left_order, left_lcp = deep_shallow.sort([t[:k][::-1] for t, k in zip(texts, left.tolist(), strict=True)], group)
    nearest = left - (np.fromiter(map(len, texts), np.int64, n) - LENGTH)  # smallest offset that has its 200 bytes
    out = np.zeros((n, SPAN), bool)
    rights, lefts = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(SPAN):
        own = np.flatnonzero((nearest <= o) & (o <= left))
        if len(own):
            rights[right_order] = np.cumsum(right_lcp < LENGTH - o)
            lefts[left_order] = np.cumsum(left_lcp < o)
            _, back = np.unique(rights[own] * (n + 1) + lefts[own], return_inverse=True)
            out[own, o] = np.bincount(back, weights=weight[own])[back] > 1
    return out


def compared(part: int, names: list[str], asked: list[list[np.ndarray]]) -> Rows:
    """Repeated offsets of all surroundings of a part, as (surroundings, first, last) by slice."""
    index: dict[tuple[int, bytes], int] = {}
    hashes, lefts, texts, weight, owners = [], [], [], [], []
    for s, (h, left, size, many, data, at) in enumerate(asked):
        raw, a = data.tobytes(), 0
        for hh, k, n, m, i in zip(np.cumsum(h, dtype=U).tolist(), left.tolist(), size.tolist(), many.tolist(), at.tolist(), strict=True):
            text = raw[a : a + n]
            a += n
            j = index.setdefault((k, text), len(texts))
            if j == len(texts):
                hashes.append(hh)
                lefts.append(k)
                texts.append(text)
                weight.append(0)
                owners.append([])
            weight[j] += 1 + m
            owners[j].append((s, i))
    left, w = np.array(lefts, np.int64), np.array(weight, np.int64)
    # surroundings alone with their hash and seen once have no other place
    h = np.array(hashes, U)
    _, back, count = np.unique(h, return_inverse=True, return_counts=True)
    out: list[list[tuple[int, int, int]]] = [[] for _ in names]

    def note(j: int, first: int, last: int) -> None:
        for s, i in owners[j]:
            out[s].append((i, first, last))

    for j in np.flatnonzero(w > 1).tolist():
        note(j, lefts[j] + LENGTH - len(texts[j]), lefts[j])
    several = np.flatnonzero(count[back] > 1)
    if len(several):
        hit = repeated_offsets(h[several], left[several], [texts[j] for j in several.tolist()], w[several])
        edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, first = np.nonzero(edge == 1)
        _, last = np.nonzero(edge == -1)
        for j, a, e in zip(several[row].tolist(), first.tolist(), last.tolist(), strict=True):
            if w[j] == 1:
                note(j, a, e - 1)
    return [(part, 0, name, pack(*(narrow(np.array(c, np.int64)) for c in zip(*own, strict=True)))) for name, own in zip(names, out, strict=True) if own]


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def marked(folder: str, keep_spans: bool):
    """The rows of a slice with their repeated bytes."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def work(name: str, _: list, __: list[int], answers: list[list[np.ndarray]]) -> pa.Table:
        own = Slice(folder, name)
        chosen, which = (x.astype(np.int64) for x in unpack(mapped(f"{folder}/{name}-which").tobytes()))
        met, first, last = (column(answers, i) for i in range(3))
        order = np.argsort(met, kind="stable")
        met, first, last = met[order], first[order], last[order]
        lo, hi = np.searchsorted(met, which, "left"), np.searchsorted(met, which, "right")
        n = hi - lo
        at = own.at[np.repeat(chosen, n)]
        run_at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        step = np.zeros(len(own.text) + 1, np.int32)
        np.add.at(step, at - last[run_at], 1)
        np.add.at(step, at - first[run_at] + LENGTH, -1)
        gone = np.cumsum(step[:-1]) > 0
        cols: list[list] = [[], [], [], [], []]
        start = 0
        for end in own.ends.tolist():
            t, cover = own.text[start:end], gone[start:end]
            start = end
            removed = int(cover.sum())
            edge = np.diff(np.concatenate([[0], cover.view(np.int8), [0]])) if removed else np.empty(0, np.int8)
            begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            kept = np.frombuffer(t, np.uint8)[~cover].tobytes() if removed else t
            spans = [{"start": x, "end": y} for x, y in zip(begin.tolist(), stop.tolist(), strict=True)] if keep_spans else None
            for c, x in zip(cols, (len(t), removed, len(begin), hashlib.sha256(kept).hexdigest(), spans), strict=True):
                c.append(x)
        rows = pa.ipc.open_stream(pa.py_buffer(mapped(f"{folder}/{name}-rows").tobytes())).read_all()
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span]
        return pa.table([*rows.columns, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*rows.schema.names, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return work


def remove_repeats(docs: DataFrame, keep_spans: bool = True) -> DataFrame:
    """All columns of docs but text, and n_bytes, n_removed, n_spans, kept_sha256 and spans (byte offsets of what goes; null without keep_spans).

    Strings are judged on the input; matches never cross texts. Null and empty texts, and texts
    below 200 bytes, lose nothing; of equal rows all lose what they share. Columns with the results'
    names are replaced. A missing intermediate file is an error.
    """
    spark = docs.sparkSession
    base = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
    rest = [f for f in base.schema.fields if f.name != "text"]
    folder = fresh_dir(spark, "repeats")
    listed = kept_in(cut(base.select("text", *[f"`{f.name}`" for f in rest]), folder), f"{folder}/listed")
    many, size = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    parts = max(8, -(-size // SHARE))
    asked = at_slices(at_parts(ask_hashes(listed, parts), parts, answer_hashes), many, ask_surroundings(folder, parts))
    found = kept_in(at_parts(asked, parts, compared), f"{folder}/offsets")
    discard(f"{folder}/listed")
    return at_slices(found, many, marked(folder, keep_spans), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), RESULT]))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents", "text", "doc_id"), keep_spans=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
