"""Benchmark decontamination by one Aho-Corasick automaton over the items' word windows.

Items and documents are normalised alike: A-Z folded, every other ASCII character that is no letter
or digit a separator. The automaton reads words, by their number among the items' words; its states
are flat arrays (13 bytes a state: an edge, a failure link, a mark), built once by one task level by
level, written to the shared folder and memory-mapped by all workers of a machine together. A text is
scanned once, many stretches of text side by side; hits map back through word numbers to offsets in
the original text. Words are compared by 64-bit hashes while scanning and by their bytes in every hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import fresh_dir, mapped, put_file, slices, table, text_bytes
from quillgraph.llm.elias_fano import dump, load
from quillgraph.llm.scan import words

U = np.uint64
WINDOW = 10
#: Bytes of item texts that may be given; more is an error, not another way of working.
MOST = 1 << 30
#: Bytes of text scanned side by side, and words that one stretch has.
BLOCK, STRETCH = 4 << 20, 64

#: A-Z to a-z; 0-9, a-z and all bytes from 0x80 as they are; the rest to blanks.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_FOLD = np.frombuffer(FOLD, np.uint8)
#: What counts as part of a word, by byte.
WORD = _FOLD != 32


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def word_offsets(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets in the original text where each normalised word starts and ends."""
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = WORD[np.frombuffer(text, np.uint8)]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted value among sorted keys; -1 where it is not."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


# ---------------------------------------------------------------- the automaton


class Automaton:
    """States in breadth-first order, root 0; edge i, a (state, word) key, leads to state i + 1, so keys are sorted.

    fail: longest proper suffix that is a state. marked: whether a window ends in the state or in one
    that its failure links reach. ends, first, items: states where windows end and the names of the
    items that have them. level: first state of each depth. spelled, cut: the words' bytes.
    """

    ARRAYS = ["words", "spelled", "cut", "keys", "fail", "marked", "level", "ends", "first", "items", "names", "name_cut"]

    def __init__(self, arrays: list[np.ndarray]) -> None:
        for name, a in zip(self.ARRAYS, arrays, strict=True):
            setattr(self, name, a)
        self.longest = len(self.level) - 2
        self.shortest = int((np.searchsorted(self.level, self.ends, side="right") - 1).min()) if len(self.ends) else 0

    @classmethod
    def build(cls, items: Iterator[tuple[str | None, bytes]], n: int = WINDOW, most: int = MOST) -> list[np.ndarray]:
        """Arrays over all windows of n words of the items (name, text); an item of fewer words, but not none, is one window."""
        numbers: dict[str | None, int] = {}
        spelled: dict[int, bytes] = {}
        hashes, lengths, owners, size = [], [], [], 0
        for name, text in items:
            size += len(text)
            if size > most:
                raise ValueError(f"more than {most} bytes of items")
            own = normal_words(text)
            if not own:
                continue
            h, _ = words([text], ~WORD, _FOLD)
            for key, word in zip(h.tolist(), own, strict=True):
                if spelled.setdefault(key, word) != word:
                    raise ValueError("two words of the items share a hash")
            hashes.append(h)
            lengths.append(len(own))
            owners.append(numbers.setdefault(name, len(numbers)))
        stream = np.concatenate(hashes) if hashes else np.empty(0, U)
        hashes.clear()
        vocabulary, stream = np.unique(stream, return_inverse=True)
        stream = stream.astype(np.uint32)
        length = np.array(lengths, np.int64)
        count = np.maximum(1, length - n + 1)
        start = np.repeat(np.cumsum(length) - length, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        long = np.repeat(np.minimum(length, n), count)
        state = np.zeros(len(start), np.int64)
        keys, fail, level = np.empty(0, U), np.zeros(1, np.uint32), [0, 1]
        for d in range(n):
            on = np.flatnonzero(long > d)
            if not len(on):
                break
            new, number = np.unique((state[on].astype(U) << U(32)) | stream[start[on] + d], return_inverse=True)
            state[on] = level[-1] + number
            if level[-1] + len(new) >= 1 << 32:
                raise ValueError("more than 2**32 states")
            # a failure link is shallower than its state, so all edges it needs are there
            link = _step(keys, fail, fail[(new >> U(32)).astype(np.int64)].astype(np.int64), (new & U(0xFFFFFFFF)).astype(np.int64)) if d else np.zeros(len(new), np.int64)
            keys, fail = np.concatenate([keys, new]), np.concatenate([fail, link.astype(np.uint32)])
            level.append(level[-1] + len(new))
        owner = np.repeat(np.array(owners, np.int64), count)
        pair = np.unique(state.astype(U) << U(32) | owner.astype(U))
        at, item = (pair >> U(32)).astype(np.int64), (pair & U(0xFFFFFFFF)).astype(np.uint32)
        ends, first = np.unique(at, return_index=True)
        marked = np.zeros(level[-1], bool)
        marked[ends] = True
        for a, b in zip(level[1:], level[2:], strict=False):
            marked[a:b] |= marked[fail[a:b]]
        names = [None if x is None else x.encode() for x in numbers]
        text = [spelled[h] for h in vocabulary.tolist()]
        # an item without a name keeps no place among the names: length -1
        return [
            vocabulary, np.frombuffer(b"".join(text), np.uint8), np.cumsum([0, *map(len, text)]), keys, fail, marked.view(np.uint8), np.array(level),
            ends.astype(np.uint32), np.append(first, len(item)), item, np.frombuffer(b"".join(x or b"" for x in names), np.uint8), np.array([-1 if x is None else len(x) for x in names], np.int64),
        ]

    def word(self, number: int) -> bytes:
        return self.spelled[self.cut[number] : self.cut[number + 1]].tobytes()

    def item_names(self) -> list[str | None]:
        out, at, raw = [], 0, self.names.tobytes()
        for size in self.name_cut.tolist():
            out.append(None if size < 0 else raw[at : at + size].decode())
            at += max(0, size)
        return out

    def scan(self, stream: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, word after the last, which end) of every window in the words `stream` (-1: no item word) of consecutive texts."""
        known = np.zeros(len(stream) + 2, np.int8)
        known[1:-1] = stream >= 0
        new = np.append(text[1:] != text[:-1], True) if len(text) else np.empty(0, bool)
        step = np.diff(known)
        begin = np.flatnonzero((step[:-1] == 1) | (np.concatenate([[False], new[:-1]]) & (stream >= 0))) if len(stream) else np.empty(0, np.int64)
        end = np.flatnonzero((step[1:] == -1) | (new & (stream >= 0))) + 1 if len(stream) else np.empty(0, np.int64)
        ok = end - begin >= max(1, self.shortest)
        begin, end = begin[ok], end[ok]
        if not len(begin) or not len(self.ends):
            return (np.empty(0, np.int64),) * 3
        # stretches of a run overlap by a window less one word, which only warms up
        many = -(-(end - begin) // STRETCH)
        number = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        own, stop = np.repeat(begin, many) + number * STRETCH, np.repeat(end, many)
        stop = np.minimum(stop, own + STRETCH)
        at = np.maximum(np.repeat(begin, many), own - (self.longest - 1))
        order = np.argsort(at - stop, kind="stable")  # longest first
        at, own, stop = at[order], own[order], stop[order]
        size = stop - at
        state, where, which = np.zeros(len(at), np.int64), [], []
        for t in range(int(size[0])):
            k = int(np.searchsorted(-size, -t))  # those longer than t
            place = at[:k] + t
            state[:k] = _step(self.keys, self.fail, state[:k], stream[place])
            hit = np.flatnonzero((self.marked[state[:k]] != 0) & (place >= own[:k]))
            if len(hit):
                where.append(place[hit])
                which.append(state[hit])
        if not where:
            return (np.empty(0, np.int64),) * 3
        where, which = np.concatenate(where), np.concatenate(which)
        last, found = [], []
        while len(where):
            e = _find(self.ends, which)
            last.append(where[e >= 0])
            found.append(e[e >= 0])
            which = self.fail[which].astype(np.int64)
            more = self.marked[which] != 0
            where, which = where[more], which[more]
        last, found = np.concatenate(last) + 1, np.concatenate(found)
        depth = np.searchsorted(self.level, self.ends[found], side="right") - 1
        return last - depth, last, found


def _step(keys: np.ndarray, fail: np.ndarray, state: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The states after one more word: along an edge, else along failure links to a state that has one, else the root."""
    out, open_ = np.zeros(len(state), np.int64), np.arange(len(state))
    while len(open_):
        at = _find(keys, (state.astype(U) << U(32)) | word.astype(U))
        out[open_] = at + 1
        rest = (at < 0) & (state != 0)
        open_, word, state = open_[rest], word[rest], fail[state[rest]].astype(np.int64)
    return out


@dataclass(frozen=True)
class Shared:
    """An automaton in the shared folder."""

    uri: str
    size: int

    def open(self) -> Automaton:
        data = mapped(self.uri)
        if len(data) != self.size:
            raise RuntimeError(f"the automaton has {len(data)} bytes, not {self.size}")
        return Automaton(load(data))


def build(benchmark: DataFrame, n: int = WINDOW, most: int = MOST) -> Shared:
    """The automaton of all items of (item_id, text), made by one task and written to the shared folder.

    Null and empty texts have no windows. The items are a stated set of tests: above `most` bytes the
    task raises an error.
    """
    uri = f"{fresh_dir(benchmark.sparkSession, 'automaton')}/states"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((name, text) for batch in it for name, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True))
        data = dump(*Automaton.build(rows, n, most))
        put_file(uri, data)
        yield pa.RecordBatch.from_arrays([pa.array([len(data)], pa.int64())], names=["size"])

    # an empty table still has one task, which writes an automaton without windows
    items = benchmark.select(F.col("item_id").cast("string"), "text").coalesce(1)
    made = items.mapInArrow(run, "size long").collect()
    return Shared(uri, made[0]["size"]) if made else build(benchmark.sparkSession.createDataFrame([(None, None)], "item_id string, text string"), n, most)


# ---------------------------------------------------------------- documents


def scanned(texts: list[bytes], machine: Automaton) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int]], np.ndarray]]]:
    """(words of each text, {text: (runs of hit words, which ends were met)})."""
    h, n = words(texts, ~WORD, _FOLD)
    text = np.repeat(np.arange(len(texts)), n)
    distinct, back = np.unique(h, return_inverse=True)
    a, b, which = machine.scan(_find(machine.words, distinct)[back], text)
    out: dict[int, tuple[list[tuple[int, int]], np.ndarray]] = {}
    if len(a):
        first, owner = np.cumsum(n) - n, text[a]
        order = np.argsort(owner, kind="stable")
        cuts = np.flatnonzero(np.diff(owner[order])) + 1
        for own in np.split(order, cuts):
            i = int(owner[own[0]])
            x, y, w = a[own] - first[i], b[own] - first[i], which[own]
            step = np.zeros(int(n[i]) + 1, np.int64)
            np.add.at(step, x, 1)
            np.add.at(step, y, -1)
            covered = np.cumsum(step[:-1]) > 0
            real, numbers = normal_words(texts[i]), _find(machine.words, h[first[i] : first[i] + n[i]])
            wrong = np.array([p for p in np.flatnonzero(covered).tolist() if real[p] != machine.word(numbers[p])], np.int64)
            if len(wrong):  # a word that only shares its hash
                ok = np.searchsorted(wrong, x) == np.searchsorted(wrong, y)
                x, y, w = x[ok], y[ok], w[ok]
                step[:] = 0
                np.add.at(step, x, 1)
                np.add.at(step, y, -1)
                covered = np.cumsum(step[:-1]) > 0
            if len(x):
                edge = np.diff(np.concatenate([[0], covered.view(np.int8), [0]]))
                out[i] = (list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)), np.unique(w))
    return n, out


def hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """All columns of docs but `text`, and n_words, n_hit, items (array<string>, sorted), spans, original spans.

    spans are runs of hit words as (start, end) byte offsets into the original UTF-8 text. Null and
    empty texts have no words. An item without an item_id hits words but is not listed; items that
    share an id are one. Documents are read once and shuffled never. Columns with the results' names are replaced.
    """
    shared = build(benchmark, n)
    base = docs.drop("n_words", "n_hit", "items", "spans")
    at = base.columns.index("text")
    kept = [i for i in range(len(base.columns)) if i != at]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.open()
        names = machine.item_names()
        for batch in it:
            texts = text_bytes(batch.column(at))
            for a, b in slices(len(texts), lambda i: len(texts[i]), BLOCK):  # noqa: B023
                own, (count, found) = texts[a:b], scanned(texts[a:b], machine)
                n_hit, items, spans = [0] * len(own), [[] for _ in own], [[] for _ in own]
                for i, (runs, which) in found.items():
                    n_hit[i] = sum(y - x for x, y in runs)
                    start, end = word_offsets(own[i])
                    spans[i] = [{"start": int(start[x]), "end": int(end[y - 1])} for x, y in runs]
                    numbers = np.unique(np.concatenate([machine.items[machine.first[e] : machine.first[e + 1]] for e in which.tolist()]))
                    items[i] = sorted(names[k] for k in numbers.tolist() if names[k] is not None)
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(i) for i in kept), pa.array(count, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, span)],
                    names=[*(rows.schema.names[i] for i in kept), "n_words", "n_hit", "items", "spans"],
                )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name != "text"]
    return base.mapInArrow(run, ", ".join([*fields, "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"]))


def clean(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """The rows and columns of docs whose text holds no window of an item."""
    shared = build(benchmark, n)
    at = docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.open()
        for batch in it:
            texts = text_bytes(batch.column(at))
            ok = np.ones(len(texts), bool)
            for a, b in slices(len(texts), lambda i: len(texts[i]), BLOCK):  # noqa: B023
                ok[[a + i for i in scanned(texts[a:b], machine)[1]]] = False
            yield batch.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
