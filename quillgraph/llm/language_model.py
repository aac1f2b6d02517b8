"""An n-gram language model in an Elias-Fano trie, and scores of texts by it.

* Level 1: words as sorted 64-bit hashes with exact counts; ids follow the counts within a part.
* Level 2: bigrams, in the part of their hash; each also has the back-off that it gives as a context.
* Level 3: trigrams, in the part of their context, whose place in level 2 is the parent. A last word is
  stored relative to its context, by its number among the successors of the middle word. Contexts seen
  more often than a part should hold are dealt over all parts.

Each level is monotone pointers and successor-searched children in flat arrays, with one byte of
log10 p for each n-gram, on one scale that reaches down to the rarest event of the corpus, so nothing
is clipped. Probabilities are smoothed by Dirichlet priors: p1(w) = (c(w) + 1) / (N + V + 1),
p2(w|v) = (c(vw) + MU2 p1(w)) / (c(v) + MU2), p3(w|uv) = (c(uvw) + MU3 p2(w|v)) / (c(uv) + MU3).

Texts never meet the model. They are cut into slices, kept in the shared folder as numbers of their
own words. A slice asks the parts for its distinct words, then for its distinct bigrams, then for its
distinct trigrams, in one packed message for each part; a part opens (memory-maps) its own files only.
Training is the same exchange, in which questions carry counts and a part writes its level before it
answers. The number of parts follows the tokens, so a part's share is bounded at any size of corpus.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import discard, fresh_dir, kept_in, mapped, narrow, pack, put_file, slices, steps, table, text_bytes, unpack
from quillgraph.llm.exchange import ASK, Rows, at_parts, at_slices, chunk_of, column, keep, low_edge, message, part_of_hash, runs, summed_column
from quillgraph.llm.elias_fano import EliasFano, Level, dump, load
from quillgraph.llm.scan import mix, words

U = np.uint64
#: The end of a text: no word has this hash but by a 64-bit accident.
END = mix(np.array([0x5E0F_7E47], U))[0]
#: Strength of the priors, in tokens.
MU2, MU3 = 1000.0, 1.0
#: Bytes of text in a slice (a longer text is one slice), and n-grams of slices that a part is meant to get.
SLICE, SHARE = 4 << 20, 1 << 20
_PLACE = 40  # bits of a place in level 2, in the parents of spread contexts


@dataclass(frozen=True)
class Model:
    """What a task needs to open the model. files: size of each file, by name; a file that is not there is an error."""

    folder: str
    parts: int
    size: int = 0  # distinct words
    total: int = 0  # training tokens
    share: int = SHARE
    files: dict[str, int] = field(default_factory=dict)

    @property
    def unit(self) -> float:
        """log10 of one step of a byte: 255 of them reach down to a single event after every token."""
        return float(np.log10(self.total + MU2 + MU3)) / 255

    def code(self, log: np.ndarray) -> np.ndarray:
        return np.rint(log / -self.unit).astype(np.int64)

    def log_one(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.total + self.size + 1))

    @property
    def hot(self) -> int:
        """Occurrences of a context from which its trigrams are dealt over all parts."""
        return self.share // 4

    def open(self, name: str) -> list[np.ndarray] | None:
        """The arrays of a file, mapped; None if training wrote none."""
        if name not in self.files:
            return None
        data = mapped(f"{self.folder}/{name}")
        if len(data) != self.files[name]:
            raise RuntimeError(f"{name} of the model has {len(data)} bytes, not {self.files[name]}")
        return load(data)


def sequences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, each text followed by END, and the tokens of each text."""
    h, n = words(texts)
    return np.insert(h, np.cumsum(n), END), n + 1


# ---------------------------------------------------------------- orders


def order_of(*keys: np.ndarray) -> np.ndarray:
    """The stable order by keys, the foremost first, all whole numbers from 0.

    As many keys as fit go with the place into words of 64 bits, whose sort is several times faster
    than one of places; the keys that are left take further rounds, from the last one on.
    """
    n, todo, order = len(keys[0]), list(keys), None
    place = max(1, n - 1).bit_length()
    while todo:
        word, used, left = np.arange(n, dtype=U), place, len(todo)
        while todo and used + (bits := int(todo[-1].max(initial=0)).bit_length()) <= 64:
            key = todo.pop()
            word |= (key if order is None else key[order]).astype(U) << U(used)
            used += bits
        if len(todo) == left:
            return np.lexsort(keys[::-1])
        word.sort()
        word &= U((1 << place) - 1)
        order = word.astype(np.int64) if order is None else order[word.astype(np.int64)]
    return order


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct pair, in order of the pairs; each place's number among the distinct pairs)."""
    if not len(a):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = order_of(a, b)
    x, y = a[order], b[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    number = np.empty(len(a), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def once_each(find, keys: np.ndarray) -> np.ndarray:
    """find(keys), asked once for each run of equal keys."""
    new = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
    return find(keys[new])[np.cumsum(new) - 1]


# ---------------------------------------------------------------- slices


def cut(docs: DataFrame, folder: str) -> DataFrame:
    """(slice, tokens, blob) of docs (..., text, _train): each slice's texts, as numbers of its own words, in a file of its own.

    The blob has the slice's distinct words and their training counts. The result is to be written
    before use, so that only slices of tasks that ended count.
    """
    text, train = docs.columns.index("text"), docs.columns.index("_train")
    kept = [(i, c) for i, c in enumerate(docs.columns) if i not in (text, train)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = text_bytes(batch.column(text))
            flags = np.array(batch.column(train).to_pylist(), bool)
            for a, b in slices(len(texts), lambda i: len(texts[i]), SLICE):  # noqa: B023
                name = uuid.uuid4().hex
                h, n = sequences(texts[a:b])
                vocabulary, local, often = np.unique(h, return_inverse=True, return_counts=True)
                counts = np.bincount(local, weights=np.repeat(flags[a:b], n)).astype(np.int64)
                # frequent words get small numbers, which pack well
                order = np.argsort(-often, kind="stable")
                number = np.empty(len(order), np.int64)
                number[order] = np.arange(len(order))
                own = pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i, _ in kept], names=[c for _, c in kept])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(own)
                put_file(f"{folder}/{name}-text", pack(*map(narrow, (number[local], n, flags[a:b], order))))
                put_file(f"{folder}/{name}-rows", sink.getvalue().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(h)], pa.int64()), pa.array([pack(steps(vocabulary), narrow(counts))], pa.binary())], names=["slice", "tokens", "blob"])

    return docs.mapInArrow(run, "slice string, tokens long, blob binary")


def opened(folder: str, name: str) -> np.ndarray:
    return mapped(f"{folder}/{name}")


class Slice:
    """A slice's texts, and the numbers of its distinct bigrams and trigrams; the same whenever it is opened."""

    def __init__(self, folder: str, name: str) -> None:
        # order: place among the sorted hashes of each of the slice's words, most frequent first
        local, n, flags, order = unpack(opened(folder, f"{name}-text").tobytes())
        self.local, self.n, self.order = local.astype(np.int32), n.astype(np.int64), order.astype(np.int64)
        self.text = np.repeat(np.arange(len(n), dtype=np.int32), self.n)
        self.train = np.repeat(flags, self.n)
        self.first = np.cumsum(self.n) - self.n
        ahead = np.flatnonzero(self.text[1:] == self.text[:-1])
        u, v = self.local[ahead], self.local[ahead + 1]
        first, number = distinct(u, v)
        #: words of the distinct bigrams, and each token's bigram with the next one, -1 at a text's end
        self.first_of, self.second_of = u[first], v[first]
        self.pair = np.full(len(local), -1, np.int32)
        self.pair[ahead] = number
        self.pair_counts = np.bincount(number, weights=self.train[ahead], minlength=len(first)).astype(np.int32)

    def triples(self) -> None:
        """context, suffix: bigrams of the distinct trigrams; triple: the trigram that ends at each token of `thirds`."""
        at = np.flatnonzero((self.pair[:-1] >= 0) & (self.pair[1:] >= 0))
        x, y = self.pair[at], self.pair[at + 1]
        first, triple = distinct(x, y)
        self.triple_counts = np.bincount(triple, weights=self.train[at], minlength=len(first)).astype(np.int32)
        self.context, self.suffix = x[first], y[first]
        self.thirds, self.triple = (at + 2).astype(np.int32), triple.astype(np.int32)


# ---------------------------------------------------------------- files of the model


def note(name: str, size: int, n: int = 0, total: int = 0) -> bytes:
    return pack(np.frombuffer(name.encode(), np.uint8), np.array([size, n, total], np.int64))


def noted(blob: bytes) -> tuple[str, list[int]]:
    name, numbers = unpack(blob)
    return name.tobytes().decode(), numbers.tolist()


def put(model: Model, name: str, *arrays: np.ndarray) -> tuple[Model, int]:
    """Writes a file of the model; the model that knows it, and its size."""
    data = dump(*arrays)
    put_file(f"{model.folder}/{name}", data)
    return replace(model, files={name: len(data)}), len(data)


# ---------------------------------------------------------------- level 1


def ask_words(listed: DataFrame, parts: int, chunks: int) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                gaps, counts = unpack(blob)
                h = np.cumsum(gaps, dtype=U)
                rows = [(p, chunk_of(name, chunks), name, pack(steps(h[a:b] - U(low_edge(p, parts))), counts[a:b])) for p, a, b in runs(part_of_hash(h, parts))]
                yield from message(rows).to_batches()

    return listed.select("slice", "blob").mapInArrow(run, ASK)


def answer_words(model: Model, training: bool):
    """Writes the words of a part, and answers one more than their ranks by count (0: unknown) and their counts."""

    def work(part: int, names: list[str], asked: list[list[np.ndarray]]) -> Rows:
        hashes, name, out, own = summed_column(asked, 0, U), f"words-{part}", [], model
        if training:
            counts = column(asked, 1)
            order = np.argsort(hashes, kind="stable")
            order = order[counts[order] > 0]
            h = hashes[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
            if len(h):
                total = np.add.reduceat(counts[order], first)
                rank = np.empty(len(total), np.int64)
                rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
                own, size = put(model, name, *EliasFano.of(h[first]).arrays, narrow(total), narrow(rank))
                out = [(-1, 0, "", note(name, size, len(first), int(total.sum())))]
        rank, seen = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        if arrays := own.open(name):
            place = EliasFano(*arrays[:4]).find(hashes)
            has = place >= 0
            seen[has], rank[has] = arrays[4][place[has]], arrays[5][place[has]].astype(np.int64) + 1
        ends = np.cumsum([len(a[0]) for a in asked])
        return out + [(part, 0, s, pack(narrow(rank[e - len(a[0]) : e]), narrow(seen[e - len(a[0]) : e]))) for s, e, a in zip(names, ends.tolist(), asked, strict=True)]

    return work


# ---------------------------------------------------------------- level 2


def pair_questions(own: Slice, ids: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the bigrams of known words in the order of questions: by part, first and second id; their parts)."""
    has = ids >= 0
    known = np.flatnonzero(has[own.first_of] & has[own.second_of])
    u, v = own.first_of[known], own.second_of[known]
    part = part_of_hash(mix(mix(ids.astype(U))[u] + ids.astype(U)[v]), parts)
    rank = np.empty(len(ids), np.int64)  # of the slice's own words by their ids, which takes fewer bits
    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    order = order_of(part, rank[u], rank[v])
    return known[order], part[order]


def ask_pairs(model: Model, folder: str, chunks: int):
    def work(name: str, _: list, parts: list[int], answers: list[list[np.ndarray]]) -> pa.Table:
        own = Slice(folder, name)
        # parts are ranges of hashes in order, so the answers stand as the slice's sorted words do
        rank, counts = column(answers, 0), column(answers, 1)
        ids = np.where(rank > 0, (rank - 1) * model.parts + np.repeat(np.array(parts), [len(a[0]) for a in answers]), -1)[own.order]
        counts = counts[own.order]
        pairs, part = pair_questions(own, ids, model.parts)
        u, v = own.first_of[pairs], own.second_of[pairs]
        prior = model.code(model.log_one(counts[v]))
        chunk = chunk_of(name, chunks)
        rows = [(p, chunk, name, pack(steps(ids[u[a:b]]), *map(narrow, (ids[v[a:b]], own.pair_counts[pairs[a:b]], counts[u[a:b]], prior[a:b])))) for p, a, b in runs(part)]
        return message([*rows, keep(model.parts, name, narrow(ids + 1), narrow(counts))])

    return work


def answer_pairs(model: Model, training: bool):
    """Writes the bigrams of a part; answers which are seen, and of those their places, numbers among the
    successors of a first word (of the first of these here; the others follow), bytes of log10 p and of the back-off, and counts of hot contexts."""

    def work(part: int, names: list[str], asked: list[list[np.ndarray]]) -> Rows:
        u = summed_column(asked, 0)
        v, c, cu, prior = (column(asked, i) for i in range(1, 5))
        first, number = distinct(u, v)
        name, out, own = f"pairs-{part}", [], model
        if training:
            n = np.bincount(number, weights=c, minlength=len(first)).astype(np.int64)
            f, n = first[n > 0], n[n > 0]
            if len(f):
                logs = model.code(np.log10((n + MU2 * 10.0 ** (-model.unit * prior[f])) / (cu[f] + MU2)))
                hot = np.flatnonzero(n > model.hot)
                own, size = put(model, name, *Level.of(u[f], v[f]), narrow(logs), narrow(model.code(np.log10(MU3 / (n + MU3)))), hot, n[hot])
                out = [(-1, 0, "", note(name, size))]
        place, relative, log, back = (np.full(len(first), x) for x in (-1, 0, 0, 0))
        hot = hot_count = np.empty(0, np.int64)
        if arrays := own.open(name):
            level, (logs, backs, hot, hot_count) = Level(arrays[: Level.ARRAYS]), arrays[Level.ARRAYS :]
            rank = once_each(level.parents.find, u[first])
            place = level.find(rank, v[first])
            has = place >= 0
            relative[has], log[has], back[has] = level.relative(rank[has], place[has]), logs[place[has]], backs[place[has]]
        e = 0
        for s, a in zip(names, asked, strict=True):
            b, e = e, e + len(a[0])
            own_place = place[number[b:e]]
            seen = own_place >= 0
            at = number[b:e][seen]
            word = u[b:e][seen]
            lead = np.concatenate([[True], word[1:] != word[:-1]])[: len(word)]
            spot = np.searchsorted(hot, place[at])
            is_hot = np.flatnonzero(np.append(hot, -1)[spot] == place[at])
            out.append((part, 0, s, pack(seen.view(np.uint8), steps(place[at]), *map(narrow, (np.where(lead, relative[at], 0), log[at], back[at], is_hot, hot_count[spot[is_hot]])))))
        return out

    return work


def keep_pairs(model: Model, folder: str):
    """What a slice knows about its words and bigrams goes to a file of the slice; only its name goes on."""

    def work(name: str, kept: list[np.ndarray], parts: list[int], answers: list[list[np.ndarray]]) -> pa.Table:
        ends = np.array([len(a) for x in answers for a in x], np.int64)
        flat = [a for x in answers for a in x]
        put_file(f"{folder}/{name}-pairs", pack(*kept, narrow(np.array(parts, np.int64)), narrow(ends), *flat))
        return message([(-1, 0, name, b"")])

    return work


# ---------------------------------------------------------------- level 3


class Questions:
    """All that a slice knows before it asks for trigrams, and the questions in their order; the same whenever it is made."""

    def __init__(self, model: Model, folder: str, name: str) -> None:
        self.own = own = Slice(folder, name)
        own.triples()
        ids, counts, parts, _, *flat = unpack(opened(folder, f"{name}-pairs").tobytes())
        ids, self.counts, answers = ids.astype(np.int64) - 1, counts.astype(np.int64), [flat[i : i + 7] for i in range(0, len(flat), 7)]
        pairs, where = pair_questions(own, ids, model.parts)
        seen = column(answers, 0, bool)
        at, part = pairs[seen], where[seen]
        place, relative = summed_column(answers, 1), column(answers, 2)
        if len(at):
            word = own.first_of[at]
            lead = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (part[1:] != part[:-1])]))
            relative = place - np.repeat(place[lead] - relative[lead], np.diff(np.append(lead, len(at))))
        many = len(own.first_of)
        self.place, self.part, child, self.code, self.back = np.full(many, -1), *(np.zeros(many, np.int64) for _ in range(4))
        self.place[at], self.part[at], child[at], self.code[at], self.back[at] = place, part, relative * model.parts + part, column(answers, 3), column(answers, 4)
        times, b = np.zeros(many, np.int64), 0
        for a in answers:
            times[at[b + a[5].astype(np.int64)]] = a[6]
            b += len(a[1])
        asked = np.flatnonzero((self.place[own.context] >= 0) & (self.place[own.suffix] >= 0))
        x = own.context[asked]
        parent, child, times, part = self.place[x], child[own.suffix[asked]], times[x], self.part[x]
        hot = np.flatnonzero(times)  # contexts that are dealt over further parts
        parent[hot] |= part[hot] << _PLACE
        part[hot] = model.parts + part_of_hash(mix(mix(parent[hot].astype(U)) + child[hot].astype(U)), model.parts)
        turn = np.zeros(many, np.int64)  # questions stand by part and place, and so by parent within the part that a trigram goes to
        turn[at] = np.arange(len(at))
        order = order_of(part, turn[x])
        self.asked, self.to, self.parent, self.child, self.times = asked[order], part[order], parent[order], child[order], times[order]


def ask_triples(model: Model, folder: str, chunks: int, listed: DataFrame) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for name in batch.column(0).to_pylist():
                q, chunk = Questions(model, folder, name), chunk_of(name, chunks)
                count, code = q.own.triple_counts[q.asked], q.code[q.own.suffix[q.asked]]
                rows = [(p, chunk, name, pack(steps(q.parent[a:b]), *map(narrow, (q.child[a:b], code[a:b], count[a:b], q.times[a:b])))) for p, a, b in runs(q.to)]
                yield from message([*rows, keep(model.parts, name)]).to_batches()

    return listed.select("slice").mapInArrow(run, ASK)


def answer_triples(model: Model, training: bool, answers: bool):
    """Writes the trigrams of a part, and answers log10 p in units: of the trigram, or of the shorter context where it is not seen."""

    def work(part: int, names: list[str], asked: list[list[np.ndarray]]) -> Rows:
        parent = summed_column(asked, 0)
        child, code, c, times = (column(asked, i) for i in range(1, 5))
        first, number = distinct(parent, child)
        name, out, own = f"triples-{part}", [], model
        if training:
            n = np.bincount(number, weights=c, minlength=len(first)).astype(np.int64)
            f, n = first[n > 0], n[n > 0]
            if len(f):
                begin = np.flatnonzero(np.concatenate([[True], parent[f][1:] != parent[f][:-1]]))
                whole = np.repeat(np.add.reduceat(n, begin), np.diff(np.append(begin, len(f))))
                whole = np.where(times[f] > 0, times[f], whole)
                p = (n + MU3 * 10.0 ** (-model.unit * code[f])) / (whole + MU3)
                own, size = put(model, name, *Level.of(parent[f], child[f]), narrow(model.code(np.log10(np.minimum(p, 1.0)))))
                out = [(-1, 0, "", note(name, size))]
        if not answers:
            return out
        value = np.full(len(first), -1)
        if arrays := own.open(name):
            level = Level(arrays[: Level.ARRAYS])
            place = level.find(once_each(level.parents.find, parent[first]), child[first])
            value[place >= 0] = arrays[Level.ARRAYS][place[place >= 0]]
        value = value[number]
        rest = np.flatnonzero(value < 0)
        if len(rest):
            if part < model.parts:
                # level 2 of this part has the back-offs; a training run has just written it
                size = model.files.get(f"pairs-{part}")
                data = load(mapped(f"{model.folder}/pairs-{part}")) if size is None else model.open(f"pairs-{part}")
                back = data[Level.ARRAYS + 1][parent[rest]].astype(np.int64)
            else:
                back = model.code(np.log10(MU3 / (times[rest] + MU3)))
            value[rest] = back + code[rest]
        e = 0
        for s, a in zip(names, asked, strict=True):
            b, e = e, e + len(a[0])
            out.append((part, 0, s, pack(narrow(value[b:e]))))
        return out

    return work


def answered(model: Model, folder: str, kept_names: list[str]):
    """The rows of a slice with their scores, from the answers about its trigrams."""

    def work(name: str, _: list, __: list[int], answers: list[list[np.ndarray]]) -> pa.Table:
        q = Questions(model, folder, name)
        own, one = q.own, model.log_one(q.counts)
        two = np.where(q.place >= 0, -model.unit * q.code, np.log10(MU2 / (q.counts[own.first_of] + MU2)) + one[own.second_of])
        three = np.where(q.place >= 0, -model.unit * q.back, 0.0)[own.context] + two[own.suffix]
        three[q.asked] = -model.unit * column(answers, 0)
        each = np.zeros(len(own.local))
        each[own.first] = one[own.local[own.first]]
        second = own.first[own.n > 1]
        each[second + 1] = two[own.pair[second]]
        each[own.thirds] = three[own.triple]
        score, base, known = (np.bincount(own.text, weights=x, minlength=len(own.n)) for x in (each, one[own.local], q.counts[own.local] > 0))
        rows = pa.ipc.open_stream(pa.py_buffer(opened(folder, f"{name}-rows").tobytes())).read_all()
        made = [pa.array(own.n, pa.int64()), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)]
        return pa.table([*rows.columns, *made], names=[*kept_names, "n_tokens", "n_known", "base_score", "score"])

    return work


# ---------------------------------------------------------------- training and scores


def exchange(docs: DataFrame, model: Model | None, answers: bool, share: int = SHARE) -> tuple[Model, DataFrame | None]:
    """Trains on the rows of docs (..., text, _train) that _train marks, unless there is a model; then scores all rows if asked to."""
    spark, training = docs.sparkSession, model is None
    folder = fresh_dir(spark, "ngrams")
    listed = kept_in(cut(docs, folder), f"{folder}/listed")
    many, tokens = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    model = model or Model(folder, max(4, -(-tokens // share)), share=share)
    chunks = 1 if training else max(1, -(-tokens // (model.share * model.parts)))
    found = kept_in(at_parts(ask_words(listed, model.parts, chunks), model.parts * chunks, answer_words(model, training)), f"{folder}/words")
    if training:
        model = noticed(model, found)
    discard(f"{folder}/listed")
    asked = at_slices(found.filter("slice <> ''"), many, ask_pairs(model, folder, chunks))
    pairs = kept_in(at_parts(asked, model.parts * chunks, answer_pairs(model, training)), f"{folder}/pairs")
    if training:
        model = noticed(model, pairs)
    discard(f"{folder}/words")
    ready = kept_in(at_slices(pairs.filter("slice <> ''"), many, keep_pairs(model, folder)), f"{folder}/ready")
    discard(f"{folder}/pairs")
    names = ready.repartition(max(1, many), "slice")
    scores = kept_in(at_parts(ask_triples(model, folder, chunks, names), model.parts * chunks, answer_triples(model, training, answers)), f"{folder}/scores")
    if training:
        model = noticed(model, scores)
    if not answers:
        return model, None
    kept = [f for f in docs.schema.fields if f.name not in ("text", "_train")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_tokens long, n_known long, base_score double, score double"])
    return model, at_slices(scores.filter("slice <> ''"), many, answered(model, folder, [f.name for f in kept]), schema)


def noticed(model: Model, messages: DataFrame) -> Model:
    """The model with the files that the parts have noted: three numbers for each."""
    notes = {name: numbers for name, numbers in (noted(bytes(r["blob"])) for r in messages.filter("slice = ''").select("blob").collect())}
    return replace(model, size=model.size + sum(n[1] for n in notes.values()), total=model.total + sum(n[2] for n in notes.values()), files=model.files | {k: n[0] for k, n in notes.items()})


RESULT = ["n_tokens", "n_known", "base_score", "score"]


def train_model(texts: DataFrame, share: int = SHARE) -> Model:
    """A model of all rows of `text` (null: empty), in a new folder of the shared folder.

    Every trigram counts; share: n-grams of the texts that a part is meant to get. An empty table
    gives a model without words, for which every token is unknown.
    """
    return exchange(texts.select("text", F.lit(True).alias("_train")), None, False, share)[0]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs but `text`, and n_tokens, n_known, base_score, score of every row.

    A text is its words and one end; null counts as empty. base_score is the add-one unigram
    estimate; both scores are sums of log10 over tokens. Columns with these names are replaced. Every
    token has a probability above zero, unknown words too. A file of the model that is missing or cut
    short is an error.
    """
    return exchange(docs.drop(*RESULT, "_train").withColumn("_train", F.lit(False)), model, True)[1]


def train_and_score(docs: DataFrame, train) -> tuple[Model, DataFrame]:
    """train_model() on the rows where the condition `train` holds (null: not), and score() of all rows, in one exchange."""
    return exchange(docs.drop(*RESULT, "_train").withColumn("_train", F.coalesce(train, F.lit(False))), None, True)


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("held_out", held)
    model, scored = train_and_score(docs, ~F.col("held_out"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
