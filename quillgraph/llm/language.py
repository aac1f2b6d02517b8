"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. The vector of an n-gram binds (multiplies) the
vectors of its letters, each permuted (rotated) by its place; a document bundles (adds) the vectors
of its n-grams, a language those of its documents, and a document gets the language whose profile
has the largest cosine with its own. Profiles add up, so every task adds what it has seen and the
sums of all tasks make the profile: the corpus is never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import table

DIM = 1024
N = 3
#: n-grams whose vectors a worker keeps; beyond that it starts anew.
KEPT = 16_000
#: Characters that are looked at in one go; counts add up over a longer text.
STEP = 1 << 18


def fold(held_mod: int = 3) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(held_mod))


@cache
def letter_vector(code: int, dim: int, seed: int) -> np.ndarray:
    return (np.random.default_rng([seed, code]).integers(0, 2, dim, dtype=np.int8) * 2 - 1).astype(np.int8)


@cache
def _letters(block: int) -> np.ndarray:
    """For 4096 code points from block * 4096: the lower-case letter, or 0 for what is no letter."""
    out = np.zeros(4096, np.uint32)
    for i in range(4096):
        c = chr(block * 4096 + i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else ord(c)
    return out


def letters(text: str) -> np.ndarray:
    """Lower-case letters as code points, 0 for anything else."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    blocks = codes >> 12
    low = np.zeros(len(codes), np.uint64)
    for b in np.unique(blocks):
        at = blocks == b
        low[at] = _letters(int(b))[codes[at] & 4095]
    return low


def grams(text: str, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (21 bits a letter, n at most 3) with their counts; only grams with a letter.

    Each run of anything but letters is one 0, and so are both ends of the text. A long text is taken
    in steps that hand on their last n - 1 symbols, so the counts are those of the whole text.
    """
    keys: list[np.ndarray] = []
    before = np.zeros(1, np.uint64)
    for a in range(0, max(1, len(text)), STEP):
        s = np.concatenate([before, letters(text[a : a + STEP])] + ([np.zeros(1, np.uint64)] if a + STEP >= len(text) else []))
        s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
        if len(s) >= n:
            key = np.zeros(len(s) - n + 1, np.uint64)
            for j in range(n):
                key = (key << np.uint64(21)) | s[j : len(s) - n + 1 + j]
            keys.append(key[key != 0])
        before = s[max(0, len(s) - n + 1) :]
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.unique(np.concatenate(keys), return_counts=True)


class Vectors:
    """Vectors of n-grams, made when first asked for; at most KEPT stay."""

    def __init__(self, dim: int = DIM, n: int = N, seed: int = 11) -> None:
        self.dim, self.n, self.seed, self.slot = dim, n, seed, {}
        self.rows = np.empty((1024, dim), np.float32)

    def _make(self, key: int) -> np.ndarray:
        v = np.ones(self.dim, np.int8)
        for j in range(self.n):
            code = key >> (21 * (self.n - 1 - j)) & 0x1FFFFF
            v = v * np.roll(letter_vector(code, self.dim, self.seed), self.n - 1 - j)
        return v

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of count * vector."""
        out = np.zeros(self.dim, np.float64)
        for a in range(0, len(keys), 4096):
            at = self._slots(keys[a : a + 4096].tolist())  # may replace self.rows
            out += counts[a : a + 4096].astype(np.float32) @ self.rows[at]
        return out

    def _slots(self, keys: list[int]) -> list[int]:
        if len(self.slot) + len(keys) > KEPT:
            self.slot = {}
        for k in keys:
            if k not in self.slot:
                i = len(self.slot)
                if i == len(self.rows):
                    self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
                self.slot[k] = i
                self.rows[i] = self._make(k)
        return [self.slot[k] for k in keys]


def profiles(labelled: DataFrame, dim: int = DIM, seed: int = 11) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their unit profiles, learnt from all rows of (text, lang) with both set.

    Each task keeps n-gram counts by language and adds up their vectors when it has many, so it
    returns one vector a language; these are summed by (lang, dimension). The driver gets
    languages x dim numbers.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, held, size, sums = Vectors(dim, N, seed), {}, {}, {}

        def add(lang: str) -> None:
            keys, back = np.unique(np.concatenate([k for k, _ in held[lang]]), return_inverse=True)
            counts = np.bincount(back, weights=np.concatenate([n for _, n in held.pop(lang)]))
            sums[lang] = sums.get(lang, 0) + vectors.bundle(keys, counts)
            size.pop(lang)

        for batch in it:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = grams(text.as_py())
                held.setdefault(lang, []).append(own)
                size[lang] = size.get(lang, 0) + len(own[0])
                if size[lang] > 1 << 21:
                    add(lang)
        for lang in list(held):
            add(lang)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(range(dim), pa.int32()), pa.array(v, pa.float64())], names=["lang", "i", "v"])

    parts = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang").mapInArrow(run, "lang string, i int, v double")
    rows = parts.groupBy("lang", "i").agg(F.sum("v").alias("v")).collect()
    langs = sorted({r["lang"] for r in rows})
    out = np.zeros((len(langs), dim))
    for r in rows:
        out[langs.index(r["lang"]), r["i"]] = r["v"]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return langs, out / np.where(norm == 0, 1, norm)


def identify(docs: DataFrame, langs: list[str], matrix: np.ndarray, seed: int = 11) -> DataFrame:
    """All columns of docs but `text`, and lang_pred and score, the cosine cut to 0..1.

    Only the text is looked at. A null text, a text without a letter, or no profile at all gives
    `und` and score 0. Ties go to the first language in sorted order.
    """
    base = docs.drop("lang_pred", "score")
    at = base.columns.index("text")
    kept = [i for i in range(len(base.columns)) if i != at]
    dim = matrix.shape[1] if len(langs) else DIM
    shared = docs.sparkSession.sparkContext.broadcast((langs, matrix))  # languages x dim numbers

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, prototypes = shared.value
        vectors = Vectors(dim, N, seed)
        for batch in it:
            best, score = [], []
            for value in batch.column(at):
                keys, n = grams(value.as_py() or "")
                norm = 0.0
                if len(keys) and len(names):
                    v = vectors.bundle(keys, n)
                    norm = float(np.linalg.norm(v))
                if norm == 0.0:
                    best.append("und")
                    score.append(0.0)
                else:
                    cosine = prototypes @ v / norm
                    k = int(np.argmax(cosine))
                    best.append(names[k])
                    score.append(float(min(1.0, max(0.0, cosine[k]))))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=[*(batch.schema.names[i] for i in kept), "lang_pred", "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name != "text"]
    return base.mapInArrow(run, ", ".join([*fields, "lang_pred string, score double"]))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn("held_out", F.coalesce(fold() == 1, F.lit(False)))
    langs, matrix = profiles(docs.filter(~F.col("held_out")))
    return identify(docs.select("doc_id", "text", "held_out"), langs, matrix).select("doc_id", "held_out", "lang_pred", "score")
