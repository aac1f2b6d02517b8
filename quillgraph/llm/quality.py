"""Host-level quality rules.

Document rules fail a document by itself. Their failures are counted by host, each host's failure
rate is shrunk towards the corpus by a beta prior whose two parameters are fitted to the hosts'
own counts (empirical Bayes), and a host whose shrunk rate is above `bad_host` takes its remaining
documents down with it. With few documents a host keeps close to the corpus rate, so a small host
is never judged by one bad page.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import join_hosts, slices, table, text_bytes, written
from quillgraph.llm.scan import PLAIN, SPACE, windows, words

#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Bounds of the prior's strength, in documents.
WEAK, STRONG = 10.0, 10_000.0
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[bytes] = set()
    n = 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line and not line.isspace():
            seen.add(line)
    return n


def repeated_words(grams: np.ndarray) -> int:
    """Words inside windows that occur twice or more in the text, the first occurrence included."""
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(grams), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    step = np.zeros(len(grams) + WINDOW, np.int32)
    at = np.flatnonzero(hit)
    step[at] += 1
    np.add.at(step, at + WINDOW, -1)
    return int((np.cumsum(step[:-1]) > 0).sum())


def features(texts: list[bytes]) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    hashes, n_words = words(texts, fold=PLAIN)  # words are told apart by case
    grams, each = windows(hashes, n_words, WINDOW)
    ends = np.cumsum(each)
    chars, symbols, dups, repeats = (np.zeros(len(texts), np.int64) for _ in range(4))
    for i, t in enumerate(texts):
        if t:
            b = np.frombuffer(t, np.uint8)
            chars[i] = np.count_nonzero((b & 0xC0) != 0x80) - np.count_nonzero(SPACE[b])
            symbols[i] = len(t) - len(t.translate(None, SYMBOLS))
            dups[i] = duplicate_lines(t)
            repeats[i] = repeated_words(grams[ends[i] - each[i] : ends[i]])
    return [n_words, chars, symbols, dups, repeats]


def document_features(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Every row with the five counts; without keep_text the text leaves the plan here, before any shuffle.

    Null and empty texts count 0 in all five. Columns with the counts' names are replaced.
    """
    base = docs.drop(*FEATURES)
    at = base.columns.index("text")
    kept = [i for i in range(len(base.columns)) if keep_text or i != at]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = text_bytes(batch.column(at))
            found = [features(texts[a:b]) for a, b in slices(len(texts), lambda i: len(texts[i]))]
            columns = [np.concatenate(x) if found else np.empty(0, np.int64) for x in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *(pa.array(c, pa.int64()) for c in columns)], names=[*(batch.schema.names[i] for i in kept), *FEATURES])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if keep_text or f.name != "text"]
    return base.mapInArrow(run, ", ".join([*fields, *(f"{c} long" for c in FEATURES)]))


def failed(min_words: int = 10, repeat_percent: int = 20):
    """The document rules as one condition."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def host_verdicts(judged: DataFrame, bad_host: float = 0.5) -> DataFrame:
    """source, host_docs, host_failed, shrunk_rate, host_kept of every host of (source, base_failed) rows.

    The prior Beta(a, b) has the mean m of the hosts' rates and a strength a + b from the method of
    moments: m (1 - m) / v - 1 for the variance v of the rates, at least WEAK documents (one bad page must not
    condemn a host) and at most STRONG (equal rates have no variance). A null source is a host of its own.
    """
    hosts = judged.groupBy("source").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    prior = hosts.agg(F.avg(rate).alias("_m"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("_v"))
    spread = F.col("_m") * (1 - F.col("_m"))
    strength = F.when(F.col("_v") * (STRONG + 1) <= spread, F.lit(STRONG)).otherwise(F.greatest(F.lit(WEAK), spread / F.when(F.col("_v") > 0, F.col("_v")).otherwise(F.lit(1.0)) - 1))
    # the prior is one row
    shrunk = (F.col("host_failed") + F.col("_m") * F.col("_s")) / (F.col("host_docs") + F.col("_s"))
    return hosts.crossJoin(F.broadcast(prior.select("_m", strength.alias("_s")))).select("source", "host_docs", "host_failed", shrunk.alias("shrunk_rate"), (shrunk <= bad_host).alias("host_kept"))


def judge(docs: DataFrame, bad_host: float = 0.5, min_words: int = 10, repeat_percent: int = 20) -> DataFrame:
    """Rows of (doc_id, source, text) with their counts, base_failed, host_rate and kept; other columns are not looked at.

    kept is false where the document fails by itself, else the verdict on its host; a host exactly at
    bad_host stays. Null or empty texts fail (no words); documents with a null source are judged as
    one host; an empty table gives no rows. Texts are read once: the counts, without texts, are
    written, summed by host and joined with the verdicts.
    """
    rule = failed(min_words, repeat_percent)
    counted = written(document_features(docs.select("doc_id", "source", "text")).withColumn("base_failed", rule), "quality-counts")
    verdicts = host_verdicts(counted, bad_host).select(F.col("source").alias("__host"), F.col("shrunk_rate").alias("host_rate"), "host_kept")
    joined = join_hosts(counted, "source", verdicts, "left")
    return joined.select("doc_id", "source", *FEATURES, "base_failed", "host_rate", (~F.col("base_failed") & F.col("host_kept")).alias("kept"))


def keep(docs: DataFrame, bad_host: float = 0.5, min_words: int = 10, repeat_percent: int = 20) -> DataFrame:
    """The rows and columns of docs that judge() would keep.

    Texts are read once: what passes by itself is written with its text, the rest without, and rejected
    hosts are taken out of that.
    """
    wrapped = docs.select("source", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("__rest"))
    judged = document_features(wrapped, keep_text=True).withColumn("__failed", failed(min_words, repeat_percent))
    columns = [F.when(~F.col("__failed"), F.col("text")).alias("text") if c == "text" else F.col("__rest")[c].alias(c) for c in docs.columns]
    judged = written(judged.select(*columns, "__failed"), "quality-passed")
    hosts = host_verdicts(judged.select("source", F.col("__failed").alias("base_failed")), bad_host)
    bad = hosts.filter(~F.col("host_kept")).select(F.col("source").alias("__host"))
    return join_hosts(judged.filter(~F.col("__failed")).select(*docs.columns), "source", bad, "left_anti")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return found.select("doc_id", *FEATURES, "base_failed", "kept")
