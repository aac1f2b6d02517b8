"""Concepts from patent texts: a pluggable extractor, and parsing of its answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.schema import EXTRACTIONS

# fixed values: what a relation's confidence may be, and what anything else becomes
CONFIDENCES, DEFAULT_CONFIDENCE = ("EXTRACTED", "INFERRED", "AMBIGUOUS"), "INFERRED"
BATCH, RETRIES = 5, 3
ITEM = "array<struct<translated_abstract:string,keywords:array<string>,relations:array<struct<source:string,target:string,relation:string,weight:string,reason:string,confidence:string>>>>"

#: From (patent_id, title, abstract) rows of a batch to one answer text.
Extractor = Callable[[list[dict]], str]


def answer_items(answer: Column) -> Column:
    """The first JSON array in an answer, fences and chatter around it ignored; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(answer, r"(?s)\[.*\]", 0), F.lit("")), ITEM)


def clean_relations(relations: Column) -> Column:
    """Parts as texts, weight 1 where there is none or no number, confidence from the list or the default."""
    none = F.array().cast("array<struct<source:string,target:string,relation:string,weight:double,reason:string,confidence:string>>")
    return F.coalesce(
        F.transform(
            relations,
            lambda r: F.struct(
                F.coalesce(r["source"], F.lit("")).alias("source"), F.coalesce(r["target"], F.lit("")).alias("target"), F.coalesce(r["relation"], F.lit("")).alias("relation"),
                F.coalesce(r["weight"].try_cast("double"), F.lit(1.0)).alias("weight"), F.nullif(r["reason"], F.lit("")).alias("reason"),
                F.when(r["confidence"].isin(*CONFIDENCES), r["confidence"]).otherwise(F.lit(DEFAULT_CONFIDENCE)).alias("confidence"),
            ),
        ),
        none,
    )


def batch_ids(patents: DataFrame, size: int = BATCH) -> DataFrame:
    """Adds batch and place by the order of patent_id, so that answers line up with requests: numbered within hash buckets, so no task sorts all."""
    from pyspark.sql import Window

    b = patents.withColumn("_bucket", F.conv(F.substring(F.md5(F.col("patent_id").cast("string")), 1, 8), 16, 10).cast("long") % 1024)
    n = F.row_number().over(Window.partitionBy("_bucket").orderBy("patent_id")) - 1
    return b.withColumn("_n", n).withColumn("batch", F.concat_ws("-", F.col("_bucket").cast("string"), F.floor(F.col("_n") / size).cast("string"))).withColumn("place", (F.col("_n") % size).cast("int")).drop("_bucket", "_n")


def parse_answers(batched: DataFrame, answers: DataFrame) -> DataFrame:
    """Extraction results of patents (batch, place, patent_id, abstract) from answers (batch, answer).

    An answer whose array is not as long as its batch counts as none: all its patents get empty
    results, with the abstract as it is.
    """
    sizes = batched.groupBy("batch").agg(F.count(F.lit(1)).alias("_size"))
    parsed = answers.withColumn("_items", answer_items(F.col("answer"))).select("batch", "_items")
    joined = batched.join(sizes, "batch").join(parsed, "batch", "left")
    item = F.when(F.size("_items") == F.col("_size"), F.get("_items", F.col("place")))
    return joined.select(
        "patent_id", F.coalesce(item["translated_abstract"], "abstract", F.lit("")).alias("translated_abstract"), F.coalesce(item["keywords"], F.array().cast("array<string>")).alias("keywords"), clean_relations(item["relations"]).alias("relations")
    )


def extract(patents: DataFrame, extractor: Extractor, size: int = BATCH, retries: int = RETRIES) -> DataFrame:
    """Extraction results by an extractor that runs on the executors, one call a batch, tried again on failure; after that empty results."""
    batched = batch_ids(patents.select("patent_id", "title", "abstract"), size)

    def call(_: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("place")
        answer = None
        for _attempt in range(retries):
            try:
                answer = extractor(rows[["patent_id", "title", "abstract"]].to_dict("records"))
                break
            except Exception:  # noqa: BLE001  a remote service may fail in any way; the contract is an empty result
                continue
        yield pd.DataFrame({"batch": [rows["batch"].iloc[0]], "answer": [answer]})

    answers = batched.groupBy("batch").applyInPandas(call, "batch string, answer string")
    return parse_answers(batched, answers)


def trend_input(results: DataFrame, ordinal: str = "patent_id", most: int = 15) -> DataFrame:
    """What a trend report is written from: the first results in order."""
    return results.orderBy(ordinal).limit(most)


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], EXTRACTIONS)


def keyword_extractor(vocabulary: list[str]) -> Extractor:
    """A deterministic stand-in for a language model: the vocabulary's words that occur, related in order of appearance."""
    import json

    def run(rows: list[dict]) -> str:
        out = []
        for r in rows:
            text = f"{r['title'] or ''} {r['abstract'] or ''}"
            found = sorted((text.find(w), w) for w in vocabulary if w in text)
            words = [w for _, w in found]
            out.append({"keywords": words, "relations": [{"source": a, "target": b, "relation": "next", "weight": 1} for a, b in zip(words, words[1:], strict=False)]})
        return json.dumps(out, ensure_ascii=False)

    return run
