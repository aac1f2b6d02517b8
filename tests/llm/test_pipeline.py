"""The pipeline's stages against brute force on the smallest tables, and the queries' SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quillgraph.llm import bpe, decontamination, near_dedup, queries
from quillgraph.llm.common import table

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")


def test_stages(spark):
    docs = table(spark, SMALL, "documents", *P.COLUMNS).cache()
    kept = P.quality_rules(spark, docs, SMALL).cache()
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in queries.QUERIES["op8_quality"](spark, SMALL).filter("kept").collect()}
    lined = P.line_dedup(spark, kept, SMALL).cache()
    assert lined.columns == P.COLUMNS and lined.count() == kept.count()
    near = P.near_duplicates(spark, lined, SMALL).cache()
    rows = {r.doc_id: near_dedup.shingles_of((r.text or "").encode(), 5) for r in lined.collect()}
    up = {i: i for i in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in rows:
        for j in rows:
            both = len(rows[i] & rows[j]) if i < j else 0
            if both and 100 * both >= 80 * len(rows[i] | rows[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    assert sorted(r.doc_id for r in near.collect()) == sorted({root(i) for i in rows})
    clean = P.decontaminate(spark, near, SMALL).cache()
    windows = {tuple(w[i : i + 10]) for r in table(spark, SMALL, "benchmark").collect() for w in [decontamination.normal_words((r.text or "").encode())] if w for i in range(max(1, len(w) - 9))}
    hit = lambda w: any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in near.collect() if not hit(decontamination.normal_words((r.text or "").encode()))}
    last = P.encode(spark, clean, SMALL).collect()
    enc = bpe.encoding(*bpe.default_ranks())
    texts = {r.doc_id: r.text or "" for r in clean.collect()}
    assert all(r.round_trip and r.token_ids == enc.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.token_ids) for r in last) and len(last) == len(texts)


def test_rows_that_share_an_id(spark):
    rows = [(1, "one two three four five six", "en", "s", 27), (1, "one two three four five six", "en", "r", 27), (1, "seven eight nine ten eleven twelve", "en", "s", 34), (2, "a b c d e f g", "en", "s", 13)]
    got = P.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3), SMALL)
    assert got.columns == P.COLUMNS and sorted(map(tuple, got.collect())) == sorted(rows[1:])


def test_run_and_odd_tables(spark):
    odd = spark.createDataFrame([(1, "a b c d e f g h i j k l", "en", "s", 1), (1, "a b c d e f g h i j k l", "en", "s", 1), (None, "p q r s t u v w x y z aa", None, None, None), (2, None, None, None, None), (3, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").withColumn("component", F.lit(1)).withColumn("n_words", F.lit("x")).withColumn("boiler", F.lit("x")).withColumn("token_ids", F.lit("x"))
    for docs in (odd, odd.filter("false")):
        for _, stage in P.STAGES:
            docs = stage(spark, docs, SMALL).cache()
            docs.count()
    assert P.run(spark, SMALL).filter("not round_trip").count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    done = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in done.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in done.fetchall()), key=repr)
