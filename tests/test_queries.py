"""Queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from quillgraph import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def norm(v):
    return round(v, 7) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    done = duck.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in done.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in done.fetchall()), key=repr)


def test_evidence_of_fractional_and_missing_weights(spark, tmp_path):
    """Weights are rounded as SQL rounds them, halves to even; evidence without a weight is left out, which may leave none."""
    con = duckdb.connect()
    con.execute(f"copy (select * from (values (1, 'a'), (2, 'b'), (3, 'c')) t(p_partkey, p_name)) to '{tmp_path}/part.parquet'")
    con.execute(f"copy (select * from '{DATA}/orders.parquet' limit 1) to '{tmp_path}/orders.parquet'")
    line = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag"
    rows = "(1, 1, 1, 1, 17.6, 1.0, 'A'), (1, 2, 1, 2, null, 1.0, 'A'), (1, 3, 1, 3, 4.0, 1.0, 'A'), (2, 1, 1, 1, 2.5, 1.0, 'A'), (2, 2, 1, 2, 3.0, 1.0, 'A'), (3, 1, 1, 1, null, 1.0, 'A'), (3, 2, 1, 2, 3.0, 1.0, 'A')"
    con.execute(f"copy (select l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(l_quantity as double) as l_quantity, l_extendedprice, l_returnflag from (values {rows}) t({line})) to '{tmp_path}/lineitem.parquet'")
    for t in ("part", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    got = {tuple(r) for r in queries.QUERIES["semantic_evidence"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(queries.ORACLE_SQL["semantic_evidence"]).fetchall())
    told = con.execute("select md5('1:18,2:2')").fetchone()[0]
    assert got == {("a", "b", "A", "EXTRACTED", told), ("b", "c", "A", "EXTRACTED", None)}


def test_evidence_of_lines_without_a_number(spark, tmp_path):
    """Lines without a number come after the others of their order, as in SQL, and so does their evidence."""
    con = duckdb.connect()
    con.execute(f"copy (select * from (values (1, 'a'), (2, 'b')) t(p_partkey, p_name)) to '{tmp_path}/part.parquet'")
    con.execute(f"copy (select * from '{DATA}/orders.parquet' limit 1) to '{tmp_path}/orders.parquet'")
    line = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag"
    con.execute(f"copy (select * from (values (1, 1, 1, 1, 9.0::double, 1.0::double, 'A'), (1, 2, 1, 2, 8, 1, 'A'), (1, 1, 1, null, 3, 1, 'A'), (1, 2, 1, null, 2, 1, 'A')) t({line})) to '{tmp_path}/lineitem.parquet'")
    for t in ("part", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    got = {tuple(r) for r in queries.QUERIES["semantic_evidence"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(queries.ORACLE_SQL["semantic_evidence"]).fetchall())
    ab, ba = con.execute("select md5('1:9,1:3'), md5('1:8')").fetchone()
    assert got == {("a", "b", "A", "EXTRACTED", ab), ("b", "a", "A", "EXTRACTED", ba)}
