"""Queries on small tables against brute force: nothing of a table is left out."""

import datetime
import random
from collections import Counter
from itertools import combinations

import pytest

from quillgraph import queries

NAMES = ["alpha", "beta", "gamma", "delta", "coral", "opal", "topaz", "violet", "hazel", "hotel", "island", "quartz"]


def stored(spark, folder, **tables):
    for name, (rows, columns) in tables.items():
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def sets():
    """Concepts of patents: one heavy pair, a chain of single links, and chance."""
    rng = random.Random(5)
    chain = [{a, b} for a, b in zip(NAMES, NAMES[1:], strict=False)]
    return [{"alpha", "beta"}] * 20 + chain + [set(rng.sample(NAMES, 2)) for _ in range(6)]


@pytest.fixture(scope="module")
def graph_tables(spark, sets, tmp_path_factory):
    lines = [(i, NAMES.index(c)) for i, s in enumerate(sets) for c in sorted(s)]
    return stored(spark, tmp_path_factory.mktemp("graph"), part=(list(enumerate(NAMES)), "p_partkey long, p_name string"), lineitem=(lines, "l_orderkey long, l_partkey long"))


@pytest.fixture(scope="module")
def pairs(sets):
    return Counter(p for s in sets for p in combinations(sorted(s), 2))


def around(seeds, pairs, hops):
    found = dict.fromkeys(seeds, 0)
    for h in range(1, hops + 1):
        for x in {y for a, b in pairs for x, y in ((a, b), (b, a)) if found.get(x) == h - 1} - found.keys():
            found[x] = h
    return found


def test_hops_over_all_pairs(spark, graph_tables, pairs):
    got = {r.id: r.hop for r in queries.QUERIES["hops_from_centre"](spark, graph_tables).collect()}
    assert got == around([min(a for a, _ in pairs)], pairs, 2) and len(got) > 2


def test_keyword_subgraph_over_all_pairs(spark, graph_tables, pairs):
    keep = around([c for c in NAMES if "al" in c], pairs, 1)
    got = {(r.a, r.b) for r in queries.QUERIES["keyword_subgraph"](spark, graph_tables).collect()}
    assert got == {(a, b) for a, b in pairs if a in keep and b in keep} and len(got) > 1


def test_connectivity_over_all_pairs(spark, graph_tables, pairs):
    own = lambda c: ord(c[0]) % 7
    inside = [p for p in pairs if own(p[0]) == own(p[1])]
    want = Counter(own(c) for c in {min(around([c], inside, len(NAMES))) for c in NAMES})
    got = {r.community_id: r.components for r in queries.QUERIES["community_connectivity"](spark, graph_tables).collect()}
    assert inside and got == want


def test_surprising_over_all_pairs(spark, graph_tables, pairs):
    own = lambda c: ord(c[0]) % 7
    cross = {p: tuple(sorted(map(own, p))) for p in pairs if own(p[0]) != own(p[1])}
    n = Counter(cross.values())
    want = sorted((n[k], -pairs[p], *p) for p, k in cross.items() if n[k] <= 2)[:15]
    got = [(round(1 / r.bridge_rarity), -r.support, r.a, r.b) for r in queries.QUERIES["surprising_connections"](spark, graph_tables).collect()]
    assert got == want and len(got) > 1


def test_hidden_membership_over_whole_files(spark, tmp_path):
    orders = [(i, datetime.date(1992 + i % 7, 1, 1), ("1-URGENT", "2-HIGH", "5-LOW")[i % 3], 1, "F") for i in range(1, 61)]
    lines = [(i, (i * 7 + k) % 40) for i in range(1, 61) for k in range(2)]
    folder = stored(spark, tmp_path, orders=(orders, "o_orderkey long, o_orderdate date, o_orderpriority string, o_custkey long, o_orderstatus string"), lineitem=(lines, "l_orderkey long, l_partkey long"), part=([(k, f"n{k % 3}") for k in range(40)], "p_partkey long, p_name string"))
    file = {o[0]: o[2] for o in orders}
    of = lambda f: {f"n{k % 3} {k}" for i, k in lines if file[i] == f}
    got = [r.id for r in queries.QUERIES["hidden_membership"](spark, folder).collect()]
    assert sorted(got) == sorted(of("1-URGENT") - of("2-HIGH")) and got
