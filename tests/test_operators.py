"""Operators on small hand-made graphs."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import citations, community, compare, ipc, metrics, network, publish, resolve, sampling, subgraph, temporal
from quillgraph.plans import options, views


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def facts(spark, pairs, name="concept"):
    return spark.createDataFrame(pairs, f"patent_id string, {name} string")


def test_cooccurrence_and_blanks(spark):
    ex = spark.createDataFrame([("P1", ["A", "A", " B "]), ("P2", ["A", "B"]), ("P3", ["A", "C", " "])], "patent_id string, keywords array<string>")
    m = network.memberships(ex)
    assert rows(network.concept_frequency(m), "concept", "frequency") == [("A", 3), ("B", 2), ("C", 1)]
    got = rows(network.cooccurrence(m), "a", "b", "support", "jaccard")
    assert got == [("A", "B", 2, pytest.approx(2 / 3)), ("A", "C", 1, pytest.approx(1 / 3))]
    assert rows(network.pairs_by_join(m, "patent_id", "concept"), "a", "b", "support") == [("A", "B", 2), ("A", "C", 1)]
    assert network.cooccurrence(m.limit(0)).count() == 0


def test_semantic_edges(spark):
    m = facts(spark, [("P1", "A"), ("P1", "B"), ("P2", "A"), ("P2", "B")])
    r = spark.createDataFrame([("P1", 0, "A", "B", "支援", 3.0, "r1", "EXTRACTED"), ("P2", 0, "A", "B", "支援", 5.0, "r2", "INFERRED"), ("P1", 1, "A", "不存在", "x", 1.0, None, None), ("P1", 2, "A", "A", "x", 1.0, None, None), ("P1", 3, "A", "B", " ", 1.0, None, None)], "patent_id string, ordinal int, source string, target string, relation string, weight double, reason string, confidence string")
    got = network.semantic_edges(network.admissible(r, m)).collect()
    assert len(got) == 1 and (got[0].support, got[0].weight, got[0].reason, len(got[0].evidence)) == (2, 4.0, "r1", 2)


def test_synonyms():
    found, warnings = network.synonym_map([("人工智慧", ["AI"]), ("行動支付", ["QRcode支付"]), ("AI", ["機器學習"]), ("掃碼", ["QRcode支付", "掃 碼"])])
    assert found["AI"] == "人工智慧" and found["QRcode支付"] == "行動支付" and "機器學習" not in found and found["掃 碼"] == "掃碼"
    assert len(warnings) == 2


def test_synonym_order_is_han_first(spark):
    groups = spark.createDataFrame([("1", "AI（行動裝置）", ["AI"], None), ("2", "人工智慧", ["AI"], None), ("3", "QRcode支付", ["掃碼支付"], None), ("4", "行動支付", ["QRcode支付"], None)], "id string, canonical string, aliases array<string>, note string")
    table, _ = network.synonym_table(spark, groups)
    found = {r.alias: r.canonical for r in table.collect()}
    assert found["AI"] == "人工智慧" and found["QRcode支付"] == "行動支付" and "掃碼支付" not in found
    m = network.canonicalise(facts(spark, [("P", "AI"), ("P", "人工智慧"), ("P", "z")]), table)
    assert rows(m, "concept") == [("z",), ("人工智慧",)]


def test_unit_metrics(spark):
    m = facts(spark, [("1", "A"), ("1", "B"), ("1", "C"), ("2", "A"), ("2", "B"), ("3", "D")])
    o = facts(spark, [("1", "X"), ("2", "Y"), ("3", "Z")], "applicant")
    got = {(r.a, r.b): r for r in metrics.unit_metrics(m, o, 3, 3).collect()}
    assert got["A", "B"].support_applicants == 2 and got["A", "C"].support_applicants == 1
    assert got["A", "B"].jaccard_applicants == 1 and got["A", "C"].jaccard_applicants == 0.5
    assert got["A", "B"].association_strength == pytest.approx(4 * 2 / (3 * 3))


def test_year_stats(spark):
    years = [("a", y) for y in (2015, 2016, 2018, 2020)] + [("b", y) for y in (2015, 2020, 2020, 2020)] + [("c", 2018), ("c", 2019), ("d", 2000)]
    got = {r.concept: r for r in temporal.year_stats(spark.createDataFrame(years, "concept string, year int")).collect()}
    a = got["a"]
    assert (a.first_year, a.q1_year, a.median_year, a.q3_year, a.last_year, a.median_loo_min, a.median_loo_max) == (2015, 2015, 2017.0, 2018, 2020, 2016.0, 2018.0)
    assert got["b"].median_year == 2020 and got["c"].median_year == 2018.5 and got["d"].median_loo_min is None
    assert a.year_counts == {"2015": 1, "2016": 1, "2018": 1, "2020": 1}


def test_year_stats_against_definition(spark):
    rng = random.Random(3)
    data = {f"k{i}": [rng.randint(1990, 2005) for _ in range(rng.randint(1, 12))] for i in range(60)}
    got = {r.concept: r for r in temporal.year_stats(spark.createDataFrame([(k, y) for k, v in data.items() for y in v], "concept string, year int")).collect()}

    def median(v):
        v, h = sorted(v), len(v) // 2
        return float(v[h]) if len(v) % 2 else (v[h - 1] + v[h]) / 2

    for k, v in data.items():
        loo = [median(v[:i] + v[i + 1 :]) for i in range(len(v))] if len(v) > 1 else None
        assert got[k].median_year == median(v)
        assert (got[k].median_loo_min, got[k].median_loo_max) == ((min(loo), max(loo)) if loo else (None, None))


def test_orientation_and_evidence(spark):
    stats = spark.createDataFrame([("a", 2010.0), ("b", 2005.0), ("c", 2005.0)], "concept string, median_year double")
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("a", "x", 1)], "a string, b string, support int")
    d = temporal.directed(edges, stats)
    assert rows(d, "from", "to", "directed") == [("a", "x", False), ("b", "a", True), ("b", "c", False)]
    counts = spark.createDataFrame([("b", "a", 3), ("a", "b", 1), ("c", "a", 4)], "from string, to string, n long")
    got = {(r["from"], r["to"]): r for r in citations.edge_evidence(d, counts).collect()}
    assert got["b", "a"].state == "aligned" and got["b", "a"].citation_supported and not got["b", "c"].citation_supported
    only = citations.citation_only(counts, edges, stats)
    assert rows(only, "from", "to", "forward", "reverse", "conflict") == [("c", "a", 4, 0, False)]


def test_cycles():
    e = lambda i, a, b, s, d: {"edge_id": i, "source": a, "target": b, "support": s, "delta_median": d}
    kept, gone = temporal.break_cycles([e("1", "a", "b", 2, 1), e("2", "b", "c", 1, 5), e("3", "c", "a", 1, 2), e("4", "c", "d", 1, 1)])
    assert [x["edge_id"] for x in gone] == ["3"] and len(kept) == 3
    assert temporal.break_cycles(kept) == (kept, [])


def test_communities(spark):
    nodes = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "concept string")
    edges = spark.createDataFrame([("A", "B", 2), ("A", "C", 1), ("B", "C", 1)], "a string, b string, support long")
    assert rows(community.detect(nodes, edges, mode="support"), "concept", "community_id") == [("A", 0), ("B", 0), ("C", 0), ("D", 1)]
    assert rows(community.detect(nodes, edges.limit(0)), "concept", "community_id") == [("A", 0), ("B", 1), ("C", 2), ("D", 3)]
    two = spark.createDataFrame([("A", 0), ("B", 0), ("C", 0), ("D", 0)], "concept string, community_id int")
    split = spark.createDataFrame([("A", "B"), ("C", "D")], "a string, b string")
    assert rows(community.connectivity(two, split), "community_id", "components") == [(0, 2)]


def test_louvain_finds_cliques_and_beats_singletons():
    left = [(a, b, 1.0) for a in "abcd" for b in "abcd" if a < b]
    right = [(a, b, 1.0) for a in "wxyz" for b in "wxyz" if a < b]
    found = community.louvain([*left, *right, ("d", "w", 1.0)], [*"abcdwxyz"])
    assert found == {**dict.fromkeys("abcd", "a"), **dict.fromkeys("wxyz", "w")}
    assert community.louvain([*right, ("d", "w", 1.0), *left][::-1], [*"zyxwdcba"]) == found


def test_subgraphs(spark):
    nodes = spark.createDataFrame([(x, x) for x in "ABCDE"], "id string, label string")
    edges = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "D")], "from string, to string")
    for hops, want in ((1, "AB"), (2, "ABC"), (3, "ABCD")):
        assert rows(subgraph.around(nodes, edges, "A", hops)[0], "id") == [(x,) for x in want]
    assert subgraph.around(nodes, edges, "?", 1)[0].count() == 5
    assert rows(subgraph.by_keyword(nodes, edges, "c", 1)[0], "id") == [("B",), ("C",), ("D",)]
    assert subgraph.by_keyword(nodes, edges, " ", 1)[0].count() == 5 and subgraph.by_keyword(nodes, edges, "zz", 1)[0].count() == 5
    with pytest.raises(ValueError):
        subgraph.reach(nodes, edges, 4)


def test_compare(spark):
    v = [spark.createDataFrame([(x,) for x in s], "id string") for s in (("n1", "n2", "n3"), ("n2", "n3", "n4"))]
    ids = compare.tagged(v)
    assert rows(compare.membership(ids, 2), "id", "membership") == [("n1", "a"), ("n2", "shared"), ("n3", "shared"), ("n4", "b")]
    s = compare.summary(ids, 2).first()
    assert (s.union_count, s.shared, s.a_only, s.b_only, s.jaccard) == (4, 2, 1, 1, 0.5)
    assert compare.summary(ids.limit(0), 2).first().jaccard == 0


IPC_PATENTS = [("p1", 2020, ["G06Q10/10", "G06Q40/04"], ["fileA"]), ("p2", 2020, ["G06K9/00"], ["fileA"]), ("p3", 2021, ["G06Q20/38"], ["fileB"]), ("p4", None, ["H04L9/32"], []), ("p5", 2021, None, [])]


def ipc_graph(spark):
    p = spark.createDataFrame(IPC_PATENTS, "patent_id string, year int, ipc5 array<string>, source_files array<string>")
    m = facts(spark, [("p1", "C1"), ("p1", "C2"), ("p2", "C1"), ("p3", "C2"), ("p4", "C3"), ("p5", "C4")])
    o = facts(spark, [("p1", "A1"), ("p2", "A1"), ("p3", "A2"), ("p4", "A2"), ("p5", "A2")], "applicant")
    return views.Graph(p, m, o)


def test_ipc(spark):
    g = ipc_graph(spark)
    t = {r.key: r.n for r in ipc.tree(g.patents, 4).collect()}
    assert (t["G"], t["G06"], t["G06Q"]) == (3, 3, 2) and {"G06K9", "G06Q10", "G06Q20", "G06Q40"} <= set(t)
    assert {r.concept: r.key for r in ipc.dominant(g.membership, g.patents, 3).collect()} == {"C1": "G06K", "C2": "G06Q", "C3": "H04L"}
    assert ipc.selected(g.patents, 3, []).count() == 0


def test_views(spark):
    g = ipc_graph(spark)
    v = views.concept_view(g, options.ViewOptions(ipc_filter=("G06Q",)))
    assert rows(v.nodes, "concept", "frequency") == [("C1", 1), ("C2", 2)]
    assert v.stats.first().patent_count == 2
    assert views.cohort(g, options.ViewOptions(ipc_filter=("G06Q",), source_files=("fileA",))).count() == 1
    assert views.cohort(g, options.ViewOptions()) is None and views.cohort(g, options.ViewOptions(year_range=(2020, 2021))) is None
    assert rows(views.cohort(g, options.ViewOptions(year_range=(2021, 2021))), "patent_id") == [("p3",), ("p5",)]
    i = views.institution_view(g, options.ViewOptions(mode="institution", ipc_filter=("G06Q",)))
    assert rows(i.edges, "a", "b", "support") == [("A1", "A2", 1)]
    assert views.institution_view(g, options.ViewOptions(mode="institution", min_support=9)).nodes.count() == 0


def test_year_window_recomputes(spark):
    p = spark.createDataFrame([("p1", 2018, ["old"]), ("p2", 2024, ["new"]), ("p3", 2024, ["new"])], "patent_id string, year int, source_files array<string>")
    m = facts(spark, [("p1", "A"), ("p1", "B"), ("p2", "A"), ("p2", "C"), ("p3", "B"), ("p3", "C")])
    v = views.concept_view(views.Graph(p, m, facts(spark, [("p1", "x")], "applicant")), options.ViewOptions(year_range=(2024, 2024)))
    a = v.nodes.filter("concept = 'A'").first()
    assert a.frequency == 1 and a.median_year == 2024
    assert rows(v.edges, "from", "to", "support", "jaccard") == [("A", "C", 1, 0.5), ("B", "C", 1, 0.5)]


def test_options():
    o = options.from_query("?mode=institution&minSupport=3&yearStart=2020&yearEnd=2010&ipcLevel=9&unit=applicant&panel0=a&panel1=")
    assert (o.mode, o.min_support, o.year_range, o.ipc_level, o.unit, o.panels) == ("institution", 3, None, 3, "applicant", (("a",), ()))
    assert options.from_query("yearStart=2020&yearEnd=2010", repair_years=True).year_range == (2010, 2020)
    full = options.ViewOptions(min_support=2, year_range=(2000, 2010), source_files=("a", "b"), ipc_filter=("G06Q",), show_semantic=True)
    assert options.from_query(options.to_query(full)) == full
    assert options.normal_scopes([["a", "b"], ["a", "x", "a"]], ["a", "b"]) == [[], ["a"]]
    with pytest.raises(ValueError):
        options.ViewOptions(mode="x")


COLS = "row_id string, patent_number string, application_number string, title string, abstract string, filing_date string, applicants array<string>, applicant string, source_files array<string>, cited_by_count int, case_status string"
RAW = [
    ("r1", "1", "9", "t", "short", "2020/01/02", ["甲"], "甲", ["a"], 1, "核准"), ("r2", "2", "9", "t", "longer text", "2019/12/31", ["乙"], "乙", ["b"], 5, "消滅"), ("r3", None, "9", "t", "x", None, ["甲"], "甲", ["c"], None, None),
    ("r4", "1", "8", "u", "y", None, [], "", [], None, None), ("r5", None, None, "v", "z", "2020", [], "", [], None, "公開"),
]


def test_resolution(spark):
    st = resolve.staged(spark.createDataFrame(RAW, COLS))
    g = resolve.groups(st)
    # a row without a number bridges two different numbers
    assert rows(g, "row_id", "group_id") == [("r1", "r1"), ("r2", "r1"), ("r3", "r1"), ("r4", "r4"), ("r5", "r5")]
    m = {r.group_id: r for r in resolve.merged(st, g).collect()}["r1"]
    assert (m.abstract, m.filing_date, m.case_status, m.cited_by_count, m.applicant, m.source_files) == ("longer text", "2019/12/31", "消滅", 5, "乙；甲", ["a", "b", "c"])
    assert rows(resolve.identity_conflicts(st, g), "group_id") == [("r1",)]
    assert rows(resolve.title_conflicts(st), "pn") == [("1",)]
    assert rows(resolve.unidentified(st), "row_id") == [("r5",)]


def test_resolution_ignores_order(spark):
    want = None
    for seed in (1, 2):
        data = RAW[:]
        random.Random(seed).shuffle(data)
        st = resolve.staged(spark.createDataFrame(data, COLS).repartition(3))
        got = rows(resolve.merged(st, resolve.groups(st)), "patent_id", "title", "abstract", "applicant")
        assert want is None or got == want
        want = got


def test_sampling(spark):
    p = spark.createDataFrame([(f"p{i}", ["a"] if i < 7 else ["b", "a"] if i < 10 else None) for i in range(12)], "patent_id string, source_files array<string>")
    assert rows(sampling.plan(p, ["b", "a"], 4).na.fill("-"), "source_file", "available", "allocated") == [("-", 2, 2), ("a", 7, 4), ("b", 3, 3)]
    s = sampling.sample(p, ["b", "a"], 4, seed=5)
    assert s.count() == 9 and rows(s, "patent_id") == rows(sampling.sample(p.repartition(3), ["b", "a"], 4, seed=5), "patent_id")
    assert sampling.sample_size(None, 10) == 10 and sampling.sample_size(3.7, 10) == 3 and sampling.sample_size(-1, 10) == 0


def test_primary_labels(spark):
    nodes = spark.createDataFrame([("root", 0, 1), ("hub", 1, 1), ("x", 2, 9), ("y", 2, 1)], "id string, community_id int, frequency int")
    edges = spark.createDataFrame([("root", "hub", True), ("hub", "x", False), ("hub", "y", False)], "from string, to string, directed boolean")
    got = [(r.id, r.priority) for r in publish.primary_labels(nodes, edges, 3).collect()]
    assert got[0] == ("root", 1) and got[1] == ("hub", 2)
    assert publish.primary_label_cap(85) == 15 and publish.primary_label_cap(180) == 35 and publish.mm_to_pixels(25.4) == 300 and publish.full_labels_blocked(1, 85) and not publish.full_labels_blocked(30, 180)
