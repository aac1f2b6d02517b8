"""What joins the operators: stored graphs, imports, warnings, differences, references at ingest, plans that do not repeat themselves."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillgraph import shared
from quillgraph.operators import citations, community, compare, metrics, network, temporal
from quillgraph.plans import options, views
from quillgraph.sinks import store
from quillgraph.sources import graph_json

PAYLOAD = {
    "schema_version": 3,
    "nodes": [
        {"id": "patent:p1", "type": "patent", "label": "one", "year": 2001, "source_files": ["f"]},
        {"id": "patent:p2", "type": "patent", "label": "two", "year": 2002, "source_files": ["g"]},
        {"id": "applicant:a", "type": "applicant", "label": "a"},
        {"id": "concept:x", "type": "concept", "label": "x", "median_year": 2001.0, "community_id": 0},
        {"id": "concept:y", "type": "concept", "label": "y", "median_year": 2002.0, "community_id": 0},
    ],
    "edges": [
        {"id": "1", "from": "patent:p1", "to": "concept:x", "relation": "包含"},
        {"id": "2", "from": "patent:p1", "to": "concept:y", "relation": "包含"},
        {"id": "3", "from": "patent:p2", "to": "concept:y", "relation": "包含"},
        {"id": "4", "from": "applicant:a", "to": "patent:p1", "relation": "申請了"},
        {"id": "5", "kind": "cooccurrence", "from": "concept:x", "to": "concept:y", "relation": "共同出現", "support_count": 2, "temporal_directed": True},
        {"id": "6", "kind": "cooccurrence", "from": "concept:y", "to": "concept:x", "relation": "共同出現", "support_count": 1, "temporal_directed": True},
    ],
    "methodology": {"cooccurrence_data": "reconstructed", "semantic_provenance": "partial"},
}


def edge(i, a, b, support=1, delta=1.0):
    return {"edge_id": str(i), "source": a, "target": b, "support": support, "delta_median": delta}


def test_overlapping_cycles_are_met_depth_first_in_input_order():
    # a-b-c-a and b-c-d-b share b-c: walking from a, a-b-c-a closes first and loses its weakest edge
    edges = [edge(1, "a", "b", 3), edge(2, "b", "c", 2), edge(3, "c", "a", 5), edge(4, "c", "d", 1), edge(5, "d", "b", 9)]
    assert [e["edge_id"] for e in temporal.break_cycles(edges)[1]] == ["2"]
    # with the shared edge strong, each cycle loses an edge of its own
    edges[1] = edge(2, "b", "c", 10)
    assert [e["edge_id"] for e in temporal.break_cycles(edges)[1]] == ["1", "4"]
    # the order of the input decides which way is walked first
    assert [e["edge_id"] for e in temporal.break_cycles([edges[3], edges[4], edges[1], edges[2], edges[0]])[1]] == ["4", "1"]
    assert temporal.break_cycles([edge(1, "a", "a")])[1] == [edge(1, "a", "a")] and temporal.break_cycles([]) == ([], [])
    with pytest.raises(ValueError, match="more than 1"):
        temporal.break_cycles(edges, most=1)


def test_what_is_left_has_no_cycle():
    rng = random.Random(3)
    for _ in range(50):
        edges = [edge(i, rng.randint(0, 6), rng.randint(0, 6), rng.randint(1, 4), rng.random()) for i in range(14)]
        left, gone = temporal.break_cycles(edges)
        assert len(left) + len(gone) == 14
        out, ends = {e["source"] for e in left}, list(left)
        while ends and (free := {e["target"] for e in ends} - {e["source"] for e in ends}):
            ends = [e for e in ends if e["target"] not in free]
        assert not ends and out <= set(range(7))


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "old.json").write_text(json.dumps(PAYLOAD))
    (tmp_path / "in" / "broken.json").write_text('{"nodes": 3')
    (tmp_path / "in" / "note.txt").write_text("no graph")
    return tmp_path


def test_import_folder_and_load_graph(spark, folder):
    root = f"file://{folder}/store"
    assert store.known_ids(spark, root) == set() and store.load_graph(spark, root, "old") is None
    got = store.import_folder(spark, f"file://{folder}/in", root)
    assert got == {"imported": ["old"], "skipped": [], "failed": ["broken"]}
    assert store.import_folder(spark, f"file://{folder}/in", root)["skipped"] == ["old"]
    assert store.import_folder(spark, f"file://{folder}/in", root, force=True)["imported"] == ["old"]
    g = store.load_graph(spark, root, "old")
    assert sorted(map(tuple, g.membership.select("patent_id", "concept").collect())) == [("p1", "x"), ("p1", "y"), ("p2", "y")]
    assert [tuple(r) for r in g.ownership.select("patent_id", "applicant").collect()] == [("p1", "a")] and g.citations is None and g.source_files == ["f", "g"]
    # the payload's two directed edges contradict each other: the weaker one is shown without direction
    v = views.concept_view(g, options.ViewOptions())
    assert v.warnings == ["cooccurrence_reconstructed", "semantic_provenance_partial", "temporal_cycle_broken:6"]
    assert [tuple(r) for r in v.communities.select("community_id", "node_count").collect()] == [(0, 2)]
    store.save_graph(g, root, "busy", status="running")
    assert store.load_graph(spark, root, "busy") is None and store.known_ids(spark, root) == {"old", "busy"}


def test_view_without_warnings_and_with_conflicts(spark):
    patents = spark.createDataFrame([(f"p{i}", 2000 + i // 4, ["f"]) for i in range(8)], "patent_id string, year int, source_files array<string>")
    m = spark.createDataFrame([(f"p{i}", "early") for i in range(4)] + [(f"p{i}", "late") for i in range(4, 8)] + [("p0", "late"), ("p7", "early")], "patent_id string, concept string")
    own = spark.createDataFrame([(f"p{i}", "a") for i in range(8)], "patent_id string, applicant string")
    # early patents cite late ones: against the medians
    cited = spark.createDataFrame([(f"p{i}", f"p{j}") for i in (1, 2) for j in (4, 5, 6)], "from_patent string, to_patent string")
    v = views.concept_view(views.Graph(patents, m, own, citations=cited), options.ViewOptions())
    rows = v.edges.collect()
    assert v.warnings == [] and len(rows) == 1
    assert [(r.edge_id, r.forward, r.reverse) for r in v.conflicts.collect()] == ([(rows[0].edge_id, rows[0].forward, rows[0].reverse)] if rows[0].citation_direction_conflict else [])
    turned = cited.select(F.col("to_patent").alias("from_patent"), F.col("from_patent").alias("to_patent"))
    other = views.concept_view(views.Graph(patents, m, own, citations=turned), options.ViewOptions())
    assert v.conflicts.count() + other.conflicts.count() == 1


def test_difference_view_and_first_edges(spark):
    a = spark.createDataFrame([("x", 1), ("y", 1)], "id string, n int")
    b = spark.createDataFrame([("y", 2), ("z", 2)], "id string, n int")
    nodes, edges = compare.difference([a, b], [a.limit(0), b])
    assert sorted((r.id, r.n, r.membership, r.shape) for r in nodes.collect()) == [("x", 1, "a", "triangle"), ("y", 1, "shared", "dot"), ("z", 2, "b", "square")]
    assert {(r.membership, r.dashes) for r in edges.collect()} == {("b", "2,4")}
    e = spark.createDataFrame([("e", 2, "later"), ("e", 1, "first"), ("f", 3, "only")], "id string, at int, said string")
    assert sorted(map(tuple, compare.first_by_id(e, "at").collect())) == [("e", 1, "first"), ("f", 3, "only")]


def test_difference_keeps_edges_whose_ids_are_equal(spark):
    # both pairs have the same hash of 32 bits; one is in the first panel, the other in the second
    pairs = {"p": ("c1061", "c968"), "q": ("c263", "c464")}
    patents = spark.createDataFrame([("p", 2000, ["f"]), ("q", 2000, ["g"])], "patent_id string, year int, source_files array<string>")
    m = spark.createDataFrame([(p, c) for p, cs in pairs.items() for c in cs], "patent_id string, concept string")
    own = spark.createDataFrame([("p", "a"), ("q", "a")], "patent_id string, applicant string")
    edges = views.compare_views(views.Graph(patents, m, own), options.ViewOptions(min_support=1), [["f"], ["g"]])[1].collect()
    assert sorted((r["from"], r["to"], r.membership, r.panels) for r in edges) == [("c1061", "c968", "a", [1]), ("c263", "c464", "b", [2])]
    assert len({r.id for r in edges}) == 1 and edges[0].id.startswith("e:cooccurrence:")


def test_references_inside_and_outside(spark):
    p = spark.createDataFrame([("a", "TWI111", ["I222", "US 5/6", "I111"]), ("b", "I222U", None), ("c", "I222", ["I111"]), ("d", None, [])], "patent_id string, patent_number string, references array<string>")
    split, cited = citations.with_references(p)
    got = {r.patent_id: (r.references, r.external_references) for r in split.collect()}
    assert got == {"a": (["I222"], ["I111", "US5/6"]), "b": (None, None), "c": (["I111"], None), "d": (None, None)}
    assert sorted(map(tuple, cited.collect())) == [("a", "b"), ("c", "a")]


def test_options_of_a_comparison():
    o = options.from_query("?mode=concept&compare=1&compareView=difference&panel0=a&panel1=b")
    assert o.compare and o.compare_view == "difference" and o.panels == (("a",), ("b",)) and options.from_query(options.to_query(o)) == o
    assert options.from_query("?compare=0&compareView=other") == options.ViewOptions()
    with pytest.raises(ValueError, match="compare_view"):
        options.ViewOptions(compare_view="other")
    key = options.scope_key(["b", "a"], options.ViewOptions(source_files=("z", "y"), ipc_filter=("G06", "A01"), unit="applicant"), (2001, 2003))
    assert key == "dataset=a,b|source=y,z|ipc=A01,G06|unit=applicant|year=2001-2003"


def test_plans_read_the_facts_few_times(spark, tmp_path):
    """The facts are written once; no plan scans their source more than three times."""
    rows = [(i, f"c{(i * k) % 17}") for i in range(200) for k in (1, 2, 3)]
    spark.createDataFrame(rows, "patent_id long, concept string").write.parquet(f"{tmp_path}/marked_facts")
    m = network.laid_out(spark.read.parquet(f"{tmp_path}/marked_facts"))
    own = spark.createDataFrame([(i, i % 9) for i in range(200)], "patent_id long, applicant long")
    patents = spark.createDataFrame([(i, 2000 + i % 9, ["f"]) for i in range(200)], "patent_id long, year int, source_files array<string>")
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("marked_facts")
    assert scans(metrics.unit_metrics(m, own)) == 0
    v = views.concept_view(views.Graph(patents, m, own), options.ViewOptions(year_range=(2001, 2004)))
    assert scans(v.edges) <= 3 and scans(v.nodes) <= 3


def test_a_component_above_the_bound_is_an_error(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 1)], "a string, b string, support long")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "concept string")
    assert community.detect(nodes, e).count() == 3
    with pytest.raises(ValueError, match="2 edges, more than 1"):
        community.detect(nodes, e, most_edges=1)


def test_the_shared_folder_must_be_set_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return self

        def get(self, _key):
            return None

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda _key, default=None: default)})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())
    assert shared.shared_dir(spark)


def test_archive_digests(spark, tmp_path):
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.xlsx").write_bytes(b"abc")
    got = store.archive(spark, f"file://{tmp_path}/up").collect()
    assert [(r.bytes, r.sha256) for r in got] == [(3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")]


def test_payload_without_directions_has_no_cycles(spark, tmp_path):
    plain = dict(PAYLOAD, edges=PAYLOAD["edges"][:4])
    (tmp_path / "p.json").write_text(json.dumps(plain))
    g = graph_json.as_graph(graph_json.normalise(graph_json.read(spark, f"file://{tmp_path}/p.json")))
    assert g.broken_cycles == [] and views.capability_warnings({}) == []
