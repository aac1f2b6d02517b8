"""Sources, sinks, progress and streaming."""

import io
import json
import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import network
from quillgraph.sinks import store
from quillgraph.sources import extraction, graph_json, xlsx
from quillgraph.streaming import progress


def workbook(sheets):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = list(sheets)
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i + 1}" Target="worksheets/s{i}.xml"/>' for i in range(len(names))) + "</Relationships>")
        for i, n in enumerate(names):
            body = "".join(f'<row r="{r + 1}">' + "".join(f'<c r="{chr(65 + c)}{r + 1}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' for c, v in enumerate(row) if v) + "</row>" for r, row in enumerate(sheets[n]))
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


A = [["搜尋關鍵字", "申請日", "申請號", "專利名稱(中)", "申請人", "摘要"], ["金控", "2020/01/02", "109", "支付系統", "甲公司 台北 (中華民國)；乙公司", "﻿摘要一"], ["金控", "2020/01/03", "110", "", "丙", "x"]]
B = [["專利編號", "專利名稱", "摘要", "申請號", "申請日", "IPC5-2", "IPC5-1", "申請人1", "參考文獻1", "案件狀態", "被參考次數"], ["M1", "支付系統", "較長的摘要", "TW109", "44196", "G06Q-020/38", "G06Q-010/10", "甲公司 x", "TWM2U", "公開", "3"], ["", "無號", "y", "111", "44196", "", "", "", "", "", ""]]


def test_sheet_choice_and_ingest(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook({"專利清單": A}))
    (tmp_path / "b.xlsx").write_bytes(workbook({"雷達圖分析": [["IPC5-1"]], "原始資料": B}))
    (tmp_path / "c.xlsx").write_bytes(workbook({"x": [["foo", "bar"]]}))
    cells = xlsx.read_xlsx(spark, str(tmp_path / "*.xlsx"))
    assert sorted((r.file, r.format) for r in cells.select("file", "format").distinct().collect()) == [("a.xlsx", "A"), ("b.xlsx", "B"), ("c.xlsx", "?")]
    a, b = xlsx.format_a(cells).collect(), xlsx.format_b(cells).collect()
    assert len(a) == 1 and a[0].applicants == ["甲公司", "乙公司"] and a[0].abstract == "摘要一"
    assert len(b) == 1 and b[0].filing_date == "2020-12-31" and b[0].ipc5 == ["G06Q10/10", "G06Q20/38"] and b[0].references == ["M2"] and b[0].cited_by_count == 3
    assert [r.missing for r in xlsx.skipped(cells).collect()] == ["title"]
    merged = xlsx.ingest(cells).collect()
    assert len(merged) == 1 and merged[0].source_files == ["a.xlsx", "b.xlsx"] and merged[0].abstract == "較長的摘要"
    assert xlsx.ingest(cells, dedupe=False).count() == 2
    spark.dataSource.register(xlsx.XlsxSource)
    assert spark.read.format("patent_xlsx").load(str(tmp_path / "a.xlsx")).count() == 2


def test_sheet_rules():
    long = [["IPC5-1", "摘要", "專利名稱", "申請號"], *[["G06Q", "a", "t", str(i)] for i in range(501)]]
    assert xlsx.choose_sheet(xlsx.Workbook(workbook({"first": [["z"]], "IPC5分析": long, "data": long}))) == ("B", "data")
    assert xlsx.choose_sheet(xlsx.Workbook(workbook({"first": [["abstract"]]}))) == ("A", "first")
    assert xlsx.choose_sheet(xlsx.Workbook(workbook({"first": [["z"]], "short": long[:300]}))) is None
    assert xlsx.numbered_columns(["IPC5-10", "IPC5-2", "IPC5x", "IPC51"], "IPC5") == ["IPC51", "IPC5-2", "IPC5-10"]
    assert xlsx.column_map([" Title ", "摘要"]) == {"title": " Title ", "abstract": "摘要"}


def test_extraction(spark):
    p = spark.createDataFrame([("p1", "pay", "pay by qr"), ("p2", "qr", None)], "patent_id string, title string, abstract string")
    got = {r.patent_id: r for r in extraction.extract(p, extraction.keyword_extractor(["pay", "qr"])).collect()}
    assert got["p1"].keywords == ["pay", "qr"] and got["p1"].relations[0].confidence == "INFERRED" and got["p2"].keywords == ["qr"]

    def broken(rows):
        raise OSError("down")

    assert [(r.keywords, r.translated_abstract) for r in extraction.extract(p.filter("patent_id = 'p1'"), broken).collect()] == [([], "pay by qr")]
    bad = extraction.extract(p, lambda rows: "no json").collect()
    assert all(r.keywords == [] and r.relations == [] for r in bad)


def test_graph_json(spark, tmp_path):
    nodes = [{"id": "patent:p1", "label": "p1", "type": "patent"}, {"id": "patent:p2", "label": "p2", "type": "patent"}, {"id": "concept:A", "label": "A", "type": "concept"}, {"id": "concept:B", "label": "B", "type": "concept"}, {"id": "x", "label": "", "type": "concept"}, {"id": "applicant:z", "label": "z", "type": "applicant"}]
    edges = [{"id": f"e{i}", "from": f, "to": t, "relation": r} for i, (f, t, r) in enumerate([("patent:p1", "concept:A", "包含"), ("patent:p1", "concept:B", "包含"), ("patent:p2", "concept:A", "包含"), ("applicant:z", "patent:p1", "申請了"), ("concept:A", "concept:B", "支援"), ("concept:A", "concept:?", "x")])]
    (tmp_path / "old.json").write_text(json.dumps({"nodes": nodes, "edges": edges}, ensure_ascii=False))
    g = graph_json.normalise(graph_json.read(spark, str(tmp_path / "old.json")))
    assert g.version == 2 and g.methodology["cooccurrence_data"] == "reconstructed" and g.methodology["semantic_provenance"] == "partial"
    pair = g.edges.filter("kind = 'cooccurrence'").first()
    assert (pair["from"], pair["to"], pair.support_count, pair.jaccard) == ("concept:A", "concept:B", 1, 0.5)
    assert {r.label: r.frequency for r in g.nodes.filter("type = 'concept'").collect()} == {"A": 2, "B": 1}
    (tmp_path / "new.json").write_text(json.dumps({"schema_version": 4, "nodes": nodes, "edges": edges, "methodology": {"semantic_provenance": "nonsense"}}, ensure_ascii=False))
    n = graph_json.normalise(graph_json.read(spark, str(tmp_path / "new.json")))
    assert n.version == 4 and n.methodology["semantic_provenance"] == "complete" and n.edges.count() == 5 and n.nodes.count() == 5


def test_store(spark, tmp_path):
    root = str(tmp_path / "db")
    m = spark.createDataFrame([("p", "a"), ("p", "b")], "patent_id string, concept string")
    store.save({"membership": m}, root, "one")
    store.save({"membership": m.limit(1)}, root, "two")
    store.save({"membership": m.filter("concept = 'a'")}, root, "one")
    assert store.load(spark, root, "one")["membership"].collect() == [("p", "a")] and store.load(spark, root, "two")["membership"].count() == 1
    with pytest.raises(ValueError):
        store.save({"x": m}, root, "one")
    store.export_csv(m.groupBy("patent_id").agg(F.collect_list("concept").alias("c")), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().c in ("a;b", "b;a")
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    pos = spark.createDataFrame([("a", 0.0, 1.0), ("b", 1.0, 1.0)], "id string, x double, y double")
    assert store.valid_positions(pos, nodes) and not store.valid_positions(pos.limit(1), nodes)


def test_progress_and_stream(spark, tmp_path):
    with progress.job(spark, "j1", "counting"):
        assert spark.range(100).count() == 100
        assert progress.progress(spark, "j1")["active"] == 0
    src, out = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([("p1", ["a", " b "]), ("p2", ["a"])], "patent_id string, keywords array<string>").write.parquet(str(src))
    stream = progress.stream_memberships(spark.readStream.schema("patent_id string, keywords array<string>").parquet(str(src)))
    progress.ingest(stream, str(out), str(tmp_path / "cp")).awaitTermination()
    assert network.concept_frequency(spark.read.parquet(str(out)).select("patent_id", "concept")).orderBy("concept").collect() == [("a", 2), ("b", 1)]


def test_catalog(spark, tmp_path):
    from quillgraph.sinks import catalog

    t = catalog.synonyms(spark, str(tmp_path / "syn"))
    assert t.read().count() == 0
    catalog.upsert_group(t, "1", "行動支付", ["QR"])
    catalog.upsert_group(t, "2", "人工智慧", ["AI"])
    catalog.upsert_group(t, "1", "行動支付", ["QR", "掃碼"])
    with pytest.raises(ValueError):
        catalog.upsert_group(t, "3", "行動支付", [])
    catalog.snapshot_synonyms(t, str(tmp_path / "snap"))
    t.delete(["2"])
    assert [(r.id, r.aliases) for r in t.read().collect()] == [("1", ["QR", "掃碼"])]
    catalog.restore_synonyms(t, str(tmp_path / "snap"))
    assert t.read().count() == 2
    a = catalog.analyses(spark, str(tmp_path / "an"))
    rows = spark.sql("select 'x' as analysis_id, 'o' as owner, 'running' as status, timestamp'2024-01-01' as created_at union all select 'y', 'o', 'running', timestamp'2024-02-01'")
    a.insert_if_absent(rows)
    a.insert_if_absent(rows)
    catalog.set_status(a, "x", "completed")
    catalog.set_status(a, "x", "failed", "late")
    assert [(r.analysis_id, r.status) for r in catalog.history(a.read(), "o").collect()] == [("y", "running"), ("x", "completed")]


def test_limits():
    from quillgraph.plans.limits import Limits, check_analysis, check_upload, from_env

    assert from_env({"UPLOAD_MAX_FILES": "3.9", "ANALYZE_MAX_PATENTS": "-1"}) == Limits(upload_max_files=3)
    assert check_upload([("a.XLSX", 5)]) is None and check_upload([]).status == 400 and check_upload([("a.csv", 5)]).status == 400 and check_upload([("a.xlsx", 0)]).status == 400
    assert check_upload([("a.xlsx", 9 << 20)]).status == 413 and check_upload([("a.xlsx", 5 << 20)] * 2).status == 413 and check_upload([("a.xlsx", 1)] * 11).status == 413
    assert check_analysis(20_000, 5) is None and check_analysis(20_001, 5).status == 413 and check_analysis(0, 0).status == 400


def test_labels():
    from quillgraph.plans import labels
    from quillgraph.plans.options import ViewOptions

    assert labels.scope_label([]) == "all files" and labels.scope_label(["a", "b", "c"]) == "a +2"
    assert labels.filter_summary(ViewOptions(year_range=(2000, 2001), ipc_filter=("G06Q",))) == "mode=concept; unit=patent; support>=1; years 2000-2001; IPC L3: G06Q"
    assert labels.upload_label(["a", "b", "c", "d"], 1500) == "a, b, c and 1 more (1,500 rows)" and labels.file_name("a/b", "concept", "csv") == "a-b-concept.csv"
    assert labels.tooltip({"label": "x", "frequency": 2, "first_year": 2000, "last_year": 2003, "median_year": 2001.5}) == ["x", "patents: 2", "years: 2000-2003", "median year: 2001.5"]
