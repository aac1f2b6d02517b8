"""Scalar functions against known values."""

import math

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import numeric as N
from quillgraph.functions import text as X


def values(spark, fn, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_ipc_normalisation(spark):
    raw = ["G06Q-010/10", "G06K-09/00", "G06K-009/00", "H02M -001/42", "G06Q-040/00 (2012.01)", "Z99Z-010/10", "g06q", None, "", "G06Q10/10;;"]
    assert values(spark, X.normalize_ipc5, raw) == ["G06Q10/10", "G06K9/00", "G06K9/00", "H02M1/42", "G06Q40/00", None, "G06Q", None, None, "G06Q10/10"]
    for level, want in ((1, "G"), (2, "G06"), (3, "G06Q"), (4, "G06Q10"), (5, "G06Q10/40")):
        assert values(spark, lambda c, level=level: X.ipc_key_at_level(c, level), ["G06Q10/40"]) == [want]
    for level in (4, 5):
        assert values(spark, lambda c, level=level: X.ipc_key_at_level(c, level), ["G06Q"]) == [None]
    assert values(spark, lambda c: X.ipc_key_at_level(c, 3), ["g06q10/40", "xx"]) == [None, None]


def test_identifiers(spark):
    assert values(spark, X.normalize_application_number, ["TW109208236", " tw-109208236 ", "", None]) == ["109208236", "109208236", None, None]
    assert values(spark, X.normalize_patent_number, ["TWM628244U", "D199419", "M199419"]) == ["M628244", "D199419", "M199419"]
    assert values(spark, X.normalize_reference, ["TWM563592U", "US2017/0041332A1"]) == ["M563592", "US2017/0041332A1"]
    assert values(spark, X.is_usable_reference, ["TWM563592U", "美國60/168,894", "US2017/0041332A1", "", None]) == [True, False, True, False, False]


def test_names(spark):
    raw = ["國泰金融控股股份有限公司 臺北市大安區仁愛路4段296號 (中華民國)", "某公司（台灣）", "A　B", None]
    assert values(spark, X.clean_applicant_name, raw) == ["國泰金融控股股份有限公司", "某公司", "A", None]
    assert values(spark, X.extract_country, raw[:3]) == ["中華民國", "台灣", None]
    assert values(spark, X.normalize_applicant_name, ["ＪＸ金屬股份有限公司", "Acme Co., Ltd.", "Acme Inc."]) == ["JX金屬公司", "ACME公司", "ACME公司"]
    assert values(spark, X.classify_org_type, ["國泰金融控股", "某商業銀行", "富邦人壽", "台灣大學", "資訊科技公司", "王小明", "其他企業集團公司", ""]) == ["金控", "銀行", "保險", "學研", "科技資訊", "個人", "其他", "其他"]
    assert values(spark, X.institution_type_of, ["台灣大學", "某證券", "其他企業集團公司", "王小明"]) == ["大學", "證券投承", "學研", "個人"]
    assert values(spark, X.normalize_title_key, ["Ａ b-c（一）"]) == ["ABC一"]
    assert values(spark, X.strip_bom, ["﻿​x", "y"]) == ["x", "y"]
    assert values(spark, X.squeeze, [" a 　 b﻿"]) == ["a b"]
    assert values(spark, X.split_applicants, ["甲；乙; 甲 ;", None]) == [["甲", "乙"], []]


def fnv(s):
    h = 2166136261
    b = s.encode("utf-16-be")
    for i in range(0, len(b), 2):
        h = ((h ^ int.from_bytes(b[i : i + 2], "big")) * 16777619) & 0xFFFFFFFF
    return h


def test_fnv(spark):
    texts = ["", "abc", "人工智慧", "😀x"]
    assert values(spark, X.fnv1a32, texts) == [fnv(t) for t in texts]
    want = f"e:cooccurrence:{fnv('["cooccurrence","a","中""]'.replace(chr(0x22) + chr(0x22) + ']', chr(0x5C) + chr(0x22) + chr(0x22) + ']')):08x}"
    assert values(spark, lambda c: X.stable_edge_id("cooccurrence", F.lit("a"), c), ['中"']) == [want]


def test_dates(spark):
    assert values(spark, N.excel_serial_to_date, [44196.0, 38016.0, 44558.0, 0.0, -1.0, float("nan"), None], "double") == ["2020-12-31", "2004-01-30", "2021-12-28", None, None, None, None]
    assert values(spark, N.coerce_date, ["44196", "2020/1/2", " ", None]) == ["2020-12-31", "2020/1/2", None, None]
    assert values(spark, N.date_sort_key, ["2020/1/2", "2020-11-12", "x"]) == ["20200102", "20201112", None]
    assert values(spark, N.filing_year, ["2020/1/2", "x", None]) == [2020, None, None]
    assert values(spark, lambda c: N.is_valid_year(c, 2025), [1989, 1990, 2025, 2026, None], "int") == [False, True, True, False, False]


def test_measures(spark):
    df = spark.createDataFrame([(1.0, 0.5, 0.5), (0.5, 0.5, 0.5), (0.01, 0.9, 0.9), (0.0, 0.5, 0.5)], "p double, x double, y double")
    got = [r[0] for r in df.select(N.npmi(F.col("p"), F.col("x"), F.col("y"))).collect()]
    assert got[0] is None and got[1] == pytest.approx(1) and got[2] == pytest.approx(-0.9542425094393251) and got[3] is None
    assert [round(v, 4) for v in values(spark, N.support_opacity, [0, 5, 10], "long")] == [0.3, 0.7425, 0.9053]
    df = spark.createDataFrame([(0, 0), (1, 0), (3, 1), (1, 3), (2, 0)], "f int, r int")
    assert [r[0] for r in df.select(N.citation_state(F.col("f"), F.col("r"))).collect()] == ["absent", "insufficient", "aligned", "conflicting", "aligned"]
    assert values(spark, N.concept_size, [0, 1, 100], "long") == [10.0, 20.0, 72.0]
    assert values(spark, N.applicant_size, [0, 1, 100], "long") == [18.0, 23.0, 52.0]


def test_gradient_hits_anchors(spark):
    got = values(spark, lambda c: N.gradient_colour(c, F.lit(2000), F.lit(2006)), [2000, 2001, 2002, 2003, 2004, 2005, 2006, None], "int")
    assert got == [*N.RAINBOW, N.UNKNOWN_YEAR]
    between = values(spark, lambda c: N.gradient_colour(c, F.lit(2000), F.lit(2012)), [2001], "int")[0]
    a, b = N.oklab(N.RAINBOW[0]), N.oklab(N.RAINBOW[1])
    mid = N.oklab(between)
    assert all(math.isclose(m, (x + y) / 2, abs_tol=0.01) for m, x, y in zip(mid, a, b, strict=True))
