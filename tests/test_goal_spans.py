"""Spans of goal texts: each is cut from its text, and each kind is found where it stands."""

import os

import numpy as np
import pytest

from tracewell.sources import goals as G

SF = "/root/testdata/sf0.01"


def found(spark, *texts):
    rows = G.goal_spans(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t").collect()
    out = [[] for _ in texts]
    for r in rows:
        text = texts[r.k]
        assert r.span == text[r.start : r.end]
        out[r.k].append((r.kind, r.span, r.detail))
    return out


def test_each_kind(spark):
    goal = "Hello there. Please compare Type Ia supernovae's light curves and redshift where z <= 0.1 mag, excluding fast novae; use 2010 to 2015! Study dwarf novae within RA: 10-20, as CSV or Parquet."
    (got,) = found(spark, goal)
    assert got == [
        ("unit", "Please compare Type Ia supernovae's light curves and redshift where z <= 0", None),
        ("unit", "Study dwarf novae within RA: 10-20, as CSV or Parquet", None),
        ("entity", "Type Ia supernovae's", None),
        ("entity", "dwarf novae", None),
        ("variable", "light curves", None),
        ("variable", "redshift", None),
        ("condition", "light curves and redshift where z <= 0.1 mag", "filter"),
        ("condition", "where z <= 0", "observation"),
        ("condition", "excluding fast novae", "exclusion"),
        ("temporal", "2010 to 2015", None),
        ("spatial", "RA: 10-20", None),
        ("output", "CSV", "csv"),
        ("output", "Parquet", "parquet"),
    ]


def test_other_scripts_and_edges(spark):
    got = found(spark, "请帮我研究超新星的光变曲线，最近 5 年，温度 > 300 K。", "I want to flux maps", None, "", "  ?! ", "no marker. second", "flux of x; measure x's flux: y")
    assert got[0][:4] == [("unit", "请帮我研究超新星的光变曲线，最近 5 年，温度 > 300 K", None), ("entity", "超新星", None), ("variable", "光变曲线", None), ("variable", "温度", None)]
    assert ("temporal", "最近 5 年", None) in got[0] and ("condition", "温度 > 300 K", "filter") in got[0]
    assert got[1] == [("unit", "I want to flux maps", None), ("variable", "flux", None)]
    assert got[2:6] == [[], [("unit", "", None)], [("unit", "?!", None)], [("unit", "no marker", None)]]
    assert [x for x in got[6] if x[0] in ("unit", "entity")] == [("unit", "measure x's flux: y", None), ("entity", "x's", None)]


def test_entities_count_once_and_long_ones_are_left_out(spark):
    got = found(spark, "Measure NGC 1 flux. measure ngc 1 fluxes. Compare " + "very " * 60 + "long flux. Study dust from Mars")[0]
    assert [s for k, s, _ in got if k == "entity"] == ["NGC 1", "dust"]


def test_matches_are_those_of_the_patterns():
    goal, r = G.Goal(), np.random.default_rng(5)
    words = ["light curve", "Spectra", "pH 值", "x", "a_b", ">=", "=", "<", " ", "  ", "12", "-3.5", "mag", "光度", "红移", "在 ", "under ", "where\n", "without", "Excluding", "RA", "dec:", "2010", "to", "2015", "19", "last 3 days", "recently", "csv", "csvs", "JSON", "ſpectra", "İ", "study", "reſearch", "，", ".", ";", "K", "very long words and more of them that go on"]
    for _ in range(3000):
        text = "".join(words[i] + " " * int(r.integers(0, 2)) for i in r.integers(0, len(words), r.integers(0, 14)))
        for name in G.STEMS:
            assert [m.span() for m in goal.found(name, text)] == [m.span() for m in goal.of[name].finditer(text)], (name, text)
        assert [m.span() for m in goal.comparisons(text)] == [m.span() for m in goal.of["filter"].finditer(text)], text


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_query_over_whole_documents(spark):
    from tracewell.plans.catalog import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if r.text is not None}
    rows = QUERIES["goal_spans"](spark, SF).collect()
    said = {i: t + f". Measure the flux of NGC {i} under calm skies, without dust, 2010 to 2015, RA: {i}, as CSV." for i, t in texts.items()}
    assert all(r.span == said[r.doc_id][r.start : r.end] for r in rows)
    kinds = {}
    for r in rows:
        kinds.setdefault(r.doc_id, set()).add(r.kind)
    assert set(kinds) == set(texts) and all(own == {"unit", "entity", "variable", "condition", "temporal", "spatial", "output"} for own in kinds.values())
    # one goal object for all rows gives what each text gives alone
    sample = np.random.default_rng(1).choice(sorted(texts), 20)
    for i in sample.tolist():
        assert sorted((r.kind, r.start, r.end, r.detail or "") for r in rows if r.doc_id == i) == sorted((k, a, b, d or "") for k, a, b, d in G.Goal().spans(said[i]))
