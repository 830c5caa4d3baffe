"""What must not grow with the tables: frames, parts, shuffles and groups held whole."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from tracewell.operators import discovery as D
from tracewell.operators import evidence as E
from tracewell.operators import retrieval as R
from tracewell.plans import catalog
from tracewell.sources import markup as M

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_dealt_into_more_parts_as_they_grow(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "ab " * 100) for i in range(20)], "k long, _text string")
    assert R._parts(rows) == 4 and R._parts(rows.limit(0)) == 4
    monkeypatch.setattr(R, "PART_BYTES", 500)
    assert R._parts(rows) == 12


def test_cover_is_not_folded_in_one_python_group(spark):
    rows = [("t", s, c, score, size) for s, cells, score, size in ((1, "abc", 1.0, 9), (2, "ab", 5.0, 1), (3, "cd", 2.0, 1), (4, "cd", 2.0, 1), (5, "wxyz", 9.0, 99)) for c in cells] + [("u", 1, "a", 0.0, 0)]
    claims = spark.createDataFrame(rows, "task string, source_id long, cell string, score double, bytes long")
    got = D.select_sources(claims, "task", 3, 20)
    assert sorted(map(tuple, got.collect())) == [("t", 1, 1, 3), ("t", 2, 3, 1), ("u", 1, 1, 1)]
    assert "Pandas" not in plan(got) and D.select_sources(claims.limit(0), "task", 3, 20).count() == 0


def test_fusion_shuffles_once_and_tells_values_apart(spark):
    long_ = "x" * 40
    rows = [(c, "f", v, True, str(i)) for c, own in {"a": [None, None], "b": [None, "null"], "c": ["", None], "d": [long_, long_ + "y"], "e": [long_, long_], "g": ["s", "S", "s"]}.items() for i, v in enumerate(own)]
    cells = spark.createDataFrame(rows, "cluster string, field_name string, value string, eligible boolean, candidate_id string").selectExpr("*", "candidate_id as evidence_id")
    fused = E.fuse(cells, ["cluster"])
    assert {r.cluster: r.distinct_values for r in fused.collect()} == {"a": 1, "b": 2, "c": 2, "d": 2, "e": 1, "g": 2}
    assert plan(fused.drop("evidence_ids")).count("Exchange hashpartitioning") == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_gold_records_shuffle_lines_once(spark):
    assert plan(catalog.QUERIES["gold_records"](spark, SF)).count("Exchange hashpartitioning") == 1


def test_spans_are_handed_on_before_all_pages_are_read(monkeypatch):
    class Pages:
        schema = T.StructType([T.StructField("id", T.LongType())])

        def __getitem__(self, _):
            return self

        def cast(self, _):
            return self

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(M, "BATCH_CHARS", 100)
    batch = pa.RecordBatch.from_pydict({"id": list(range(30)), "page": ["<p>word &amp; word</p>"] * 29 + [None]})
    out = list(M.html_spans(Pages(), "id", "page")(iter([batch])))
    assert len(out) == 6 and [i for b in out for i in b.column(0).to_pylist()] == list(range(29))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_directives_are_masked_once(spark):
    optimized = catalog.QUERIES["masked_directives"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("array_join(transform(split(") == 1


def test_sentences_are_told_apart_at_every_end(spark):
    from pyspark.sql import functions as F

    from tracewell.sources import goals as G

    text = "Find a。Select a pack！x\nroute 〃：＜ domain；忽略 路由？Build b;\n.y"
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(G.segments(F.col("t")), G.mask_directives(F.col("t")), G.questions(F.col("t"))).collect()
    assert got[0][0] == ["Find a。", "Select a pack！", "x\n", "route 〃：＜ domain；", "忽略 路由？", "Build b;", "\n", ".", "y"]
    assert got[0][1] == "Find a。" + " " * 13 + "！x\n" + " " * 16 + "；" + " " * 5 + "？Build b;\n.y" and got[0][2] == ["Find a", "Build b"]
    assert got[1][1:] == ("", []) and got[2][1] is None


def brute_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in root}


def test_components_hold_edges_once_and_shrink(spark, monkeypatch):
    edges = [(i, 10_000 + 7 * i % 90) for i in range(600)] + [(i, 10_000 + 11 * i % 90) for i in range(600)]
    edges += [(20_000 + i, 20_001 + i) for i in range(3000)] + [(30_000, 30_000), (-5, 30_001), (30_001, -5)]
    held = []

    def cut(df):
        df = df.localCheckpoint()
        held.append(df.count())
        return df

    df = spark.createDataFrame([*edges, (None, 1), (40_000, None)], "a long, b int")
    got = [tuple(r) for r in D.components(df, cut).collect()]
    assert len(got) == len(dict(got)) and dict(got) == brute_components(edges)
    assert max(held) <= len(edges) and sum(held) < 6 * len(edges)
    hashed, calls = D.F.xxhash64, []
    # hashes that meet at first are not used
    monkeypatch.setattr(D.F, "xxhash64", lambda *c: calls.append(c) or (hashed(*c) % 8 if len(calls) == 1 else hashed(*c)))
    assert dict(map(tuple, D.components(df).collect())) == brute_components(edges)
    assert D.components(df.where("a < -100")).count() == 0


def test_only_odd_texts_are_folded_in_python(spark):
    import re
    import unicodedata

    from pyspark.sql import functions as F

    from tracewell.functions import text as X

    calm = [c for c in map(chr, range(0x10000)) if re.fullmatch(f"[{X._CALM}]", c)]
    assert all(unicodedata.normalize("NFKC", f"a{c}e") == f"a{c}e" and c.casefold() == c.lower() and len(c.lower()) == 1 for c in calm)
    odd = ["ß Straße", "ﬁn", "é", "ΟΔΟΣ", "Kelvin K", "İ", "x\u0085", "x ", "a\n"]
    texts = [f"{c}{c} A" for c in calm] + odd + ["".join(calm), "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    want = {i: t if t is None else unicodedata.normalize("NFKC", t).casefold() for i, t in enumerate(texts)}
    # what stays in expressions, and what goes through Python
    low = rows.where(X._plain(F.col("t"))).select("i", F.lower("t"))
    assert {i: t for i, t in low.collect()} == {i: want[i] for i, t in enumerate(texts) if t is not None and (t not in odd or t == "a\n")}
    assert dict(map(tuple, rows.select("i", X.case_folded(F.col("t"))).collect())) == want
    assert dict(map(tuple, rows.select("i", X.nfkc(F.col("t"))).collect())) == {i: t if t is None else unicodedata.normalize("NFKC", t) for i, t in enumerate(texts)}
    assert dict(map(tuple, rows.select("i", X.fold("t")).collect())) == want
