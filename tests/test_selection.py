"""Selection's rules on nulls, empty tables and clashing keys."""

import pytest

from tracewell.operators import selection as L


def test_capabilities(spark):
    rows = [("a", ["Physics"], ["x"]), ("b", ["GENERIC"], ["y", "x"]), ("c", ["biology"], ["x"]), ("d", None, ["x"]), ("e", ["physics"], None), ("f", ["physics"], ["z"])]
    capabilities = spark.createDataFrame(rows, "id string, domains array<string>, source_types array<string>")
    fields = spark.createDataFrame([("f", ["x", "z"]), ("g", None)], "field_name string, preferences array<string>")
    assert {r.id for r in L.applicable_capabilities(capabilities, "id", ["physics"], ["x", "y"], fields).collect()} == {"a", "b"}
    packs = spark.createDataFrame([("p", ["a", "b"]), ("q", ["a"]), ("r", None)], "pack string, required array<string>")
    assert {r.pack: (r.missing, r.mode) for r in L.routing_mode(packs, ["a"], ["a"]).collect()} == {"p": (["b"], "generic"), "q": ([], "formal"), "r": ([], "formal")}
    assert {r.pack: (r.missing, r.mode) for r in L.routing_mode(packs, ["a"], ["z"]).collect()}["p"] == (["b", "z"], "unsupported")


def test_gates_and_ratios(spark):
    fields = spark.createDataFrame([("a", True, True, "covered"), ("b", True, False, "uncertain"), ("c", False, False, "covered")], "field_name string, required boolean, entity_key boolean, state string")
    gates = spark.createDataFrame([("all", "required_fields", ["b", "a"], 1.0, True), ("any", "any_of_fields", ["b", "c"], 1.0, True), ("none", "required_fields", ["b", "unknown"], 0.5, False)], "gate string, kind string, fields array<string>, threshold double, blocking boolean")
    got = {r.gate: (r.covered, r.missing, r.ratio, r.state) for r in L.gate_coverage(gates, fields).collect()}
    assert got == {"all": (["a"], ["b"], 0.5, "partial"), "any": (["c"], ["b"], 0.5, "satisfied"), "none": ([], ["b", "unknown"], 0.0, "unsatisfied")}
    types = spark.createDataFrame([("covered",), ("uncovered",)], "state string")
    assert tuple(L.coverage_ratios(fields, types).first()) == (0.5, 1.0, 0.5)
    assert tuple(L.coverage_ratios(fields.limit(0), types).first()) == (1.0, 1.0, 0.5)


def test_attempts(spark):
    routes = spark.createDataFrame([(r, i, f"p{i}", t) for r in "abcde" for i, t in ((0, None), (1, "s"), (2, "t"))], "route string, position int, parser_id string, trigger string")
    ran = [("a", "p0", "succeeded", [], 1), ("b", "p0", "quality_failed", ["t"], 1), ("b", "p2", "succeeded", [], 1), ("c", "p1", "succeeded", [], 1), ("d", "p0", "failed", ["s"], 9), ("d", "p1", "failed", [], 9), ("e", "p0", "failed", [], 1), ("e", "p1", "succeeded", [], 1)]
    recorded = spark.createDataFrame(ran, "route string, parser_id string, status string, failed_checks array<string>, cost long")
    got = {}
    for r in L.parse_attempts(routes, recorded, 10).orderBy("route", "position").collect():
        got.setdefault(r.route, []).append((r.outcome, r.reason))
    no = ("not_run", None)
    assert got["a"] == [("succeeded", None), no, no] and got["c"] == [("blocked", "parser_unavailable"), no, no]
    assert got["b"] == [("quality_failed", None), ("blocked", "quality_unsatisfied"), ("succeeded", None)]
    assert got["d"] == [("failed", None), ("blocked", "budget_exhausted"), ("blocked", "parser_unavailable")]
    assert got["e"] == [("failed", None), ("blocked", "quality_unsatisfied"), ("blocked", "parser_unavailable")]


def test_one_to_one_fails_loudly(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    right = lambda *keys: spark.createDataFrame([(k, "y") for k in keys], "k int, y string")
    assert L.one_to_one(left, right(2, 1), "k").count() == 2
    for keys in ((1,), (1, 2, 3), (1, 2, 2), (1, 2, None)):
        with pytest.raises(Exception, match="not one to one"):
            L.one_to_one(left, right(*keys), "k").collect()


def test_graph_search(spark):
    nodes = spark.createDataFrame([("a", "Heart", "心"), ("b", "Lung", None), ("c", "Skin", None)], "node string, label string, original string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")
    found, inside = L.search_graph(nodes, edges, " HEART")
    assert {r.node for r in found.collect()} == {"a", "b"} and [tuple(e) for e in inside.collect()] == [("a", "b")]
    assert L.search_graph(nodes, edges, "")[0].count() == 3 and L.search_graph(nodes, edges, "心")[0].count() == 2
