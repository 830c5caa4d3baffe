"""Intake rules, the graph, pack merging and reports on nulls, empty tables and disagreements."""

import pytest
from pyspark.sql import functions as F

from tests.test_operators import CURVE
from tracewell.functions.values import backoff
from tracewell.operators import contract as K
from tracewell.operators import graph as G
from tracewell.operators import intake as N
from tracewell.operators import reports as O


def test_intake(spark):
    df = spark.createDataFrame([(" Find\tDATA ", True, "restricted"), ("fluxes of SN", True, "public"), (None, None, None)], "g string, e boolean, p string")
    got = [(r.a, r.b) for r in df.select(N.policy_problems(F.col("g"), F.col("e"), F.col("p")).alias("a"), N.external_allowed(F.col("e"), F.col("p")).alias("b")).collect()]
    assert got == [(["goal_needs_clarification", "external_model_disabled"], False), ([], True), ([], False)]
    rows = spark.createDataFrame([("k", "h", 1), ("k", "h", 2), ("k", "other", 3), ("n", None, 1), ("n", None, 2)], "k string, h string, n int")
    assert sorted((r.k, r.n, r.outcome) for r in N.intake_outcomes(rows, "k", "h", "n").collect()) == [("k", 1, "new"), ("k", 2, "replayed"), ("k", 3, "conflict"), ("n", 1, "new"), ("n", 2, "replayed")]
    goal = spark.createDataFrame([("找最近的数据", 0, 1, 1), ("all spectra", 1, 1, 1)], "t string, e int, v int, q int").withColumn("c", N.ambiguities(F.col("t"), F.col("e"), F.col("v"), F.col("q")))
    out = goal.select("c", N.clarification(F.col("t"), F.col("c")).alias("q")).collect()
    assert out[0].c == ["missing_entity", "ambiguous_scope"] and out[0].q.language == "zh" and (out[1].c, out[1].q) == ([], None)
    assert spark.range(1).select(N.assumptions(F.lit(True), F.lit(False), F.lit(False)).alias("a")).first().a == ["no_spatial_filter", "output_format_open"]


def test_graph_has_each_kind(spark):
    fields = spark.createDataFrame([("f",), ("g",)], "field_name string")
    evidence = spark.createDataFrame([("e1", "f", 0, 1, "t"), (None, "f", 0, 2, "t")], "evidence_id string, field_name string, row_index int, column_index int, table_id string")
    gates = spark.createDataFrame([("q", "required_fields", ["f"], False)], "gate string, kind string, field_names array<string>, passed boolean")
    issues = spark.createDataFrame([("i", "q", "blocking", ["f", "g"])], "issue_id string, gate string, severity string, field_names array<string>")
    nodes, edges = G.graph("t", fields, evidence, gates, issues, "m", True)
    assert sorted(r.node for r in nodes.collect()) == ["evidence:e1", "field:f", "field:g", "memory:m", "quality_gate:q", "quality_issue:i", "task:t"]
    assert {r.kind: r.n for r in edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()} == {"contains": 6, "supports": 1, "violates": 1, "affects": 2, "derived_from": 1}
    assert {r.kind for r in G.index_documents(evidence, gates, issues).collect()} == {"evidence", "quality_gate", "quality_issue"}
    empty = G.graph("t", fields.limit(0), evidence.limit(0), gates.limit(0), issues.limit(0), "m", False)
    assert empty[0].count() == 2 and empty[1].count() == 1


def test_packs_that_disagree_are_left_out(spark):
    rows = [(1, "f", "number", False, True, ["A", "b"], None, 0.5), (2, "f", "number", True, False, ["B", "c"], "mag", 0.9), (3, "f", "string", True, True, ["z"], "mag", 1.0), (4, "f", "number", False, True, None, "jy", None), (1, "g", "string", None, None, None, None, None)]
    packs = spark.createDataFrame(rows, "pack int, field_name string, data_type string, required boolean, nullable boolean, aliases array<string>, unit string, threshold double")
    got = {r.field_name: r for r in K.merge_fields(packs).collect()}
    f = got["f"]
    assert (f.data_type, f.required, f.nullable, f.aliases, f.unit, f.threshold, f.conflict) == ("number", True, False, ["A", "b", "c"], "mag", 0.9, True)
    assert [(c.pack, c.reason) for c in f.conflicts] == [("3", "data_type"), ("4", "unit")] and not got["g"].conflict and got["g"].aliases is None
    assert K.confirm(CURVE, K.contract_hash(CURVE)) and K.merge_fields(packs.limit(0)).count() == 0
    with pytest.raises(K.Stale):
        K.confirm(CURVE, "0" * 64)


def test_many_definitions_of_a_field_are_not_folded_one_by_one(spark):
    rows = [(i, "f", "t" if i % 5 else "u", None if i < 3 else "m" if i % 3 else "k", bool(i % 2), [f"A{i % 7}", f"a{i % 11}", None]) for i in range(1, 60)]
    packs = spark.createDataFrame(rows, "pack int, field_name string, data_type string, unit string, required boolean, aliases array<string>")
    names, known, unit, refused = [], set(), None, []
    for i, _, kind, u, _, own in rows:
        if kind != "t" or None not in (u, unit) and u != unit:
            refused.append((str(i), "data_type" if kind != "t" else "unit"))
            continue
        unit = unit or u
        fresh = [a for a in own if a and a.lower() not in known]
        names, known = names + fresh, known | {a.lower() for a in fresh}
    merged = K.merge_fields(packs)
    got = merged.first()
    assert (got.aliases, got.unit, [tuple(c) for c in got.conflicts]) == (names, unit, refused)
    assert "aggregate(" not in merged._jdf.queryExecution().toString().lower().replace("hashaggregate(", "").replace("sortaggregate(", "")


def test_delays(spark):
    df = spark.createDataFrame([(1, 0.0, None), (3, 1.0, None), (9, 0.5, None), (1, 0.5, " 7 "), (1, 0.5, "-3"), (1, 0.5, "99"), (1, 0.5, "soon"), (1, 0.5, "NaN")], "n int, j double, a string")
    got = [r.d for r in df.select(backoff(F.col("n"), 1.0, 10.0, F.col("j"), 0.5, F.col("a")).alias("d")).collect()]
    assert got == [0.5, 6.0, 10.0, 7.0, 0.0, 10.0, 1.0, 1.0]


def test_reports(spark):
    fields = spark.createDataFrame([("c", 1, "a", "x", True), ("c", 1, "b", "y", False), ("c", 2, "a", "x", True), ("c", 3, "a", None, True), ("d", 4, "a", "x", True), ("c", 5, "a", "x", False)], "cluster string, record int, field_name string, value string, eligible boolean")
    assert [(r.cluster, r.copies, r.first_record) for r in O.duplicate_groups(fields, "cluster", "record").collect()] == [("c", 2, 1)]
    texts = spark.createDataFrame([("a", O_HASH), ("a", "bad"), (None, None)], "t string, h string")
    assert O.wrong_hashes(texts, "t", "h").count() == 1
    assert O.orphans(fields, spark.createDataFrame([(1,), (1,), (2,)], "record int"), "record").count() == 3
    none = O.status_ladder(spark.createDataFrame([], "decision string")).first()
    assert (none.fields, none.status) == (0, "unsupported")
    kinds = {"s": ["single_eligible"], "p": ["exact_consensus", "unresolved_conflict"], "w": ["single_eligible", "withheld_review"], "n": ["unresolved_conflict", "withheld_review"]}
    rows = spark.createDataFrame([(g, d) for g, own in kinds.items() for d in own], "g string, decision string")
    assert {r.g: r.status for r in O.status_ladder(rows, by=["g"]).collect()} == {"s": "succeeded", "p": "partial", "w": "partial", "n": "needs_review"}
    assert {r.status for r in O.status_ladder(rows.where("g = 's'"), by=["g"], upstream=False).collect()} == {"partial"}


O_HASH = "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"
