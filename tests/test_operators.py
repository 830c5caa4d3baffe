import datetime

import pytest
from pyspark.sql import functions as F

from tracewell.operators import cells as C
from tracewell.operators import contract as K
from tracewell.operators import discovery as D
from tracewell.operators import evidence as E
from tracewell.operators import ranking as W
from tracewell.operators import retrieval as R
from tracewell.sinks import tables as O
from tracewell.streaming import events as V

CURVE = K.Contract(
    fields=(
        K.Field("object_id", "string", True, ("object", "name")),
        K.Field("observation_time", "number", True, ("time", "mjd")),
        K.Field("band", "string", True, ("filter",)),
        K.Field("magnitude", "number", False, ("mag",)),
        K.Field("flux", "number"),
        K.Field("source_record_id", "string", True),
    ),
    entity_keys=("object_id",),
    gates=(K.Gate("complete", "required_fields", ("object_id", "observation_time")), K.Gate("photometry", "any_of_fields", ("magnitude", "flux")), K.Gate("traced", "field_provenance", ("magnitude",))),
)


def cells(spark, header, *rows):
    data = [("t", r, i, h, v) for r, row in enumerate(rows) for i, (h, v) in enumerate(zip(header, row, strict=True))]
    return spark.createDataFrame(data, "table_id string, row_index long, column_index long, header string, decoded string")


def test_short_profile(spark):
    candidates, gaps = E.extract(cells(spark, ("object_id", "observation_time", "band", "magnitude"), ("SN-A", "59000.1", "B", "12.3")), CURVE)
    mapped = E.map_fields(candidates, CURVE)
    assert candidates.count() == 4 and mapped.where("decision = 'auto_accepted'").count() == 4
    assert [(g.field_name, g.reason) for g in gaps.collect()] == [("source_record_id", "required_header_absent")]


def test_missing_entity_and_empty_values(spark):
    header = ("object_id", "observation_time", "band", "magnitude")
    candidates, gaps = E.extract(cells(spark, header, ("", "59000.1", "B", "12.3"), ("SN-A", "", "B", ""), ("SN-B", "not-a-number", None, "1")), CURVE)
    assert {r.row_index for r in candidates.collect()} == {1, 2}
    told = {(g.row_index, g.field_name, g.reason) for g in gaps.collect()}
    assert {(0, None, "entity_key_missing"), (1, "observation_time", "required_value_empty"), (2, "band", "required_value_empty")} <= told
    decisions = {(r.row_index, r.field_name): r.decision for r in E.map_fields(candidates, CURVE).collect()}
    assert decisions[2, "observation_time"] == "blocked_type_conflict"


def test_aliases_are_suggestions_only(spark):
    candidates, gaps = E.extract(cells(spark, ("object_id", "MJD", "filter"), ("SN-A", "1", "B")), CURVE)
    assert candidates.count() == 1
    assert {(s.header, s.suggested_field) for s in E.alias_suggestions(gaps, CURVE).collect()} == {("MJD", "observation_time"), ("filter", "band")}


def test_normalize_needs_a_unit_from_context(spark):
    candidates, _ = E.extract(cells(spark, ("object_id", "magnitude"), ("a", "12.30"), ("b", "1e5")), CURVE)
    context = spark.createDataFrame([("t", 0, "magnitude", "mag")], "table_id string, row_index long, field_name string, unit string")
    got = {(r.row_index, r.field_name): (r.status, r.issues, r.decimal_places) for r in E.normalize(E.map_fields(candidates, CURVE), context, {"magnitude": "mag"}).collect()}
    assert got[0, "magnitude"] == ("normalized", [], 2)
    assert got[1, "magnitude"] == ("needs_review", ["invalid_decimal", "source_unit_missing"], None)


def test_fusion_ladder(spark):
    rows = [
        ("one", "c1", "5", True), ("same", "c2", "5", True), ("same", "c1", "5", True), ("other", "c1", "5", True), ("other", "c2", "6", True),
        ("weak", "c1", "5", False), ("mixed", "c1", "5", True), ("mixed", "c2", "5", False), ("bad", "c1", "5", False), ("bad", "c2", "6", False),
    ]
    df = spark.createDataFrame(rows, "cluster string, candidate_id string, value string, eligible boolean").withColumn("field_name", F.lit("f")).withColumn("evidence_id", F.col("candidate_id"))
    got = {r.cluster: (r.decision, r.value, r.evidence_ids) for r in E.fuse(df, ["cluster"]).collect()}
    assert got["one"] == ("single_eligible", "5", ["c1"]) and got["same"] == ("exact_consensus", "5", ["c1", "c2"])
    assert got["other"][:2] == ("unresolved_conflict", None) and got["bad"][0] == "unresolved_conflict"
    assert got["weak"][0] == got["mixed"][0] == "withheld_review"


def test_resolution(spark):
    rows = [(1, "a", "x", True), (1, "b", "y", True), (2, "a", "x", True), (2, "b", "y", True), (3, "a", "x", True), (3, "b", "y", False), (4, "a", "z", True), (4, "b", "y", True)]
    prints = E.resolve(spark.createDataFrame(rows, "record_id int, field_name string, value string, eligible boolean"), ["a", "b"])
    assert prints.where("fingerprint is null").count() == 1
    groups = E.clusters(prints)
    assert sorted((r.members, r.decision, r.pairs) for r in groups.collect()) == [(1, "singleton", 0), (2, "auto_merged", 1)]
    assert E.pair_metrics(groups).first().reduction == pytest.approx(2 / 3)


def test_gates(spark):
    rows = [("a", "1", "12", None, ["magnitude"]), ("b", "", None, None, []), ("c", "2", "3", None, [])]
    records = spark.createDataFrame(rows, "object_id string, observation_time string, magnitude string, flux string, evidence array<string>")
    results = E.gate_results(records, "object_id", CURVE, "evidence")
    passed = {(r.object_id, r.gate): r.passed for r in results.collect()}
    assert passed == {("a", "complete"): True, ("a", "photometry"): True, ("a", "traced"): True, ("b", "complete"): False, ("b", "photometry"): False, ("b", "traced"): True, ("c", "complete"): True, ("c", "photometry"): True, ("c", "traced"): False}
    report = E.quality_report(E.gate_scores(results)).first()
    assert (report.status, report.blocking_failures) == ("needs_review", 3) and report.score == pytest.approx(2 / 3)
    none = E.quality_report(E.gate_scores(E.gate_results(records.limit(0), "object_id", CURVE, "evidence"))).first()
    assert (none.status, none.score, none.approved) == ("unsupported", 1.0, False)
    told = {r.gate: (r.records, r.score) for r in E.gate_scores(results.limit(0), CURVE).collect()}
    assert told == {g.name: (0, 1.0) for g in CURVE.gates}
    assert E.quality_report(E.gate_scores(results.where("object_id = 'a'"))).first().status == "succeeded"
    assert E.quality_report(E.gate_scores(results.where("object_id = 'a'")), upstream=False).first().status == "partial"
    assert E.quality_issues(results, "object_id").count() == 3


def test_cells_round_trip(spark):
    df = spark.createDataFrame([(0, "a", None), (1, "", "z")], "i long, x string, y string")
    long = C.unpivot(df, F.col("i"), ["x", "y"])
    assert C.pivot(long, ["x", "y"]).orderBy("row_index").collect() == df.withColumnRenamed("i", "row_index").collect()
    assert {(r.header, r.non_empty, r.empty, r.nulls) for r in C.column_profile(df, ["x", "y"]).collect()} == {("x", 1, 1, 0), ("y", 1, 0, 1)}


def test_contract_rules():
    for bad in (dict(fields=(K.Field("a"), K.Field("a")), entity_keys=()), dict(fields=(K.Field("a"),), entity_keys=("a",)), dict(fields=(K.Field("a", "odd"),), entity_keys=())):
        with pytest.raises(ValueError):
            K.Contract(**bad)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40) if i != 20] + [(5, 5)], "a long, b long")
    got = {r.id: r.component for r in D.components(edges).collect()}
    assert {got[i] for i in range(1, 21)} == {1} and {got[i] for i in range(21, 41)} == {21}


def test_greedy_budget_skips_and_goes_on(spark):
    df = spark.createDataFrame([("g", 1, 5, 1), ("g", 2, 6, 1), ("g", 3, 4, 1), ("g", 4, 1, 9)], "task string, q long, cost long, time long")
    got = W.greedy_budget(df, "task", [F.col("q")], "q", "cost", "time", 10, 5).orderBy("position").collect()
    assert [r.q for r in got] == [1, 3]


def test_select_sources(spark):
    rows = [("t", "a", c, 0.5, 10) for c in "wx"] + [("t", "b", c, 0.9, 10) for c in "xyz"] + [("t", "c", "w", 0.1, 1), ("t", "d", "v", 1.0, 1000)]
    got = D.select_sources(spark.createDataFrame(rows, "task string, source_id string, cell string, score double, bytes long"), "task", 5, 100).orderBy("position").collect()
    assert [(r.source_id, r.gain) for r in got] == [("b", 3), ("a", 1)]


def test_retrieval(spark):
    docs = spark.createDataFrame([("a", "Observation_Time quality-issue"), ("b", "quality"), ("c", "nothing"), ("d", None)], "id string, text string")
    got = {r.id: r.score for r in R.bm25(docs, "id", "text", ["observation", "issue"]).collect()}
    assert got == {"a": 1.0}
    edges = spark.createDataFrame([("a", "c")], "source string, target string")
    assert [(r.id, round(r.score, 6)) for r in R.retrieve(docs, "id", "text", ["observation"], edges).collect()] == [("a", 1.0), ("c", 0.2)]
    tagged = docs.withColumn("tags", F.when(F.col("id") == "a", F.array(F.lit("t"))).when(F.col("id") == "b", F.array(F.lit("x"))))
    assert {r.id for r in R.allowed(tagged, "tags", ["t"]).collect()} == {"a", "c", "d"}


def test_hashed_vectors(spark):
    import hashlib
    import math

    text = "alpha beta alpha x"
    want: dict[int, float] = {}
    for w in ("alpha", "beta", "alpha"):
        d = hashlib.sha256(w.encode()).digest()
        i = int.from_bytes(d[:8], "big") % 384
        want[i] = want.get(i, 0) + (-1 if d[8] & 1 else 1)
    norm = math.sqrt(sum(v * v for v in want.values()))
    got = {r.dimension: r.value for r in R.hashed_terms(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").collect()}
    assert got == pytest.approx({i: v / norm for i, v in want.items()})


def test_gold_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\"b\"\nc", ""), (2, None, "x")], "i int, s string, t string")
    O.export_gold(df, str(tmp_path / "gold"))
    assert [r.i for r in O.gold_order(spark.createDataFrame([(1, "10"), (2, "9.5"), (3, "n/a")], "i int, v string"), "v", "i").collect()] == [3, 2, 1]
    assert O.manifest(spark, str(tmp_path / "gold" / "gold.parquet")).count() >= 1


def test_upsert(spark, tmp_path):
    rows = lambda *k: spark.createDataFrame([(x, 1) for x in k], "k string, size long")
    path = str(tmp_path / "objects")
    assert O.insert_or_ignore(spark, rows("a", "b", "a"), path, "k") == 2
    assert O.insert_or_ignore(spark, rows("b", "c"), path, "k") == 1
    assert O.summary(spark.read.parquet(path), "size").first().bytes == 3


def test_stream_equals_batch(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=17 * i), "ab"[i % 2], float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = V.windowed_counts(V.read_events(spark, str(tmp_path / "in"), df.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("hourly").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("hourly").exceptAll(V.windowed_counts(df)).isEmpty() and spark.table("hourly").count() == V.windowed_counts(df).count()


def test_breaker(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [("h", start + datetime.timedelta(seconds=10 * i), ok) for i, ok in enumerate([False, False, False, True, True, True, True, True, True, True])]
    got = [r.state for r in V.breaker(spark.createDataFrame(rows, "host string, ts timestamp, ok boolean"), "host", "ok", "ts", 3, 60).orderBy("ts").collect()]
    assert got == ["closed"] * 3 + ["open"] * 5 + ["half_open", "closed"]
