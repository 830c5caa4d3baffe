"""Stores by content and key, registries, dictionaries, reports and packages."""

import hashlib
import json
import zipfile

import pytest

from tests.test_operators import CURVE, cells
from tracewell.operators import evidence as E
from tracewell.sinks import stores as B


def test_bytes_are_checked_on_every_read(spark, tmp_path):
    path = str(tmp_path / "bytes")
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,), ("",)], "text string")
    assert B.put_bytes(df, "text", path).where("sha256 is null").count() == 1
    B.put_bytes(df, "text", path)
    assert sorted(bytes(r.content) for r in B.get_bytes(spark, path).collect()) == [b"", b"a", b"b"]
    bad = spark.read.parquet(path).where("size_bytes = 1").limit(1).withColumn("content", B.F.lit(b"x")).collect()
    spark.createDataFrame(bad, spark.read.parquet(path).schema).write.mode("append").partitionBy("part").parquet(path)
    with pytest.raises(Exception, match="stored bytes changed"):
        B.get_bytes(spark, path).collect()


def test_checkpoints_replay_and_refuse(spark, tmp_path):
    path, key = str(tmp_path / "c"), "0" * 64
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    assert B.checkpoint(df, path, key).count() == B.checkpoint(df.orderBy(B.F.desc("i")), path, key).count() == 2
    for other in (df.limit(1), df.unionAll(df), df.withColumn("s", B.F.lit("z"))):
        with pytest.raises(B.Conflict):
            B.checkpoint(other, path, key)
    with pytest.raises(ValueError):
        B.checkpoint(df, path, "../x")


def test_upsert_keeps_one_row_of_each_key(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    B.upsert(rows(("a", 1), ("b", 1)), path, "k")
    B.upsert(rows(("b", 2), ("c", 2)), path, "k")
    assert sorted(map(tuple, B.read_version(spark, path).collect())) == [("a", 1), ("b", 2), ("c", 2)]


def test_registry_must_give_its_hash(tmp_path):
    body = {"packs": [{"name": "é", "n": 1}], "registry_version": "1"}
    sha = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    path = tmp_path / "r.json"
    for change, error in (({}, None), ({"registry_version": "2"}, "hash_mismatch"), ({"more": 1}, "invalid_schema"), ({"packs": [{"n": 1}]}, "invalid_schema")):
        path.write_text(json.dumps(body | {"content_hash": sha} | change))
        if error:
            with pytest.raises(ValueError, match=error):
                B.load_registry(str(path), "packs", "name, n")
        else:
            assert B.load_registry(str(path), "packs", "name, n") == body["packs"]
    with pytest.raises(ValueError, match="too_large"):
        B.load_registry(str(path), "packs", "name", max_bytes=10)
    path.write_text("{")
    with pytest.raises(ValueError, match="invalid_json"):
        B.load_registry(str(path), "packs", "name")


def test_dictionary_report_and_package(spark, tmp_path):
    assert [r.name for r in B.data_dictionary(spark, CURVE).orderBy("position").collect()] == [f.name for f in CURVE.fields]
    assert json.loads(B.dictionary_json(CURVE))["fields"][0]["requirement"] == "required"
    records = spark.createDataFrame([("a", "1", None, None, []), ("b", "", None, None, [])], "object_id string, observation_time string, magnitude string, flux string, evidence array<string>")
    results = E.gate_results(records, "object_id", CURVE, "evidence")
    B.write_report(E.quality_report(E.gate_scores(results)), E.quality_issues(results, "object_id"), str(tmp_path / "out" / "report"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out" / "report")).collect()]
    assert sum("issue_count" in x for x in lines) == 1 and len(lines) == 1 + next(x["issue_count"] for x in lines if "issue_count" in x)
    manifest = B.package(spark, str(tmp_path / "out"), str(tmp_path / "a.zip"))
    B.package(spark, str(tmp_path / "out"), str(tmp_path / "b.zip"))
    assert (tmp_path / "a.zip").read_bytes() == (tmp_path / "b.zip").read_bytes() and manifest == sorted(manifest)
    assert zipfile.ZipFile(tmp_path / "a.zip").namelist()[0] == "manifest.jsonl"
    with pytest.raises(ValueError):
        B.package(spark, str(tmp_path / "out"), str(tmp_path / "c.zip"), max_bytes=1)


def test_a_repeated_key_is_no_second_key(spark):
    rows = [(1, "a", "x", True), (1, "a", "x", True), (2, "a", "x", True), (2, "b", "y", True)]
    prints = {r.record_id: r.fingerprint for r in E.resolve(spark.createDataFrame(rows, "record_id int, field_name string, value string, eligible boolean"), ["a", "b"]).collect()}
    assert prints[1] is None and prints[2] is not None


def test_a_column_takes_one_target(spark):
    columns = spark.createDataFrame([("t", 0, "x"), ("t", 1, "y")], "artifact_id string, column_index int, header string")
    targets = spark.createDataFrame([("a",), ("b",)], "target_field string")
    proposals = spark.createDataFrame([("t", 0, "a", 0.8), ("t", 0, "b", 0.9), ("t", 1, "b", 0.95), ("t", 1, "a", 0.2)], "artifact_id string, column_index int, target_field string, score double")
    assert [(r.column_index, r.target_field) for r in E.map_columns(columns, targets, proposals).collect()] == [(0, "b")]


def test_times_need_a_scale_and_julian_dates_are_shifted(spark):
    candidates, _ = E.extract(cells(spark, ("object_id", "observation_time"), ("a", "2459000.25"), ("b", "2459001")), CURVE)
    context = spark.createDataFrame([("t", 0, "observation_time", "JD", "UTC"), ("t", 1, "observation_time", "JD", None)], "table_id string, row_index long, field_name string, unit string, time_scale string")
    got = {r.row_index: (r.status, r.value) for r in E.normalize(E.map_fields(candidates, CURVE), context, {"observation_time": "MJD"}, {"observation_time": "UTC"}).where("field_name = 'observation_time'").collect()}
    assert got == {0: ("normalized", "58999.75"), 1: ("needs_review", "59000.5")}
