"""Commits over five tables: crashes, conflicts, audits, replays, recovery."""

import pytest
from pyspark.sql import functions as F

from tracewell.sinks import catalog as C
from tracewell.sinks.stores import Conflict


def rows(spark, ids, size=10):
    base = spark.createDataFrame([(i,) for i in ids], "i int")
    sha = F.sha2(F.col("i").cast("string"), 256)
    return {
        "artifacts": base.select(sha.alias("byte_sha256"), F.lit(size).cast("long").alias("size_bytes"), F.lit("text/csv").alias("media_type"), F.lit("table").alias("artifact_kind"), F.lit("u").alias("storage_uri")),
        "acquisitions": base.select(F.concat(F.lit("e"), "i").alias("event_id"), F.lit("l").alias("locator_hash"), sha.alias("byte_sha256"), F.lit("u").alias("source_url"), F.lit("t").alias("source_title"), F.lit("stored").alias("status"), F.lit(1).alias("extra")),
        "failures": base.where("i % 2 = 0").select(F.concat(F.lit("f"), "i").alias("event_id"), F.lit("l").alias("locator_hash"), F.lit("u").alias("source_url"), F.lit("t").alias("source_title"), F.lit("timeout").alias("error_code"), F.lit(True).alias("retryable")),
    }


def counts(catalog, version=None):
    r = catalog.summary(version).first()
    return r.artifacts, r.acquisitions, r.failures, r.reflections, r.qualifications, r.stored_bytes, r.version


def test_commits_add_each_key_once_and_old_versions_stay(spark, tmp_path):
    c = C.Catalog(spark, str(tmp_path / "c"))
    assert counts(c) == (0, 0, 0, 0, 0, 0, 0)
    assert c.commit(rows(spark, [1, 2, 2, 3])) == 1 and c.commit(rows(spark, [3, 4], 99)) == 2 and c.commit(rows(spark, [1])) == 3
    assert counts(c) == (4, 4, 2, 0, 0, 30 + 99, 3) and counts(c, 1) == (3, 3, 1, 0, 0, 30, 1)
    assert c.record()["rows"] == {"artifacts": 4, "acquisitions": 4, "failures": 2, "reflections": 0, "qualifications": 0} and c.recover() == []
    assert c.commit({n: df.limit(0) for n, df in rows(spark, [9]).items()}) == 4 and counts(c)[:3] == (4, 4, 2)


@pytest.mark.parametrize("point", ["artifacts", "failures", "_audit", "_publish"])
def test_a_crash_between_writes_is_never_seen(spark, tmp_path, monkeypatch, point):
    c = C.Catalog(spark, str(tmp_path / "c"))
    c.commit(rows(spark, [1]))
    stage, crash = c._stage, RuntimeError("the writer died")

    def dies(*args, **_):
        raise crash

    def staged(name, *rest):
        out = stage(name, *rest)
        if name == point:
            raise crash
        return out

    monkeypatch.setattr(c, point if point.startswith("_") else "_stage", dies if point.startswith("_") else staged)
    with pytest.raises(RuntimeError):
        c.commit(rows(spark, [1, 2, 3]))
    monkeypatch.undo()
    again = C.Catalog(spark, str(tmp_path / "c"))
    assert counts(again) == (1, 1, 0, 0, 0, 10, 1)
    assert len(again.recover()) == {"artifacts": 1}.get(point, 3) and again.recover() == []
    assert again.commit(rows(spark, [1, 2, 3])) == 2 and counts(again) == (3, 3, 1, 0, 0, 30, 2)


def test_writers_that_meet(spark, tmp_path, monkeypatch):
    a, b = (C.Catalog(spark, str(tmp_path / "c")) for _ in range(2))
    publish, met = a._publish, []

    def late(record):
        if not met:  # the other writer is faster, once
            met.append(b.commit(rows(spark, [2, 5])))
        publish(record)

    monkeypatch.setattr(a, "_publish", late)
    assert a.commit(rows(spark, [1, 2])) == 2 and met == [1]
    assert counts(a) == (3, 3, 1, 0, 0, 30, 2) and a.recover() == []

    def always(record):
        b.commit(rows(spark, [100 + record["version"]]))
        publish(record)

    monkeypatch.setattr(a, "_publish", always)
    with pytest.raises(Conflict):
        a.commit(rows(spark, [7]), tries=2)
    assert a.read("artifacts").where(F.col("byte_sha256") == F.sha2(F.lit("7"), 256)).count() == 0 and a.recover() == []


def test_audits_refuse(spark, tmp_path):
    c = C.Catalog(spark, str(tmp_path / "c"))
    own = rows(spark, [1, 2])
    with pytest.raises(C.AuditFailed):
        c.commit({"acquisitions": own["acquisitions"]})  # of bytes that are not there
    with pytest.raises(C.AuditFailed):
        c.commit({"artifacts": own["artifacts"].withColumn("size_bytes", F.when(F.col("byte_sha256") > "9", 1).cast("long"))})
    with pytest.raises(C.AuditFailed):
        c.commit({"artifacts": own["artifacts"].withColumn("byte_sha256", F.lit(None).cast("string"))})
    assert c.versions() == [] and c.recover() == []
    reflections = spark.createDataFrame([("p", 1, "q", "", "stop", None, 1)], C.ACQUISITION["reflections"].schema)
    marks = spark.createDataFrame([("m", "p", None, 0.5, True, "")], C.ACQUISITION["qualifications"].schema)
    assert c.commit({**own, "reflections": reflections, "qualifications": marks}) == 1 and counts(c) == (2, 2, 1, 1, 1, 20, 1)
