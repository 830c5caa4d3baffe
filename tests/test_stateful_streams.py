"""Stateful streams over several batches and a restart, against folding each key's rows at once."""

import datetime

import numpy as np
import pytest

from tracewell.streaming import stateful as V

START = datetime.datetime(2024, 1, 1)


def ms(t):
    return int((t - START).total_seconds() * 1000) + 1_704_067_200_000


def breaker(rows, threshold, cooldown, idle, end):
    out, held = [], {}
    for host, event, ok, t in sorted(rows, key=lambda r: (r[3], r[1])):
        at = ms(t)
        failures, until, last, probed = held.get(host, (0, None, None, False))
        if until is not None and not probed and until <= min(at, last + idle):
            out.append((host, None, until, "probe"))
            probed = True
        if last is not None and at - last > idle:
            failures, until = 0, None
        state = "closed" if until is None else "open" if at < until else "half_open"
        out.append((host, event, at, state))
        if state != "open":
            failures = 0 if ok else failures + 1
            if ok:
                until = None
            elif failures >= threshold or state == "half_open":
                until, probed = at + cooldown, False
        held[host] = (failures, until, at, probed)
    return out + [(h, None, until, "probe") for h, (_, until, last, probed) in held.items() if until is not None and not probed and until <= min(end, last + idle)]


@pytest.fixture()
def two_stores(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def stream(spark, rows, schema, tmp_path, build, cuts):
    """Runs over files one at a time; after half of them the query stops and starts anew."""
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    parts = np.array_split(np.arange(len(rows)), cuts)
    for half in (parts[: cuts // 2], parts[cuts // 2 :]):
        for part in half:
            spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        V.run_to_end(build(source), out, checkpoint)
    return [tuple(r) for r in spark.read.parquet(out).collect()]


def test_breaker_over_batches_and_a_restart(spark, tmp_path, two_stores):
    r = np.random.default_rng(3)
    rows = sorted((str(r.integers(0, 3)), i, bool(r.random() > 0.6), START + datetime.timedelta(seconds=int(20 * i + (5000 if i > 90 else 0)))) for i in range(120))
    rows.sort(key=lambda x: x[3])
    got = stream(spark, rows, "host string, event long, ok boolean, ts timestamp", tmp_path, lambda s: V.breaker_stream(s, "host", "event", "ok", "ts", 2, 100, 3000), 4)
    want = breaker(rows, 2, 100_000, 3_000_000, ms(rows[-1][3]))
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and {x[3] for x in got} == {"closed", "open", "half_open", "probe"}


def test_jobs_over_batches_and_a_restart(spark, tmp_path, two_stores):
    moves = [("a", "queued", 0), ("b", "running", 5), ("a", "running", 10), ("b", "queued", 20), ("a", "succeeded", 60), ("b", "running", 70), ("a", "queued", 80), ("c", "queued", 90), ("c", "running", 100), ("d", "queued", 900), ("b", "succeeded", 1000), ("c", "failed", 1010)]
    rows = [(j, i, s, START + datetime.timedelta(seconds=t)) for i, (j, s, t) in enumerate(moves)]
    got = stream(spark, rows, "job string, event long, state string, ts timestamp", tmp_path, lambda s: V.job_stream(s, "job", "event", "state", "ts", 300), 4)
    at = lambda t: ms(START) + 1000 * t
    want = [("a", 0, at(0), "queued", True), ("b", 1, at(5), "none", False), ("a", 2, at(10), "running", True), ("b", 3, at(20), "queued", True), ("a", 4, at(60), "succeeded", True), ("b", 5, at(70), "running", True), ("a", 6, at(80), "succeeded", False), ("c", 7, at(90), "queued", True), ("c", 8, at(100), "running", True), ("d", 9, at(900), "queued", True), ("b", None, at(370), "failed", True), ("c", None, at(400), "failed", True), ("b", 10, at(1000), "failed", False), ("c", 11, at(1010), "failed", False)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_times_are_rounded_to_the_nearest_millisecond(spark, tmp_path, two_stores):
    assert [r.t for r in spark.sql("SELECT timestamp_micros(x) AS t FROM VALUES (1499L), (1500L), (-500L), (-499L), (null) v(x)").select(V.to_millis("t")).selectExpr("unix_micros(t) t").collect()] == [1000, 2000, -1000, 0, None]
    rows = [("a", 0, False, START + datetime.timedelta(microseconds=179_575)), ("a", 1, True, START + datetime.timedelta(microseconds=179_501)), ("a", 2, True, START + datetime.timedelta(seconds=9, microseconds=499))]
    got = stream(spark, rows, "host string, event long, ok boolean, ts timestamp", tmp_path, lambda s: V.breaker_stream(s, "host", "event", "ok", "ts", 1, 1, 3000), 2)
    assert sorted((x[2] - ms(START), x[1] is None, x[3]) for x in got) == [(180, False, "closed"), (180, False, "open"), (1180, True, "probe"), (9000, False, "half_open")]
