"""Stateful streams with state variables and event-time timers: circuit breakers by host and jobs by id.

What is kept of a key is a few values, however long its history. Timers fire when the watermark passes them: one tells when
a breaker's cooldown is over, one forgets hosts that have been idle. The rules themselves are plain functions, which
the batch forms use too. Rows of a batch are taken in order of time and id; rows behind the watermark are not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State stores with variables and timers need this store.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def to_millis(time: str) -> Column:
    """A time to the nearest millisecond, halves away from zero: what the processors count in."""
    return F.timestamp_micros(F.round(F.unix_micros(F.col(time).cast("timestamp")), -3)).alias(time)


class Breaker(StatefulProcessor):
    """closed until ``threshold`` failures in a row, open for the cooldown, then half open for one probe, which is told once
    for each cooldown: by the timer or by the attempt that comes first. A host that has been idle for longer than
    ``idle_ms`` begins anew; what it had is forgotten, a probe that was still to come too."""

    def __init__(self, host: str, event: str, ok: str, time: str, threshold: int, cooldown_ms: int, idle_ms: int):
        self.names, self.threshold, self.cooldown, self.idle = (host, event, ok, time), threshold, cooldown_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "failures int, until long, last long, told boolean")

    def _clear(self, at: int | None) -> None:
        if at is not None and at in set(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        host, event, ok, time = self.names
        failures, until, last, probed = self.held.get() if self.held.exists() else (0, None, None, False)
        old = {until, None if last is None else last + self.idle}
        every = pd.concat(list(rows))
        every["_ms"] = every[time].astype("datetime64[ms]").astype("int64")
        every = every.sort_values(["_ms", event], kind="stable")
        out = []
        for at, number, good in zip(every["_ms"].tolist(), every[event].tolist(), every[ok].tolist(), strict=True):
            if until is not None and not probed and until <= min(at, last + self.idle):
                out.append((key[0], None, until, "probe"))
                probed = True
            if last is not None and at - last > self.idle:
                failures, until = 0, None
            last = at
            state = "closed" if until is None else "open" if at < until else "half_open"
            out.append((key[0], number, at, state))
            if state == "open":
                continue
            failures = 0 if good else failures + 1
            if good:
                until = None
            elif failures >= self.threshold or state == "half_open":
                until, probed = at + self.cooldown, False
        new = {until, last + self.idle}
        for at in old - new:
            self._clear(at)
        for at in new - old - {None}:
            self.handle.registerTimer(at)
        self.held.update((failures, until, last, probed))
        frame = pd.DataFrame(out, columns=[host, event, "at_ms", "state"])
        frame[event] = pd.array([x[1] for x in out], "Int64")
        yield frame

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        host, event, _, _ = self.names
        if self.held.exists():
            failures, until, last, probed = self.held.get()
            if until == at and not probed:  # a probe may go now
                self.held.update((failures, until, last, True))
                yield pd.DataFrame({host: [key[0]], event: pd.array([None], "Int64"), "at_ms": [at], "state": ["probe"]})
            if last + self.idle == at:
                self._clear(until)
                self.held.clear()

    def close(self) -> None:
        pass


def breaker_stream(events: DataFrame, host: str, event: str, ok: str, time: str, threshold: int = 3, cooldown_s: float = 60.0, idle_s: float = 86_400.0, late: str = "0 seconds") -> DataFrame:
    """host, event, at_ms and state of each attempt (closed, open or half_open), and one row with state probe and no event
    when a cooldown has passed. A stream; the session's state store must be ``PROVIDER``."""
    kinds = events.schema
    out = T.StructType([T.StructField(host, kinds[host].dataType), T.StructField(event, T.LongType()), T.StructField("at_ms", T.LongType()), T.StructField("state", T.StringType())])
    rows = events.select(host, F.col(event).cast("long").alias(event), ok, to_millis(time)).withWatermark(time, late)
    processor = Breaker(host, event, ok, time, threshold, int(cooldown_s * 1000), int(idle_s * 1000))
    return rows.groupBy(host).transformWithStateInPandas(processor, outputStructType=out, outputMode="append", timeMode="EventTime")


class Jobs(StatefulProcessor):
    """queued, running, then succeeded or failed; a transition out of order is refused. A job that runs for longer than
    ``limit_ms`` fails by a timer."""

    def __init__(self, job: str, event: str, state: str, time: str, limit_ms: int):
        self.names, self.limit = (job, event, state, time), limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "state string, due long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        job, event, state, time = self.names
        now, due = self.held.get() if self.held.exists() else (None, None)
        old = due
        every = pd.concat(list(rows))
        every["_ms"] = every[time].astype("datetime64[ms]").astype("int64")
        every = every.sort_values(["_ms", event], kind="stable")
        out = []
        for at, number, to in zip(every["_ms"].tolist(), every[event].tolist(), every[state].tolist(), strict=True):
            if due is not None and at >= due:  # its time was up before this came
                out.append((key[0], None, due, "failed", True))
                now, due = "failed", None
            fits = to in {None: ("queued",), "queued": ("running",), "running": ("succeeded", "failed")}.get(now, ())
            if fits:
                now = to
                due = at + self.limit if to == "running" else None
            out.append((key[0], number, at, now if now is not None else "none", fits))
        if old is not None and old != due:
            self.handle.deleteTimer(old)
        if due is not None and old != due:
            self.handle.registerTimer(due)
        self.held.update((now, due))
        frame = pd.DataFrame(out, columns=[job, event, "at_ms", "state", "accepted"])
        frame[event] = pd.array([x[1] for x in out], "Int64")
        yield frame

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        job, event, _, _ = self.names
        now, due = self.held.get()
        if due == at:
            self.held.update(("failed", None))
            yield pd.DataFrame({job: [key[0]], event: pd.array([None], "Int64"), "at_ms": [at], "state": ["failed"], "accepted": [True]})

    def close(self) -> None:
        pass


def job_stream(events: DataFrame, job: str, event: str, state: str, time: str, limit_s: float = 3600.0, late: str = "0 seconds") -> DataFrame:
    """job, event, at_ms, state after it and whether it was accepted; a job whose time is up has a row without event."""
    kinds = events.schema
    out = T.StructType([T.StructField(job, kinds[job].dataType), T.StructField(event, T.LongType()), T.StructField("at_ms", T.LongType()), T.StructField("state", T.StringType()), T.StructField("accepted", T.BooleanType())])
    rows = events.select(job, F.col(event).cast("long").alias(event), state, to_millis(time)).withWatermark(time, late)
    return rows.groupBy(job).transformWithStateInPandas(Jobs(job, event, state, time, int(limit_s * 1000)), outputStructType=out, outputMode="append", timeMode="EventTime")


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over all that is there, batch by batch, and stops. Started again on the same checkpoint, it goes on with
    what has come since; its files are written exactly once."""
    session = stream.sparkSession
    before = session.conf.get(PROVIDER[0])
    session.conf.set(*PROVIDER)
    try:
        query = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
        query.awaitTermination()
    finally:
        session.conf.set(PROVIDER[0], before)


def deal_by_time(rows: DataFrame, time: str, path: str, pieces: int) -> Iterator[str]:
    """Writes rows in ``pieces`` folders below ``path``, by quantiles of their time, and gives each folder once it is there,
    so that a stream can take one piece after the other."""
    at = F.col(time).cast("timestamp").cast("double")
    cuts = rows.agg(F.percentile_approx(at, [i / pieces for i in range(1, pieces)], 1000).alias("c")).first()["c"] or []
    number = sum((F.when(at > c, 1).otherwise(0) for c in cuts), F.lit(0))
    for i in range(pieces):
        rows.where(number == i).write.parquet(f"{path}/{i:03d}")
        yield f"{path}/{i:03d}"
