"""Structured Streaming over append-only event tables; each gives what the batch query gives on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and type; on a stream a window closes once the watermark has passed it."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, size).alias("w"), kind).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), kind, "events", "total")


def idempotent(events: DataFrame, key: str, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each key once: a replay of the same key within the watermark is dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def breaker(events: DataFrame, host: str, ok: str, time: str, threshold: int = 3, cooldown_s: float = 60.0) -> DataFrame:
    """Circuit breaker for each host over its attempts in time order: closed until ``threshold`` failures in a row, then
    open for the cooldown, then one probe. Gives the state before each attempt. Batch; a host's attempts are bounded."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        failures, until, states = 0, None, []
        for at, good in zip(group[time], group[ok], strict=True):
            state = "closed" if until is None else ("open" if at < until else "half_open")
            states.append(state)
            if state == "open":
                continue
            if good:
                failures, until = 0, None
            else:
                failures += 1
                if failures >= threshold or state == "half_open":
                    until = at + pd.Timedelta(seconds=cooldown_s)
        return group.assign(state=states)

    def ordered(group: pd.DataFrame) -> pd.DataFrame:
        return run(group.sort_values(time, kind="stable"))

    return events.groupBy(host).applyInPandas(ordered, events.select("*", F.lit("").alias("state")).schema)


def breaker_stream(events: DataFrame, host: str, ok: str, time: str, threshold: int = 3, cooldown_s: float = 60.0) -> DataFrame:
    """The breaker on a stream: host, time and state of each attempt. What is kept of a host is its failures in a row and
    when its breaker closes, however long its history; attempts of one batch are taken in time order."""
    kind = dict(events.dtypes)[host]

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        failures, until = state.get if state.exists else (0, None)
        until = None if until is None else pd.Timestamp(until)
        rows = pd.concat(list(batches)).sort_values(time, kind="stable")
        told = []
        for at, good in zip(rows[time], rows[ok], strict=True):
            now = "closed" if until is None else ("open" if at < until else "half_open")
            told.append(now)
            if now == "open":
                continue
            failures = 0 if good else failures + 1
            if good:
                until = None
            elif failures >= threshold or now == "half_open":
                until = at + pd.Timedelta(seconds=cooldown_s)
        state.update((failures, None if until is None else until.to_pydatetime()))
        yield pd.DataFrame({host: key[0], time: rows[time], "state": told})

    out = f"{host} {kind}, {time} timestamp, state string"
    return events.groupBy(host).applyInPandasWithState(run, out, "failures int, until timestamp", "append", "NoTimeout")


def job_states(events: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """key, state and refused: where each job's transitions lead, queued, running, then succeeded or failed, and how many
    were refused as out of order. A fold over a job's events, which are few by nature."""
    listed = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(state).alias("s")))).alias("all"))
    start = F.struct(F.lit(None).cast("string").alias("s"), F.lit(0).cast("long").alias("refused"))

    def step(held, x):
        fits = (held["s"].isNull() & (x["s"] == "queued")) | ((held["s"] == "queued") & (x["s"] == "running")) | ((held["s"] == "running") & x["s"].isin("succeeded", "failed"))
        return F.when(F.coalesce(fits, F.lit(False)), F.struct(x["s"].alias("s"), held["refused"].alias("refused"))).otherwise(F.struct(held["s"].alias("s"), (held["refused"] + 1).alias("refused")))

    return listed.select(key, F.aggregate("all", start, step).alias("r")).select(key, F.col("r.s").alias(state), "r.refused")


def round_progress(rounds: DataFrame, path: str, checkpoint: str, order: str = "round", value: str = "coverage", new: str = "new_sources"):
    """Follows a stream of finished rounds: after each batch the table at ``path`` has every round with its gain and
    whether the search stagnates. A batch that is tried again replaces its own rows, so each round counts once."""
    from tracewell.operators.ranking import marginal_gain, stagnant

    def step(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rounds/{number}")
        every = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/rounds/*")
        told = stagnant(marginal_gain(every, order, value), order, "gain", new)
        told.write.mode("overwrite").parquet(f"{path}/progress")

    return rounds.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state(events: DataFrame, key: str, time: str, state: str) -> DataFrame:
    """The newest state of each job."""
    return events.groupBy(key).agg(F.max_by(state, time).alias(state), F.max(time).alias(time))


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Runs a stream over what is there and stops: exactly-once files by the checkpoint."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
