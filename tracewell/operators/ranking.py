"""Operators whose meaning is a window, a ranking or a fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key: an aggregate that keeps one row for each key and task, not a sort of each group."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, "_r.*").select(df.columns)


def terminal(df: DataFrame, keys: Sequence[str], attempt: Column) -> DataFrame:
    """The row with the highest attempt number of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), attempt).alias("_r")).select(*keys, "_r.*").select(df.columns)


def running_rank(df: DataFrame, group: Sequence[str], order: Sequence[Column], to: str = "rank") -> DataFrame:
    return df.withColumn(to, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def round_robin(df: DataFrame, group: str, order: Sequence[Column], key: str, limit: int) -> DataFrame:
    """The first of every group, then the second of every group and so on, each key once, up to ``limit``.

    No group can give more than ``limit`` rows, so ranks beyond it are cut before the interleaving sort."""
    ranked = running_rank(df, [group], order, "_offset").where(F.col("_offset") <= limit)
    return first_wins(ranked, [key], [F.col("_offset"), F.col(group)]).orderBy("_offset", group).limit(limit).withColumnRenamed("_offset", "turn")


def islands(df: DataFrame, group: str, order: str, starts: Column) -> DataFrame:
    """Numbers runs of rows of a group; ``starts`` (over columns and lag) says where a new one begins."""
    w = Window.partitionBy(group).orderBy(order)
    flagged = df.withColumn("_start", F.when(starts, 1).otherwise(0))
    return flagged.withColumn("island", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def stagnant(rounds: DataFrame, order: str, gain: str, new: str, k: int = 2, least: float = 0.02, few: int = 1) -> DataFrame:
    """For each round: were the last k rounds all below ``least`` gain with at most ``few`` new sources?"""
    w = Window.orderBy(order).rowsBetween(-(k - 1), 0)
    calm = (F.count(F.lit(1)).over(w) == k) & (F.max(gain).over(w) < least) & (F.max(new).over(w) <= few)
    return rounds.withColumn("stagnant", calm)


def marginal_gain(rounds: DataFrame, order: str, value: str) -> DataFrame:
    """What each round added, 0 at least."""
    w = Window.orderBy(order)
    return rounds.withColumn("gain", F.greatest(F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)), F.lit(0)))


def in_order_share(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Share of neighbouring rows of a group whose values grow."""
    w = Window.partitionBy(group).orderBy(order)
    pairs = df.select(group, (F.col(value) > F.lag(value).over(w)).alias("_up"))
    return pairs.groupBy(group).agg(F.coalesce(F.avg(F.col("_up").cast("int")), F.lit(1.0)).alias("in_order"))


def greedy_budget(df: DataFrame, group: str, order: Sequence[Column], key: str, cost: str, time: str, max_cost: float, max_time: float) -> DataFrame:
    """group and the keys taken: by priority, each that still fits both budgets; one that does not fit is passed over.

    A fold over each group's candidates; the group (a task's queries) is bounded by nature.
    """
    listed = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.col(key).alias("k"), F.col(cost).cast("double").alias("c"), F.col(time).cast("double").alias("t")))).alias("all"))
    kind = dict(df.dtypes)[key]
    start = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("t"), F.array().cast(f"array<{kind}>").alias("taken"))
    step = lambda s, x: F.when(
        (s["c"] + x["c"] <= max_cost) & (s["t"] + x["t"] <= max_time),
        F.struct((s["c"] + x["c"]).alias("c"), (s["t"] + x["t"]).alias("t"), F.array_append(s["taken"], x["k"]).alias("taken")),
    ).otherwise(s)
    return listed.select(group, F.aggregate("all", start, step).alias("r")).select(group, F.posexplode("r.taken").alias("position", key))


def macro_f1(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy and macro F1 over all labels, from one aggregate per (truth, prediction) pair."""
    pairs = df.groupBy(F.col(truth).cast("string").alias("t"), F.col(predicted).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    each = pairs.select("n", F.explode(F.array_distinct(F.array("t", "p"))).alias("label"), "t", "p")
    is_ = lambda c: F.col(c) == F.col("label")
    labels = each.groupBy("label").agg(F.sum(F.when(is_("t") & is_("p"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(~is_("t"), F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when(~is_("p"), F.col("n")).otherwise(0)).alias("fn"))
    f1 = labels.agg(F.avg(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("macro_f1"))
    accuracy = pairs.agg((F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return accuracy.crossJoin(f1)
