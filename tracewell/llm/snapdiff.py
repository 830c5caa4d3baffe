"""Difference of two snapshots by key-range Merkle search trees, with pairing of rows that changed their key.

Each row becomes a digest row: its key and a SHA-256 of each compared column; texts are never shuffled. Both snapshots are
sorted by key over the cluster, and a key is a boundary of level 1, 2 or 3 by its hash alone, so the ranges between
boundaries are the same in both snapshots wherever the keys are. A node of the tree is the range from a boundary to the
next of its level, with the number of its rows and two sums (exclusive or) of their hashes.

The descent goes from level 3 to level 1 in joins: a node that both snapshots have with equal sums is left out, children of
the others are compared in turn. Rows of the leaves left out are verified exactly: each must occur as often in both
snapshots by key and all digests, or its leaf counts as differing after all. Rows of differing leaves are merged by
key. What has no partner by key is numbered by key within equal content, and equal numbers pair.

Nothing that grows with the rows goes to the driver, to one task or into a broadcast: order within groups is found by range
partitions sorted each for itself plus one summary row for each partition and snapshot, and these summaries alone (two for
each of ``spark.sql.shuffle.partitions``) are broadcast. A key or a content that a third of the rows have is split like
any other range. All tables on the way lie in the shared folder.

Nulls and edge cases: a null key is a key like others and pairs with a null key. Rows of a snapshot that share a key are
numbered by content and pair number by number, so repeated rows pair one to one. Null equals only null; an empty text is
not null. Empty snapshots give inserts or deletes alone, two empty ones an empty table. Columns other than the key and the
compared ones are not looked at, whatever their names. Texts are whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.storage import discard, written

#: Keys between boundaries of a level, on average: rows in a leaf, leaves below a node of level 2, nodes of level 2
#: below one of level 3.
FANOUT = 32
LEVELS = 3


def _level(key: Column) -> Column:
    """How many levels a key is a boundary of, by its hash alone."""
    h = F.xxhash64(key, F.lit("boundary"))
    return sum((F.when(F.pmod(h, F.lit(FANOUT**n)) == 0, 1).otherwise(0) for n in range(1, LEVELS + 1)), F.lit(0))


def digests(df: DataFrame, key: str, columns: list[str], side: int) -> DataFrame:
    """(side, key, content, line, c0, c1, ...): SHA-256 of each compared column (null for null), of them all, and, for the
    later snapshot, of their texts line by line with ~ for null."""
    texts = [df[c].cast("string") for c in columns]
    line = F.sha2(F.concat_ws("\n", *(F.coalesce(t, F.lit("~")) for t in texts)), 256) if side else F.lit(None).cast("string")
    df = df.select(df[key].alias("key"), *(F.unhex(F.sha2(t, 256)).alias(f"c{i}") for i, t in enumerate(texts)), F.unhex(line).alias("line"))
    content = F.concat(*(F.coalesce(F.hex(f"c{i}"), F.lit("~")) for i in range(len(columns))))
    return df.select(F.lit(side).alias("side"), "key", F.unhex(F.sha2(content, 256)).alias("content"), "line", *(f"c{i}" for i in range(len(columns))))


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) | (pc.is_null(a).to_numpy(zero_copy_only=False) & pc.is_null(b).to_numpy(zero_copy_only=False))


def _number(batches: Iterator[pa.RecordBatch], group: list[str], levels: int) -> Iterator[pa.RecordBatch]:
    """A sorted partition with each row's number in its group and the last boundary of each level up to it in its
    snapshot, as far as the partition shows them."""
    last, number, starts = None, 0, [None] * levels
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(g) for g in group]
        fresh, other = np.zeros(n, bool), np.zeros(n, bool)
        for i, c in enumerate(columns):
            before = pa.concat_arrays([c.slice(0, 1) if last is None else last[i], c.slice(0, n - 1)])
            differs = ~_same(c, before)
            fresh |= differs
            if group[i] == "side":
                other |= differs
        if last is None:
            fresh[0] = other[0] = True
        at = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
        numbers = np.where(at >= 0, np.arange(n) - at + 1, number + np.arange(n) + 1)
        out = [*batch.columns, pa.array(numbers, pa.int64())]
        reset = np.maximum.accumulate(np.where(other, np.arange(n), -1))
        for level in range(levels):
            key, own = batch.column("key"), batch.column("level").to_numpy() > level
            found = np.maximum.accumulate(np.where(own, np.arange(n), -1))
            known = found >= np.maximum(reset, 0)  # a boundary in this batch and snapshot
            carried = ~known & (reset < 0)  # that of the batch before
            held = pa.concat_arrays([key, starts[level] if starts[level] is not None else pa.nulls(1, key.type)])
            take = pa.array(np.where(known, found, n), pa.int64(), mask=~(known | carried))
            out.append(held.take(take))
            starts[level] = out[-1].slice(n - 1, 1)
        last, number = [c.slice(n - 1, 1) for c in columns], int(numbers[-1])
        yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names, "number", *(f"s{i + 1}" for i in range(levels))])


def numbered(df: DataFrame, group: list[str], order: list[str], levels: int = 0) -> DataFrame:
    """``df``, which must have a column ``side``, with each row's number (from 1) in its group by ``order``, and, where
    levels are asked for, the boundary ``s1``, ``s2``, ... that its range of each level begins with (null before the
    first). ``group`` begins with the side for levels. Sorted in partitions; a group may span any number of them."""
    spark = df.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows that agree in all of group and order are dealt to several partitions too
    dealt = df.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(count, *group, *order, "_salt").drop("_salt")
    dealt = dealt.sortWithinPartitions(*group, *order).withColumn("part", F.spark_partition_id())
    starts = [f"s{i + 1}" for i in range(levels)]
    schema = T.StructType([*dealt.schema, T.StructField("number", T.LongType()), *(T.StructField(s, df.schema["key"].dataType) for s in starts)])
    local = written(dealt.mapInArrow(lambda batches: _number(batches, group, levels), schema), "ordered")
    # one row for each partition and snapshot: its first and last group, and the boundaries that the next go on from
    held = F.struct(*group)
    ends = [F.min(held).alias("first"), F.max(held).alias("last"), F.max(F.struct(held, "number"))["number"].alias("n")]
    parts = local.groupBy("part", "side").agg(*ends, *(F.max(s).alias(f"max_{s}") for s in starts))
    by_part = Window.partitionBy("side").orderBy("part") if levels else Window.partitionBy(F.lit(0)).orderBy("part", "side")
    if not levels:
        parts = local.groupBy("part").agg(*ends).withColumn("side", F.lit(0))
    parts = parts.withColumn("_total", F.sum("n").over(Window.partitionBy("side", "last").orderBy("part")))
    ahead = F.coalesce(F.when(F.lag("last").over(by_part).eqNullSafe(F.col("first")), F.lag("_total").over(by_part)), F.lit(0))
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", *(["side"] if levels else []), "first", ahead.alias("_ahead"), *(F.last(f"max_{s}", True).over(before).alias(f"_{s}") for s in starts))
    rows = local.join(F.broadcast(parts), ["part", "side"] if levels else ["part"])
    number = F.col("number") + F.when(F.struct(*group).eqNullSafe(F.col("first")), F.col("_ahead")).otherwise(0)
    return rows.select(*df.columns, number.alias("number"), *(F.coalesce(s, f"_{s}").alias(s) for s in starts))


def _sums() -> list[Column]:
    h = [F.xxhash64(F.lit(seed), "key", "number", "content") for seed in (1, 2)]
    return [F.count(F.lit(1)).alias("n"), *(F.bit_xor(x).alias(f"x{i}") for i, x in enumerate(h))]


def _joined_on(left: DataFrame, right: DataFrame, start: str, how: str) -> DataFrame:
    right = right.select(F.col(start).alias("_start"), F.lit(True).alias("_found"))
    return left.join(right, F.col(start).eqNullSafe(F.col("_start")), how)


def differing(rows: DataFrame) -> DataFrame:
    """(s1): the leaves whose rows differ between the snapshots, by descent from the widest ranges."""
    level = [f"s{i + 1}" for i in range(LEVELS)]
    leaves = written(rows.groupBy("side", *level).agg(*_sums()), "leaves")
    left = leaves
    for start in reversed(level):
        side = [[F.when(F.col("side") == s, F.col(c)) for c in ("n", "x0", "x1")] for s in (0, 1)]
        both = [x for s in (0, 1) for x in (F.sum(side[s][0]).alias(f"n{s}"), F.bit_xor(side[s][1]).alias(f"a{s}"), F.bit_xor(side[s][2]).alias(f"b{s}"))]
        unlike = ~(F.col("n0").eqNullSafe(F.col("n1")) & F.col("a0").eqNullSafe(F.col("a1")) & F.col("b0").eqNullSafe(F.col("b1")))
        nodes = left.groupBy(start).agg(*both).where(unlike).select(start)
        left = _joined_on(left, nodes, start, "left_semi")
    return nodes


def flagged(rows: DataFrame) -> DataFrame:
    """``rows`` with ``skip``: in a leaf that is equal in both snapshots, as verified row by row."""
    marked = written(_joined_on(rows, differing(rows), "s1", "left").withColumn("skip", F.col("_found").isNull()).drop("_start", "_found"), "marked")
    balance = F.sum(F.when(F.col("side") == 0, 1).otherwise(-1))
    wrong = marked.where("skip").groupBy("s1", "key", "number", "content").agg(balance.alias("balance")).where("balance <> 0").select("s1").distinct()
    if wrong.isEmpty():
        return marked
    out = _joined_on(marked, wrong, "s1", "left")
    return out.withColumn("skip", F.col("skip") & F.col("_found").isNull()).drop("_start", "_found")


def diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row for each pair or unpaired row of two snapshots: key (the later one, else the earlier), old_key (the earlier),
    op (same, update, rekey, insert, delete), changed (names of a pair's differing columns) and row_sha256 (of the
    later row's columns, line by line)."""
    both = digests(old, key, columns, 0).unionByName(digests(new, key, columns, 1)).withColumn("level", _level(F.col("key")))
    both = written(both, "digests")
    rows = numbered(both, ["side", "key"], ["content"], LEVELS)
    marked = flagged(rows)
    discard(both)
    discard(rows)
    values = [f"c{i}" for i in range(len(columns))]
    scan = marked.where("not skip")
    a = scan.where("side = 0").select("key", "number", F.lit(True).alias("_old"), *(F.col(c).alias(f"o_{c}") for c in ("content", *values)))
    b = scan.where("side = 1").select(F.col("key").alias("_key"), F.col("number").alias("_number"), F.lit(True).alias("_new"), "line", *(F.col(c).alias(f"n_{c}") for c in ("content", *values)))
    merged = a.join(b, F.col("key").eqNullSafe(F.col("_key")) & (F.col("number") == F.col("_number")), "full")
    changed = F.concat_ws(",", *(F.when(~F.col(f"o_{v}").eqNullSafe(F.col(f"n_{v}")), F.lit(c)) for c, v in zip(columns, values, strict=True)))
    merged = written(merged.select(F.when(F.col("_new"), F.col("_key")).otherwise(F.col("key")).alias("key"), "_old", "_new", "o_content", "n_content", "line", changed.alias("changed")), "merged")
    nothing, no_key = F.lit(""), F.lit(None).cast(old.schema[key].dataType)
    line = F.lower(F.hex("line")).alias("row_sha256")
    same = marked.where("skip and side = 1").select("key", F.col("key").alias("old_key"), F.lit("same").alias("op"), nothing.alias("changed"), line)
    pairs = merged.where("_old and _new").select("key", F.col("key").alias("old_key"), F.when(F.col("changed") == "", "same").otherwise("update").alias("op"), "changed", line)
    # content pairs: the i-th smallest keys of a content on either side
    lone = merged.where("_old is null or _new is null")
    lone = lone.select(F.when(F.col("_old"), 0).otherwise(1).alias("side"), "key", F.coalesce("o_content", "n_content").alias("content"), "line")
    lone = numbered(lone, ["content", "side"], ["key"])
    gone = lone.where("side = 0").select("content", "number", F.col("key").alias("_from"), F.lit(True).alias("_old"))
    come = lone.where("side = 1").select("content", "number", F.col("key").alias("_to"), "line", F.lit(True).alias("_new"))
    met = gone.join(come, ["content", "number"], "full")
    op = F.when(F.col("_old") & F.col("_new"), "rekey").when(F.col("_new"), "insert").otherwise("delete")
    rest = met.select(
        F.when(F.col("_new"), F.col("_to")).otherwise(F.col("_from")).alias("key"),
        F.when(F.col("_old"), F.col("_from")).otherwise(no_key).alias("old_key"),
        op.alias("op"),
        nothing.alias("changed"),
        line,
    )
    return same.unionByName(pairs).unionByName(rest)
