"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in SQL expressions alone.

A key's shard depends on the key and the number of shards only. There is no ring table: each key replays its own
sequence of jumps, and going from n to n + 1 shards moves a row only if its next jump lands on the new shard.

Nulls and ties: a null key counts as -1. A null text has 0 bytes and the CRC of no bytes. Rows that are equal in every
column get neighbouring slots in either order. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: The multiplier of the published generator, as 32-bit halves and the low half's 16-bit parts.
MULTIPLIER = 2862933555777941757
_M_HIGH, _M_LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
_M_LOW_1, _M_LOW_0 = _M_LOW >> 16, _M_LOW & 0xFFFF
_32 = 0xFFFFFFFF

#: Rows of one (shard, chunk) group on average: what one task sorts to number the slots.
ROWS_PER_CHUNK = 50_000


def _next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 modulo 2**64 on 32-bit halves; no step overflows a long, so ANSI mode is no matter."""
    t0 = low * F.lit(_M_LOW_0) + F.lit(1)
    t1 = low * F.lit(_M_LOW_1)
    low_sum = t0 + F.shiftleft(t1.bitwiseAND(F.lit(0xFFFF)), 16)
    cross = (
        F.shiftright(low_sum, 32)
        + F.shiftright(t1, 16)
        + high * F.lit(_M_LOW_0)
        + F.shiftleft((high * F.lit(_M_LOW_1)).bitwiseAND(F.lit(0xFFFF)), 16)
        + (low * F.lit(_M_HIGH & 0xFFFF)).bitwiseAND(F.lit(_32))
        + F.shiftleft((low * F.lit(_M_HIGH >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)
    )
    return cross.bitwiseAND(F.lit(_32)), low_sum.bitwiseAND(F.lit(_32))


def key64(df: DataFrame, key: str) -> Column:
    """Integers are their own key; anything else is hashed to 64 bits."""
    column = df[key]
    if isinstance(df.schema[key].dataType, IntegralType):
        return F.coalesce(column.cast("long"), F.lit(-1))
    return F.coalesce(F.when(column.isNotNull(), F.xxhash64(column)), F.lit(-1))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard of a 64-bit key, 0 to ``shards`` - 1.

    Jumps strictly grow, so ``shards`` rounds always suffice; rounds after the last jump only hand the state on.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"),
        key.bitwiseAND(F.lit(_32)).alias("low"),
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )

    def jump(state: Column, _: Column) -> Column:
        high, low = _next_state(state["high"], state["low"])
        # (state >> 33) + 1 needs the top 31 bits only, which are the high half without its last bit
        reach = (state["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double"))
        moved = F.struct(high.alias("high"), low.alias("low"), state["j"].alias("b"), F.floor(reach).cast("long").alias("j"))
        return F.when(state["j"] >= F.lit(shards), state).otherwise(moved)

    rounds = F.sequence(F.lit(1), F.lit(shards))
    return F.aggregate(rounds, start, jump, lambda s: s["b"].cast("int"))


def assign(df: DataFrame, key: str, text: str, shards: int, grow_to: int | None = None) -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard of every row.

    Slots count from 0 without gaps in each shard. They are numbered in (shard, chunk) groups, chunk being a further
    hash of the key and the number of chunks growing with the table, so that no task sorts a whole shard; the
    chunks' first slots are a running sum over the small table of group sizes.
    """
    grow_to = grow_to or shards + 1
    chunks = max(1, -(-df.count() // (shards * ROWS_PER_CHUNK)))
    k = key64(df, key)
    rows = df.select(
        df[key].alias(key),
        (F.coalesce(F.octet_length(df[text]), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(df[text], F.lit(""))).alias("text_crc32"),
        jump_hash(k, shards).alias("shard"),
        jump_hash(k, grow_to).alias("grown_shard"),
        F.pmod(F.xxhash64(k, F.lit(1)), F.lit(chunks)).alias("_chunk"),
    )
    order = Window.partitionBy("shard", "_chunk").orderBy(F.col(key).asc_nulls_first(), "text_crc32", "size")
    numbered = rows.withColumn("_n", F.row_number().over(order) - 1)
    sizes = rows.groupBy("shard", "_chunk").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_chunk", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return numbered.join(starts, ["shard", "_chunk"]).select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_n")).cast("long").alias("slot"), "grown_shard"
    )


def write_shards(df: DataFrame, key: str, text: str, shards: int, path: str) -> None:
    """The rows themselves as one folder per shard; rows of a shard stay spread over tasks."""
    placed = df.withColumn("shard", jump_hash(key64(df, key), shards))
    placed.write.partitionBy("shard").parquet(path)
