"""The declared contract: fields, keys and quality gates, and how two versions differ."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("string", "integer", "number", "boolean", "datetime")


@dataclass(frozen=True)
class Field:
    name: str
    data_type: str = "string"
    required: bool = False
    aliases: tuple[str, ...] = ()
    unit: str | None = None
    derived: bool = False


@dataclass(frozen=True)
class Gate:
    """kind: required_fields, any_of_fields or field_provenance."""

    name: str
    kind: str
    fields: tuple[str, ...]
    threshold: float = 1.0
    blocking: bool = True


@dataclass(frozen=True)
class Contract:
    fields: tuple[Field, ...]
    entity_keys: tuple[str, ...]
    gates: tuple[Gate, ...] = field(default=())

    def __post_init__(self):
        names = [f.name for f in self.fields]
        required = {f.name for f in self.fields if f.required}
        if len(set(names)) != len(names):
            raise ValueError("field names must be unique")
        if any(f.data_type not in TYPES for f in self.fields):
            raise ValueError("unknown data type")
        if not set(self.entity_keys) <= required:
            raise ValueError("entity keys must be required fields")
        if any(not set(g.fields) <= set(names) for g in self.gates):
            raise ValueError("gates may name declared fields only")

    def field_table(self, spark: SparkSession) -> DataFrame:
        rows = [(f.name, f.data_type, f.required, f.name in self.entity_keys, list(f.aliases), f.unit) for f in self.fields if not f.derived]
        return spark.createDataFrame(rows, "field_name string, data_type string, required boolean, entity_key boolean, aliases array<string>, unit string")

    def gate_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(g.name, g.kind, list(g.fields), g.threshold, g.blocking) for g in self.gates], "gate string, kind string, fields array<string>, threshold double, blocking boolean")


#: What a pack may say about a field beyond its name, and what is assumed where a table lacks the column.
PACK_COLUMNS = {"data_type": "string", "dimension": "string", "semantic": "string", "derivation": "string", "valid_range": "string", "unit": "string", "required": "boolean", "nullable": "boolean", "aliases": "array<string>", "threshold": "double"}
#: In this order the first that differs is why two definitions conflict.
MUST_AGREE = ("data_type", "dimension", "semantic", "derivation", "valid_range")


def merge_fields(packs: DataFrame) -> DataFrame:
    """Fields of several packs as one, in the order of the packs: strongest requirement, nullable only if all say so,
    aliases in order and once whatever their case, first unit, highest threshold. A definition that disagrees with what
    stands so far is left out and listed in ``conflicts`` with its pack and reason. packs: pack, field_name and any of
    PACK_COLUMNS. A null alias is left out.

    What stands is known without going through the definitions in order: only those that agree with the first one can be
    taken, and the first unit among these is the unit, so aggregates with map-side combine do."""
    absent = [F.lit(None).cast(kind).alias(c) for c, kind in PACK_COLUMNS.items() if c not in packs.columns]
    rows = packs.select("pack", "field_name", *[F.col(c).cast(kind) for c, kind in PACK_COLUMNS.items() if c in packs.columns], *absent)
    # ordered by pack alone: a pack defines a field once
    rows = rows.withColumn("_at", F.struct(F.col("pack").alias("p"), F.xxhash64(*PACK_COLUMNS).alias("h")))
    named = lambda df: df.withColumnRenamed("field_name", "_name")
    joined = lambda df, other, how="inner": df.join(named(other), F.col("field_name").eqNullSafe(F.col("_name")), how).drop("_name")
    first = rows.groupBy("field_name").agg(F.min_by(F.struct(*MUST_AGREE, F.col("aliases").isNotNull().alias("_listed")), "_at").alias("_f"))
    differs = F.coalesce(*[F.when(~F.col(f"_f.{c}").eqNullSafe(F.col(c)), c) for c in MUST_AGREE])
    agreeing = joined(rows, first).withColumn("_reason", differs)
    units = agreeing.where("_reason is null and unit is not null").groupBy("field_name").agg(F.min_by("unit", "_at").alias("_unit"))
    told = joined(agreeing, units, "left").withColumn("_reason", F.coalesce("_reason", F.when(F.col("unit") != F.col("_unit"), "unit")))
    taken = told.where("_reason is null")
    each = taken.select("field_name", "_at", F.posexplode("aliases").alias("_pos", "_alias")).where("_alias is not null")
    own = each.groupBy("field_name", F.lower("_alias").alias("_low"), "_at").agg(F.collect_set(F.struct("_pos", "_alias")).alias("_own"))
    fresh = own.groupBy("field_name", "_low").agg(F.min(F.struct("_at", "_own")).alias("_m"))
    placed = fresh.select("field_name", F.explode("_m._own").alias("_o"), F.col("_m._at").alias("_at")).select("field_name", F.struct("_at", "_o").alias("_o"))
    aliases = placed.groupBy("field_name").agg(F.transform(F.array_sort(F.collect_list("_o")), lambda o: o["_o"]["_alias"]).alias("_aliases"))
    refused = told.where("_reason is not null").select("field_name", F.struct("_at", F.col("pack").cast("string").alias("pack"), F.col("_reason").alias("reason")).alias("_c"))
    conflicts = refused.groupBy("field_name").agg(F.transform(F.array_sort(F.collect_list("_c")), lambda c: F.struct(c["pack"].alias("pack"), c["reason"].alias("reason"))).alias("conflicts"))
    sums = taken.groupBy("field_name").agg(F.max("required").alias("required"), F.min("nullable").alias("nullable"), F.max("threshold").alias("threshold"), F.max(F.col("_unit")).alias("unit"), F.count(F.lit(1)).alias("_taken"))
    merged = joined(joined(joined(first, sums), aliases, "left"), conflicts, "left")
    # a field that one definition alone makes keeps its lack of aliases; a merged one has a list
    none = F.when(F.col("_f._listed") | (F.col("_taken") > 1), F.array().cast("array<string>"))
    values = {c: F.col(f"_f.{c}") for c in MUST_AGREE} | {"aliases": F.coalesce("_aliases", none)}
    listed = F.coalesce("conflicts", F.array().cast("array<struct<pack:string,reason:string>>"))
    return merged.select("field_name", *[values.get(c, F.col(c)).alias(c) for c in PACK_COLUMNS], listed.alias("conflicts"), (F.size(listed) > 0).alias("conflict"))


def difference(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """added, removed and changed keys: a full outer join on the key."""
    a = old.select(F.col(key).alias("_a"), F.col(value).alias("_old"))
    b = new.select(F.col(key).alias("_b"), F.col(value).alias("_new"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(key), change.alias("change")).where("change is not null")


class Stale(ValueError):
    """The contract changed since it was read."""


def confirm(contract: Contract, read_hash: str) -> str:
    """The hash of a contract that is confirmed, if it still is what its reader saw."""
    now = contract_hash(contract)
    if now != read_hash:
        raise Stale(f"read {read_hash}, now {now}")
    return now


def contract_hash(contract: Contract) -> str:
    import hashlib
    import json
    from dataclasses import asdict

    return hashlib.sha256(json.dumps(asdict(contract), sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()
