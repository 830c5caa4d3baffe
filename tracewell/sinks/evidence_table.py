"""The long evidence table: every accepted cell once, with where it came from and what its column was mapped to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.values import stable_id

#: The table's columns in order.
COLUMNS = (
    "dataset_id",
    "source_url",
    "artifact_sha256",
    "source_row",
    "source_column_index",
    "source_column_json",
    "target_field_json",
    "mapping_status",
    "mapping_method",
    "raw_value_json",
    "evidence_id",
    "source_location_json",
)


class EvidenceError(ValueError):
    """The mapping and the files do not belong together, or the table is larger than allowed."""


def json_text(text: Column) -> Column:
    """A text as a JSON string, null as null."""
    quoted = F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.when(text.isNull(), "null").otherwise(quoted)


def mapping_problems(columns: DataFrame, artifacts: DataFrame, decisions: DataFrame) -> DataFrame:
    """artifact_sha256, column_index and problem: artifact_unknown, decided_twice, column_undecided, header_differs and
    column_missing (decided but not there), for the artifacts that have a decision.

    columns: artifact_sha256, column_index, header. decisions: artifact_sha256, column_index, source_column, ..."""
    key = ["artifact_sha256", "column_index"]
    unknown = decisions.join(artifacts, "artifact_sha256", "left_anti").select(*key, F.lit("artifact_unknown").alias("problem"))
    twice = decisions.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key, F.lit("decided_twice").alias("problem"))
    of = columns.join(decisions.select("artifact_sha256").distinct(), "artifact_sha256", "left_semi")
    both = of.withColumn("_there", F.lit(True)).join(decisions.select(*key, "source_column", F.lit(True).alias("_told")).dropDuplicates(key), key, "full")
    problem = F.when(F.col("_told").isNull(), "column_undecided").when(F.col("_there").isNull(), "column_missing").when(~F.col("header").eqNullSafe(F.col("source_column")), "header_differs")
    return unknown.unionByName(twice).unionByName(both.select(*key, problem.alias("problem")).where("problem is not null"))


def evidence_table(cells: DataFrame, columns: DataFrame, artifacts: DataFrame, decisions: DataFrame) -> DataFrame:
    """The twelve columns, one row for each cell of each decided column; EvidenceError unless every decision belongs to
    exactly one column of a known artifact and every column of a decided artifact has its decision.

    cells: artifact_sha256, dataset_id, row_index and column_index (from 1), raw_json, location. artifacts:
    artifact_sha256, source_url. decisions: artifact_sha256, column_index, source_column, target_field, status, method.
    Values are not touched; a null raw value is JSON's null."""
    wrong = mapping_problems(columns, artifacts.select("artifact_sha256"), decisions).orderBy("problem", "artifact_sha256", "column_index").limit(5).collect()
    if wrong:
        raise EvidenceError("; ".join(f"{r.artifact_sha256} column {r.column_index}: {r.problem}" for r in wrong))
    key = ["artifact_sha256", "column_index"]
    joined = cells.join(decisions, key).join(artifacts.dropDuplicates(["artifact_sha256"]), "artifact_sha256")
    return joined.select(
        "dataset_id",
        "source_url",
        "artifact_sha256",
        F.col("row_index").alias("source_row"),
        F.col("column_index").alias("source_column_index"),
        json_text(F.col("source_column")).alias("source_column_json"),
        json_text(F.col("target_field")).alias("target_field_json"),
        F.col("status").alias("mapping_status"),
        F.col("method").alias("mapping_method"),
        F.coalesce("raw_json", F.lit("null")).alias("raw_value_json"),
        stable_id("evd_", F.col("artifact_sha256"), F.col("row_index"), F.col("column_index"), digits=32).alias("evidence_id"),
        json_text(F.col("location")).alias("source_location_json"),
    )


def write_evidence(table: DataFrame, path: str, most: int = 64 << 20) -> int:
    """Writes the table as CSV with a byte-order mark before each file's header and returns about how many bytes it has;
    EvidenceError above ``most``, before anything is written."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in COLUMNS), F.lit(len(COLUMNS)))
    total = table.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    if total > most:
        raise EvidenceError(f"the table has {total} bytes, more than {most}")
    marked = table.select(F.col(COLUMNS[0]).alias("﻿" + COLUMNS[0]), *COLUMNS[1:])
    marked.write.option("header", True).option("escape", '"').csv(path)
    return int(total)


def read_evidence(spark, path: str) -> DataFrame:
    """The table that ``write_evidence`` wrote, all values as text."""
    schema = ", ".join(f"{c} string" for c in COLUMNS)
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("enforceSchema", True).csv(path)
