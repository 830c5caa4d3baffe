"""Sinks: Gold as CSV and Parquet, provenance, dictionary, manifest, content-addressed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def gold_order(df: DataFrame, column: str, key: str) -> DataFrame:
    """By the number that a text column holds; what is no number comes first."""
    return df.orderBy(F.col(column).try_cast("decimal(38,9)").asc_nulls_first(), key)


def export_gold(df: DataFrame, path: str) -> None:
    """Writes all-text CSV and Parquet and fails unless both read back equal to the table."""
    text = df.select([F.col(c).cast("string").alias(c) for c in df.columns])
    text.write.parquet(f"{path}/gold.parquet")
    text.write.option("header", True).option("emptyValue", '""').option("nullValue", "\\N").option("escape", '"').csv(f"{path}/gold.csv")
    a, b = read_gold(df.sparkSession, path, "parquet", df.columns), read_gold(df.sparkSession, path, "csv", df.columns)
    if not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()):
        raise ValueError("CSV and Parquet differ")


def read_gold(spark: SparkSession, path: str, kind: str, columns: list[str]) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in columns)
    if kind == "parquet":
        return spark.read.schema(schema).parquet(f"{path}/gold.parquet")
    return spark.read.schema(schema).option("header", True).option("emptyValue", "").option("nullValue", "\\N").option("escape", '"').option("multiLine", True).csv(f"{path}/gold.csv")


def evidence_long(cells: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row for each cell and mapping decision of its column, with JSON-encoded values and location."""
    joined = cells.join(F.broadcast(decisions), ["dataset_id", "column_index"])
    location = F.to_json(F.struct(F.col("column_index").alias("column"), F.col("row_index").alias("row")))
    return joined.select("dataset_id", (F.col("row_index") + 2).alias("source_row"), "column_index", F.to_json(F.struct("header")).alias("source_column_json"), "target_field", "method", "value_json", location.alias("source_location_json"))


def provenance(gold: DataFrame, path: str) -> None:
    """JSON lines, keys in alphabetical order."""
    gold.select(*sorted(gold.columns)).write.json(path)


def insert_or_ignore(spark: SparkSession, rows: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key the table lacks, each key once, and returns how many there were."""
    fresh, before = rows.dropDuplicates([key]), 0
    if _exists(spark, path):
        have = spark.read.parquet(path)
        before = have.count()
        fresh = fresh.join(have.select(key), key, "left_anti")
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def summary(df: DataFrame, size: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and SHA-256 of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy("name")
