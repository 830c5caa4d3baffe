"""The evidence graph of a task and the documents that search it.

Six kinds of nodes (task, field, evidence, quality_gate, quality_issue, memory) and five of edges: the task contains
every other node, evidence supports its field, an issue violates its gate and affects its fields, and memory is derived
from issues. Every edge is a projection or an explode of the table that it comes from; nothing is joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def node_id(kind: str, source: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), source.cast("string"))


def _nodes(df: DataFrame, kind: str, source: str, label: Column) -> DataFrame:
    return df.select(node_id(kind, F.col(source)).alias("node"), F.lit(kind).alias("kind"), F.col(source).cast("string").alias("source_id"), label.alias("label"))


def graph(task: str, fields: DataFrame, evidence: DataFrame, gates: DataFrame, issues: DataFrame, memory: str, reusable: bool) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of fields (field_name), evidence (evidence_id, field_name, row_index, column_index), gates (gate,
    kind) and issues (issue_id, gate, severity, field_names). Ids must be unique within their table; nulls are left out."""
    spark = fields.sparkSession
    own = spark.createDataFrame([(task, "task", "task run"), (memory, "memory", "task memory approved" if reusable else "task memory quarantined")], "id string, kind string, label string")
    nodes = own.select(F.concat("kind", F.lit(":"), "id").alias("node"), "kind", F.col("id").alias("source_id"), "label")
    parts = [
        _nodes(fields, "field", "field_name", F.concat(F.lit("field "), "field_name")),
        _nodes(evidence, "evidence", "evidence_id", F.format_string("evidence row %s column %s", F.col("row_index").cast("string"), F.col("column_index").cast("string"))),
        _nodes(gates, "quality_gate", "gate", F.concat(F.lit("quality gate "), "kind", F.lit(" "), "gate")),
        _nodes(issues, "quality_issue", "issue_id", F.concat(F.lit("quality issue "), "gate", F.lit(" "), "severity")),
    ]
    nodes = reduce(lambda a, b: a.unionByName(b), parts, nodes).where("source_id is not null")
    edge = lambda df, a, b, kind: df.select(a.alias("source"), b.alias("target"), F.lit(kind).alias("kind"))
    issue = node_id("quality_issue", F.col("issue_id"))
    edges = [
        edge(nodes.where("kind <> 'task'"), F.lit(f"task:{task}"), F.col("node"), "contains"),
        edge(evidence, node_id("evidence", F.col("evidence_id")), node_id("field", F.col("field_name")), "supports"),
        edge(issues, issue, node_id("quality_gate", F.col("gate")), "violates"),
        edge(issues.withColumn("_f", F.explode("field_names")), issue, node_id("field", F.col("_f")), "affects"),
        edge(issues, F.lit(f"memory:{memory}"), issue, "derived_from"),
    ]
    return nodes, reduce(lambda a, b: a.unionByName(b), edges).where("source is not null and target is not null")


def index_documents(evidence: DataFrame, gates: DataFrame, issues: DataFrame) -> DataFrame:
    """source_id, kind, location and text of what search finds: evidence by its field and cell, gates by their fields and
    verdict, issues by their gate. gates also: field_names, passed; evidence also: table_id."""
    place = F.format_string("table:%s:row:%s:column:%s", F.col("table_id").cast("string"), F.col("row_index").cast("string"), F.col("column_index").cast("string"))
    parts = [
        evidence.select(F.col("evidence_id").alias("source_id"), F.lit("evidence").alias("kind"), place.alias("location"), F.concat(F.lit("evidence table cell fields "), "field_name").alias("text")),
        gates.select(F.col("gate").alias("source_id"), F.lit("quality_gate").alias("kind"), F.concat(F.lit("gate:"), "gate").alias("location"), F.concat_ws(" ", F.lit("quality gate"), "kind", F.lit("fields"), F.array_join("field_names", " "), F.lit("passed"), F.col("passed").cast("string")).alias("text")),
        issues.select(F.col("issue_id").alias("source_id"), F.lit("quality_issue").alias("kind"), F.concat(F.lit("issue:"), "issue_id").alias("location"), F.concat_ws(" ", F.lit("quality issue"), "gate", "severity", F.array_join("field_names", " ")).alias("text")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
