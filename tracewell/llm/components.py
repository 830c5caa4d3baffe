"""Connected components by the smallest label, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.storage import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for the ids of edges (a, b): the smallest id that can be reached.

    In each round an id takes the smallest label among its neighbours' and its own, then its label's label. Each
    round is written to the shared folder, so its plan stays short and lost executors cost one round at most. A label
    is pre-aggregated on the map side, so an id with very many edges is no hot key; the joins on such an id are
    ordinary joins, which adaptive execution splits.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.distinct(), "edges")
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("id"), "label")
    labels = written(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("_near"))
        step = labels.join(near, "id").select("id", F.col("label").alias("_old"), F.least("label", "_near").alias("label"))
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("_jump"))
        before, step = labels, written(step.join(jump, "label").select("id", "_old", F.least("label", "_jump").alias("label")), "labels")
        labels = step.select("id", "label")
        discard(before)  # nothing reads a round before the last
        if step.where("label <> _old").isEmpty():
            discard(both)
            return labels.select("id", F.col("label").alias("component"))
