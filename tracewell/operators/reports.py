"""Reports over finished stages: duplicates, status, metrics, gaps of the review loop, the read model, and audits.

An audit gives the rows that are wrong, so an empty table is a passed one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the review loop wants of each task: artifacts, useful ones, and domains they come from; and rounds at most.
WANTED, ROUNDS = {"artifacts": 3, "useful": 1, "domains": 2}, 4


def duplicate_groups(fields: DataFrame, cluster: str, record: str) -> DataFrame:
    """cluster, fingerprint, copies and first record of the records of a cluster that agree in all eligible fields.

    fields: cluster, record, field_name, value, eligible. A record's fingerprint is over its sorted (field, value hash)
    pairs; records without an eligible field have none."""
    own = fields.where("eligible").groupBy(cluster, record).agg(F.array_sort(F.collect_set(F.struct("field_name", F.sha2(F.coalesce("value", F.lit("")), 256).alias("h")))).alias("_f"))
    prints = own.select(cluster, record, F.sha2(F.to_json("_f"), 256).alias("fingerprint"))
    return prints.groupBy(cluster, "fingerprint").agg(F.count(F.lit(1)).alias("copies"), F.min(record).alias("first_record")).where("copies > 1")


def equal_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """fingerprint, copies and first_id of texts that several rows have; nulls are no texts."""
    rows = df.where(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("fingerprint"), F.col(key).alias("_k"))
    return rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"), F.min("_k").alias("first_id")).where("copies > 1")


def fields_by_row(fields: DataFrame, row: list[str], order: str) -> DataFrame:
    """One row for each row of a source: its fields in order, how many there are and how many are eligible. fields: row
    keys, order, field_name, value, eligible; a row's fields are as many as its columns."""
    entry = F.struct(F.col(order).alias("position"), "field_name", "value", "eligible")
    return fields.groupBy(*row).agg(F.array_sort(F.collect_list(entry)).alias("fields"), F.count(F.lit(1)).alias("n_fields"), F.count_if("eligible").alias("n_eligible"))


def cell_evidence(cells: DataFrame, atoms: DataFrame, key: str = "cell_id") -> DataFrame:
    """Cells with the evidence taken from them; cells that gave none are left out."""
    return cells.join(atoms, key)


def status_ladder(decisions: DataFrame, decision: str = "decision", by: list[str] | None = None, upstream: bool = True) -> DataFrame:
    """Counts of a fusion's decisions, in all or for each group, and the status they leave: unsupported without any,
    needs_review where no value was selected, partial where some are withheld or in conflict or the stage before did not
    succeed, else succeeded."""
    is_ = lambda *d: F.count_if(F.col(decision).isin(*d))
    sums = decisions.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("fields"),
        is_("single_eligible", "exact_consensus").alias("selected"),
        is_("unresolved_conflict").alias("conflicts"),
        is_("withheld_review").alias("withheld"),
    )
    rest = (F.col("withheld") > 0) | (F.col("conflicts") > 0) | F.lit(not upstream)
    status = F.when(F.col("fields") == 0, "unsupported").when(F.col("selected") == 0, "needs_review").when(rest, "partial").otherwise("succeeded")
    return sums.withColumn("status", status)


def attempt_metrics(attempts: DataFrame, group: str, succeeded: Column, size: Column) -> DataFrame:
    """Attempts, successes and bytes of each group."""
    amount = F.sum(F.when(succeeded, size.cast("decimal(18,2)")).otherwise(F.lit(0).cast("decimal(18,2)")))
    return attempts.groupBy(group).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(succeeded).alias("succeeded"), amount.cast("double").alias("bytes"))


def review_gaps(artifacts: DataFrame, group: str, useful: Column, domain: Column, round_: Column | None = None, wanted: dict[str, int] = WANTED) -> DataFrame:
    """What each group's search still lacks: artifacts, useful ones and domains short of what is wanted; done when
    nothing is short, or when the rounds are used up."""
    sums = artifacts.groupBy(group).agg(F.count(F.lit(1)).alias("artifacts"), F.count_if(useful).alias("useful"), F.count_distinct(domain).alias("domains"), F.max(round_ if round_ is not None else F.lit(1)).alias("rounds"))
    short = {c: F.greatest(F.lit(n) - F.col(c), F.lit(0)) for c, n in wanted.items()}
    out = sums.select("*", *[s.alias(f"{c}_gap") for c, s in short.items()])
    met = F.lit(True)
    for c in wanted:
        met = met & (F.col(f"{c}_gap") == 0)
    return out.withColumn("done", met | (F.col("rounds") >= ROUNDS))


def latest(rows: DataFrame, at: str, key: str, n: int) -> DataFrame:
    """The n newest rows, of equal times by key: a bounded heap for each task."""
    return rows.orderBy(F.desc(at), key).limit(n)


def read_model(stages: dict[str, DataFrame], key: str) -> DataFrame:
    """One row for each task with the counts and status of every stage: stages have key, items and status. Tasks that a
    stage lacks have null there. Each stage is small by then, one row a task."""
    out = None
    for name, df in stages.items():
        own = df.groupBy(key).agg(F.sum("items").alias(f"{name}_items"), F.max("status").alias(f"{name}_status"))
        out = own if out is None else out.join(own, key, "full_outer")
    return out


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Audit: rows whose key no parent has."""
    return children.join(parents.select(key).distinct(), key, "left_anti")


def wrong_hashes(df: DataFrame, text: str, digest: str) -> DataFrame:
    """Audit: rows whose SHA-256 is not that of their text; a null text has no digest."""
    return df.where(~F.sha2(F.col(text), 256).eqNullSafe(F.col(digest)))


def wrong_counts(report: DataFrame, rows: DataFrame, key: str, count: str) -> DataFrame:
    """Audit: keys whose reported count is not that of their rows, on either side."""
    own = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    both = report.select(key, F.col(count).alias("_told")).join(own, key, "full_outer")
    return both.where(~F.coalesce("_told", F.lit(0)).eqNullSafe(F.coalesce("_n", F.lit(0)))).select(key, F.col("_told").alias("reported"), F.col("_n").alias("found"))
