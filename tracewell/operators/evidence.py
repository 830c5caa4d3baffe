"""From cells to audited Gold: extraction, mapping, normalization, entity resolution, fusion, quality gates.

Every stage is a DataFrame in and DataFrames out. Rows carry the ids of the cells they come from. Contract, gates and
rules are small tables made from a driver object and are broadcast; everything that grows with the data is joined or
grouped by a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import field_name
from tracewell.functions.values import decimal_places, fits_type, kind, shift_decimal, significant_digits, stable_id
from tracewell.operators.contract import Contract


def extract(cells: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """(candidates, gaps) from cells (table_id, row_index, column_index, header, decoded).

    A header is bound by exact equality. A row without one of the entity keys gives nothing but a gap. An empty cell is
    no evidence, and a gap if its field is required.
    """
    fields = F.broadcast(contract.field_table(cells.sparkSession))
    bound = cells.join(fields, cells.header == fields.field_name).select("table_id", "row_index", "column_index", "field_name", "required", "entity_key", F.coalesce("decoded", F.lit("")).alias("raw_value"))
    keys = bound.where("entity_key and raw_value <> ''").groupBy("table_id", "row_index").agg(F.count_distinct("field_name").alias("keys"))
    complete = keys.where(F.col("keys") == len(contract.entity_keys)).select("table_id", "row_index")
    whole = bound.join(complete, ["table_id", "row_index"], "left_semi")
    evidence = stable_id("ev_", F.col("table_id"), F.col("row_index"), F.col("column_index"))
    candidates = whole.where("raw_value <> ''").select("table_id", "row_index", "field_name", "raw_value", kind(F.col("raw_value")).alias("kind"), evidence.alias("evidence_id"))
    rows = cells.select("table_id", "row_index").distinct()
    no_key = rows.join(complete, ["table_id", "row_index"], "left_anti").select("table_id", "row_index", F.lit(None).cast("string").alias("field_name"), F.lit("entity_key_missing").alias("reason"))
    empty = whole.where("required and raw_value = ''").select("table_id", "row_index", "field_name", F.lit("required_value_empty").alias("reason"))
    headers = cells.select("table_id", "header").distinct()
    wanted = contract.field_table(cells.sparkSession).where("required").select("field_name")
    tables = headers.select("table_id").distinct()
    absent = tables.crossJoin(F.broadcast(wanted)).join(headers.withColumnRenamed("header", "field_name"), ["table_id", "field_name"], "left_anti")
    absent = absent.select("table_id", F.lit(None).cast("long").alias("row_index"), "field_name", F.lit("required_header_absent").alias("reason"))
    unknown = headers.join(fields, headers.header == fields.field_name, "left_anti").select("table_id", F.lit(None).cast("long").alias("row_index"), F.col("header").alias("field_name"), F.lit("header_not_in_contract").alias("reason"))
    return candidates, no_key.unionByName(empty).unionByName(absent).unionByName(unknown)


def alias_suggestions(gaps: DataFrame, contract: Contract) -> DataFrame:
    """Unmapped headers with the fields that list them as an alias: suggestions, never mappings."""
    fields = contract.field_table(gaps.sparkSession).select("field_name", F.explode("aliases").alias("alias"))
    own = gaps.where("reason = 'header_not_in_contract'").select("table_id", F.col("field_name").alias("header"))
    return own.join(F.broadcast(fields), F.lower("header") == F.lower("alias")).select("table_id", "header", F.col("field_name").alias("suggested_field"))


def map_fields(candidates: DataFrame, contract: Contract, score: Column | None = None, threshold: float = 0.9) -> DataFrame:
    """Candidates with data_type, score and decision: exact headers score 1."""
    fields = F.broadcast(contract.field_table(candidates.sparkSession).select("field_name", "data_type"))
    joined = candidates.join(fields, "field_name").withColumn("score", score if score is not None else F.lit(1.0))
    decision = F.when(~fits_type(F.col("kind"), F.col("data_type")), "blocked_type_conflict").when(F.col("score") < threshold, "blocked_below_threshold").otherwise("auto_accepted")
    return joined.withColumn("decision", decision)


def normalize(mapped: DataFrame, context: DataFrame, units: dict[str, str], scales: dict[str, str] | None = None) -> DataFrame:
    """Mapped fields with unit, places, digits, value, issues and status.

    Unit and time scale of a field come from its row's context alone: context has table_id, row_index, field_name, unit
    and, if times are normalized, time_scale. units: the unit that each measured field must end in; scales: the time
    scale that each time must have. A missing unit or scale is an issue. ``value`` is the text as it stands, but for
    Julian dates in a field that must end in MJD, which are shifted exactly.
    """
    scales = scales or {}
    if "time_scale" not in context.columns:
        context = context.withColumn("time_scale", F.lit(None).cast("string"))
    joined = mapped.join(context, ["table_id", "row_index", "field_name"], "left")
    timed = F.col("field_name").isin(list(scales))
    wanted = F.create_map(*[F.lit(x) for pair in scales.items() for x in pair]) if scales else F.create_map(F.lit(""), F.lit(""))
    numeric = F.col("data_type").isin("integer", "number")
    measured = F.col("field_name").isin(list(units))
    target = F.create_map(*[F.lit(x) for pair in units.items() for x in pair]) if units else F.create_map(F.lit(""), F.lit(""))
    issues = F.array_compact(
        F.array(
            F.when(F.col("decision") != "auto_accepted", "mapping_not_eligible"),
            F.when(numeric & decimal_places(F.col("raw_value")).isNull(), "invalid_decimal"),
            F.when(measured & F.col("unit").isNull(), "source_unit_missing"),
            F.when(timed & ~F.coalesce(F.col("time_scale") == F.try_element_at(wanted, F.col("field_name")), F.lit(False)), "time_scale_missing"),
        )
    )
    status = F.when(F.col("decision") != "auto_accepted", "blocked").when(F.size("issues") > 0, "needs_review").otherwise("normalized")
    out = joined.withColumn("target_unit", F.try_element_at(target, F.col("field_name"))).withColumn("issues", issues)
    return out.withColumn("decimal_places", F.when(numeric, decimal_places(F.col("raw_value")))).withColumn("significant_digits", F.when(numeric, significant_digits(F.col("raw_value")))).withColumn("status", status).withColumn("value", F.when((F.col("unit") == "JD") & (F.col("target_unit") == "MJD"), shift_decimal(F.col("raw_value"), "2400000.5")).otherwise(F.col("raw_value")))


def resolve(fields: DataFrame, keys: list[str], record: str = "record_id") -> DataFrame:
    """record, fingerprint and decision: records with equal normalized keys are one entity. A record that lacks an
    eligible key is unresolved. fields: record, field_name, value, eligible. No pair is ever compared."""
    own = fields.where(F.col("field_name").isin(keys))
    picked = own.groupBy(record).agg(*[F.min(F.when((F.col("field_name") == k) & F.col("eligible"), F.col("value"))).alias(f"_{i}") for i, k in enumerate(keys)])
    whole = F.lit(True)
    for i in range(len(keys)):
        whole = whole & F.col(f"_{i}").isNotNull()
    print_ = F.when(whole, F.sha2(F.concat_ws("\u0001", *[F.col(f"_{i}") for i in range(len(keys))]), 256))
    return fields.select(record).distinct().join(picked.select(record, print_.alias("fingerprint")), record, "left")


def clusters(prints: DataFrame, record: str = "record_id") -> DataFrame:
    """fingerprint, members (count), first member, decision and the pairs that blocking left to compare."""
    grouped = prints.where("fingerprint is not null").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("members"), F.min(record).alias("first_member"))
    n = F.col("members")
    return grouped.select("*", F.when(n == 1, "singleton").otherwise("auto_merged").alias("decision"), (n * (n - 1) / 2).cast("long").alias("pairs"))


def pair_metrics(groups: DataFrame) -> DataFrame:
    """Pairs within clusters, pairs in all, and the share that blocking saved."""
    sums = groups.agg(F.sum("members").alias("records"), F.sum("pairs").alias("candidate_pairs"))
    total = (F.col("records") * (F.col("records") - 1) / 2).cast("long")
    return sums.select("records", "candidate_pairs", total.alias("all_pairs"), F.when(total > 0, 1 - F.col("candidate_pairs") / total).otherwise(0.0).alias("reduction"))


def fuse(candidates: DataFrame, cluster: list[str]) -> DataFrame:
    """One decision for each (cluster, field) over all candidates (candidate_id, value, eligible, evidence_id).

    single_eligible: one candidate, eligible. exact_consensus: all eligible and equal; the smallest id wins.
    unresolved_conflict: several different values; no value. withheld_review: the rest. All evidence is kept. A null value
    is a value of its own, and a candidate whose eligibility is null is not eligible.
    """
    # a short value stands for itself, a longer one for its 32 bytes of digest, a null for none: in one set, so that the rows
    # are shuffled once and not once more for the distinct ones
    value = F.col("value").cast("string")
    print_ = F.when(F.octet_length(value) < 32, F.concat(F.lit(b"+"), F.encode(value, "UTF-8"))).otherwise(F.coalesce(F.unhex(F.sha2(value, 256)), F.lit(b"")))
    grouped = candidates.groupBy(*cluster, "field_name").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.size(F.collect_set(print_)).cast("long").alias("distinct_values"),
        F.min(F.coalesce("eligible", F.lit(False))).alias("_all"),
        F.min_by("value", "candidate_id").alias("_first"),
        F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"),
    )
    decision = (
        F.when((F.col("candidates") > 1) & (F.col("distinct_values") > 1), "unresolved_conflict")
        .when(~F.col("_all"), "withheld_review")
        .when(F.col("candidates") == 1, "single_eligible")
        .otherwise("exact_consensus")
    )
    value = F.when(F.col("decision").isin("single_eligible", "exact_consensus"), F.col("_first"))
    return grouped.withColumn("decision", decision).select(*cluster, "field_name", "candidates", "distinct_values", "decision", value.alias("value"), "evidence_ids")


def gold_records(decisions: DataFrame, cluster: list[str]) -> DataFrame:
    """One row for each cluster: values (field to text) and evidence of its selected fields, the names of the fields
    that are withheld and of those among them that are in conflict, in order, and whether any field was selected. A field
    that no candidate names is in no list."""
    taken = F.col("decision").isin("single_eligible", "exact_consensus")
    entry = F.when(taken, F.struct("field_name", "value", "evidence_ids"))
    names = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("field_name"))))
    grouped = decisions.groupBy(*cluster).agg(F.array_sort(F.collect_list(entry)).alias("_f"), names(~taken).alias("withheld"), names(F.col("decision") == "unresolved_conflict").alias("in_conflict"))
    pairs = lambda of: F.map_from_entries(F.transform("_f", lambda f: F.struct(f["field_name"], f[of])))
    return grouped.select(*cluster, pairs("value").alias("values"), pairs("evidence_ids").alias("evidence"), "withheld", "in_conflict", (F.size("_f") > 0).alias("selected"))


def conflicts(df: DataFrame, entity: str, attributes: list[str], evidence: str | None = None) -> DataFrame:
    """entity, attribute, distinct values and rows (of the column ``evidence``: how many different ones) of attributes on
    which an entity's rows disagree; a conflict has two pieces of evidence at least."""
    each = F.array(*[F.struct(F.lit(a).alias("attribute"), df[a].cast("string").alias("value")) for a in attributes])
    source = df[evidence] if evidence else F.lit(1)
    long = df.select(df[entity].alias(entity), source.alias("_e"), F.explode(each).alias("a")).select(entity, "_e", "a.*").where("value is not null")
    amount = F.count_distinct("_e") if evidence else F.count(F.lit(1))
    return long.groupBy(entity, "attribute").agg(F.count_distinct("value").alias("distinct_values"), amount.alias("rows")).where("distinct_values > 1 and rows >= 2")


def gate_results(records: DataFrame, record: str, contract: Contract, provenance: str | None = None) -> DataFrame:
    """One row for each record and gate: did it pass? records: wide, one column for each field; provenance: a column
    with the names of fields that have evidence. Gates are expressions on the row, so nothing is joined."""

    def passed(gate) -> Column:
        present = [F.coalesce(records[f].cast("string") != "", F.lit(False)) for f in gate.fields]
        if gate.kind == "required_fields":
            return F.array_min(F.array(*present))
        if gate.kind == "any_of_fields":
            return F.array_max(F.array(*present))
        if gate.kind == "field_provenance":
            return F.size(F.array_except(F.array(*[F.when(p, F.lit(f)) for p, f in zip(present, gate.fields, strict=True)]), F.array_append(F.col(provenance), F.lit(None).cast("string")))) == 0
        raise ValueError(gate.kind)

    each = F.array(*[F.struct(F.lit(g.name).alias("gate"), passed(g).alias("passed"), F.lit(g.threshold).alias("threshold"), F.lit(g.blocking).alias("blocking")) for g in contract.gates])
    return records.select(F.col(record), F.explode(each).alias("g")).select(record, "g.*")


def gate_scores(results: DataFrame, contract: Contract | None = None) -> DataFrame:
    """Share of records that pass each gate, and whether that is enough. With a contract its gates without any record
    have rows too: their score is 1."""
    scored = results.groupBy("gate", "threshold", "blocking").agg(F.count(F.lit(1)).alias("records"), F.count_if("passed").alias("passed_records"))
    if contract is not None:
        rows = [(g.name, float(g.threshold), g.blocking) for g in contract.gates]
        gates = results.sparkSession.createDataFrame(rows, "gate string, threshold double, blocking boolean")
        scored = gates.join(scored.drop("threshold", "blocking"), "gate", "left").fillna(0, ["records", "passed_records"])
    score = F.when(F.col("records") == 0, 1.0).otherwise(F.col("passed_records") / F.col("records"))
    return scored.select("gate", "records", "passed_records", score.alias("score"), (score >= F.col("threshold")).alias("passed"), "blocking")


def quality_report(scores: DataFrame, upstream: bool = True) -> DataFrame:
    """The mean of the gates' scores with a status: unsupported without records, needs_review where a blocking gate
    failed, partial where records failed other gates or the stage before did not succeed, else succeeded; and whether the
    records may be published."""
    failed = F.count_if(F.expr("blocking and not passed"))
    sums = scores.agg(
        F.count(F.lit(1)).alias("gates"),
        F.avg("score").alias("score"),
        failed.alias("blocking_failures"),
        F.coalesce(F.sum(F.col("records") - F.col("passed_records")), F.lit(0)).alias("issues"),
        F.coalesce(F.max("records"), F.lit(0)).alias("records"),
    )
    rest = (F.col("issues") > 0) | F.lit(not upstream)
    status = F.when(F.col("records") == 0, "unsupported").when(F.col("blocking_failures") > 0, "needs_review").when(rest, "partial").otherwise("succeeded")
    approved = (F.col("records") > 0) & (F.col("blocking_failures") == 0)
    return sums.select("gates", F.coalesce("score", F.lit(1.0)).alias("score"), "blocking_failures", "issues", "records", status.alias("status"), approved.alias("approved"))


def quality_issues(results: DataFrame, record: str) -> DataFrame:
    """One issue, with its planned repair and review item, for each failing (gate, record)."""
    failed = results.where("not passed")
    return failed.select("gate", record, stable_id("iss_", F.col("gate"), F.col(record)).alias("issue_id"), stable_id("rep_", F.col("gate"), F.col(record)).alias("repair_id"), F.when(F.col("blocking"), "blocking").otherwise("advisory").alias("severity"))


def lineage_differs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, as often as it lacks them; empty if the sides are equal."""
    return left.exceptAll(right).select(F.lit("left").alias("only_in"), "*").unionByName(right.exceptAll(left).select(F.lit("right").alias("only_in"), "*"))


def map_columns(columns: DataFrame, targets: DataFrame, proposals: DataFrame | None = None, least: float = 0.7) -> DataFrame:
    """artifact_id, column_index, header, target_field and method.

    Columns (artifact_id, column_index, header) take the target (target_field) of equal normalized name if no other
    target has it; a target is used once in an artifact, by the first column. What is left may take a proposal
    (artifact_id, column_index, target_field, score) of ``least`` or more for a target that is still free.
    """
    from pyspark.sql import Window

    named = targets.select("target_field", field_name(F.col("target_field")).alias("_name"))
    only = named.groupBy("_name").agg(F.min("target_field").alias("target_field"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    exact = columns.withColumn("_name", field_name(F.col("header"))).join(F.broadcast(only), "_name")
    first = Window.partitionBy("artifact_id", F.lower("target_field")).orderBy("column_index")
    exact = exact.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("artifact_id", "column_index", "header", "target_field", F.lit("exact").alias("method"))
    if proposals is None:
        return exact
    open_ = columns.join(exact.select("artifact_id", "column_index"), ["artifact_id", "column_index"], "left_anti")
    offered = open_.join(proposals.where(F.col("score") >= least), ["artifact_id", "column_index"])
    free = offered.join(exact.select("artifact_id", "target_field"), ["artifact_id", "target_field"], "left_anti")
    # a column takes one target, its best; of several columns after one target the first has it
    free = free.groupBy("artifact_id", "column_index", "header").agg(F.min_by("target_field", F.struct(-F.col("score"), F.col("target_field"))).alias("target_field"))
    taken = free.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("artifact_id", "column_index", "header", "target_field", F.lit("proposal").alias("method"))
    return exact.unionByName(taken)
