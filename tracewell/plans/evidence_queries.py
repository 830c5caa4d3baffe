"""Queries of the evidence chain on the driver's tables: cells, mapping, normalization, entities, fusion, quality."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracewell.functions.values import decimal_places, fits_type, kind, shift_decimal, significant_digits
from tracewell.operators import cells as C
from tracewell.operators import contract as K
from tracewell.operators import discovery as D
from tracewell.operators import evidence as E
from tracewell.operators import graph as G
from tracewell.operators import integrity as I
from tracewell.operators import reports as O
from tracewell.operators import retrieval as R
from tracewell.plans.registry import Registry
from tracewell.session import shared_base, table

REGISTRY = Registry()
query = REGISTRY.query

CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


@query(
    "column_profile",
    """
    SELECT header, CAST(count(*) FILTER (v <> '') AS BIGINT) AS non_empty, CAST(count(*) FILTER (v = '') AS BIGINT) AS empty, CAST(count(*) FILTER (v IS NULL) AS BIGINT) AS nulls
    FROM (SELECT 'c_custkey' AS header, CAST(c_custkey AS VARCHAR) AS v FROM customer UNION ALL SELECT 'c_name', c_name FROM customer
          UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer)
    GROUP BY header
    """,
)
def column_profile(spark, sf_dir):
    return C.column_profile(table(spark, sf_dir, "customer"), CUSTOMER)


@query(
    "cells_unpivot",
    """
    SELECT CAST(n_nationkey AS BIGINT) AS row_index, 0 AS column_index, 'n_nationkey' AS header, CAST(n_nationkey AS VARCHAR) AS decoded FROM nation
    UNION ALL SELECT n_nationkey, 1, 'n_name', n_name FROM nation UNION ALL SELECT n_nationkey, 2, 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation
    """,
)
def cells_unpivot(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return C.unpivot(nation, F.col("n_nationkey").cast("long"), ["n_nationkey", "n_name", "n_regionkey"])


@query("typed_cells", """
    SELECT kind, count(*) AS cells, count(DISTINCT sha256(v)) AS distinct_texts FROM (
      SELECT v, CASE WHEN trim(v) = '' THEN 'empty' WHEN lower(trim(v)) IN ('true', 'false') THEN 'boolean_candidate'
                     WHEN regexp_full_match(trim(v), '[+-]?[0-9]+') THEN 'integer_candidate'
                     WHEN regexp_full_match(trim(v), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN 'decimal_candidate' ELSE 'text' END AS kind
      FROM (SELECT CAST(p_partkey AS VARCHAR) AS v FROM part UNION ALL SELECT p_name FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT CAST(p_size AS VARCHAR) FROM part))
    GROUP BY kind
    """)
def typed_cells(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    typed = C.typed_cells(C.unpivot(part, F.col("p_partkey"), ["p_partkey", "p_name", "p_brand", "p_size"]))
    return typed.groupBy("kind").agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("text_sha256").alias("distinct_texts"))


@query("gold_pivot", "SELECT CAST(n_nationkey AS BIGINT) AS row_index, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def gold_pivot(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return C.pivot(C.unpivot(nation, F.col("n_nationkey").cast("long"), ["n_nationkey", "n_name", "n_regionkey"]), ["n_name", "n_regionkey"])


@query("bounded_preview", """
    SELECT s_suppkey - 1 AS row_index, c AS column_index, v AS decoded FROM (
      SELECT s_suppkey, 0 AS c, CAST(s_suppkey AS VARCHAR) AS v FROM supplier UNION ALL SELECT s_suppkey, 1, s_name FROM supplier UNION ALL SELECT s_suppkey, 2, CAST(s_nationkey AS VARCHAR) FROM supplier)
    WHERE s_suppkey - 1 < 20 AND c < 2
    """)
def bounded_preview(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    return C.bounded_preview(C.unpivot(supplier, F.col("s_suppkey") - 1, ["s_suppkey", "s_name", "s_nationkey"]), 20, 2).select("row_index", "column_index", "decoded")


PART = K.Contract(
    fields=(K.Field("p_partkey", "integer", True), K.Field("p_name", "string", True), K.Field("p_size", "integer", True), K.Field("p_brand", "number"), K.Field("weight", "number", True), K.Field("kind", "string", aliases=("P_TYPE",))),
    entity_keys=("p_partkey",),
)


@query("header_contract_gaps", """
    SELECT 'part' AS table_id, f AS field_name, r AS reason FROM (
      SELECT unnest(['p_type', 'p_retailprice']) AS f, 'header_not_in_contract' AS r UNION ALL SELECT 'weight', 'required_header_absent')
    WHERE (SELECT count(*) FROM part) > 0
    """)
def header_contract_gaps(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    cells = C.unpivot(part, F.col("p_partkey")).withColumn("table_id", F.lit("part"))
    return E.extract(cells, PART)[1].where("row_index is null").select("table_id", "field_name", "reason")


@query("alias_suggestions", "SELECT 'part' AS table_id, 'p_type' AS header, 'kind' AS suggested_field")
def alias_suggestions(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    cells = C.unpivot(part, F.col("p_partkey")).withColumn("table_id", F.lit("part"))
    return E.alias_suggestions(E.extract(cells, PART)[1], PART)


@query("type_compat_mapping", """
    SELECT field_name, decision, count(*) AS candidates FROM (
      SELECT 'p_partkey' AS field_name, 'auto_accepted' AS decision FROM part UNION ALL SELECT 'p_name', 'auto_accepted' FROM part WHERE p_name <> ''
      UNION ALL SELECT 'p_size', 'auto_accepted' FROM part WHERE p_size IS NOT NULL
      UNION ALL SELECT 'p_brand', CASE WHEN regexp_full_match(trim(p_brand), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)') THEN 'auto_accepted' ELSE 'blocked_type_conflict' END FROM part WHERE p_brand <> '')
    GROUP BY ALL
    """)
def type_compat_mapping(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    cells = C.unpivot(part, F.col("p_partkey")).withColumn("table_id", F.lit("part"))
    return E.map_fields(E.extract(cells, PART)[0], PART).groupBy("field_name", "decision").agg(F.count(F.lit(1)).alias("candidates"))


@query("kind_inference", """
    SELECT kind, fits, count(*) AS n FROM (
      SELECT kind, kind = 'integer_candidate' AS fits FROM (
        SELECT CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN 'integer_candidate' WHEN regexp_full_match(v, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN 'decimal_candidate' ELSE 'text' END AS kind
        FROM (SELECT regexp_extract(props, '"k": ([^}]*)', 1) AS v FROM events)))
    GROUP BY ALL
    """)
def kind_inference(spark, sf_dir):
    label = kind(F.regexp_extract("props", r'"k": ([^}]*)', 1))
    found = table(spark, sf_dir, "events").select(label.alias("kind")).select("kind", fits_type(F.col("kind"), F.lit("integer")).alias("fits"))
    return found.groupBy("kind", "fits").agg(F.count(F.lit(1)).alias("n"))


@query("exact_decimal_shift", """
    SELECT o_orderkey, CAST(CAST(o_orderkey AS DECIMAL(38, 1)) - 2400000.5 AS VARCHAR) AS shifted, 1 AS places, CAST(length(CAST(o_orderkey AS VARCHAR)) AS INT) AS digits FROM orders
    """)
def exact_decimal_shift(spark, sf_dir):
    text = F.col("o_orderkey").cast("string")
    shifted = shift_decimal(text, "2400000.5")
    return table(spark, sf_dir, "orders").select("o_orderkey", shifted.alias("shifted"), decimal_places(shifted).alias("places"), significant_digits(text).alias("digits"))


@query("context_units", """
    SELECT event_type, CASE WHEN event_type = 'error' THEN 'needs_review' ELSE 'normalized' END AS status, CASE WHEN event_type = 'error' THEN 'source_unit_missing' ELSE '' END AS issues, count(*) AS n FROM events GROUP BY ALL
    """)
def context_units(spark, sf_dir):
    """A unit is known for the rows of some event types; the others need review."""
    contract = K.Contract((K.Field("key", "string", True), K.Field("quantity", "number", unit="t")), ("key",))
    rows = table(spark, sf_dir, "events").select(F.lit("events").alias("table_id"), F.col("event_id").alias("row_index"), F.lit("quantity").alias("field_name"), F.col("value").cast("decimal(18,2)").cast("string").alias("raw_value"), "event_type")
    mapped = E.map_fields(rows.withColumn("kind", kind(F.col("raw_value"))), contract)
    context = rows.where("event_type <> 'error'").select("table_id", "row_index", "field_name", F.lit("t").alias("unit"))
    out = E.normalize(mapped, context, {"quantity": "t"}).select("event_type", "status", F.array_join("issues", ",").alias("issues"))
    return out.groupBy("event_type", "status", "issues").agg(F.count(F.lit(1)).alias("n"))


def _document_prints(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fields = docs.select(F.col("doc_id").alias("record_id"), F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in ("lang", "source")])).alias("f")).select("record_id", "f.*")
    return E.resolve(fields.withColumn("eligible", F.col("value").isNotNull() & (F.col("value") != "")), ["lang", "source"])


@query("entity_blocking", """
    SELECT sha256(concat(lang, chr(1), source)) AS fingerprint, count(*) AS members, min(doc_id) AS first_member,
           CASE WHEN count(*) = 1 THEN 'singleton' ELSE 'auto_merged' END AS decision, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS pairs
    FROM documents WHERE lang <> '' AND source <> '' GROUP BY lang, source
    """)
def entity_blocking(spark, sf_dir):
    return E.clusters(_document_prints(spark, sf_dir))


@query("pair_metrics", """
    WITH g AS (SELECT count(*) AS n FROM documents WHERE lang <> '' AND source <> '' GROUP BY lang, source), s AS (SELECT CAST(sum(n) AS BIGINT) AS r, CAST(sum(n * (n - 1) / 2) AS BIGINT) AS p FROM g)
    SELECT r AS records, p AS candidate_pairs, CAST(r * (r - 1) / 2 AS BIGINT) AS all_pairs, 1 - p / CAST(r * (r - 1) / 2 AS BIGINT) AS reduction FROM s
    """)
def pair_metrics(spark, sf_dir):
    return E.pair_metrics(E.clusters(_document_prints(spark, sf_dir)))


@query("exact_duplicates", """
    SELECT sha256(text) AS fingerprint, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY sha256(text) HAVING count(*) > 1
    """)
def exact_duplicates(spark, sf_dir):
    return O.equal_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("duplicate_groups", """
    WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus AS s, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders)
    SELECT o_custkey, count(*) AS copies, min(o_orderkey) AS first_record FROM r GROUP BY o_custkey, s, p HAVING count(*) > 1
    """)
def duplicate_groups(spark, sf_dir):
    field = lambda name, value, eligible: F.struct(F.lit(name).alias("field_name"), F.col(value).alias("value"), eligible.alias("eligible"))
    each = F.array(field("status", "o_orderstatus", F.lit(True)), field("priority", "o_orderpriority", F.col("o_orderkey") % 4 != 0))
    fields = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.explode(each).alias("f")).select("o_custkey", "o_orderkey", "f.*")
    return O.duplicate_groups(fields, "o_custkey", "o_orderkey").select("o_custkey", "copies", "first_record")


@query("fields_by_row", """
    SELECT n_nationkey AS row_index, 'n_nationkey=' || CAST(n_nationkey AS VARCHAR) || ';n_name=' || n_name || ';n_regionkey=' || CAST(n_regionkey AS VARCHAR) AS fields, 3 AS n_fields, CASE WHEN n_regionkey = 0 THEN 2 ELSE 3 END AS n_eligible FROM nation
    """)
def fields_by_row(spark, sf_dir):
    cells = C.unpivot(table(spark, sf_dir, "nation"), F.col("n_nationkey"), ["n_nationkey", "n_name", "n_regionkey"])
    fields = cells.select("row_index", "column_index", F.col("header").alias("field_name"), F.col("decoded").alias("value"), ((F.col("header") != "n_regionkey") | (F.col("decoded") != "0")).alias("eligible"))
    shown = F.array_join(F.transform("fields", lambda f: F.concat_ws("=", f["field_name"], f["value"])), ";")
    return O.fields_by_row(fields, ["row_index"], "column_index").select("row_index", shown.alias("fields"), "n_fields", "n_eligible")


@query("cell_evidence", "SELECT 'r' || CAST(s_suppkey AS VARCHAR) || 'c1' AS cell_id, s_name AS decoded, 'ev' || CAST(s_suppkey AS VARCHAR) AS evidence_id FROM supplier WHERE s_suppkey % 3 <> 0")
def cell_evidence(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    cell = lambda row, column: F.concat(F.lit("r"), row.cast("string"), F.lit("c"), column.cast("string"))
    cells = C.unpivot(supplier, F.col("s_suppkey"), ["s_suppkey", "s_name"]).select(cell(F.col("row_index"), F.col("column_index")).alias("cell_id"), "decoded")
    atoms = supplier.where("s_suppkey % 3 <> 0").select(cell(F.col("s_suppkey"), F.lit(1)).alias("cell_id"), F.concat(F.lit("ev"), F.col("s_suppkey").cast("string")).alias("evidence_id"))
    return O.cell_evidence(cells, atoms)


@query("read_model", """
    WITH c AS (SELECT c_nationkey AS task, count(*) AS customers FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS task, count(*) AS suppliers, max(CASE WHEN s_acctbal < 0 THEN 'needs_review' ELSE 'done' END) AS st FROM supplier GROUP BY 1)
    SELECT task, CAST(customers AS BIGINT) AS customers_items, CASE WHEN customers IS NOT NULL THEN 'done' END AS customers_status, CAST(suppliers AS BIGINT) AS suppliers_items, st AS suppliers_status FROM c FULL JOIN s USING (task)
    """)
def read_model(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("task"), F.lit(1).alias("items"), F.lit("done").alias("status"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("task"), F.lit(1).alias("items"), F.when(F.col("s_acctbal") < 0, "needs_review").otherwise("done").alias("status"))
    return O.read_model({"customers": customers, "suppliers": suppliers}, "task")


@query("lineage_audit", """
    WITH l AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT o_orderkey AS k, o_orderkey % 5 AS told FROM orders)
    SELECT k AS o_orderkey, coalesce(told, 0) AS reported, coalesce(n, 0) AS found FROM l FULL JOIN p USING (k) WHERE coalesce(told, 0) <> coalesce(n, 0)
    """)
def lineage_audit(spark, sf_dir):
    """Orders that report a made-up number of lines against the lines there are."""
    report = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("told"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return O.wrong_counts(report, lines, "o_orderkey", "told").select("o_orderkey", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("reported", "found")])


FUSION_SQL = """
    WITH c AS (SELECT l_partkey, l_suppkey, CASE WHEN l_tax <> 0.04 THEN CAST(CAST(l_tax AS DECIMAL(18, 2)) AS VARCHAR) END AS value, CASE WHEN l_quantity <> 7 THEN l_discount >= 0.01 END AS eligible, concat(l_orderkey, '-', l_linenumber) AS id FROM lineitem),
    g AS (SELECT l_partkey, l_suppkey, count(*) AS candidates, count(DISTINCT coalesce(value, 'null')) AS distinct_values, bool_and(coalesce(eligible, false)) AS ok, first(value ORDER BY id) AS first_value, list_sort(list(DISTINCT id)) AS ids FROM c GROUP BY 1, 2),
    d AS (SELECT *, CASE WHEN candidates > 1 AND distinct_values > 1 THEN 'unresolved_conflict' WHEN NOT ok THEN 'withheld_review' WHEN candidates = 1 THEN 'single_eligible' ELSE 'exact_consensus' END AS decision FROM g)
"""


def _fused(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_partkey",
        "l_suppkey",
        F.lit("tax").alias("field_name"),
        F.when(F.col("l_tax") != 0.04, F.col("l_tax").cast("decimal(18,2)").cast("string")).alias("value"),
        F.when(F.col("l_quantity") != 7, F.col("l_discount") >= 0.01).alias("eligible"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("candidate_id"),
    )
    return E.fuse(lines.withColumn("evidence_id", F.col("candidate_id")), ["l_partkey", "l_suppkey"])


@query("fusion_decision", FUSION_SQL + """
    SELECT l_partkey, l_suppkey, 'tax' AS field_name, candidates, distinct_values, decision, CASE WHEN decision IN ('single_eligible', 'exact_consensus') THEN first_value END AS value, array_to_string(ids, ',') AS evidence_ids FROM d
    """)
def fusion_decision(spark, sf_dir):
    return _fused(spark, sf_dir).withColumn("evidence_ids", F.array_join("evidence_ids", ","))


@query("status_ladder", FUSION_SQL + """
    , n AS (SELECT l_partkey, count(*) AS fields, CAST(count(*) FILTER (decision IN ('single_eligible', 'exact_consensus')) AS BIGINT) AS selected,
                   CAST(count(*) FILTER (decision = 'unresolved_conflict') AS BIGINT) AS conflicts, CAST(count(*) FILTER (decision = 'withheld_review') AS BIGINT) AS withheld FROM d GROUP BY 1)
    SELECT *, CASE WHEN selected = 0 THEN 'needs_review' WHEN withheld > 0 OR conflicts > 0 THEN 'partial' ELSE 'succeeded' END AS status FROM n
    """)
def status_ladder(spark, sf_dir):
    """The status that fusing the taxes of each part leaves."""
    return O.status_ladder(_fused(spark, sf_dir), by=["l_partkey"])


@query("gold_records", """
    WITH c AS (SELECT l_orderkey, unnest(['discount', 'flag', 'tax']) AS f, unnest([CAST(CAST(l_discount AS DECIMAL(18, 2)) AS VARCHAR), l_returnflag, CAST(CAST(l_tax AS DECIMAL(18, 2)) AS VARCHAR)]) AS v, l_quantity > 5 AS ok FROM lineitem),
    d AS (SELECT l_orderkey, f, min(v) AS v, CASE WHEN count(*) > 1 AND count(DISTINCT v) > 1 THEN 'conflict' WHEN NOT bool_and(ok) THEN 'withheld' ELSE 'taken' END AS d FROM c GROUP BY 1, 2)
    SELECT l_orderkey, coalesce(string_agg(f || '=' || v, ',' ORDER BY f) FILTER (d = 'taken'), '') AS "values", coalesce(string_agg(f, ',' ORDER BY f) FILTER (d <> 'taken'), '') AS withheld,
           coalesce(string_agg(f, ',' ORDER BY f) FILTER (d = 'conflict'), '') AS in_conflict, bool_or(d = 'taken') AS selected FROM d GROUP BY 1
    """)
def gold_records(spark, sf_dir):
    """Each order's lines as candidates for three of its fields: what is selected, and what is withheld by name."""
    decimal = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    fields = {"discount": decimal("l_discount"), "flag": F.col("l_returnflag"), "tax": decimal("l_tax")}
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("field_name"), v.alias("value")) for n, v in fields.items()))).alias("f")
    # dealt out by order as narrow lines, before they become three candidates each; fields and orders then stand where they are
    dealt = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_tax").repartition("l_orderkey")
    lines = dealt.withColumn("id", F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber"))
    candidates = lines.select("l_orderkey", F.col("id").alias("candidate_id"), F.col("id").alias("evidence_id"), (F.col("l_quantity") > 5).alias("eligible"), each).select("l_orderkey", "candidate_id", "evidence_id", "eligible", "f.*")
    gold = E.gold_records(E.fuse(candidates, ["l_orderkey"]), ["l_orderkey"])
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("values")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return gold.select("l_orderkey", shown.alias("values"), F.array_join("withheld", ",").alias("withheld"), F.array_join("in_conflict", ",").alias("in_conflict"), "selected")


@query("conflict_report", """
    SELECT o_custkey, attribute, count(DISTINCT v) AS distinct_values, count(v) AS rows FROM (
      SELECT o_custkey, 'o_orderstatus' AS attribute, o_orderstatus AS v FROM orders UNION ALL SELECT o_custkey, 'o_orderpriority', o_orderpriority FROM orders)
    GROUP BY 1, 2 HAVING count(DISTINCT v) > 1 AND count(v) >= 2
    """)
def conflict_report(spark, sf_dir):
    return E.conflicts(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"])


GATES = K.Contract(
    fields=(K.Field("c_custkey", "integer", True), K.Field("c_name", "string", True), K.Field("c_mktsegment"), K.Field("best_status")),
    entity_keys=("c_custkey",),
    gates=(
        K.Gate("required_fields_complete", "required_fields", ("c_custkey", "c_name")),
        K.Gate("any_attribute", "any_of_fields", ("best_status",), 0.9),
        K.Gate("segment_provenance", "field_provenance", ("c_mktsegment",), 0.5, False),
    ),
)
GATES_SQL = """
    WITH r AS (SELECT c.c_custkey, c_name, c_mktsegment, max(o_orderstatus) AS best_status FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY ALL),
    x AS (SELECT c_custkey, 'required_fields_complete' AS gate, c_name <> '' AND c_name IS NOT NULL AS passed, 1.0 AS threshold, true AS blocking FROM r
          UNION ALL SELECT c_custkey, 'any_attribute', coalesce(best_status, '') <> '', 0.9, true FROM r
          UNION ALL SELECT c_custkey, 'segment_provenance', NOT (coalesce(c_mktsegment, '') <> '' AND c_mktsegment = 'BUILDING'), 0.5, false FROM r),
    s AS (SELECT gate, count(*) AS records, CAST(count(*) FILTER (passed) AS BIGINT) AS passed_records, count(*) FILTER (passed) / count(*) AS score, count(*) FILTER (passed) / count(*) >= threshold AS passed, blocking FROM x GROUP BY gate, threshold, blocking)
"""


def _gate_results(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderstatus").alias("best_status"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    records = customer.join(orders, customer.c_custkey == orders.o_custkey, "left").drop("o_custkey")
    known = F.when(F.col("c_mktsegment") != "BUILDING", F.array(F.lit("c_mktsegment"))).otherwise(F.array().cast("array<string>"))
    return E.gate_results(records.withColumn("evidence", known), "c_custkey", GATES, "evidence")


@query("quality_gates", GATES_SQL + "SELECT * FROM s")
def quality_gates(spark, sf_dir):
    return E.gate_scores(_gate_results(spark, sf_dir))


@query("quality_report", GATES_SQL + """
    SELECT count(*) AS gates, avg(score) AS score, CAST(count(*) FILTER (blocking AND NOT passed) AS BIGINT) AS blocking_failures, CAST(sum(records - passed_records) AS BIGINT) AS issues, max(records) AS records,
           CASE WHEN count(*) FILTER (blocking AND NOT passed) > 0 THEN 'needs_review' WHEN sum(records - passed_records) > 0 THEN 'partial' ELSE 'succeeded' END AS status, count(*) FILTER (blocking AND NOT passed) = 0 AS approved FROM s
    """)
def quality_report(spark, sf_dir):
    return E.quality_report(E.gate_scores(_gate_results(spark, sf_dir)))


@query("quality_issues", GATES_SQL + """
    SELECT gate, c_custkey, concat('iss_', sha256(concat(gate, chr(1), c_custkey))[1:16]) AS issue_id, concat('rep_', sha256(concat(gate, chr(1), c_custkey))[1:16]) AS repair_id, CASE WHEN blocking THEN 'blocking' ELSE 'advisory' END AS severity FROM x WHERE NOT passed
    """)
def quality_issues(spark, sf_dir):
    return E.quality_issues(_gate_results(spark, sf_dir), "c_custkey")


@query("contract_diff", """
    SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT o_orderkey AS k, o_orderpriority AS v FROM orders WHERE o_orderkey % 5 <> 0) b ON a.k = b.k
    WHERE a.v IS DISTINCT FROM b.v OR a.k IS NULL OR b.k IS NULL
    """)
def contract_diff(spark, sf_dir):
    """Two versions of a keyed table: a key that one lacks was added or removed, one with another value was changed."""
    orders = table(spark, sf_dir, "orders")
    old = orders.where(F.col("o_orderkey") % 3 != 0).select("o_orderkey", F.col("o_orderstatus").alias("v"))
    new = orders.where(F.col("o_orderkey") % 5 != 0).select("o_orderkey", F.col("o_orderpriority").alias("v"))
    return K.difference(old, new, "o_orderkey", "v")


@query("pack_merge", """
    WITH f AS (SELECT p_brand, arg_min(p_type, p_partkey) AS data_type FROM part GROUP BY 1),
    a AS (SELECT part.*, data_type, p_type = data_type AS ok FROM part JOIN f USING (p_brand))
    SELECT p_brand AS field_name, bool_or(p_size > 40) FILTER (ok) AS required, bool_and(p_size > 5) FILTER (ok) AS nullable, bool_or(NOT ok) AS conflict, any_value(data_type) AS data_type,
           count(DISTINCT p_name) FILTER (ok) AS aliases, max(p_retailprice) FILTER (ok) AS threshold, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS refused FROM a GROUP BY 1
    """)
def pack_merge(spark, sf_dir):
    packs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pack"), F.col("p_brand").alias("field_name"), F.col("p_type").alias("data_type"), (F.col("p_size") > 40).alias("required"), (F.col("p_size") > 5).alias("nullable"), F.array("p_name").alias("aliases"), F.col("p_retailprice").alias("threshold"))
    merged = K.merge_fields(packs)
    return merged.select("field_name", "required", "nullable", "conflict", "data_type", F.size("aliases").cast("long").alias("aliases"), "threshold", F.size("conflicts").cast("long").alias("refused"))


def _graph(spark, sf_dir):
    """The graph of the customers' gates: two evidence cells for each customer, an issue for each failure."""
    issues = E.quality_issues(_gate_results(spark, sf_dir), "c_custkey").select("issue_id", "gate", "severity", F.when(F.col("gate") == "any_attribute", F.array(F.lit("best_status"))).otherwise(F.array(F.lit("c_mktsegment"))).alias("field_names"))
    names = ("c_name", "c_mktsegment")
    cells = C.unpivot(table(spark, sf_dir, "customer"), F.col("c_custkey"), list(names)).where("decoded <> ''")
    evidence = cells.select(F.concat_ws("-", F.col("row_index").cast("string"), "header").alias("evidence_id"), F.col("header").alias("field_name"), "row_index", "column_index")
    gates = GATES.gate_table(spark).select("gate", "kind")
    return G.graph("t", spark.createDataFrame([(f.name,) for f in GATES.fields], "field_name string"), evidence, gates, issues, "m", False)


GRAPH_SQL = GATES_SQL + """,
    i AS (SELECT 'quality_issue:iss_' || sha256(concat(gate, chr(1), c_custkey))[1:16] AS node, gate FROM x WHERE NOT passed),
    v AS (SELECT CAST(c_custkey AS VARCHAR) || '-c_name' AS id, 'c_name' AS f FROM customer WHERE c_name <> '' UNION ALL SELECT CAST(c_custkey AS VARCHAR) || '-c_mktsegment', 'c_mktsegment' FROM customer WHERE c_mktsegment <> ''),
    n AS (SELECT 'task:t' AS node, 'task' AS kind UNION ALL SELECT 'memory:m', 'memory' UNION ALL SELECT 'field:' || f, 'field' FROM (SELECT unnest(['c_custkey', 'c_name', 'c_mktsegment', 'best_status']) AS f)
          UNION ALL SELECT 'evidence:' || id, 'evidence' FROM v UNION ALL SELECT 'quality_gate:' || g, 'quality_gate' FROM (SELECT unnest(['required_fields_complete', 'any_attribute', 'segment_provenance']) AS g) UNION ALL SELECT node, 'quality_issue' FROM i)
"""


@query("graph_nodes", GRAPH_SQL + " SELECT node, kind FROM n")
def graph_nodes(spark, sf_dir):
    return _graph(spark, sf_dir)[0].select("node", "kind")


@query("graph_edges", GRAPH_SQL + """
    SELECT 'task:t' AS source, node AS target, 'contains' AS kind FROM n WHERE kind <> 'task' UNION ALL SELECT 'evidence:' || id, 'field:' || f, 'supports' FROM v
    UNION ALL SELECT node, 'quality_gate:' || gate, 'violates' FROM i UNION ALL SELECT node, CASE WHEN gate = 'any_attribute' THEN 'field:best_status' ELSE 'field:c_mktsegment' END, 'affects' FROM i UNION ALL SELECT 'memory:m', node, 'derived_from' FROM i
    """)
def graph_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[1]


@query("lineage_equal", "SELECT 'left' AS only_in, o_orderkey FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT 'right', o_orderkey FROM orders WHERE o_orderkey % 11 = 0 AND false")
def lineage_equal(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select("o_orderkey")
    return E.lineage_differs(keys, keys.where(F.col("o_orderkey") % 7 != 0))


EDGES_SQL = "WITH e AS (SELECT DISTINCT concat('part:', l_partkey) AS source, concat('supplier:', l_suppkey) AS target FROM lineitem)"


def _supplies(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("part:"), "l_partkey").alias("source"), F.concat(F.lit("supplier:"), "l_suppkey").alias("target"))


def _edges(spark, sf_dir):
    return _supplies(spark, sf_dir).distinct()


@query("evidence_edges", EDGES_SQL + " SELECT source, target FROM e")
def evidence_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query("one_hop", EDGES_SQL + ", s AS (SELECT concat('part:', p_partkey) AS node FROM part WHERE p_size = 1) SELECT node FROM s UNION SELECT target FROM e JOIN s ON e.source = s.node")
def one_hop(spark, sf_dir):
    seeds = table(spark, sf_dir, "part").where("p_size = 1").select(F.concat(F.lit("part:"), "p_partkey").alias("node"))
    return R.one_hop(_edges(spark, sf_dir), seeds)


@query("degree", EDGES_SQL + " SELECT node, count(*) AS degree FROM (SELECT source AS node FROM e UNION ALL SELECT target FROM e) GROUP BY node")
def degree(spark, sf_dir):
    return R.degrees(_edges(spark, sf_dir))


@query("components")  # a recursion over one skewed component is too much for SQL; a test compares with union-find
def components(spark, sf_dir):
    return D.components(_supplies(spark, sf_dir).select(F.col("source").alias("a"), F.col("target").alias("b")))


@query("column_mapping", """
    SELECT 'orders' AS artifact_id, i AS column_index, h AS header, t AS target_field, m AS method FROM (VALUES (0, 'o_orderkey', 'O_OrderKey', 'exact'), (3, 'o_totalprice', 'price', 'proposal')) v(i, h, t, m) WHERE (SELECT count(*) FROM orders) > 0
    """)
def column_mapping(spark, sf_dir):
    headers = C.unpivot(table(spark, sf_dir, "orders"), F.lit(0)).select("column_index", "header").distinct()
    columns = headers.select(F.lit("orders").alias("artifact_id"), "column_index", "header")
    targets = spark.createDataFrame([("O_OrderKey",), ("price",), ("o orderkey!x",)], "target_field string")
    proposals = spark.createDataFrame([("orders", 3, "price", 0.8), ("orders", 4, "price", 0.9), ("orders", 1, "other", 0.5), ("orders", 5, "O_OrderKey", 0.9)], "artifact_id string, column_index int, target_field string, score double").where("column_index <> 4")
    return E.map_columns(columns, targets, proposals)


@query("sealed_changes", """
    WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT BETWEEN 700 AND 720),
    b AS (SELECT o_orderkey, CASE WHEN o_orderkey BETWEEN 300 AND 330 AND o_orderstatus <> 'X' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT BETWEEN 1000 AND 1010)
    SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.o_totalprice IS DISTINCT FROM b.o_totalprice
    """)
def sealed_changes(spark, sf_dir):
    """Orders sealed twice, with some added, removed and changed: both seals are verified, then compared by their trees."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    key = F.col("o_orderkey")
    old = orders.where(~key.between(700, 720))
    new = orders.where(~key.between(1000, 1010)).withColumn("o_orderstatus", F.when(key.between(300, 330), "X").otherwise(F.col("o_orderstatus")))
    base = f"{shared_base(spark)}/seal-{uuid.uuid4().hex}"
    I.seal(old, "o_orderkey", f"{base}/a", leaves=32)
    I.seal(new, "o_orderkey", f"{base}/b", like=f"{base}/a")
    for path in ("a", "b"):
        I.verify(spark, f"{base}/{path}", orders.schema)
    return I.changes(spark, f"{base}/a", f"{base}/b", orders.schema)
