"""Queries of selection's rules and reports, recorded parses and downloads, discovery merging and stores."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracewell.operators import cells as C
from tracewell.operators import discovery as D
from tracewell.operators import merging as M
from tracewell.operators import selection as L
from tracewell.plans.registry import Registry
from tracewell.session import shared_base, table
from tracewell.sinks import stores as B

REGISTRY = Registry()
query = REGISTRY.query


@query("capability_filter", """
    WITH c AS (SELECT n_name, CASE WHEN n_nationkey % 5 = 0 THEN 'Generic' ELSE r_name END AS d, ['size' || CAST(n_nationkey % 7 AS VARCHAR), 'size' || CAST(n_regionkey AS VARCHAR)] AS t FROM nation JOIN region ON n_regionkey = r_regionkey),
    f AS (SELECT DISTINCT 'size' || CAST(p_size % 3 AS VARCHAR) AS t FROM part)
    SELECT n_name FROM c WHERE lower(d) IN ('asia', 'europe', 'generic') AND EXISTS (SELECT 1 FROM f WHERE f.t IN ('size0', 'size1', 'size3') AND list_contains(c.t, f.t))
    """)
def capability_filter(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    size = lambda c: F.concat(F.lit("size"), c.cast("string"))
    capabilities = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.array(F.when(F.col("n_nationkey") % 5 == 0, "Generic").otherwise(F.col("r_name"))).alias("domains"), F.array(size(F.col("n_nationkey") % 7), size(F.col("n_regionkey"))).alias("source_types"))
    fields = table(spark, sf_dir, "part").select(F.array(size(F.col("p_size") % 3)).alias("preferences"))
    return L.applicable_capabilities(capabilities, "n_name", ["Asia", "EUROPE"], ["size0", "size1", "size3"], fields).select("n_name")


@query("missing_capabilities", """
    WITH p AS (SELECT p_brand AS pack, list_sort(list_filter(list(DISTINCT 'c' || CAST(p_size % 13 AS VARCHAR)), lambda x: x NOT IN ('c0', 'c1', 'c2', 'c3', 'c4', 'c5', 'c6', 'c7', 'c8', 'c9', 'c10'))) AS m FROM part WHERE p_size % 13 <> 12 OR p_brand <> 'Brand#1' GROUP BY 1)
    SELECT pack, array_to_string(m, ',') AS missing, CASE WHEN len(m) = 0 THEN 'formal' ELSE 'generic' END AS mode FROM p
    """)
def missing_capabilities(spark, sf_dir):
    part = table(spark, sf_dir, "part").where("p_size % 13 <> 12 OR p_brand <> 'Brand#1'")
    packs = part.groupBy(F.col("p_brand").alias("pack")).agg(F.collect_set(F.concat(F.lit("c"), (F.col("p_size") % 13).cast("string"))).alias("required"))
    return L.routing_mode(packs, [f"c{i}" for i in range(11)], ["c1"]).select("pack", F.array_join("missing", ",").alias("missing"), "mode")


@query("eligible_sources", "SELECT s_suppkey FROM supplier WHERE s_nationkey % 3 < 2 AND s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09 AND l_quantity > 49)")
def eligible_sources(spark, sf_dir):
    sources = table(spark, sf_dir, "supplier").select("s_suppkey", F.array(F.concat(F.lit("n"), (F.col("s_nationkey") % 3).cast("string")), F.lit("other")).alias("categories"))
    claims = table(spark, sf_dir, "lineitem").where("l_discount > 0.09 and l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return L.eligible_sources(sources, claims, "s_suppkey", ["n0", "n1"]).select("s_suppkey")


FIELDS_SQL = "f AS (SELECT p_brand AS field_name, min(p_size) <= 2 AS required, min(p_size) <= 1 AS entity_key, CASE WHEN avg(p_size) > 25 THEN 'covered' ELSE 'uncertain' END AS state FROM part GROUP BY 1)"


def _fields(spark, sf_dir):
    size = F.min("p_size")
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("field_name")).agg((size <= 2).alias("required"), (size <= 1).alias("entity_key"), F.when(F.avg("p_size") > 25, "covered").otherwise("uncertain").alias("state"))


@query("coverage_ratios", f"""
    WITH {FIELDS_SQL}, h AS (SELECT *, CASE WHEN state = 'covered' THEN 1.0 ELSE 0.0 END AS hit FROM f)
    SELECT coalesce(avg(CAST(hit AS DOUBLE)) FILTER (required), 1.0) AS required_ratio, coalesce(avg(CAST(hit AS DOUBLE)) FILTER (entity_key), 1.0) AS entity_ratio,
           (SELECT avg(CASE WHEN n_nationkey % 3 <> 0 THEN 1.0::DOUBLE ELSE 0.0 END) FROM nation) AS source_type_ratio FROM h
    """)
def coverage_ratios(spark, sf_dir):
    types = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 3 != 0, "covered").otherwise("uncovered").alias("state"))
    return L.coverage_ratios(_fields(spark, sf_dir), types)


@query("gate_coverage", """
    WITH s AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1), t AS (SELECT n_nationkey, n_name, n_regionkey, coalesce(n, 0) >= 1 AND n_nationkey % 4 <> 0 AS hit FROM nation LEFT JOIN s ON s_nationkey = n_nationkey),
    g AS (SELECT r_name AS gate, r_regionkey % 2 = 0 AS any_of, 0.7 AS threshold, coalesce(list(n_name ORDER BY n_nationkey) FILTER (hit), []) AS covered, coalesce(list(n_name ORDER BY n_nationkey) FILTER (NOT hit), []) AS missing, count(*) AS n FROM region JOIN t ON n_regionkey = r_regionkey GROUP BY ALL)
    SELECT gate, array_to_string(covered, ',') AS covered, array_to_string(missing, ',') AS missing, len(covered) / n AS ratio,
           CASE WHEN CASE WHEN any_of THEN len(covered) > 0 ELSE len(covered) / n >= threshold END THEN 'satisfied' WHEN len(covered) > 0 THEN 'partial' ELSE 'unsatisfied' END AS state FROM g
    """)
def gate_coverage(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    counted = table(spark, sf_dir, "supplier").select("s_nationkey").distinct()
    hit = F.col("s_nationkey").isNotNull() & (F.col("n_nationkey") % 4 != 0)
    fields = nation.join(counted, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.col("n_name").alias("field_name"), F.when(hit, "covered").otherwise("uncovered").alias("state"))
    gates = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("gate"), "r_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"]).alias("fields"))
    gates = gates.select("gate", F.when(F.col("r_regionkey") % 2 == 0, "any_of_fields").otherwise("required_fields").alias("kind"), "fields", F.lit(0.7).alias("threshold"), F.lit(True).alias("blocking"))
    found = L.gate_coverage(gates, fields)
    return found.select("gate", F.array_join("covered", ",").alias("covered"), F.array_join("missing", ",").alias("missing"), "ratio", "state")


@query("parse_ranking", """
    WITH r AS (SELECT l_orderkey AS route, l_suppkey AS candidate_id, 'p' || CAST(l_suppkey % 5 AS VARCHAR) AS parser_id, l_suppkey % 7 AS cost, l_quantity >= 10 AS passed, l_tax AS score FROM lineitem),
    j AS (SELECT route, candidate_id, parser_id, cost, CAST(count(*) FILTER (NOT passed) AS BIGINT) AS failed, min(score) AS least_score FROM r GROUP BY 1, 2, 3, 4)
    SELECT route, candidate_id, failed, least_score, row_number() OVER (PARTITION BY route ORDER BY failed, least_score DESC, cost, parser_id, candidate_id) AS rank FROM j
    """)
def parse_ranking(spark, sf_dir):
    results = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("route"), F.col("l_suppkey").alias("candidate_id"), F.concat(F.lit("p"), (F.col("l_suppkey") % 5).cast("string")).alias("parser_id"),
        (F.col("l_suppkey") % 7).alias("cost"), (F.col("l_quantity") >= 10).alias("passed"), F.col("l_tax").alias("score"),
    )
    return L.rank_parses(results, "route").select("route", "candidate_id", "failed", "least_score", "rank")


@query("parse_attempts", """
    WITH o AS (SELECT o_orderkey AS route, o_orderkey % 4 AS a, o_orderkey % 3 AS b, o_orderkey % 5 AS c FROM orders),
    p AS (SELECT route, c = 4 AS gone, CASE WHEN a = 0 THEN 'succeeded' WHEN a = 1 THEN 'failed' ELSE 'quality_failed' END AS s0, a = 3 AS t, CASE WHEN b = 0 THEN 'succeeded' ELSE 'quality_failed' END AS s1 FROM o),
    q AS (SELECT route, CASE WHEN gone THEN 'blocked' ELSE s0 END AS o0, CASE WHEN gone THEN 'parser_unavailable' END AS r0,
                 CASE WHEN gone OR s0 = 'succeeded' THEN 'not_run' WHEN t THEN s1 ELSE 'blocked' END AS o1, CASE WHEN NOT gone AND s0 <> 'succeeded' AND NOT t THEN 'quality_unsatisfied' END AS r1 FROM p)
    SELECT route, 0 AS position, o0 AS outcome, r0 AS reason FROM q UNION ALL SELECT route, 1, o1, r1 FROM q
    UNION ALL SELECT route, 2, CASE WHEN o0 IN ('blocked', 'succeeded') OR o1 = 'succeeded' THEN 'not_run' ELSE 'blocked' END, CASE WHEN o0 IN ('blocked', 'succeeded') OR o1 = 'succeeded' THEN NULL WHEN o1 = 'quality_failed' THEN 'budget_exhausted' WHEN o0 = 'failed' THEN 'budget_exhausted' ELSE 'quality_unsatisfied' END FROM q
    """)
def parse_attempts(spark, sf_dir):
    """Three parsers for each order: the second runs where structure failed the check it is for, the third is too dear."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(key.alias("route"), (key % 4).alias("a"), (key % 3).alias("b"), (key % 5).alias("c"))
    plans = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f"p{i}").alias("parser_id"), F.lit(t).cast("string").alias("trigger")) for i, t in ((0, None), (1, "structure"), (2, "text"))])
    routes = orders.select("route", F.explode(plans).alias("p")).select("route", "p.*")
    none = F.array().cast("array<string>")
    first = F.when(F.col("a") == 0, "succeeded").when(F.col("a") == 1, "failed").otherwise("quality_failed")
    record = lambda p, status, checks, cost: F.struct(F.lit(p).alias("parser_id"), status.alias("status"), checks.alias("failed_checks"), F.lit(cost).alias("cost"))
    runs = F.array(
        record("p0", F.when(F.col("c") != 4, first), F.when(F.col("a") == 3, F.array(F.lit("structure"))).otherwise(none), 5),
        record("p1", F.when(F.col("b") == 0, "succeeded").otherwise("quality_failed"), F.array(F.lit("text")), 3),
        record("p2", F.lit("succeeded"), none, 50),
    )
    recorded = orders.select("route", F.explode(runs).alias("r")).select("route", "r.*").where("status is not null")
    return L.parse_attempts(routes, recorded, 20).select("route", F.col("position").cast("int").alias("position"), "outcome", "reason")


@query("table_quality", """
    WITH h AS (SELECT s_nationkey AS table_id, CASE WHEN s_suppkey % 11 = 0 THEN '  ' ELSE 'h' || CAST(s_suppkey % 40 AS VARCHAR) END AS header FROM supplier),
    s AS (SELECT table_id, count(*) AS columns, count(DISTINCT header) = count(*) AND count(*) FILTER (trim(header) = '') = 0 AS ok FROM h GROUP BY 1)
    SELECT table_id, columns, CASE WHEN ok THEN 1.0 ELSE 0.75 END AS score, ok AS passed FROM s
    """)
def table_quality(spark, sf_dir):
    return L.table_quality(_headers(spark, sf_dir))


def _headers(spark, sf_dir):
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("table_id"), key.alias("column_index"), F.when(key % 11 == 0, "  ").otherwise(F.concat(F.lit("h"), (key % 40).cast("string"))).alias("header"))


@query("table_gaps", """
    WITH h AS (SELECT s_nationkey AS table_id, CASE WHEN s_suppkey % 11 = 0 THEN '  ' ELSE 'h' || CAST(s_suppkey % 40 AS VARCHAR) END AS header FROM supplier),
    s AS (SELECT table_id, count(*) AS n, count(DISTINCT header) = count(*) AND count(*) FILTER (trim(header) = '') = 0 AS ok FROM h GROUP BY 1)
    SELECT table_id, CASE WHEN ok THEN n ELSE 0 END AS cells, CASE WHEN NOT ok THEN 'table_quality_failed' END AS reason FROM s
    """)
def table_gaps(spark, sf_dir):
    headers = _headers(spark, sf_dir)
    kept, gaps = L.usable_tables(headers, L.table_quality(headers))
    return kept.groupBy("table_id").agg(F.count(F.lit(1)).alias("cells"), F.lit(None).cast("string").alias("reason")).unionByName(gaps.select("table_id", F.lit(0).cast("long").alias("cells"), "reason"))


@query("one_to_one", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def one_to_one(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return L.one_to_one(orders.select("o_orderkey", "o_custkey"), orders.select("o_orderkey", "o_orderpriority"), "o_orderkey")


@query("scope_predicates", "SELECT p_brand AS constraint_id, count(*) AS rows, 'unverified' AS state FROM part GROUP BY 1")
def scope_predicates(spark, sf_dir):
    return L.unverified(table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("constraint_id")).agg(F.count(F.lit(1)).alias("rows")))


@query("page_loop", """
    WITH p AS (SELECT user_id, event_id AS page, CAST(floor(value + 0.5) AS INT) AS results, CAST(floor(value * 10 + 0.5) AS INT) AS bytes, CASE WHEN event_id % 17 = 0 THEN 't' ELSE 't' || CAST(event_id AS VARCHAR) END AS token, CASE WHEN event_id % 13 = 0 THEN NULL ELSE 'n' END AS next_token FROM events),
    r AS (SELECT *, row_number() OVER w AS n, coalesce(sum(results) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had, sum(bytes) OVER (w ROWS UNBOUNDED PRECEDING) AS b, lag(next_token) OVER w AS asked,
                 EXISTS (SELECT 1 FROM p q WHERE q.user_id = p.user_id AND q.page < p.page AND q.token = p.token) AS seen FROM p WINDOW w AS (PARTITION BY user_id ORDER BY page)),
    s AS (SELECT *, CASE WHEN n > 1 AND asked IS NULL THEN 'end' WHEN n > 8 THEN 'page_limit' WHEN had >= 200 THEN 'result_limit' WHEN seen THEN 'repeated_token' WHEN b > 3000 THEN 'byte_limit' END AS stop FROM r),
    f AS (SELECT *, min(CASE WHEN stop IS NOT NULL THEN n END) OVER (PARTITION BY user_id) AS first FROM s)
    SELECT user_id, page, CASE WHEN first IS NULL OR n < first THEN 'accepted' WHEN n = first THEN stop ELSE 'not_read' END AS state,
           CAST(CASE WHEN first IS NULL OR n < first THEN least(results, 200 - had) ELSE 0 END AS BIGINT) AS taken FROM f
    """)
def page_loop(spark, sf_dir):
    """Each user's events as the recorded pages of a query."""
    i, value = F.col("event_id"), F.col("value")
    pages = table(spark, sf_dir, "events").select(
        "user_id", i.alias("page"), F.floor(value + 0.5).cast("int").alias("results"), F.floor(value * 10 + 0.5).cast("int").alias("bytes"),
        F.when(i % 17 == 0, "t").otherwise(F.concat(F.lit("t"), i.cast("string"))).alias("token"), F.when(i % 13 != 0, "n").alias("next_token"),
    )
    return L.page_loop(pages, "user_id", 8, 200, 3000).select("user_id", "page", "state", "taken")


@query("download_rules", """
    WITH r AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 206 WHEN 2 THEN 429 WHEN 3 THEN 503 WHEN 4 THEN 404 WHEN 5 THEN 201 WHEN 6 THEN 204 ELSE 200 END AS status, CASE WHEN o_orderkey % 10 = 5 THEN 'GZIP' END AS encoding,
                      CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey AS BIGINT) END AS declared, CAST(CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_custkey END + CASE WHEN o_orderkey % 8 = 6 THEN 1 ELSE 0 END AS BIGINT) AS bytes FROM orders),
    e AS (SELECT o_orderkey, status, CASE WHEN status IS NULL THEN 'timeout' WHEN status = 206 THEN 'incomplete_response' WHEN status <> 200 THEN 'http_error' WHEN encoding IS NOT NULL THEN 'content_encoding_unsupported'
                 WHEN bytes > 1000 OR coalesce(declared > 1000, false) THEN 'response_too_large' WHEN bytes = 0 THEN 'empty_response' WHEN declared IS NOT NULL AND declared <> bytes THEN 'incomplete_response' END AS error FROM r)
    SELECT o_orderkey, error, coalesce(error = 'timeout' OR (error = 'incomplete_response' AND status = 200) OR (error = 'http_error' AND status IN (429, 503)), false) AS retryable FROM e
    """)
def download_rules(spark, sf_dir):
    i, size = F.col("o_orderkey"), F.col("o_custkey").cast("long")
    status = F.when(i % 9 == 0, F.lit(None).cast("int")).when(i % 9 == 1, 206).when(i % 9 == 2, 429).when(i % 9 == 3, 503).when(i % 9 == 4, 404).when(i % 9 == 5, 201).when(i % 9 == 6, 204).otherwise(200)
    responses = table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), F.when(i % 10 == 5, "GZIP").alias("encoding"), F.when(i % 7 != 0, size).alias("declared_bytes"), (F.when(i % 11 == 0, 0).otherwise(size) + F.when(i % 8 == 6, 1).otherwise(0)).cast("long").alias("bytes"))
    return L.download_verdicts(responses, 1000).select("o_orderkey", "error", "retryable")


@query("download_chains", """
    WITH h AS (SELECT l_orderkey, l_linenumber - 1 AS hop, 'https://' || CASE WHEN l_suppkey % 9 = 0 THEN 'other.org' ELSE 'data.org' END || '/' || l_partkey AS url, CASE WHEN l_partkey % 11 <> 0 THEN 'https://data.org/' || l_suppkey END AS location,
                      CASE WHEN l_quantity > 25 THEN 302 WHEN l_quantity > 10 THEN 200 WHEN l_quantity > 5 THEN 503 ELSE 404 END AS status, CAST(l_suppkey * 10 AS BIGINT) AS bytes
          FROM (SELECT l_orderkey, l_linenumber, unnest(min(struct_pack(l_partkey := l_partkey, l_suppkey := l_suppkey, l_quantity := l_quantity))) FROM lineitem GROUP BY 1, 2)),
    s AS (SELECT *, CASE WHEN url LIKE 'https://other%' THEN 'host_not_allowed' WHEN status = 302 AND location IS NULL THEN 'redirect_blocked' WHEN status = 302 AND hop >= 3 THEN 'redirect_limit' WHEN status = 302 THEN NULL
                    WHEN status <> 200 THEN 'http_error' WHEN bytes > 900 THEN 'response_too_large' WHEN bytes = 0 THEN 'empty_response' ELSE 'none' END AS stop FROM h),
    g AS (SELECT l_orderkey, min(CASE WHEN stop IS NOT NULL THEN hop END) AS ended, count(*) AS n, arg_max_null(location, hop) AS next FROM s GROUP BY 1)
    SELECT g.l_orderkey, CASE WHEN ended IS NULL THEN next ELSE s.url END AS final_url, CAST(coalesce(ended, n) AS BIGINT) AS redirects, CASE WHEN ended IS NULL THEN 'timeout' WHEN stop <> 'none' THEN stop END AS error,
           ended IS NULL OR (stop = 'http_error' AND status = 503) AS retryable
    FROM g LEFT JOIN s ON s.l_orderkey = g.l_orderkey AND s.hop = g.ended
    """)
def download_chains(spark, sf_dir):
    """The lines of each order as the recorded answers of one request and its redirects."""
    line, part, supplier, amount = (F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    host = F.when(supplier % 9 == 0, "other.org").otherwise("data.org")
    # line numbers repeat: the least line of each number is the answer
    least = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("l"))
    hops = least.select("l_orderkey", "l_linenumber", "l.*").select(
        "l_orderkey",
        (line - 1).alias("hop"),
        F.concat(F.lit("https://"), host, F.lit("/"), part.cast("string")).alias("url"),
        F.when(part % 11 != 0, F.concat(F.lit("https://data.org/"), supplier.cast("string"))).alias("location"),
        F.when(amount > 25, 302).when(amount > 10, 200).when(amount > 5, 503).otherwise(404).alias("status"),
        F.lit(None).cast("string").alias("encoding"),
        F.lit(None).cast("long").alias("declared_bytes"),
        (supplier * 10).alias("bytes"),
    )
    return L.download_chains(hops, "l_orderkey", ["data.org"], 3, 900)


@query("graph_search", """
    WITH n AS (SELECT DISTINCT 'p' || CAST(p_partkey AS VARCHAR) AS node, p_name AS label FROM part UNION SELECT 's' || CAST(s_suppkey AS VARCHAR), s_name FROM supplier),
    e AS (SELECT DISTINCT 'p' || CAST(l_partkey AS VARCHAR) AS source, 's' || CAST(l_suppkey AS VARCHAR) AS target FROM lineitem WHERE l_quantity >= 50),
    h AS (SELECT node FROM n WHERE contains(lower(label), 'small r')), x AS (SELECT node FROM h UNION SELECT target FROM e JOIN h ON source = node UNION SELECT source FROM e JOIN h ON target = node)
    SELECT source, target FROM e WHERE source IN (SELECT node FROM x) AND target IN (SELECT node FROM x)
    """)
def graph_search(spark, sf_dir):
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    parts = table(spark, sf_dir, "part").select(name("p", "p_partkey").alias("node"), F.col("p_name").alias("label"), F.lit("").alias("original"))
    suppliers = table(spark, sf_dir, "supplier").select(name("s", "s_suppkey").alias("node"), F.col("s_name").alias("label"), F.lit("").alias("original"))
    edges = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(name("p", "l_partkey").alias("source"), name("s", "l_suppkey").alias("target")).distinct()
    return L.search_graph(parts.unionByName(suppliers), edges, " SMALL r ")[1]


MERGE_SQL = """
    WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h, doc_id % 4 AS k, doc_id % 50 = 0 AS shared FROM documents WHERE text IS NOT NULL),
    r AS (SELECT doc_id, h, CASE WHEN k IN (0, 1) THEN '10.5555/' || h[1:20] END AS doi, CASE WHEN shared THEN 'https://h.org/shared' WHEN k IN (1, 2) THEN 'https://h.org/' || h[1:20] END AS url FROM d),
    -- a text's records share a DOI or an address, and one record with both ties the two together
    t AS (SELECT h, bool_or(doi IS NOT NULL AND url IS NOT NULL AND url <> 'https://h.org/shared') AS tied FROM r GROUP BY h),
    g AS (SELECT r.*, CASE WHEN doi IS NOT NULL THEN 'd' || h WHEN url = 'https://h.org/shared' THEN 'shared' WHEN url IS NOT NULL THEN CASE WHEN tied THEN 'd' || h ELSE 'u' || h END END AS strong FROM r JOIN t USING (h)),
    s AS (SELECT *, CASE WHEN strong = 'shared' THEN coalesce((SELECT strong FROM g x WHERE x.url = 'https://h.org/shared' AND x.doi IS NOT NULL ORDER BY x.doi, x.doc_id LIMIT 1), 'shared') ELSE strong END AS root FROM g),
    w AS (SELECT h, count(DISTINCT root) AS n, min(root) AS one FROM s WHERE root IS NOT NULL GROUP BY h),
    c AS (SELECT s.doc_id, s.doi, s.url, s.h, CASE WHEN root IS NOT NULL THEN root WHEN n = 1 THEN one WHEN n > 1 THEN 'lone' || CAST(s.doc_id AS VARCHAR) ELSE 'w' || s.h END AS grp FROM s LEFT JOIN w USING (h))
"""


def _records(spark, sf_dir):
    """Documents as discovery records: a DOI, an address, both or neither by id, copies share them; some ids share an
    address whatever their text."""
    i, sha = F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256)
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", sha.alias("h"), (i % 4).alias("k"), (i % 50 == 0).alias("shared"))
    short = F.left("h", F.lit(20))
    return docs.select(
        F.col("doc_id").alias("record_id"), F.col("h").alias("title"), F.when(F.col("k").isin(0, 1), F.concat(F.lit("DOI: 10.5555/"), short)).alias("doi"),
        F.when(F.col("shared"), "https://H.org/shared?utm_source=x").when(F.col("k").isin(1, 2), F.concat(F.lit("https://h.org/"), short, F.lit("#top"))).alias("url"), F.lit(2020).alias("year"),
    )


@query("merge_records", MERGE_SQL + "SELECT CAST(count(*) AS BIGINT) AS records, min(doc_id) AS lowest FROM c GROUP BY grp")
def merge_records(spark, sf_dir):
    found = M.merge_records(_records(spark, sf_dir).orderBy(F.rand(3)))
    return found.groupBy("candidate").agg(F.count(F.lit(1)).alias("records"), F.min("record_id").alias("lowest")).select("records", "lowest")


def _members(spark, sf_dir):
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.coalesce("source", F.lit("none")).alias("candidate"), (F.col("lang") == "de").alias("primary_source"), (i % 10).alias("rank"), F.concat(F.lit("Title "), i.cast("string")).alias("title"),
        F.coalesce("lang", F.lit("?")).alias("source_id"), i.cast("string").alias("external_id"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("date").alias("published"),
        F.when(i % 3 == 0, "MIT").when(i % 3 == 1, "mit").alias("license"), F.array(F.concat(F.lit("f"), (i % 4).cast("string"))).alias("formats"), F.lit("open").alias("access"),
        F.array(F.concat(F.lit("field"), (i % 5).cast("string")), F.lit("all")).alias("target_fields"), (i % 100).cast("string").alias("evidence_id"),
    )


@query("candidate_build", """
    WITH m AS (SELECT coalesce(source, 'none') AS candidate, coalesce(lang = 'de', false) AS prime, lang IS NULL AS odd, doc_id % 10 AS rank, doc_id, doc_id % 3 <> 2 AS licensed, coalesce(lang, '?') AS source_id, doc_id % 3 AS l, doc_id % 4 AS f FROM documents),
    b AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY CASE WHEN odd THEN 0 WHEN prime THEN 1 ELSE 2 END, rank, CASE WHEN licensed THEN 0 ELSE 1 END, 'title ' || CAST(doc_id AS VARCHAR)) AS r FROM m)
    SELECT candidate, max(CASE WHEN r = 1 THEN 'Title ' || CAST(doc_id AS VARCHAR) END) AS title, count(*) AS records, CASE WHEN bool_or(l = 1) AND bool_or(l = 0) THEN 'MIT,mit' WHEN bool_or(l = 0) THEN 'MIT' WHEN bool_or(l = 1) THEN 'mit' ELSE '' END AS licenses,
           array_to_string(list_sort(list(DISTINCT 'f' || CAST(f AS VARCHAR))), ',') AS formats, array_to_string(list_sort(list(DISTINCT source_id)), ',') AS sources FROM b GROUP BY candidate
    """)
def candidate_build(spark, sf_dir):
    built = M.build_candidates(_members(spark, sf_dir))
    return built.select("candidate", "title", "records", *[F.array_join(c, ",").alias(c) for c in ("licenses", "formats", "sources")])


@query("coverage_claims", """
    WITH m AS (SELECT coalesce(source, 'none') AS candidate, doc_id, unnest(['field' || CAST(doc_id % 5 AS VARCHAR), 'all']) AS field_name FROM documents)
    SELECT candidate, field_name, 'probable' AS assessment, 0.35 AS confidence, count(DISTINCT doc_id % 100) AS evidence, min(CAST(doc_id % 100 AS VARCHAR)) AS first_evidence FROM m GROUP BY 1, 2
    """)
def coverage_claims(spark, sf_dir):
    return M.coverage_claims(_members(spark, sf_dir))


def _place(spark, name: str) -> str:
    return f"{shared_base(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("byte_store", "SELECT sha256(text) AS sha256, CAST(max(strlen(text)) AS BIGINT) AS size_bytes FROM documents WHERE text IS NOT NULL GROUP BY 1")
def byte_store(spark, sf_dir):
    """Every text into a byte store, in two overlapping loads, and back through the check on read."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), _place(spark, "bytes")
    B.put_bytes(docs.where("doc_id % 3 <> 0"), "text", path)
    B.put_bytes(docs, "text", path)
    return B.get_bytes(spark, path).select(F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size_bytes"))


@query("vector_upsert", "SELECT CAST(vec_id AS VARCHAR) AS document_id, CASE WHEN vec_id % 2 = 0 THEN 'second' ELSE 'first' END AS text, len(embedding) AS dimensions FROM embeddings")
def vector_upsert(spark, sf_dir):
    """All vectors, then those of even ids again with another text."""
    path, none = _place(spark, "vectors"), F.lit(None).cast("string")
    rows = lambda df, text: df.select(F.col("vec_id").cast("string").alias("document_id"), F.lit(text).alias("text"), F.col("embedding").alias("vector"), *[none.alias(c) for c in ("evidence_id", "task_id", "source_hash", "field_name", "location")])
    vectors = table(spark, sf_dir, "embeddings")
    B.upsert_vectors(rows(vectors, "first"), path)
    B.upsert_vectors(rows(vectors.where("vec_id % 2 = 0"), "second"), path)
    return B.read_version(spark, path).select("document_id", "text", F.size("vector").cast("long").alias("dimensions"))


@query("checkpoint_replay", "SELECT o_custkey, count(*) AS orders, 'conflict' AS other FROM orders GROUP BY 1")
def checkpoint_replay(spark, sf_dir):
    """A result kept under a key, replayed, and refused where another one comes under the same key."""
    import hashlib

    path, key = _place(spark, "checkpoints"), hashlib.sha256(b"orders").hexdigest()
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    B.checkpoint(counts, path, key)
    again = B.checkpoint(counts, path, key)
    try:
        B.checkpoint(counts.withColumn("orders", F.col("orders") + 1), path, key)
        other = "taken"
    except B.Conflict:
        other = "conflict"
    return again.withColumn("other", F.lit(other))


@query("preview_flags", """
    SELECT CAST(s_suppkey AS BIGINT) AS row_index, c AS column_index, v AS decoded, (SELECT count(*) FROM supplier) > 20 OR true AS truncated FROM (
      SELECT s_suppkey, 0 AS c, CAST(s_suppkey AS VARCHAR) AS v FROM supplier UNION ALL SELECT s_suppkey, 1, s_name FROM supplier) WHERE s_suppkey < 20
    """)
def preview_flags(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    return C.preview_with_flag(C.unpivot(supplier, F.col("s_suppkey"), ["s_suppkey", "s_name", "s_nationkey"]), 20, 2).select("row_index", "column_index", "decoded", "truncated")


@query("license_decision", """
    SELECT doc_id, CASE WHEN lang = 'es' THEN 'restricted' WHEN lang = 'en' AND source IS DISTINCT FROM 'src1' THEN 'allowed' ELSE 'needs_review' END AS decision FROM documents
    """)
def license_decision(spark, sf_dir):
    """Open access with a marked label, open beside restricted access and unknown access all need a review."""
    docs = table(spark, sf_dir, "documents")
    labels = F.when(F.col("source") == "src1", F.array(F.lit("MIT"), F.lit("All Rights Reserved"))).when(F.col("lang").isin("en", "de") | F.col("lang").isNull(), F.array(F.lit("MIT"))).otherwise(F.array().cast("array<string>"))
    mixed, unknown = F.array(F.lit("open"), F.lit("restricted")), F.array().cast("array<string>")
    access = F.when(F.col("lang") == "es", F.array(F.lit("restricted"))).when(F.col("lang") == "de", mixed).when(F.col("lang").isNull(), unknown).otherwise(F.array(F.lit("open")))
    return docs.select("doc_id", D.license_decision(labels, access).alias("decision"))
