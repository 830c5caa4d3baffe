"""Queries of windows, rankings, folds, coverage and selection on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import discovery as D
from tracewell.operators.greedy import Policy, select_sources as select_by_gain
from tracewell.operators import ranking as W
from tracewell.operators import reports as O
from tracewell.plans.registry import Registry
from tracewell.session import table

REGISTRY = Registry()
query = REGISTRY.query


@query("first_wins", "SELECT user_id, event_type, arg_min(event_id, event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2")
def first_wins(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return W.first_wins(events, ["user_id", "event_type"], [F.col("event_id")])


@query("representative", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def representative(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")
    best = W.first_wins(orders, ["o_custkey"], [F.col("o_orderpriority"), -F.col("o_totalprice"), F.col("o_orderkey")])
    return best.select("o_custkey", "o_orderkey", "o_totalprice")


@query("terminal_attempt", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def terminal_attempt(spark, sf_dir):
    return W.terminal(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], F.col("o_orderkey"))


@query("running_rank", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem")
def running_rank(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return W.running_rank(lines, ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber")]).select("l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"))


@query("round_robin", """
    WITH r AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS turn FROM events),
    f AS (SELECT user_id, min(struct_pack(turn := turn, event_type := event_type)) AS m FROM r WHERE turn <= 50 GROUP BY user_id)
    SELECT m.turn AS turn, m.event_type AS event_type, user_id FROM f ORDER BY 1, 2 LIMIT 50
    """)
def round_robin(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "user_id", "ts", "event_id")
    return W.round_robin(events, "event_type", [F.col("ts"), F.col("event_id")], "user_id", 50).select(F.col("turn").cast("long").alias("turn"), "event_type", "user_id")


@query("islands", """
    WITH f AS (SELECT user_id, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS s, ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM f)
    SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM i GROUP BY 1, 2
    """)
def islands(spark, sf_dir):
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts").withColumn("_at", F.struct("ts", "event_id"))
    gap = F.lag("ts").over(Window.partitionBy("user_id").orderBy("_at"))
    runs = W.islands(events, "user_id", "_at", gap.isNull() | (F.col("ts") - gap > F.expr("interval 6 hours")))
    return runs.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


ROUNDS_SQL = "m AS (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) AS month, count(*) AS n FROM orders GROUP BY 1)"


def _months(spark, sf_dir):
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    return table(spark, sf_dir, "orders").groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("marginal_gain", f"WITH {ROUNDS_SQL} SELECT month, n, greatest(n - coalesce(lag(n) OVER (ORDER BY month), 0), 0) AS gain FROM m")
def marginal_gain(spark, sf_dir):
    return W.marginal_gain(_months(spark, sf_dir), "month", "n")


@query("stagnation", f"""
    WITH {ROUNDS_SQL}, g AS (SELECT month, greatest(n - coalesce(lag(n) OVER (ORDER BY month), 0), 0) AS gain FROM m)
    SELECT month, gain, count(*) OVER w = 2 AND max(gain) OVER w < 3 AND max(gain) OVER w <= 2 AS stagnant FROM g WINDOW w AS (ORDER BY month ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)
    """)
def stagnation(spark, sf_dir):
    gains = W.marginal_gain(_months(spark, sf_dir), "month", "n").select("month", "gain")
    return W.stagnant(gains, "month", "gain", "gain", least=3, few=2)


@query("in_order_share", """
    WITH p AS (SELECT user_id, ts > lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS up FROM events)
    SELECT user_id, coalesce(avg(CAST(up AS INT)), 1.0) AS in_order FROM p GROUP BY 1
    """)
def in_order_share(spark, sf_dir):
    return W.in_order_share(table(spark, sf_dir, "events"), "user_id", "event_id", "ts")


@query("greedy_budget", """
    WITH RECURSIVE q AS (SELECT p_brand, p_partkey, CAST(p_size AS DOUBLE) AS c, CAST(p_size % 7 AS DOUBLE) AS t, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part),
    f AS (SELECT p_brand, r, CASE WHEN c <= 100 AND t <= 20 THEN c ELSE 0 END AS sc, CASE WHEN c <= 100 AND t <= 20 THEN t ELSE 0 END AS st, c <= 100 AND t <= 20 AS took, p_partkey FROM q WHERE r = 1
          UNION ALL SELECT q.p_brand, q.r, CASE WHEN sc + c <= 100 AND st + t <= 20 THEN sc + c ELSE sc END, CASE WHEN sc + c <= 100 AND st + t <= 20 THEN st + t ELSE st END, sc + c <= 100 AND st + t <= 20, q.p_partkey
          FROM f JOIN q ON q.p_brand = f.p_brand AND q.r = f.r + 1)
    SELECT p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY r) - 1 AS INT) AS position, p_partkey FROM f WHERE took
    """)
def greedy_budget(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("t", F.col("p_size") % 7)
    return W.greedy_budget(part, "p_brand", [-F.col("p_retailprice"), F.col("p_partkey")], "p_partkey", "p_size", "t", 100, 20).select("p_brand", F.col("position").cast("int").alias("position"), "p_partkey")


@query("macro_f1", """
    WITH x AS (SELECT CAST(quality AS VARCHAR) AS t, CAST(1 - toxic AS VARCHAR) AS p FROM labels), l AS (SELECT t AS label FROM x UNION SELECT p FROM x),
    c AS (SELECT label, count(*) FILTER (t = label AND p = label) AS tp, count(*) FILTER (t <> label AND p = label) AS fp, count(*) FILTER (t = label AND p <> label) AS fn FROM x, l GROUP BY label)
    SELECT (SELECT count(*) FILTER (t = p) / count(*) FROM x) AS accuracy, avg(2 * tp / (2 * tp + fp + fn)) AS macro_f1 FROM c
    """)
def macro_f1(spark, sf_dir):
    return W.macro_f1(table(spark, sf_dir, "labels").withColumn("guess", 1 - F.col("toxic")), "quality", "guess")


@query("coverage_matrix", """
    WITH c AS (SELECT p_brand AS field_name, n_name AS source_type, max(l_discount * 5) AS confidence FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)
    SELECT f.p_brand AS field_name, n.n_name AS source_type, CASE WHEN confidence >= 0.3 THEN 'covered' WHEN confidence >= 0.05 THEN 'uncertain' ELSE 'uncovered' END AS state, confidence
    FROM (SELECT DISTINCT p_brand FROM part) f CROSS JOIN nation n LEFT JOIN c ON c.field_name = f.p_brand AND c.source_type = n.n_name
    """)
def coverage_matrix(spark, sf_dir):
    part, nation = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    suppliers = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_discount")
    claims = lines.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    claims = claims.select(F.col("p_brand").alias("field_name"), F.col("n_name").alias("source_type"), (F.col("l_discount") * 5).alias("confidence"))
    # fields of a contract by source types: both are rule tables, not data
    cells = part.select(F.col("p_brand").alias("field_name")).distinct().crossJoin(F.broadcast(nation.select(F.col("n_name").alias("source_type"))))
    return D.coverage(cells, claims)


@query("source_score", """
    SELECT d.doc_id, round(CAST(0.25 * CASE WHEN l.quality = 1 THEN 1.0 ELSE 0.0 END + 0.20 * CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END + 0.15 * CASE WHEN lang = 'en' THEN 1.0 WHEN lang = 'de' THEN 0.5 ELSE 0.0 END
           + 0.20 * CASE WHEN source = 'src1' THEN 1.0 WHEN source = 'src2' THEN 0.35 ELSE 0.0 END + 0.20 * CASE WHEN n_chars > 500 THEN 1.0 ELSE 0.5 END AS DOUBLE), 6) AS score
    FROM documents d LEFT JOIN labels l USING (doc_id)
    """)
def source_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    access = F.array(F.when(F.col("lang") == "en", "open").otherwise("unknown"))
    licenses = F.when(F.col("lang") == "en", F.array(F.lit("MIT"))).when(F.col("lang") == "de", F.array(F.lit("MIT"), F.lit("house rules"))).when(F.col("lang") == "fr", F.array(F.lit("MIT"), F.lit("All rights reserved"))).otherwise(F.array().cast("array<string>"))
    formats = F.when(F.col("source") == "src1", F.array(F.lit("csv"), F.lit("pdf"))).when(F.col("source") == "src2", F.array(F.lit("pdf"))).otherwise(F.array(F.lit("x")))
    score = D.source_score(F.coalesce(F.col("quality") == 1, F.lit(False)), D.access_score(access), D.license_score(licenses), D.format_score(formats), F.when(F.col("n_chars") > 500, 1.0).otherwise(0.5))
    return docs.select("doc_id", F.round(score, 6).alias("score"))


@query("keyword_routing", r"""
    WITH r(pack, term, weight) AS (VALUES ('english', 'the', 1.0), ('english', 'and', 0.5), ('french', 'le', 1.0), ('french', 'pour', 1.5), ('german', 'der', 1.0), ('german', 'und', 1.0)),
    h AS (SELECT doc_id, pack, weight FROM documents, r WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])' || term || '($|[^\p{L}\p{N}_])'))
    SELECT doc_id, pack, round(sum(weight), 6)::DOUBLE AS score, count(*) AS votes, round(least(0.99, 0.2 + 0.22 * round(sum(weight), 6)::DOUBLE + 0.08 * least(count(*), 3)), 6) AS confidence FROM h GROUP BY 1, 2
    """)
def keyword_routing(spark, sf_dir):
    rules = [("english", "the", 1.0), ("english", "and", 0.5), ("french", "le", 1.0), ("french", "pour", 1.5), ("german", "der", 1.0), ("german", "und", 1.0)]
    return D.route(table(spark, sf_dir, "documents"), "doc_id", "text", rules)


@query("select_sources", """
    WITH RECURSIVE c AS (SELECT p_brand, l_suppkey AS s, list(DISTINCT p_size) AS cells, max(s_acctbal) AS score, max(s_suppkey % 100) AS bytes FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
    x AS (SELECT p_brand, CAST(0 AS BIGINT) AS position, CAST([] AS INT[]) AS done, CAST(0 AS BIGINT) AS spent, CAST(NULL AS BIGINT) AS source_id, CAST(0 AS BIGINT) AS gain FROM (SELECT DISTINCT p_brand FROM c)
          UNION ALL SELECT p_brand, position + 1, list_concat(done, b.cells), spent + b.bytes, b.s, b.g FROM (
            SELECT x.p_brand, x.position, x.done, x.spent, arg_min(struct_pack(s := c.s, cells := c.cells, bytes := c.bytes, g := len(list_filter(c.cells, lambda v: NOT list_contains(x.done, v)))), struct_pack(a := -len(list_filter(c.cells, lambda v: NOT list_contains(x.done, v))), b := -c.score, c := c.bytes, d := c.s)) AS b
            FROM x JOIN c ON c.p_brand = x.p_brand AND x.spent + c.bytes <= 200 AND len(list_filter(c.cells, lambda v: NOT list_contains(x.done, v))) > 0 WHERE x.position < 5 GROUP BY 1, 2, 3, 4))
    SELECT p_brand, position, source_id, gain FROM x WHERE position > 0
    """)
def select_sources(spark, sf_dir):
    """Greedy cover of part sizes by suppliers, for each brand."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    claims = lines.join(part.select("p_partkey", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    claims = claims.select("p_brand", F.col("l_suppkey").alias("source_id"), F.col("p_size").alias("cell"), F.col("s_acctbal").alias("score"), (F.col("s_suppkey") % 100).alias("bytes")).distinct()
    return D.select_sources(claims, "p_brand", 5, 200)


@query("source_selection", """
    WITH RECURSIVE b AS (SELECT p_brand, l_suppkey AS s, 'f' || CAST(p_size % 6 AS VARCHAR) AS f, 't' || CAST(l_linenumber % 4 AS VARCHAR) AS t, CASE WHEN l_quantity >= 46 THEN 'covered' WHEN l_quantity >= 40 THEN 'uncertain' END AS state
                         FROM lineitem JOIN part ON l_partkey = p_partkey),
    c AS (SELECT p_brand, s, coalesce(list(DISTINCT f) FILTER (state = 'covered' AND f < 'f4'), []) AS r, coalesce(list(DISTINCT f) FILTER (state = 'uncertain' AND f < 'f4'), []) AS u, coalesce(list(DISTINCT f) FILTER (state = 'covered' AND f >= 'f4'), []) AS o,
                 coalesce(list(DISTINCT t) FILTER (state = 'covered'), []) AS t, list_filter(['c' || CAST(s % 3 AS VARCHAR), 'c' || CAST(s % 4 AS VARCHAR)], lambda x: x <> 'c3') AS cats,
                 s % 10 = 0 AS prime, s % 4 < 2 AND s % 3 <> 0 AS allowed, s % 2 = 0 AS direct, any_value(s_acctbal) AS score
          FROM b JOIN supplier ON s_suppkey = s WHERE state IS NOT NULL GROUP BY p_brand, s),
    x AS (SELECT p_brand, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS r, CAST([] AS VARCHAR[]) AS o, CAST([] AS VARCHAR[]) AS t, CAST([] AS VARCHAR[]) AS cats, false AS prime, CAST([] AS BIGINT[]) AS used, CAST(NULL AS VARCHAR) AS category, CAST(0 AS BIGINT) AS gain FROM (SELECT DISTINCT p_brand FROM c)
          UNION ALL
          SELECT p_brand, n + 1, list_distinct(list_concat(r, w.r)), list_distinct(list_concat(o, w.o)), list_distinct(list_concat(t, w.t)), CASE WHEN list_contains(cats, w.a) THEN cats ELSE list_append(cats, w.a) END, prime OR w.prime, list_append(used, w.s), w.a, CAST(w.g AS BIGINT)
          FROM (SELECT p_brand, n, r, o, t, cats, prime, used, arg_min(struct_pack(s := s, r := cr, o := co, t := ct, prime := cp, a := a, g := g1), struct_pack(a := -g1, b := -g2, c := -g3, d := -g4, e := -g5, f := -g6, g := -CAST(allowed AS INT), h := -CAST(direct AS INT), i := -score, j := s)) AS w
                FROM (SELECT x.*, c.s, c.r AS cr, c.o AS co, c.t AS ct, c.prime AS cp, c.allowed, c.direct, c.score, coalesce(list_filter(c.cats, lambda k: NOT list_contains(x.cats, k))[1], c.cats[1]) AS a,
                             len(list_filter(c.r, lambda k: NOT list_contains(x.r, k))) AS g1, len(list_filter(c.u, lambda k: NOT list_contains(x.r, k))) AS g2, CASE WHEN c.prime AND NOT x.prime THEN 1 ELSE 0 END AS g3,
                             len(list_filter(c.t, lambda k: NOT list_contains(x.t, k))) AS g4, CASE WHEN len(x.cats) < 2 AND len(list_filter(c.cats, lambda k: NOT list_contains(x.cats, k))) > 0 THEN 1 ELSE 0 END AS g5, len(list_filter(c.o, lambda k: NOT list_contains(x.o, k))) AS g6
                      FROM x JOIN c ON c.p_brand = x.p_brand AND NOT list_contains(x.used, c.s) WHERE x.n < 6 AND len(c.cats) > 0)
                WHERE g1 + g2 + g3 + g4 + g5 + g6 > 0 GROUP BY p_brand, n, r, o, t, cats, prime, used))
    SELECT p_brand, n AS position, used[len(used)] AS candidate_id, category, gain AS required_gain, gain / 4.0 AS marginal, len(r) / 4.0 AS cumulative FROM x WHERE n > 0
    """)
def source_selection(spark, sf_dir):
    """Suppliers that cover the sizes of each brand's parts, by all ten parts of the key."""
    part, supplier, lines = (table(spark, sf_dir, n) for n in ("part", "supplier", "lineitem"))
    amount, i = F.col("l_quantity"), F.col("s_suppkey")
    claims = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "p_brand",
        F.col("l_suppkey").alias("candidate_id"),
        F.concat(F.lit("f"), (F.col("p_size") % 6).cast("string")).alias("field_name"),
        F.when(amount >= 46, "covered").when(amount >= 40, "uncertain").alias("state"),
        F.array(F.concat(F.lit("t"), (F.col("l_linenumber") % 4).cast("string"))).alias("source_types"),
    )
    claims = claims.where("state is not null")
    facts = supplier.select(
        i.alias("candidate_id"),
        F.array(F.concat(F.lit("c"), (i % 3).cast("string")), F.concat(F.lit("c"), (i % 4).cast("string"))).alias("categories"),
        (i % 10 == 0).alias("primary"),
        F.when(i % 4 < 2, F.array(F.lit("MIT"))).otherwise(F.array().cast("array<string>")).alias("labels"),
        F.when(i % 3 != 0, F.array(F.lit("open"))).otherwise(F.array(F.lit("open"), F.lit("restricted"))).alias("access"),
        (i % 2 == 0).alias("direct"),
        F.col("s_acctbal").alias("score"),
    )
    facts = claims.select("p_brand", "candidate_id").distinct().join(facts, "candidate_id")
    policy = Policy(("f0", "f1", "f2", "f3"), ("f4", "f5"), ("t0", "t1", "t2", "t3"), ("c0", "c1", "c2"), 2, True, 6)
    picked = select_by_gain(claims, facts, "p_brand", policy)
    return picked.withColumn("position", F.col("position").cast("long"))


@query("latest_jobs", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def latest_jobs(spark, sf_dir):
    return O.latest(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 20)


@query("acquisition_metrics", """
    SELECT event_type, count(*) AS attempts, CAST(count(*) FILTER (value > 50) AS BIGINT) AS succeeded, CAST(sum(CASE WHEN value > 50 THEN CAST(value AS DECIMAL(18, 2)) ELSE 0 END) AS DOUBLE) AS bytes FROM events GROUP BY 1
    """)
def acquisition_metrics(spark, sf_dir):
    return O.attempt_metrics(table(spark, sf_dir, "events"), "event_type", F.col("value") > 50, F.col("value"))
