"""Queries of the file sources and streams on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.functions.values import backoff, canonical_hash
from tracewell.operators import causality as A
from tracewell.plans.registry import Registry
from tracewell.session import shared_base, table
from tracewell.sinks import evidence_table as E
from tracewell.sinks.catalog import Catalog
from tracewell.sources import files as S
from tracewell.sources import markup as M
from tracewell.streaming import events as V
from tracewell.streaming import stateful as U

REGISTRY = Registry()
query = REGISTRY.query


@query("json_records", """
    SELECT event_id, 'k' AS header, regexp_extract(props, '"k": ([0-9]+)', 1) AS value_json FROM events
    """)
def json_records(spark, sf_dir):
    """Each event's properties as one record; numbers keep their lexeme."""
    files = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), F.encode(F.concat(F.lit("["), "props", F.lit("]")), "UTF-8").alias("content"))
    parsed = S.parse_files(files, S.json_records, S.PREVIEW)
    return parsed.where("failure is null").select(F.col("path").cast("long").alias("event_id"), "header", "value_json")


@query("text_paragraphs", r"""
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS i FROM l),
    o AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b0, regexp_matches(line, '[^\x09-\x0D\x20]') AS filled FROM e),
    g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, filled ORDER BY i) AS grp FROM o),
    p AS (SELECT doc_id, grp, CAST(min(b0) AS BIGINT) AS start_byte, CAST(max(b0 + strlen(line)) AS BIGINT) AS end_byte, string_agg(line, chr(10) ORDER BY i) AS t FROM g WHERE filled GROUP BY 1, 2)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_byte) - 1 AS block_index, start_byte, end_byte, sha256(t) AS text_sha256 FROM p
    """)
def text_paragraphs(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return S.parse_files(files, S.paragraphs, S.BLOCKS).where("kind is not null").select(F.col("path").cast("long").alias("doc_id"), "block_index", "start_byte", "end_byte", F.sha2("text", 256).alias("text_sha256"))


@query("csv_cells", """
    SELECT row_index, column_index, decoded FROM (
      SELECT s_suppkey AS row_index, 0 AS column_index, CAST(s_suppkey AS VARCHAR) AS decoded FROM supplier UNION ALL SELECT s_suppkey, 1, s_name || ', "' || s_nationkey || '"' FROM supplier)
    """)
def csv_cells(spark, sf_dir):
    """Suppliers as small CSV files, one each, back to cells: quotes, doubled quotes and delimiters inside."""
    line = F.concat(F.col("s_suppkey").cast("string"), F.lit(',"'), "s_name", F.lit(', ""'), F.col("s_nationkey").cast("string"), F.lit('"""\r\n'))
    files = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), F.encode(line, "UTF-8").alias("content"))
    return S.parse_files(files, S.delimited_cells, S.CELLS).select(F.col("path").cast("long").alias("row_index"), "column_index", "decoded")


@query("html_blocks")
def html_blocks(spark, sf_dir):
    return S.with_html_blocks(table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", "block_index", "kind", F.sha2("text", 256).alias("text_sha256"))


@query("attachment_links", """
    WITH p AS (SELECT page_id, regexp_extract(url, '^(https://[^/?#]+)', 1) AS site FROM pages WHERE html IS NOT NULL)
    SELECT page_id, site || '/files/d' || CAST(page_id AS VARCHAR) || '.CSV?x=1' AS url FROM p WHERE site <> '' UNION ALL SELECT page_id, 'https://data.example.org/raw' FROM p WHERE page_id % 2 = 0
    """)
def attachment_links(spark, sf_dir):
    """The pages' own anchors name no files; each page gets some that do, once within the site and once elsewhere."""
    i = F.col("page_id").cast("string")
    file = F.concat(F.lit('<a class="x" href="/files/d'), i, F.lit('.CSV?x=1">'))
    more = F.concat(file, file, F.when(F.col("page_id") % 2 == 0, '<a href="https://data.example.org/raw" download>').otherwise('<a href="https://data.example.org/raw" data-x="download">'), F.lit('<a href="http://data.example.org/a.csv"><a href="//x.org/b.csv">'))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(S.attachment_links(F.concat("html", more), F.col("url"), most=64)).alias("url"))


@query("media_types", """
    SELECT page_id, CASE WHEN regexp_matches(lower(ltrim(coalesce(html, ''), chr(9) || chr(10) || chr(13) || ' ')), '^(<!doctype html|<html|<head|<body)') THEN 'text/html' ELSE 'other' END AS media FROM pages
    """)
def media_types(spark, sf_dir):
    media = S.text_media(F.coalesce("html", F.lit("")))
    return table(spark, sf_dir, "pages").select("page_id", F.when(media == "text/html", media).otherwise("other").alias("media"))


@query("format_detection", """
    SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'csv' WHEN page_id % 3 = 0 THEN 'json' END AS format FROM pages
    """)
def format_detection(spark, sf_dir):
    i = F.col("page_id")
    media = F.when(i % 2 == 0, "text/csv").otherwise("application/octet-stream")
    url = F.when(i % 3 == 0, "https://x.org/a.GeoJSON?x=1").otherwise("https://x.org/a.bin")
    return table(spark, sf_dir, "pages").select("page_id", S.format_of(media, url).alias("format"))


@query("canonical_hashes", "SELECT event_id, sha256('{\"k\":' || regexp_extract(props, '\"k\": ([0-9]+)', 1) || '}') AS hash FROM events")
def canonical_hashes(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", canonical_hash(F.col("props")).alias("hash"))


@query("backoff_delays", "SELECT l_linenumber, least(20.0, 0.5 * power(2.0, l_linenumber - 1)) AS delay, count(*) AS n FROM lineitem GROUP BY ALL")
def backoff_delays(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber", backoff(F.col("l_linenumber"), 0.5, 20.0).alias("delay")).agg(F.count(F.lit(1)).alias("n"))


@query("retry_delays", """
    SELECT event_id, CASE WHEN event_id % 4 = 0 THEN least(20.0, CAST(event_id % 30 AS DOUBLE)) ELSE least(20.0, greatest(0.0, least(20.0, 0.5 * power(2.0, event_id % 8)) * (1 + 0.2 * (2 * (event_id % 11) / 10.0::DOUBLE - 1)))) END AS delay FROM events
    """)
def retry_delays(spark, sf_dir):
    i = F.col("event_id")
    delay = backoff(i % 8 + 1, 0.5, 20.0, (i % 11) / 10, 0.2, F.when(i % 4 == 0, (i % 30).cast("string")).when(i % 4 == 1, "soon"))
    return table(spark, sf_dir, "events").select("event_id", delay.alias("delay"))


@query("windowed_events", """
    SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL
    """)
def windowed_events(spark, sf_dir):
    return V.windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("idempotent_replay", "SELECT user_id, count(*) AS events FROM events GROUP BY 1")
def idempotent_replay(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return V.idempotent(events.unionAll(events), "event_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))


@query("latest_state", "SELECT user_id, arg_max(event_type, struct_pack(ts := ts, event_id := event_id)) AS event_type FROM events GROUP BY 1")
def latest_state(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"))
    return V.latest_state(events, "user_id", "at", "event_type").select("user_id", "event_type")


@query("job_states", """
    WITH RECURSIVE q AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
    f AS (SELECT user_id, CAST(0 AS BIGINT) AS r, CAST(NULL AS VARCHAR) AS s, CAST(0 AS BIGINT) AS refused FROM (SELECT DISTINCT user_id FROM q)
          UNION ALL SELECT user_id, r, CASE WHEN ok THEN new ELSE old END, refused + CASE WHEN ok THEN 0 ELSE 1 END
          FROM (SELECT q.user_id, q.r, f.s AS old, q.s AS new, f.refused, coalesce((f.s IS NULL AND q.s = 'queued') OR (f.s = 'queued' AND q.s = 'running') OR (f.s = 'running' AND q.s IN ('succeeded', 'failed')), false) AS ok FROM f JOIN q ON q.user_id = f.user_id AND q.r = f.r + 1))
    SELECT user_id, arg_max(coalesce(s, '-'), r) AS state, max(refused) AS refused FROM f GROUP BY 1
    """)
def job_states(spark, sf_dir):
    kind = F.col("event_type")
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(kind == "view", "queued").when(kind == "click", "running").when(kind == "purchase", "succeeded").otherwise("failed").alias("state"))
    return V.job_states(events, "user_id", "event_id", "state").withColumn("state", F.coalesce("state", F.lit("-")))


@query("circuit_breaker", """
    WITH RECURSIVE q AS (SELECT user_id, event_id, ts, value > 30 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
    f AS (SELECT user_id, r, event_id, 'closed' AS state, CASE WHEN ok THEN 0 ELSE 1 END AS fails, CAST(NULL AS TIMESTAMP) AS till FROM q WHERE r = 1
          UNION ALL SELECT user_id, r, event_id, state, CASE WHEN state = 'open' THEN fails WHEN ok THEN 0 ELSE fails + 1 END,
                           CASE WHEN state = 'open' THEN till WHEN ok THEN NULL WHEN fails + 1 >= 3 OR state = 'half_open' THEN ts + INTERVAL 24 HOUR ELSE till END
          FROM (SELECT q.*, f.fails, f.till, CASE WHEN f.till IS NULL THEN 'closed' WHEN q.ts < f.till THEN 'open' ELSE 'half_open' END AS state FROM f JOIN q ON q.user_id = f.user_id AND q.r = f.r + 1))
    SELECT user_id, event_id, state FROM f
    """)
def circuit_breaker(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("value") > 30).alias("ok"))
    return V.breaker(events, "user_id", "ok", "ts", 3, 3600 * 24).select("user_id", "event_id", "state")


@query("causal_log", """
    WITH RECURSIVE e AS (SELECT event_id, CASE WHEN event_id % 1000 = 3 THEN event_id + 1 WHEN event_id % 1000 = 4 THEN event_id - 1 WHEN event_id % 997 = 5 THEN -1 - event_id WHEN event_id % 400 <> 0 THEN event_id - 1 - event_id % 3 END AS cause FROM events),
    f AS (SELECT event_id, event_id AS root, CAST(0 AS BIGINT) AS depth, cause IS NOT NULL AS orphan FROM e WHERE cause IS NULL OR cause NOT IN (SELECT event_id FROM e)
          UNION ALL SELECT e.event_id, f.root, f.depth + 1, f.orphan FROM f JOIN e ON e.cause = f.event_id)
    SELECT e.event_id, f.root, f.depth, CASE WHEN f.event_id IS NULL THEN 'cycle' WHEN f.orphan THEN 'orphan' ELSE 'rooted' END AS state FROM e LEFT JOIN f USING (event_id)
    """)
def causal_log(spark, sf_dir):
    """Events caused by one just before, by rule, with causes that are missing and pairs that cause each other."""
    i = F.col("event_id")
    cause = F.when(i % 1000 == 3, i + 1).when(i % 1000 == 4, i - 1).when(i % 997 == 5, -1 - i).when(i % 400 != 0, i - 1 - i % 3)
    return A.causes(table(spark, sf_dir, "events").select("event_id", cause.alias("cause")), "event_id", "cause")


BREAKER_SQL = """
    WITH RECURSIVE q AS (SELECT user_id, event_id, epoch_ms(ts) AS tm, value > 30 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS r FROM events),
    z AS (SELECT max(tm) AS stop FROM q),
    f AS (SELECT user_id, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS tm, CAST(NULL AS VARCHAR) AS state, 0 AS fails, CAST(NULL AS BIGINT) AS till, false AS probed, CAST(NULL AS BIGINT) AS probe FROM (SELECT DISTINCT user_id FROM q)
          UNION ALL
          SELECT user_id, r, event_id, tm, state, CASE WHEN state = 'open' THEN fails WHEN ok THEN 0 ELSE fails + 1 END,
                 CASE WHEN state = 'open' THEN till WHEN ok THEN NULL WHEN fails + 1 >= 3 OR state = 'half_open' THEN tm + 86400000 ELSE till END,
                 CASE WHEN state <> 'open' AND NOT ok AND (fails + 1 >= 3 OR state = 'half_open') THEN false ELSE probed OR probe IS NOT NULL END, probe
          FROM (SELECT *, CASE WHEN till IS NULL THEN 'closed' WHEN tm < till THEN 'open' ELSE 'half_open' END AS state
                FROM (SELECT q.user_id, q.r, q.event_id, q.tm, q.ok, f.probed, CASE WHEN f.tm IS NOT NULL AND q.tm - f.tm > 259200000 THEN 0 ELSE f.fails END AS fails,
                             CASE WHEN f.tm IS NOT NULL AND q.tm - f.tm > 259200000 THEN NULL ELSE f.till END AS till,
                             CASE WHEN f.till IS NOT NULL AND NOT f.probed AND f.till <= least(q.tm, f.tm + 259200000) THEN f.till END AS probe
                      FROM f JOIN q ON q.user_id = f.user_id AND q.r = f.r + 1)))
    SELECT user_id, event_id, tm AS at_ms, state FROM f WHERE r > 0
    UNION ALL SELECT user_id, NULL, probe, 'probe' FROM f WHERE probe IS NOT NULL
    UNION ALL SELECT user_id, NULL, till, 'probe' FROM (SELECT user_id, arg_max_null(till, r) AS till, arg_max(probed, r) AS probed, max(tm) AS last FROM f GROUP BY 1), z WHERE till IS NOT NULL AND NOT probed AND till <= least(stop - 1000, last + 259200000)
"""


@query("breaker_stream", BREAKER_SQL)
def breaker_stream(spark, sf_dir):
    """Events as attempts of a stream that comes in four pieces and is started anew from its checkpoint for each: the
    states of all attempts, and when probes may go."""
    base = f"{shared_base(spark)}/breaker-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("value") > 30).alias("ok"))
    for _ in U.deal_by_time(events, "ts", f"{base}/in", 4):
        source = spark.readStream.schema(events.schema).option("recursiveFileLookup", True).parquet(f"{base}/in")
        U.run_to_end(U.breaker_stream(source, "user_id", "event_id", "ok", "ts", 3, 86_400, 259_200, "1 second"), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out")


@query("catalog_commit", """
    WITH d AS (SELECT doc_id, sha256(text) AS h, octet_length(encode(text)) AS size, lang, source FROM documents),
    v AS (SELECT 1 AS version, * FROM d WHERE doc_id % 2 = 0 UNION ALL SELECT 2, * FROM d)
    SELECT CAST(version AS BIGINT) AS version, count(DISTINCT h) AS artifacts, CAST(sum(size) FILTER (first) AS BIGINT) AS stored_bytes, count(h) AS acquisitions, count(*) - count(h) AS failures, count(DISTINCT source) AS reflections,
           count(h) FILTER (source IS NOT NULL) AS qualifications
    FROM (SELECT *, h IS NOT NULL AND row_number() OVER (PARTITION BY version, h) = 1 AS first FROM v) GROUP BY 1
    """)
def catalog_commit(spark, sf_dir):
    """Documents as acquisitions: half of them in one commit, then all; texts are artifacts, null texts failures."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    i, sha, url = F.col("doc_id").cast("string"), F.sha2("text", 256), F.concat(F.lit("https://data.org/"), F.col("doc_id").cast("string"))
    locator = F.sha2(url, 256)

    def parts(rows):
        there, asked = rows.where("text is not null"), rows.where("source is not null")
        return {
            "artifacts": there.select(sha.alias("byte_sha256"), F.octet_length("text").cast("long").alias("size_bytes"), F.lit("text/plain").alias("media_type"), F.lit("text").alias("artifact_kind"), F.concat(F.lit("store/"), sha).alias("storage_uri")),
            "acquisitions": there.select(F.concat(F.lit("stored-"), i).alias("event_id"), locator.alias("locator_hash"), sha.alias("byte_sha256"), url.alias("source_url"), F.coalesce("source", F.lit("")).alias("source_title"), F.lit("stored").alias("status")),
            "failures": rows.where("text is null").select(F.concat(F.lit("failed-"), i).alias("event_id"), locator.alias("locator_hash"), url.alias("source_url"), F.coalesce("source", F.lit("")).alias("source_title"), F.lit("empty_response").alias("error_code"), F.lit(False).alias("retryable")),
            "reflections": asked.select("source").distinct().select(F.sha2("source", 256).alias("proof_hash"), F.lit(1).alias("iteration"), F.col("source").alias("input_query"), F.lit("").alias("gaps"), F.lit("stop").alias("decision"), F.lit(None).cast("string").alias("next_query"), F.lit(1).alias("useful_artifact_count")),
            "qualifications": asked.where("text is not null").select(F.concat(F.lit("q-"), i).alias("qualification_id"), F.sha2("source", 256).alias("reflection_proof_hash"), sha.alias("byte_sha256"), F.lit(0.5).alias("confidence"), F.lit(True).alias("accepted"), F.lit("").alias("rationale")),
        }

    catalog = Catalog(spark, f"{shared_base(spark)}/catalog-{uuid.uuid4().hex}")
    catalog.commit(parts(docs.where("doc_id % 2 = 0")))
    catalog.commit(parts(docs))
    return catalog.summary(1).unionByName(catalog.summary())


@query("html_spans")
def html_spans(spark, sf_dir):
    """The text blocks of whole pages with the bytes they stand in."""
    return M.html_spans(table(spark, sf_dir, "pages"), "page_id", "html")


@query("evidence_table", """
    WITH r AS (SELECT sha256('nation-' || CAST(s_nationkey AS VARCHAR)) AS h, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS row_index, s_suppkey, s_name, s_acctbal FROM supplier),
    c AS (SELECT *, unnest([1, 2, 3]) AS i FROM r)
    SELECT 'ds_' || h[1:16] AS dataset_id, 'https://data.org/' || CAST(s_nationkey AS VARCHAR) || '.csv' AS source_url, h AS artifact_sha256, row_index AS source_row, i AS source_column_index,
           '"' || ['s_suppkey', 's_name', 's_acctbal'][i] || '"' AS source_column_json, CASE i WHEN 1 THEN '"supplier_id"' WHEN 2 THEN '"name"' ELSE 'null' END AS target_field_json,
           CASE WHEN i < 3 THEN 'mapped' ELSE 'unmapped' END AS mapping_status, CASE WHEN i < 3 THEN 'exact' ELSE 'none' END AS mapping_method,
           CASE i WHEN 1 THEN '"' || CAST(s_suppkey AS VARCHAR) || '"' WHEN 2 THEN '"' || s_name || '"' ELSE '"' || CAST(CAST(s_acctbal AS DECIMAL(18, 2)) AS VARCHAR) || '"' END AS raw_value_json,
           'evd_' || sha256(concat(h, chr(1), row_index, chr(1), i))[1:32] AS evidence_id, '"line ' || CAST(row_index + 1 AS VARCHAR) || '"' AS source_location_json FROM c
    """)
def evidence_table(spark, sf_dir):
    """The suppliers of each nation as one file of three columns, two of them mapped."""
    names = ["s_suppkey", "s_name", "s_acctbal"]
    row = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).cast("long")
    rows = table(spark, sf_dir, "supplier").withColumns({"artifact_sha256": F.sha2(F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")), 256), "row_index": row})
    values = [F.col("s_suppkey").cast("string"), F.col("s_name"), F.col("s_acctbal").cast("decimal(18,2)").cast("string")]
    each = F.explode(F.array(*(F.struct(F.lit(i + 1).alias("column_index"), E.json_text(v).alias("raw_json")) for i, v in enumerate(values)))).alias("c")
    cells = rows.select("artifact_sha256", F.concat(F.lit("ds_"), F.left("artifact_sha256", F.lit(16))).alias("dataset_id"), "row_index", each, F.concat(F.lit("line "), (F.col("row_index") + 1).cast("string")).alias("location"))
    cells = cells.select("artifact_sha256", "dataset_id", "row_index", "c.*", "location")
    artifacts = rows.select("artifact_sha256", F.concat(F.lit("https://data.org/"), F.col("s_nationkey").cast("string"), F.lit(".csv")).alias("source_url")).distinct()
    plan = spark.createDataFrame([(i + 1, n, t, "mapped" if t else "unmapped", "exact" if t else "none") for i, (n, t) in enumerate(zip(names, ("supplier_id", "name", None), strict=True))], "column_index int, source_column string, target_field string, status string, method string")
    decisions = artifacts.select("artifact_sha256").crossJoin(plan)  # three rows for each file
    columns = decisions.select("artifact_sha256", "column_index", F.col("source_column").alias("header"))
    return E.evidence_table(cells, columns, artifacts, decisions)
