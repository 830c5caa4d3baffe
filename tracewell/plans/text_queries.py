"""Queries over documents, pages and vectors: retrieval, permissions, normalized locators, margins, upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.functions.values import stable_id
from tracewell.operators import reports as O
from tracewell.operators import retrieval as R
from tracewell.plans.registry import Registry
from tracewell.session import table
from tracewell.sinks.tables import summary

REGISTRY = Registry()
query = REGISTRY.query

TERMS = ["the", "pour", "und", "the"]

BM25_SQL = """
    WITH t AS (SELECT doc_id, regexp_extract_all(replace(lower(coalesce(text, '')), '_', ' '), '[a-z0-9]+') AS w FROM documents),
    c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'pour')) AS b, len(list_filter(w, lambda x: x = 'und')) AS c FROM t),
    s AS (SELECT count(*) AS docs, avg(n) AS avg_n FROM c),
    d AS (SELECT u AS term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS u FROM t) GROUP BY u),
    i AS (SELECT term, ln(docs - df + 0.5) - ln(df + 0.5) AS idf FROM d, s),
    f AS (SELECT 0.25 * avg(idf) AS floor FROM i),
    q AS (SELECT term, CASE WHEN idf < 0 THEN floor ELSE idf END AS idf FROM i, f),
    r AS (SELECT doc_id, 2 * coalesce((SELECT idf FROM q WHERE term = 'the'), 0) * a * 2.5 / (a + 1.5 * (0.25 + 0.75 * n / avg_n))
                 + coalesce((SELECT idf FROM q WHERE term = 'pour'), 0) * b * 2.5 / (b + 1.5 * (0.25 + 0.75 * n / avg_n))
                 + coalesce((SELECT idf FROM q WHERE term = 'und'), 0) * c * 2.5 / (c + 1.5 * (0.25 + 0.75 * n / avg_n)) AS score FROM c, s WHERE a + b + c > 0),
    b AS (SELECT doc_id, score / max(score) OVER () AS score FROM r WHERE score > 0)
"""


@query("bm25_topk", BM25_SQL + "SELECT doc_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, doc_id LIMIT 20")
def bm25_topk(spark, sf_dir):
    scored = R.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS)
    return scored.orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", F.round("score", 6).alias("score"))


@query("retrieval_topk", BM25_SQL + """,
    e AS (SELECT DISTINCT doc_id AS s, doc_id + 1 AS t FROM documents WHERE doc_id % 10 = 0),
    h AS (SELECT doc_id AS node FROM b UNION SELECT t FROM e JOIN b ON b.doc_id = e.s UNION SELECT s FROM e JOIN b ON b.doc_id = e.t)
    SELECT coalesce(b.doc_id, h.node) AS doc_id, round(0.8 * coalesce(score, 0) + 0.2 * CASE WHEN node IS NULL THEN 0 ELSE 1 END, 6) AS score
    FROM b FULL JOIN h ON b.doc_id = h.node ORDER BY 0.8 * coalesce(b.score, 0) + 0.2 * CASE WHEN node IS NULL THEN 0 ELSE 1 END DESC, 1 LIMIT 20
    """)
def retrieval_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    edges = docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("source"), (F.col("doc_id") + 1).alias("target"))
    return R.retrieve(docs, "doc_id", "text", TERMS, edges).select("doc_id", F.round("score", 6).alias("score"))


@query("permission_filter", "SELECT doc_id FROM documents WHERE coalesce(lang, 'en') IN ('en', 'fr') AND coalesce(source, 'src1') IN ('src1', 'src2')")
def permission_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_compact(F.array("lang", "source")).alias("tags"))
    return R.allowed(docs, "tags", ["en", "fr", "src1", "src2"]).select("doc_id")


@query("hash_vector", r"""
    WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{Nd}_]{2,}')) AS w FROM documents),
    h AS (SELECT doc_id, sha256(w) AS d FROM w),
    v AS (SELECT doc_id, CAST(CAST('0x' || d[1:16] AS UBIGINT) % 384 AS INT) AS dimension, sum(CASE WHEN CAST('0x' || d[17:18] AS INT) % 2 = 1 THEN -1 ELSE 1 END) AS v FROM h GROUP BY 1, 2)
    SELECT doc_id, dimension, round(v / sqrt(sum(CAST(v * v AS DOUBLE)) OVER (PARTITION BY doc_id)), 6) AS value FROM v WHERE v <> 0
    """)
def hash_vector(spark, sf_dir):
    return R.hashed_terms(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "dimension", F.round("value", 6).alias("value"))


@query("vector_topk_each", """
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
    s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(v.e, q.e) AS score FROM v, v AS q WHERE q.vec_id % 50 = 0)
    SELECT query_id, vec_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s) WHERE n <= 10
    """)
def vector_topk_each(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return R.nearest_each(vectors, "vec_id", "embedding", vectors.where("vec_id % 50 = 0")).select("query_id", "vec_id", F.round("score", 5).alias("score"))


@query("tokens", "SELECT doc_id, CAST(len(w) AS INT) AS n_tokens, sha256(array_to_string(w, ' ')) AS tokens_sha256 FROM (SELECT doc_id, regexp_extract_all(replace(lower(coalesce(text, '')), '_', ' '), '[a-z0-9]+') AS w FROM documents)")
def tokens(spark, sf_dir):
    words = T.tokenize(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).alias("n_tokens"), F.sha2(F.array_join(words, " "), 256).alias("tokens_sha256"))


@query("url_normalize", """
    WITH p AS (SELECT page_id, page_id % 3 = 0 AS added, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path,
                      array_to_string(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(ref|ref_src|gclid|fbclid|utm_[^=]*)=')), '&') AS q, starts_with(url, 'https://') AS ok FROM pages)
    SELECT page_id, CASE WHEN ok THEN 'https://' || host || CASE WHEN path = '' THEN '/' ELSE path END
           || CASE WHEN added OR q <> '' THEN '?' ELSE '' END || CASE WHEN added THEN 'A=1' ELSE '' END || CASE WHEN added AND q <> '' THEN '&' ELSE '' END || q END AS url FROM p
    """)
def url_normalize(spark, sf_dir):
    more = F.concat(F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("utm_source=x&A=1#top"))
    url = F.concat("url", F.when(F.col("page_id") % 3 == 0, more).otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", T.normalize_url(url).alias("url"))


@query("doi_normalize", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '10.1234/ab' || doc_id WHEN 1 THEN '10.5555/xy.' || doc_id WHEN 2 THEN '10.99999/q' END AS doi FROM documents")
def doi_normalize(spark, sf_dir):
    i = F.col("doc_id")
    raw = F.when(i % 4 == 0, F.concat(F.lit("DOI: 10.1234/AB"), i)).when(i % 4 == 1, F.concat(F.lit("https://dx.doi.org/10.5555%2FXY."), i)).when(i % 4 == 2, F.lit("10.99999/q")).otherwise(F.concat(F.lit("10.12/short"), i))
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_doi(raw).alias("doi"))


@query("format_alias", """
    SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'csv' WHEN 1 THEN 'hdf5' WHEN 2 THEN 'fits' WHEN 3 THEN 'jsonl' ELSE 'odd format' END AS format,
           CASE doc_id % 4 WHEN 0 THEN 'CC-BY-SA-4.0' WHEN 1 THEN 'MIT' WHEN 2 THEN 'CC0-1.0' ELSE 'House Rules' END AS license FROM documents
    """)
def format_alias(spark, sf_dir):
    pick = lambda *of: F.element_at(F.array(*map(F.lit, of)), (F.col("doc_id") % len(of) + 1).cast("int"))
    formats = pick("Text/CSV; charset=utf-8", ".H5", "application/x-fits", "NDJSON", " odd  Format ")
    licenses = pick("https://creativecommons.org/licenses/by-sa/4.0/", "MIT  License", "http://creativecommons.org/publicdomain/zero/1.0/", "House Rules")
    return table(spark, sf_dir, "documents").select("doc_id", T.file_format(formats).alias("format"), T.license_label(licenses).alias("license"))


@query("title_keys", r"""
    SELECT doc_id, trim(regexp_replace(regexp_replace(replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss'), '\p{P}', ' ', 'g'), '\s+', ' ', 'g')) AS k FROM documents
    """)
def title_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.title_key(F.col("text")).alias("k"))


@query("repeated_margins", """
    WITH d AS (SELECT source, doc_id, CASE WHEN doc_id % 9 <> 0 THEN 'Journal of ' || source || chr(10) ELSE '' END || text || CASE WHEN doc_id % 3 <> 0 THEN chr(10) || 'All rights' ELSE '' END || chr(10) || 'End' AS t FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
    l AS (SELECT source, doc_id, string_split(t, chr(10)) AS x FROM d), n AS (SELECT source, count(*) AS pages FROM l GROUP BY 1),
    e AS (SELECT source, doc_id, len(x) AS n, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS line FROM l),
    m AS (SELECT source, line, 'header' AS kind, count(DISTINCT doc_id) AS seen FROM e WHERE trim(line) <> '' AND (i - 1) / n <= 0.15 GROUP BY 1, 2
          UNION ALL SELECT source, line, 'footer', count(DISTINCT doc_id) FROM e WHERE trim(line) <> '' AND i / n >= 0.85 GROUP BY 1, 2)
    SELECT source, kind, sha256(line) AS text_sha256, seen AS pages FROM m JOIN n USING (source) WHERE n.pages >= 2 AND seen >= greatest(2, ceil(0.8 * n.pages))
    """)
def repeated_margins(spark, sf_dir):
    """Each source as a paged text, a document a page: the lines that stand in the margins of most of its pages."""
    i = F.col("doc_id")
    line = F.lit("\n")
    text = F.concat(F.when(i % 9 != 0, F.concat(F.lit("Journal of "), "source", line)).otherwise(""), "text", F.when(i % 3 != 0, F.concat(line, F.lit("All rights"))).otherwise(""), line, F.lit("End"))
    lines = table(spark, sf_dir, "documents").where("text is not null and source is not null").select("source", "doc_id", F.split(text, "\n").alias("x"))
    blocks = lines.select("source", "doc_id", F.size("x").alias("n"), F.posexplode("x").alias("i", "line"))
    blocks = blocks.select("source", "doc_id", "line", (F.col("i") / F.col("n")).alias("top"), ((F.col("i") + 1) / F.col("n")).alias("bottom"))
    return R.repeated_margins(blocks, "source", "doc_id", "line")


@query("stable_ids", "SELECT doc_id, concat('doc_', sha256(concat(doc_id, chr(1), coalesce(text, '')))[1:32]) AS id FROM documents")
def stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", stable_id("doc_", F.col("doc_id"), F.col("text"), digits=32).alias("id"))


@query("catalog_summary", "SELECT count(*) AS objects, CAST(coalesce(sum(n), 0) AS BIGINT) AS bytes FROM (SELECT sha256(text), max(strlen(text)) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1)")
def catalog_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return summary(docs.groupBy(F.sha2("text", 256).alias("sha")).agg(F.max(F.octet_length("text")).alias("size")), "size")


@query("review_loop_gaps", """
    WITH h AS (SELECT regexp_extract(url, '^[a-z]+://(?:[^/]*[.])?([^/.]+[.][^/.]+)(?:[/?#]|$)', 1) AS site, count(*) AS artifacts, CAST(count(*) FILTER (length(html) > 2000) AS BIGINT) AS useful, count(DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS domains, max(page_id % 3 + 1) AS rounds FROM pages GROUP BY 1),
    g AS (SELECT *, greatest(3 - artifacts, 0) AS artifacts_gap, greatest(1 - useful, 0) AS useful_gap, greatest(2 - domains, 0) AS domains_gap FROM h)
    SELECT site, artifacts, useful, domains, artifacts_gap, useful_gap, domains_gap, artifacts_gap + useful_gap + domains_gap = 0 OR rounds >= 4 AS done FROM g
    """)
def review_loop_gaps(spark, sf_dir):
    site = F.regexp_extract("url", r"^[a-z]+://(?:[^/]*[.])?([^/.]+[.][^/.]+)(?:[/?#]|$)", 1)
    pages = table(spark, sf_dir, "pages").withColumn("site", site)
    gaps = O.review_gaps(pages, "site", F.length("html") > 2000, F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1), F.col("page_id") % 3 + 1)
    return gaps.drop("rounds")


@query("memory_admission", "SELECT quality, CASE WHEN quality = 1 AND toxic = 0 THEN 'approved' ELSE 'quarantined' END AS state, count(*) AS n FROM labels GROUP BY ALL")
def memory_admission(spark, sf_dir):
    kept = R.admit(table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 0)
    return kept.groupBy("quality", "state").agg(F.count(F.lit(1)).alias("n"))


@query("evidence_text", "SELECT c_custkey, concat_ws('; ', 'c_name: ' || c_name, 'c_mktsegment: ' || c_mktsegment) AS text FROM customer")
def evidence_text(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", R.evidence_text(None, ["c_name", "c_mktsegment"]).alias("text"))


@query("query_language", "SELECT doc_id, 'en' AS language FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]') UNION ALL SELECT doc_id, 'zh' FROM documents WHERE regexp_matches(coalesce(text, ''), '[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]')")
def query_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.query_language(F.coalesce("text", F.lit(""))).alias("language"))
