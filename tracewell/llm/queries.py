"""The registered queries of this package, with the DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, decontaminate, hardneg, langid, minhash, piecebpe, secrets, sharding, snapdiff, substring, syncmers, tokenfile, warc
from tracewell.llm.storage import small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under ``name``, and its SQL if it has one."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op1_warc_archive",
    """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
    d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest,
                 min(page_id) OVER (PARTITION BY sha256(body)) AS first_id FROM p)
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
    FROM d
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_records(read(spark, sf_dir, "pages"), "page_id", "url", "html")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_closed_syncmers")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(read(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    "op3_fm_decontamination",
    r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM documents),
    i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM benchmark),
    k AS (SELECT DISTINCT item_id, len(v) AS n, array_to_string(v, ' ') AS v FROM (SELECT item_id, unnest(CASE WHEN len(t) < 13 THEN [t] ELSE list_transform(range(1, len(t) - 11), lambda x: t[x : x + 12]) END) AS v FROM i WHERE len(t) > 0)),
    s AS (SELECT doc_id, n, unnest(range(1, len(t) - n + 2)) AS p FROM w, (SELECT DISTINCT n FROM k) WHERE len(t) >= n),
    h AS (SELECT s.doc_id, s.p, s.n, k.item_id FROM s JOIN w USING (doc_id) JOIN k ON k.n = s.n AND k.v = array_to_string(w.t[s.p : s.p + s.n - 1], ' ')),
    c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY 1),
    f AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS items FROM h GROUP BY 1)
    SELECT doc_id, CAST(len(t) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(t) AS contaminated
    FROM w LEFT JOIN c USING (doc_id) LEFT JOIN f USING (doc_id)
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(read(spark, sf_dir, "documents"), "doc_id", "text", read(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_bpe_segment_tree")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), "doc_id", "text", vocabulary("byte_bpe_50k.json"))


@query(
    "op5_suffix_automata",
    r"""
    WITH w AS (
        SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents),
    s AS (SELECT doc_id, unnest(range(1, len(t) - 33)) AS i FROM w WHERE len(t) >= 35),
    g AS (SELECT s.doc_id, s.i, md5(array_to_string(w.t[s.i : s.i + 34], ' ')) AS h FROM s JOIN w USING (doc_id)),
    d AS (SELECT doc_id, i FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
    c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM d),
    l AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY 1)
    SELECT w.doc_id, CAST(len(t) AS BIGINT) AS n_words, CAST(len(coalesce(gone, [])) AS BIGINT) AS n_removed,
           sha256(array_to_string(list_filter(t, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256
    FROM w LEFT JOIN l USING (doc_id)
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(read(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_hierarchical_langid")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"), "doc_id", "text", "lang")


@query(
    "op7_circulant_minhash",
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t
        FROM documents),
    s AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) >= 2 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])
                                       WHEN len(t) = 1 THEN [t[1]] ELSE [] END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 80 * (x.n + y.n - i)),
    e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
    SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.c AS component_id, c.c = d.doc_id AS kept
    FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY 1) c USING (doc_id)
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), "doc_id", "text", size=2)


@query("op8_jump_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read(spark, sf_dir, "documents"), "doc_id", "text", 40)


@query("op9_forest_secret_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", "start", "length", F.sha2("candidate", 256).alias("secret_sha256"), F.round("score", 6).alias("score"))


@query("op10_context_mixing_token_file")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(read(spark, sf_dir, "documents"), "doc_id", "text", vocabulary("word_bpe_49k.json"), end_id=2)


@query(
    "op11_distance_key_negatives",
    """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
        FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (
        SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
    SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
           s.other_id AS negative_id, p.positive_score, s.score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
    QUALIFY rank <= 10
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(rows.withColumn("label", label), "vec_id", "embedding", "label", F.col("id") % 100 == 0)


@query("op12_piece_merge_rounds")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecebpe.round_trip(read(spark, sf_dir, "documents"), "doc_id", "text", vocabulary("piece_bpe_32k.model"))


def later_snapshot(docs: DataFrame) -> DataFrame:
    """``documents`` as the contract of operator 13 changes them, by the crc32 of the decimal key modulo 10."""
    kind = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10))
    away = -1 - F.col("doc_id")
    kept = docs.select("doc_id", "text", "lang", "source", F.coalesce(kind, F.lit(9)).alias("kind")).where("kind <> 0")
    swapped = F.col("kind") == 2
    changed = kept.select(
        F.when(F.col("kind").isin(3, 4), away).otherwise(F.col("doc_id")).alias("doc_id"),
        F.when(F.col("kind") == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text")).alias("text"),
        F.when(swapped, F.col("source")).otherwise(F.col("lang")).alias("lang"),
        F.when(swapped, F.col("lang")).when(F.col("kind") == 4, F.lit(None)).otherwise(F.col("source")).alias("source"),
    )
    return changed.unionByName(kept.where("kind = 5").select(away.alias("doc_id"), "text", "lang", "source"))


@query(
    "op13_merkle_snapshot_diff",
    """
    WITH t AS (
        SELECT list(v ORDER BY i) AS tab
        FROM (SELECT i, list_reduce(list_transform(range(9), lambda x: i), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
    d AS (
        SELECT doc_id, text, lang, source,
               xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                               lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10 AS kind
        FROM documents, t),
    o AS (SELECT doc_id AS key, text, lang, source FROM d),
    n AS (
        SELECT CASE WHEN kind IN (3, 4) THEN -1 - doc_id ELSE doc_id END AS key, CASE WHEN kind = 1 THEN coalesce(text, '') || '+' ELSE text END AS text,
               CASE WHEN kind = 2 THEN source ELSE lang END AS lang, CASE WHEN kind = 2 THEN lang WHEN kind = 4 THEN NULL ELSE source END AS source
        FROM d WHERE kind <> 0
        UNION ALL SELECT -1 - doc_id, text, lang, source FROM d WHERE kind = 5),
    p AS (
        SELECT n.key, n.text, n.lang, n.source,
               concat_ws(',', CASE WHEN n.text IS DISTINCT FROM o.text THEN 'text' END, CASE WHEN n.lang IS DISTINCT FROM o.lang THEN 'lang' END,
                         CASE WHEN n.source IS DISTINCT FROM o.source THEN 'source' END) AS changed
        FROM n JOIN o ON n.key = o.key),
    a AS (SELECT *, row_number() OVER (PARTITION BY text, lang, source ORDER BY key) AS i FROM o WHERE key NOT IN (SELECT key FROM n)),
    b AS (SELECT *, row_number() OVER (PARTITION BY text, lang, source ORDER BY key) AS i FROM n WHERE key NOT IN (SELECT key FROM o)),
    m AS (
        SELECT a.key AS gone, b.key AS come, b.text, b.lang, b.source
        FROM a FULL JOIN b ON a.i = b.i AND a.text IS NOT DISTINCT FROM b.text AND a.lang IS NOT DISTINCT FROM b.lang AND a.source IS NOT DISTINCT FROM b.source),
    r AS (
        SELECT key, key AS old_key, CASE WHEN changed = '' THEN 'same' ELSE 'update' END AS op, changed, text, lang, source FROM p
        UNION ALL
        SELECT coalesce(come, gone), gone, CASE WHEN come IS NULL THEN 'delete' WHEN gone IS NULL THEN 'insert' ELSE 'rekey' END, '', text, lang, source FROM m)
    SELECT key, old_key, op, changed,
           CASE WHEN op <> 'delete' THEN sha256(coalesce(text, '~') || chr(10) || coalesce(lang, '~') || chr(10) || coalesce(source, '~')) END AS row_sha256
    FROM r
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return snapdiff.diff(docs, later_snapshot(docs), "doc_id", ["text", "lang", "source"])
