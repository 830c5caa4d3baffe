"""Queries of rule books over texts: spans of terms, routing profiles, expanded queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import keywords as W
from tracewell.plans.registry import Registry
from tracewell.session import table

REGISTRY = Registry()
query = REGISTRY.query


def _pairs(spark, sf_dir):
    """A rule book: each pair of neighbouring words of a benchmark item votes for the item, longer pairs more."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    at = F.explode(F.sequence(F.lit(0), F.size("w") - 2)).alias("i")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("pack"), words.alias("w")).where(F.size("w") > 1)
    pair = F.concat_ws(" ", F.get("w", F.col("i")), F.get("w", F.col("i") + 1))
    return items.select("pack", "w", at).select("pack", F.lower(pair).alias("term")).distinct().withColumn("weight", 0.25 + (F.length("term") % 4) / 4)


@query("keyword_spans", r"""
    WITH w AS (SELECT CAST(item_id AS VARCHAR) AS pack, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM benchmark),
    r AS (SELECT DISTINCT pack, lower(w[i] || ' ' || w[i + 1]) AS term FROM (SELECT pack, w, unnest(range(1, len(w))) AS i FROM w)),
    t AS (SELECT DISTINCT term, replace(term, 'ß', 'ss') AS f FROM r),
    d AS (SELECT doc_id, replace(lower(text), 'ß', 'ss') AS text FROM documents),
    c AS MATERIALIZED (SELECT doc_id, term, f, text FROM d JOIN t ON contains(text, f)),
    p AS (SELECT *, '(?s)^(' || CASE WHEN regexp_matches(f, '^[a-z0-9]') THEN '(?:.*?[^\p{L}\p{N}_])??' ELSE '.*?' END || ')' || regexp_escape(f) || CASE WHEN regexp_matches(f, '[a-z0-9]$') THEN '(?:$|[^\p{L}\p{N}_])' ELSE '' END AS pattern FROM c),
    m AS (SELECT doc_id, term, f, regexp_extract(text, pattern, 0) AS found, length(regexp_extract(text, pattern, 1)) AS start FROM p)
    SELECT doc_id, pack, term, 0.25 + (length(term) % 4) / 4.0 AS weight, start, start + length(f) AS "end", f AS matched_text FROM m JOIN r USING (term) WHERE found <> ''
    """)
def keyword_spans(spark, sf_dir):
    """Where pairs of words of the benchmark stand in the documents."""
    found = W.find_terms(table(spark, sf_dir, "documents"), "doc_id", "text", _pairs(spark, sf_dir))
    return found.drop("matches")


ROUTES = [("english", "the", 1.0), ("english", "and", 0.5), ("french", "le", 0.5), ("french", "pour", 0.25), ("german", "der", 1.0), ("german", "und", 1.0), ("spanish", "el", 0.75)]


@query("domain_profiles", r"""
    WITH r(pack, term, weight) AS (VALUES ('english', 'the', 1.0), ('english', 'and', 0.5), ('french', 'le', 0.5), ('french', 'pour', 0.25), ('german', 'der', 1.0), ('german', 'und', 1.0), ('spanish', 'el', 0.75)),
    h AS (SELECT doc_id, pack, sum(weight)::DOUBLE AS score, count(*) AS votes FROM documents, r WHERE regexp_matches(replace(lower(text), 'ß', 'ss'), '(^|[^\p{L}\p{N}_])' || term || '($|[^\p{L}\p{N}_])') GROUP BY 1, 2),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pack) AS n, max(score) OVER (PARTITION BY doc_id) AS best, round(least(0.99, 0.2 + 0.22 * score + 0.08 * least(votes, 3)), 6) AS confidence FROM h),
    s AS (SELECT doc_id, string_agg(pack, ',' ORDER BY score DESC, pack) AS secondary FROM o WHERE n > 1 AND score >= 0.7 AND score >= best * 0.45 GROUP BY 1)
    SELECT d.doc_id, coalesce(o.pack, 'generic') AS "primary", coalesce(s.secondary, '') AS secondary, coalesce(o.confidence, 0.25) AS confidence, coalesce(o.confidence, 0.25) < 0.65 AS provisional
    FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id AND o.n = 1 LEFT JOIN s ON s.doc_id = d.doc_id
    """)
def domain_profiles(spark, sf_dir):
    """The domain of each document by its keywords, and the general one where none of them stands."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    book = spark.createDataFrame(ROUTES, "pack string, term string, weight double")
    profiles = W.profiles(docs, W.scores(W.find_terms(docs, "doc_id", "text", book), "doc_id"), "doc_id")
    return profiles.withColumn("secondary", F.array_join("secondary", ","))


@query("expanded_queries", """
    WITH e AS (SELECT n_nationkey AS expansion_id, lower(n_name) AS t1, 'pays ' || lower(n_name) AS t2 FROM nation WHERE n_regionkey % 2 = 0),
    c AS (SELECT s_nationkey AS task, s_suppkey AS concept_id, lower(CASE WHEN s_suppkey % 3 = 0 THEN 'data of ' || n_name || ' ' || CAST(s_suppkey % 2 AS VARCHAR) WHEN s_suppkey % 3 = 1 THEN left(n_name, 4) ELSE s_name END) AS term FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    m AS (SELECT DISTINCT task, concept_id, expansion_id FROM c JOIN e ON contains(c.term, t1) OR contains(t1, c.term) OR contains(c.term, t2) OR contains(t2, c.term)),
    x AS (SELECT DISTINCT task, expansion_id FROM m),
    l AS (SELECT task, 'en' AS language, 0 AS a, expansion_id AS b, 0 AS c, t1 AS shown FROM x JOIN e USING (expansion_id)
          UNION ALL SELECT task, 'fr', 0, expansion_id, 1, t2 FROM x JOIN e USING (expansion_id)
          UNION ALL SELECT task, 'en', 1, concept_id, 0, term FROM c WHERE (task, concept_id) NOT IN (SELECT (task, concept_id) FROM m)),
    o AS (SELECT task, language, shown, min(struct_pack(a := a, b := b, c := c)) AS k FROM l GROUP BY ALL),
    g AS (SELECT task, language, list(shown ORDER BY k) AS terms FROM o GROUP BY ALL)
    SELECT task, language, array_to_string(terms, ' ') || ' survey' AS text, array_to_string(terms, '|') AS terms FROM g
    """)
def expanded_queries(spark, sf_dir):
    """Suppliers' concepts of each nation against a rule book of nations' names in two languages."""
    nation = table(spark, sf_dir, "nation")
    name = F.lower("n_name")
    both = F.array(F.struct(F.lit("en").alias("language"), name.alias("term")), F.struct(F.lit("fr").alias("language"), F.concat(F.lit("pays "), name).alias("term")))
    domains = F.array(F.when(F.col("n_regionkey") % 2 == 0, "Geography").otherwise("other"))
    expansions = nation.select(F.col("n_nationkey").alias("expansion_id"), F.col("n_nationkey").alias("position"), domains.alias("domains"), both.alias("terms"))
    i = F.col("s_suppkey")
    term = F.when(i % 3 == 0, F.concat(F.lit("Data of "), "n_name", F.lit(" "), (i % 2).cast("string"))).when(i % 3 == 1, F.left("n_name", F.lit(4))).otherwise(F.col("s_name"))
    concepts = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_nationkey").alias("task"), i.alias("concept_id"), i.alias("position"), F.lower(term).alias("term"))
    hints = nation.select(F.col("n_nationkey").alias("task"), F.lit(0).alias("position"), F.lit("und").alias("language"), F.lit("survey").alias("text"))
    found = W.expanded_queries(concepts, expansions, hints, ["geography"])
    return found.withColumn("terms", F.array_join("terms", "|"))
