"""Queries of recorded discovery pages: tables of the driver written as each provider's answers and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.plans.registry import Registry
from tracewell.session import table
from tracewell.sources import providers as P

REGISTRY = Registry()
query = REGISTRY.query


def _pages(items, body):
    """One page for each item; ``body`` makes its JSON value from a column."""
    return items.select(F.to_json(body).alias("body"))


@query("provider_openalex", """
    SELECT 'W' || CAST(c_custkey AS VARCHAR) AS external_id, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN '10.1234/c' || CAST(c_custkey AS VARCHAR) END AS doi, CASE WHEN c_custkey % 3 = 0 THEN '2020-01-15' END AS published, 'alpha beta alpha' AS abstract FROM customer
    """)
def provider_openalex(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    index = F.create_map(F.lit("alpha"), F.array(F.lit(0), F.lit(2)), F.lit("beta"), F.array(F.lit(1)))
    doi = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("https://doi.org/10.1234/C"), key))
    day = F.when(F.col("c_custkey") % 3 == 0, "2020-01-15").otherwise("2020-02-31")
    item = F.struct(F.concat(F.lit("W"), key).alias("id"), F.col("c_name").alias("display_name"), doi.alias("doi"), day.alias("publication_date"), index.alias("abstract_inverted_index"))
    pages = _pages(table(spark, sf_dir, "customer"), F.struct(F.array(item).alias("results")))
    return P.openalex(pages).select("external_id", "title", "doi", F.col("published").cast("string").alias("published"), "abstract")


@query("provider_zenodo", """
    SELECT CAST(p_partkey AS VARCHAR) AS external_id, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 'csv,hdf5' ELSE 'csv' END AS formats, CASE WHEN p_partkey % 3 = 0 THEN 'cc-by-4.0' END AS license FROM part
    """)
def provider_zenodo(spark, sf_dir):
    i = F.col("p_partkey")
    names = F.when(i % 2 == 0, F.array(F.lit("b.H5"), F.lit("a.csv"), F.lit("c.CSV"))).otherwise(F.array(F.lit("a.csv"), F.lit("noformat"), F.lit("b.csv")))
    license_ = F.when(i % 3 == 0, F.struct(F.lit("cc-by-4.0").alias("id")))
    hit = F.struct(i.cast("string").alias("id"), F.struct(F.col("p_name").alias("title"), license_.alias("license")).alias("metadata"), F.transform(names, lambda n: F.struct(n.alias("key"))).alias("files"))
    pages = _pages(table(spark, sf_dir, "part"), F.struct(F.struct(F.array(hit).alias("hits")).alias("hits")))
    return P.zenodo(pages).select("external_id", "title", F.array_join("formats", ",").alias("formats"), "license")


@query("provider_crossref", """
    SELECT '10.5555/s' || CAST(s_suppkey AS VARCHAR) AS doi, s_name AS title, CASE s_suppkey % 4 WHEN 0 THEN '2019-03-07' WHEN 1 THEN '2018-11-30' WHEN 2 THEN NULL ELSE NULL END AS published FROM supplier
    """)
def provider_crossref(spark, sf_dir):
    """Dates: complete, complete only in the second place, without a day, and impossible."""
    i = F.col("s_suppkey")
    parts = lambda *p: F.struct(F.array(F.array(*[F.lit(x) for x in p])).alias("date-parts"))
    published = F.when(i % 4 == 0, parts(2019, 3, 7)).when(i % 4 == 3, parts(2019, 2, 30)).otherwise(parts(2018, 5))
    item = F.struct(F.concat(F.lit("10.5555/S"), i.cast("string")).alias("DOI"), F.array("s_name").alias("title"), published.alias("published"), F.when(i % 4 == 1, parts(2018, 11, 30)).alias("issued"))
    pages = _pages(table(spark, sf_dir, "supplier"), F.struct(F.struct(F.array(item).alias("items")).alias("message")))
    return P.crossref(pages).select("doi", "title", F.col("published").cast("string").alias("published"))


@query("provider_serp", """
    SELECT url, CASE WHEN page_id % 3 = 0 THEN left(trim(regexp_replace(html, '\\s+', ' ', 'g')), 2048) ELSE 'Page ' || CAST(page_id AS VARCHAR) END AS title FROM pages WHERE regexp_matches(url, '^https?://') AND page_id % 5 <> 0
    """)
def provider_serp(spark, sf_dir):
    """Some results have no title, whose snippet stands in, and some link to no web page."""
    i = F.col("page_id")
    result = F.struct(F.when(i % 3 != 0, F.concat(F.lit("Page "), i.cast("string"))).alias("title"), F.when(i % 5 == 0, F.concat(F.lit("ftp://x/"), i.cast("string"))).otherwise(F.col("url")).alias("link"), F.col("html").alias("snippet"))
    pages = _pages(table(spark, sf_dir, "pages"), F.struct(F.array(result).alias("organic_results")))
    return P.serp(pages).select("url", "title")


@query("provider_arxiv", """
    SELECT 'https://arxiv.org/abs/' || CAST(o_orderkey AS VARCHAR) AS url, 'Order ' || CAST(o_orderkey AS VARCHAR) || ' of customer ' || CAST(o_custkey AS VARCHAR) AS title, strftime(o_orderdate, '%Y-%m-%d') AS published FROM orders WHERE o_orderkey % 7 <> 0
    """)
def provider_arxiv(spark, sf_dir):
    """Atom entries whose ids are http addresses; those of another host are left out."""
    i = F.col("o_orderkey")
    host = F.when(i % 7 == 0, "arxiv.example.org").otherwise("arxiv.org")
    entry = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://'), host, F.lit("/abs/"), i.cast("string"), F.lit("</id><title>Order "), i.cast("string"), F.lit("\n  of  customer "), F.col("o_custkey").cast("string"),
        F.lit("</title><published>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z</published></entry></feed>"),
    )
    pages = table(spark, sf_dir, "orders").select(entry.alias("body"))
    return P.arxiv(pages).select("url", "title", F.col("published").cast("string").alias("published"))


@query("provider_vizier", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_name), 'small') ORDER BY p_name, p_partkey LIMIT 100")
def provider_vizier(spark, sf_dir):
    """The service answers with the first rows of the match; the order is made total to compare."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.struct("p_name", "p_partkey").alias("at"))
    named = rows.withColumn("name", F.col("p_name"))
    hits = P.vizier_matches(named, "name", ["RING", "small"])
    return hits.orderBy("at").limit(100).select("p_partkey", "p_name")


@query("provider_pages", """
    SELECT n_nationkey AS page, 'openalex' AS provider, CASE WHEN n_nationkey % 5 <> 4 THEN 'c' || CAST(n_nationkey AS VARCHAR) END AS next_token FROM nation
    UNION ALL SELECT n_nationkey, 'zenodo', CASE WHEN n_nationkey % 3 <> 2 THEN CAST(n_nationkey + 1 AS VARCHAR) END FROM nation UNION ALL SELECT n_nationkey, 'crossref', NULL FROM nation
    """)
def provider_pages(spark, sf_dir):
    """The token of the next page, as each provider gives it; Crossref's answers are single pages."""
    i = F.col("n_nationkey")
    cursor = F.struct(F.when(i % 5 != 4, F.concat(F.lit("c"), i.cast("string"))).alias("next_cursor"))
    link = F.struct(F.when(i % 3 != 2, F.concat(F.lit("https://zenodo.org/api/records?size=5&page="), (i + 1).cast("string"), F.lit("&sort=x"))).alias("next"))
    body = F.to_json(F.struct(cursor.alias("meta"), link.alias("links")))
    nation = table(spark, sf_dir, "nation").select(i.alias("page"), body.alias("body"))
    parts = [P.with_next_token(nation, name).select("page", F.lit(name).alias("provider"), "next_token") for name in ("openalex", "zenodo", "crossref")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
