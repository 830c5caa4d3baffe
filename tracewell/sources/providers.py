"""Recorded pages of discovery providers as one schema of records. The pages are inputs: nothing here uses a network.

Columns: provider, external_id, title, doi, url, published, license, formats.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import file_format, normalize_doi, preview
from tracewell.functions.values import date_parts, iso_date

COLUMNS = ("provider", "external_id", "title", "doi", "url", "published", "license", "formats")
_OPENALEX = "struct<results:array<struct<id:string,display_name:string,doi:string,publication_date:string,abstract_inverted_index:map<string,array<int>>,primary_location:struct<landing_page_url:string,license:string>>>>"
_ZENODO = "struct<hits:struct<hits:array<struct<id:string,doi:string,links:struct<self_html:string>,metadata:struct<title:string,publication_date:string,license:struct<id:string>>,files:array<struct<key:string>>>>>>"
_CROSSREF = "struct<message:struct<items:array<struct<DOI:string,title:array<string>,URL:string,license:array<struct<URL:string>>,published:struct<`date-parts`:array<array<int>>>,issued:struct<`date-parts`:array<array<int>>>>>>>"
_SERP = "struct<organic_results:array<struct<title:string,link:string,snippet:string>>>"


def abstract(index: Column) -> Column:
    """Words at their positions, from the inverted index that OpenAlex gives."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda s: s["w"]), " ")


def _rows(pages: DataFrame, schema: str, items: str) -> DataFrame:
    return pages.select(F.explode(F.from_json("body", schema)[items] if "." not in items else F.expr(f"from_json(body, '{schema}').{items}")).alias("r"))


def openalex(pages: DataFrame) -> DataFrame:
    """pages: body (JSON text of a result page). Also the abstract."""
    r = _rows(pages, _OPENALEX, "results")
    return r.select(
        F.lit("openalex").alias("provider"), F.col("r.id").alias("external_id"), F.col("r.display_name").alias("title"), normalize_doi(F.col("r.doi")).alias("doi"), F.col("r.primary_location.landing_page_url").alias("url"),
        iso_date(F.col("r.publication_date")).alias("published"), F.col("r.primary_location.license").alias("license"), F.array().cast("array<string>").alias("formats"), abstract(F.col("r.abstract_inverted_index")).alias("abstract"),
    )


def zenodo(pages: DataFrame) -> DataFrame:
    r = _rows(pages, _ZENODO, "hits.hits")
    suffixes = F.transform("r.files", lambda f: file_format(F.regexp_extract(f["key"], r"\.([A-Za-z0-9]+)$", 1), folded=False))
    return r.select(
        F.lit("zenodo").alias("provider"), F.col("r.id").alias("external_id"), F.col("r.metadata.title").alias("title"), normalize_doi(F.col("r.doi")).alias("doi"), F.col("r.links.self_html").alias("url"),
        iso_date(F.col("r.metadata.publication_date")).alias("published"), F.col("r.metadata.license.id").alias("license"), F.array_sort(F.array_distinct(F.filter(suffixes, lambda s: s != ""))).alias("formats"),
    )


def crossref(pages: DataFrame) -> DataFrame:
    r = _rows(pages, _CROSSREF, "message.items")
    parts = lambda name: F.get(F.expr(f"r.{name}.`date-parts`"), F.lit(0))
    return r.select(
        F.lit("crossref").alias("provider"), F.col("r.DOI").alias("external_id"), F.get("r.title", F.lit(0)).alias("title"), normalize_doi(F.col("r.DOI")).alias("doi"), F.col("r.URL").alias("url"),
        F.coalesce(date_parts(parts("published")), date_parts(parts("issued"))).alias("published"), F.get("r.license", F.lit(0))["URL"].alias("license"), F.array().cast("array<string>").alias("formats"),
    )


def serp(pages: DataFrame) -> DataFrame:
    """Web results; only http(s) links, snippets of bounded length as the title's fallback."""
    r = _rows(pages, _SERP, "organic_results").where(F.col("r.link").rlike("(?i)^https?://"))
    none = F.lit(None).cast("string")
    return r.select(
        F.lit("serp").alias("provider"), F.col("r.link").alias("external_id"), F.coalesce("r.title", preview(F.col("r.snippet"))).alias("title"), none.alias("doi"), F.col("r.link").alias("url"),
        F.lit(None).cast("date").alias("published"), none.alias("license"), F.array().cast("array<string>").alias("formats"),
    )


def arxiv(pages: DataFrame) -> DataFrame:
    """pages: body (Atom text). Entries whose id is an https address of arxiv.org."""
    schema = "struct<entry:array<struct<id:string,title:string,published:string>>>"
    plain = F.regexp_replace(F.regexp_replace("body", r"<!DOCTYPE[^>]*>", ""), r"\sxmlns(?::\w+)?=\"[^\"]*\"", "")
    r = pages.select(F.explode(F.from_xml(plain, schema)["entry"]).alias("r"))
    id_ = F.regexp_replace("r.id", "^http://", "https://")
    none = F.lit(None).cast("string")
    return r.select(
        F.lit("arxiv").alias("provider"), id_.alias("external_id"), F.trim(F.regexp_replace("r.title", r"\s+", " ")).alias("title"), none.alias("doi"), id_.alias("url"),
        iso_date(F.left("r.published", F.lit(10))).alias("published"), none.alias("license"), F.array().cast("array<string>").alias("formats"),
    ).where(F.col("url").rlike(r"^https://arxiv\.org/"))


def vizier_matches(catalog: DataFrame, column: str, terms: list[str]) -> DataFrame:
    """The rows that contain one of up to eight terms, whatever their case."""
    hits = reduce(lambda a, b: a | b, [F.contains(F.lower(column), F.lit(t.lower())) for t in terms[:8]])
    return catalog.where(hits)


def vizier(catalog: DataFrame, column: str, terms: list[str], limit: int) -> DataFrame:
    """The first rows, by the column, that contain one of up to eight terms, whatever their case."""
    return vizier_matches(catalog, column, terms).orderBy(column).limit(limit)


def with_next_token(pages: DataFrame, provider: str) -> DataFrame:
    """Pages (body) with the token of the page after them, null after the last: a cursor for OpenAlex, a page number for
    Zenodo; the others answer with single pages."""
    if provider == "openalex":
        token = F.get_json_object("body", "$.meta.next_cursor")
    elif provider == "zenodo":
        token = F.nullif(F.regexp_extract(F.get_json_object("body", "$.links.next"), "[?&]page=([0-9]+)", 1), F.lit(""))
    else:
        token = F.lit(None).cast("string")
    return pages.withColumn("next_token", token)


def every(*parts: DataFrame) -> DataFrame:
    """Records of several providers."""
    return reduce(lambda a, b: a.unionByName(b), [p.select(*COLUMNS) for p in parts])
