"""Discovery records as candidates: who belongs together, and what a group says.

Records with a DOI or an address in common are one candidate, unless that would bring two sets of DOIs together that have
nothing in common; then records without either join by title and year, if at most one group with a strong identity
bears that title. Which unions are refused depends on their order, so the order is total: input order never matters.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import normalize_doi, normalize_title, normalize_url, title_key
from tracewell.operators.discovery import components, ordered_text

#: Confidence of a claim that rests on a query's intent alone.
INTENT = 0.35


def aliases(records: DataFrame) -> DataFrame:
    """Records with normalized doi and url, title_alias (null without a title) and dedup_key, their strongest alias."""
    key = title_key(F.col("title"))
    titled = F.when(F.coalesce(key, F.lit("")) != "", F.concat(F.lit("title:"), F.sha2(key, 256), F.lit("|year:"), F.coalesce(F.col("year").cast("string"), F.lit("unknown"))))
    rows = records.withColumn("doi", normalize_doi(F.col("doi"))).withColumn("url", normalize_url(F.col("url"))).withColumn("title_alias", titled)
    return rows.withColumn("dedup_key", F.coalesce(F.concat(F.lit("doi:"), "doi"), F.concat(F.lit("url:"), "url"), "title_alias"))


def merge_records(records: DataFrame, order: list[str] = ()) -> DataFrame:
    """record_id and candidate (the first record of its group) of records (record_id, title, doi, url, year).

    Records stand in the order of their dedup key, the columns of ``order`` and their id. Groups are found in three
    steps that grow with the data (components over shared DOIs and addresses, a count of strong groups for each title)
    and one that does not: only in groups with several DOIs a union may be refused, and these alone are settled record
    by record. A record without doi, url and title is a candidate of its own. record_id must be unique.
    """
    rows = aliases(records)
    place = F.struct(F.coalesce("dedup_key", F.lit("~")).alias("k"), *[F.col(c) for c in order], F.col("record_id"))
    rows = rows.select("record_id", "doi", "url", "title_alias", place.alias("place"))
    strong = rows.where("doi is not null or url is not null")
    owners = strong.select("record_id", F.explode(F.array_compact(F.array(F.concat(F.lit("doi:"), "doi"), F.concat(F.lit("url:"), "url")))).alias("alias"))
    lowest = owners.groupBy("alias").agg(F.min("record_id").alias("a"))
    edges = owners.join(lowest, "alias").where("a <> record_id").select("a", F.col("record_id").alias("b")).distinct()
    parts = components(edges).withColumnRenamed("id", "record_id")
    placed = strong.join(parts, "record_id", "left").withColumn("component", F.coalesce("component", "record_id"))
    kinds = placed.groupBy("component").agg(F.count_distinct("doi").alias("dois"), F.min_by("record_id", "place").alias("first"))
    placed = placed.join(kinds, "component")
    calm = placed.where("dois <= 1").select("record_id", "title_alias", "place", F.col("first").alias("root"))
    settled = _settle(placed.where("dois > 1"), dict(rows.dtypes)["record_id"])
    roots = calm.unionByName(settled.join(rows.select("record_id", "title_alias", "place"), "record_id").select("record_id", "title_alias", "place", "root"))
    weak = rows.where("doi is null and url is null").select("record_id", "title_alias", "place")
    titles = roots.where("title_alias is not null").groupBy("title_alias").agg(F.count_distinct("root").alias("strong"), F.min("root").alias("owner"))
    leads = weak.where("title_alias is not null").groupBy("title_alias").agg(F.min_by("record_id", "place").alias("lead"))
    joined = weak.join(leads.join(titles, "title_alias", "left"), "title_alias", "left")
    candidate = F.when(F.col("title_alias").isNull() | (F.col("strong") > 1), F.col("record_id")).otherwise(F.coalesce("owner", "lead"))
    # a record that comes before the group it joins by title becomes its first
    every = roots.select("record_id", "place", F.col("root").alias("candidate")).unionByName(joined.select("record_id", "place", candidate.alias("candidate")))
    firsts = every.groupBy("candidate").agg(F.min_by("record_id", "place").alias("first"))
    return every.join(firsts, "candidate").select("record_id", F.col("first").alias("candidate"))


def _settle(rows: DataFrame, kind: str) -> DataFrame:
    """record_id and root in groups with several DOIs: unions in order, refused where two sets of DOIs would meet that
    have none in common."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("n")
        ids = group.record_id.tolist()
        parent = list(range(len(ids)))
        dois = [{d} if d is not None else set() for d in group.doi.tolist()]
        owner: dict[str, int] = {}

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i, (doi, url) in enumerate(zip(group.doi, group.url, strict=True)):
            for alias in (doi and f"doi:{doi}", url and f"url:{url}"):
                if alias is None:
                    continue
                a, b = sorted((root(i), root(owner.setdefault(alias, i))))
                if a != b and not (dois[a] and dois[b] and dois[a].isdisjoint(dois[b])):
                    parent[b] = a
                    dois[a] |= dois[b]
        return pd.DataFrame({"record_id": ids, "root": [ids[root(i)] for i in range(len(ids))]})

    from pyspark.sql import Window

    numbered = rows.select("component", "record_id", "doi", "url", F.row_number().over(Window.partitionBy("component").orderBy("place")).alias("n"))
    return numbered.groupBy("component").applyInPandas(run, f"record_id {kind}, root {kind}")


def metadata_count() -> Column:
    """How many of a record's descriptive attributes are known. Columns: doi, url, published, license, formats, access."""
    known = [F.col("doi").isNotNull(), F.col("url").isNotNull(), F.col("published").isNotNull(), F.col("license").isNotNull(), F.coalesce(F.size("formats") > 0, F.lit(False)), F.coalesce("access", F.lit("unknown")) != "unknown"]
    total = F.lit(0)
    for k in known:
        total = total + k.cast("int")
    return total


def build_candidates(members: DataFrame) -> DataFrame:
    """One row for each candidate: its preferred title and the sorted distinct values of its attributes.

    members: candidate, primary_source, rank, title, source_id, external_id, doi and url (normalized), published,
    license, formats, access."""
    best = F.struct(~F.col("primary_source"), "rank", -metadata_count(), title_key(F.col("title")), normalize_title(F.col("title")), "source_id", "external_id")
    return members.groupBy("candidate").agg(
        F.min_by(normalize_title(F.col("title")), best).alias("title"),
        F.count(F.lit(1)).alias("records"),
        *[ordered_text(F.collect_set(c)).alias(to) for c, to in (("doi", "dois"), ("url", "urls"), ("license", "licenses"), ("access", "access"), ("source_id", "sources"))],
        ordered_text(F.flatten(F.collect_set("formats"))).alias("formats"),
        F.min("published").alias("first_published"),
    )


def coverage_claims(members: DataFrame) -> DataFrame:
    """What a candidate may cover: the fields that its records' queries were after, with the records' evidence. members:
    candidate, target_fields, evidence_id. Each (candidate, field) pair once; its evidence is counted, not gathered."""
    each = members.select("candidate", F.explode("target_fields").alias("field_name"), "evidence_id")
    claims = each.groupBy("candidate", "field_name").agg(F.count_distinct("evidence_id").alias("evidence"), F.min("evidence_id").alias("first_evidence"))
    return claims.select("candidate", "field_name", F.lit("probable").alias("assessment"), F.lit(INTENT).alias("confidence"), "evidence", "first_evidence")
