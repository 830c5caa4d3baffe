"""Planning before data moves: intake checks, routing companions, parser choice, search coverage, acquisition."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.selection import rules

#: Query keys that carry credentials, hosts of cloud metadata, and networks that are not public.
CREDENTIAL_KEYS = (
    "access_token",
    "api-key",
    "api_key",
    "apikey",
    "authorization",
    "credential",
    "signature",
    "token",
)
METADATA_HOSTS = ("169.254.169.254", "metadata.google.internal", "metadata")
PRIVATE_V4 = r"^(?:0\.|10\.|127\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|22[4-9]\.|23[0-9]\.|2[4-5][0-9]\.)"


def over_budget(requested: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Requested resources (resource, amount) above their hard limit. Nothing is reduced silently."""
    rows = [F.when(F.col("resource") == k, F.lit(float(v))) for k, v in limits.items()]
    return requested.withColumn("limit", F.coalesce(*rows)).where(F.col("limit").isNull() | (F.col("amount") > F.col("limit")))


def url_problems(url: Column, allowed_hosts: list[str]) -> Column:
    """What is wrong with an address, as far as its text tells; [] if nothing is. No name is resolved."""
    pattern = r"(?i)^([a-z][a-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[0-9a-f:.]+\]|[^/?#:@]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?"
    part = lambda i: F.lower(F.regexp_extract(url, pattern, i))
    host = F.regexp_replace(part(3), r"\.+$", "")
    suffixes = [(host == h.lower()) if not h.startswith("*.") else F.endswith(host, F.lit(h[1:].lower())) for h in allowed_hosts]
    allowed = F.lit(False)
    for s in suffixes:
        allowed = allowed | s
    keys = F.transform(F.split(part(6), "&"), lambda q: F.substring_index(q, "=", 1))
    return F.array_compact(
        F.array(
            F.when((part(1) == "") | (host == ""), "url_invalid"),
            F.when(~part(1).isin("", "http", "https"), "scheme_blocked"),
            F.when(F.contains(F.regexp_extract(url, r"^[^:]*://([^/?#]*)", 1), F.lit("@")), "userinfo_blocked"),
            F.when(F.exists(keys, lambda k: k.isin(*CREDENTIAL_KEYS)), "credential_in_query"),
            F.when(host.isin(*METADATA_HOSTS), "metadata_host"),
            F.when(host.rlike(PRIVATE_V4) | host.isin("localhost", "[::1]") | host.rlike(r"^\[f[cd]|^\[fe80"), "address_not_public"),
            F.when((host != "") & ~allowed, "host_not_allowed"),
        )
    )


#: Media types of uploads with the suffixes that may go with them.
UPLOAD_SUFFIXES = {
    "application/json": ("json", "geojson"),
    "application/pdf": ("pdf",),
    "application/zip": ("zip",),
    "text/csv": ("csv",),
    "text/plain": ("txt",),
    "text/tab-separated-values": ("tsv",),
}


def upload_problems(files: DataFrame, max_file: int = 100_000_000, max_total: int = 500_000_000, max_expanded: int = 1_000_000_000, max_ratio: float = 100.0, max_entries: int = 10_000) -> DataFrame:
    """files: task, name, media_type, size_bytes, expanded_bytes and entries (null but for archives), with problems.

    Totals are sums over each task; nothing is unpacked."""
    w = Window.partitionBy("task")
    suffix = F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1))
    known = F.lit(False)
    for media, suffixes in UPLOAD_SUFFIXES.items():
        known = known | ((F.col("media_type") == media) & suffix.isin(*suffixes))
    problems = F.array_compact(
        F.array(
            F.when(~known, "media_type_mismatch"),
            F.when(F.col("name").rlike(r"[/\\\x00]|^\.\.?$"), "unsafe_name"),
            F.when(F.col("size_bytes") <= 0, "empty"),
            F.when(F.col("size_bytes") > max_file, "file_too_large"),
            F.when(F.sum("size_bytes").over(w) > max_total, "total_too_large"),
            F.when(F.sum(F.coalesce("expanded_bytes", "size_bytes")).over(w) > max_expanded, "expansion_too_large"),
            F.when(F.col("expanded_bytes") > max_ratio * F.col("size_bytes"), "ratio_too_large"),
            F.when(F.col("entries") > max_entries, "too_many_entries"),
        )
    )
    return files.withColumn("problems", problems)


def companions(scores: DataFrame, packs: DataFrame, key: str) -> DataFrame:
    """Scores (key, pack, score) with the packs that others activate: 45 % of the best trigger, .75 at least.
    packs: pack, activate_with_any. A pack with a score of its own keeps it."""
    triggers = packs.select("pack", F.explode("activate_with_any").alias("trigger"))
    raised = scores.select(key, F.col("pack").alias("trigger"), "score").join(rules(triggers), "trigger")
    raised = raised.groupBy(key, "pack").agg(F.round(F.greatest(F.lit(0.75), F.max("score") * 0.45), 6).alias("score"))
    return scores.select(key, "pack", "score").unionByName(raised.join(scores.select(key, "pack"), [key, "pack"], "left_anti"))


def choose_parsers(artifacts: DataFrame, parsers: DataFrame, available: list[str], tiers: list[str], network: bool, budget: int, route_limit: int, plan: str = "plan") -> DataFrame:
    """One decision for each artifact: its cheapest usable primary parser with its fallbacks and cost, or why there is none.

    artifacts: plan, artifact_id, kind, family, media_type, size_bytes. parsers: parser_id, kinds, families, media_types,
    max_bytes, tier, tier_rank, needs_network, primary, cost, module, checks, triggers. Artifacts of a plan draw on its
    budget in the order of their id; one that does not fit takes nothing, and a later one may fit. Fallbacks are usable
    parsers of the primary's module and of no lower tier that a check of the primary triggers, by cost, as many as still
    fit. A fold over a plan's artifacts, which one task takes.
    """
    rule = rules(parsers)
    matches = F.array_contains("kinds", F.col("kind")) & F.array_contains("families", F.col("family")) & F.array_contains("media_types", F.col("media_type")) & (F.col("size_bytes") <= F.col("max_bytes"))
    there = F.col("parser_id").isin(*available) if available else F.lit(False)
    usable = there & F.col("tier").isin(*tiers) & (~F.col("needs_network") | F.lit(network))
    key = F.struct("cost", "tier_rank", "parser_id")
    joined = artifacts.join(rule, matches, "left")
    best = joined.groupBy(plan, "artifact_id").agg(
        F.count("parser_id").alias("matching"),
        F.count_if(~there & F.col("parser_id").isNotNull()).alias("absent"),
        F.min_by(F.struct("parser_id", F.col("cost").cast("long").alias("cost"), "tier_rank", "module", "checks"), F.when(usable & F.col("primary"), key)).alias("best"),
        F.array_sort(F.collect_list(F.when(usable & ~F.col("primary"), F.struct(F.col("cost").cast("long").alias("cost"), "tier_rank", "parser_id", "module", "triggers")))).alias("others"),
    )
    fits = lambda o: (o["tier_rank"] >= F.col("best.tier_rank")) & (o["module"] == F.col("best.module")) & F.arrays_overlap(o["triggers"], F.col("best.checks"))
    fallbacks = F.when(F.col("best").isNotNull(), F.filter("others", fits))
    blocker = F.when(F.col("best").isNotNull(), F.lit(None)).when(F.col("matching") == 0, "capability_missing").when(F.col("absent") > 0, "parser_unavailable").otherwise("policy_blocked")
    ready = best.select(plan, "artifact_id", F.col("best.parser_id").alias("parser_id"), F.col("best.cost").alias("cost"), F.transform(fallbacks, lambda o: o["parser_id"]).alias("names"), F.transform(fallbacks, lambda o: o["cost"]).alias("costs"), blocker.alias("blocker"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group, left, out = group.sort_values("artifact_id"), budget, []
        for p, a, parser, cost, names, costs, why in group.itertuples(index=False):
            if why is not None:
                out.append((p, a, None, [], 0, why))
                continue
            limit = min(route_limit, left)
            if cost > limit:
                out.append((p, a, None, [], 0, "budget_exhausted"))
                continue
            spent, taken = int(cost), []
            for name, more in zip(names, costs, strict=True):
                if spent + more <= limit:
                    taken.append(name)
                    spent += int(more)
            left -= spent
            out.append((p, a, parser, taken, spent, None))
        return pd.DataFrame(out, columns=["p", "a", "parser_id", "fallbacks", "cost", "blocker"])

    kinds = dict(artifacts.dtypes)
    out = ready.groupBy(plan).applyInPandas(run, f"p {kinds[plan]}, a {kinds['artifact_id']}, parser_id string, fallbacks array<string>, cost long, blocker string")
    return out.withColumnsRenamed({"p": plan, "a": "artifact_id"})


def classification_blocker(unknown: Column, password: Column, damaged: Column, review: Column) -> Column:
    return F.when(unknown, "unknown").when(password, "password").when(damaged, "damaged").when(review, "review")


def coverage_cells(fields: DataFrame, families: DataFrame) -> DataFrame:
    """Field and source type pairs: each preference of a field (field_name, preferences) with the families
    (family, source_types) that can serve it."""
    wanted = fields.select("field_name", F.explode("preferences").alias("source_type"))
    offered = families.select("family", F.explode("source_types").alias("source_type"))
    return wanted.join(rules(offered), "source_type").groupBy("field_name", "source_type").agg(F.array_sort(F.collect_set("family")).alias("families"))


def new_queries(planned: DataFrame, executed: DataFrame, text: str) -> DataFrame:
    """Planned queries that were not executed yet, by their normalized text."""
    from tracewell.functions.text import normalize_query

    same = F.sha2(normalize_query(F.col(text)).cast("binary"), 256)
    done = executed.select(same.alias("_q"))
    return planned.withColumn("_q", same).join(done, "_q", "left_anti").drop("_q")


def acquisitions(downloads: DataFrame, approvals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(objects, edges, skipped) of downloads (candidate_id, locator, license, byte_sha256, size_bytes).

    A source without license is skipped unless an approval names that exact locator. Bytes are kept once, under their
    hash; every acquisition is an edge to them; a locator counts once for each candidate.
    """
    rest = F.struct("license", "byte_sha256", "size_bytes")
    # of several downloads of a locator one with a license, then that with the least digest
    first = downloads.groupBy("candidate_id", "locator").agg(F.min_by(rest, F.struct(F.col("license").isNull(), "license", "byte_sha256")).alias("_r"))
    once = first.select("candidate_id", "locator", "_r.*")
    approved = once.join(approvals.select("candidate_id", "locator").distinct().withColumn("_ok", F.lit(True)), ["candidate_id", "locator"], "left")
    free = F.col("license").isNotNull() | F.coalesce("_ok", F.lit(False))
    taken = approved.where(free).drop("_ok")
    object_id = F.concat(F.lit("brz_"), F.left("byte_sha256", F.lit(32)))
    objects = taken.groupBy("byte_sha256").agg(F.max("size_bytes").alias("size_bytes"), F.count(F.lit(1)).alias("acquisitions")).select(object_id.alias("object_id"), "byte_sha256", "size_bytes", "acquisitions")
    return objects, taken.select("candidate_id", "locator", object_id.alias("object_id")), approved.where(~free).select("candidate_id", "locator", F.lit("license_missing").alias("reason"))


#: Suffixes of addresses that are files themselves.
DIRECT_SUFFIXES = (
    ".csv",
    ".fits",
    ".geojson",
    ".grb",
    ".grib",
    ".h5",
    ".hdf5",
    ".json",
    ".nc",
    ".parquet",
    ".pdf",
    ".tif",
    ".tiff",
    ".tsv",
    ".txt",
    ".xls",
    ".xlsx",
    ".zip",
)


def promote(sources: DataFrame, group: str, promoted: int = 2, most: int = 5) -> DataFrame:
    """The sources that each group fetches, with their position: those to download in their own order, then at most
    ``promoted`` of those to inspect (direct files first, then by relevance, then in their order), ``most`` in all.

    sources: group, url, action, relevance, order. Only https addresses count, and an address to download is not
    inspected as well. A missing relevance is 0."""
    https = sources.where(F.col("url").rlike("(?i)^https://"))
    take = https.where("action = 'download'")
    look = https.where("action = 'inspect'").join(take.select(group, "url").distinct(), [group, "url"], "left_anti")
    path = F.lower(F.regexp_extract("url", r"^[^:]+://[^/?#]*([^?#]*)", 1))
    direct = F.lit(False)
    for suffix in DIRECT_SUFFIXES:
        direct = direct | F.endswith(path, F.lit(suffix))
    rank = Window.partitionBy(group).orderBy(F.desc("_direct"), F.desc("_relevance"), "order")
    look = look.withColumns({"_direct": direct, "_relevance": F.coalesce("relevance", F.lit(0.0))}).withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= promoted)
    first = Window.partitionBy(group).orderBy("order")
    take = take.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= most)
    every = take.withColumn("_p", F.lit(0)).select(*sources.columns, "_p", "_r").unionByName(look.withColumn("_p", F.lit(1)).select(*sources.columns, "_p", "_r"))
    return every.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy("_p", "_r"))).where(F.col("position") <= most).drop("_p", "_r")
