"""Selection's rules and reports, recorded parses, and table gates.

Capabilities, gates, fields and parsers are rule tables of a contract's size; claims, candidates, attempts and cells grow
with the data and are joined or grouped by a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a rule table up to which it is broadcast; a larger one is joined by a shuffle.
RULES = 100_000


def rules(df: DataFrame) -> DataFrame:
    """A rule table, broadcast while it is one by its size."""
    return F.broadcast(df) if len(df.limit(RULES + 1).select(F.lit(1)).collect()) <= RULES else df


def applicable_capabilities(capabilities: DataFrame, key: str, domains: list[str], source_types: list[str], fields: DataFrame) -> DataFrame:
    """Capabilities (key, domains, source_types) of one of the domains or generic, whatever their case, with a source
    type that the contract accepts and that some field (preferences) prefers. Null arrays match nothing."""
    low = F.transform("domains", lambda d: F.lower(d))
    fits = F.arrays_overlap(low, F.array(*[F.lit(d.lower()) for d in (*domains, "generic")]))
    accepted = F.array_intersect("source_types", F.array(*[F.lit(s) for s in source_types]).cast("array<string>"))
    offered = capabilities.where(fits).select(key, F.explode(accepted).alias("_type"))
    preferred = fields.select(F.explode("preferences").alias("_type")).distinct()
    return capabilities.join(offered.join(preferred, "_type", "left_semi").select(key).distinct(), key, "left_semi")


def routing_mode(packs: DataFrame, available: list[str], generic: list[str]) -> DataFrame:
    """Packs (pack, required) with what they lack of the available capabilities, in order, and the mode that leaves:
    formal if nothing is missing, generic if the generic pack can run instead, else unsupported (and the generic pack's
    missing ones are listed too)."""
    have = F.array(*[F.lit(a) for a in available]).cast("array<string>")
    lacking = F.array_sort(F.array_except(F.coalesce("required", F.array().cast("array<string>")), have))
    absent = sorted(set(generic) - set(available))
    more = F.array(*[F.lit(a) for a in absent]).cast("array<string>")
    mode = F.when(F.size(lacking) == 0, "formal").otherwise("unsupported" if absent else "generic")
    return packs.select("*", F.when(F.size(lacking) == 0, lacking).otherwise(F.array_sort(F.array_union(lacking, more))).alias("missing"), mode.alias("mode"))


def eligible_sources(sources: DataFrame, claims: DataFrame, key: str, categories: list[str]) -> DataFrame:
    """Sources (key, categories) of an applicable category with at least one claim."""
    some = F.arrays_overlap("categories", F.array(*[F.lit(c) for c in categories]).cast("array<string>"))
    return sources.where(some).join(claims.select(key), key, "left_semi")


def coverage_ratios(fields: DataFrame, source_types: DataFrame) -> DataFrame:
    """Shares of required fields, entity keys and source types that are covered. fields: required, entity_key, state;
    source_types: state. A share of nothing is 1, but of no source types null."""
    hit = (F.col("state") == "covered").cast("int")
    share = lambda of: F.coalesce(F.avg(F.when(F.col(of), hit)), F.lit(1.0))
    row = fields.agg(share("required").alias("required_ratio"), share("entity_key").alias("entity_ratio"))
    types = source_types.agg(F.avg(hit).alias("source_type_ratio"))
    return row.join(F.broadcast(types))  # two rows of one


def gate_coverage(gates: DataFrame, fields: DataFrame) -> DataFrame:
    """Gates (gate, kind, fields, threshold, blocking) with covered and missing fields in the gate's order, the share and
    the state. fields: field_name, state. An any_of_fields gate needs one field, another its threshold."""
    each = gates.select("gate", F.posexplode("fields").alias("_at", "field_name"))
    known = each.join(fields.select("field_name", (F.col("state") == "covered").alias("_in")), "field_name", "left")
    entry = F.struct("_at", "field_name")
    listed = known.groupBy("gate").agg(
        F.array_sort(F.collect_list(F.when(F.col("_in"), entry))).alias("_in"), F.array_sort(F.collect_list(F.when(~F.coalesce("_in", F.lit(False)), entry))).alias("_out"), F.count(F.lit(1)).alias("_n")
    )
    names = lambda c: F.transform(c, lambda s: s["field_name"])
    out = gates.join(listed, "gate", "left").select("gate", "kind", "threshold", "blocking", names("_in").alias("covered"), names("_out").alias("missing"), (F.size("_in") / F.col("_n")).alias("ratio"))
    met = F.when(F.col("kind") == "any_of_fields", F.size("covered") > 0).otherwise(F.col("ratio") >= F.col("threshold"))
    return out.withColumn("state", F.when(met, "satisfied").when(F.size("covered") > 0, "partial").otherwise("unsatisfied"))


def rank_parses(results: DataFrame, route: str) -> DataFrame:
    """Candidates of each route with their rank: fewest failed checks, then the highest least score, the lowest cost,
    parser and id. results: route, candidate_id, parser_id, cost and, for each check, passed and score."""
    judged = results.groupBy(route, "candidate_id", "parser_id", "cost").agg(F.count_if(~F.col("passed")).alias("failed"), F.min("score").alias("least_score"))
    order = Window.partitionBy(route).orderBy("failed", F.desc("least_score"), "cost", "parser_id", "candidate_id")
    return judged.withColumn("rank", F.row_number().over(order).cast("long"))


def parse_attempts(routes: DataFrame, recorded: DataFrame, budget: int) -> DataFrame:
    """What became of each parser of a route: succeeded, failed, quality_failed, blocked or not_run.

    routes: route, position (0 is the primary), parser_id, trigger (the check whose failure lets a fallback run).
    recorded: route, parser_id, status, failed_checks and cost of parsers as they would run; a parser without a record is
    unavailable. The primary runs first; a fallback runs only if its trigger failed before, is blocked if something else
    failed, and nothing runs after a success, after a primary that could not start, or beyond the route's budget. A fold
    over a route's parsers, which are few by nature."""
    known = routes.join(recorded, ["route", "parser_id"], "left")
    entry = F.struct("position", "parser_id", "trigger", "status", F.coalesce("failed_checks", F.array().cast("array<string>")).alias("checks"), F.coalesce(F.col("cost").cast("long"), F.lit(0).cast("long")).alias("cost"))
    listed = known.groupBy("route").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    start = F.struct(
        F.lit(False).alias("over"), F.lit(False).alias("broke"), F.lit(False).alias("weak"), F.lit(0).cast("long").alias("spent"), F.array().cast("array<string>").alias("checks"),
        F.array().cast("array<struct<position:int,parser_id:string,outcome:string,reason:string>>").alias("out"),
    )

    def step(s: Column, x: Column) -> Column:
        first = x["position"] == 0
        cannot = F.when(x["status"].isNull(), "parser_unavailable").when(s["spent"] + x["cost"] > budget, "budget_exhausted")
        triggered = first | F.coalesce(F.array_contains(s["checks"], x["trigger"]), F.lit(False))
        failed_before = s["broke"] | s["weak"]
        told = F.when(s["broke"], F.coalesce(cannot, F.lit("quality_unsatisfied"))).otherwise("quality_unsatisfied")
        outcome = F.when(s["over"] | (~triggered & ~failed_before), "not_run").when(~triggered, "blocked").when(cannot.isNotNull(), "blocked").otherwise(x["status"])
        reason = F.when(outcome != "blocked", F.lit(None).cast("string")).when(~triggered, told).otherwise(cannot)
        ran = outcome.isin("succeeded", "failed", "quality_failed")
        return F.struct(
            (s["over"] | (outcome == "succeeded") | (outcome == "not_run") | (first & (outcome == "blocked"))).alias("over"),
            (s["broke"] | (outcome == "failed")).alias("broke"),
            (s["weak"] | (outcome == "quality_failed")).alias("weak"),
            (s["spent"] + F.when(ran, x["cost"]).otherwise(F.lit(0).cast("long"))).alias("spent"),
            F.when(ran, F.concat(s["checks"], x["checks"])).otherwise(s["checks"]).alias("checks"),
            F.array_append(s["out"], F.struct(x["position"].cast("int").alias("position"), x["parser_id"].alias("parser_id"), outcome.alias("outcome"), reason.alias("reason"))).alias("out"),
        )

    return listed.select("route", F.explode(F.aggregate("all", start, step, lambda s: s["out"])).alias("a")).select("route", "a.*")


def table_quality(headers: DataFrame, least: float = 0.9) -> DataFrame:
    """Score and verdict of tables by their header cells (table_id, column_index, header): 1 if every header is filled and
    stands once, .75 otherwise. Tables without header cells are not listed."""
    counts = headers.groupBy("table_id", "header").agg(F.count(F.lit(1)).alias("n"))
    blank = F.trim(F.coalesce("header", F.lit(""))) == ""
    sums = counts.groupBy("table_id").agg(F.max("n").alias("most"), F.count_if(blank).alias("blanks"), F.sum("n").alias("columns"))
    score = F.when((F.col("most") == 1) & (F.col("blanks") == 0), 1.0).otherwise(0.75)
    return sums.select("table_id", "columns", score.alias("score"), (score >= least).alias("passed"))


def usable_tables(cells: DataFrame, quality: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cells of tables that passed, and a gap for each that did not."""
    gaps = quality.where("not passed").select("table_id", F.lit("table_quality_failed").alias("reason"))
    return cells.join(quality.where("passed").select("table_id"), "table_id", "left_semi"), gaps


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The join of two sides that must have each key once and the same keys; reading the result fails otherwise.

    Nulls are no keys: a row without one fails too."""
    a = left.select(F.col(key), F.struct(*[c for c in left.columns if c != key]).alias("_l"))
    b = right.select(F.col(key), F.struct(*[c for c in right.columns if c != key]).alias("_r"))
    a = a.groupBy(key).agg(F.first("_l").alias("_l"), F.count(F.lit(1)).alias("_ln"))
    b = b.groupBy(key).agg(F.first("_r").alias("_r"), F.count(F.lit(1)).alias("_rn"))
    both = a.join(b, key, "full_outer")
    sound = F.col(key).isNotNull() & F.coalesce(F.col("_ln") == 1, F.lit(False)) & F.coalesce(F.col("_rn") == 1, F.lit(False))
    checked = F.when(sound, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("not one to one at "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(dict(left.dtypes)[key]))
    return both.select(checked.alias(key), "_l.*", "_r.*")


def unverified(constraints: DataFrame) -> DataFrame:
    """Selection constraints as scopes: their text is carried along and never evaluated."""
    return constraints.select("*", F.lit("unverified").alias("state"))


def page_loop(pages: DataFrame, query: str, max_pages: int, max_results: int, max_bytes: int) -> DataFrame:
    """Recorded pages of each query (query, page, token, next_token, results, bytes) with what the loop makes of them:
    accepted, then why it ends: end (no next page), page_limit, result_limit, byte_limit, repeated_token, or not_read for
    the pages after that. ``taken`` counts the results kept of a page."""
    w = Window.partitionBy(query).orderBy("page")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    seen = F.array_contains(F.coalesce(F.collect_set("token").over(before), F.array().cast("array<string>")), F.col("token"))
    rows = pages.select(
        "*", F.row_number().over(w).alias("_n"), earlier("results").alias("_had"), F.sum("bytes").over(upto).alias("_bytes"),
        F.coalesce(seen, F.lit(False)).alias("_seen"), F.lag("next_token").over(w).alias("_asked"),
    )
    stop = (
        F.when((F.col("_n") > 1) & F.col("_asked").isNull(), "end")
        .when(F.col("_n") > max_pages, "page_limit")
        .when(F.col("_had") >= max_results, "result_limit")
        .when(F.col("_seen"), "repeated_token")
        .when(F.col("_bytes") > max_bytes, "byte_limit")
    )
    first = F.min(F.when(F.col("_stop").isNotNull(), F.col("_n"))).over(Window.partitionBy(query))
    rows = rows.withColumn("_stop", stop).withColumn("_first", first)
    state = F.when(F.col("_first").isNull() | (F.col("_n") < F.col("_first")), "accepted").when(F.col("_n") == F.col("_first"), F.col("_stop")).otherwise("not_read")
    taken = F.when(state == "accepted", F.least(F.col("results"), max_results - F.col("_had"))).otherwise(F.lit(0))
    return rows.select(*pages.columns, state.alias("state"), taken.cast("long").alias("taken"))


#: Statuses that lead elsewhere, and those that a later attempt may not meet again.
REDIRECTS = (301, 302, 303, 307, 308)
RETRYABLE = (408, 425, 429, 500, 502, 503, 504)


def download_verdicts(responses: DataFrame, max_bytes: int) -> DataFrame:
    """Recorded responses (status, encoding, declared_bytes, bytes) with their error, if any, and whether trying again may
    help. Only a whole answer of status 200 in its own encoding is taken; a null status is an answer that never came."""
    status, declared = F.col("status"), F.col("declared_bytes")
    error = (
        F.when(status.isNull(), "timeout")
        .when(status == 206, "incomplete_response")
        .when(status != 200, "http_error")
        .when(~F.lower(F.coalesce("encoding", F.lit("identity"))).isin("", "identity"), "content_encoding_unsupported")
        .when(declared > max_bytes, "response_too_large")
        .when(F.col("bytes") > max_bytes, "response_too_large")
        .when(F.col("bytes") == 0, "empty_response")
        .when(declared.isNotNull() & (declared != F.col("bytes")), "incomplete_response")
    )
    cut = (error == "incomplete_response") & (status == 200)
    again = (error == "timeout") | cut | ((error == "http_error") & status.isin(*RETRYABLE))
    return responses.select("*", error.alias("error"), F.coalesce(again, F.lit(False)).alias("retryable"))


def download_chains(hops: DataFrame, request: str, allowed_hosts: list[str], max_redirects: int, max_bytes: int) -> DataFrame:
    """One row for each request: the address that its redirects end at, how many were followed, and the error, if any.

    hops: request, hop (from 0), url, location, status, encoding, declared_bytes, bytes: the recorded answers of a request in
    order. A redirect needs a location at an allowed https host (no user, fragment or other port) and may be followed
    ``max_redirects`` times; the first answer that is no redirect, or the first redirect that may not be followed, decides.
    A chain that breaks off has a timeout. Each request is one aggregate over its hops: nothing is sorted."""
    allowed = lambda u: F.coalesce(u.rlike(r"(?i)^https://[^/?#@:]+(?::(?:443)?)?(?:[/?][^#]*)?$") & F.regexp_replace(F.lower(F.regexp_extract(u, r"(?i)^https://([^/?#@:]+)", 1)), r"\.+$", "").isin(*allowed_hosts), F.lit(False))
    leads = F.col("status").isin(*REDIRECTS)
    judged = download_verdicts(hops, max_bytes)
    stop = (
        F.when(~allowed(F.col("url")), "host_not_allowed")
        .when(leads & (F.coalesce("location", F.lit("")) == ""), "redirect_blocked")
        .when(leads & (F.col("hop") >= max_redirects), "redirect_limit")
        .when(leads & ~allowed(F.col("location")), "host_not_allowed")
        .when(leads, None)
        .otherwise(F.coalesce("error", F.lit("none")))
    )
    judged = judged.withColumn("_stop", stop)
    at = F.when(F.col("_stop").isNotNull(), F.col("hop"))
    ends = judged.groupBy(request).agg(
        F.min_by(F.struct("url", "_stop", "retryable"), at).alias("_end"),
        F.min(at).alias("_at"),
        F.max_by("location", "hop").alias("_next"),
        F.count(F.lit(1)).alias("_n"),
    )
    done = F.col("_end").isNotNull()
    return ends.select(
        request,
        F.when(done, F.col("_end.url")).otherwise(F.col("_next")).alias("final_url"),
        F.when(done, F.col("_at")).otherwise(F.col("_n")).cast("long").alias("redirects"),
        F.when(~done, "timeout").when(F.col("_end._stop") != "none", F.col("_end._stop")).alias("error"),
        F.when(~done, True).otherwise(F.col("_end.retryable") & F.col("_end._stop").isin("timeout", "http_error", "incomplete_response")).alias("retryable"),
    )


def search_graph(nodes: DataFrame, edges: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a text search: nodes (node, label, original) that contain it, whatever the case, with their
    neighbours, and the edges (source, target) among them. An empty text finds every node."""
    from tracewell.operators.retrieval import one_hop

    hit = F.contains(F.lower(F.concat_ws(" ", "label", "original")), F.lit(text.strip().lower()))
    near = one_hop(edges, nodes.where(hit).select("node"))
    inside = edges.join(near.select(F.col("node").alias("source")), "source", "left_semi").join(near.select(F.col("node").alias("target")), "target", "left_semi")
    return nodes.join(near, "node", "left_semi"), inside.select("source", "target")
