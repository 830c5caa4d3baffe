"""Discovery records: merging, scoring, coverage, selection, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import LICENSE_ALIASES, MACHINE_FORMATS, RESTRICTED_MARKERS, VIEWABLE_FORMATS
from tracewell.operators import keywords
from tracewell.session import dropped, written


def components(edges: DataFrame, checkpoint=None) -> DataFrame:
    """(id, component): the smallest id that edges (a, b) lead to. Edges with a null end are left out.

    Ids go by a hash, which is tested to tell them all apart. In each round a node joins the least of its neighbours, or
    what that joined, and edges are told anew between what is left, once each; hashes are in no order that ids could have,
    so edges shrink to a fraction in each round, and only the first meets them all. Each round is written to the shared
    folder, so the plan does not grow and a lost executor costs one round.
    """
    held = []

    def cut(df: DataFrame) -> DataFrame:
        held.append(checkpoint(df) if checkpoint else written(df, "components"))
        return held[-1]

    rows = edges.where("a is not null and b is not null")
    ends = lambda df: df.select(F.col("a").alias("id")).unionAll(df.select("b"))
    kind = ends(rows).schema["id"].dataType
    rows = cut(rows.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b")))
    ids, seed = cut(ends(rows).distinct()), 0
    number = lambda c: F.xxhash64(F.lit(seed), c)
    while not ids.groupBy(number("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        seed += 1
    links, joined = rows.select(number("a").alias("a"), number("b").alias("b")).where("a <> b"), []
    while True:
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = cut(both.groupBy(F.col("a").alias("n")).agg(F.least(F.col("a"), F.min("b")).alias("to")))
        if near.isEmpty():
            break
        joined.append(cut(near.join(near.select(F.col("n").alias("to"), F.col("to").alias("_next")), "to").select("n", F.col("_next").alias("to"))))
        for end in ("a", "b"):
            links = links.join(joined[-1].withColumnRenamed("n", end), end).drop(end).withColumnRenamed("to", end)
        links = cut(links.where("a <> b").distinct())
    groups = ids.select("id", number("id").alias("n"))
    # the rounds one after the other, from the smallest: all together are hardly more than the first
    last = None
    for step in reversed(joined):
        last = step if last is None else step.join(last.select(F.col("n").alias("to"), F.col("to").alias("_next")), "to", "left").select("n", F.coalesce("_next", "to").alias("to"))
    if last is not None:
        groups = groups.join(last, "n", "left").select("id", F.coalesce("to", "n").alias("n"))
    groups = cut(groups)
    least = groups.groupBy("n").agg(F.min("id").alias("component"))
    found = groups.join(least, "n").select("id", "component")
    if checkpoint:
        return found
    found = written(found, "components")
    for df in held:
        dropped(df)
    return found


def gather_attributes(df: DataFrame, group: str, attributes: list[str]) -> DataFrame:
    """Distinct values of each attribute of a group, in the order of their lower case."""
    return df.groupBy(group).agg(*[ordered_text(F.collect_set(a)).alias(a) for a in attributes])


def ordered_text(values: Column) -> Column:
    """Distinct texts in the order of their lower case, then of themselves; nulls left out."""
    pairs = F.transform(F.array_distinct(F.filter(values, lambda v: v.isNotNull())), lambda v: F.struct(F.lower(v).alias("l"), v.alias("v")))
    return F.transform(F.array_sort(pairs), lambda p: p["v"])


def access_score(statuses: Column) -> Column:
    return F.when(F.array_contains(statuses, "open"), 1.0).otherwise(0.0)


def license_score(labels: Column) -> Column:
    """1 if all labels are known open licenses, .5 if some are, 0 with a restricted one or none."""
    closed = F.exists(labels, lambda x: F.lower(x).rlike("|".join(RESTRICTED_MARKERS)))
    known = F.size(F.filter(labels, lambda x: x.isin(*sorted(set(LICENSE_ALIASES.values())))))
    return F.when(F.size(labels) == 0, 0.0).when(closed, 0.0).when(known == F.size(labels), 1.0).when(known > 0, 0.5).otherwise(0.0)


def format_score(formats: Column) -> Column:
    return F.when(F.exists(formats, lambda x: x.isin(*MACHINE_FORMATS)), 1.0).when(F.exists(formats, lambda x: x.isin(*VIEWABLE_FORMATS)), 0.35).otherwise(0.0)


def source_score(primary: Column, access: Column, license_: Column, formats: Column, completeness: Column) -> Column:
    return 0.25 * F.when(primary, 1.0).otherwise(0.0) + 0.20 * access + 0.15 * license_ + 0.20 * formats + 0.20 * completeness


def license_decision(labels: Column, access: Column) -> Column:
    """allowed: all that is known of access is open, and every label is a known open license. restricted: access is
    restricted somewhere and open nowhere. needs_review: the rest, unknown access and marked labels among it."""
    statuses = F.array_distinct(access)
    open_only = (F.size(statuses) == 1) & F.array_contains(statuses, "open")
    closed = F.array_contains(statuses, "restricted") & ~F.array_contains(statuses, "open")
    sure = lambda c: F.coalesce(c, F.lit(False))
    return F.when(sure(open_only & (license_score(labels) == 1.0)), "allowed").when(sure(closed), "restricted").otherwise("needs_review")


def claim_state(confidence_: Column) -> Column:
    """covered, uncertain or null by a claim's confidence."""
    return F.when(confidence_ >= 0.30, "covered").when(confidence_ >= 0.05, "uncertain")


def coverage(cells: DataFrame, claims: DataFrame) -> DataFrame:
    """State of each (field_name, source_type) cell: the best of its claims (field_name, source_type, confidence)."""
    best = claims.groupBy("field_name", "source_type").agg(F.max("confidence").alias("confidence"))
    return cells.join(best, ["field_name", "source_type"], "left").select("field_name", "source_type", F.coalesce(claim_state(F.col("confidence")), F.lit("uncovered")).alias("state"), "confidence")


def route(df: DataFrame, key: str, text: str, rules: list[tuple[str, str, float]]) -> DataFrame:
    """key, pack, score, votes and confidence by the keyword rules (pack, term, weight) whose term stands in the text."""
    book = df.sparkSession.createDataFrame(rules, "pack string, term string, weight double")
    return keywords.scores(keywords.find_terms(df, key, text, book), key)


def select_sources(claims: DataFrame, group: str, max_sources: int, max_bytes: int) -> DataFrame:
    """Greedy cover for each task: again and again the source that adds most uncovered cells (ties: higher score,
    fewer bytes, id) and fits the budget. claims: group, source_id, cell, score, bytes. A round is one aggregate with
    map-side combine over all tasks' sources; only what is covered and spent of each task goes from round to round."""
    cover = written(claims.groupBy(group, "source_id").agg(F.collect_set("cell").alias("_cells"), F.max("score").alias("_score"), F.max("bytes").alias("_bytes")).where(F.size("_cells") > 0), "cover")
    name = F.col(group).alias("_group")
    nothing = F.array().cast(cover.schema["_cells"].dataType)
    state = written(cover.select(name).distinct().select("_group", nothing.alias("_done"), F.lit(0).cast("long").alias("_spent")), "covered")
    picked = []
    for position in range(1, max_sources + 1):
        left = cover.join(state, F.col(group).eqNullSafe(F.col("_group"))).where(F.col("_spent") + F.col("_bytes") <= max_bytes)
        gain = left.withColumn("_gain", F.size(F.array_except("_cells", "_done")).cast("long")).where("_gain > 0")
        # a negated score: of equal gains the highest comes first
        place = F.struct((-F.col("_gain")).alias("a"), (-F.col("_score")).alias("b"), F.col("_bytes").alias("c"), F.col("source_id").alias("d"))
        best = gain.groupBy(group).agg(F.min_by(F.struct("source_id", "_gain", "_cells", "_bytes", "_done", "_spent"), place).alias("_b"))
        step = written(best.select(group, F.lit(position).cast("long").alias("position"), "_b.*"), "covered")
        picked.append(step.select(group, "position", "source_id", F.col("_gain").alias("gain")))
        if position == max_sources or step.isEmpty():
            break
        state = step.select(name, F.array_union("_done", "_cells").alias("_done"), (F.col("_spent") + F.col("_bytes")).alias("_spent"))
    out = picked[0]
    for more in picked[1:]:
        out = out.unionByName(more)
    return out
