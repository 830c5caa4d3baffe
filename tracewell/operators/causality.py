"""The causal log: which event led to which, how deep, from which root; and what is wrong with a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import dropped, written

#: The kinds of events.
EVENT_TYPES = (
    "task.created",
    "task.accepted",
    "task.rejected",
    "problem.compiled",
    "routing.completed",
    "contract.compiled",
    "contract.confirmed",
    "search.plan.created",
    "connector.batch.completed",
    "selection.completed",
    "search.completed",
    "artifact.stored",
    "artifact.download.completed",
    "parse.plan.created",
    "document.parsed",
    "table.parsed",
    "field.extracted",
    "field.mapped",
    "record.normalized",
    "entity.resolved",
    "fusion.completed",
    "quality.gated",
    "knowledge.updated",
    "figure.digitized",
    "dataset.parsed",
    "quality.issue.created",
    "review.resolved",
    "delivery.completed",
)


def causes(events: DataFrame, event: str, cause: str) -> DataFrame:
    """event, root, depth and state of each event: rooted (its first cause is in the log), orphan (the first event that the
    log has of its chain names a cause that the log lacks) or cycle (its chain never ends; no root and no depth).

    An event that occurs several times counts once, with its least cause; a null event is left out. Each round every open
    event takes over what the event it points to has found, or points to where that points (so a chain of n events ends
    after about log2 n rounds). Ended events leave the rounds; what is still open when all chains must have ended is a cycle.
    An event that very many others name is one row of the smaller side of an ordinary join. Events that nobody names take no
    part in the rounds: they follow what they point to once, at the end.
    """
    kind = events.schema[event].dataType
    told = events.where(F.col(event).isNotNull())
    ids = told.select(F.col(event).alias("id"), F.col(cause).cast(kind).alias("up"), F.lit(True).alias("_own"), F.lit(False).alias("_named"))
    named = told.where(F.col(cause).isNotNull()).select(F.col(cause).cast(kind).alias("id"), F.lit(None).cast(kind).alias("up"), F.lit(False).alias("_own"), F.lit(True).alias("_named"))
    nodes = written(ids.unionAll(named).groupBy("id").agg(F.min("up").alias("up"), F.max("_own").alias("_own"), F.max("_named").alias("_named")), "causes")
    log = nodes.where("_own and _named").select("id", "up")
    start = written(log.join(log.select(F.col("id").alias("up"), F.lit(True).alias("_there")), "up", "left"), "causes")
    ended = start.where("_there is null").select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("depth"), F.col("up").isNotNull().alias("orphan"))
    open_ = start.where("_there").select("id", "up", F.lit(1).cast("long").alias("steps"))
    done, rounds = [ended], max(1, start.count()).bit_length() + 1
    held = [nodes, start]
    for _ in range(rounds):
        if open_.isEmpty():
            break
        # what the event pointed to is: ended before, or still on its way
        target = done[-1].select(F.col("id").alias("up"), "root", "depth", "orphan", F.lit(None).cast(log.schema["up"].dataType).alias("_to"), F.lit(0).cast("long").alias("_more"))
        for d in done[:-1]:
            target = target.unionByName(d.select(F.col("id").alias("up"), "root", "depth", "orphan", F.lit(None).cast(log.schema["up"].dataType).alias("_to"), F.lit(0).cast("long").alias("_more")))
        way = open_.select(F.col("id").alias("up"), F.lit(None).cast(log.schema["id"].dataType).alias("root"), F.lit(None).cast("long").alias("depth"), F.lit(None).cast("boolean").alias("orphan"), F.col("up").alias("_to"), F.col("steps").alias("_more"))
        step = written(open_.join(target.unionByName(way), "up"), "causes")
        held.append(step)
        done.append(step.where("root is not null").select("id", "root", (F.col("steps") + F.col("depth")).alias("depth"), "orphan"))
        open_ = step.where("root is null").select("id", F.col("_to").alias("up"), (F.col("steps") + F.col("_more")).alias("steps"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    lost = open_.select("id", F.lit(None).cast(log.schema["id"].dataType).alias("root"), F.lit(None).cast("long").alias("depth"), F.lit(None).cast("boolean").alias("orphan"))
    inner = written(out.unionByName(lost), "causes")
    held.append(inner)
    # what a leaf points to has a row if the log has it
    leaves = nodes.where("_own and not _named").select("id", "up")
    above = inner.select(F.col("id").alias("up"), "root", "depth", "orphan", F.lit(True).alias("_there"))
    first = F.col("_there").isNull()
    last = leaves.join(above, "up", "left").select("id", F.when(first, F.col("id")).otherwise(F.col("root")).alias("root"), F.when(first, F.lit(0).cast("long")).otherwise(F.col("depth") + 1).alias("depth"), F.when(first, F.col("up").isNotNull()).otherwise(F.col("orphan")).alias("orphan"))
    state = F.when(F.col("orphan").isNull(), "cycle").when(F.col("orphan"), "orphan").otherwise("rooted")
    found = written(inner.unionByName(last).select(F.col("id").alias(event), "root", "depth", state.alias("state")), "causal-log")
    for table in held:
        dropped(table)
    return found


def log_problems(events: DataFrame, event: str, kind: str, at: str, cause: str, kinds: tuple[str, ...] = EVENT_TYPES) -> DataFrame:
    """event and problem, one row for each thing that is wrong with an event: event_missing, event_repeated, kind_unknown,
    time_without_zone (a text without an offset is refused), caused_by_itself, cause_missing, causal_cycle."""
    zone = F.col(at).cast("string").rlike(r"(?:[Zz]|[+-][0-9]{2}:?[0-9]{2})$")
    own = F.array_compact(
        F.array(
            F.when(F.col(event).isNull(), "event_missing"),
            F.when(~F.coalesce(F.col(kind).isin(*kinds), F.lit(False)), "kind_unknown"),
            F.when(~F.coalesce(zone, F.lit(False)), "time_without_zone"),
            F.when(F.col(event) == F.col(cause), "caused_by_itself"),
        )
    )
    rows = events.select(F.col(event), F.explode(own).alias("problem"))
    again = events.where(F.col(event).isNotNull()).groupBy(event).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(event, F.lit("event_repeated").alias("problem"))
    known = events.select(F.col(event).alias(cause)).where(F.col(cause).isNotNull()).distinct()
    missing = events.where(F.col(cause).isNotNull()).join(known, cause, "left_anti").select(event, F.lit("cause_missing").alias("problem"))
    loops = causes(events, event, cause).where("state = 'cycle'").select(event, F.lit("causal_cycle").alias("problem"))
    return rows.unionByName(again).unionByName(missing).unionByName(loops)
