"""Intake: policy of requests, keys that must not change their request, and what a goal leaves open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import squeeze
from tracewell.functions.values import stable_id

#: Goals that name nothing, and words that bound nothing.
TOO_BROAD_GOALS = ("data", "find data", "help me", "research", "science", "找数据", "数据", "研究", "科研")
AMBIGUOUS_SCOPE = r"(?i)\b(?:recent|nearby|high|low|large|small|soon)\b|最近|近期|附近|较高|较低|大量|少量"
PRIVATE = ("sensitive", "restricted")


def policy_problems(goal: Column, external: Column, privacy: Column) -> Column:
    """What task policy finds: a goal that names nothing, and outside models asked for where privacy forbids them."""
    return F.array_compact(
        F.array(
            F.when(F.lower(squeeze(F.coalesce(goal, F.lit("")))).isin(*TOO_BROAD_GOALS), "goal_needs_clarification"),
            F.when(F.coalesce(external, F.lit(False)) & privacy.isin(*PRIVATE), "external_model_disabled"),
        )
    )


def external_allowed(external: Column, privacy: Column) -> Column:
    return F.coalesce(external & ~privacy.isin(*PRIVATE), F.lit(False))


def intake_outcomes(requests: DataFrame, key: str, digest: str, order: str) -> DataFrame:
    """Requests with what becomes of each: new for the first of its key, replayed for the same request again, conflict for
    another one under the same key. The first of a key is an aggregate, so a hot key is not sorted."""
    first = requests.groupBy(key).agg(F.min(F.struct(F.col(order).alias("o"), F.col(digest).alias("d"))).alias("_first"))
    outcome = F.when((F.col(order) == F.col("_first.o")) & F.col(digest).eqNullSafe(F.col("_first.d")), "new").when(F.col(digest).eqNullSafe(F.col("_first.d")), "replayed").otherwise("conflict")
    return requests.join(first, key).select(*requests.columns, outcome.alias("outcome"))


def ambiguities(text: Column, entities: Column, variables: Column, questions: Column) -> Column:
    """Codes of what must be settled before a goal is worked on; entities, variables and questions: how many were found."""
    scopes = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(AMBIGUOUS_SCOPE), F.lit(0))
    return F.array_compact(
        F.array(
            F.when(entities == 0, "missing_entity"),
            F.when(variables == 0, "missing_variable"),
            F.when(questions > 1, "multiple_independent_questions"),
            F.when(F.size(scopes) > 0, "ambiguous_scope"),
        )
    )


def clarification(text: Column, codes: Column) -> Column:
    """The one question that settles all codes, as an id and its language; null where there is nothing to settle."""
    language = F.when(text.rlike("[\\u4e00-\\u9fff]"), "zh").otherwise("en")
    return F.when(F.size(codes) > 0, F.struct(stable_id("clar_", F.array_join(codes, "|")).alias("question_id"), language.alias("language"), codes.alias("resolves")))


def assumptions(temporal: Column, spatial: Column, outputs: Column) -> Column:
    """What is assumed for scopes and outputs that a goal does not name."""
    return F.array_compact(F.array(F.when(~temporal, "no_temporal_filter"), F.when(~spatial, "no_spatial_filter"), F.when(~outputs, "output_format_open")))


def unsupported_recall(df: DataFrame, expected: str, status: str) -> DataFrame:
    """Share of the requests expected to be unsupported that were found so; 0 if none was expected."""
    hit = F.avg(F.when(F.col(expected), (F.col(status) == "unsupported").cast("int")))
    return df.agg(F.coalesce(hit, F.lit(0.0)).alias("unsupported_recall"))
