"""Source selection: again and again the source that adds most to what a task's contract asks for.

Coverage is kept in bitmaps of the contract's fields and types, so a candidate is one short row and a task's state is one
row, however many claims there are. A round is one aggregate over the candidates (a least key, combined where they are
read); there are as many rounds as sources may be selected. Gains only shrink, so a candidate that adds nothing leaves the
rounds, and of candidates that are alike in all but score and id only as many stay as may still be selected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.discovery import license_decision
from tracewell.session import dropped, written

#: Fields or types in one number.
WORD = 60


@dataclass(frozen=True)
class Policy:
    """What a selection asks for and may spend. Names stand in the contract's order."""

    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    least_categories: int = 1
    want_primary: bool = True
    most: int = 5
    available_bytes: int = 1 << 60
    reserved_bytes: int = 1

    @property
    def limit(self) -> int:
        return min(self.most, self.available_bytes // self.reserved_bytes)

    @property
    def category_target(self) -> int:
        return min(self.least_categories, len(self.categories))


def _words(names: tuple[str, ...]) -> int:
    return max(1, -(-len(names) // WORD))


def _bits(names: tuple[str, ...], value: Column, when: Column) -> list[Column]:
    """Bitmaps of the names among ``value``, by word."""
    out = []
    for w in range(_words(names)):
        bits = F.lit(0).cast("long")
        for i, name in enumerate(names[w * WORD : (w + 1) * WORD]):
            bits = F.when(when & (value == name), F.lit(1 << i).cast("long")).otherwise(bits)
        out.append(F.coalesce(F.bit_or(bits), F.lit(0).cast("long")))
    return out


def compact(claims: DataFrame, candidates: DataFrame, group: str, policy: Policy) -> DataFrame:
    """One row for each candidate with a claim and a category of the policy's.

    claims: group, candidate_id, field_name, state (covered or uncertain), source_types. candidates: group, candidate_id,
    categories (in order), primary, labels, access, direct, score; a candidate stands there once."""
    covered, uncertain = F.col("state") == "covered", F.col("state") == "uncertain"
    field = F.col("field_name")
    masks = {"r": _bits(policy.required, field, covered), "u": _bits(policy.required, field, uncertain), "o": _bits(policy.optional, field, covered)}
    own = claims.groupBy(group, "candidate_id").agg(*(c.alias(f"{k}{i}") for k, cs in masks.items() for i, c in enumerate(cs)))
    typed = claims.where(covered).select(group, "candidate_id", F.explode("source_types").alias("t")).groupBy(group, "candidate_id").agg(*(c.alias(f"t{i}") for i, c in enumerate(_bits(policy.types, F.col("t"), F.lit(True)))))
    eligible = F.filter("categories", lambda c: c.isin(*policy.categories)) if policy.categories else F.array().cast("array<string>")
    facts = candidates.select(
        group,
        "candidate_id",
        eligible.alias("categories"),
        F.coalesce("primary", F.lit(False)).alias("primary"),
        (license_decision(F.col("labels"), F.col("access")) == "allowed").alias("allowed"),
        F.coalesce("direct", F.lit(False)).alias("direct"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
    every = own.join(typed, [group, "candidate_id"], "left").fillna(0, [f"t{i}" for i in range(_words(policy.types))])
    every = every.join(facts, [group, "candidate_id"]).where(F.size("categories") > 0)
    alike = [c for c in every.columns if c not in ("candidate_id", "score")]
    order = Window.partitionBy(*alike).orderBy(F.desc("score"), "candidate_id")
    return every.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= policy.limit).drop("_n")


def select_sources(claims: DataFrame, candidates: DataFrame, group: str, policy: Policy) -> DataFrame:
    """group, position, candidate_id, category (the one it is taken for), required_gain, marginal and cumulative coverage of
    the required fields.

    Each step takes the candidate with most new required fields, then most uncertain ones among the uncovered, a primary
    source where none is selected yet, most new types, a new category while too few are, most new optional fields, an
    allowed license, a direct address, the higher score and the smaller id. It ends when nothing is added any more, or at
    the policy's limits."""
    widths = {"r": _words(policy.required), "o": _words(policy.optional), "t": _words(policy.types)}
    rows = written(compact(claims, candidates, group, policy), "candidates")
    zero = F.lit(0).cast("long")
    state = rows.select(group).distinct().select(
        group,
        *(zero.alias(f"have_{k}{i}") for k, n in widths.items() for i in range(n)),
        F.array().cast("array<string>").alias("have_categories"),
        F.lit(False).alias("have_primary"),
        F.array().cast(f"array<{dict(rows.dtypes)['candidate_id']}>").alias("used"),
    )
    total = float(len(policy.required))
    taken, held = None, []
    for position in range(1, policy.limit + 1):
        new = lambda k, have: sum((F.bit_count(F.col(f"{k}{i}").bitwiseAND(F.bitwise_not(F.col(f"have_{have}{i}")))) for i in range(widths[have])), F.lit(0))
        both = rows.join(state, group).where(~F.array_contains("used", F.col("candidate_id")))
        free = F.filter("categories", lambda c: ~F.array_contains("have_categories", c))
        assigned = F.coalesce(F.get(free, F.lit(0)), F.get("categories", F.lit(0)))
        gain = {
            "required": new("r", "r"),
            "uncertain": new("u", "r"),
            "primary": (F.lit(policy.want_primary) & ~F.col("have_primary") & F.col("primary")).cast("int"),
            "types": new("t", "t"),
            "category": ((F.size("have_categories") < policy.category_target) & (F.size(free) > 0)).cast("int"),
            "optional": new("o", "o"),
        }
        both = both.withColumn("_assigned", assigned).withColumns({f"_{k}": c for k, c in gain.items()})
        useful = F.greatest(*(F.col(f"_{k}") for k in gain)) > 0
        key = F.struct(*(-F.col(f"_{k}") for k in gain), (-F.col("allowed").cast("int")), (-F.col("direct").cast("int")), -F.col("score"), "candidate_id")
        pick = F.struct("candidate_id", "_assigned", "_required", "primary", *(f"{k}{i}" for k, n in widths.items() for i in range(n)))
        best = both.where(useful).groupBy(group).agg(F.min_by(pick, key).alias("pick"))
        step = state.join(best, group)
        have = [F.col(f"have_{k}{i}").bitwiseOR(F.col(f"pick.{k}{i}")).alias(f"have_{k}{i}") for k, n in widths.items() for i in range(n)]
        step = step.select(
            group,
            *have,
            F.array_union("have_categories", F.array("pick._assigned")).alias("have_categories"),
            (F.col("have_primary") | F.col("pick.primary")).alias("have_primary"),
            F.array_append("used", F.col("pick.candidate_id")).alias("used"),
            F.lit(position).alias("position"),
            F.col("pick._assigned").alias("category"),
            F.col("pick._required").cast("long").alias("required_gain"),
            sum((F.bit_count(F.col(f"have_r{i}")) for i in range(widths["r"])), F.lit(0)).alias("_before"),
        )
        step = written(step, "picks")
        held.append(step)
        # a task without a useful candidate has none later either
        state = step.drop("position", "category", "required_gain", "_before")
        if step.isEmpty():
            break
        share = lambda n: n / total if total else F.lit(1.0)
        before = F.lit(0.0) if position == 1 else share(F.col("_before"))
        after = share(F.col("_before") + F.col("required_gain"))
        picks = step.select(group, "position", F.element_at("used", -1).alias("candidate_id"), "category", "required_gain", F.greatest(F.lit(0.0), after - before).alias("marginal"), after.alias("cumulative"))
        taken = picks if taken is None else taken.unionByName(picks)
    dropped(rows)
    if taken is None:
        kind = dict(candidates.dtypes)
        return claims.sparkSession.createDataFrame([], f"`{group}` {kind[group]}, position int, candidate_id {kind['candidate_id']}, category string, required_gain long, marginal double, cumulative double")
    return taken
