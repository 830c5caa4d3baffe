"""Ten-part source selection against choosing step by step by hand."""

import numpy as np
import pytest

from tracewell.operators import greedy as G

CLAIMS = "task string, candidate_id string, field_name string, state string, source_types array<string>"
FACTS = "task string, candidate_id string, categories array<string>, primary boolean, labels array<string>, access array<string>, direct boolean, score double"


def brute(claims, facts, policy):
    out = []
    for task in {c[0] for c in claims}:
        info = {f[1]: f for f in facts if f[0] == task}
        own = {i: [c for c in claims if c[0] == task and c[1] == i] for i in info}
        required, optional, types, cats, used, primary, before = set(), set(), set(), [], [], False, 0.0
        while len(used) < policy.limit:
            ranked = []
            for i, (_, _, categories, is_primary, labels, access, direct, score) in info.items():
                eligible = [c for c in categories if c in policy.categories]
                if i in used or not own[i] or not eligible:
                    continue
                assigned = next((c for c in eligible if c not in cats), eligible[0])
                covered = {c[2] for c in own[i] if c[3] == "covered"}
                unsure = {c[2] for c in own[i] if c[3] == "uncertain"}
                kinds = {t for c in own[i] if c[3] == "covered" for t in c[4] or []}
                gains = (
                    len(covered & set(policy.required) - required),
                    len(unsure & set(policy.required) - required),
                    int(policy.want_primary and not primary and bool(is_primary)),
                    len(kinds & set(policy.types) - types),
                    int(len(cats) < policy.category_target and assigned not in cats),
                    len(covered & set(policy.optional) - optional),
                )
                if any(gains):
                    allowed = access == ["open"] and labels == ["MIT"]
                    ranked.append((tuple(-g for g in gains), -int(allowed), -int(bool(direct)), -(score or 0.0), i, assigned, covered, kinds, bool(is_primary)))
            if not ranked:
                break
            gains, *_, i, assigned, covered, kinds, is_primary = min(ranked, key=lambda r: r[:5])
            required |= covered & set(policy.required)
            optional |= covered & set(policy.optional)
            types |= kinds
            cats += [assigned] if assigned not in cats else []
            primary |= is_primary
            used.append(i)
            now = len(required) / len(policy.required) if policy.required else 1.0
            out.append((task, len(used), i, assigned, -gains[0], round(max(0.0, now - before), 9), round(now, 9)))
            before = now
    return sorted(out)


def run(spark, claims, facts, policy):
    rows = G.select_sources(spark.createDataFrame(claims, CLAIMS).repartition(3), spark.createDataFrame(facts, FACTS), "task", policy).collect()
    return sorted((r.task, r.position, r.candidate_id, r.category, r.required_gain, round(r.marginal, 9), round(r.cumulative, 9)) for r in rows)


@pytest.mark.parametrize("fields", [5, 130])
def test_equals_choosing_by_hand(spark, fields):
    r = np.random.default_rng(fields)
    names = [f"f{i}" for i in range(fields)]
    claims, facts = [], []
    for task in "ab":
        for i in range(60):
            facts.append((task, f"c{i:02d}", [f"k{x}" for x in r.permutation(4)[: r.integers(0, 4)]], bool(r.random() < 0.2), [["MIT"], []][r.integers(0, 2)], [["open"], ["open", "restricted"], []][r.integers(0, 3)], [True, False, None][r.integers(0, 3)], [0.5, 0.25, None][r.integers(0, 3)]))
            for f in r.choice(names, min(fields, r.integers(0, 4))):
                claims.append((task, f"c{i:02d}", str(f), ["covered", "uncertain"][r.integers(0, 2)], [["t0"], ["t1", "t9"], None, []][r.integers(0, 4)]))
    policy = G.Policy(tuple(names[: fields - 2]), tuple(names[fields - 2 :]), ("t0", "t1"), ("k0", "k1", "k2"), 2, True, 8, 1000, 140)
    assert policy.limit == 7
    got = run(spark, claims, facts, policy)
    assert got == brute(claims, facts, policy) and len(got) >= 6


def test_alike_candidates_and_nothing_to_gain(spark):
    claims = [("t", f"c{i}", "f", "uncertain", None) for i in range(9)] + [("u", "x", "other", "covered", None)]
    facts = [("t", f"c{i}", ["k"], False, ["MIT"], ["open"], True, float(i % 3)) for i in range(9)] + [("u", "x", ["k"], False, [], [], False, 1.0), ("u", "y", ["k"], True, [], [], False, 1.0)]
    policy = G.Policy(("f",), categories=("k",), least_categories=0, most=3)
    assert run(spark, claims, facts, policy) == brute(claims, facts, policy) == [("t", 1, "c2", "k", 0, 0.0, 0.0), ("t", 2, "c5", "k", 0, 0.0, 0.0), ("t", 3, "c8", "k", 0, 0.0, 0.0)]
    assert run(spark, [], [], policy) == [] and run(spark, claims, facts, G.Policy(("f",), categories=("k",), available_bytes=5, reserved_bytes=9)) == []
