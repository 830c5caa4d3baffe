"""Causal logs against following each chain by hand: deep chains, orphans, cycles, repeats."""

import numpy as np

from tracewell.operators import causality as C


def brute(rows):
    up = {}
    for e, c in rows:
        if e is not None:
            up[e] = min((x for x in (up.get(e), c) if x is not None), default=None)
    out = set()
    for e in up:
        seen, at = [e], up[e]
        while at is not None and at in up and at not in seen:
            seen.append(at)
            at = up[at]
        if at in seen:
            out.add((e, None, None, "cycle"))
        else:
            out.add((e, seen[-1], len(seen) - 1, "rooted" if at is None else "orphan"))
    return out


def run(spark, rows):
    return {tuple(r) for r in C.causes(spark.createDataFrame(rows, "e long, c long").repartition(3), "e", "c").collect()}


def test_chains_of_every_kind(spark):
    r = np.random.default_rng(2)
    rows = [(i, i - 1 if i % 700 else None) for i in range(2000)]  # chains of 700
    rows += [(3000 + i, int(r.integers(3000, 3000 + max(1, i)))) if i else (3000, None) for i in range(500)]  # a tree
    rows += [(5000, 5001), (5001, 5002), (5002, 5000), (5003, 5001), (5004, 5004), (6000, -1), (6001, 6000), (None, 3), (6001, 6000), (6002, None), (6002, 6001)]
    rows += [(7000 + i, 3000) for i in range(400)]  # one cause of very many
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == set() and run(spark, [(1, 1)]) == {(1, None, None, "cycle")} and run(spark, [(1, 2)]) == {(1, 1, 0, "orphan")}


def test_problems(spark):
    rows = [("a", "task.created", "2024-01-01T00:00:00Z", None), ("b", "nonsense", "2024-01-01T00:00:00", "a"), ("b", "task.accepted", "2024-01-01T00:00:00+01:00", "gone"), ("c", None, None, "c"), (None, "task.created", "2024-01-01T00:00:00Z", None)]
    got = C.log_problems(spark.createDataFrame(rows, "e string, k string, t string, c string"), "e", "k", "t", "c").collect()
    want = [("b", "kind_unknown"), ("b", "time_without_zone"), ("b", "event_repeated"), ("b", "cause_missing"), ("c", "kind_unknown"), ("c", "time_without_zone"), ("c", "caused_by_itself"), ("c", "causal_cycle"), (None, "event_missing")]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_events_that_nobody_names_take_no_part_in_rounds(spark, monkeypatch):
    rows = [(0, None)] + [(i, i - 1) for i in range(1, 6)] + [(100 + i, i % 5) for i in range(300)]
    held = []
    monkeypatch.setattr(C, "written", lambda df, name: held.append((name, df.localCheckpoint())) or held[-1][1])
    monkeypatch.setattr(C, "dropped", lambda df: None)
    assert run(spark, rows) == brute(rows)
    assert [df.count() <= 6 for name, df in held if name == "causes"].count(False) <= 1
