"""Discovery merging against a record-by-record version, whatever the input's order."""

import random

from pyspark.sql import functions as F

from tracewell.operators import merging as M

SCHEMA = "record_id long, title string, doi string, url string, year int"


def brute(rows):
    """Unions one after the other, in order; a union that would bring two unlike sets of DOIs together is refused."""
    rows = [(i, t.lower() if t else None, d, u, y) for i, t, d, u, y in rows]
    key = lambda r: ("doi:" + r[2] if r[2] else "url:" + r[3] if r[3] else "title:" if r[1] else "~", r[0])
    rows.sort(key=key)
    part, dois, seen = {r[0]: r[0] for r in rows}, {r[0]: {r[2]} - {None} for r in rows}, {}
    place = {r[0]: n for n, r in enumerate(rows)}

    def merge(a, b):
        a, b = sorted((part[a], part[b]), key=place.__getitem__)
        if a == b or (dois[a] and dois[b] and not dois[a] & dois[b]):
            return
        dois[a] |= dois[b]
        for x in part:
            if part[x] == b:
                part[x] = a

    for i, _, d, u, _ in rows:
        for alias in (d and "d" + d, u and "u" + u):
            if alias:
                merge(i, seen.setdefault(alias, i))
    titles = {}
    for i, t, _, _, y in rows:
        if t:
            titles.setdefault((t, y), []).append(i)
    strong = {r[0] for r in rows if r[2] or r[3]}
    for own in titles.values():
        roots = {part[i] for i in own if i in strong}
        if len(roots) <= 1:
            first = min(roots or {part[i] for i in own}, key=place.__getitem__)
            for i in own:
                merge(first, i)
    return {frozenset(x for x in part if part[x] == p) for p in part.values()}


def groups(df):
    found = {}
    for r in M.merge_records(df).collect():
        found.setdefault(r.candidate, set()).add(r.record_id)
    assert all(c in own for c, own in found.items())
    return {frozenset(g) for g in found.values()}


def test_records_that_share_nothing_stay_apart(spark):
    rows = [(1, None, None, None, 2020), (2, None, None, None, 2020), (3, None, None, "https://a.org/x", None), (4, None, None, None, None), (5, "", None, None, 2020), (6, " !", None, None, 2020)]
    assert groups(spark.createDataFrame(rows, SCHEMA)) == {frozenset([i]) for i in range(1, 7)}


def test_aliases_and_veto(spark):
    rows = [
        (1, "A b", "10.1234/x", "https://a.org/1", 2020), (2, "other", "doi:10.1234/X", None, 2020), (3, "zz", None, "https://a.org/1?utm_source=q", 2021), (4, "Same title", "10.1234/p", None, 2020),
        (5, "same TITLE", "10.1234/q", None, 2020), (6, "same title", None, None, 2020), (7, "Lone", None, None, None), (8, "lone!", None, None, None), (9, "a B.", None, None, 2020), (10, "a b", None, None, 2021),
    ]
    want = {frozenset(x) for x in ([1, 2, 3, 9], [4], [5], [6], [7, 8], [10])}
    df = spark.createDataFrame(rows, SCHEMA)
    assert groups(df) == groups(df.orderBy(F.desc("record_id"))) == want
    assert M.merge_records(df.limit(0)).count() == 0


def test_random_records_equal_brute_force(spark):
    rng = random.Random(6)
    for n in range(3):
        some = lambda kind, k: None if rng.random() < 0.5 else kind.format(rng.randrange(k))
        rows = [(i, some("t{}", 12), some("10.1234/d{}", 14), some("https://h.org/{}", 14), rng.choice([2020, None])) for i in rng.sample(range(1000), 60)]
        assert groups(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_candidates(spark):
    rows = [("c", False, 1, "Best  of rank", "s", "x", "10.1/a", None, None, "MIT", ["pdf"], "open", ["f"], "e1"), ("c", True, 5, "Primary wins", "s", "y", None, "https://a/", None, "mit", ["CSV", "csv"], None, ["f", "g"], "e2")]
    schema = "candidate string, primary_source boolean, rank int, title string, source_id string, external_id string, doi string, url string, published date, license string, formats array<string>, access string, target_fields array<string>, evidence_id string"
    df = spark.createDataFrame(rows, schema)
    got = M.build_candidates(df).first()
    assert (got.title, got.records, got.licenses, got.formats, got.access) == ("Primary wins", 2, ["MIT", "mit"], ["CSV", "csv", "pdf"], ["open"])
    assert {(r.field_name, r.evidence) for r in M.coverage_claims(df).collect()} == {("f", 2), ("g", 1)}
