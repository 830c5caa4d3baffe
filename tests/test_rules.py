"""Rules whose easy reading is wrong: licenses, fused nulls, promotion, downloads and their redirects."""

from pyspark.sql import functions as F

from tracewell.operators import discovery as D
from tracewell.operators import evidence as E
from tracewell.operators import planning as P
from tracewell.operators import selection as L


def test_license_needs_known_access(spark):
    cases = [(["MIT"], ["open"], "allowed"), (["MIT"], ["open", "open"], "allowed"), (["MIT"], ["open", "restricted"], "needs_review"), (["MIT"], [], "needs_review"), (["MIT"], ["unknown"], "needs_review"), (["All Rights Reserved"], ["open"], "needs_review"), (["MIT"], ["restricted"], "restricted"), (["MIT"], ["restricted", "unknown"], "restricted"), ([], ["open"], "needs_review"), (["MIT", "house"], ["open"], "needs_review"), (["MIT"], None, "needs_review"), (None, ["open"], "needs_review")]
    df = spark.createDataFrame(cases, "labels array<string>, access array<string>, want string")
    assert df.select(D.license_decision(F.col("labels"), F.col("access")).alias("got"), "want").where("got <> want or got is null").collect() == []


def test_null_values_and_null_eligibility(spark):
    rows = [("a", 1, None, True), ("a", 2, "5", True), ("b", 1, "5", None), ("c", 1, None, True), ("c", 2, None, True), ("d", 1, "5", True), ("d", 2, "5", None), ("e", 1, "", True), ("e", 2, None, True)]
    df = spark.createDataFrame(rows, "c string, candidate_id int, value string, eligible boolean").withColumns({"field_name": F.lit("f"), "evidence_id": F.col("candidate_id")})
    got = {r.c: (r.decision, r.value, r.distinct_values) for r in E.fuse(df, ["c"]).collect()}
    assert got == {"a": ("unresolved_conflict", None, 2), "b": ("withheld_review", None, 1), "c": ("exact_consensus", None, 1), "d": ("withheld_review", None, 1), "e": ("unresolved_conflict", None, 2)}


def test_conflicts_count_different_evidence(spark):
    df = spark.createDataFrame([("a", "x", "e1"), ("a", "y", "e1"), ("b", "x", "e1"), ("b", "y", "e2"), ("b", "y", "e2")], "k string, v string, e string")
    assert {(r.k, r.rows) for r in E.conflicts(df, "k", ["v"], "e").collect()} == {("b", 2)}
    assert {(r.k, r.rows) for r in E.conflicts(df, "k", ["v"]).collect()} == {("a", 2), ("b", 3)}


def test_accepted_sources_keep_their_order(spark):
    rows = [("g", f"https://x.org/{i}", "download", float(i), i) for i in range(7)] + [("h", "https://x.org/a", "download", 0.1, 0), ("h", "http://x.org/b", "download", 1.0, 1), ("h", "https://x.org/a", "inspect", 1.0, 2), ("h", "https://x.org/p", "inspect", 0.9, 3), ("h", "https://x.org/p.CSV?x=.html", "inspect", 0.1, 4), ("h", "https://x.org/q?f=a.csv", "inspect", None, 5), ("h", "ftp://x.org/f.csv", "inspect", 1.0, 6), ("h", "https://x.org/r", "reject", 1.0, 7)]
    df = spark.createDataFrame(rows, "g string, url string, action string, relevance double, `order` int")
    got = sorted((r.g, r.position, r.order) for r in P.promote(df, "g").collect())
    assert got == [("g", i + 1, i) for i in range(5)] + [("h", 1, 0), ("h", 2, 4), ("h", 3, 3)]


def test_only_whole_answers_of_200_are_taken(spark):
    rows = [(200, None, None, 5), (201, None, None, 5), (204, None, None, 0), (206, None, None, 5), (None, None, None, 0), (429, None, None, 5), (404, None, None, 5), (200, "gzip", None, 5), (200, "Identity", 5, 5), (200, None, 6, 5), (200, None, 101, 5), (200, None, None, 101), (200, None, 0, 0)]
    df = spark.createDataFrame(rows, "status int, encoding string, declared_bytes long, bytes long")
    got = [(r.error, r.retryable) for r in L.download_verdicts(df, 100).collect()]
    assert got == [(None, False), ("http_error", False), ("http_error", False), ("incomplete_response", False), ("timeout", True), ("http_error", True), ("http_error", False), ("content_encoding_unsupported", False), (None, False), ("incomplete_response", True), ("response_too_large", False), ("response_too_large", False), ("empty_response", False)]


def test_redirects(spark):
    ok, far = "https://a.org/x", "https://b.org/x"
    chains = {
        "direct": [(ok, None, 200)],
        "twice": [(ok, ok + "1", 302), (ok + "1", ok + "2", 307), (ok + "2", None, 200)],
        "limit": [(ok, ok, 301), (ok, ok, 301), (ok, ok, 301), (ok, None, 200)],
        "away": [(ok, far, 302), (far, None, 200)],
        "down": [(ok, "http://a.org/x", 302)],
        "nowhere": [(ok, "", 308)],
        "broken": [(ok, ok + "1", 302)],
        "error": [(ok, ok + "1", 303), (ok + "1", None, 503)],
        "start": [("https://u@a.org/x", None, 200)],
        "port": [("https://A.org.:443/x", None, 200)],
    }
    rows = [(k, i, u, to, s) for k, own in chains.items() for i, (u, to, s) in enumerate(own)]
    hops = spark.createDataFrame(rows, "r string, hop int, url string, location string, status int").withColumns({"encoding": F.lit(None).cast("string"), "declared_bytes": F.lit(None).cast("long"), "bytes": F.lit(9)})
    got = {r.r: (r.final_url, r.redirects, r.error, r.retryable) for r in L.download_chains(hops, "r", ["a.org"], 2, 100).collect()}
    assert got == {
        "direct": (ok, 0, None, False),
        "twice": (ok + "2", 2, None, False),
        "limit": (ok, 2, "redirect_limit", False),
        "away": (ok, 0, "host_not_allowed", False),
        "down": (ok, 0, "host_not_allowed", False),
        "nowhere": (ok, 0, "redirect_blocked", False),
        "broken": (ok + "1", 1, "timeout", True),
        "error": (ok + "1", 1, "http_error", True),
        "start": ("https://u@a.org/x", 0, "host_not_allowed", False),
        "port": ("https://A.org.:443/x", 0, None, False),
    }


def test_gold_records_name_what_is_withheld(spark):
    rows = [("a", "x", 1, "5", True), ("a", "y", 1, "1", True), ("a", "y", 2, "2", True), ("a", "z", 1, "7", False), ("a", "w", 1, None, None), ("b", "x", 1, None, True), ("c", "x", 1, "1", False)]
    df = spark.createDataFrame(rows, "c string, field_name string, candidate_id int, value string, eligible boolean").withColumn("evidence_id", F.concat("field_name", F.col("candidate_id").cast("string")))
    got = {r.c: (r["values"], r.evidence, r.withheld, r.in_conflict, r.selected) for r in E.gold_records(E.fuse(df, ["c"]), ["c"]).collect()}
    assert got == {"a": ({"x": "5"}, {"x": ["x1"]}, ["w", "y", "z"], ["y"], True), "b": ({"x": None}, {"x": ["x1"]}, [], [], True), "c": ({}, {}, ["x"], [], False)}
