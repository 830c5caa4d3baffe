"""Operators on the driver's tables: fingerprints by their definition, held-out accuracy, planted secrets."""

import os
import re

import pytest
from pyspark.sql import functions as F

from tracewell.llm import langid, secrets, syncmers

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def anchors_of(fingerprint):
    return {fingerprint[i : i + 8] for i in range(0, len(fingerprint), 8)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@tables
def test_likeness_is_that_of_the_fingerprints(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in syncmers.fingerprints(docs, "doc_id", "text").collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)
    edited = []
    for i, after in zip(order, [*order[1:], order[0]], strict=True):
        half = len(texts[i]) // 2
        edited.append((i, texts[i][: len(texts[i]) - half] + texts[after][:half]))
        assert got[i].near_next == pytest.approx(jaccard(anchors_of(got[i].fingerprint), anchors_of(got[after].fingerprint)))
        assert got[i].near_edited == pytest.approx(jaccard(anchors_of(got[i].fingerprint), anchors_of(got[i].edited_fingerprint)))
    own = syncmers.with_anchors(spark.createDataFrame(edited, "doc_id long, text string"), "text", "a").select("doc_id", syncmers.fingerprint(F.col("a")).alias("f"))
    assert all(r.f == got[r.doc_id].edited_fingerprint for r in own.collect())


def test_far_null_and_repeated_keys_have_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "GROUP", 1)
    keys = [*range(100, 400), 1 << 62, -(1 << 62), (1 << 63) - 1, 7, 7, None]
    rows = [(k, f"text number {n} of some words to be told from any other by its number {n * 7919}") for n, k in enumerate(keys)]
    got = syncmers.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "doc_id", "text").collect()
    follows = {r.text: r.next_text for r in got}
    assert len(got) == len(rows) and sorted(follows.values()) == sorted(follows)  # one ring
    key = {t: k for k, t in rows}
    down = [key[t] for t in follows if key[t] is not None and key[follows[t]] is not None and key[t] < key[follows[t]]]
    assert down == [] and key[next(follows[t] for t in follows if key[t] is None)] == (1 << 63) - 1


@tables
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs, "doc_id", "text", "lang").join(docs.select("doc_id", "lang"), "doc_id")
    judged = got.where("held_out and lang is not null and lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert judged[1] > 100 and judged[0] >= 0.99


@tables
def test_planted_secrets_are_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    planted = {(r.doc_id, m.start(1)) for r in docs.collect() for m in re.finditer(r'token = "([0-9a-f]{40})"', r.text or "")}
    found = {(r.doc_id, r.start) for r in secrets.scan(docs, "doc_id", "text").collect()}
    assert planted and len(planted & found) >= 0.99 * len(planted)
    texts = {r.doc_id: r.text for r in docs.collect()}
    # whatever else is found stands right after a secret's name too
    others = [texts[i][max(0, at - 40) : at] for i, at in found - planted]
    named = re.compile(rf"(?i)(?:{secrets.FOR})[\w-]{{0,16}}[\"'`]?\s?[=: ]\s?[\"'`]?$")
    assert sum(not named.search(o) for o in others) <= 0.02 * len(found)


def test_languages_of_rows_that_share_a_key(spark):
    words = {"en": "the and of with", "de": "der und ich ein"}
    rows = [(1, f"{words[c]} {i}", c) for i in range(60) for c in words] + [(None, "der und ein", "de"), (1, None, "en")]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang").collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} <= {"en", "de", "und"}
