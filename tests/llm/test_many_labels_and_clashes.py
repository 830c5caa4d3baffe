"""Language labels without a bound on their number, and columns that share names with the operators' own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import langid, secrets

SECRET = "9f8a1c7d3e5b2a4f6c8d0e1f2a3b4c5d6e7f8091"


def test_three_hundred_labels(spark, monkeypatch):
    monkeypatch.setattr(langid, "EXCERPTS", (40,))
    r = np.random.default_rng(9)
    words = {f"x{c:03d}": ["".join(chr(97 + i) for i in r.integers(0, 26, 6)) for _ in range(3)] for c in range(300)}
    rows = [(c * 10 + i, " ".join(words[label][j] for j in r.integers(0, 3, 12)), label) for c, label in enumerate(words) for i in range(6)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), "doc_id", "text", "lang").collect()
    want = {k: label for k, _, label in rows}
    assert len(got) == len(rows) and all(0 <= g.score <= 1 for g in got)
    assert np.mean([g.lang_pred == want[g.doc_id] for g in got if g.held_out]) > 0.95


def test_more_labels_than_rows_that_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "ROWS", 40)
    rows = [(i, f"word{i} and some more", f"l{i % 120}") for i in range(240)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang").collect()
    assert len(got) == 240 and {g.lang_pred for g in got} <= {f"l{i}" for i in range(120)}


@pytest.mark.parametrize("names", [("_key", "_spans", "_scanned"), ("_KEY0", "_text", "candidate"), ("start", "score", "_key")])
def test_redact_keeps_clashing_columns(spark, names):
    rows = [(i, t, "a", "b", "c") for i, t in enumerate([f'token = "{SECRET}" end', None, "", "clean text", f"API_KEY={SECRET}"])]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names]).repartition(2)
    out = secrets.redact(df, "doc_id", "text")
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == df.columns and len(got) == len(rows)
    assert all(SECRET not in (r.text or "") and tuple(r)[2:] == ("a", "b", "c") for r in got.values())
    assert (got[1].text, got[2].text, got[3].text) == (None, "", "clean text") and out.where(F.col("text").contains(secrets.MASK)).count() == 2
