"""SentencePiece BPE by merge rounds, against the sentencepiece library."""

import hashlib
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_text_operators import TEXTS, vocabulary
from tracewell.llm import piecebpe

SF = "/root/testdata/sf0.01"
ALPHABET = [*"aAbZhH z0959'''sStTlL!?.,;:$*<|>-_=()", *" \n\t\x0b\x85\xa0　éÉßẞİΣσ̸́日本語中国…€²Ⅷ१😀\x00", "  ", "    ", "▁", "▁ ", " ▁", "the", " and", "<s>", "</s>", "<0x41>", "<unk>", "aaaa", "ss"]


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def own():
    return piecebpe.Codec(piecebpe._spec(vocabulary("piece_bpe_32k.model")))


def ids_of(own, texts):
    got = [None] * len(texts)
    for first, last, ids, counts in own.encode(pa.array(texts, pa.string())):
        got[first:last] = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    return got


@pytest.mark.parametrize("most", [piecebpe.WORDS, 50])
def test_rounds_equal_the_library(monkeypatch, own, library, most):
    monkeypatch.setattr(own.memory, "most", most)
    r = np.random.default_rng(12)
    texts = ["".join(ALPHABET[i] for i in r.integers(0, len(ALPHABET), r.integers(0, 40))) for _ in range(4000)]
    texts += ["".join("abeinst "[i] for i in r.integers(0, 8, 60)) for _ in range(2000)]
    texts += [None, "", " ", "word " * 3000, "x" * 5000, " " * 3000, *(" " * n + "the" for n in range(60)), "日本" * 900, "abab" * 500]
    for s in range(0, len(texts), 900):
        part = texts[s : s + 900]
        got = ids_of(own, part)
        want = [library.encode(t or "") for t in part]
        assert [(t, g, w) for t, g, w in zip(part, got, want, strict=True) if g != w] == []
        counts = np.array([len(g) for g in got], np.int64)
        data, ends = own.decode(np.concatenate([np.array(g, np.int64) for g in got]), counts)
        assert [data[a:b].tobytes().decode() for a, b in zip(ends, ends[1:])] == [library.decode(w) for w in want]


def test_words_that_the_agenda_finishes_equal_the_rounds(own):
    r = np.random.default_rng(4)
    for _ in range(300):
        text = "".join("abeinst▁"[i] for i in r.integers(0, 8, 20))
        at = np.searchsorted(own.code_points, [ord(c) for c in text])
        symbols = own.code_symbols[at]
        assert own.merge(symbols, np.zeros(len(symbols), np.int64))[0].tolist() == own._agenda(symbols.tolist())


def test_ids_that_no_text_gives(own, library):
    lists = np.random.default_rng(2).integers(0, 32_000, (60, 7))
    lists[::3] %= 300
    data, ends = own.decode(lists.ravel(), np.full(len(lists), 7))
    assert [data[a:b].tobytes().decode() for a, b in zip(ends, ends[1:])] == [library.decode(x) for x in lists.tolist()]


def want_rows(library, rows):
    out = []
    for key, text in rows:
        ids = library.encode(text or "")
        out.append((key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    return sorted(map(repr, out))


def test_round_trip_of_nulls_repeats_and_clashing_names(spark, library):
    path = vocabulary("piece_bpe_32k.model")
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "one"), (1, "two"), (1, "two"), (None, None)]
    df = spark.createDataFrame([(k, t, "x", -1) for k, t in rows], "doc_id long, text string, token_ids string, n_tokens int").repartition(3)
    got = piecebpe.round_trip(df, "doc_id", "text", path)
    assert sorted(repr(tuple(r)) for r in got.collect()) == want_rows(library, rows)
    assert piecebpe.round_trip(df.limit(0), "doc_id", "text", path).collect() == []
    back = piecebpe.decode(piecebpe.encode(df, "text", path), "token_ids", path, "back")
    assert back.columns == ["doc_id", "text", "n_tokens", "token_ids", "back"]
    assert back.where(F.coalesce("text", F.lit("")) != F.col("back")).count() == 0
    assert [tuple(r) for r in piecebpe.decode(spark.createDataFrame([(None,)], "i array<int>"), "i", path, "t").collect()] == [(None, "")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_query_on_whole_documents(spark, library):
    from tracewell.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(repr(tuple(r)) for r in QUERIES["op12_piece_merge_rounds"](spark, SF).collect()) == want_rows(library, rows)
