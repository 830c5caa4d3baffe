"""The token file: the coder's round trips and size, pieces against the tokenizers library, and files."""

import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_text_operators import LONG, PASSAGE, TEXTS, vocabulary
from tracewell.llm import idcoder, tokenfile

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("n", [0, 1, 5, 1024, 1025, 9000])
@pytest.mark.parametrize("top", [1, 40, 65536])
def test_range_coder_round_trip(n, top):
    ids = np.random.default_rng(n + top).integers(0, top, n)
    blocks = idcoder.encode(ids, size=4000)
    assert (idcoder.decode(blocks) == ids).all()
    if n == 9000 and top == 40:
        assert sum(len(b[2]) for b in blocks) < n
        one = idcoder.decode(blocks[1:2])
        assert (one == ids[4000:8000]).all()  # blocks stand alone
        for damaged in ([(k, crc ^ 1, code) for k, crc, code in blocks], [(k, crc, code[:-2]) for k, crc, code in blocks]):
            with pytest.raises(ValueError):
                idcoder.decode(damaged)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_coder_is_below_order_0_entropy_and_zlib(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("text").collect()]
    ids = np.concatenate([np.array(e.ids + [2], np.uint16) for e in library.encode_batch(texts, add_special_tokens=False)])
    blocks = idcoder.encode(ids)
    assert (idcoder.decode(blocks) == ids).all()
    share = np.bincount(ids) / len(ids)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum() * len(ids) / 8
    size = sum(len(b[2]) for b in blocks)
    assert size < 0.85 * entropy and size < len(zlib.compress(ids.astype("<u2").tobytes(), 6))


def test_order_2_is_used():
    """Ids that only the last two tell: far below what the order-1 entropy allows."""
    r = np.random.default_rng(4)
    rule = r.integers(0, 16, (16, 16))
    ids = [0, 1]
    for step in r.random(60_000):
        ids.append(int(rule[ids[-2], ids[-1]]) if step < 0.9 else int(step * 1e6) % 16)
    size = sum(len(b[2]) for b in idcoder.encode(np.array(ids)))
    pairs, count = np.unique(np.stack([ids[:-1], ids[1:]]), axis=1, return_counts=True)
    last = np.bincount(pairs[0], count)[pairs[0]]
    assert 8 * size < 0.75 * -(count * np.log2(count / last)).sum()


def test_contexts_with_very_many_followers():
    ids = np.zeros(60_000, np.int64)
    ids[1::2] = np.random.default_rng(1).permutation(65_535)[:30_000] + 1
    assert (idcoder.decode(idcoder.encode(ids)) == ids).all()


def test_pieces_equal_the_library():
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    with open(path, "rb") as f:
        own = tokenfile.Tokens(f.read())
    r = np.random.default_rng(8)
    alphabet = [*"aAbZhH z0959'''sStT!?.,;:$*<|>-_=()", *" \n\t\x0b\x1c\x85\xa0 　éÉßẞİΣσ̸̱́日本…€²Ⅷ१😀\x00", "'s", "'Re", "n't", "<|endoftext|>"]
    texts = ["".join(alphabet[i] for i in r.integers(0, len(alphabet), r.integers(0, 40))) for _ in range(4000)] + [None, "", "word " * 3000]
    got = [None] * len(texts)
    for first, last, ids, counts in own.encode(pa.array(texts, pa.string())):
        got[first:last] = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [(t, g) for t, g, w in zip(texts, got, want, strict=True) if g != w] == []


@pytest.mark.parametrize("row_ids", [tokenfile.ROW_IDS, 300])
def test_token_file_of_null_and_repeated_keys(spark, tmp_path, monkeypatch, row_ids):
    monkeypatch.setattr(tokenfile, "ROW_IDS", row_ids)  # with 300, LONG is longer than a row
    path = vocabulary("word_bpe_49k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    rows = [(None, "first of all"), (2, "one"), (2, LONG), (2, "one"), (5, None), (7, ""), (9, PASSAGE), (None, "")]
    df = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, part string")
    tokenfile.write(df, "doc_id", "text", path, 2, str(tmp_path / "f"))
    got = tokenfile.read(spark, str(tmp_path / "f"), ids=True).orderBy("start").collect()
    want = [(k, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for k, t in rows]
    assert sorted(repr((r.key, list(r.ids))) for r in got) == sorted(map(repr, want))
    assert [r.key for r in got] == sorted((k for k, _ in rows), key=lambda k: -1 if k is None else k)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()


def test_token_file(spark):
    path = vocabulary("word_bpe_49k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in tokenfile.round_trip(docs, "doc_id", "text", path, 2).collect()}
    start = 0
    for i, t in enumerate(TEXTS):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert tokenfile.round_trip(docs.limit(0), "doc_id", "text", path, 2).count() == 0
