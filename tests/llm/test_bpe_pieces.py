"""Byte-level BPE over pieces of text, against the tokenizers library."""

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_text_operators import vocabulary
from tracewell.llm import bpe

ALPHABET = [*"aAbZhH z0959'''sStTlL!?.,;:$*<|>-_=()", *" \n\t\x0b\x1c\x85\xa0  　éÉßẞİΣσ̸́日本…€²Ⅷ१😀\x00", "'s", "'Re", "n't", "  ", " \n", "<|endoftext|>"]


@pytest.mark.parametrize("most", [bpe.PIECES, 50])
def test_pieces_equal_the_library(monkeypatch, most):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.Codec(bpe._spec(path))
    own.memory.most = most
    r = np.random.default_rng(8)
    texts = ["".join(ALPHABET[i] for i in r.integers(0, len(ALPHABET), r.integers(0, 40))) for _ in range(4000)] + [None, "", "word " * 3000, "x" * 5000]
    got = [None] * len(texts)
    for s in range(0, len(texts), 700):
        for first, last, ids, counts in own.encode(pa.array(texts[s : s + 700], pa.string())):
            got[s + first : s + last] = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
            data, ends = own.decode(ids, counts)
            assert [data[a:b].tobytes().decode() for a, b in zip(ends, ends[1:])] == [t or "" for t in texts[s + first : s + last]]
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [(t, g) for t, g, w in zip(texts, got, want, strict=True) if g != w] == []


def test_ids_that_are_no_text():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.Codec(bpe._spec(path))
    lists = np.random.default_rng(2).integers(0, 50_257, (50, 7))
    data, ends = own.decode(lists.ravel(), np.full(50, 7))
    assert [data[a:b].tobytes().decode() for a, b in zip(ends, ends[1:])] == [library.decode(x.tolist(), skip_special_tokens=False) for x in lists]


def test_null_and_repeated_keys(spark):
    path = vocabulary("byte_bpe_50k.json")
    rows = [(None, "one"), (1, "one"), (1, "two"), (None, None), (1, "one")]
    got = bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", path).collect()
    assert sorted(repr((r.doc_id, r.n_tokens)) for r in got) == sorted(repr((k, 1 if t else 0)) for k, t in rows)
    assert len({r.ids_sha256 for r in got}) == 3
