"""Byte-level BPE encoding by segment trees over adjacent pair ranks, and decoding.

A word's symbols are the leaves of a segment tree. Each leaf holds the rank of the merge of its symbol and the next,
with its position as tie-break, so the root is the leftmost pair of lowest rank. A merge changes three leaves, each
carried to the root in logarithmic time, and a word is done when no pair at its root can merge. The trees of all
words of a length class stand side by side in one numpy array and take their merges in step.

Texts are cut into pieces where the pre-tokenizer's pattern has a boundary whatever stands around, and only pieces that a
worker has not met are split into words and encoded; what it keeps of them is bounded.

Nulls and edge cases: a null text encodes as an empty one, to no ids. Text is never cut, however long. The strings of
added tokens found in a text become their ids, as the tokenizers library has it. Other columns are kept by ``encode``
and ``decode`` and not looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracewell.llm.arrowkit import buffers
from tracewell.llm.pieces import APOSTROPHE, DIGIT, HIGH, LETTER, OTHER, SPACE, Memory, between, encode_column, gather, gathered, places

#: Encoded pieces that a worker keeps, about 12 MB; beyond them it starts anew.
PIECES = 150_000
#: Bytes of text handled at a time.
BATCH_BYTES = 1 << 20

#: The public byte-level pattern, and Unicode's white space beyond ASCII.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WIDE_SPACE = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Pieces end before ASCII white space, which goes with what follows it (texts with other white space are not cut), and
#: between ASCII letters, digits and other ASCII; "'" begins endings such as 's, so nothing is cut after it.
CUTS = between(
    *((a, SPACE) for a in (LETTER, DIGIT, APOSTROPHE, OTHER, HIGH)),
    *((LETTER, b) for b in (DIGIT, APOSTROPHE, OTHER)),
    *((DIGIT, b) for b in (LETTER, APOSTROPHE, OTHER)),
    *((OTHER, b) for b in (LETTER, DIGIT)),
)
#: What the pattern takes for one word, whatever version of Unicode's tables it has.
ONE_WORD = r"^ ?(?:[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+|[0-9]+|[!-/:-@\[-`{-~]+)$"

NO_PAIR = np.iinfo(np.int64).max


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: bytes that print stand for
    themselves, the others follow from code point 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PairRanks:
    """Ranks and results of merges by pair of ids, for arrays of pairs."""

    def __init__(self, pairs: np.ndarray, results: np.ndarray):
        key = (pairs[:, 0].astype(np.int64) << 32) | pairs[:, 1]
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.results = key[order], order, results

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pair's rank, or -1. A negative id is no symbol."""
        key = (left.astype(np.int64) << 32) | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], -1)


def merge_words(symbols: np.ndarray, ranks: PairRanks) -> np.ndarray:
    """symbols: [words, width] ids, -1 past a word's end, width a power of two. The same with all merges done and -1
    where a symbol went into one on its left."""
    words, width = symbols.shape
    symbols = symbols.copy()
    if width < 2 or not words:
        return symbols
    levels = width.bit_length() - 1
    tree = np.full((words, 2 * width), NO_PAIR, np.int64)

    def key(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(rank >= 0, rank * width + at, NO_PAIR)

    first = ranks(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(words, width - 1)
    tree[:, width : 2 * width - 1] = key(first, np.arange(width - 1))
    for level in range(levels - 1, -1, -1):
        a, b = 1 << level, 2 << level
        tree[:, a:b] = np.minimum(tree[:, b : 2 * b : 2], tree[:, b + 1 : 2 * b : 2])
    # neighbours among the symbols that are left; slot ``width`` takes what falls off either end
    after = np.tile(np.arange(1, width + 2, dtype=np.int32), (words, 1))
    before = np.tile(np.arange(-1, width, dtype=np.int32), (words, 1))
    padded = np.full((words, width + 1), -1, np.int64)
    padded[:, :width] = symbols

    def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        node = leaf + width
        tree[rows, node] = value
        for _ in range(levels):
            node >>= 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    rows = np.flatnonzero(tree[:, 1] != NO_PAIR)
    while len(rows):
        root = tree[rows, 1]
        rank, at = root // width, root % width
        gone = after[rows, at]
        then = np.minimum(after[rows, gone], width)
        made = ranks.results[rank]
        padded[rows, at] = made
        padded[rows, gone] = -1
        after[rows, at] = then
        before[rows, then] = at
        put(rows, gone.astype(np.int64), np.full(len(rows), NO_PAIR))
        put(rows, at.copy(), key(ranks(made, padded[rows, then]), at))
        prior = before[rows, at].astype(np.int64)
        some = prior >= 0
        left_rows, left = rows[some], prior[some]
        put(left_rows, left.copy(), key(ranks(padded[left_rows, left], made[some]), left))
        rows = rows[tree[rows, 1] != NO_PAIR]
    return padded[:, :width]


class Codec:
    """One byte-level BPE vocabulary, read from the tokenizers library's JSON."""

    def __init__(self, spec: bytes):
        spec = json.loads(spec)
        model = spec["model"]
        pre, odd = spec["pre_tokenizer"] or {}, [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only plain byte-level BPE vocabularies are handled")
        vocab, symbol = model["vocab"], byte_symbols()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = np.array([(vocab[a], vocab[b]) for a, b in merges], np.int64).reshape(-1, 2)
        self.ranks = PairRanks(pairs, np.array([vocab[a + b] for a, b in merges], np.int64))
        self.byte_id = np.zeros(256, np.int64)
        for s, b in symbol.items():
            self.byte_id[b] = vocab[s]
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not handled")
        bytes_of = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for s, i in vocab.items():
            bytes_of[i] = bytes(symbol[c] for c in s) if all(c in symbol for c in s) else s.encode()
        for s, i in added.items():
            bytes_of[i] = s.encode()
        self.size_of = np.array([len(b) for b in bytes_of], np.int64)
        self.place_of = np.cumsum(self.size_of) - self.size_of
        self.bytes = np.frombuffer(b"".join(bytes_of), np.uint8)
        self.added = added
        self.added_pattern = re.compile("(" + "|".join(re.escape(s) for s in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.word_pattern = regex.compile(PATTERN)
        self.memory = Memory(self._learn, PIECES, pa.uint32())

    def _merge(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words, one after the other, and how many each has; a length class is merged at a time."""
        data, offsets = buffers(words)
        length = np.diff(offsets)
        counts = np.zeros(len(length), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        classes = np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64)
        for level in np.unique(classes):
            width = 1 << int(level)
            members = np.flatnonzero(classes == level)
            step = max(1, (1 << 17) // width)
            for s in range(0, len(members), step):
                part = members[s : s + step]
                inside = np.arange(width) < length[part][:, None]
                codes = np.full((len(part), width), -1, np.int64)
                codes[inside] = self.byte_id[gather(data, offsets[part], length[part])]
                done = merge_words(codes, self.ranks)
                kept = done >= 0
                counts[part] = kept.sum(axis=1)
                parts.append((part, done[kept]))
        out = np.empty(int(counts.sum()), np.uint32)
        starts = np.cumsum(counts) - counts
        for part, ids in parts:
            out[places(starts[part], counts[part])] = ids
        return out, counts

    def _learn(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        single = pc.match_substring_regex(pieces, ONE_WORD).to_numpy(zero_copy_only=False)
        split = [self.word_pattern.findall(p) for p in pieces.filter(pa.array(~single)).to_pylist()]
        more = pa.array([w for own in split for w in own], pa.large_string())
        words = pa.concat_arrays([pieces.filter(pa.array(single)), more]).dictionary_encode()
        ids, counts = self._merge(words.dictionary)
        which = words.indices.to_numpy()
        # words in the order of the pieces that they stand in
        number = np.concatenate([np.flatnonzero(single), np.repeat(np.flatnonzero(~single), [len(own) for own in split])])
        order = np.argsort(number, kind="stable")
        each = counts[which[order]]
        total = np.bincount(number[order], each, minlength=len(pieces)).astype(np.int64)
        return gather(ids, (np.cumsum(counts) - counts)[which[order]], each), total

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts by the pattern alone, with the strings of added tokens as their ids."""
        out = []
        for text in texts:
            parts = [np.zeros(0, np.uint32)]
            for part in self.added_pattern.split(text) if self.added_pattern else [text]:
                if part in self.added:
                    parts.append(np.array([self.added[part]], np.uint32))
                elif part:
                    words = pa.array(self.word_pattern.findall(part), pa.large_string()).dictionary_encode()
                    ids, counts = self._merge(words.dictionary)
                    which = words.indices.to_numpy()
                    parts.append(gather(ids, (np.cumsum(counts) - counts)[which], counts[which]))
            out.append(np.concatenate(parts))
        return out

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first, last, ids, counts) of runs of a string column's rows."""
        apart = pc.match_substring_regex(column, WIDE_SPACE)
        for token in self.added:
            apart = pc.or_(apart, pc.match_substring(column, token))
        return encode_column(column, self.memory, CUTS, pc.fill_null(apart, False).to_numpy(zero_copy_only=False), self._whole, BATCH_BYTES)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of texts, one after the other, and their offsets; bytes that are no UTF-8 become U+FFFD."""
        size = self.size_of[ids]
        data = gather(self.bytes, self.place_of[ids], size)
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        try:
            pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(ends), pa.py_buffer(data)).validate(full=True)
        except pa.ArrowInvalid:
            return buffers(pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends, ends[1:])], pa.large_string()))
        return data, ends


_codecs: dict[bytes, Codec] = {}


def codec(spec: bytes) -> Codec:
    """The worker's codec of a vocabulary, made once."""
    name = hashlib.sha256(spec).digest()
    if name not in _codecs:
        _codecs[name] = Codec(spec)
    return _codecs[name]


def _spec(path: str) -> bytes:
    with open(path, "rb") as f:  # a vocabulary file beside the driver, bounded by its nature; tasks get its bytes
        return f.read()


def encode(df: DataFrame, text: str, path: str, to: str = "token_ids", check: bool = False) -> DataFrame:
    """``df`` with the ids of its text column as array<int>; ``check`` decodes them and fails unless the text comes back."""
    spec, schema = _spec(path), T.StructType([*[f for f in df.schema if f.name != to], T.StructField(to, T.ArrayType(T.IntegerType()))])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(spec)
        for batch in gathered(batches, at, BATCH_BYTES):
            names = [n for n in batch.schema.names if n != to]
            for first, last, ids, counts in own.encode(batch.column(at)):
                rows = batch.slice(first, last - first)
                if check:
                    (data, ends), (back, back_ends) = buffers(rows.column(at)), own.decode(ids, counts)
                    if not (np.array_equal(ends, back_ends) and np.array_equal(data, back)):
                        raise ValueError("a text does not come back from its ids")
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), ids.astype(np.int32))
                yield pa.RecordBatch.from_arrays([*[rows.column(n) for n in names], lists], names=[*names, to])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str, path: str, to: str) -> DataFrame:
    """``df`` with the text of its array of ids; a null array decodes to an empty text."""
    spec, schema = _spec(path), T.StructType([*[f for f in df.schema if f.name != to], T.StructField(to, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(spec)
        for batch in batches:
            lists = batch.column(ids)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, ends = own.decode(lists.flatten().to_numpy(zero_copy_only=False), counts)
            texts = pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(ends), pa.py_buffer(data)).cast(pa.string())
            names = [n for n in batch.schema.names if n != to]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], texts], names=[*names, to])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """Per row: n_tokens, and the SHA-256 of its ids and of the text decoded from these ids."""
    spec = _spec(path)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(spec)
        hashes = lambda data, ends: [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        for batch in gathered(batches, 1, BATCH_BYTES):
            for first, last, ids, counts in own.encode(batch.column(1)):
                ends = np.concatenate([[0], np.cumsum(counts)])
                shas = hashes(ids.astype("<u4"), ends), hashes(*own.decode(ids, counts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(counts, pa.int64()), *(pa.array(h, pa.string()) for h in shas)], names=schema.names)

    return df.select(df[key], df[text].cast("string")).mapInArrow(run, schema)
