"""Arrow string columns as byte buffers, and words, hashes and runs over them in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that the vectorised code takes at a time: small enough for a core's cache, whole documents always.
CHUNK_BYTES = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def byte_class(excluded: list[tuple[int, int]]) -> np.ndarray:
    """True for the bytes in none of the inclusive ranges. Bytes of multi-byte characters are at 0x80 and above."""
    table = np.ones(256, dtype=bool)
    for first, last in excluded:
        table[first : last + 1] = False
    return table


#: The complements that the word patterns name.
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
NONSPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    base = 0x9E3779B97F4A7C15 | 1
    up = np.ones(1, U64)
    down = np.ones(1, U64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, 2 * CHUNK_BYTES)
            for name, step in (("up", cls.base), ("down", pow(cls.base, -1, 1 << 64))):
                full = np.full(n, step, U64)
                full[0] = 1
                setattr(cls, name, np.cumprod(full))
        return cls.up, cls.down


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of values[start:end] for each range (none empty), equal for equal contents."""
    up, down = _Powers.get(len(values) + 1)
    total = np.empty(len(values) + 1, U64)
    total[0] = 0
    np.cumsum(values.astype(U64) * up[: len(values)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts])


@dataclass
class Words:
    """Words of a chunk of documents: byte ranges in ``data``, the document each is in, and a hash of each."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray
    #: first[d]:first[d + 1] are the words of document d.
    first: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def split_words(data: np.ndarray, offsets: np.ndarray, word: np.ndarray, lower: bool) -> Words:
    """Maximal runs of ``word`` bytes in each document. data: bytes; offsets[d]:offsets[d + 1] are document d."""
    n, docs = len(data), len(offsets) - 1
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, none, np.zeros(0, U64), np.zeros(docs + 1, np.int64))
    if lower:
        data = LOWER[data]
    inside = word[data]
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    at = offsets[1:-1]
    at = at[(at > 0) & (at < n)]
    begins[at] = inside[at]  # a document's first byte starts a word whatever stands before it
    closes[at - 1] = inside[at - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    hashes = range_hashes(data.astype(np.uint16) + np.uint16(1), starts, ends) if len(starts) else np.zeros(0, U64)
    first = np.searchsorted(doc, np.arange(docs + 1))
    return Words(data, starts, ends, doc, hashes, first)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK_BYTES, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of at most ``most`` whole documents with about ``size`` bytes; a longer one
    comes alone."""
    first, docs = 0, len(offsets) - 1
    while first < docs:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        last = min(last, docs, first + most)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
