"""Texts cut into pieces that a tokenizer encodes one by one, and a bounded memory of pieces already encoded.

Cutting, finding the distinct pieces of a batch, looking them up and joining their ids run over Arrow and numpy buffers;
only pieces never met before become Python strings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tracewell.llm.arrowkit import buffers, chunks

#: Bytes of text cut at a time; a longer document comes alone.
CHUNK_BYTES = 16 << 20

#: Classes of bytes: ASCII white space, letters, digits, apostrophe, other ASCII, and bytes of other characters.
SPACE, LETTER, DIGIT, APOSTROPHE, OTHER, HIGH = range(6)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[*range(0x09, 0x0E), 0x20]] = SPACE
CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
CLASS[0x30:0x3A] = DIGIT
CLASS[0x27] = APOSTROPHE
CLASS[0x80:] = HIGH


def between(*pairs: tuple[int, int]) -> np.ndarray:
    """A table of the pairs of neighbouring classes that a cut goes between."""
    table = np.zeros((6, 6), bool)
    for a, b in pairs:
        table[a, b] = True
    return table.ravel()


def cut(data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Where pieces begin; every document begins one."""
    kind = CLASS[data]
    fresh = np.empty(len(data), bool)
    fresh[0] = True
    np.take(cuts, kind[:-1] * np.uint8(6) + kind[1:], out=fresh[1:])
    heads = offsets[:-1]
    fresh[heads[heads < len(data)]] = True
    return np.flatnonzero(fresh)


#: Elements gathered at a time: their places take three times eight bytes each.
GATHER = 1 << 17


def places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all elements of some ranges, one range after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """flat[start:start + count] of each range, one after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    if total <= GATHER:
        return flat[places(starts, counts)]
    out = np.empty(total, flat.dtype)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(GATHER, total, GATHER)), [len(ends)]]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        begin = int(ends[a - 1]) if a else 0
        out[begin : int(ends[b - 1])] = flat[places(starts[a:b], counts[a:b])]
    return out


class Memory:
    """Ids of pieces. learn: distinct pieces to the ids of all and how many each has. fold: what of pieces that are
    looked up matters (of an array of strings, an array). Beyond ``most`` pieces it starts anew."""

    def __init__(self, learn: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], most: int, kind: pa.DataType, fold: Callable[[pa.Array], pa.Array] = lambda p: p):
        self.learn, self.most, self.kind, self.fold = learn, most, kind, fold
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids = pa.array([], pa.list_(self.kind))

    def numbers(self, pieces: pa.Array) -> pa.Array:
        """The entry of each of some distinct pieces; those not known are learned."""
        if len(self.known) > self.most:
            self.clear()
        pieces = self.fold(pieces)
        at = pc.index_in(pieces, value_set=self.known)
        if not at.null_count:
            return at
        missing = pc.is_null(at)
        found = pieces.filter(missing).dictionary_encode()
        new, known = found.dictionary, len(self.known)
        ids, counts = self.learn(new)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        self.ids = pa.concat_arrays([self.ids, pa.ListArray.from_arrays(offsets, pa.array(ids, self.kind))])
        self.known = pa.concat_arrays([self.known, new])
        return pc.replace_with_mask(at, missing, pc.add(found.indices, pa.scalar(known, pa.int32())))

    def encode(self, data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents, one after the other, and how many each has."""
        if not len(data):
            return np.zeros(0, self.kind.to_pandas_dtype()), np.zeros(len(offsets) - 1, np.int64)
        starts = cut(data, offsets, cuts)
        column = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data))
        coded = column.dictionary_encode()
        found = self.ids_of(self.numbers(coded.dictionary), coded.indices)
        ends = found.offsets.to_numpy()
        return found.values.to_numpy(), np.diff(ends[np.searchsorted(starts, offsets)])

    def ids_of(self, numbers: pa.Array, indices: pa.Array) -> pa.ListArray:
        return self.ids.take(numbers.take(indices))


def gathered(batches: Iterator[pa.RecordBatch], text: int, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Small batches joined to ones with about ``size`` bytes of text, so that what batches share is looked up once."""
    held: list[pa.RecordBatch] = []
    room = size
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        room -= batch.column(text).nbytes
        if room <= 0:
            yield pa.concat_batches(held)
            held, room = [], size
    if held:
        yield pa.concat_batches(held)


def encode_column(column: pa.Array, memory: Memory, cuts: np.ndarray, apart: np.ndarray, whole: Callable[[list[str]], list[np.ndarray]], size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, ids, counts) of runs of a string column's rows. apart: rows that ``whole`` encodes, uncut."""
    if apart.any():
        plain = pc.if_else(pa.array(apart), pa.scalar("", column.type), column)
    else:
        plain = column
    data, offsets = buffers(plain)
    for first, last, part, own in chunks(data, offsets, size):
        ids, counts = memory.encode(part, own, cuts)
        rows = np.flatnonzero(apart[first:last])
        if len(rows):
            pieces = np.split(ids, np.cumsum(counts)[:-1])
            for row, found in zip(rows.tolist(), whole([column[first + row].as_py() for row in rows.tolist()]), strict=True):
                pieces[row] = found.astype(ids.dtype)
                counts[row] = len(found)
            ids = np.concatenate(pieces)
        yield first, last, ids, counts
