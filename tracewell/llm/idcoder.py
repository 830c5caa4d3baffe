"""Adaptive context-mixing range coder for token ids.

A block of ids is coded by itself: its models start empty and its checksum covers its ids. The block is cut into equal
runs, one for each of its lanes, and numpy takes the same step of all lanes at once; every lane has a range coder of
its own, all lanes of a block share one model. Every so many steps the model is brought up to date with all ids that the
lanes have coded, which the decoder knows as well by then:

- order 0: how often each id occurred; an id that never did keeps a small share.
- order 1: the ids seen after the last id. Their distribution is mixed with order 0's, with a weight for each size of
  context that is learned from how well either order foretold the latest ids. An id that was not seen there is coded
  as an escape, followed by order 0.
- order 2: the id that followed the last two. Where such a guess is worth it, by the hits of guesses of its confidence
  so far, it is first coded whether it holds.

All numbers are integers, so that any machine gives the same code. The range coder has 64 bits of state and emits 32-bit
words; carries are settled when a block ends.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Ids of a block, lanes of a block at most, and the least steps that another lane is added for.
BLOCK, LANES, STEPS = 1 << 22, 8192, 256
U64, U32 = np.uint64, np.uint32
#: log2 of the sums of frequencies: order 0, order 1, and the choice for or against an order-2 guess.
SUM0, SUM1, SUM2 = 22, 16, 12
IDS = 1 << 16
_LEAST, _LOW, _32 = U64(1 << 32), U64((1 << 32) - 1), U64(32)
#: Ids after one id beyond which order 0 alone serves it; their smallest shares would fill a context.
_WIDEST = 1 << 14
_HASH_BITS = 17
#: Order-2 guesses by how often they held of late (0 to 7); a class is used from this share of hits on (of 4096).
_SURE, _WORTH = 8, 1600
#: Steps whose ids teach the weights at an update.
_LEARN = 4


class _Writer:
    """Range coder states of all lanes and the words they emit."""

    def __init__(self, lanes: int, steps: int):
        self.low = np.zeros(lanes, U64)
        self.range = np.full(lanes, (1 << 64) - 1, U64)
        self.words = np.zeros((lanes, steps // 2 + 8), U64)
        self.count = np.zeros(lanes, np.int64)

    def _emit(self, lanes: np.ndarray, words: np.ndarray) -> None:
        at = self.count[lanes]
        if int(at.max()) >= self.words.shape[1]:
            self.words = np.concatenate([self.words, np.zeros_like(self.words)], axis=1)
        self.words[lanes, at] = words
        self.count[lanes] = at + 1

    def _carry(self, lanes: np.ndarray) -> None:
        self.words[lanes, self.count[lanes] - 1] += U64(1)

    def code(self, lanes, begin: np.ndarray, size: np.ndarray, bits: int) -> None:
        """Narrows the range of lanes (their numbers, or a slice for all) to size parts from begin on, of 2**bits."""
        every = isinstance(lanes, slice)
        old, span = self.low[lanes], self.range[lanes] >> U64(bits)
        low = old + begin * span
        span *= size
        over = np.flatnonzero(low < old)
        if len(over):
            self._carry(over if every else lanes[over])
        out = np.flatnonzero(span < _LEAST)  # once is enough: span is at least 2**(32 - bits)
        if len(out):
            own = low[out]
            self._emit(out if every else lanes[out], own >> _32)
            low[out] = own << _32
            span[out] <<= _32
        self.low[lanes], self.range[lanes] = low, span

    def finish(self) -> bytes:
        """Word counts of the lanes, then their words."""
        end = self.low + _LOW  # its upper word alone lies in any range of 2**32 or more
        self._carry(np.flatnonzero(end < self.low))
        self._emit(np.arange(len(self.low)), end >> _32)
        words = self.words[:, : int(self.count.max())]
        for at in range(words.shape[1] - 1, 0, -1):  # what a word has above 32 bits is a carry into the one before
            words[:, at - 1] += words[:, at] >> _32
        used = words[np.arange(words.shape[1]) < self.count[:, None]]
        return self.count.astype("<u2").tobytes() + used.astype("<u4").tobytes()


class _Reader:
    def __init__(self, lanes: int, code: bytes):
        count = np.frombuffer(code, "<u2", lanes).astype(np.int64)
        if len(code) != 2 * lanes + 4 * int(count.sum()):
            raise ValueError("a block is cut short")
        words = np.frombuffer(code, "<u4", offset=2 * lanes)
        # two words of zeros stand behind those of each lane: what is read past the end counts as 0
        self.at = np.cumsum(count) - count + 2 * np.arange(lanes)
        self.last = self.at + count + 1
        self.words = np.zeros(len(words) + 2 * lanes, U64)
        self.words[np.arange(len(words)) + 2 * np.repeat(np.arange(lanes), count)] = words
        self.value = (self.words[self.at] << _32) | self.words[self.at + 1]
        self.at += 2
        self.range = np.full(lanes, (1 << 64) - 1, U64)

    def part(self, lanes, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Width of a part of 2**bits, and the part that each lane's value lies in."""
        span = self.range[lanes] >> U64(bits)
        return span, np.minimum(self.value[lanes] // span, U64((1 << bits) - 1)).view(np.int64)

    def take(self, lanes, span: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        value = self.value[lanes] - begin * span
        span = span * size
        out = np.flatnonzero(span < _LEAST)
        if len(out):
            own = out if isinstance(lanes, slice) else lanes[out]
            at = np.minimum(self.at[own], self.last[own])
            value[out] = (value[out] << _32) | self.words[at]
            self.at[own] = at + 1
            span[out] <<= _32
        self.value[lanes], self.range[lanes] = value, span


class _Model:
    """What a block's lanes have shown so far."""

    def __init__(self):
        self.size0 = np.full(IDS, 1 << (SUM0 - 16), np.int64)
        self.begin0 = (np.cumsum(self.size0) - self.size0).astype(U64)
        self.places0 = self.begin0.astype(U32)
        self.keys = np.zeros(1, U32)  # last id and id; with a count of 0 here, so that no search is empty
        self.count = np.zeros(1, np.int64)
        self.begin, self.size = np.zeros(1, U64), np.ones(1, U64)
        self.escape = np.full(IDS, 1 << SUM1, np.int64)  # the share, from 0 on, of ids not seen after an id
        self.paired = False  # does any context have a share for what followed it?
        self.class_ = np.zeros(IDS, np.int64)
        self.total = np.zeros(IDS, np.int64)
        # weight of order 1 (of 2**16) by the bit length of a context's size, and the credit that it comes from
        self.credit = np.array([[(k + 1) << 20, 4 << 20] for k in range(18)], np.int64)
        self.credit[:, 1] += self.credit[:, 0]
        self.guess = np.zeros(1 << _HASH_BITS, np.uint16)
        self.sure = np.zeros(1 << _HASH_BITS, np.int8)
        self.hits = np.array([[1, 8 - s] for s in range(_SURE)], np.int64)
        self.hits[:, 1] += self.hits[:, 0]
        self.share2 = self._share2()

    @staticmethod
    def context2(last: np.ndarray, before: np.ndarray) -> np.ndarray:
        mixed = (last.astype(U32) * U32(0x9E3779B1)) ^ (before.astype(U32) * U32(0x85EBCA77))
        return ((mixed * U32(0xC2B2AE35)) >> U32(32 - _HASH_BITS)).astype(np.int64)

    def _share2(self) -> np.ndarray:
        """Share of the hits (of 2**SUM2) by confidence, 0 for those that are not worth a choice."""
        share = np.clip((self.hits[:, 0] << SUM2) // np.maximum(self.hits[:, 1], 1), 64, (1 << SUM2) - 64)
        return np.where(share >= _WORTH, share, 0)

    def find(self, last: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of each id after its last one, and whether there is one."""
        key = (last << 16) | ids
        at = np.maximum(_search(self.keys, key) - 1, 0)
        return at, (self.keys[at] == key) & (self.escape[last] < 1 << SUM1)

    def update(self, ids: np.ndarray, a: int, b: int) -> None:
        """Learns from steps a to b of ids [step, lane], all before which are known too."""
        last, before = _earlier(ids, a, b, 1), _earlier(ids, a, b, 2)
        now = ids[a:b].astype(np.int64)
        self._learn_weights(last[-_LEARN:].ravel(), now[-_LEARN:].ravel())
        self._learn_guesses(self.context2(last, before).ravel(), now.ravel())
        so_far = ids[:b].astype(U32)
        self._learn_counts(np.concatenate([np.zeros((1, ids.shape[1]), U32), so_far[:-1]]).ravel(), so_far.ravel())

    def _learn_weights(self, last: np.ndarray, ids: np.ndarray) -> None:
        at, there = self.find(last, ids)
        weight = self._weights()[self.class_[last]]
        known = self.escape[last] < 1 << SUM1
        first = np.where(there, weight * ((self.count[at] << 16) // np.maximum(self.total[last], 1)), 0)
        other = (65536 - weight) * (self.size0[ids] >> (SUM0 - 16))
        credit = (first << 12) // np.maximum(first + other, 1)
        kind = self.class_[last][known]
        # sums of integers below 2**12, exact in doubles
        self.credit[:, 0] = (self.credit[:, 0] >> 1) + np.bincount(kind, credit[known], minlength=18).astype(np.int64)
        self.credit[:, 1] = (self.credit[:, 1] >> 1) + (np.bincount(kind, minlength=18) << 12)

    def _weights(self) -> np.ndarray:
        return np.clip((self.credit[:, 0] << 16) // np.maximum(self.credit[:, 1], 1), 655, 65536 - 655)

    def _learn_guesses(self, context: np.ndarray, ids: np.ndarray) -> None:
        right, sure = self.guess[context] == ids, self.sure[context]
        for column, own in ((0, sure[right]), (1, sure)):
            self.hits[:, column] = (self.hits[:, column] >> 1) + np.bincount(own, minlength=_SURE)
        wrong = ~right
        failed, other = context[wrong], ids[wrong]
        gain = np.bincount(context[right], minlength=1 << _HASH_BITS) - np.bincount(failed, minlength=1 << _HASH_BITS) + self.sure
        lost = gain[failed] < 0
        self.guess[failed[lost]] = other[lost]  # of several the last stays
        self.sure = np.clip(gain, 0, _SURE - 1).astype(np.int8)
        self.share2 = self._share2()

    def _learn_counts(self, last: np.ndarray, ids: np.ndarray) -> None:
        n = len(ids)
        self.size0 = 1 + np.bincount(ids, minlength=IDS) * ((1 << SUM0) - IDS) // n
        self.begin0 = (np.cumsum(self.size0) - self.size0).astype(U64)
        self.places0 = self.begin0.astype(U32)
        key = (last << U32(16)) | ids
        key.sort()
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.keys, self.count = key[heads], np.diff(np.append(heads, n))
        owner = (self.keys >> U32(16)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        rows, wide = owner[first], np.diff(np.append(first, len(owner)))
        total = np.add.reduceat(self.count, first)
        self.total = np.zeros(IDS, np.int64)
        self.total[rows] = total
        kind = np.frexp(total.astype(np.float64))[1]  # the bit length
        self.class_ = np.zeros(IDS, np.int64)
        self.class_[rows] = np.minimum(kind, 17)
        weight = self._weights()[self.class_[rows]]
        mixed = np.repeat(weight, wide) * ((self.count << SUM0) // np.repeat(total, wide))
        mixed += np.repeat(65536 - weight, wide) * self.size0[(self.keys & U32(0xFFFF)).astype(np.int64)]
        room = np.maximum((1 << SUM1) - 1 - wide, 0)
        size = 1 + ((mixed * np.repeat(room, wide)) >> (SUM0 + 16))
        ends = np.cumsum(size)
        sums = ends[first + wide - 1] - ends[first] + size[first]
        escape = (1 << SUM1) - sums
        self.begin = (ends - size - np.repeat(ends[first] - size[first], wide) + np.repeat(escape, wide)).astype(U64)
        self.size = size.astype(U64)
        self.escape = np.full(IDS, 1 << SUM1, np.int64)
        self.escape[rows] = np.where(wide <= _WIDEST, escape, 1 << SUM1)
        self.paired = bool((wide <= _WIDEST).any())
        self.places = ((owner << SUM1) + self.begin.view(np.int64)).astype(U32)
        self.of = (self.keys & U32(0xFFFF)).astype(np.int64)


def _search(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """How many entries of a sorted table of 32-bit numbers are at most each value; values are sorted first, as
    neighbouring searches then share their path."""
    order = (values.astype(U64) << U64(24)) | np.arange(len(values), dtype=U64)
    order.sort()
    out = np.empty(len(values), np.int64)
    out[(order & U64((1 << 24) - 1)).view(np.int64)] = np.searchsorted(table, (order >> U64(24)).astype(U32), side="right")
    return out


def _earlier(ids: np.ndarray, a: int, b: int, back: int) -> np.ndarray:
    """The ids ``back`` steps before steps a to b, 0 before a lane begins."""
    out = np.zeros((b - a, ids.shape[1]), np.int64)
    skip = max(0, back - a)
    if b - back > 0 and skip < b - a:
        out[skip:] = ids[a + skip - back : b - back]
    return out


def _phases(steps: int) -> list[tuple[int, int]]:
    """Spans of steps between which the model learns: each as long as all before."""
    ends = [min(2, steps)]
    while ends[-1] < steps:
        ends.append(min(steps, 2 * ends[-1]))
    return list(zip([0, *ends[:-1]], ends, strict=True))


def _lanes(n: int) -> tuple[int, int]:
    """Lanes and steps of a block of n ids."""
    lanes = max(1, min(LANES, n // STEPS))
    return lanes, -(-n // lanes)


def _encode_block(block: np.ndarray) -> bytes:
    lanes, steps = _lanes(len(block))
    padded = np.zeros(lanes * steps, np.uint16)
    padded[: len(block)] = block
    ids = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    model, writer, every = _Model(), _Writer(lanes, steps), slice(None)
    for a, b in _phases(steps):
        last, before = _earlier(ids, a, b, 1), _earlier(ids, a, b, 2)
        now = ids[a:b].astype(np.int64)
        context = model.context2(last, before)
        share = model.share2[model.sure[context]]
        tried = share > 0
        held = tried & (model.guess[context] == now)
        at, there = model.find(last.ravel(), now.ravel())
        at, there = at.reshape(now.shape), there.reshape(now.shape)
        size = np.where(there, model.size[at], model.escape[last].astype(U64))
        size[held] = 1 << SUM1
        begin = np.where(there & ~held, model.begin[at], U64(0))
        escaped = ~there & ~held
        for t in range(b - a):
            lane = np.flatnonzero(tried[t])
            if len(lane):
                own, won = share[t, lane], held[t, lane]
                writer.code(lane, np.where(won, 0, own).astype(U64), np.where(won, own, (1 << SUM2) - own).astype(U64), SUM2)
            if model.paired:
                writer.code(every, begin[t], size[t], SUM1)
            lane = np.flatnonzero(escaped[t])
            if len(lane):
                own = now[t, lane]
                writer.code(lane, model.begin0[own], model.size0[own].astype(U64), SUM0)
        if b < steps:
            model.update(ids, a, b)
    return writer.finish()


def _decode_block(n: int, code: bytes) -> np.ndarray:
    lanes, steps = _lanes(n)
    ids = np.zeros((steps, lanes), np.uint16)
    model, reader, every = _Model(), _Reader(lanes, code), slice(None)
    last = before = np.zeros(lanes, np.int64)
    for a, b in _phases(steps):
        for t in range(a, b):
            now = np.zeros(lanes, np.int64)
            context = model.context2(last, before)
            share = model.share2[model.sure[context]]
            held = np.zeros(lanes, bool)
            lane = np.flatnonzero(share)
            if len(lane):
                own = share[lane]
                span, value = reader.part(lane, SUM2)
                won = value < own
                reader.take(lane, span, np.where(won, 0, own).astype(U64), np.where(won, own, (1 << SUM2) - own).astype(U64))
                held[lane] = won
            if model.paired:
                span, value = reader.part(every, SUM1)
                escape = model.escape[last]
                at = np.maximum(_search(model.places, (last << SUM1) + value) - 1, 0)
                there = (value >= escape) & ~held
                size = np.where(there, model.size[at], escape.astype(U64))
                size[held] = 1 << SUM1
                reader.take(every, span, np.where(there, model.begin[at], U64(0)), size)
                now = np.where(there, model.of[at], now)
            else:
                there = np.zeros(lanes, bool)
            lane = np.flatnonzero(~there & ~held)
            if len(lane):
                span, value = reader.part(lane, SUM0)
                own = _search(model.places0, value) - 1
                reader.take(lane, span, model.begin0[own], model.size0[own].astype(U64))
                now[lane] = own
            lane = np.flatnonzero(held)
            now[lane] = model.guess[context[lane]]
            ids[t] = now
            last, before = now, last
        if b < steps:
            model.update(ids, a, b)
    return ids.T.ravel()[:n]


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def encode(ids: np.ndarray, size: int = BLOCK) -> list[tuple[int, int, bytes]]:
    """(number of ids, checksum, code) of each block of a sequence of ids below 65,536."""
    if len(ids) and int(ids.max()) >= IDS:
        raise ValueError("ids must be below 65,536")
    blocks = [ids[i : i + size] for i in range(0, len(ids), size)]
    return [(len(b), checksum(b), _encode_block(b)) for b in blocks]


def decode(blocks: list[tuple[int, int, bytes]]) -> np.ndarray:
    """The ids of blocks; raises ValueError if a block does not give its checksum."""
    out = [np.zeros(0, np.uint16)]
    for i, (n, crc, code) in enumerate(blocks):
        out.append(_decode_block(n, code))
        if checksum(out[-1]) != crc:
            raise ValueError(f"block {i} does not give its checksum")
    return np.concatenate(out)
