"""Removal of word passages that occur more than once, by suffix automata of reference shards.

A window is ``WINDOW`` words in a row. Its anchor is the least hash among its runs of ``KMER`` words, so equal windows
have equal anchors wherever they stand. Neighbouring windows with one anchor form a run, whose text holds exactly
these windows; runs with equal anchors belong to one reference shard. A suffix automaton is built over a shard's
distinct texts, weighted by their number, and each text is streamed through it: matching statistics of at least WINDOW
words in a state with two or more occurrences mark a repeated window. Overlapping windows merge to maximal spans, and
these words are removed. Only anchors that occur once in all are left out, as no other text can hold their windows.

All reference texts together grow with the corpus, so the automata are not broadcast: texts meet them in the shard of
their anchor, which holds a bounded number of texts. An anchor with more than ``HOT`` different texts, too many for one
automaton, has its windows counted by their hash instead, which is exact and spread over all tasks.

Words are compared by 64-bit hashes. Nulls and edge cases: a null text has no words and gives an empty text; a text
with fewer words than a window loses nothing. Repeated rows are each others' copies. Null or repeated keys are
allowed: rows then get a number of their own first. Other columns are ignored. An empty table works.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.arrowkit import NONSPACE, U64, Words, buffers, chunks, range_hashes, split_words
from tracewell.llm.storage import written

WINDOW, KMER = 35, 8
#: Different texts of an anchor up to which an automaton takes it; texts of a shard on average.
HOT, SHARD_TEXTS = 1000, 1500


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of values[i:i + width] for each i that has so many."""
    out, power, at = None, values, 0
    for bit in range(width.bit_length()):
        if width >> bit & 1:
            n = len(values) - width + 1
            part = power[at : at + n]
            out = part if out is None else np.minimum(out, part)
            at += 1 << bit
        power = np.minimum(power[: -(1 << bit)], power[1 << bit :]) if len(power) > 1 << bit else power[:0]
    return out


def runs(words: Words, window: int, kmer: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: document, first word in it, windows, anchor, hash of the run's text, and whether
    the anchor stands in the text more than once (only then may a window occur twice inside it)."""
    n = len(words.hashes)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none.astype(U64), none.astype(U64), none.astype(bool)
    grams = range_hashes(words.hashes, np.arange(n - kmer + 1), np.arange(kmer, n + 1))
    width = window - kmer + 1
    least = sliding_min(grams, width)
    inside = words.doc[: n - window + 1] == words.doc[window - 1 :]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return none, none, none, none.astype(U64), none.astype(U64), none.astype(bool)
    anchor = least[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (np.diff(starts) != 1) | (anchor[1:] != anchor[:-1]) | (words.doc[starts[1:]] != words.doc[starts[:-1]])
    heads = np.flatnonzero(fresh)
    place = np.arange(len(starts)) - np.repeat(heads, np.diff(np.append(heads, len(starts))))
    fresh |= place % width == 0  # a run longer than one anchor can make is cut, so that masks stay short
    heads = np.flatnonzero(fresh)
    size = np.diff(np.append(heads, len(starts)))
    first, anchor = starts[heads], anchor[heads]
    seen = np.zeros(len(heads), np.int64)
    for i in range(2 * width - 1):  # grams of the run: its windows' grams
        at = first + i
        own = i < size + width - 1
        seen += own & (grams[np.minimum(at, len(grams) - 1)] == anchor)
    doc = words.doc[first]
    text = range_hashes(words.hashes, first, first + size + window - 1)
    return doc, first - words.first[doc], size, anchor, text, seen > 1


class SuffixAutomaton:
    """Of several sequences, each with a number of occurrences."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, sequence: list[int], weight: int) -> None:
        nexts, links, lengths, counts = self.next, self.link, self.length, self.count
        last = 0
        for symbol in sequence:
            known = nexts[last].get(symbol)
            if known is not None and lengths[known] == lengths[last] + 1:
                last = known
                counts[last] += weight
                continue
            if known is None:
                state = len(lengths)
                nexts.append({})
                lengths.append(lengths[last] + 1)
                counts.append(0)
                links.append(0)
                p = last
                while p != -1 and symbol not in nexts[p]:
                    nexts[p][symbol] = state
                    p = links[p]
                if p != -1:
                    q = nexts[p][symbol]
                    links[state] = q if lengths[q] == lengths[p] + 1 else self._split(p, q, symbol)
                last = state
            else:
                last = self._split(last, known, symbol)
            counts[last] += weight

    def _split(self, p: int, q: int, symbol: int) -> int:
        nexts, links, lengths = self.next, self.link, self.length
        clone = len(lengths)
        nexts.append(nexts[q].copy())
        lengths.append(lengths[p] + 1)
        links.append(links[q])
        self.count.append(0)
        links[q] = clone
        while p != -1 and nexts[p].get(symbol) == q:
            nexts[p][symbol] = clone
            p = links[p]
        return clone

    def finish(self) -> None:
        """Counts of occurrences from the longest states down their links."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.count[self.link[state]] += self.count[state]

    def repeated(self, sequence: list[int], window: int) -> int:
        """Bit i: the window that starts at word i of a sequence occurs at least twice."""
        nexts, links, lengths, counts = self.next, self.link, self.length, self.count
        mask = state = matched = 0
        for end, symbol in enumerate(sequence, 1):
            while state and symbol not in nexts[state]:
                state = links[state]
                matched = lengths[state]
            if symbol in nexts[state]:
                state = nexts[state][symbol]
                matched += 1
            while lengths[links[state]] >= window:  # the state of the last WINDOW words
                state = links[state]
                matched = lengths[state]
            if matched >= window and counts[state] > 1:
                mask |= 1 << (end - window)
        return mask


def _run_rows(rows: DataFrame, window: int, kmer: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for at, _, part, own in chunks(data, offsets):
                doc, first, size, anchor, text, twice = runs(split_words(part, own, NONSPACE, lower=False), window, kmer)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc + at)), pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(text.view(np.int64)), pa.array(twice)],
                    names=["row", "first", "size", "anchor", "hash", "twice"],
                )

    return rows.mapInArrow(run, "row long, first int, size int, anchor long, hash long, twice boolean")


def _texts_of(wanted: DataFrame, rows: DataFrame, window: int) -> DataFrame:
    """anchor, hash, n and the word hashes of wanted runs (row, first, size, anchor, hash, n)."""
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("first", "size", "anchor", "hash", "n")).alias("own"))
    joined = rows.join(lists, "row").select("text", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for at, last, part, own in chunks(data, offsets):
                words = split_words(part, own, NONSPACE, lower=False)
                picked = batch.column(1).slice(at, last - at)
                doc = np.repeat(np.arange(last - at), np.diff(picked.offsets.to_numpy()))
                flat = picked.flatten()
                first, size = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                length = size + window - 1
                ends = np.cumsum(length)
                index = np.repeat(words.first[doc] + first, length) + np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - length, length)
                values = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), words.hashes[index].view(np.int64))
                yield pa.RecordBatch.from_arrays([flat.field(2), flat.field(3), flat.field(4), values], names=["anchor", "hash", "n", "words"])

    return joined.mapInArrow(run, "anchor long, hash long, n long, words array<long>")


def _by_automata(texts: DataFrame, window: int) -> DataFrame:
    """anchor, hash and mask of repeated windows; texts: also a shard, n and words."""

    def run(table: pa.Table) -> pa.Table:
        n, sequences = table.column("n").to_pylist(), table.column("words").to_pylist()
        automaton = SuffixAutomaton()
        for weight, sequence in zip(n, sequences, strict=True):
            automaton.add(sequence, weight)
        automaton.finish()
        masks = [automaton.repeated(s, window) for s in sequences]
        return pa.table({"anchor": table.column("anchor"), "hash": table.column("hash"), "mask": pa.array(masks, pa.int64())})

    return texts.groupBy("shard").applyInArrow(run, "anchor long, hash long, mask long")


def _by_counts(texts: DataFrame, window: int) -> DataFrame:
    """The same for anchors with very many texts: windows are counted by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            flat = words.flatten().to_numpy(zero_copy_only=False).view(U64)
            lengths = np.diff(words.offsets.to_numpy())
            windows = lengths - window + 1
            text = np.repeat(np.arange(len(lengths)), windows)
            place = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
            start = np.repeat(np.cumsum(lengths) - lengths, windows) + place
            pick = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("anchor").take(pick), batch.column("hash").take(pick), batch.column("n").take(pick), pa.array(place), pa.array(range_hashes(flat, start, start + window).view(np.int64))],
                names=["anchor", "hash", "n", "place", "window"],
            )

    each = texts.select("anchor", "hash", "n", "words").mapInArrow(run, "anchor long, hash long, n long, place long, window long")
    counted = each.groupBy("window").agg(F.sum("n").alias("total")).where("total > 1")
    found = each.join(counted, "window")
    return found.groupBy("anchor", "hash").agg(F.bit_or(F.expr("shiftleft(1L, cast(place as int))")).alias("mask"))


def repeated_windows(rows: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """row, and own: the runs (first, size, mask) with a repeated window. rows: row (unique long) and text."""
    every = written(_run_rows(rows, window, kmer), "runs")
    anchors = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("runs"), F.max("twice").alias("twice"))
    open_ = anchors.where("runs > 1 or twice").select("anchor")  # the text of any other stands nowhere else
    found = written(every.join(open_, "anchor").select("row", "first", "size", "anchor", "hash"), "repeats")
    groups = found.groupBy("anchor", "hash").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "first", "size")).alias("one"))
    groups = written(groups.select("anchor", "hash", "n", "one.*"), "texts")
    parts = groups.groupBy("anchor").agg(F.count(F.lit(1)).alias("texts"))
    texts = _texts_of(groups, rows, window).join(parts, "anchor")
    texts = written(texts, "words")
    shards = max(1, -(-groups.count() // SHARD_TEXTS))
    few = texts.where(F.col("texts") <= HOT).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    masks = _by_automata(few, window).unionAll(_by_counts(texts.where(F.col("texts") > HOT), window))
    marked = found.join(masks, ["anchor", "hash"]).where("mask <> 0").select("row", "first", "mask")
    return marked.groupBy("row").agg(F.collect_list(F.struct("first", "mask")).alias("own"))


def remove_repeats(df: DataFrame, key: str, text: str, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """Per row: key, n_words, n_removed and kept (the words that are left, joined by one space)."""
    rows = df.select(df[key].alias(key), df[text].cast("string").alias("text"))
    ids = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    whole = dict(rows.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    if whole and ids.where(f"n > 1 or `{key}` is null").isEmpty():
        rows = rows.select(key, F.col(key).cast("long").alias("row"), "text")
    else:
        rows = written(rows.select(key, F.monotonically_increasing_id().alias("row"), "text"), "numbered")
    marked = repeated_windows(rows.select("row", "text"), window, kmer)
    joined = rows.join(marked, "row", "left").select(key, "text", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n_words, n_removed, kept = [], [], []
                for text, own in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = (text or "").encode().split()  # bytes are split at 0x20 and 0x09 to 0x0D
                    n_words.append(len(words))
                    if own:
                        cover = np.zeros(len(words) + 1, np.int64)
                        first, mask = np.array([x["first"] for x in own]), np.array([x["mask"] for x in own], np.int64)
                        run_, bit = np.nonzero(mask[:, None] >> np.arange(window) & 1)
                        np.add.at(cover, first[run_] + bit, 1)
                        np.subtract.at(cover, first[run_] + bit + window, 1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=[key, "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, n_words long, n_removed long, kept string")
