"""Benchmark decontamination: an FM-index per training shard, searched for windows of benchmark words.

A shard is a run of documents that one task holds at a time. Its index leaves out what cannot take part in any match:
a word that no benchmark item has becomes a separator, and a stretch between separators that is shorter than the
shortest window is dropped. Every window is then searched backwards through the wavelet ranks, its occurrences are
located by sampled suffix positions, and overlapping occurrences merge to spans of words.

Words are compared by a 64-bit hash. The benchmark is taken in blocks of at most ``BLOCK_BYTES`` of text, so what
tasks receive is bounded however large it is; with more than one block the spans of a document are merged after a
shuffle on its key.

Nulls and edge cases: a null or empty text has no words, and no item without words ever occurs. Items that repeat an
id count once. An item with a null id still marks words but is in no list. Keys may repeat; with one block each row
gets its own result, with more they are told apart by a row number. An empty benchmark or table works. Other columns
of the documents are left out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.arrowkit import ALNUM, U64, Words, buffers, chunks, range_hashes, split_words
from tracewell.llm.fmindex import FMIndex

WINDOW = 13
#: Benchmark text per block: with its windows about ten times this in a task's memory.
BLOCK_BYTES = 8 << 20
#: Words kept for one index; a document that has more gets an index of its own.
SHARD_WORDS = 1 << 20
#: Occurrences located at a time.
LOCATE_ROWS = 1 << 20


@dataclass
class Phrases:
    """The distinct windows of a block of items, as symbols 1..top that stand for words."""

    vocabulary: np.ndarray  # sorted hashes; symbol s is vocabulary[s - 1]
    seen: np.ndarray  # by the low bits of a hash: may a word be in the vocabulary?
    by_length: list[tuple[np.ndarray, np.ndarray]]  # (numbers of windows, [windows, length] symbols)
    item_first: np.ndarray  # window w stands in items[item_first[w]:item_first[w + 1]]
    items: np.ndarray
    names: list[str | None]
    shortest: int

    @staticmethod
    def of(items: list[tuple[str | None, str | None]], window: int) -> Phrases:
        data, offsets = buffers(pa.array([t for _, t in items], pa.string()))
        words = split_words(data, offsets, ALNUM, lower=True)
        vocabulary, symbols = np.unique(words.hashes, return_inverse=True)
        symbols = symbols + 1
        starts, lengths, owners = [], [], []
        for d in range(len(items)):
            a, b = int(words.first[d]), int(words.first[d + 1])
            if b > a:
                at = np.arange(a, max(a, b - window) + 1)
                starts.append(at)
                lengths.append(np.full(len(at), min(window, b - a)))
                owners.append(np.full(len(at), d))
        none = np.zeros(0, np.int64)
        starts, lengths, owners = (np.concatenate([none, *x]) for x in (starts, lengths, owners))
        names = [n for n, _ in items]
        known: dict[str, int] = {}
        number = np.array([known.setdefault(n, d) if n is not None else -1 for d, n in enumerate(names)], np.int64)
        prints = range_hashes(symbols.astype(np.uint64), starts, starts + lengths) if len(starts) else np.zeros(0, U64)
        _, first, which = np.unique(prints, return_index=True, return_inverse=True)
        by_length = []
        for length in np.unique(lengths[first]):
            own = np.flatnonzero(lengths[first] == length)
            by_length.append((own, symbols[starts[first[own]][:, None] + np.arange(length)]))
        pairs = np.unique(np.stack([which, number[owners]], 1), axis=0) if len(starts) else np.zeros((0, 2), np.int64)
        seen = np.zeros(1 << 16, bool)
        seen[vocabulary & U64(0xFFFF)] = True
        return Phrases(vocabulary, seen, by_length, np.searchsorted(pairs[:, 0], np.arange(len(first) + 1)), pairs[:, 1], names, int(lengths.min()) if len(lengths) else 0)

    def symbols_of(self, hashes: np.ndarray) -> np.ndarray:
        """0 for words that no item has."""
        out = np.zeros(len(hashes), np.int64)
        may = np.flatnonzero(self.seen[hashes & U64(0xFFFF)])
        if len(may):
            own = hashes[may]
            at = np.minimum(np.searchsorted(self.vocabulary, own), len(self.vocabulary) - 1)
            out[may] = np.where(self.vocabulary[at] == own, at + 1, 0)
        return out


def _stretches(words: Words, symbols: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the stretches that may hold a window, each followed by a 0, and the word that each stands for (-1)."""
    known = symbols > 0
    if not known.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.empty(len(symbols), bool)
    breaks[0] = True
    breaks[1:] = (words.doc[1:] != words.doc[:-1]) | (known[1:] != known[:-1])
    heads = np.flatnonzero(breaks)
    sizes = np.diff(np.append(heads, len(symbols)))
    keep = known[heads] & (sizes >= shortest)
    heads, sizes = heads[keep], sizes[keep]
    total = int(sizes.sum()) + len(sizes)
    text, word = np.zeros(total, np.int64), np.full(total, -1, np.int64)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    to, source = np.repeat(begin, sizes) + inner, np.repeat(heads, sizes) + inner
    text[to], word[to] = symbols[source], source
    return text, word


class _Shard:
    """Documents gathered until their index is worth building, and what the search then found."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.clear()

    def clear(self) -> None:
        self.n_words: list[np.ndarray] = []
        self.text: list[np.ndarray] = []
        self.word: list[np.ndarray] = []  # place of the word in its document
        self.doc: list[np.ndarray] = []
        self.bytes: list[np.ndarray] = []
        self.docs = self.kept = 0

    def add(self, words: Words, docs: int, start_of_doc: np.ndarray) -> None:
        phrases = self.phrases
        self.n_words.append(np.diff(words.first))
        if phrases.shortest and len(words.doc):
            text, word = _stretches(words, phrases.symbols_of(words.hashes), phrases.shortest)
            real = np.maximum(word, 0)
            doc = words.doc[real]
            self.text.append(text)
            self.word.append(np.where(word >= 0, word - words.first[doc], -1))
            self.doc.append(doc + self.docs)
            self.bytes.append(np.stack([words.starts[real] - start_of_doc[doc], words.ends[real] - start_of_doc[doc]], 1))
            self.kept += len(text)
        self.docs += docs

    def search(self) -> tuple[np.ndarray, list[list[int]], list[list[tuple[int, int, int, int]]]]:
        """Per document: its words, the items found, and the merged spans (first and past word, first and past byte)."""
        n_words = np.concatenate([np.zeros(0, np.int64), *self.n_words])
        items: list[list[int]] = [[] for _ in range(self.docs)]
        spans: list[list[tuple[int, int, int, int]]] = [[] for _ in range(self.docs)]
        if not self.kept:
            return n_words, items, spans
        text, word, doc = (np.concatenate(x) for x in (self.text, self.word, self.doc))
        places = np.concatenate(self.bytes)
        index = FMIndex(text, len(self.phrases.vocabulary))
        cover = np.zeros(len(text) + 1, np.int64)
        found = []
        for numbers, phrases in self.phrases.by_length:
            low, high = index.search(phrases)
            hits = np.flatnonzero(high > low)
            if not len(hits):
                continue
            counts = (high - low)[hits]
            rows = np.repeat(low[hits], counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            which = np.repeat(numbers[hits], counts)
            for s in range(0, len(rows), LOCATE_ROWS):
                at = index.locate(rows[s : s + LOCATE_ROWS])
                np.add.at(cover, at, 1)
                np.subtract.at(cover, at + phrases.shape[1], 1)
                found.append(np.unique(doc[at] * len(self.phrases.item_first) + which[s : s + LOCATE_ROWS]))
        if not found:
            return n_words, items, spans
        hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        fresh = np.empty(len(hit), bool)
        fresh[0] = True
        # separators stand between stretches, so places that follow each other are words that follow each other
        fresh[1:] = np.diff(hit) != 1
        heads, tails = hit[fresh], hit[np.append(np.flatnonzero(fresh)[1:] - 1, len(hit) - 1)]
        for d, a, b, c, e in zip(doc[heads].tolist(), word[heads].tolist(), (word[tails] + 1).tolist(), places[heads, 0].tolist(), places[tails, 1].tolist(), strict=True):
            spans[d].append((a, b, c, e))
        pairs = np.unique(np.concatenate(found))
        first, of = self.phrases.item_first, self.phrases.items
        for pair in pairs.tolist():
            d, w = divmod(pair, len(first))
            items[d].extend(of[first[w] : first[w + 1]].tolist())
        return n_words, items, spans


SPANS = "array<struct<first_word:bigint,past_word:bigint,first_byte:bigint,past_byte:bigint>>"


def _search_block(rows: DataFrame, phrases: Phrases) -> DataFrame:
    """rows: key columns and, last, the text. Key columns, n_words, items (array<string>) and spans."""
    keys = rows.columns[:-1]
    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), "n_words bigint", "items array<string>", f"spans {SPANS}"])
    struct = pa.struct([(n, pa.int64()) for n in ("first_word", "past_word", "first_byte", "past_byte")])

    def results(shard: _Shard, columns: list[pa.Array], begin: int) -> pa.RecordBatch:
        n_words, items, spans = shard.search()
        names = [sorted({phrases.names[i] for i in own if i >= 0}) if own else [] for own in items]
        values = [[dict(zip(struct.names, s, strict=True)) for s in own] for own in spans]
        out = [*(c.slice(begin, shard.docs) for c in columns), pa.array(n_words, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(values, pa.list_(struct))]
        return pa.RecordBatch.from_arrays(out, names=[*keys, "n_words", "items", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(phrases)
        for batch in batches:
            data, offsets = buffers(batch.column(len(keys)))
            columns, begin = [batch.column(i) for i in range(len(keys))], 0
            for first, last, part, own in chunks(data, offsets):
                shard.add(split_words(part, own, ALNUM, lower=True), last - first, own)
                if shard.kept >= SHARD_WORDS:
                    yield results(shard, columns, begin)
                    begin = last
                    shard.clear()
            if shard.docs:
                yield results(shard, columns, begin)
                shard.clear()

    return rows.mapInArrow(run, schema)


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in blocks of bounded size, each collected by itself."""
    own = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")).where("text is not null")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for b in range(blocks):
        part = own if blocks == 1 else own.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        yield [(r.item, r.text) for r in part.collect()]


def find_contamination(df: DataFrame, key: str, text: str, benchmark: DataFrame, item: str, item_text: str, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``df``: key, n_words, n_hit (words inside occurrences), items (ids as sorted strings) and spans."""
    blocks = [Phrases.of(items, window) for items in _blocks(benchmark, item, item_text, block_bytes)]
    rows = df.select(df[key].alias(key), df[text].cast("string").alias("_text"))
    if len(blocks) == 1:
        found = _search_block(rows, blocks[0])
    else:
        from tracewell.llm.storage import written

        # a row number of its own tells rows with equal keys apart; written, so that all blocks see the same one
        numbered = written(rows.select(key, F.monotonically_increasing_id().alias("_row"), "_text"), "decontaminate")
        parts = [_search_block(numbered, block) for block in blocks]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionAll(part)
        found = every.groupBy("_row").agg(
            F.first(key).alias(key),
            F.first("n_words").alias("n_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        )
        found = found.select(key, "n_words", "items", F.expr(MERGE).alias("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda t, s: t + s["past_word"] - s["first_word"])
    return found.select(key, "n_words", n_hit.alias("n_hit"), "items", "spans")


#: Merges sorted spans of words that overlap or touch.
MERGE = f"""
aggregate(spans, cast(array() as {SPANS}), (done, s) ->
  if(size(done) > 0 and element_at(done, -1).past_word >= s.first_word,
     concat(slice(done, 1, size(done) - 1), array(named_struct(
       'first_word', element_at(done, -1).first_word, 'past_word', greatest(element_at(done, -1).past_word, s.past_word),
       'first_byte', element_at(done, -1).first_byte, 'past_byte', greatest(element_at(done, -1).past_byte, s.past_byte)))),
     concat(done, array(s))))
"""


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit"):
    """The rule: some word is hit, and at least one in twenty is."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))
