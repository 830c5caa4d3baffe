"""HTML as blocks of text with the exact bytes they come from.

A tokenizer of one regular expression walks over a page and keeps every token's place; entities are decoded apart, so each
span of a block is either the text itself or one entity. Nothing is followed, run or fetched. A page beyond a limit has no
blocks but one row that says which limit it was.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Elements whose content is not shown, that have no content, that make blocks, and kinds of blocks.
HIDDEN = ("iframe", "object", "script", "style", "template")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source")
BLOCKS = ("address", "article", "aside", "blockquote", "caption", "dd", "div", "dt", "figcaption", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "li", "main", "nav", "p", "pre", "section", "td", "th")
KINDS = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "li": "list_item", "pre": "code", "code": "code", "caption": "caption", "figcaption": "caption"}
SPANS = 64
#: Elements whose content is text up to their end, whatever stands in it.
RAW = ("script", "style")

TOKEN = re.compile(
    r"(?P<comment><!--.*?(?:--!?>|\Z))"
    r"|(?P<other><[!?][^>]*>?)"
    r"|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>?"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?:[^\"'>/]|\"[^\"]*\"|'[^']*'|/(?!>))*(?P<closed>/?)>"
    r"|(?P<entity>&(?:\#[0-9]+|\#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);)"
    r"|(?P<text>[^<&]+|[<&])",
    re.DOTALL,
)


@dataclass(frozen=True)
class Limits:
    depth: int = 256
    tokens: int = 1_000_000
    block_characters: int = 250_000
    blocks: int = 100_000


class Beyond(ValueError):
    """A page exceeds a limit."""


class Page:
    """The blocks of one page: (kind, text, [(start, end, decoded)]) with places in code points."""

    def __init__(self, limits: Limits):
        self.limits, self.blocks, self.open = limits, [], []
        self.hidden = self.tokens = 0
        self._begin()

    def _begin(self) -> None:
        self.texts, self.spans, self.size, self.kind = [], [], 0, "paragraph"

    def flush(self) -> None:
        text = "".join(self.texts)
        if text.strip():
            if len(self.blocks) >= self.limits.blocks:
                raise Beyond("blocks")
            self.blocks.append((self.kind, text, self.spans))
        self._begin()

    def add(self, text: str, start: int, end: int, decoded: bool) -> None:
        if not self.spans and not text.strip():
            return
        if len(self.spans) == SPANS:
            self.flush()
        self.size += len(text)
        if self.size > self.limits.block_characters:
            raise Beyond("block_characters")
        # neighbouring pieces of plain text are one span
        if self.spans and not decoded and not self.spans[-1][2] and self.spans[-1][1] == start:
            self.spans[-1] = (self.spans[-1][0], end, False)
        else:
            self.spans.append((start, end, decoded))
        self.texts.append(text)
        self.kind = next((KINDS[t] for t in reversed(self.open) if t in KINDS), "paragraph")

    def begin(self, tag: str, closed: bool) -> None:
        if closed:
            return
        if tag in BLOCKS and not self.hidden:
            self.flush()
        if tag not in VOID:
            if len(self.open) >= self.limits.depth:
                raise Beyond("depth")
            self.open.append(tag)
            self.hidden += tag in HIDDEN

    def end(self, tag: str) -> None:
        if tag in BLOCKS and not self.hidden:
            self.flush()
        if tag in self.open:
            at = len(self.open) - 1 - self.open[::-1].index(tag)
            self.hidden -= sum(t in HIDDEN for t in self.open[at:])
            del self.open[at:]

    def read(self, text: str) -> Page:
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at) or re.compile("<").match(text, at)
            at, kind = m.end(), m.lastgroup
            if kind == "closed":
                kind = "start"
            self.tokens += 1
            if self.tokens > self.limits.tokens:
                raise Beyond("tokens")
            if kind == "start":
                tag = m["start"].lower()
                self.begin(tag, bool(m["closed"]))
                if tag in RAW and not m["closed"]:
                    stop = re.compile(rf"(?i)</{tag}(?=[\s/>])").search(text, at)
                    at = stop.start() if stop else len(text)
            elif kind == "end":
                self.end(m["end"].lower())
            elif kind in ("text", "entity", None) and not self.hidden:
                raw = m[0]
                self.add(html.unescape(raw) if kind == "entity" else raw, m.start(), m.end(), kind == "entity")
        self.flush()
        return self


def blocks(text: str, limits: Limits = Limits()) -> tuple[list[tuple[str, str, list[tuple[int, int, bool]]]], str | None]:
    """Blocks of a page with spans in bytes of its UTF-8, and the limit that it exceeds, if any."""
    try:
        found = Page(limits).read(text).blocks
    except Beyond as e:
        return [], str(e)
    if text.isascii():
        return found, None
    data = np.frombuffer(text.encode(), np.uint8)
    place = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data)).tolist()
    return [(k, t, [(place[a], place[b], d) for a, b, d in s]) for k, t, s in found], None


#: Characters of pages after which their blocks are handed on: spans take many times the memory of their page.
BATCH_CHARS = 1 << 20


def html_spans(df: DataFrame, key: str, page: str, limits: Limits = Limits()) -> DataFrame:
    """key, block_index, kind, text, spans (start, end, decoded: bytes of the page's UTF-8) and failure of each block of
    whole pages. Spans in order, each as it stands or one decoded entity, give the text. A page beyond a limit has one row
    with the limit's name; a null or blank page has none. Rows may share a key."""
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("decoded", T.BooleanType())])
    fields = [("block_index", T.LongType()), ("kind", T.StringType()), ("text", T.StringType()), ("spans", T.ArrayType(span)), ("failure", T.StringType())]
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(n, t) for n, t in fields)])
    kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("decoded", pa.bool_())])), pa.string()]

    def made(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * len(fields)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, size = [], [], 0
            for row, page_text in enumerate(batch.column(1)):  # one page at a time becomes Python text
                text = page_text.as_py()
                found, failure = blocks(text, limits) if text is not None else ([], None)
                own = [(i, kind, t, [{"start": a, "end": b, "decoded": d} for a, b, d in spans], None) for i, (kind, t, spans) in enumerate(found)]
                own += [(None, None, None, None, failure)] if failure else []
                rows += own
                at += [row] * len(own)
                size += len(text or "")
                if size >= BATCH_CHARS:
                    yield made(batch, at, rows)
                    at, rows, size = [], [], 0
            yield made(batch, at, rows)

    return df.select(df[key], df[page].cast("string")).mapInArrow(run, schema)
