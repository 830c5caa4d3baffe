"""Blocks of HTML with byte spans, against the standard parser on the driver's pages."""

import html
import os
from html.parser import HTMLParser

import pytest

from tracewell.sources import markup as M

SF = "/root/testdata/sf0.01"


class Standard(HTMLParser):
    """The same blocks by the standard parser, without places."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.tags, self.out, self.parts, self.kind, self.n, self.plain = [], [], [], "paragraph", 0, False

    def flush(self):
        text = "".join(self.parts)
        if text.strip():
            self.out.append((self.kind, text))
        self.parts, self.n, self.plain = [], 0, False

    @property
    def shown(self):
        return not set(self.tags) & set(M.HIDDEN)

    def add(self, text, plain):
        if not self.shown or (not self.parts and not text.strip()):
            return
        if self.n == M.SPANS and not (plain and self.plain):
            self.flush()
        self.n += not (plain and self.plain)
        self.plain = plain
        self.parts.append(text)
        self.kind = next((M.KINDS[t] for t in reversed(self.tags) if t in M.KINDS), "paragraph")

    def handle_starttag(self, tag, attrs):
        if tag in M.BLOCKS and self.shown:
            self.flush()
        self.plain = False
        if tag not in M.VOID:
            self.tags.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.plain = False

    def handle_endtag(self, tag):
        if tag in M.BLOCKS and self.shown:
            self.flush()
        self.plain = False
        if tag in self.tags:
            while self.tags.pop() != tag:
                pass

    def handle_data(self, data):
        self.add(data, True)

    def handle_entityref(self, name):
        self.add(html.unescape(f"&{name};"), False)

    def handle_charref(self, name):
        self.add(html.unescape(f"&#{name};"), False)


def standard(text):
    p = Standard()
    p.feed(text)
    p.close()
    p.flush()
    return p.out


def cut(text, spans):
    data = text.encode()
    return "".join(html.unescape(data[a:b].decode()) if d else data[a:b].decode() for a, b, d in spans)


PAGES = [
    "<h1>Ünï &amp; co</h1><p>a<b>b</b> c &#233;&#xe9; d<br>e</p> tail",
    "<ul><li>one<li>two <code>x &lt; y</code></ul><script>if (a < b) { '</p>' }</script><p>after</p>",
    "<div><style>p { }</style>shown<template><p>hidden</p></template> end</div>",
    "plain text only",
    "<p class='a > b' title=\"x<y\">quoted</p><img src=x alt='p'/><hr/>line<p/>still",
    "<table><caption>cap</caption><tr><th>h<td>1</table><pre> two\n lines </pre><!-- no <p> --><?pi x?><!DOCTYPE html>z",
    "<p>" + "a&amp;" * 100 + "</p>",
    "</p></div>closed<p></p><p> </p>",
]


@pytest.mark.parametrize("text", PAGES)
def test_blocks_equal_the_standard_parser(text):
    found, failure = M.blocks(text)
    assert failure is None and [(k, t) for k, t, _ in found] == standard(text)
    assert all(cut(text, spans) == t and len(spans) <= M.SPANS for _, t, spans in found)


def test_limits_are_told():
    assert M.blocks("<i>" * 300 + "x") == ([], "depth") and M.blocks("<br>" * 20, M.Limits(tokens=10)) == ([], "tokens")
    assert M.blocks("x" * 11, M.Limits(block_characters=10)) == ([], "block_characters") and M.blocks("<p>a<p>b<p>c", M.Limits(blocks=2)) == ([], "blocks")
    odd = "a < b &amp c &nosuch; &#0; <"
    assert [cut(odd, s) == t for _, t, s in M.blocks(odd)[0]] == [True]


def test_nulls_empties_and_repeated_keys(spark):
    rows = [(1, None), (1, ""), (None, "<p>x</p>é"), (1, "<p>y"), (1, "<p>y")]
    got = M.html_spans(spark.createDataFrame([(*r, "clash") for r in rows], "k int, page string, text string"), "k", "page").collect()
    assert sorted((r.k or 0, r.block_index, r.text, [tuple(s) for s in r.spans]) for r in got) == [(0, 0, "x", [(3, 4, False)]), (0, 1, "é", [(8, 10, False)]), (1, 0, "y", [(3, 4, False)]), (1, 0, "y", [(3, 4, False)])]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_all_pages(spark):
    from tracewell.plans.catalog import QUERIES

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()}
    got = {}
    for r in QUERIES["html_spans"](spark, SF).collect():
        assert r.failure is None and cut(pages[r.page_id], r.spans) == r.text
        got.setdefault(r.page_id, []).append((r.block_index, r.kind, r.text))
    assert {i: [x[1:] for x in sorted(own)] for i, own in got.items()} == {i: b for i, h in pages.items() if h and (b := standard(h))}
