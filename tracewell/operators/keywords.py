"""Terms of a rule book in texts: an automaton over all terms reads each text once and keeps exact spans.

Texts and terms are compared in NFKC and full case folding. A term that begins or ends with an ASCII letter or digit must
not stand against another word character there; other terms match anywhere. A rule book of any size is taken in parts of
``TERMS`` terms, each of which becomes one automaton that tasks build once for each Python worker.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.text import fold, normalize_query, normalize_title, query_language
from tracewell.functions.values import confidence

#: Terms in one automaton: some ten megabytes in each Python worker.
TERMS = 50_000
#: When the best domain is certain, and when others stand beside it.
CERTAIN, BESIDE_LEAST, BESIDE_SHARE, NO_DOMAIN = 0.65, 0.7, 0.45, ("generic", 0.25)


def folded(text: str) -> str:
    """NFKC and full case folding; ASCII text needs no look at Unicode's tables."""
    return text.casefold() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Automaton:
    """All given terms; without the package for it, one search for each term."""

    def __init__(self, terms: list[str]):
        self.terms = [(t, t[0].isascii() and t[0].isalnum(), t[-1].isascii() and t[-1].isalnum()) for t in terms]
        try:
            import ahocorasick
        except ModuleNotFoundError:
            self.tree = None
            return
        self.tree = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            self.tree.add_word(t, i)
        self.tree.make_automaton()

    def _places(self, text: str) -> Iterator[tuple[int, int]]:
        if self.tree is not None:
            yield from ((i, end + 1 - len(self.terms[i][0])) for end, i in self.tree.iter(text))
            return
        for i, (term, _, _) in enumerate(self.terms):
            at = text.find(term)
            while at >= 0:
                yield i, at
                at = text.find(term, at + 1)

    def first(self, text: str) -> dict[int, tuple[int, int, int]]:
        """Of each term in a folded text: first start, end, and how many matches that do not overlap."""
        found: dict[int, list[int]] = {}
        for i, start in self._places(text):
            term, before, after = self.terms[i]
            end = start + len(term)
            if (before and start and _is_word(text[start - 1])) or (after and end < len(text) and _is_word(text[end])):
                continue
            own = found.get(i)
            if own is None:
                found[i] = [start, end, 1, end]
            elif start >= own[3]:
                own[2], own[3] = own[2] + 1, end
        return {i: (a, b, n) for i, (a, b, n, _) in found.items()}


_automata: dict[bytes, Automaton] = {}


def _automaton(terms: list[str]) -> Automaton:
    name = hashlib.sha256("\0".join(terms).encode()).digest()
    if name not in _automata:
        _automata.clear()  # one rule book at a time
        _automata[name] = Automaton(terms)
    return _automata[name]


def find_terms(df: DataFrame, key: str, text: str, rules: DataFrame, size: int = TERMS) -> DataFrame:
    """key, pack, term, weight, first start and end (code points of the folded text), the text there, and the number of
    matches, for each rule (pack, term, weight) whose term stands in the text. A rule that is given twice counts twice;
    terms of white space alone or none, and null texts, match nothing."""
    rules = rules.where(F.trim("term") != "").select("pack", "term", F.col("weight").cast("double").alias("weight"), fold(F.col("term")).alias("folded"))
    parts = max(1, -(-rules.count() // size))
    out = None
    for n in range(parts):
        own = rules.where(F.pmod(F.xxhash64("folded"), F.lit(parts)) == n).orderBy("folded", "pack", "term", "weight").collect()  # about ``size`` rows
        found = _find(df, key, text, own)
        out = found if out is None else out.unionByName(found)
    return out


def _find(df: DataFrame, key: str, text: str, rules: list) -> DataFrame:
    terms = list(dict.fromkeys(r.folded for r in rules))
    place = {t: i for i, t in enumerate(terms)}
    having: list[list[tuple]] = [[] for _ in terms]
    for r in rules:
        having[place[r.folded]].append((r.pack, r.term, r.weight))
    fields = [("pack", T.StringType()), ("term", T.StringType()), ("weight", T.DoubleType()), ("start", T.LongType()), ("end", T.LongType()), ("matched_text", T.StringType()), ("matches", T.LongType())]
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(n, t) for n, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(terms)
        for batch in batches:
            at, rows = [], []
            for row, value in enumerate(batch.column(1).to_pylist()):
                if value is None or not terms:
                    continue
                low = folded(value)
                for i, (start, end, n) in automaton.first(low).items():
                    for p, term, weight in having[i]:
                        at.append(row)
                        rows.append((p, term, weight, start, end, low[start:end], n))
            columns = list(zip(*rows)) if rows else [[]] * len(fields)
            arrow = [pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, arrow, strict=True))], names=schema.names)

    return df.select(df[key], df[text].cast("string")).mapInArrow(run, schema)


def scores(found: DataFrame, key: str) -> DataFrame:
    """key, pack, score, votes and confidence: each rule that matches votes once with its weight."""
    summed = found.groupBy(key, "pack").agg(F.round(F.sum("weight"), 6).alias("score"), F.count(F.lit(1)).alias("votes"))
    return summed.select("*", confidence(F.col("score"), F.col("votes")).alias("confidence"))


def profiles(df: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    """key, primary, secondary (in order), confidence and provisional of each row of ``df``: the pack of the highest
    score (of equal ones the first by name), those near it, and the general one where no rule matched."""
    low = F.struct((-F.col("score")).alias("s"), F.col("pack").alias("pack"), F.col("confidence").alias("confidence"))
    ranked = scored.where("score > 0").groupBy(key).agg(F.array_sort(F.collect_list(low)).alias("r"))
    best = F.col("r")[0]
    near = F.filter(F.slice("r", 2, 1 << 30), lambda x: (-x["s"] >= BESIDE_LEAST) & (-x["s"] >= -best["s"] * BESIDE_SHARE))
    profiled = ranked.select(key, best["pack"].alias("primary"), F.transform(near, lambda x: x["pack"]).alias("secondary"), best["confidence"].alias("confidence"))
    every = df.select(key).join(profiled, key, "left")
    return every.select(
        key,
        F.coalesce("primary", F.lit(NO_DOMAIN[0])).alias("primary"),
        F.coalesce("secondary", F.array().cast("array<string>")).alias("secondary"),
        F.coalesce("confidence", F.lit(NO_DOMAIN[1])).alias("confidence"),
        (F.coalesce("confidence", F.lit(NO_DOMAIN[1])) < CERTAIN).alias("provisional"),
    )


def concept_matches(concepts: DataFrame, terms: DataFrame) -> DataFrame:
    """(concept_id, expansion_id), once each, of concepts (concept_id, term) and expansion terms (expansion_id, term) of
    which one contains the other, both normalized.

    Terms inside concepts are found by the automaton. Concepts inside terms are found by equality with the parts of
    terms, since the rule book's terms are short: no concept is compared with every term."""
    keyed = concepts.select("concept_id", normalize_query(F.col("term")).alias("_key")).where("_key <> ''")
    named = terms.select("expansion_id", normalize_query(F.col("term")).alias("_key")).where("_key <> ''").distinct()
    numbered = named.select(F.col("expansion_id").cast("string").alias("pack"), F.col("_key").alias("term"), F.lit(1.0).alias("weight"))
    inside = _inside(keyed, numbered).select("concept_id", F.col("pack").cast(dict(terms.dtypes)["expansion_id"]).alias("expansion_id"))
    size = F.length("_key")
    starts = F.explode(F.sequence(F.lit(1), size)).alias("_from")
    cut = named.select("expansion_id", "_key", starts).select("expansion_id", "_key", "_from", F.explode(F.sequence(F.lit(1), size - F.col("_from") + 1)).alias("_size"))
    cut = cut.select("expansion_id", F.substring("_key", F.col("_from"), F.col("_size")).alias("_key")).distinct()
    around = keyed.join(cut, "_key").select("concept_id", "expansion_id")
    return inside.unionByName(around).distinct()


def _inside(keyed: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules whose term is anywhere in the key, in the middle of words too."""
    parts = max(1, -(-rules.count() // TERMS))
    out = None
    for n in range(parts):
        own = rules.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == n).collect()
        terms = sorted({r.term for r in own})
        packs: dict[str, list[str]] = {}
        for r in own:
            packs.setdefault(r.term, []).append(r.pack)

        def run(batches: Iterator[pa.RecordBatch], terms: list[str] = terms, packs: dict[str, list[str]] = packs) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(terms)
            for batch in batches:
                at, names = [], []
                for row, value in enumerate(batch.column(1).to_pylist()):
                    hit = {p for i, _ in automaton._places(value) for p in packs[terms[i]]} if terms else ()
                    at += [row] * len(hit)
                    names += hit
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string())], names=["concept_id", "pack"])

        found = keyed.mapInArrow(run, T.StructType([keyed.schema["concept_id"], T.StructField("pack", T.StringType())]))
        out = found if out is None else out.unionByName(found)
    return out


def expanded_queries(concepts: DataFrame, expansions: DataFrame, hints: DataFrame, domains: Column | list[str]) -> DataFrame:
    """task, language, text and terms: the queries of each task's concepts, expanded by a rule book.

    concepts: task, concept_id, position, term. expansions: expansion_id, position, domains, terms (array of language and
    term). hints: task, position, language, text. An expansion of one of the wanted domains that matches a concept gives all its
    terms, in the rule book's order; concepts without one give themselves, in theirs. Equal normalized texts count once,
    the first spelling stays. A query's text is its terms and then its language's hints and those of no language (und)."""
    wanted = F.array(*(F.lit(d.lower()) for d in domains)) if isinstance(domains, list) else domains
    own = expansions.where(F.arrays_overlap(F.transform("domains", F.lower), wanted))
    terms = own.select("expansion_id", F.posexplode("terms").alias("_i", "_t")).select("expansion_id", F.col("_t.term").alias("term"))
    met = concept_matches(concepts.select("concept_id", "term").distinct(), terms)
    met = concepts.select("task", "concept_id").distinct().join(met, "concept_id")
    given = met.select("task", "expansion_id").distinct().join(own.select("expansion_id", "position", F.posexplode("terms").alias("_i", "_t")), "expansion_id")
    spoken = given.select("task", F.col("_t.language").alias("language"), F.struct(F.lit(0).alias("a"), F.col("position").cast("long").alias("b"), F.col("_i").alias("c")).alias("order"), F.col("_t.term").alias("shown"))
    alone = concepts.join(met.select("task", "concept_id").distinct(), ["task", "concept_id"], "left_anti")
    spoken = spoken.unionByName(alone.select("task", query_language(F.col("term")).alias("language"), F.struct(F.lit(1).alias("a"), F.col("position").cast("long").alias("b"), F.lit(0).alias("c")).alias("order"), F.col("term").alias("shown")))
    spoken = _once(spoken, ["task", "language"])
    languages = spoken.select("task", "language").distinct()
    order = lambda a: F.struct(F.lit(a).alias("a"), F.col("position").cast("long").alias("b"), F.lit(0).alias("c")).alias("order")
    said = hints.where("language <> 'und'").select("task", "language", order(2), F.col("text").alias("shown"))
    said = said.unionByName(languages.join(hints.where("language = 'und'").select("task", order(3), F.col("text").alias("shown")), "task").select("task", "language", "order", "shown"))
    # hints of a language without terms make no query
    every = _once(spoken.select("task", "language", "order", "shown").unionByName(said.join(languages, ["task", "language"], "left_semi")), ["task", "language"])
    listed = every.groupBy("task", "language").agg(F.array_sort(F.collect_list(F.struct("order", "shown"))).alias("l"))
    words = F.transform("l", lambda x: x["shown"])
    own_terms = F.transform(F.filter("l", lambda x: x["order"]["a"] < 2), lambda x: x["shown"])
    return listed.select("task", "language", F.array_join(words, " ").alias("text"), own_terms.alias("terms"))


def _once(rows: DataFrame, group: list[str]) -> DataFrame:
    """The first spelling of each normalized text in a group; empty ones go."""
    shown = rows.withColumn("shown", normalize_title(F.col("shown"))).withColumn("_key", normalize_query(F.col("shown"))).where("_key <> ''")
    return shown.groupBy(*group, "_key").agg(F.min("order").alias("order"), F.min_by("shown", "order").alias("shown")).drop("_key")

