"""Goal texts: clauses that ask for something, and instructions to the router, which are data and get masked."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sentences that try to steer routing.
DIRECTIVES = (
    r"(?i)\b(?:ignore|disregard|override)\b.{0,200}\b(?:route|routing|domain|pack|classif(?:y|ication))\b",
    r"(?i)\b(?:route|classify|select|enable)\b.{0,100}\b(?:domain|pack)\b",
    r"(?:忽略|无视).{0,100}(?:路由|领域|包)",
    r"(?:路由到|选择|启用).{0,60}(?:领域|包)",
)
#: One of ``.!?\n。！？;；``, told in a way that settles letters of most alphabets with one range.
_END = r"[.!?\n;\u3002-\uff1f&&[^\u3003-\uff00\uff02-\uff1a\uff1c-\uff1e]]"
#: A word without which no directive in Latin letters is one.
_STEERED = r"(?i)\b(?:rout|domain|pack|classif)"
_ASKS = r"(?i)\b(?:measure|compare|study|investigate|analy[sz]e|determine|find|collect|integrate|build|estimate)\b"


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it occurs in it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _directive(segment: Column) -> Column:
    """Whether a sentence steers. Most sentences meet one short pattern, those of ASCII alone none in other letters."""
    latin, other = ([segment.rlike(p) for p in DIRECTIVES if p.isascii() is plain] for plain in (True, False))
    return (segment.rlike(_STEERED) & (latin[0] | latin[1])) | ((F.octet_length(segment) > F.length(segment)) & (other[0] | other[1]))


def segments(text: Column) -> Column:
    """Sentences with their ends; joined they are the text again."""
    return F.split(text, f"(?<={_END})", -1)


def mask_directives(text: Column) -> Column:
    """The text with steering sentences blanked; every other character keeps its place."""
    blank = lambda s: F.regexp_replace(s, r"[^.!?\n。！？;；]", " ")
    return F.array_join(F.transform(segments(text), lambda s: F.when(_directive(s), blank(s)).otherwise(s)), "")


def questions(text: Column) -> Column:
    """The clauses that ask for research, or the first one."""
    clauses = F.filter(F.transform(F.split(text, _END, -1), lambda s: F.trim(s)), lambda s: s != "")
    chosen = lambda every: _bound(F.filter(every, lambda s: s.rlike(_ASKS)), lambda asked: F.when(F.size(asked) > 0, asked).otherwise(F.slice(every, 1, 1)))
    return _bound(clauses, chosen)


def years(text: Column) -> Column:
    """Years that a text names, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?=[12])\b(?:19|20)[0-9]{2}\b"), F.lit(0)), lambda y: y.cast("int"))))


#: What the extractors look for in a goal, by kind.
CLAUSE = r"[^?？;；.!。\n]+[?？;；.!。]?"
CLAUSE_ENDS = "?？;；.!。"
RESEARCH = r"(?i)研究|分析|比较|探索|测量|调查|提取|study|analy[sz]e|compare|investigate|measure|research"
VARIABLE = (
    r"(?i)光变曲线|溶解氧|pH\s*值?|光谱|红移|亮度|温度|质量|通量|速度|丰度|浓度|"
    r"light\s+curves?|dissolved\s+oxygen|spectra?|redshifts?|luminosit(?:y|ies)|"
    r"temperatures?|masses?|flux(?:es)?|velocit(?:y|ies)|abundances?|concentrations?"
)
COMPARISON = r"(?:[A-Za-z_][\w -]{0,32}|[一-鿿]{1,16})\s*(?:<=|>=|=|<|>|≤|≥)\s*[+-]?\d+(?:\.\d+)?(?:\s*[A-Za-z/%°一-鿿]+)?"
EXCLUSION = r"(?i)(?:不包括|排除|剔除|without|excluding|exclude)\s*[^,，;；.。?？]+"
CONDITION = r"(?i)(?:在|仅限于|under|where|subject\s+to)\s+[^,，;；.。?？]+"
TEMPORAL = r"(?i)(?:19|20)\d{2}(?:\s*(?:-|至|到|through|to)\s*(?:19|20)\d{2})?\s*年?|最近\s*\d*\s*年|recent|last\s+\d+\s+(?:days?|months?|years?)"
SPATIAL = r"(?i)(?:RA|Dec|latitude|longitude|赤经|赤纬|纬度|经度)\s*[:=]?\s*[^,，;；.。?？]+"
OUTPUT = r"(?i)\b(?:csv|parquet|json|notebook)\b"
DESIRE = r"(?i)(?:请帮我|帮我|我希望|我想|希望|please|I\s+(?:want|would\s+like)\s+to)\s*"
ENTITY_ENDS, ENTITY_LIMIT = r"(?i)\s+(?:under|where|within|from|between)\s+|在|仅限于", 200


#: What a match of each pattern begins with, in lower case: places that begin otherwise need no look.
STEMS = {
    "research": ("研究", "分析", "比较", "探索", "测量", "调查", "提取", "study", "analy", "compare", "investigate", "measure", "research"),
    "variable": ("光变曲线", "溶解氧", "ph", "光谱", "红移", "亮度", "温度", "质量", "通量", "速度", "丰度", "浓度", "light", "dissolved", "spectr", "redshift", "luminosit", "temperature", "mass", "flux", "velocit", "abundance", "concentration"),
    "exclusion": ("不包括", "排除", "剔除", "without", "exclud"),
    "observation": ("在", "仅限于", "under", "where", "subject"),
    "temporal": ("19", "20", "最近", "recent", "last"),
    "spatial": ("ra", "dec", "latitude", "longitude", "赤经", "赤纬", "纬度", "经度"),
    "output": ("csv", "parquet", "json", "notebook"),
}
#: A comparison's sign with its number, and how far before it the comparison may begin.
SIGN, REACH = re.compile(r"\s*(?:<=|>=|=|<|>|≤|≥)\s*[+-]?\d"), 33
#: Letters whose lower case is not what patterns that ignore case take them for.
ODD_CASE = "ſKİı"


class Goal:
    """Where a goal text says what: spans in code points, each of which is the words themselves."""

    def __init__(self):
        names = {"clause": CLAUSE, "research": RESEARCH, "variable": VARIABLE, "filter": COMPARISON, "exclusion": EXCLUSION, "observation": CONDITION, "temporal": TEMPORAL, "spatial": SPATIAL, "output": OUTPUT, "desire": DESIRE, "ends": ENTITY_ENDS}
        self.of = {n: re.compile(p) for n, p in names.items()}

    def found(self, name: str, text: str, low: str | None = None) -> Iterator[re.Match]:
        """The pattern's matches as ``finditer`` gives them, tried only where one can begin."""
        low = text.lower() if low is None else low
        if len(low) != len(text) or (not text.isascii() and any(c in text for c in ODD_CASE)):
            yield from self.of[name].finditer(text)
            return
        places = []
        for stem in STEMS[name]:
            at = low.find(stem)
            while at >= 0:
                places.append(at)
                at = low.find(stem, at + 1)
        end = 0
        for at in sorted(places):
            if at >= end and (m := self.of[name].match(text, at)):
                yield m
                end = m.end()

    def comparisons(self, text: str) -> Iterator[re.Match]:
        end = 0
        for sign in SIGN.finditer(text):
            for at in range(max(end, sign.start() - REACH), sign.end()):
                if m := self.of["filter"].match(text, at):
                    yield m
                    end = m.end()
                    break

    @staticmethod
    def trimmed(text: str, start: int, end: int, also: str = "") -> tuple[int, int]:
        """Without white space at either end, nor any of ``also`` at the end."""
        start += len(text[start:end]) - len(text[start:end].lstrip())
        kept = text[start:end].rstrip()
        if also:
            kept = kept.rstrip(also).rstrip()
        return start, start + len(kept)

    def units(self, text: str) -> list[tuple[int, int]]:
        """Clauses that ask for research; without one the first clause, without any the text."""
        clauses = [self.trimmed(text, *m.span(), CLAUSE_ENDS) for m in self.of["clause"].finditer(text)]
        clauses = [(a, b) for a, b in clauses if a < b]
        asked = [m.span() for m in self.found("research", text)]
        first = [bisect.bisect_left(asked, (a, a)) for a, _ in clauses]
        asking = [(a, b) for (a, b), i in zip(clauses, first, strict=True) if i < len(asked) and asked[i][1] <= b]
        if asking or clauses:
            return asking or clauses[:1]
        a, b = self.trimmed(text, 0, len(text), CLAUSE_ENDS)
        return [(a, b) if a < b else self.trimmed(text, 0, len(text))]

    def entities(self, text: str, units: list[tuple[int, int]], variables: list[int]) -> list[tuple[int, int]]:
        """What stands between the word that asks and the first variable of a unit, cut where a condition begins."""
        out, seen = [], set()
        for a, b in units:
            stop = next((v for v in variables if a < v < b), None)
            asked = [a + m.end() for m in self.found("research", text[a:b])]
            if not asked and stop is None:
                continue
            wish = self.of["desire"].match(text[a:b])
            first = max((x for x in asked if stop is None or x <= stop), default=a) if asked else a + (wish.end() if wish else 0)
            start, end = self.trimmed(text, first, b if stop is None else stop)
            while start < end and text[end - 1] in "的:'\"":
                start, end = self.trimmed(text, start, end - 1)
            named = self.of["ends"].split(text[start:end], maxsplit=1)[0].rstrip()
            if named and len(named) <= ENTITY_LIMIT and named.casefold() not in seen:
                seen.add(named.casefold())
                out.append((start, start + len(named)))
        return out

    def spans(self, text: str) -> list[tuple[str, int, int, str | None]]:
        """(kind, start, end, detail); a condition's detail says which it is, an output's is the format."""
        units = self.units(text)
        low = text.lower()
        variables = [m.span() for m in self.found("variable", text, low)]
        told = {"filter": self.comparisons(text)} | {kind: self.found(kind, text, low) for kind in ("exclusion", "observation")}
        conditions = sorted({(*m.span(), kind) for kind, own in told.items() for m in own}, key=lambda c: (c[0], c[1], ("exclusion", "filter", "observation").index(c[2])))
        out = [("unit", a, b, None) for a, b in units]
        out += [("entity", a, b, None) for a, b in self.entities(text, units, [a for a, _ in variables])]
        out += [("variable", a, b, None) for a, b in variables]
        out += [("condition", *self.trimmed(text, a, b), kind) for a, b, kind in conditions]
        for kind in ("temporal", "spatial"):
            if first := next(self.found(kind, text, low), None):
                out.append((kind, *self.trimmed(text, *first.span()), None))
        out += [("output", *m.span(), m.group().lower()) for m in self.found("output", text, low)]
        return out


def goal_spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind, start, end, span and detail of what each whole text asks for: unit, entity, variable, condition, temporal,
    spatial and output. Every span is a piece of the text, so nothing is inferred or converted. Null texts have none, an
    empty text has one empty unit; rows may share a key."""
    fields = [("kind", T.StringType()), ("start", T.LongType()), ("end", T.LongType()), ("span", T.StringType()), ("detail", T.StringType())]
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(n, t) for n, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        goal = Goal()
        for batch in batches:
            at, rows = [], []
            for row, value in enumerate(batch.column(1).to_pylist()):
                for kind, start, end, detail in goal.spans(value) if value is not None else ():
                    at.append(row)
                    rows.append((kind, start, end, value[start:end], detail))
            columns = list(zip(*rows)) if rows else [[]] * len(fields)
            arrow = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, arrow, strict=True))], names=schema.names)

    return df.select(df[key], df[text].cast("string")).mapInArrow(run, schema)
