"""Language identification in two steps: the language family first, then the language within it.

Both steps are linear support vector machines on hashed byte n-grams of the whole text: one for each family against the
others, then one for each pair of languages of a family. A label that no family lists is a family of its own, so the
number of machines grows with the labels, not with their square. Training rows are a bounded sample of the labelled ones
(``PER_LANGUAGE`` of each language at most and ``ROWS`` in all, about, chosen by a hash of the key), each as a whole and as
two short excerpts, so that short texts are known too; with more labels than ``ROWS`` some go unlearned. Prediction sees
every byte of every text and nothing but the text.

Nulls and edge cases: a null text, or one without any letter, is ``und`` with score 0. Rows without label are not
learned from. With one learned language every text with letters is given it, with none every text is ``und``. A key
that is null counts as the empty text where folds are made. Keys may repeat. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.arrowkit import LOWER, buffers, chunks

#: Labelled rows of each language, and in all, that are learned from, at most.
PER_LANGUAGE, ROWS = 400, 4000
#: Labels up to which their counts are broadcast.
BROADCAST_LABELS = 20_000
#: Hash buckets of n-grams.
SIZE = 4096
#: Documents whose features stand in memory at a time (32 KB each).
DOCUMENTS = 256
#: Bytes of the two excerpts of each training row.
EXCERPTS = (40, 160)
UNKNOWN = "und"

#: Families of languages by ISO 639-1 code. A label that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en is nl nb nn no sv",
    "romance": "ca es fr gl it pt ro",
    "slavic": "be bg cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk tr uz",
    "semitic": "ar he mt",
    "indic": "bn hi mr ne pa ur",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True
_ASCII_LETTER = _LETTER.copy()
_ASCII_LETTER[0x80:] = False
_FOLD = np.where(_LETTER[LOWER], LOWER, ord(" ")).astype(np.uint8)


def held_out(key: Column) -> Column:
    """The fold that is never learned from: CRC-32 of the key as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 0


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[documents, SIZE]: square roots of counts of hashed 1-, 2- and 3-byte runs that hold a letter, to length 1."""
    docs, n = len(offsets) - 1, len(data)
    total = np.zeros(docs * SIZE, np.float64)
    text = _FOLD[data].astype(np.uint32)
    doc = np.repeat(np.arange(docs, dtype=np.int64) * SIZE, np.diff(offsets))
    code = np.zeros(n, np.uint32)
    for size in (1, 2, 3):
        if n < size:
            break
        code = (code[: n - size + 1] << np.uint32(8)) | text[size - 1 :]
        own = doc[: n - size + 1]
        whole = (own == doc[size - 1 :]) & (code != np.uint32(int.from_bytes(b" " * size, "big")))
        mixed = (code + np.uint32(size)) * np.uint32(0x9E3779B1)
        total += np.bincount(own[whole] + (mixed[whole] >> np.uint32(20)).astype(np.int64), minlength=docs * SIZE)
    table = np.sqrt(total.reshape(docs, SIZE)).astype(np.float32)
    return table / np.maximum(np.sqrt((table * table).sum(axis=1, keepdims=True)), 1e-9)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per document, in Unicode's sense; only texts without ASCII letters are decoded."""
    ascii_before = np.concatenate([[0], np.cumsum(_ASCII_LETTER[LOWER[data]])])
    out = ascii_before[offsets[1:]] > ascii_before[offsets[:-1]]
    for d in np.flatnonzero(~out):
        own = data[offsets[d] : offsets[d + 1]]
        out[d] = len(own) > 0 and own.max() >= 0x80 and any(map(str.isalpha, own.tobytes().decode("utf-8", "replace")))
    return out


def fit_pair(x: np.ndarray, y: np.ndarray, c: float = 20.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """A linear SVM (squared hinge, L2) by accelerated gradient descent from 0; y is 1 or -1."""
    n = len(x)
    weight = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum()))).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    v, vb = w.copy(), b
    step = 1.0 / (1.0 + 4.0 * c * float(weight.max()))  # rows have length 1, and 1 for the intercept
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v + vb)) * weight * y
        grad, grad_b = v - (2 * c / n) * (slack @ x), -(2 * c / n) * float(slack.sum())
        w_next, b_next = v - step * grad, vb - step * grad_b
        move = t / (t + 3)
        v, vb = w_next + move * (w_next - w), b_next + move * (b_next - b)
        w, b = w_next, b_next
    return w, b


def fit_rest(x: np.ndarray, own: np.ndarray, classes: int, c: float = 20.0, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """For each class the machine of ``fit_pair`` against all other rows; own: the class of each row. One matrix product
    serves all classes."""
    n = len(x)
    y = np.full((n, classes), -1, np.float32)
    y[np.arange(n), own] = 1
    size = np.bincount(own, minlength=classes).astype(np.float32)
    weight = np.where(y > 0, n / (2 * size), n / (2 * (n - size))).astype(np.float32)
    step = 1.0 / (1.0 + 4.0 * c * weight.max(axis=0))
    w, b = np.zeros((x.shape[1], classes), np.float32), np.zeros(classes, np.float32)
    v, vb = w.copy(), b.copy()
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v + vb)) * weight * y
        w_next = v - step * (v - (2 * c / n) * (x.T @ slack))
        b_next = vb + step * (2 * c / n) * slack.sum(axis=0)
        move = t / (t + 3)
        v, vb = w_next + move * (w_next - w), b_next + move * (b_next - b)
        w, b = w_next, b_next
    return np.ascontiguousarray(w.T), b.astype(np.float64)


@dataclass
class Machines:
    """Machines among classes: one for each pair, or one for each class against the rest."""

    classes: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, SIZE), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rest: bool = False

    @staticmethod
    def fit(x: np.ndarray, labels: np.ndarray) -> Machines:
        classes = sorted(set(labels.tolist()))
        fitted = []
        for a, b in combinations(classes, 2):
            rows = (labels == a) | (labels == b)
            fitted.append(fit_pair(x[rows].astype(np.float32), np.where(labels[rows] == a, 1.0, -1.0).astype(np.float32)))
        if not fitted:
            return Machines(classes)
        return Machines(classes, np.stack([w for w, _ in fitted]), np.array([b for _, b in fitted]))

    @staticmethod
    def against_rest(x: np.ndarray, labels: np.ndarray) -> Machines:
        """One machine for each class, all fitted together; two classes need but one."""
        classes = sorted(set(labels.tolist()))
        if len(classes) <= 2:
            return Machines.fit(x, labels)
        own = np.searchsorted(np.array(classes, object), labels)
        weights, bias = fit_rest(x.astype(np.float32), own, len(classes))
        return Machines(classes, weights, bias, True)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the class with most duels won (ties: by summed margins), and how sure, 0.5 to 1, its duels are; or of
        the class that stands out most from the rest, and how sure, 0 to 1, its machine is."""
        if len(self.classes) == 1:
            return np.zeros(len(x), int), np.ones(len(x))
        margins = x @ self.weights.T + self.bias
        if self.rest:
            best = margins.argmax(axis=1)
            return best, 1 / (1 + np.exp(-3 * margins[np.arange(len(x)), best]))
        votes, sure = np.zeros((len(x), len(self.classes))), np.ones((len(x), len(self.classes)))
        for i, (a, b) in enumerate(combinations(range(len(self.classes)), 2)):
            p = 1 / (1 + np.exp(-3 * margins[:, i]))
            votes[:, a] += (p >= 0.5) + 1e-3 * p
            votes[:, b] += (p < 0.5) + 1e-3 * (1 - p)
            sure[:, a], sure[:, b] = np.minimum(sure[:, a], p), np.minimum(sure[:, b], 1 - p)
        best = votes.argmax(axis=1)
        return best, sure[np.arange(len(x)), best]


@dataclass
class LanguageModel:
    families: Machines
    languages: dict[str, Machines]

    @staticmethod
    def fit(x: np.ndarray, labels: list[str]) -> LanguageModel | None:
        if not labels:
            return None
        labels = np.array(labels, object)
        families = np.array([FAMILY.get(code, code) for code in labels], object)
        return LanguageModel(Machines.against_rest(x, families), {f: Machines.fit(x[families == f], labels[families == f]) for f in sorted(set(families))})

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        family, score = self.families.predict(x)
        out = np.empty(len(x), object)
        for f, name in enumerate(self.families.classes):
            rows = np.flatnonzero(family == f)
            if len(rows):
                own = self.languages[name]
                best, sure = own.predict(x[rows])
                out[rows] = np.array(own.classes, object)[best]
                score[rows] = score[rows] * sure
        return out, score


def train(df: DataFrame, text: str, label: str, key: str, per_language: int = PER_LANGUAGE) -> LanguageModel | None:
    """Fits on at most about ``per_language`` rows of each label; ``df`` must hold none that are to be held out."""
    rows = df.where(df[label].isNotNull() & df[text].isNotNull())
    rows = rows.select(rows[label].cast("string").alias("label"), rows[text].cast("string").alias("text"), F.coalesce(rows[key].cast("string"), F.lit("")).alias("key"))
    counts = rows.groupBy("label").count()
    labels = counts.count()
    if not labels:
        return None
    counts = F.broadcast(counts) if labels <= BROADCAST_LABELS else counts
    # about as many rows of each label as asked for, taken by a hash of key and text: nothing is sorted or gathered
    share = F.least(F.lit(1.0), F.lit(min(float(per_language), ROWS / labels)) / F.col("count"))
    draw = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 20)) < share * (1 << 20)
    sample = rows.join(counts, "label").where(draw).select("label", "text")
    sample = sample.distinct()  # rows that agree in key and text are drawn together and teach nothing twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for first, last, part, own in chunks(data, offsets, most=DOCUMENTS):
                label = batch.column(0).slice(first, last - first)
                half = (own[1:] - own[:-1]) // 2
                views = [part[own[i] + half[i] : own[i] + half[i] + n] if n else part[own[i] : own[i + 1]] for n in (0, *EXCERPTS) for i in range(last - first)]
                ends = np.concatenate([[0], np.cumsum([len(v) for v in views])]).astype(np.int64)
                x = features(np.concatenate(views), ends)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([label] * (1 + len(EXCERPTS))), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], names=["label", "x"])

    got = sample.mapInArrow(run, "label string, x binary").collect()
    got.sort(key=lambda r: (r.label, bytes(r.x)))
    # half precision here, as it came; each machine takes its own rows in single precision, one copy at a time
    x = np.stack([np.frombuffer(r.x, np.float16) for r in got]) if got else np.zeros((0, SIZE), np.float16)
    labels = [r.label for r in got]
    del got
    return LanguageModel.fit(x, labels)


def judge(data: np.ndarray, offsets: np.ndarray, model: LanguageModel | None) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each document of a chunk."""
    docs = len(offsets) - 1
    code, score = np.full(docs, UNKNOWN, object), np.zeros(docs)
    known = has_letter(data, offsets) if model is not None else np.zeros(docs, bool)
    if known.any():
        code[known], score[known] = model.predict(features(data, offsets)[known])
    return code, score


def predict(df: DataFrame, key: str, text: str, model: LanguageModel | None) -> DataFrame:
    """key, lang_pred and score of every row."""
    rows = df.select(df[key].alias(key), df[text].cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for first, last, part, own in chunks(data, offsets, most=DOCUMENTS):
                code, score = judge(part, own, model)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(code.tolist(), pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], names=[key, "lang_pred", "score"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, lang_pred string, score double")


def with_language(df: DataFrame, text: str, model: LanguageModel | None, to: str = "lang_pred") -> DataFrame:
    """``df`` with the predicted language in a further column."""
    schema = T.StructType([*df.schema.fields, T.StructField(to, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(text))
            for first, last, part, own in chunks(data, offsets, most=DOCUMENTS):
                code, _ = judge(part, own, model)
                rows = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(code.tolist(), pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def identify(df: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """Learns from the rows outside the held-out fold, then predicts every row: key, held_out, lang_pred, score."""
    model = train(df.where(~held_out(df[key])), text, label, key)
    return predict(df, key, text, model).select(key, held_out(F.col(key)).alias("held_out"), "lang_pred", "score")
