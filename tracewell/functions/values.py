"""Kinds, decimals, dates, ids and hashes of values that stay text."""

from __future__ import annotations

import json
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PLAIN = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"


def kind(text: Column) -> Column:
    """empty, boolean, integer, decimal or text: a label, the value is not changed."""
    bare = F.trim(text)
    return (
        F.when(bare == "", "empty")
        .when(F.lower(bare).isin("true", "false"), "boolean_candidate")
        .when(bare.rlike("^[+-]?[0-9]+$"), "integer_candidate")
        .when(bare.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), "decimal_candidate")
        .otherwise("text")
    )


def fits_type(kind_: Column, declared: Column) -> Column:
    """May a cell of this kind be a value of the declared type?"""
    return (
        F.when(kind_ == "empty", False)
        .when(declared.isin("string", "datetime"), True)
        .when(declared == "integer", kind_ == "integer_candidate")
        .when(declared == "number", kind_.isin("integer_candidate", "decimal_candidate"))
        .when(declared == "boolean", kind_ == "boolean_candidate")
        .otherwise(False)
    )


def decimal_places(text: Column) -> Column:
    """Digits after the point of a plain lexeme, null for others."""
    return F.when(F.trim(text).rlike(PLAIN), F.length(F.regexp_extract(F.trim(text), r"\.([0-9]*)$", 1)))


def significant_digits(text: Column) -> Column:
    digits = F.regexp_replace(F.regexp_replace(F.trim(text), "[^0-9]", ""), "^0+", "")
    return F.when(F.trim(text).rlike(PLAIN), F.greatest(F.length(digits), F.lit(1)))


def shift_decimal(text: Column, minus: str) -> Column:
    """``text`` less a constant, exactly, with as many places as either has; null for what is no plain decimal."""
    places = F.greatest(decimal_places(text), F.lit(len(minus.partition(".")[2])))
    wide = F.expr("cast(null as decimal(38,12))")
    value = F.when(F.trim(text).rlike(PLAIN), F.trim(text).try_cast("decimal(38,12)")).otherwise(wide) - F.lit(minus).cast("decimal(38,12)")
    shown = value.cast("decimal(38,12)").cast("string")
    return F.when(places == 0, F.substring_index(shown, ".", 1)).otherwise(F.left(shown, F.length(shown) - 12 + F.least(places, F.lit(12))))


@F.pandas_udf(StringType())
def decimal_text(values: pd.Series) -> pd.Series:
    """Any finite decimal lexeme, exponents too, in fixed-point text; null for others."""

    def one(v):
        try:
            d = Decimal(v.strip())
        except (InvalidOperation, AttributeError):
            return None
        return format(d, "f") if d.is_finite() else None

    return values.map(one)


@F.pandas_udf(StringType())
def canonical_json(values: pd.Series) -> pd.Series:
    """JSON text with sorted keys, no spaces and ASCII escapes; null for what is no JSON or holds NaN."""

    def one(v):
        def refuse(_):
            raise ValueError

        try:
            return None if v is None else json.dumps(json.loads(v, parse_constant=refuse), sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)
        except ValueError:
            return None

    return values.map(one)


def canonical_hash(text: Column) -> Column:
    return F.sha2(canonical_json(text), 256)


def stable_id(prefix: str, *parts: Column, digits: int = 16) -> Column:
    """prefix and the first hexadecimal digits of SHA-256 over the parts, nulls as empty."""
    joined = F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.left(F.sha2(joined, 256), F.lit(digits)))


def iso_date(text: Column) -> Column:
    """A date, or null for what is none."""
    return F.try_to_date(F.trim(text), "yyyy-MM-dd")


def date_parts(parts: Column) -> Column:
    """[year, month, day] as a date; a year and month alone are not completed."""
    return F.when(F.size(parts) == 3, F.try_to_date(F.concat_ws("-", F.transform(parts, lambda p: F.when(p < 10, F.concat(F.lit("0"), p.cast("string"))).otherwise(p.cast("string")))), "yyyy-MM-dd"))


def utc(text: Column) -> Column:
    """A timestamp from text with an offset; text without one is refused (null)."""
    return F.when(text.rlike(r"(?:Z|[+-][0-9]{2}:?[0-9]{2})$"), text.try_cast("timestamp"))


def backoff(attempt: Column, base: float, cap: float, jitter: Column | None = None, ratio: float = 0.0, retry_after: Column | None = None) -> Column:
    """Seconds before the next attempt: what the server asked for, if it named a number, else twice as long each time,
    spread by ``ratio`` (jitter: 0 to 1); never more than ``cap`` or less than 0."""
    delay = F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt - 1))
    if jitter is not None:
        spread = F.least(F.greatest(jitter, F.lit(0.0)), F.lit(1.0))
        delay = F.least(F.lit(cap), F.greatest(F.lit(0.0), delay * (1 + F.lit(ratio) * (2 * spread - 1))))
    if retry_after is not None:
        asked = F.trim(retry_after).try_cast("double")
        delay = F.when(asked.isNotNull() & ~F.isnan(asked), F.least(F.lit(cap), F.greatest(F.lit(0.0), asked))).otherwise(delay)
    return delay


def confidence(score: Column, votes: Column) -> Column:
    """Calibrated from a rule score and its number of votes."""
    return F.round(F.least(F.lit(0.99), F.lit(0.2) + F.lit(0.22) * score + F.lit(0.08) * F.least(votes, F.lit(3))), 6)


def axis(pixel: Column, first_pixel: float, first_value: float, second_pixel: float, second_value: float, log: bool = False) -> Column:
    """The value at a pixel by two anchors of a linear or base-10 logarithmic axis."""
    import math

    if log and min(first_value, second_value) <= 0:
        raise ValueError("a logarithmic axis needs positive anchors")
    a, b = (math.log10(first_value), math.log10(second_value)) if log else (first_value, second_value)
    value = F.lit(a) + (pixel - first_pixel) * ((b - a) / (second_pixel - first_pixel))
    return F.pow(F.lit(10.0), value) if log else value


def spread(pixel: Column, radius: Column, **anchors) -> Column:
    """The largest change of the value within a radius around a pixel."""
    mid = axis(pixel, **anchors)
    return F.greatest(F.abs(axis(pixel + radius, **anchors) - mid), F.abs(axis(pixel - radius, **anchors) - mid))
