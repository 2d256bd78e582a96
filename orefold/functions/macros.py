"""Scalar helpers of contracted models, all built from Spark's own functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPERATORS = {
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b,
    "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b,
}


def clean_sentinel(c: Column, sentinels: Sequence[str]) -> Column:
    """Null where the value is one of the sentinels."""
    return reduce(lambda x, s: F.nullif(x, F.lit(s)), sentinels, c)


def normalize_key(c: Column) -> Column:
    return F.nullif(F.upper(F.trim(c)), F.lit(""))


def source_label(c: Column) -> Column:
    return F.trim(c)


def safe_cast(c: Column, kind: str) -> Column:
    return c.try_cast(kind)


def staged(c: Column, kind: str) -> Column:
    """Staging cleanup: strings trimmed with blanks as null, others cast."""
    return F.nullif(F.trim(c.cast("string")), F.lit("")) if kind == "string" else c.cast(kind)


def json_value(c: Column, path: str) -> Column:
    return F.get_json_object(c, path)


def json_array_len(c: Column) -> Column:
    return F.size(F.from_json(c, "array<string>")).cast("int")


def enum_label(c: Column, labels: Mapping[object, str]) -> Column:
    """The label of a code, or ``Unknown (code)``; null stays null."""
    text = c.cast("string")
    value = F.lit(None).cast("string")
    first = True
    for code, label in labels.items():
        test = text == F.lit(str(code))
        value = F.when(test, F.lit(label)) if first else value.when(test, F.lit(label))
        first = False
    other = F.concat(F.lit("Unknown ("), text, F.lit(")"))
    return other if first else value.otherwise(other)


def null_safe_differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def newer(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Lexicographically greater; as in SQL, null beats nothing and is beaten by nothing."""
    terms = []
    for k in range(len(left)):
        equal = [left[i] == right[i] for i in range(k)]
        terms.append(reduce(lambda a, b: a & b, [*equal, left[k] > right[k]]))
    return reduce(lambda a, b: a | b, terms)


def lookback_floor(c: Column, amount: int, unit: str) -> Column:
    """A timestamp some hours or days earlier; other units and amounts below one are errors."""
    if unit not in ("hours", "days") or amount < 1:
        raise ValueError("a lookback is a positive number of hours or days")
    return c - F.make_interval(days=F.lit(amount if unit == "days" else 0), hours=F.lit(amount if unit == "hours" else 0))


def date_spine(spark: SparkSession, start: str, days: int) -> DataFrame:
    return spark.range(days).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("date_day"))
