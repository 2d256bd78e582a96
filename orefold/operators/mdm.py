"""Matching and survivorship of master records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.macros import normalize_key


def match(a: DataFrame, b: DataFrame, key: str, attribute: str, comparator: str, block: Column | None = None, threshold: float = 1.0) -> DataFrame:
    """Pairs ``left_key, right_key, score``; exact and normalized are equality joins, fuzzy compares within blocks."""
    value = normalize_key(F.col(attribute)) if comparator != "exact" else F.col(attribute)
    side = lambda df, n: df.select(F.col(key).alias(f"{n}_key"), value.alias(f"{n}_value"), (block if block is not None else F.lit(0)).alias(f"{n}_block"))
    left, right = side(a, "left"), side(b, "right")
    if comparator in ("exact", "normalized"):
        return left.join(right, F.col("left_value") == F.col("right_value")).select("left_key", "right_key", F.lit(1.0).alias("score"))
    if block is None:
        raise ValueError("fuzzy matching needs a block")
    longest = F.greatest(F.length("left_value"), F.length("right_value"), F.lit(1))
    score = F.round(1 - F.levenshtein("left_value", "right_value") / longest, 6)
    return left.join(right, F.col("left_block") == F.col("right_block")).withColumn("score", score).filter(F.col("score") >= threshold).select("left_key", "right_key", "score")


def survive(df: DataFrame, key: str, attribute: str, policy: str, order: Sequence[Column]) -> DataFrame:
    """One value an entity: the first non-null by source precedence, recency or trust; completeness prefers the longest."""
    if policy not in ("source-precedence", "recency", "completeness", "most-trusted"):
        raise ValueError(f"{policy} needs a steward")
    first = [F.length(F.col(attribute).cast("string")).desc()] if policy == "completeness" else []
    w = Window.partitionBy(key).orderBy(F.col(attribute).isNull().cast("int"), *first, *order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select(key, attribute)
