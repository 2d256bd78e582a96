"""Dimensional products: dimensions, facts, bridges, calendars, measures and row security."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cdc import merge


def dimension(silver: DataFrame, columns: Mapping[str, str], current_only: bool = False) -> DataFrame:
    rows = silver.filter("is_current = 1") if current_only else silver
    return rows.select(*[F.col(c).alias(n) for c, n in columns.items()])


def fact_incremental(target: DataFrame, source: DataFrame, keys: Sequence[str], clock: str) -> DataFrame:
    """Source rows from the target's newest clock on replace or join its rows; one value comes to the driver."""
    top = target.agg(F.max(clock)).first()[0]
    fresh = source if top is None else source.filter(F.col(clock) >= F.lit(top))
    return merge(target, fresh, keys)


def bridge(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct endpoints with equal weights that sum to one for each left member."""
    rows = pairs.select(left, right).dropna().distinct()
    weight = (F.lit(1).cast("decimal(18,6)") / F.count("*").over(Window.partitionBy(left))).cast("decimal(18,6)")
    return rows.withColumn("weight", weight)


def calendar(spark: SparkSession, start: str, end: str, fiscal_start: int = 1, holidays: Sequence[str] | None = None) -> DataFrame:
    """Days of [start, end]; the holiday flag is null without a holiday source."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    year = F.year("date") + F.when((F.month("date") >= fiscal_start) & F.lit(fiscal_start > 1), 1).otherwise(0)
    holiday = F.lit(None).cast("boolean") if holidays is None else F.date_format("date", "yyyy-MM-dd").isin(*holidays) if holidays else F.lit(False)
    return days.select(
        F.date_format("date", "yyyyMMdd").cast("long").alias("date_key"), "date", F.year("date").alias("year"), F.month("date").alias("month"),
        F.dayofmonth("date").alias("day"), F.quarter("date").alias("quarter"), year.cast("int").alias("fiscal_year"), holiday.alias("is_holiday"),
    )


class Measures:
    """Named aggregates that may build on each other; cycles and unknown names are errors."""

    def __init__(self) -> None:
        self._base: dict[str, Column] = {}
        self._derived: dict[str, tuple[tuple[str, ...], object]] = {}

    def base(self, name: str, column: Column) -> None:
        self._base[name] = column

    def derived(self, name: str, needs: Sequence[str], formula) -> None:
        self._derived[name] = (tuple(needs), formula)

    def resolve(self, name: str, above: tuple[str, ...] = ()) -> Column:
        if name in above:
            raise ValueError("measure cycle: " + " > ".join((*above, name)))
        if name in self._base:
            return self._base[name]
        if name not in self._derived:
            raise ValueError(f"unknown measure {name}")
        needs, formula = self._derived[name]
        return formula(*[self.resolve(n, (*above, name)) for n in needs])

    def evaluate(self, df: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
        return df.groupBy(*by).agg(*[self.resolve(n).alias(n) for n in names])


def to_date(df: DataFrame, value: str, date: str, period: str, partition: Sequence[str] = ()) -> Column:
    """Running sum within the year, quarter or month (ytd, qtd, mtd)."""
    unit = {"ytd": "year", "qtd": "quarter", "mtd": "month"}[period]
    w = Window.partitionBy(*partition, F.date_trunc(unit, date)).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(value).over(w)


def secured(df: DataFrame, entitled: Column | None, hidden: Sequence[str] = ()) -> DataFrame:
    """Fail closed: without an entitlement no row, and hidden columns never."""
    return df.filter(F.lit(False) if entitled is None else entitled).drop(*hidden)
