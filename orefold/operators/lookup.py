"""Parent lookups: plain, current and as of a time, with match counts and routing of the misses."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import UNKNOWN_MEMBER

#: Actions on a parent that is missing, met more than once, or known but not valid yet; open ends; overlaps.
MISSING = ("error", "null", "quarantine")
AMBIGUOUS = ("error", "quarantine", "first")
LATE = ("error", "null", "defer")
OPEN_ENDS = ("null", "max-value")
OVERLAPS = ("error", "latest-start")


def lookup(
    child: DataFrame, parent: DataFrame, pairs: Sequence[tuple[str, str]], bring: dict[str, str], current: str | None = None,
    as_of: tuple[str, str, str] | None = None, open_end: str = "null",
) -> DataFrame:
    """Left join on the (child, parent) column pairs; ``bring`` maps parent columns to new names.

    ``current`` names a 0/1 flag that the parent must have; ``as_of`` is the child's time and the
    parent's closed-open interval columns, the end null where open, or under ``max-value`` a time after all others
    (then a null end is no interval). The join keys are real columns,
    so a range condition stays a residual of a hash or merge join; no side is forced to be broadcast.
    """
    if current:
        parent = parent.filter(F.col(current) == 1)
    p = parent.select(*[F.col(k).alias(f"__k{i}") for i, (_, k) in enumerate(pairs)],
                      *([F.col(as_of[1]).alias("__from"), F.col(as_of[2]).alias("__to")] if as_of else []),
                      *[F.col(c).alias(n) for c, n in bring.items()])
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__k{i}") for i, (c, _) in enumerate(pairs)])
    if as_of:
        t = F.col(as_of[0])
        if open_end not in OPEN_ENDS:
            raise ValueError(f"unknown open end {open_end}")
        on = on & (t >= F.col("__from")) & ((t < F.col("__to")) | (F.col("__to").isNull() if open_end == "null" else F.lit(False)))
    return child.join(p, on, "left").drop(*[c for c in p.columns if c.startswith("__")])


def with_match_count(joined: DataFrame, grain: Sequence[str], parent_key: str, name: str) -> DataFrame:
    """How many parents each grain row met, counted before anything is resolved."""
    return joined.withColumn(name, F.count(parent_key).over(Window.partitionBy(*grain)))


def one_parent(parent: DataFrame, keys: Sequence[str], bring: dict[str, str], count: str, order: Sequence[str] = ()) -> DataFrame:
    """One row for each key: how many parents have it and, of the first in the order, the brought columns.

    The parents are counted before the join, so a child is never multiplied and no window runs over it.
    """
    first = F.min(F.struct(*[F.col(c) for c in order], *[F.col(c).alias(f"__b_{n}") for c, n in bring.items()]))
    found = parent.groupBy(*keys).agg(F.count("*").alias(count), first.alias("__first"))
    return found.select(*keys, count, *[F.col(f"__first.__b_{n}").alias(n) for n in bring.values()])


def counted_lookup(
    child: DataFrame, parent: DataFrame, pairs: Sequence[tuple[str, str]], bring: dict[str, str], count: str, current: str | None = None, order: Sequence[str] = ()
) -> DataFrame:
    """``lookup`` with one row for each child row: the first parent in the order and the count of all."""
    if current:
        parent = parent.filter(F.col(current) == 1)
    one = one_parent(parent, [p for _, p in pairs], bring, count, order)
    out = lookup(child, one, pairs, {count: count, **{n: n for n in bring.values()}})
    return out.withColumn(count, F.coalesce(count, F.lit(0)).cast("long"))


def latest_start(joined: DataFrame, grain: Sequence[str], start: str) -> DataFrame:
    """Of several valid parents of one child row the one that started last; ties stay and count as ambiguous."""
    best = F.max(start).over(Window.partitionBy(*grain))
    return joined.withColumn("__best", best).filter(F.col("__best").isNull() | (F.col(start) == F.col("__best"))).drop("__best")


def first_parent(joined: DataFrame, grain: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of several parents of one child row the first in the order."""
    w = Window.partitionBy(*grain).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return joined.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def late(joined: DataFrame, parent: DataFrame, pairs: Sequence[tuple[str, str]], key: str, name: str) -> DataFrame:
    """After an as-of lookup: whether the parent is known but had no interval at the child's time."""
    known = parent.select(*[F.col(k).alias(f"__k{i}") for i, (_, k) in enumerate(pairs)]).distinct().withColumn("__known", F.lit(True))
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__k{i}") for i, (c, _) in enumerate(pairs)])
    out = joined.join(known, on, "left").withColumn(name, F.col(key).isNull() & F.coalesce("__known", F.lit(False)))
    return out.drop("__known", *[f"__k{i}" for i in range(len(pairs))])


def route_late(joined: DataFrame, flag: str, key: str, action: str = "error") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted rows, deferred rows (for a later run) and rows that must fail the run; ``null`` gives the unknown member."""
    if action not in LATE:
        raise ValueError(f"unknown policy {action}")
    there = joined.filter(~F.col(flag))
    behind = joined.filter(F.col(flag))
    none = joined.limit(0)
    if action == "null":
        return there.unionByName(behind.withColumn(key, unknown_member(F.col(key)))), none, none
    return there, behind if action == "defer" else none, behind if action == "error" else none


def unknown_member(c: Column, member: str = UNKNOWN_MEMBER) -> Column:
    return F.coalesce(c, F.lit(member))


def route(joined: DataFrame, count: str, key: str, missing: str = "null", ambiguous: str = "error") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted rows, quarantined rows and rows that must fail the run.

    Missing parents become the unknown member under ``null``; ``first`` takes rows as they are, so one parent must have
    been chosen before; the other actions set rows apart.
    """
    if missing not in MISSING or ambiguous not in AMBIGUOUS:
        raise ValueError(f"unknown policy {missing}, {ambiguous}")
    none, many = F.col(count) == 0, F.col(count) > 1
    action = F.when(none, F.lit(missing)).when(many, F.lit(ambiguous)).otherwise(F.lit("accept"))
    marked = joined.withColumn("__action", action)
    part = lambda *names: marked.filter(F.col("__action").isin(*names)).drop("__action")
    return part("accept", "null", "first").withColumn(key, unknown_member(F.col(key))), part("quarantine"), part("error")


def orphans(child: DataFrame, parent: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Child rows with a key that no parent has; a null key is an orphan."""
    p = parent.select(*[F.col(k).alias(f"__k{i}") for i, (_, k) in enumerate(pairs)])
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__k{i}") for i, (c, _) in enumerate(pairs)])
    return child.join(p, on, "left_anti")


def reverse_key(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, bring: dict[str, str]) -> DataFrame:
    """The key on the range side: the parent's rows with the referring child's columns."""
    return lookup(parent, child, [(parent_key, child_key)], bring)
