"""Several sources of one entity: unions, precedence, survivors, lineage and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_all(branches: Sequence[DataFrame]) -> DataFrame:
    """Disjoint branches with the same columns."""
    first = set(branches[0].columns)
    if any(set(b.columns) != first for b in branches):
        raise ValueError("branches differ in columns")
    return reduce(lambda a, b: a.unionByName(b), branches)


def union_superset(branches: Sequence[DataFrame], last: Sequence[str] = ()) -> DataFrame:
    """All columns of all branches, missing ones null; the columns in ``last`` (keys) at the end."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches)
    return out.select(*[c for c in out.columns if c not in last], *[c for c in out.columns if c in last])


def common_columns(branches: Sequence[DataFrame]) -> list[str]:
    names = set.intersection(*[set(b.columns) for b in branches])
    return [c for c in branches[0].columns if c in names]


def with_discriminator(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.withColumn(column, F.lit(value))


def precedence(c: Column, sources: Sequence[str]) -> Column:
    """0 for the first source; unknown ones after the last."""
    out = F.when(c == F.lit(sources[0]), F.lit(0))
    for k, s in enumerate(sources[1:], 1):
        out = out.when(c == F.lit(s), F.lit(k))
    return out.otherwise(F.lit(len(sources)))


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; the order should be total."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rank = 1").drop("__rank")


def conform(branches: Sequence[DataFrame], key: str, system: str, sources: Sequence[str], record_key: str, order: Sequence[Column] = ()) -> DataFrame:
    """Exactly equivalent branches: one row a key by source precedence, the authored order, the record key."""
    if len(set(sources)) != len(sources):
        raise ValueError("precedence must be unique")
    rows = union_all(branches)
    return best_per_key(rows, [key], [precedence(F.col(system), sources), *order, F.col(record_key)])


def full_merge(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """Complementary sources: one row a key, columns of both, ``in_<name>`` flags."""
    a = left.withColumn(f"in_{names[0]}", F.lit(True))
    b = right.withColumn(f"in_{names[1]}", F.lit(True))
    out = a.join(b, key, "full_outer")
    return out.fillna(False, [f"in_{n}" for n in names])


def contribution_lineage(branches: Sequence[tuple[DataFrame, str, str]], key: str) -> DataFrame:
    """Which record of which system contributed to which entity; branches come with a role and identity reference."""
    parts = [
        b.select(F.col(key).alias("parent_key"), "_source_system", "_source_record_key", F.lit(role).alias("_contribution_role"), F.lit(ref).alias("_source_identity_ref"))
        for b, role, ref in branches
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def reconciliation(branches: Sequence[tuple[DataFrame, str, str]], key: str, actions: dict[str, str]) -> DataFrame:
    """Lineage with occurrences of source and integration keys, collision and overlap flags, and the policy."""
    rows = reduce(
        lambda a, b: a.unionByName(b),
        [b.select(F.lit(name).alias("_branch_model"), "_source_system", "_source_record_key", key, F.lit(role).alias("_contribution_role")) for b, name, role in branches],
    )
    by_source = F.count("*").over(Window.partitionBy("_source_system", "_source_record_key"))
    by_key = F.count("*").over(Window.partitionBy(key))
    out = rows.withColumns({"_source_key_occurrences": by_source, "_integration_key_occurrences": by_key})
    flags = {
        "_source_key_collision": (F.col("_source_key_occurrences") > 1).cast("int"),
        "_equivalent_branch_overlap": (F.col("_integration_key_occurrences") > 1).cast("int"),
    }
    return out.withColumns(flags | {f"_{k}_action": F.lit(v) for k, v in actions.items()})


def check_members(members: Sequence[dict]) -> list[str]:
    """Codes of what forbids conforming these members; empty if they may be."""
    found = []
    if len(members) < 2:
        found.append("conform-too-few")
    ranks = [m["precedence"] for m in members]
    if len(set(ranks)) != len(ranks):
        found.append("conform-precedence")
    for field in ("class", "grain", "identity", "types", "load"):
        if len({repr(m.get(field)) for m in members}) > 1:
            found.append(f"conform-{field}")
    return found
