"""Declarative checks with one result row each, quarantine, and checks of keys, shapes and runtime tables.

A result has rule, category, status (pass, fail, not-evaluated), observed value as text, the number of
affected rows. Rates are decimals of 18 places and 6 digits, so any engine prints them alike.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.macros import OPERATORS

ROW_LEVEL = ("contract-shape", "range", "distribution", "referential", "cross-field")


@dataclass(frozen=True)
class Rule:
    """A check's name, kind, tolerance and action; ``bad`` is the row predicate of row-level kinds."""

    name: str
    kind: str
    tolerance: float = 0.0
    severity: str = "BLOCK"
    action: str = "report"
    bad: Column | None = None


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, (part.cast("decimal(18,0)") / whole.cast("decimal(18,0)")).cast("decimal(18,6)"))


def result(rule: Rule, observed: Column, affected: Column, fails: Column, known: Column | None = None) -> list[Column]:
    status = F.when(fails, "fail").otherwise("pass")
    if known is not None:
        status = F.when(~known, "not-evaluated").otherwise(status)
    return [
        F.lit(rule.name).alias("rule"), F.lit(rule.kind).alias("category"), status.alias("status"), observed.cast("string").alias("observed"),
        F.coalesce(affected, F.lit(0)).cast("long").alias("affected"),
    ]


def bad_rows(test: Column) -> Column:
    return F.sum(F.when(test, 1).otherwise(0))


def contract_shape(df: DataFrame, rule: Rule, required: Sequence[str]) -> DataFrame:
    test = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required])
    return df.agg(bad_rows(test).alias("n")).select(*result(rule, F.col("n"), F.col("n"), F.coalesce(F.col("n") > rule.tolerance, F.lit(False))))


def freshness(df: DataFrame, rule: Rule, clock: str, now: str, unit_seconds: int) -> DataFrame:
    """Age of the newest row in units before the injected time; no rows are not evaluated."""
    age = ((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("top")) / F.lit(unit_seconds)).cast("decimal(18,6)")
    return df.agg(F.max(clock).cast("timestamp").alias("top")).withColumn("age", age).select(
        *result(rule, F.col("age"), F.when(F.col("age") > rule.tolerance, 1).otherwise(0), F.col("age") > rule.tolerance, F.col("top").isNotNull())
    )


def volume(df: DataFrame, rule: Rule) -> DataFrame:
    n = F.col("n")
    return df.agg(F.count("*").alias("n")).select(*result(rule, n, F.when(n < rule.tolerance, n).otherwise(0), n < rule.tolerance))


def duplicate_rate(df: DataFrame, rule: Rule, columns: Sequence[str]) -> DataFrame:
    """Rows in groups of more than one over all rows."""
    sums = df.groupBy(*columns).agg(F.count("*").alias("n")).agg(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("bad"), F.sum("n").alias("all"))
    return _rated(sums, rule)


def _rated(sums: DataFrame, rule: Rule) -> DataFrame:
    out = sums.withColumn("rate", rate(F.col("bad"), F.coalesce("all", F.lit(0))))
    return out.select(*result(rule, F.col("rate"), F.col("bad"), F.col("rate") > rule.tolerance, F.col("rate").isNotNull()))


def share(df: DataFrame, rule: Rule, test: Column) -> DataFrame:
    """Share of rows where the test holds; null counts as not."""
    return _rated(df.agg(bad_rows(test).alias("bad"), F.count("*").alias("all")), rule)


def out_of_range(column: str, low, high) -> Column:
    """Nulls are no violations."""
    return (F.col(column) < F.lit(low)) | (F.col(column) > F.lit(high))


def out_of_list(column: str, values: Sequence) -> Column:
    """Nulls are violations."""
    return F.col(column).isNull() | ~F.col(column).isin(*values)


def cross_field(left: str, operator: str, right: str) -> Column:
    """Violations of ``left operator right``.

    Two nulls are equal; for eq and ne a single null gives no verdict; for the others any null violates.
    """
    a, b = F.col(left), F.col(right)
    both = a.isNull() & b.isNull()
    if operator == "eq":
        return ~both & (a != b)
    if operator == "ne":
        return both | (a == b)
    return a.isNull() | b.isNull() | ~OPERATORS[operator](a, b)


def reconcile(a: DataFrame, b: DataFrame, rule: Rule, column: str | None = None) -> DataFrame:
    """Counts, or sums with null as 0, of two relations; one row each meets the other."""
    metric = F.count("*").cast("decimal(38,4)") if column is None else F.coalesce(F.sum(F.col(column).cast("decimal(18,4)")), F.lit(0)).cast("decimal(38,4)")
    both = a.agg(metric.alias("m")).withColumn("side", F.lit(0)).unionByName(b.agg(metric.alias("m")).withColumn("side", F.lit(1)))
    one = both.agg(F.max(F.when(F.col("side") == 0, F.col("m"))).alias("x"), F.max(F.when(F.col("side") == 1, F.col("m"))).alias("y"))
    off = F.abs(F.col("x") - F.col("y"))
    text = F.concat(F.lit("source="), F.col("x").cast("string"), F.lit("|comparison="), F.col("y").cast("string"))
    return one.select(*result(rule, off.cast("decimal(38,4)"), F.when(off > rule.tolerance, 1).otherwise(0), off > rule.tolerance), text.alias("reconciliation"))


def referential(child: DataFrame, parent: DataFrame, rule: Rule, child_key: str, parent_key: str) -> DataFrame:
    """Share of null or unmatched keys; duplicate parents multiply rows, as in a plain left join."""
    p = parent.select(F.col(parent_key).alias("__p"))
    joined = child.select(F.col(child_key).alias("__c")).join(p, F.col("__c") == F.col("__p"), "left")
    return share(joined, rule, F.col("__c").isNull() | F.col("__p").isNull())


def statuses(results: Sequence[DataFrame]) -> DataFrame:
    cols = ["rule", "category", "status", "observed", "affected"]
    return reduce(lambda a, b: a.unionByName(b), [r.select(*cols) for r in results])


def gate(results: DataFrame, severities: Mapping[str, str]) -> DataFrame:
    """Results that are not a pass, as errors under BLOCK and warnings else."""
    level = F.lit("warn")
    for rule, severity in severities.items():
        level = F.when(F.col("rule") == rule, "error" if severity == "BLOCK" else "warn").otherwise(level)
    return results.filter(F.col("status").isin("fail", "error", "not-evaluated")).withColumn("level", level)


def failed_rules(df: DataFrame, rules: Sequence[Rule]) -> list[Rule]:
    """Row-level rules whose share exceeds the tolerance; one aggregate for all."""
    if any(r.kind not in ROW_LEVEL or r.bad is None for r in rules):
        raise ValueError("only row-level rules can set rows apart")
    got = df.agg(F.count("*").alias("all"), *[F.coalesce(bad_rows(r.bad), F.lit(0)).alias(f"b{k}") for k, r in enumerate(rules)]).first()
    return [r for k, r in enumerate(rules) if got["all"] and (got[f"b{k}"] if r.kind == "contract-shape" else got[f"b{k}"] / got["all"]) > r.tolerance]


def quarantine(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows that violate a failed rule, once for each, with ``_rule``."""
    failed = failed_rules(df, rules)
    parts = [df.filter(r.bad).withColumn("_rule", F.lit(r.name)) for r in failed]
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else df.limit(0).withColumn("_rule", F.lit(""))


def accepted(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows that violate no failed rule; a null verdict accepts."""
    out = df
    for r in failed_rules(df, rules):
        out = out.filter(~F.coalesce(r.bad, F.lit(False)))
    return out


def is_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that lack a value in one of the columns."""
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def row_counts(expected: DataFrame, found: DataFrame) -> DataFrame:
    """``expected, found``: the rows of both, by two counts that meet on a constant."""
    one = lambda df, n: df.agg(F.lit(1).alias("__k"), F.count("*").alias(n))
    return one(expected, "expected").join(one(found, "found"), "__k").select("expected", "found")


def not_unique(df: DataFrame, columns: Sequence[str], where: Column | None = None) -> DataFrame:
    rows = df if where is None else df.filter(where)
    return rows.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def shape_violations(df: DataFrame, constraints: Sequence[tuple[str, str, object]]) -> DataFrame:
    """Violations for each (column, kind, value): minCount, pattern, in, minLength, maxLength, minInclusive, maxInclusive."""
    tests = {
        "minCount": lambda c, v: c.isNull(), "pattern": lambda c, v: ~c.rlike(v), "in": lambda c, v: ~c.isin(*v),
        "minLength": lambda c, v: F.length(c) < v, "maxLength": lambda c, v: F.length(c) > v,
        "minInclusive": lambda c, v: c < v, "maxInclusive": lambda c, v: c > v,
    }
    sums = df.agg(*[F.coalesce(bad_rows(tests[k](F.col(c), v)), F.lit(0)).alias(f"s{i}") for i, (c, k, v) in enumerate(constraints)])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("constraint"), F.col(f"s{i}").cast("long").alias("violations")) for i, (c, k, _) in enumerate(constraints)]
    return sums.select(F.inline(F.array(*rows)))


def rt_total_order(df: DataFrame, identity: Sequence[str], ordering: Sequence[str]) -> DataFrame:
    return df.groupBy(*identity, *ordering).agg(F.count("*").alias("duplicate_count")).filter("duplicate_count > 1")


def rt_cdc_contract(df: DataFrame, operations: Sequence[str], times: Sequence[str]) -> DataFrame:
    missing = reduce(lambda a, b: a | b, [F.col(t).isNull() for t in times])
    return df.filter(~F.col("_cdc_operation").isin(*operations) | missing)


def rt_delete_policy(df: DataFrame, hard: str, soft: str) -> DataFrame:
    op = F.col("_cdc_operation")
    return df.filter((F.lit(hard == "block") & (op == "delete")) | (F.lit(soft == "block") & (op == "soft-delete")))


def rt_replay(df: DataFrame, identity: Sequence[str], times: Sequence[str]) -> DataFrame:
    return df.groupBy(*identity, "_cdc_operation", *times).agg(F.count("*").alias("replay_count")).filter("replay_count > 1")


def rt_one_current(df: DataFrame, identity: Sequence[str], flag: str = "is_current") -> DataFrame:
    return df.groupBy(*identity).agg(bad_rows(F.col(flag) == 1).alias("current_count")).filter("current_count <> 1")


def rt_half_open(df: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Intervals that end before they start or overlap the one before."""
    by_business = Window.partitionBy(*identity).orderBy("_business_valid_from", "_system_from")
    by_system = Window.partitionBy(*identity).orderBy("_system_from")
    out = df.withColumns({"__b": F.lag("_business_valid_to").over(by_business), "__s": F.lag("_system_to").over(by_system)})
    bf, bt, sf, st = (F.col(c) for c in ("_business_valid_from", "_business_valid_to", "_system_from", "_system_to"))
    return out.filter((bf >= bt) | (sf >= st) | (bf < F.col("__b")) | (sf < F.col("__s"))).drop("__b", "__s")


def rt_fk_cardinality(df: DataFrame, count: str, required: bool) -> DataFrame:
    return df.filter((F.col(count) > 1) | (F.lit(required) & (F.col(count) == 0)))
