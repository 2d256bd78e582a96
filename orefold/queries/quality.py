"""Checks, quarantine, shape constraints and checks of runtime tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cdc, lookup
from ..operators import quality as Q
from .base import IDENTITY, TIES, events_sql, money, query, stamp, stamp_sql, table, user_events
from .changes import VERSIONS_SQL, versions
from .sources import _COUNTED, counted

_RATE = "CAST(round(CAST({a} AS DOUBLE) / {b}, 6) AS DECIMAL(18,6))"


def _row(name: str, kind: str, bad: str, tol: float, rows: str, known: bool = True) -> str:
    """A result of a share: bad rows over all."""
    return f"""SELECT '{name}' AS rule, '{kind}' AS category, CASE WHEN n = 0 THEN 'not-evaluated' WHEN r > {tol} THEN 'fail' ELSE 'pass' END AS status, CAST(r AS VARCHAR) AS observed, CAST(coalesce(b, 0) AS BIGINT) AS affected
FROM (SELECT n, b, {_RATE.format(a="b", b="n")} AS r FROM (SELECT count(*) AS n, sum(CASE WHEN {bad} THEN 1 ELSE 0 END) AS b FROM {rows}))"""


@query("""SELECT 'shape' AS rule, 'contract-shape' AS category, CASE WHEN b > 0 THEN 'fail' ELSE 'pass' END AS status, CAST(b AS VARCHAR) AS observed, CAST(b AS BIGINT) AS affected
FROM (SELECT sum(CASE WHEN c_custkey IS NULL OR nullif(c_mktsegment, 'BUILDING') IS NULL THEN 1 ELSE 0 END) AS b FROM customer)""")
def dq_contract_shape(spark, d):
    df = table(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"))
    return Q.contract_shape(df, Q.Rule("shape", "contract-shape"), ["c_custkey", "seg"])


@query("""SELECT 'fresh' AS rule, 'freshness' AS category, CASE WHEN a > 24 THEN 'fail' ELSE 'pass' END AS status, CAST(a AS VARCHAR) AS observed, CAST(CASE WHEN a > 24 THEN 1 ELSE 0 END AS BIGINT) AS affected
FROM (SELECT CAST(round((epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(max(ts)))) / 3600, 6) AS DECIMAL(18,6)) AS a FROM events)""")
def dq_freshness(spark, d):
    return Q.freshness(table(spark, d, "events"), Q.Rule("fresh", "freshness", 24), "ts", "2024-02-01 00:00:00", 3600)


@query("""SELECT 'vol' AS rule, 'volume' AS category, CASE WHEN n < 2000 THEN 'fail' ELSE 'pass' END AS status, CAST(n AS VARCHAR) AS observed, CAST(CASE WHEN n < 2000 THEN n ELSE 0 END AS BIGINT) AS affected FROM (SELECT count(*) AS n FROM customer)""")
def dq_volume(spark, d):
    return Q.volume(table(spark, d, "customer"), Q.Rule("vol", "volume", 2000))


@query(_row("dups", "duplicate-rate", "c > 1", 0.1, "(SELECT count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS c FROM lineitem)"))
def dq_duplicate_rate(spark, d):
    return Q.duplicate_rate(table(spark, d, "lineitem"), Q.Rule("dups", "duplicate-rate", 0.1), ["l_orderkey", "l_linenumber"])


@query(_row("range", "range", "l_quantity < 2 OR l_quantity > 48", 0.01, "lineitem"))
def dq_range(spark, d):
    return Q.share(table(spark, d, "lineitem"), Q.Rule("range", "range", 0.01), Q.out_of_range("l_quantity", 2, 48))


@query(_row("list", "distribution", "nullif(o_orderstatus, 'P') IS NULL OR o_orderstatus NOT IN ('F', 'O')", 0.05, "orders"))
def dq_distribution(spark, d):
    df = table(spark, d, "orders").select(F.nullif("o_orderstatus", F.lit("P")).alias("s"))
    return Q.share(df, Q.Rule("list", "distribution", 0.05), Q.out_of_list("s", ["F", "O"]))


def _recon(name, a, b):
    return f"""SELECT '{name}' AS rule, 'reconciliation' AS category, CASE WHEN abs(x - y) > 0 THEN 'fail' ELSE 'pass' END AS status, CAST(abs(x - y) AS VARCHAR) AS observed,
 CAST(CASE WHEN abs(x - y) > 0 THEN 1 ELSE 0 END AS BIGINT) AS affected, 'source=' || x || '|comparison=' || y AS reconciliation FROM (SELECT CAST(({a}) AS DECIMAL(38,4)) AS x, CAST(({b}) AS DECIMAL(38,4)) AS y)"""


@query(_recon("count", "SELECT count(*) FROM orders", "SELECT count(*) FROM orders WHERE o_custkey % 10 <> 0"))
def dq_reconciliation(spark, d):
    o = table(spark, d, "orders")
    return Q.reconcile(o, o.filter("o_custkey % 10 <> 0"), Q.Rule("count", "reconciliation"))


@query(_recon("sum", "SELECT sum(CAST(o_totalprice AS DECIMAL(18,4))) FROM orders", "SELECT coalesce(sum(CAST(o_totalprice AS DECIMAL(18,4))), 0) FROM orders WHERE o_custkey < 0"))
def dq_reconciliation_sum(spark, d):
    o = table(spark, d, "orders")
    return Q.reconcile(o, o.filter("o_custkey < 0"), Q.Rule("sum", "reconciliation"), "o_totalprice")


@query(_row("ref", "referential", "o_custkey IS NULL OR c_custkey IS NULL", 0.05, "orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) ON o_custkey = c_custkey"))
def dq_referential(spark, d):
    return Q.referential(table(spark, d, "orders"), table(spark, d, "customer").filter("c_custkey % 10 <> 0"), Q.Rule("ref", "referential", 0.05), "o_custkey", "c_custkey")


_AB = "(SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END AS a, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey % 25 END AS b FROM customer)"
_CROSS = {
    "eq": "NOT (a IS NULL AND b IS NULL) AND a <> b", "ne": "(a IS NULL AND b IS NULL) OR a = b", "lt": "a IS NULL OR b IS NULL OR NOT a < b", "gte": "a IS NULL OR b IS NULL OR NOT a >= b",
}


def _ab(spark, d):
    c = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.when(c % 4 != 0, F.col("c_nationkey")).alias("a"), F.when(c % 6 != 0, c % 25).alias("b"))


@query("\nUNION ALL\n".join(_row(f"cross-{k}", "cross-field", v, 0.3, _AB) for k, v in _CROSS.items()))
def dq_cross_field(spark, d):
    df = _ab(spark, d)
    return Q.statuses([Q.share(df, Q.Rule(f"cross-{k}", "cross-field", 0.3), Q.cross_field("a", k, "b")) for k in _CROSS])


def _rules():
    return [
        Q.Rule("range", "range", 0.01, bad=Q.out_of_range("o_totalprice", 2000, 400000)), Q.Rule("list", "distribution", 0.05, bad=Q.out_of_list("s", ["F", "O"])),
        Q.Rule("loose", "distribution", 0.99, bad=Q.out_of_list("s", ["F"])),
    ]


_DIRTY = "(SELECT o_orderkey, o_totalprice, nullif(o_orderstatus, 'P') AS s FROM orders)"
_BAD = {"range": ("o_totalprice < 2000 OR o_totalprice > 400000", 0.01), "list": ("s IS NULL OR s NOT IN ('F', 'O')", 0.05), "loose": ("s IS NULL OR s NOT IN ('F')", 0.99)}
_FAILED = ", ".join(f"{k} AS (SELECT avg(CASE WHEN {b} THEN 1.0 ELSE 0.0 END) > {t} AS failed FROM {_DIRTY})" for k, (b, t) in _BAD.items()).replace("list AS", "lists AS").replace("range AS", "ranges AS").replace("loose AS", "looses AS")


def _dirty(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.nullif("o_orderstatus", F.lit("P")).alias("s"))


@query(f"WITH {_FAILED} " + " UNION ALL ".join(f"SELECT o_orderkey, '{k}' AS _rule FROM {_DIRTY}, {k}s WHERE failed AND ({b})" for k, (b, _) in _BAD.items()))
def dq_quarantine(spark, d):
    return Q.quarantine(_dirty(spark, d), _rules()).select("o_orderkey", "_rule")


@query(f"WITH {_FAILED} SELECT o_orderkey FROM {_DIRTY} WHERE " + " AND ".join(f"NOT coalesce((SELECT failed FROM {k}s) AND ({b}), FALSE)" for k, (b, _) in _BAD.items()))
def dq_accepted(spark, d):
    return Q.accepted(_dirty(spark, d), _rules()).select("o_orderkey")


@query(f"""SELECT *, CASE WHEN rule = 'range' THEN 'error' ELSE 'warn' END AS level FROM ({_row("range", "range", "l_quantity < 2 OR l_quantity > 48", 0.01, "lineitem")} UNION ALL
{_row("list", "distribution", "o_orderstatus NOT IN ('F')", 0.05, "orders")} UNION ALL {_row("fine", "range", "l_quantity < 0", 0.5, "lineitem")}) WHERE status <> 'pass'""")
def dq_gate(spark, d):
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    results = Q.statuses([
        Q.share(lines, Q.Rule("range", "range", 0.01), Q.out_of_range("l_quantity", 2, 48)), Q.share(orders, Q.Rule("list", "distribution", 0.05), Q.out_of_list("o_orderstatus", ["F"])),
        Q.share(lines, Q.Rule("fine", "range", 0.5), Q.out_of_range("l_quantity", 0, 1000)),
    ])
    return Q.gate(results, {"range": "BLOCK", "list": "WARN", "fine": "BLOCK"})


@query("SELECT c_custkey FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NULL")
def chk_not_null(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    return Q.is_null(rows, ["segment"]).select("c_custkey")


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def chk_unique(spark, d):
    return Q.not_unique(table(spark, d, "customer"), ["c_nationkey"])


@query("SELECT count(*) AS expected, count(*) FILTER (WHERE c_custkey % 7 <> 0) AS found FROM customer")
def chk_rowcount(spark, d):
    c = table(spark, d, "customer")
    return Q.row_counts(c, c.filter("c_custkey % 7 <> 0"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY 1, 2 HAVING count(*) > 1")
def chk_grain(spark, d):
    return Q.not_unique(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], F.col("l_quantity") > 10)


@query("""SELECT * FROM (SELECT 'p_brand' AS "column", 'pattern' AS "constraint", count(*) FILTER (WHERE NOT regexp_matches(p_brand, '^Brand#1')) AS violations FROM part
UNION ALL SELECT 'p_name', 'minLength', count(*) FILTER (WHERE length(p_name) < 8) FROM part UNION ALL SELECT 'p_name', 'maxLength', count(*) FILTER (WHERE length(p_name) > 9) FROM part
UNION ALL SELECT 'p_size', 'minInclusive', count(*) FILTER (WHERE p_size < 5) FROM part UNION ALL SELECT 'p_size', 'maxInclusive', count(*) FILTER (WHERE p_size > 40) FROM part
UNION ALL SELECT 'p_size', 'in', count(*) FILTER (WHERE p_size NOT IN (1, 2, 3)) FROM part UNION ALL SELECT 'p_type', 'minCount', count(*) FILTER (WHERE p_type IS NULL) FROM part)""")
def shacl_checks(spark, d):
    return Q.shape_violations(table(spark, d, "part"), [
        ("p_brand", "pattern", "^Brand#1"), ("p_name", "minLength", 8), ("p_name", "maxLength", 9), ("p_size", "minInclusive", 5), ("p_size", "maxInclusive", 40),
        ("p_size", "in", (1, 2, 3)), ("p_type", "minCount", 1),
    ])


_TWICE = f"{events_sql()}, tw AS (SELECT * FROM ev UNION ALL SELECT * FROM ev WHERE _cdc_sequence % 10 = 0)"


def _twice(spark, d):
    rows = user_events(spark, d)
    return rows.unionByName(rows.filter("_cdc_sequence % 10 = 0"))


@query(f"WITH {_TWICE} SELECT user_id, _cdc_sequence, count(*) AS duplicate_count FROM tw GROUP BY 1, 2 HAVING count(*) > 1")
def rt_total_order(spark, d):
    return Q.rt_total_order(_twice(spark, d), IDENTITY, [*cdc.TIMES, *TIES]).select("user_id", "_cdc_sequence", "duplicate_count")


@query(f"WITH {events_sql('removal')} SELECT user_id, _cdc_sequence, _cdc_operation FROM ev WHERE _cdc_operation NOT IN ('insert', 'update', 'delete', 'soft-delete', 'snapshot')")
def rt_cdc_contract(spark, d):
    return Q.rt_cdc_contract(user_events(spark, d, "removal"), cdc.OPERATIONS, cdc.TIMES).select("user_id", "_cdc_sequence", "_cdc_operation")


@query(f"WITH {events_sql()} SELECT user_id, _cdc_sequence FROM ev WHERE _cdc_operation = 'delete'")
def rt_delete_policy(spark, d):
    return Q.rt_delete_policy(user_events(spark, d), "block", "ignore").select("user_id", "_cdc_sequence")


@query(f"WITH {_TWICE} SELECT user_id, _cdc_operation, {stamp_sql('_source_updated_at')} AS updated_at, count(*) AS replay_count FROM tw GROUP BY 1, 2, 3 HAVING count(*) > 1")
def rt_replay(spark, d):
    return Q.rt_replay(_twice(spark, d), IDENTITY, cdc.TIMES).select("user_id", "_cdc_operation", stamp("_source_updated_at").alias("updated_at"), "replay_count")


@query(f"WITH {VERSIONS_SQL}, x AS (SELECT user_id, CASE WHEN user_id % 9 = 0 THEN 1 ELSE is_current END AS is_current FROM versions) SELECT user_id, sum(is_current)::BIGINT AS current_count FROM x GROUP BY 1 HAVING sum(is_current) <> 1")
def rt_one_current(spark, d):
    rows = versions(spark, d).withColumn("is_current", F.when(F.col("user_id") % 9 == 0, 1).otherwise(F.col("is_current")))
    return Q.rt_one_current(rows, IDENTITY)


@query(f"""WITH {VERSIONS_SQL}, x AS (SELECT *, CASE WHEN user_id % 20 = 0 THEN _business_valid_to + INTERVAL 10 DAY ELSE _business_valid_to END AS bt FROM versions),
o AS (SELECT *, lag(bt) OVER (PARTITION BY user_id ORDER BY _business_valid_from, _system_from) AS pb, lag(_system_to) OVER (PARTITION BY user_id ORDER BY _system_from) AS ps FROM x)
SELECT user_id, _cdc_sequence FROM o WHERE _business_valid_from >= bt OR _system_from >= _system_to OR _business_valid_from < pb OR _system_from < ps""")
def rt_half_open(spark, d):
    to = F.when(F.col("user_id") % 20 == 0, F.col("_business_valid_to") + F.expr("INTERVAL 10 DAY")).otherwise(F.col("_business_valid_to"))
    return Q.rt_half_open(versions(spark, d).withColumn("_business_valid_to", to), IDENTITY).select("user_id", "_cdc_sequence")


@query(f"WITH {_COUNTED} SELECT o_orderkey, matches FROM c WHERE matches > 1 OR matches = 0")
def rt_fk_cardinality(spark, d):
    return Q.rt_fk_cardinality(counted(spark, d), "matches", True).select("o_orderkey", "matches")


@query("SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS amount FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def chk_unbilled(spark, d):
    lines = lookup.orphans(table(spark, d, "lineitem"), table(spark, d, "orders").filter("o_orderstatus = 'F'"), [("l_orderkey", "o_orderkey")])
    return lines.groupBy("l_orderkey").agg(F.sum(money("l_extendedprice")).alias("amount"))
