"""Change events: latest rows, merges, versions, replays, corrections, lookback and backfill."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cdc
from .base import IDENTITY, ORDER_DESC_SQL, ORDER_SQL, TIES, events_sql, query, stamp, stamp_sql, user_events

_EV = events_sql()
_MARKED = "m AS (SELECT *, CAST(_cdc_operation = 'delete' AS INTEGER) AS _is_deleted FROM ev)"
_CORRECTED = f"k AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY user_id, _source_effective_at ORDER BY {ORDER_DESC_SQL}) = 1)"
_CHANGED = """g AS (SELECT *, lag(_row_hash) OVER w AS ph, lag(_is_deleted) OVER w AS pd FROM k WINDOW w AS (PARTITION BY user_id ORDER BY _source_effective_at)),
h AS (SELECT * EXCLUDE (ph, pd) FROM g WHERE ph IS NULL OR ph <> _row_hash OR pd <> _is_deleted)"""
VERSIONS_SQL = f"""{_EV}, {_MARKED}, {_CORRECTED}, {_CHANGED},
versions AS (SELECT *, _source_effective_at AS _business_valid_from, lead(_source_effective_at) OVER (PARTITION BY user_id ORDER BY _source_effective_at) AS _business_valid_to,
 _ingested_at AS _system_from, lead(_ingested_at) OVER (PARTITION BY user_id ORDER BY _ingested_at, {ORDER_SQL}) AS _system_to,
 CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY _ingested_at DESC, {ORDER_DESC_SQL}) = 1 THEN 1 ELSE 0 END AS is_current FROM h)"""
_SHOWN = f"""user_id, _cdc_sequence, event_type, value, _row_hash, _is_deleted, is_current, {stamp_sql("_business_valid_from")} AS valid_from, {stamp_sql("_business_valid_to")} AS valid_to,
 {stamp_sql("_system_from")} AS system_from, {stamp_sql("_system_to")} AS system_to"""
_BRIEF = "user_id, _cdc_sequence, _cdc_operation, event_type, value"


def marked(spark, d):
    return cdc.handle_deletes(user_events(spark, d), "tombstone", "ignore")


def versions(spark, d):
    return cdc.scd2(marked(spark, d), IDENTITY, TIES)


def shown(df):
    times = {"valid_from": "_business_valid_from", "valid_to": "_business_valid_to", "system_from": "_system_from", "system_to": "_system_to"}
    return df.select("user_id", "_cdc_sequence", "event_type", "value", "_row_hash", "_is_deleted", "is_current", *[stamp(c).alias(n) for n, c in times.items()])


def brief(df):
    return df.select(*_BRIEF.split(", "))


@query(f"WITH {_EV}, {_MARKED} SELECT {_BRIEF} FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {ORDER_DESC_SQL}) = 1")
def scd1_latest(spark, d):
    return brief(cdc.latest(marked(spark, d), IDENTITY, TIES))


_SPLIT = "TIMESTAMP '2024-01-20 00:00:00'"
_OLD_NEW = f"""o AS (SELECT * FROM m WHERE _source_updated_at < {_SPLIT} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {ORDER_DESC_SQL}) = 1),
n AS (SELECT * FROM m WHERE _source_updated_at >= {_SPLIT} AND user_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {ORDER_DESC_SQL}) = 1),
ch AS (SELECT n.* FROM n LEFT JOIN o USING (user_id) WHERE o.user_id IS NULL OR
 ((n._source_effective_at, n._source_updated_at, n._ingested_at, n._cdc_sequence) > (o._source_effective_at, o._source_updated_at, o._ingested_at, o._cdc_sequence)
  AND (n._row_hash IS DISTINCT FROM o._row_hash OR n._is_deleted IS DISTINCT FROM o._is_deleted)))"""


@query(f"WITH {_EV}, {_MARKED}, {_OLD_NEW} SELECT {_BRIEF} FROM ch UNION ALL SELECT {_BRIEF} FROM o WHERE user_id NOT IN (SELECT user_id FROM ch)")
def scd1_merge(spark, d):
    rows, cut = marked(spark, d), F.lit("2024-01-20 00:00:00").cast("timestamp")
    old = cdc.latest(rows.filter(F.col("_source_updated_at") < cut), IDENTITY, TIES)
    return brief(cdc.scd1(rows.filter((F.col("_source_updated_at") >= cut) & (F.col("user_id") % 3 != 0)), old, IDENTITY, TIES))


@query(f"WITH {_EV} SELECT {_BRIEF} FROM ev")
def scd2_replay(spark, d):
    rows = user_events(spark, d)
    return brief(cdc.replay_dedup(rows.unionByName(rows.filter("user_id % 2 = 0")), IDENTITY, TIES))


@query(f"WITH {_EV}, {_MARKED}, {_CORRECTED} SELECT {_BRIEF} FROM k")
def scd2_correction(spark, d):
    return brief(cdc.corrected(marked(spark, d), IDENTITY, TIES))


@query(f"WITH {_EV}, {_MARKED}, {_CORRECTED}, {_CHANGED} SELECT {_BRIEF} FROM h")
def scd2_changes(spark, d):
    return brief(cdc.compacted(cdc.corrected(marked(spark, d), IDENTITY, TIES), IDENTITY))


@query(f"WITH {VERSIONS_SQL} SELECT {_SHOWN} FROM versions")
def scd2_versions(spark, d):
    return shown(versions(spark, d))


@query(f"WITH {VERSIONS_SQL} SELECT {_SHOWN} FROM versions")
def scd2_load_history(spark, d):
    """History in two loads, the second late and overlapping, equals one load of everything."""
    rows = marked(spark, d)
    first, late = rows.filter("_cdc_sequence % 7 <> 3"), rows.filter("_cdc_sequence % 7 = 3 OR _cdc_sequence % 50 = 0")
    return shown(cdc.scd2_merge(first, late, cdc.scd2(first, IDENTITY, TIES), IDENTITY, TIES))


@query(f"WITH {_EV} SELECT {_BRIEF} FROM ev WHERE user_id IN (SELECT user_id FROM ev WHERE _source_updated_at >= TIMESTAMP '2024-01-30 12:00:00')")
def scd2_affected(spark, d):
    rows = user_events(spark, d)
    return brief(cdc.affected_history(rows, rows.filter(F.col("_source_updated_at") >= F.lit("2024-01-30 12:00:00").cast("timestamp")), IDENTITY))


@query(f"""WITH {_EV} SELECT user_id, _cdc_sequence, CAST(2 AS BIGINT) AS variants FROM ev WHERE _cdc_sequence % 500 = 0""")
def scd2_tie_guard(spark, d):
    """The places of the order that a contradictory copy makes unsound."""
    rows = user_events(spark, d)
    odd = rows.filter("_cdc_sequence % 500 = 0").withColumn("_row_hash", F.lit("other"))
    return cdc.contradictions(rows.unionByName(odd), IDENTITY, TIES).select("user_id", "_cdc_sequence", "variants")


@query(f"WITH {_EV} SELECT {_BRIEF} FROM ev WHERE _source_effective_at >= TIMESTAMP '2024-01-10' AND _source_effective_at < TIMESTAMP '2024-01-12'")
def backfill_range(spark, d):
    return brief(cdc.backfill(user_events(spark, d), "2024-01-10 00:00:00", "2024-01-12 00:00:00", True))


@query(f"WITH {_EV} SELECT {_BRIEF} FROM ev WHERE _ingested_at >= (SELECT max(_ingested_at) - INTERVAL 48 HOUR FROM ev WHERE user_id % 2 = 0)")
def scd1_lookback(spark, d):
    rows = user_events(spark, d)
    return brief(cdc.lookback(rows, rows.filter("user_id % 2 = 0"), "_ingested_at", 48, "hours"))


@query(f"WITH {events_sql('soft-delete')} SELECT {_BRIEF} FROM ev WHERE _cdc_operation <> 'soft-delete'")
def scd_ignore_deletes(spark, d):
    return brief(cdc.handle_deletes(user_events(spark, d, "soft-delete"), "tombstone", "ignore"))


@query(f"WITH {_EV}, {_MARKED}, t AS (SELECT user_id, max(_source_effective_at) AS newest FROM m WHERE user_id % 2 = 0 GROUP BY 1) SELECT {_BRIEF} FROM m JOIN t USING (user_id) WHERE _source_effective_at < newest")
def late_arrivals(spark, d):
    rows = marked(spark, d)
    return brief(cdc.late_arrivals(rows, rows.filter("user_id % 2 = 0"), IDENTITY))


@query(f"WITH {_EV}, {_MARKED} SELECT {_BRIEF} FROM m WHERE _source_updated_at >= {_SPLIT} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {ORDER_DESC_SQL}) = 1")
def scd1_full_rebuild(spark, d):
    rows, cut = marked(spark, d), F.lit("2024-01-20 00:00:00").cast("timestamp")
    old = cdc.latest(rows.filter(F.col("_source_updated_at") < cut), IDENTITY, TIES)
    return brief(cdc.rebuild(old, cdc.latest(rows.filter(F.col("_source_updated_at") >= cut), IDENTITY, TIES), IDENTITY, True, True))
