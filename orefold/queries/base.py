"""Registration of queries and the inputs that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import HEADER, canonical_hash
from ..functions.types import Kind
from ..operators import cdc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DEC = Kind("decimal", 18, 2)
IDENTITY, TIES = ["user_id"], ["_cdc_sequence"]


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(c) -> Column:
    """A timestamp as text with microseconds."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def money(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def user_events(spark: SparkSession, sf_dir: str, delete: str = "delete") -> DataFrame:
    """The event table as a stream of changes by user."""
    ts = F.col("ts").cast("timestamp")
    op = cdc.normalize_operation(F.col("event_type"), {"insert": ["signup"], "update": ["view", "click", "purchase"], delete: ["error"]})
    rows = table(spark, sf_dir, "events").select(
        "user_id", F.col("event_id").alias("_cdc_sequence"), op.alias("_cdc_operation"), F.date_trunc("day", ts).alias("_source_effective_at"),
        ts.alias("_source_updated_at"), (F.date_trunc("hour", ts) + F.expr("INTERVAL 1 HOUR")).alias("_ingested_at"), "event_type", money("value").alias("value"),
    )
    return rows.withColumn("_row_hash", canonical_hash([(F.col("event_type"), Kind("string")), (F.col("value"), DEC)]))


def hash_sql(*fields: tuple[str, str]) -> str:
    """The canonical hash of (SQL text expression, label) fields."""
    parts = [f"coalesce('{label}:V:' || strlen({e}) || ':' || lower(hex({e})) || ';', '{label}:N:0:;')" for e, label in fields]
    return f"sha256('{HEADER}' || " + " || ".join(parts) + ")"


def events_sql(delete: str = "delete") -> str:
    return f"""
ev AS (
  SELECT user_id, event_id AS _cdc_sequence,
         CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN '{delete}' ELSE 'update' END AS _cdc_operation,
         date_trunc('day', ts)::TIMESTAMP AS _source_effective_at, ts AS _source_updated_at,
         date_trunc('hour', ts)::TIMESTAMP + INTERVAL 1 HOUR AS _ingested_at, event_type, CAST(value AS DECIMAL(18,2)) AS value,
         {hash_sql(("event_type", "string"), ("CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR)", "decimal(18,2)"))} AS _row_hash
  FROM events
)"""


def stamp_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


ORDER_SQL = "_source_effective_at, _source_updated_at, _ingested_at, _cdc_sequence"
ORDER_DESC_SQL = "_source_effective_at DESC, _source_updated_at DESC, _ingested_at DESC, _cdc_sequence DESC"
