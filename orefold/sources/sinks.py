"""Sinks: full refresh, merge by keys, and swaps that leave the old table until the new one is whole."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cdc import merge


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def recover_table(spark: SparkSession, path: str) -> bool:
    """Put the old table back where a swap ended between its two renames; true if there was one to put back."""
    fs, target = _fs(spark, path)
    _, pattern = _fs(spark, f"{path}.old-*")
    aside = [s.getPath() for s in fs.globStatus(pattern) or ()]
    if fs.exists(target) or not aside:
        return False
    if len(aside) > 1:
        raise OSError(f"several old tables beside {path}")
    return fs.rename(aside[0], target)


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside the table and swap by renames; a failed write leaves the table as it was.

    A driver that dies between the renames leaves the old table beside its place; the next swap or ``recover_table`` puts it back.
    """
    recover_table(df.sparkSession, path)
    spark, beside = df.sparkSession, f"{path}.new-{uuid.uuid4().hex[:8]}"
    df.write.parquet(beside)
    fs, target = _fs(spark, path)
    _, fresh = _fs(spark, beside)
    _, old = _fs(spark, f"{path}.old-{uuid.uuid4().hex[:8]}")
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"can't move {path} away")
    if not fs.rename(fresh, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"can't put {path} in place")
    if had:
        fs.delete(old, True)


def merge_table(changes: DataFrame, path: str, keys: Sequence[str], on_schema_change: str = "fail") -> None:
    """Rows of the changes replace or join the table's by key; new columns only under ``append``."""
    spark = changes.sparkSession
    recover_table(spark, path)
    if not exists(spark, path):
        replace_table(changes, path)
        return
    target = spark.read.parquet(path)
    if set(target.columns) != set(changes.columns):
        if on_schema_change != "append" or not set(target.columns) <= set(changes.columns):
            raise ValueError("the table's columns differ")
        missing = [f for f in changes.schema if f.name not in target.columns]
        wide = target.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
        replace_table(merge(wide, changes, keys), path)
        return
    replace_table(merge(target, changes, keys), path)
