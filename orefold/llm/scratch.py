"""Intermediate tables in the folder that all executors share.

The folder is ``spark.checkpoint.dir`` of the session. Where it is unset on one machine (tests, notebooks)
a temporary folder is made and set; on a cluster that is an error. Tables are removed by ``free`` once what reads
them is written, the others when the application ends.
"""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from . import textkernel as tk

BATCH_BYTES = 4 << 20
_MADE: list[tuple[SparkSession, str]] = []
_SAVED: list[tuple[DataFrame, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: the session's setting, else the context's, else on one machine a new temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: executors need a folder that they share")
        found = tempfile.mkdtemp(prefix="orefold-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path for one table, unique to this call."""
    if not _MADE:
        atexit.register(_clear)
    path = f"{shared_dir(spark)}/orefold/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append((spark, path))
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    release()
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _SAVED.append((out, path))
    return out


def free(*tables: DataFrame) -> None:
    """Remove saved tables whose every reader has been written. Tables of other making are left alone."""
    for table in tables:
        for k, (df, path) in enumerate(_SAVED):
            if df is table:
                del _SAVED[k]
                _remove(df.sparkSession, path)
                break


def long_texts(spark: SparkSession) -> None:
    """Batches for Python hold at most ``BATCH_BYTES``, or one row, in this session from now on; a lower setting stays.

    The default of 10,000 rows and 64 MB would be tens of MB of whole texts, several times over, in every worker
    and its JVM. Rows are not limited, which would cost narrow rows a batch for each thousand.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key, None)  # None: unset, so Spark's default holds
    most = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(held) if held and held[0] != "-" else 0
    if not 0 < most <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def saved() -> int:
    """How many saved tables there are, for ``free_since``."""
    return len(_SAVED)


def free_since(count: int, *kept: DataFrame) -> None:
    """Remove the tables saved after the first ``count``, but for those that are kept."""
    free(*[df for df, _ in _SAVED[count:] if not any(df is k for k in kept)])


def release() -> None:
    """Give the memory of freed arrays back to the system; a long pipeline's driver would keep it."""
    gc.collect()
    tk.give_back()


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clear() -> None:
    for spark, path in _MADE:
        try:
            _remove(spark, path)
        except Exception:  # the application may have ended already
            return
