"""Readers: CSV with a sniffed separator, Parquet, seeds, directories, catalogs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATORS = (",", ";", "\t", "|")
MOST_IMPORT_ROWS = 1000


def sniff_separator(header: str) -> str:
    """The separator that cuts the header line most often; a comma if none does."""
    return max(SEPARATORS, key=lambda s: (header.count(s), -SEPARATORS.index(s))) if header else ","


def read_csv(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Text columns under the header; a byte order mark is ignored."""
    first = spark.read.text(path).limit(1).collect()
    if not first or not first[0][0].strip("﻿ "):
        raise ValueError(f"{path} has no header")
    df = spark.read.csv(path, sep=sniff_separator(first[0][0]), header=True, inferSchema=False, multiLine=False)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df if limit is None else df.limit(limit)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_seed(spark: SparkSession, rows: Sequence[Mapping], schema: str) -> DataFrame:
    """A small static lookup given in code."""
    names = [c.split()[0] for c in schema.split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def read_directory(spark: SparkSession, path: str, form: str = "parquet", recursive: bool = True) -> DataFrame:
    """All files of one format below a folder, with their names."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower()).format(form)
    reader = reader.option("header", "true") if form == "csv" else reader
    return reader.load(path).withColumn("_file", F.input_file_name())


def introspect(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table, column, type, row_count, distinct_count``: one aggregate a table, exact counts."""
    parts = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(f"d{k}") for k, c in enumerate(df.columns)])
        rows = [
            F.struct(F.lit(name).alias("table"), F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("type"), F.col("n").alias("row_count"), F.col(f"d{k}").alias("distinct_count"))
            for k, c in enumerate(df.columns)
        ]
        part = one.select(F.inline(F.array(*rows)))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``table, column, status`` of two catalogs: added, removed, type-changed or unchanged."""
    a = old.select("table", "column", F.col("type").alias("old_type"))
    b = new.select("table", "column", F.col("type").alias("new_type"))
    status = (
        F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "type-changed").otherwise("unchanged")
    )
    return a.join(b, ["table", "column"], "full_outer").withColumn("status", status)


def distinct_scope(catalog: DataFrame) -> DataFrame:
    """Whether distinct counts hold for the table or a sample; only warehouses count whole tables."""
    warehouse = F.col("platform") == "warehouse"
    return catalog.withColumns(
        {
            "rows_sampled": F.when(~warehouse, F.col("row_count")),
            "distinct_scope": F.when(F.col("distinct_count").isNull(), F.lit(None)).when(warehouse, "table").otherwise("sample"),
        }
    )
