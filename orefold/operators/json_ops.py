"""JSON text columns: detection, keys, shape and child rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def looks_like_json(c: Column) -> Column:
    """Aggregate: at least half of the samples start like JSON."""
    t = F.ltrim(c)
    return F.avg((t.startswith("{") | t.startswith("[")).cast("double")) >= 0.5


def key_types(df: DataFrame, column: str) -> DataFrame:
    """``key, type, rows`` of the top-level keys of objects; the type of non-null values, else null."""
    keyed = df.select(F.col(column).alias("j"), F.explode(F.json_object_keys(column)).alias("key"))
    value = F.call_function("get_json_object", F.col("j"), F.concat(F.lit("$."), F.col("key")))
    kind = (
        F.when(value.isNull(), F.lit(None)).when(value.startswith("{"), "object").when(value.startswith("["), "array")
        .when(value.isin("true", "false"), "boolean").when(value.rlike(r"^-?\d+$"), "integer").when(value.rlike(r"^-?\d+\.\d+([eE][+-]?\d+)?$"), "number").otherwise("string")
    )
    return keyed.groupBy("key").agg(F.max(kind).alias("type"), F.count("*").alias("rows"))


def classify(df: DataFrame, column: str) -> DataFrame:
    """``shape``: flat, nested, array_object, array_primitive or polymorphic, of all parseable texts."""
    t = F.trim(F.col(column))
    rows = df.select(t.alias("j")).filter("j <> ''").withColumn("v", F.try_parse_json("j")).filter("v is not null")
    kind = F.schema_of_variant("v")
    keys = F.when(kind.startswith("OBJECT"), F.json_object_keys("j"))
    nested = kind.rlike(r"^OBJECT<.*(OBJECT|ARRAY)<")
    of_objects = kind.rlike("^ARRAY<OBJECT<")
    per_key = rows.select(F.explode(keys).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    sums = rows.agg(
        F.count("*").alias("n"), F.count_if(kind.startswith("OBJECT")).alias("objects"), F.count_if(kind.startswith("ARRAY")).alias("arrays"),
        F.max(nested).alias("nested"), F.count_if(of_objects).alias("rows_of_objects"), F.count_if(kind.rlike("^ARRAY<VOID>")).alias("blank"),
    )
    odd = per_key.agg(F.count("*").alias("all_keys"), F.max("n").alias("top"), F.collect_list("n").alias("ns"))
    both = sums.withColumn("__k", F.lit(1)).join(odd.withColumn("__k", F.lit(1)), "__k")
    rare = F.size(F.filter("ns", lambda x: x < F.col("n")))
    shape = (
        F.when(F.col("n") == 0, "polymorphic")
        .when(F.col("objects") == F.col("n"), F.when(rare / F.greatest("all_keys", F.lit(1)) > 0.5, "polymorphic").when(F.col("nested"), "nested").otherwise("flat"))
        .when(F.col("arrays") == F.col("n"), F.when((F.col("rows_of_objects") > 0) & (F.col("rows_of_objects") + F.col("blank") == F.col("n")), "array_object").otherwise("array_primitive"))
        .otherwise("polymorphic")
    )
    return both.select(shape.alias("shape"))


def flatten(df: DataFrame, column: str, fields: Mapping[str, str]) -> DataFrame:
    """Typed columns of a JSON object for each declared field."""
    schema = ", ".join(f"`{n}` {t}" for n, t in fields.items())
    return df.withColumn("__j", F.from_json(column, schema)).select(*df.columns, *[F.col(f"__j.{n}").alias(n) for n in fields]).drop("__j")


def children(df: DataFrame, key: str, column: str, element: str = "string", keep_childless: bool = False) -> DataFrame:
    """``key, element_index, element`` for each array element; parents without any only on request."""
    split = F.posexplode_outer if keep_childless else F.posexplode
    return df.select(key, split(F.from_json(column, f"array<{element}>")).alias("element_index", "element"))
