"""Source profiling: column statistics in one aggregate, shapes, keys, inclusion, grain and coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text_kinds as K
from .quality import bad_rows

#: Limits of the tags.
LOW_CARD = 50
CODE_LIST_ROWS = 500
SHAPE_SAMPLE = 200
FK_SAMPLE = 1000
FK_THRESHOLD = 0.98
VERSION_COLUMNS = ("updated_at", "modified_at", "valid_from", "valid_to", "version", "row_version")
FK_SUFFIXES = ("_id", "id", "_key", "_fk")


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, (a.cast("decimal(18,0)") / b.cast("decimal(18,0)")).cast("decimal(18,6)")).otherwise(F.lit(0).cast("decimal(18,6)"))


def profile_columns(df: DataFrame) -> DataFrame:
    """A row for each column: rows, nulls with blanks, exact distinct values, ratios and a tag.

    Blanks are nulls, but stay values for the distinct count.
    """
    names = df.columns
    aggs = [F.count("*").alias("rows")]
    for k, c in enumerate(names):
        aggs += [bad_rows(_blank(F.col(c))).alias(f"n{k}"), F.count_distinct(F.col(c)).alias(f"d{k}")]
    one = df.agg(*aggs)
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col("rows").alias("row_count"), F.coalesce(f"n{k}", F.lit(0)).cast("long").alias("null_count"), F.col(f"d{k}").alias("distinct_count"))
            for k, c in enumerate(names)
        ]
    )
    filled = F.col("row_count") - F.col("null_count")
    tag = (
        F.when(filled == 0, "empty").when(F.col("distinct_count") == 1, "const").when(F.col("distinct_count") == filled, "unique")
        .when(F.col("distinct_count") <= LOW_CARD, F.concat(F.lit("low-card("), F.col("distinct_count").cast("string"), F.lit(")"))).otherwise("")
    )
    return one.select(F.inline(rows)).withColumns(
        {"null_ratio": ratio(F.col("null_count"), F.col("row_count")), "distinct_ratio": ratio(F.col("distinct_count"), filled), "tag": tag}
    )


def shape_tag(name: str, data_type: T.DataType, values: Column, distinct: Column, filled: Column) -> Column:
    """The value shape from the type and an ordered sample of texts."""
    keyish = F.lit(name).rlike(K.KEYISH)
    share = F.when(filled > 0, distinct / filled).otherwise(0.0)
    if isinstance(data_type, T.BooleanType):
        return F.lit("bool")
    if isinstance(data_type, T.DateType | T.TimestampType | T.TimestampNTZType):
        return F.lit("date-like")
    if isinstance(data_type, T.DoubleType | T.FloatType | T.DecimalType):
        return F.lit("measure-like")
    if isinstance(data_type, T.IntegralType):
        return F.when((share > 0.95) | keyish, "id-like").otherwise("measure-like")
    head = F.slice(values, 1, 20)
    mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + F.length(v)) / F.greatest(F.size(values), F.lit(1))
    first = F.ltrim(F.get(values, 0))
    every = lambda p: F.forall(head, lambda v: v.rlike(p))
    return (
        F.when(F.size(values) == 0, "").when(every(K.FORMATS[0][1]), "id-like").when(every(K.ISO_DATE), "date-like")
        .when((first.startswith("{") | first.startswith("[")) & (mean > 20), "json").when((mean <= 12) & (distinct <= 100), "code-like")
        .when(mean > 40, "free-text").when(keyish & (share > 0.9), "id-like").otherwise("")
    )


def profile_shapes(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``column, shape``; text samples are the first values in the order, one column at a time."""
    stats = df.agg(*[e for k, c in enumerate(df.columns) for e in (F.count_distinct(c).alias(f"d{k}"), F.count(c).alias(f"f{k}"))])
    head = df.orderBy(*order).limit(SHAPE_SAMPLE)
    texts = [c for c in df.columns if isinstance(df.schema[c].dataType, T.StringType)]
    at = F.struct(*order)
    samples = head.agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(at.alias("o"), F.col(c).alias("v"))))), lambda x: x["v"]).alias(f"s_{c}") for c in texts] or [F.count("*").alias("__n")])
    both = stats.withColumn("__k", F.lit(1)).join(samples.withColumn("__k", F.lit(1)), "__k")
    rows = [
        F.struct(F.lit(c).alias("column"), shape_tag(c, df.schema[c].dataType, F.col(f"s_{c}") if c in texts else F.lit(None), F.col(f"d{k}"), F.col(f"f{k}")).alias("shape"))
        for k, c in enumerate(df.columns)
    ]
    return both.select(F.inline(F.array(*rows)))


def profile_table(columns: DataFrame, table: str) -> DataFrame:
    """``table, row_count, tag``: empty-table, versioned or code-list, from the column profile."""
    one = columns.agg(
        F.max("row_count").alias("row_count"), F.count("*").alias("n"), F.max(F.col("column").isin(*VERSION_COLUMNS)).alias("versioned"),
        F.count_if(F.col("tag").startswith("low-card") | (F.col("tag") == "unique")).alias("codes"),
    )
    tag = (
        F.when(F.col("row_count") == 0, "empty-table").when(F.col("versioned"), "versioned")
        .when((F.col("row_count") <= CODE_LIST_ROWS) & (F.col("codes") >= F.greatest(F.lit(2), F.floor(F.col("n") / 3))), "code-list").otherwise("")
    )
    return one.select(F.lit(table).alias("table"), "row_count", tag.alias("tag"))


def inclusion(child: DataFrame, column: str, parent: DataFrame, key: str, sample: int = FK_SAMPLE) -> DataFrame:
    """``hits, sampled, ratio, is_fk``: the first distinct values of the child that the unique key holds."""
    values = child.select(F.col(column).alias("v")).dropna().distinct().orderBy("v").limit(sample)
    keys = parent.select(F.col(key).alias("v"), F.lit(1).alias("hit")).distinct()
    sums = values.join(keys, "v", "left").agg(F.count("hit").alias("hits"), F.count("*").alias("sampled"))
    return sums.withColumn("ratio", ratio(F.col("hits"), F.col("sampled"))).withColumn("is_fk", F.col("ratio") >= FK_THRESHOLD)


def inferred_type(c: Column) -> list[Column]:
    """Aggregates that decide the type of a text column: bit, datetime, date, int, bigint, decimal or text."""
    t = F.trim(c)
    every = lambda test: F.coalesce(F.min(test.cast("int")), F.lit(0)) == 1
    whole = t.rlike(r"^[+-]?\d+$")
    date = t.rlike(K.DATE_FORMS[0]) | t.rlike(K.DATE_FORMS[1]) | t.rlike(K.DATE_FORMS[2])
    wide = F.max(F.abs(t.try_cast("decimal(38,0)"))) > 2147483647
    return [
        F.when(F.count(t) == 0, "varchar(max)").when(every(F.lower(t).isin(*K.TRUTH_WORDS)), "bit").when(every(t.rlike(K.DATETIME_FORM)), "datetime")
        .when(every(date), "date").when(every(whole), F.when(wide, "bigint").otherwise("int"))
        .when(every(t.try_cast("double").isNotNull()), "decimal").otherwise("varchar(max)")
    ]


def infer_types(df: DataFrame, columns: Sequence[str], most: int = 100) -> DataFrame:
    """``column, type`` from each column's first distinct non-blank texts, in order of value; one scan for all columns."""
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")
    values = df.select(named).select("x.*").filter(F.trim("v") != "").distinct()
    w = Window.partitionBy("column").orderBy("v")
    first = values.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most)
    found = first.groupBy("column").agg(*[e.alias("type") for e in inferred_type(F.col("v"))])
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "`column` string")
    return every.join(found, "column", "left").select("column", F.coalesce("type", F.lit("varchar(max)")).alias("type"))


def format_hints(samples: DataFrame) -> DataFrame:
    """``column, hint, pattern`` from rows ``column, value``: the first format that all samples match, and the only one."""
    aggs = [F.min(F.col("value").rlike(p).cast("int")).alias(n) for n, p in K.FORMATS]
    got = samples.groupBy("column").agg(*aggs)
    first = F.coalesce(*[F.when(F.col(n) == 1, n) for n, _ in K.FORMATS])
    matched = F.filter(F.array(*[F.when(F.col(n) == 1, n) for n, _ in K.FORMATS]), lambda x: x.isNotNull())
    return got.select("column", first.alias("hint"), F.when(F.size(matched) == 1, F.get(matched, 0)).alias("pattern"))


def enum_suggestions(profile: DataFrame, threshold: int = 50, least_rows: int = 100, most_ratio: float = 0.1) -> DataFrame:
    d, n = F.col("distinct_count"), F.col("row_count")
    return profile.filter((n >= least_rows) & (d > 1) & (d <= threshold) & (d / n < most_ratio)).select("column", "distinct_count", "row_count")


def fk_suggestions(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """``table, column, target, confidence``: high by name, else medium where counts are within 5 %.

    ``columns`` has table, column, distinct_count; ``tables`` has table, row_count. A catalog is small.
    """
    plain = F.lower("column")
    stem = F.regexp_replace(plain, "(_id|_key|_fk|id)$", "")
    c = columns.withColumn("stem", F.when(stem != plain, stem)).filter(F.col("stem").isNotNull() & (F.col("stem") != ""))
    t = tables.select(F.col("table").alias("target"), "row_count", F.regexp_replace(F.lower("table"), "^tbl", "").alias("plain"))
    forms = F.explode(F.array_distinct(F.array(F.col("plain"), F.concat("plain", F.lit("s")), F.regexp_replace("plain", "s$", "")))).alias("stem")
    named = c.join(t.select("target", forms), "stem").filter("target <> table").select("table", "column", "target").distinct()
    named = named.withColumn("confidence", F.lit("high"))
    low, high = F.floor(F.col("row_count") * 0.95), F.ceil(F.col("row_count") * 1.05)
    spread = t.select("target", F.explode(F.sequence(low, high)).alias("distinct_count"))
    rest = c.join(named.select("table", "column"), ["table", "column"], "left_anti").join(spread, "distinct_count").filter("target <> table")
    return named.unionByName(rest.select("table", "column", "target", F.lit("medium").alias("confidence")))


def name_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Equal normalized column names of two catalogs (table, column)."""
    plain = lambda: F.regexp_replace(F.lower("column"), "[^a-z0-9]|^[a-z]{1,2}_", "")
    a = left.select(F.col("table").alias("left_table"), F.col("column").alias("left_column"), plain().alias("name"))
    b = right.select(F.col("table").alias("right_table"), F.col("column").alias("right_column"), plain().alias("name"))
    return a.join(b, "name")


def grain_proposal(profile: DataFrame) -> DataFrame:
    """The non-null column with most distinct values; ties by name."""
    w = Window.orderBy(F.desc("distinct_count"), "column")
    return profile.filter("null_count = 0").withColumn("__n", F.row_number().over(w)).filter("__n = 1").select("column", "distinct_count")


def dominant_shape(values: DataFrame, column: str, order: str) -> DataFrame:
    """The most frequent sample shape; ties to the one seen first."""
    rows = values.filter(F.col(column).isNotNull()).select(K.sample_shape(F.col(column)).alias("shape"), order)
    counts = rows.groupBy("shape").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(1).select("shape", "n")


def technical_columns(profile: DataFrame, known: Sequence[str]) -> DataFrame:
    """Known names that are constant in every table that profiles (table, column, distinct_count) list."""
    n = profile.select("table").distinct().count()
    return (
        profile.filter((F.col("distinct_count") <= 1) & F.lower("column").isin(*known)).groupBy("column").agg(F.count_distinct("table").alias("tables"))
        .filter(F.col("tables") == n).select("column", "tables")
    )


def coverage(catalog: DataFrame, used: DataFrame) -> DataFrame:
    """``table, columns, mapped, ratio`` of catalog columns that bindings use."""
    marked = catalog.select("table", "column").join(used.select("table", "column", F.lit(1).alias("hit")).distinct(), ["table", "column"], "left")
    sums = marked.groupBy("table").agg(F.count("*").alias("columns"), F.count("hit").alias("mapped"))
    return sums.withColumn("ratio", ratio(F.col("mapped"), F.col("columns")))


def uncovered(catalog: DataFrame, used: DataFrame) -> DataFrame:
    """Columns with more than one value that no binding uses."""
    return catalog.filter("distinct_count > 1").join(used.select("table", "column"), ["table", "column"], "left_anti")


def sample_coverage(catalog: DataFrame) -> DataFrame:
    """Share of tables with at least one sampled column, 1 without tables."""
    per = catalog.groupBy("table").agg(F.max((F.col("samples") > 0).cast("int")).alias("has"))
    return per.agg(F.count("*").alias("tables"), F.coalesce(F.sum("has"), F.lit(0)).alias("sampled")).withColumn(
        "ratio", F.when(F.col("tables") == 0, F.lit(1).cast("decimal(18,4)")).otherwise((F.col("sampled") / F.col("tables")).cast("decimal(18,4)"))
    )


def shape_conflicts(shapes: DataFrame) -> DataFrame:
    """Properties whose sources have different dominant shapes (property, source, shape)."""
    return shapes.groupBy("property").agg(F.count_distinct("shape").alias("shapes")).filter("shapes > 1")


def disposition_gaps(tables: DataFrame, bound: DataFrame, disposed: DataFrame, least_rows: int) -> DataFrame:
    """Tables above the threshold that are neither bound nor disposed of."""
    return tables.filter(F.col("row_count") > least_rows).join(bound.select("table"), "table", "left_anti").join(disposed.select("table"), "table", "left_anti")


def gdpr_gaps(properties: DataFrame, protected: DataFrame) -> DataFrame:
    """Personal-data names (class, property, range) of classes that are not protected; flags and codes are exempt."""
    words = "|".join(K.PII_NAMES)
    plain = F.lower(F.regexp_replace("property", "(?<=[a-z0-9])(?=[A-Z])", "_"))
    named = properties.filter(plain.rlike(words) & (F.col("range") != "boolean") & ~F.col("property").endswith("Code"))
    return named.join(protected.select("class"), "class", "left_anti")


def split_out(df: DataFrame, parts: Mapping[str, str]) -> DataFrame:
    """The distinct rows of an entity flattened into another table; rows without any part don't count."""
    return df.select(*[F.col(c).alias(n) for c, n in parts.items()]).dropna(how="all").distinct()
