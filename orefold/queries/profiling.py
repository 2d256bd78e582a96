"""Profiles, shapes, types, personal data, keys and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text_kinds as K
from ..operators import profile as P
from ..sources import readers
from .base import query, table

_R6 = "CAST(round(CAST({a} AS DOUBLE) / {b}, 6) AS DECIMAL(18,6))"


def _profile_sql(rel: str, columns: list[str]) -> str:
    one = """SELECT '{c}' AS "column", count(*) AS row_count, CAST(sum(CASE WHEN trim(coalesce(CAST({c} AS VARCHAR), '')) = '' THEN 1 ELSE 0 END) AS BIGINT) AS null_count, count(DISTINCT {c}) AS distinct_count FROM {rel}"""
    parts = " UNION ALL ".join(one.format(c=c, rel=rel) for c in columns)
    return f"""SELECT *, {_R6.format(a="null_count", b="row_count")} AS null_ratio,
 CASE WHEN row_count = null_count THEN CAST(0 AS DECIMAL(18,6)) ELSE {_R6.format(a="distinct_count", b="(row_count - null_count)")} END AS distinct_ratio,
 CASE WHEN row_count = null_count THEN 'empty' WHEN distinct_count = 1 THEN 'const' WHEN distinct_count = row_count - null_count THEN 'unique' WHEN distinct_count <= 50 THEN 'low-card(' || distinct_count || ')' ELSE '' END AS tag FROM ({parts})"""


_CUST = "(SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE nullif(c_mktsegment, 'BUILDING') END AS segment, 'x' AS fixed, CAST(NULL AS VARCHAR) AS nothing FROM customer)"
_COLS = ["c_custkey", "c_name", "c_nationkey", "segment", "fixed", "nothing"]


def _cust(spark, d):
    seg = F.when(F.col("c_custkey") % 5 == 0, F.lit(" ")).otherwise(F.nullif("c_mktsegment", F.lit("BUILDING")))
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", seg.alias("segment"), F.lit("x").alias("fixed"), F.lit(None).cast("string").alias("nothing"))


@query(_profile_sql(_CUST, _COLS))
def profile_columns(spark, d):
    return P.profile_columns(_cust(spark, d))


@query("""SELECT * FROM (VALUES ('c_custkey', 'id-like'), ('c_name', ''), ('c_nationkey', 'measure-like'), ('segment', 'code-like'), ('fixed', 'code-like'), ('nothing', ''), ('c_acctbal', 'measure-like'), ('day', 'date-like')) t("column", shape)""")
def profile_shapes(spark, d):
    df = _cust(spark, d).join(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey").withColumn("day", F.lit("2024-01-01").cast("date"))
    return P.profile_shapes(df, ["c_custkey"])


@query("""SELECT 'region' AS "table", count(*) AS row_count, 'code-list' AS tag FROM region UNION ALL SELECT 'orders', count(*), '' FROM orders UNION ALL SELECT 'none', 0, 'empty-table'""")
def profile_tables(spark, d):
    r, o = table(spark, d, "region"), table(spark, d, "orders")
    parts = [P.profile_table(P.profile_columns(df), n) for df, n in ((r, "region"), (o, "orders"), (r.filter("r_regionkey < 0"), "none"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""WITH v AS (SELECT DISTINCT o_custkey AS v FROM orders WHERE o_custkey IS NOT NULL ORDER BY 1 LIMIT 1000), s AS (SELECT count(c_custkey) AS hits, count(*) AS sampled FROM v LEFT JOIN customer ON v = c_custkey)
SELECT hits, sampled, CAST(round(CAST(hits AS DOUBLE) / sampled, 6) AS DECIMAL(18,6)) AS ratio, hits / sampled >= 0.98 AS is_fk FROM s""")
def fk_inclusion(spark, d):
    return P.inclusion(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer"), "c_custkey")


@query("""SELECT * FROM (VALUES ('flag', 'bit'), ('day', 'date'), ('at', 'datetime'), ('small', 'int'), ('big', 'bigint'), ('price', 'decimal'), ('word', 'varchar(max)'), ('nil', 'varchar(max)')) t("column", type)""")
def infer_types(spark, d):
    c = F.col("o_orderkey")
    df = table(spark, d, "orders").select(
        F.when(c % 2 == 0, "yes").otherwise("no").alias("flag"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("at"),
        (c + 2).cast("string").alias("small"), (c + 3_000_000_000).cast("string").alias("big"), F.col("o_totalprice").cast("string").alias("price"), F.col("o_orderpriority").alias("word"),
        F.lit(" ").alias("nil"),
    )
    return P.infer_types(df, df.columns)


#: The columns that formats are looked for in, as SQL and, below, as Spark expressions.
_SAMPLES_SQL = """(SELECT 'mail' AS "column", 'u' || o_custkey || '@mail.org' AS value FROM orders UNION ALL SELECT 'day', strftime(o_orderdate, '%Y-%m-%d') FROM orders
 UNION ALL SELECT 'site', 'https://x.org/' || o_orderkey FROM orders UNION ALL SELECT 'tel', '+32 470 12 ' || (10 + o_custkey % 90) FROM orders UNION ALL SELECT 'code', CAST(10 + o_custkey % 90 AS VARCHAR) FROM orders
 UNION ALL SELECT 'long', CAST(1000000 + o_custkey AS VARCHAR) FROM orders UNION ALL SELECT 'mix', CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '45' END FROM orders)"""
_FORMAT_TESTS = " UNION ALL ".join(
    f"""SELECT "column", {k} AS place, '{n}' AS name FROM {_SAMPLES_SQL} GROUP BY "column" HAVING bool_and(regexp_matches(value, '{p}'))""" for k, (n, p) in enumerate(K.FORMATS)
)


def _samples(spark, d):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    values = {
        "mail": text("u", cust, "@mail.org"), "day": F.date_format("o_orderdate", "yyyy-MM-dd"), "site": text("https://x.org/", key), "tel": text("+32 470 12 ", 10 + cust % 90),
        "code": (10 + cust % 90).cast("string"), "long": (1_000_000 + cust).cast("string"), "mix": F.when(key % 2 == 0, F.col("o_orderpriority")).otherwise("45"),
    }
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), v.alias("value")) for n, v in values.items()])).alias("x")
    return table(spark, d, "orders").select(pairs).select("x.*")


@query(f"""SELECT c."column", f.name AS hint, CASE WHEN o.n = 1 THEN o.only_name END AS pattern FROM (SELECT DISTINCT "column" FROM {_SAMPLES_SQL}) c
LEFT JOIN ({_FORMAT_TESTS}) f ON c."column" = f."column" AND f.place = (SELECT min(place) FROM ({_FORMAT_TESTS}) g WHERE g."column" = c."column")
LEFT JOIN (SELECT "column", count(*) AS n, min(name) AS only_name FROM ({_FORMAT_TESTS}) GROUP BY 1) o ON c."column" = o."column" """)
def format_hint(spark, d):
    return P.format_hints(_samples(spark, d))


@query(f"""SELECT "column", min(name) AS pattern FROM ({_FORMAT_TESTS}) GROUP BY 1 HAVING count(*) = 1""")
def format_pattern(spark, d):
    return P.format_hints(_samples(spark, d)).filter("pattern is not null").select("column", "pattern")


@query(f"""SELECT "column", distinct_count, row_count FROM ({_profile_sql('orders', ['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_orderpriority'])}) WHERE row_count >= 100 AND distinct_count > 1 AND distinct_count <= 50 AND CAST(distinct_count AS DOUBLE) / row_count < 0.1""")
def enum_suggest(spark, d):
    return P.enum_suggestions(P.profile_columns(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")))


@query("""SELECT o_orderstatus AS code, count(*) AS n FROM orders WHERE (SELECT count(DISTINCT o_orderstatus) FROM orders) <= 12 GROUP BY 1""")
def enum_candidates(spark, d):
    o = table(spark, d, "orders")
    few = o.select("o_orderstatus").distinct().limit(13).count() <= 12
    return o.filter(F.lit(few)).groupBy(F.col("o_orderstatus").alias("code")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT count(DISTINCT o_custkey) AS custs, count(DISTINCT o_orderpriority) AS priorities FROM orders), n AS (SELECT (SELECT count(*) FROM customer) AS custs, (SELECT count(*) FROM region) AS areas)
SELECT 'sales' AS "table", 'customer_id' AS "column", 'customer' AS target, 'high' AS confidence UNION ALL SELECT 'sales', 'area_key', 'tblArea', 'high'
UNION ALL SELECT 'sales', 'rank_fk', 'tblArea', 'medium' FROM s, n WHERE s.priorities BETWEEN floor(n.areas * 0.95) AND ceil(n.areas * 1.05)
UNION ALL SELECT 'sales', 'rank_fk', 'customer', 'medium' FROM s, n WHERE s.priorities BETWEEN floor(n.custs * 0.95) AND ceil(n.custs * 1.05)""")
def fk_suggest(spark, d):
    sales = table(spark, d, "orders").select(F.col("o_custkey").alias("customer_id"), (F.col("o_custkey") % 5).alias("area_key"), F.col("o_orderpriority").alias("rank_fk"), F.col("o_totalprice").alias("amount"))
    catalog = readers.introspect({"sales": sales, "customer": table(spark, d, "customer").select("c_name"), "tblArea": table(spark, d, "region").select("r_name")})
    columns = catalog.filter(F.col("table") == "sales").select("table", "column", "distinct_count")
    return P.fk_suggestions(columns, catalog.groupBy("table").agg(F.max("row_count").alias("row_count")))


@query("""SELECT 'customer' AS left_table, 'c_name' AS left_column, 'supplier' AS right_table, 's_name' AS right_column, 'name' AS name UNION ALL SELECT 'customer', 'c_nationkey', 'supplier', 's_nationkey', 'nationkey' UNION ALL SELECT 'customer', 'c_acctbal', 'supplier', 's_acctbal', 'acctbal'""")
def fk_name_match(spark, d):
    cat = {t: readers.introspect({t: table(spark, d, t)}) for t in ("customer", "supplier")}
    return P.name_matches(cat["customer"], cat["supplier"])


@query(f"""SELECT "column", distinct_count FROM ({_profile_sql('orders', ['o_orderkey', 'o_custkey', 'o_orderstatus'])}) WHERE null_count = 0 ORDER BY distinct_count DESC, "column" LIMIT 1""")
def grain_proposal(spark, d):
    return P.grain_proposal(P.profile_columns(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")))


_SHAPE = """CASE WHEN t = '' THEN 'blank' WHEN regexp_matches(t, '^-?\\d+([,.]\\d+)?$') THEN 'numeric' WHEN regexp_matches(t, '^\\d{4}-\\d{2}-\\d{2}') THEN 'date' WHEN lower(t) IN ('0','1','true','false','yes','no','y','n') THEN 'boolean'
 WHEN regexp_matches(t, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') THEN 'email' WHEN regexp_matches(t, '^[A-Za-z0-9_-]{2,20}$') THEN 'code' WHEN t IS NOT NULL THEN 'text' END"""
_VALUES = """(SELECT o_orderkey, trim(CASE o_orderkey % 7 WHEN 0 THEN ' ' WHEN 1 THEN CAST(o_custkey AS VARCHAR) WHEN 2 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) WHEN 3 THEN 'Yes' WHEN 4 THEN 'u' || o_custkey || '@mail.org' WHEN 5 THEN o_orderpriority END) AS t FROM orders)"""


def _values(spark, d):
    k = F.col("o_orderkey") % 7
    v = (
        F.when(k == 0, " ").when(k == 1, F.col("o_custkey").cast("string")).when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 3, "Yes")
        .when(k == 4, F.concat(F.lit("u"), F.col("o_custkey").cast("string"), F.lit("@mail.org"))).when(k == 5, F.col("o_orderpriority"))
    )
    return table(spark, d, "orders").select("o_orderkey", v.alias("v"))


@query(f"SELECT o_orderkey, {_SHAPE} AS shape FROM {_VALUES}")
def sample_shape(spark, d):
    return _values(spark, d).select("o_orderkey", K.sample_shape(F.col("v")).alias("shape"))


@query(f"SELECT shape, count(*) AS n FROM (SELECT o_orderkey, {_SHAPE} AS shape FROM {_VALUES} WHERE t IS NOT NULL) GROUP BY 1 ORDER BY 2 DESC, min(o_orderkey) LIMIT 1")
def dominant_shape(spark, d):
    return P.dominant_shape(_values(spark, d), "v", "o_orderkey")


@query(f"""SELECT count(t) AS total, count(*) FILTER (WHERE TRY_CAST(replace(t, ',', '.') AS DOUBLE) IS NOT NULL AND t <> '') AS as_number, count(*) FILTER (WHERE regexp_matches(t, '^\\d{{4}}-\\d{{2}}-\\d{{2}}')) AS as_date,
 count(*) FILTER (WHERE lower(t) IN ('0','1','true','false','yes','no','y','n')) AS as_flag FROM {_VALUES}""")
def parse_as(spark, d):
    v = F.col("v")
    return _values(spark, d).agg(F.count("v").alias("total"), F.count_if(K.parses_as(v, "int")).alias("as_number"), F.count_if(K.parses_as(v, "date")).alias("as_date"), F.count_if(K.parses_as(v, "bit")).alias("as_flag"))


@query("""SELECT * FROM (VALUES ('customer_email', 'email'), ('homeAddress', 'address'), ('firstName', 'first_name')) t("column", kind)""")
def pii_columns(spark, d):
    names = ["customer_email", "homeAddress", "firstName", "amount", "created_at"]
    return spark.createDataFrame([(n, k) for n in names if (k := K.pii_name_kind(n))], "`column` string, kind string")


@query()
def pii_values(spark, d):
    """What each document holds; its SQL would need look-behind, so tests hold it against plain Python."""
    return table(spark, d, "documents").select("doc_id", K.pii_value_kind(F.col("text")).alias("kind"))


@query("""WITH s AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN CAST(CAST(s_acctbal / 50 AS DECIMAL(18,2)) AS VARCHAR) WHEN 1 THEN CAST(s_nationkey AS VARCHAR) WHEN 2 THEN '51.33, ' || s_nationkey || '.25' ELSE s_name END AS v FROM supplier)
SELECT s_suppkey, CASE WHEN regexp_matches(v, '^[+-]?\\d+\\.\\d+$') AND TRY_CAST(v AS DOUBLE) BETWEEN -90 AND 90 THEN 'location'
 WHEN regexp_matches(v, '^51[.]33, [0-9]+[.]25$') THEN 'location' END AS kind FROM s""")
def pii_location(spark, d):
    k = F.col("s_suppkey") % 4
    v = F.when(k == 0, (F.col("s_acctbal") / 50).cast("decimal(18,2)").cast("string")).when(k == 1, F.col("s_nationkey").cast("string")).when(k == 2, F.concat(F.lit("51.33, "), F.col("s_nationkey").cast("string"), F.lit(".25"))).otherwise(F.col("s_name"))
    return table(spark, d, "supplier").select("s_suppkey", K.location_kind("site_latitude", v).alias("kind"))


@query()
def redact_rows(spark, d):
    """Every document's text with its kind of personal data; its SQL would need look-behind, so tests hold it against plain Python."""
    kind = K.pii_value_kind(F.col("text"))
    return table(spark, d, "documents").select("doc_id", kind.alias("kind"), K.redacted(F.col("text"), kind, "documents", "text", "string").alias("cell"))


@query("""WITH v AS (SELECT c_custkey, trim(CASE c_custkey % 5 WHEN 0 THEN 'u' || c_custkey || '@mail.org' WHEN 1 THEN CAST(100000000 + c_custkey AS VARCHAR) WHEN 2 THEN '+32 470 ' || (10 + c_custkey % 90) || ' 11' WHEN 3 THEN ' ' ELSE c_name END) AS t FROM customer)
SELECT c_custkey, CASE WHEN t = '' THEN t WHEN c_custkey % 5 = 0 THEN left('u' || c_custkey, 2) || '***@***.org' WHEN c_custkey % 5 IN (1, 2) THEN repeat('*', greatest(length(t) - 2, 1)) || right(t, 2) ELSE left(t, 1) || '***' END AS masked FROM v""")
def mask_values(spark, d):
    k, c = F.col("c_custkey") % 5, F.col("c_custkey")
    v = (
        F.when(k == 0, F.concat(F.lit("u"), c.cast("string"), F.lit("@mail.org"))).when(k == 1, (100_000_000 + c).cast("string"))
        .when(k == 2, F.concat(F.lit("+32 470 "), (10 + c % 90).cast("string"), F.lit(" 11"))).when(k == 3, F.lit(" ")).otherwise(F.col("c_name"))
    )
    return table(spark, d, "customer").select("c_custkey", K.masked(v).alias("masked"))


def _used(spark):
    return spark.createDataFrame([("supplier", "s_suppkey"), ("supplier", "s_name"), ("nation", "n_nationkey")], "`table` string, `column` string")


def _catalog(spark, d):
    return readers.introspect({t: table(spark, d, t) for t in ("supplier", "nation", "region")})


@query("""SELECT * FROM (VALUES ('supplier', 4, 2, CAST(0.5 AS DECIMAL(18,6))), ('nation', 3, 1, CAST(0.333333 AS DECIMAL(18,6))), ('region', 2, 0, CAST(0 AS DECIMAL(18,6)))) t("table", "columns", mapped, ratio)""")
def coverage(spark, d):
    return P.coverage(_catalog(spark, d), _used(spark))


@query("""SELECT * FROM (VALUES ('supplier', 's_nationkey'), ('supplier', 's_acctbal'), ('nation', 'n_name'), ('nation', 'n_regionkey'), ('region', 'r_regionkey'), ('region', 'r_name')) t("table", "column")""")
def coverage_orphans(spark, d):
    return P.uncovered(_catalog(spark, d), _used(spark)).select("table", "column")


@query("""WITH b AS (SELECT (SELECT count(DISTINCT c_nationkey) FROM customer) AS a, (SELECT count(DISTINCT s_nationkey) FROM supplier) AS b)
SELECT 'tenant' AS "column", 2 AS tables UNION ALL SELECT 'batch', 2 FROM b WHERE a <= 1 AND b <= 1""")
def technical_columns(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    marked = lambda df, key: df.select("*", F.lit("t1").alias("tenant"), F.col(key).alias("batch"))
    return P.technical_columns(readers.introspect({"customer": marked(c, "c_nationkey"), "supplier": marked(s, "s_nationkey")}).select("table", "column", "distinct_count"), ["tenant", "batch"])


@query("""WITH t AS (SELECT count(DISTINCT c_mktsegment) BETWEEN 2 AND 50 AS a FROM customer), u AS (SELECT count(DISTINCT r_name) BETWEEN 2 AND 50 AS a FROM region), w AS (SELECT count(DISTINCT o_orderkey) BETWEEN 2 AND 50 AS a FROM orders),
x AS (SELECT * FROM t UNION ALL SELECT * FROM u UNION ALL SELECT * FROM w)
SELECT count(*) AS tables, CAST(sum(CAST(a AS INTEGER)) AS BIGINT) AS sampled, CAST(sum(CAST(a AS INTEGER)) / count(*) AS DECIMAL(18,4)) AS ratio FROM x""")
def sample_coverage(spark, d):
    kept = readers.introspect({"customer": table(spark, d, "customer").select("c_mktsegment"), "region": table(spark, d, "region").select("r_name"), "orders": table(spark, d, "orders").select("o_orderkey")})
    return P.sample_coverage(kept.select("table", F.when(F.col("distinct_count").between(2, 50), F.col("distinct_count")).otherwise(0).alias("samples")))


_SHAPED = """SELECT '{p}' AS property, '{s}' AS source, shape FROM (SELECT {shape} AS shape, min(k) AS seen, count(*) AS n FROM (SELECT trim(CAST({c} AS VARCHAR)) AS t, {k} AS k FROM {r}) WHERE t IS NOT NULL GROUP BY 1 ORDER BY n DESC, seen LIMIT 1)"""
_SHAPE_SOURCES = (("nation", "crm", "customer", "c_nationkey", "c_custkey"), ("nation", "erp", "nation", "n_name", "n_nationkey"), ("name", "crm", "customer", "c_name", "c_custkey"), ("name", "erp", "supplier", "s_name", "s_suppkey"))


@query("SELECT property, count(DISTINCT shape) AS shapes FROM (" + " UNION ALL ".join(f"SELECT * FROM ({_SHAPED.format(p=p, s=s, r=r, c=c, k=k, shape=_SHAPE)})" for p, s, r, c, k in _SHAPE_SOURCES) + ") GROUP BY 1 HAVING count(DISTINCT shape) > 1")
def audit_shapes(spark, d):
    parts = [P.dominant_shape(table(spark, d, r), c, k).select(F.lit(p).alias("property"), F.lit(s).alias("source"), "shape") for p, s, r, c, k in _SHAPE_SOURCES]
    return P.shape_conflicts(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))


@query("""SELECT * FROM (SELECT 'lineitem' AS "table", count(*) AS row_count FROM lineitem UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'region', count(*) FROM region) WHERE row_count > 100""")
def disposition_gaps(spark, d):
    names = ("lineitem", "orders", "customer", "part", "region")
    counted = [table(spark, d, n).agg(F.lit(n).alias("table"), F.count("*").alias("row_count")) for n in names]
    tables = counted[0]
    for more in counted[1:]:
        tables = tables.unionByName(more)
    one = lambda n: spark.createDataFrame([(n,)], "`table` string")
    return P.disposition_gaps(tables, one("orders"), one("customer"), 100)


@query("""SELECT 'Person' AS class, 'firstName' AS property, 'string' AS range""")
def gdpr_gaps(spark, d):
    rows = [("Person", "firstName", "string"), ("Person", "emailVerified", "boolean"), ("Person", "genderCode", "string"), ("Vault", "iban", "string"), ("Person", "age", "int")]
    return P.gdpr_gaps(spark.createDataFrame(rows, "class string, property string, range string"), spark.createDataFrame([("Vault",)], "class string"))


@query("SELECT DISTINCT c_nationkey AS country, c_mktsegment AS segment FROM customer")
def entity_splitout(spark, d):
    return P.split_out(table(spark, d, "customer"), {"c_nationkey": "country", "c_mktsegment": "segment"})


@query("SELECT 'customer' AS left_table, 'c_name' AS left_column UNION ALL SELECT 'customer', 'c_nationkey'")
def name_match(spark, d):
    a = readers.introspect({"customer": table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")})
    b = readers.introspect({"nation": table(spark, d, "nation").select(F.col("n_name").alias("Name"), F.col("n_nationkey").alias("NationKey"))})
    return P.name_matches(a, b).select("left_table", "left_column")
