"""Projections, the scalar language, macros, keys, hashes and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import macros as M
from ..functions.expr import compile_expr
from ..functions.types import Kind
from ..operators import conform, json_ops
from ..plans.binding import Binding, Field, Registry, columns_of, mapped
from .base import DEC, hash_sql, money, query, stamp, stamp_sql, table


def _typed(df, trees: dict):
    known = columns_of(df)
    return [compile_expr(t, known).column.alias(n) for n, t in trees.items()]


def col(n):
    return {"column": n}


def lit(v, t):
    return {"literal": v, "type": t}


@query("SELECT c_custkey, upper(c_name) AS c_name_upper, c_nationkey FROM customer WHERE c_acctbal > 0")
def scan_project(spark, d):
    df = table(spark, d, "customer")
    return df.filter("c_acctbal > 0").select(*_typed(df, {"c_custkey": col("c_custkey"), "c_name_upper": {"fn": "upper", "args": [col("c_name")]}, "c_nationkey": col("c_nationkey")}))


@query("SELECT r.r_name, count(*) AS nations FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name")
def ref_scan(spark, d):
    models = Registry()
    models.register("placed", ["nation", "region"], lambda s, i: i["nation"].join(i["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name"), "n_nationkey int, r_name string")
    models.register("by_region", ["placed"], lambda s, i: i["placed"].groupBy("r_name").agg(F.count("*").alias("nations")), "r_name string, nations bigint")
    return models.get(spark, "by_region", {"nation": table(spark, d, "nation"), "region": table(spark, d, "region")})


@query("""SELECT o_orderkey, o_custkey + o_orderkey AS added, o_orderkey - o_custkey AS subtracted, o_custkey * 3 AS multiplied,
 CAST(CAST(o_totalprice AS DECIMAL(18,2)) - CAST(1.5 AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS cheaper, o_orderkey % 7 AS modulo, -o_custkey AS negated, o_orderkey // 3 AS divided FROM orders""")
def ops_arith(spark, d):
    df = table(spark, d, "orders").withColumn("p", money("o_totalprice"))
    return df.select(*_typed(df, {
        "o_orderkey": col("o_orderkey"), "added": {"op": "add", "args": [col("o_custkey"), col("o_orderkey")]}, "subtracted": {"op": "subtract", "args": [col("o_orderkey"), col("o_custkey")]},
        "multiplied": {"op": "multiply", "args": [col("o_custkey"), lit(3, "int64")]}, "cheaper": {"op": "subtract", "args": [col("p"), lit("1.5", DEC)]},
        "modulo": {"op": "modulo", "args": [col("o_orderkey"), lit(7, "int64")]}, "negated": {"op": "negate", "args": [col("o_custkey")]},
        "divided": {"op": "divide", "args": [col("o_orderkey"), lit(3, "int64")]},
    }))


@query("""SELECT c_custkey, c_custkey = c_nationkey AS eq, c_custkey <> c_nationkey AS ne, c_custkey < c_nationkey AS lt, c_custkey <= c_nationkey AS lte,
 c_custkey > c_nationkey AS gt, c_custkey >= c_nationkey AS gte FROM customer""")
def ops_compare(spark, d):
    df = table(spark, d, "customer")
    two = [col("c_custkey"), col("c_nationkey")]
    names = {"eq": "equal", "ne": "not-equal", "lt": "less-than", "lte": "less-or-equal", "gt": "greater-than", "gte": "greater-or-equal"}
    return df.select("c_custkey", *_typed(df, {k: {"op": v, "args": two} for k, v in names.items()}))


@query("""WITH x AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer)
SELECT c_custkey, (seg = 'MACHINERY') AND (c_custkey > 100) AS both_hold, (seg = 'MACHINERY') OR (c_custkey > 100) AS one_holds, NOT (seg = 'MACHINERY') AS not_holds,
 seg IS NULL AS missing, seg IS NOT NULL AS present FROM x""")
def ops_logic3v(spark, d):
    df = table(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"))
    a, b = {"op": "equal", "args": [col("seg"), lit("MACHINERY", "string")]}, {"op": "greater-than", "args": [col("c_custkey"), lit(100, "int64")]}
    return df.select("c_custkey", *_typed(df, {"both_hold": {"op": "and", "args": [a, b]}, "one_holds": {"op": "or", "args": [a, b]}, "not_holds": {"op": "not", "args": [a]}, "missing": {"op": "is-null", "args": [col("seg")]}, "present": {"op": "is-not-null", "args": [col("seg")]}}))


@query("""WITH x AS (SELECT c_custkey, c_name, nullif(c_mktsegment, 'BUILDING') AS seg, CAST(c_acctbal AS DECIMAL(18,2)) AS bal FROM customer)
SELECT c_custkey, abs(bal) AS abs_bal, CAST(round(bal, 1) AS DECIMAL(18,2)) AS rounded, c_name || '/' || seg AS joined, upper(seg) AS up, lower(c_name) AS low,
 length(c_name) AS len, coalesce(seg, 'none') AS filled, nullif(c_name, 'x') AS nulled FROM x""")
def fn_scalar(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_name", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"), money("c_acctbal").alias("bal"))
    f = lambda n, *a: {"fn": n, "args": list(a)}
    return df.select("c_custkey", *_typed(df, {
        "abs_bal": f("abs", col("bal")), "joined": f("concat", col("c_name"), lit("/", "string"), col("seg")), "up": f("upper", col("seg")),
        "low": f("lower", col("c_name")), "len": f("length", col("c_name")), "filled": f("coalesce", col("seg"), lit("none", "string")), "nulled": f("nullif", col("c_name"), lit("x", "string")),
        "rounded": f("round", col("bal"), lit(1, "int32")),
    }))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'final' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'part' END AS state FROM orders""")
def case_expr(spark, d):
    df = table(spark, d, "orders")
    when = lambda v, t: {"when": {"op": "equal", "args": [col("o_orderstatus"), lit(v, "string")]}, "then": lit(t, "string")}
    return df.select("o_orderkey", *_typed(df, {"state": {"case": [when("F", "final"), when("O", "open")], "else": lit("part", "string")}}))


@query("""SELECT o_orderkey, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS dow, monthname(o_orderdate) AS month_name, CAST(quarter(o_orderdate) AS INTEGER) AS q FROM orders""")
def date_parts(spark, d):
    df = table(spark, d, "orders")
    return df.select("o_orderkey", *_typed(df, {"dow": {"macro": "dayOfWeek", "args": [col("o_orderdate")]}, "month_name": {"macro": "monthName", "args": [col("o_orderdate")]}, "q": {"macro": "quarter", "args": [col("o_orderdate")]}}))


@query("SELECT c_custkey, nullif(nullif(c_mktsegment, 'BUILDING'), 'MACHINERY') AS segment FROM customer")
def clean_sentinel(spark, d):
    return table(spark, d, "customer").select("c_custkey", M.clean_sentinel(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"]).alias("segment"))


@query("SELECT p_partkey, nullif(upper(trim('  ' || p_brand || ' ')), '') AS brand_key FROM part")
def normalize_key(spark, d):
    return table(spark, d, "part").select("p_partkey", M.normalize_key(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("brand_key"))


@query("SELECT s_suppkey, trim(' ' || s_name || ' ') AS label FROM supplier")
def source_label(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", M.source_label(F.concat(F.lit(" "), "s_name", F.lit(" "))).alias("label"))


@query("SELECT p_partkey, TRY_CAST(right(p_brand, 2) AS INTEGER) AS brand_no, TRY_CAST(p_name AS INTEGER) AS no_number FROM part")
def safe_cast(spark, d):
    return table(spark, d, "part").select("p_partkey", M.safe_cast(F.right("p_brand", F.lit(2)), "int").alias("brand_no"), M.safe_cast(F.col("p_name"), "int").alias("no_number"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS absent FROM events")
def json_value(spark, d):
    return table(spark, d, "events").select("event_id", M.json_value(F.col("props"), "$.k").alias("k"), M.json_value(F.col("props"), "$.none").alias("absent"))


@query("SELECT event_id, CAST(json_array_length('[' || event_id || ',\"' || event_type || '\"]') AS INTEGER) AS n FROM events")
def json_array_len(spark, d):
    return table(spark, d, "events").select("event_id", M.json_array_len(F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit(',"'), "event_type", F.lit('"]'))).alias("n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_flatten(spark, d):
    return json_ops.flatten(table(spark, d, "events").select("event_id", "props"), "props", {"k": "bigint"}).select("event_id", "k")


@query("SELECT 'k' AS key, 'integer' AS type, count(*) AS rows FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_keys(spark, d):
    return json_ops.key_types(table(spark, d, "events"), "props")


@query("SELECT 'flat' AS shape FROM events WHERE json_valid(props) LIMIT 1")
def json_classify(spark, d):
    return json_ops.classify(table(spark, d, "events"), "props")


@query("SELECT avg(CASE WHEN ltrim(props) LIKE '{%' OR ltrim(props) LIKE '[%' THEN 1.0 ELSE 0.0 END) >= 0.5 AS is_json FROM events")
def json_detect(spark, d):
    return table(spark, d, "events").agg(json_ops.looks_like_json(F.col("props")).alias("is_json"))


@query("""SELECT o_orderkey, CAST(i AS INTEGER) AS element_index, CASE i WHEN 0 THEN o_orderstatus ELSE o_orderpriority END AS element FROM orders, range(2) t(i)""")
def array_child(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.to_json(F.array("o_orderstatus", "o_orderpriority")).alias("j"))
    return json_ops.children(rows, "o_orderkey", "j")


@query("""SELECT n_nationkey, CASE CAST(n_regionkey AS VARCHAR) WHEN '0' THEN 'zero' WHEN '1' THEN 'one' ELSE 'Unknown (' || n_regionkey || ')' END AS label FROM nation""")
def enum_label(spark, d):
    return table(spark, d, "nation").select("n_nationkey", M.enum_label(F.col("n_regionkey"), {0: "zero", 1: "one"}).alias("label"))


@query(f"SELECT {stamp_sql('max(ts) - INTERVAL 36 HOUR')} AS floor_hours, {stamp_sql('max(ts) - INTERVAL 3 DAY')} AS floor_days FROM events")
def lookback_floor(spark, d):
    top = table(spark, d, "events").agg(F.max("ts").cast("timestamp").alias("t"))
    return top.select(stamp(M.lookback_floor(F.col("t"), 36, "hours")).alias("floor_hours"), stamp(M.lookback_floor(F.col("t"), 3, "days")).alias("floor_days"))


@query("SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') IS DISTINCT FROM nullif(c_mktsegment, 'MACHINERY') AS differs FROM customer")
def null_safe_diff(spark, d):
    s = F.col("c_mktsegment")
    return table(spark, d, "customer").select("c_custkey", M.null_safe_differs(F.nullif(s, F.lit("BUILDING")), F.nullif(s, F.lit("MACHINERY"))).alias("differs"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity > 25) OR (l_quantity = 25 AND l_extendedprice > 30000) AS newer FROM lineitem""")
def newer_predicate(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", M.newer([F.col("l_quantity"), F.col("l_extendedprice")], [F.lit(25.0), F.lit(30000.0)]).alias("newer"))


@query("SELECT CAST(DATE '2000-01-01' + CAST(i AS INTEGER) AS DATE) AS date_day FROM range(400) t(i)")
def date_spine(spark, d):
    return M.date_spine(spark, "2000-01-01", 400)


@query(f"""SELECT c_custkey, {hash_sql(("c_name", "string"), ("CAST(c_custkey AS VARCHAR)", "int64"), ("CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR)", "decimal(18,2)"), ("nullif(c_mktsegment, 'BUILDING')", "string"))} AS row_hash FROM customer""")
def canonical_hash(spark, d):
    seg = F.nullif("c_mktsegment", F.lit("BUILDING"))
    fields = [(F.col("c_name"), Kind("string")), (F.col("c_custkey"), Kind("int64")), (F.col("c_acctbal"), DEC), (seg, Kind("string"))]
    return table(spark, d, "customer").select("c_custkey", H.canonical_hash(fields).alias("row_hash"))


@query("SELECT c_custkey, md5(c_name || '-' || c_nationkey || '-' || coalesce(nullif(c_mktsegment, 'BUILDING'), '_null_')) AS customer_sk FROM customer")
def surrogate_key(spark, d):
    return table(spark, d, "customer").select("c_custkey", H.surrogate_key(F.col("c_name"), F.col("c_nationkey"), F.nullif("c_mktsegment", F.lit("BUILDING"))).alias("customer_sk"))


@query("SELECT c_custkey, md5('crm.customers-' || c_custkey) AS _source_record_key, 'urn:crm/instance/' || md5(c_name) AS customer_iri FROM customer")
def source_record_key(spark, d):
    return table(spark, d, "customer").select("c_custkey", H.source_record_key("crm.customers", F.col("c_custkey")).alias("_source_record_key"), H.entity_iri("urn:crm", H.surrogate_key(F.col("c_name"))).alias("customer_iri"))


@query("SELECT s_suppkey, upper(s_name) AS name, 'erp' AS _source_system, md5('erp.suppliers-' || s_suppkey) AS _source_record_key FROM supplier")
def source_branch(spark, d):
    fields = (Field("s_suppkey", col("s_suppkey"), Kind("int64")), Field("name", {"fn": "upper", "args": [col("s_name")]}, Kind("string")))
    return mapped(Binding("supplier", "erp.suppliers", "erp", ("s_suppkey",), (), fields), table(spark, d, "supplier"))


@query("SELECT c_custkey, nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE c_mktsegment || ' ' END), '') AS segment, CAST(c_nationkey AS BIGINT) AS nation, 'crm' AS source_system FROM customer")
def staging_cleanup(spark, d):
    seg = F.when(F.col("c_custkey") % 3 == 0, F.lit("  ")).otherwise(F.concat("c_mktsegment", F.lit(" ")))
    return table(spark, d, "customer").select("c_custkey", M.staged(seg, "string").alias("segment"), M.staged(F.col("c_nationkey"), "bigint").alias("nation"), F.lit("crm").alias("source_system"))


@query("SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderpriority AS _tech_priority FROM orders")
def technical_fields(spark, d):
    rows = table(spark, d, "orders").withColumn("price", money("o_totalprice"))
    fields = (Field("o_orderkey", col("o_orderkey"), Kind("int64")), Field("amount", col("price"), DEC))
    technical = (Field("_tech_priority", col("o_orderpriority"), Kind("string")),)
    return mapped(Binding("order", "shop.orders", "shop", ("o_orderkey",), (), fields, technical=technical), rows).drop("_source_system", "_source_record_key")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
def split_filter(spark, d):
    df = table(spark, d, "orders")
    tree = {"op": "and", "args": [{"op": "equal", "args": [col("o_orderstatus"), lit("F", "string")]}, {"op": "greater-than", "args": [col("o_totalprice"), lit(1000.0, "float64")]}]}
    return df.filter(compile_expr(tree, columns_of(df)).column).select("o_orderkey", "o_custkey")


@query("""SELECT c_custkey, c_name, NULL::BIGINT AS s_suppkey, 'customer' AS kind FROM customer UNION ALL SELECT NULL, NULL, s_suppkey, 'supplier' FROM supplier""")
def sti_union(spark, d):
    a = conform.with_discriminator(table(spark, d, "customer").select("c_custkey", "c_name"), "kind", "customer")
    b = conform.with_discriminator(table(spark, d, "supplier").select("s_suppkey"), "kind", "supplier")
    return conform.union_superset([a, b], ["kind"])
