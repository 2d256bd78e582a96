"""Dimensional products, graph closures and master data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gold as G
from ..operators import graph, mdm
from .base import money, query, stamp, stamp_sql, table
from .changes import VERSIONS_SQL, versions


@query(f"WITH {VERSIONS_SQL} SELECT user_id AS user_key, event_type AS last_event, value AS last_value FROM versions WHERE is_current = 1")
def gold_dim_current(spark, d):
    return G.dimension(versions(spark, d), {"user_id": "user_key", "event_type": "last_event", "value": "last_value"}, True)


@query(f"WITH {VERSIONS_SQL} SELECT user_id AS user_key, event_type AS event, is_current, {stamp_sql('_business_valid_from')} AS valid_from FROM versions")
def gold_dim_dual(spark, d):
    return G.dimension(versions(spark, d), {"user_id": "user_key", "event_type": "event", "is_current": "is_current", "_business_valid_from": "v"}).withColumn("valid_from", stamp("v")).drop("v")


@query("SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders WHERE o_orderkey % 2 = 0 OR o_orderdate >= (SELECT max(o_orderdate) FROM orders WHERE o_orderkey % 2 = 0)")
def gold_fact_incremental(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", money("o_totalprice").alias("amount"), "o_orderdate")
    return G.fact_incremental(rows.filter("o_orderkey % 2 = 0"), rows, ["o_orderkey"], "o_orderdate").select("o_orderkey", "amount")


@query("""WITH p AS (SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT o_custkey, l_suppkey, CAST(round(CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY o_custkey), 6) AS DECIMAL(18,6)) AS weight FROM p""")
def gold_bridge(spark, d):
    pairs = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_suppkey")
    return G.bridge(pairs, "o_custkey", "l_suppkey")


@query("""SELECT CAST(strftime(day, '%Y%m%d') AS BIGINT) AS date_key, CAST(day AS DATE) AS date, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month, CAST(day(day) AS INTEGER) AS day,
 CAST(quarter(day) AS INTEGER) AS quarter, CAST(year(day) + CASE WHEN month(day) >= 7 THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year, FALSE AS is_holiday
FROM (SELECT unnest(generate_series(DATE '2023-12-01', DATE '2024-12-31', INTERVAL 1 DAY)) AS day)""")
def gold_calendar(spark, d):
    return G.calendar(spark, "2023-12-01", "2024-12-31", 7, [])


@query("""SELECT n_name, year(o_orderdate)::INTEGER AS year, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS amount
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def gold_star(spark, d):
    days = G.calendar(spark, "1990-01-01", "2026-12-31").select("date", "year")
    facts = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate")).join(days, F.col("day") == F.col("date"))
    star = facts.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return star.groupBy("n_name", "year").agg(F.count("*").alias("orders"), F.sum(money("o_totalprice")).alias("amount"))


@query("""SELECT l_returnflag, count(*) AS lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS gross, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS quantity,
 CAST(round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE), 4) AS DOUBLE) AS unit_price FROM lineitem GROUP BY l_returnflag""")
def gold_measure(spark, d):
    m = G.Measures()
    m.base("lines", F.count("*"))
    m.base("gross", F.sum(money("l_extendedprice")))
    m.base("quantity", F.sum(money("l_quantity")))
    m.derived("unit_price", ["gross", "quantity"], lambda g, q: F.round(g.cast("double") / q.cast("double"), 4))
    return m.evaluate(table(spark, d, "lineitem"), ["l_returnflag"], ["lines", "gross", "quantity", "unit_price"])


@query("""WITH t AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS amount FROM orders GROUP BY 1)
SELECT day, CAST(sum(amount) OVER (PARTITION BY date_trunc('year', day) ORDER BY day) AS DECIMAL(38,2)) AS ytd, CAST(sum(amount) OVER (PARTITION BY date_trunc('quarter', day) ORDER BY day) AS DECIMAL(38,2)) AS qtd,
 CAST(sum(amount) OVER (PARTITION BY date_trunc('month', day) ORDER BY day) AS DECIMAL(38,2)) AS mtd FROM t""")
def gold_ytd(spark, d):
    days = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum(money("o_totalprice")).alias("amount"))
    return days.select("day", *[G.to_date(days, "amount", "day", p).alias(p) for p in ("ytd", "qtd", "mtd")])


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (1, 2)")
def gold_rls(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return G.secured(rows, F.col("c_nationkey").isin(1, 2), ["c_acctbal"]).unionByName(G.secured(rows, None, ["c_acctbal"]))


_TREE = """t(s, o) AS (SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'continent' FROM region UNION ALL SELECT 'continent', 'world'
 UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"""
_CLOSED = f"""WITH RECURSIVE {_TREE}, c(descendant, ancestor, distance) AS (SELECT s, o, 1 FROM t UNION ALL SELECT c.descendant, t.o, c.distance + 1 FROM c JOIN t ON c.ancestor = t.s)"""


def tree(spark, d):
    lab = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n = table(spark, d, "nation").select(lab("n", "n_nationkey").alias("s"), lab("r", "n_regionkey").alias("o"))
    r = table(spark, d, "region").select(lab("r", "r_regionkey").alias("s"), F.lit("continent").alias("o"))
    c = table(spark, d, "customer").select(lab("c", "c_custkey").alias("s"), lab("n", "c_nationkey").alias("o"))
    return n.union(r).union(c).union(spark.createDataFrame([("continent", "world")], "s string, o string"))


@query(f"{_CLOSED} SELECT ancestor, descendant, CAST(min(distance) AS INTEGER) AS distance FROM c GROUP BY 1, 2")
def closure(spark, d):
    return graph.closure(tree(spark, d))


@query("""WITH p AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation) SELECT 'n' || b.k AS ancestor, 'n' || a.k AS descendant, 1 AS distance FROM p a JOIN p b ON a.r = b.r AND b.k = a.k + 5 WHERE FALSE
UNION ALL SELECT b, a, d FROM (VALUES ('x', 'y', 1), ('y', 'x', 1), ('y', 'z', 1), ('z', 'y', 1), ('x', 'z', 2), ('z', 'x', 2)) v(a, b, d)""")
def closure_sym(spark, d):
    return graph.symmetric_closure(spark.createDataFrame([("x", "y"), ("y", "z")], "s string, o string"))


@query(f"""{_CLOSED}, dom(property, class) AS (VALUES ('name', 'world'), ('code', 'continent'), ('name', 'r1'), ('iso', 'n3'))
SELECT DISTINCT c.descendant AS class, dom.property FROM c JOIN dom ON c.ancestor = dom.class WHERE NOT EXISTS (SELECT 1 FROM dom x WHERE x.class = c.descendant AND x.property = dom.property)""")
def inherited_props(spark, d):
    domains = spark.createDataFrame([("name", "world"), ("code", "continent"), ("name", "r1"), ("iso", "n3")], "property string, class string")
    return graph.inherited_properties(graph.closure(tree(spark, d)), domains)


@query("SELECT 'n' || n_nationkey AS s, n_name AS label, CASE WHEN n_nationkey % 2 = 0 THEN 'even' END AS comment FROM nation")
def triples_optional(spark, d):
    n = table(spark, d, "nation").withColumn("s", F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))
    t = n.select("s", F.lit("type").alias("p"), F.lit("Nation").alias("o")).union(n.select("s", F.lit("label"), "n_name")).union(n.filter("n_nationkey % 2 = 0").select("s", F.lit("comment"), F.lit("even")))
    return graph.with_optional(t, "Nation", {"label": "label", "comment": "comment"})


@query("""SELECT c_custkey AS left_key, s_suppkey AS right_key, CAST(1.0 AS DOUBLE) AS score FROM customer JOIN supplier ON upper(trim(substr(c_name, 10))) = upper(trim(substr(s_name, 10))) WHERE trim(substr(c_name, 10)) <> ''""")
def mdm_match(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.substring("c_name", 10, 100).alias("name"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.substring("s_name", 10, 100).alias("name"))
    return mdm.match(a, b, "id", "name", "normalized")


@query("""SELECT c_nationkey, c_mktsegment FROM (SELECT *, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN seg IS NULL THEN 1 ELSE 0 END, c_acctbal DESC, c_custkey) = 1""")
def mdm_survivorship(spark, d):
    rows = table(spark, d, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return mdm.survive(rows, "c_nationkey", "c_mktsegment", "recency", [F.desc("c_acctbal"), F.col("c_custkey")])
