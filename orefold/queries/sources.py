"""Readers, catalogs, lookups of parents and conformance of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions.types import Kind
from ..operators import conform, lookup
from ..plans.binding import Binding, Field, Relationship, compile_binding
from ..sources import readers
from .base import money, query, table, user_events
from .changes import VERSIONS_SQL, versions


@query("""SELECT n.n_nationkey, s.label FROM nation n JOIN (VALUES (0, 'south'), (1, 'west'), (2, 'east')) s(k, label) ON n.n_regionkey = s.k""")
def seed_lookup(spark, d):
    seed = readers.read_seed(spark, [{"k": 0, "label": "south"}, {"k": 1, "label": "west"}, {"k": 2, "label": "east"}], "k int, label string")
    return table(spark, d, "nation").join(seed, F.col("n_regionkey") == F.col("k")).select("n_nationkey", "label")


@query("""SELECT 'supplier' AS "table", 's_suppkey' AS "column", count(*) AS row_count, count(DISTINCT s_suppkey) AS distinct_count FROM supplier
UNION ALL SELECT 'supplier', 's_name', count(*), count(DISTINCT s_name) FROM supplier UNION ALL SELECT 'supplier', 's_nationkey', count(*), count(DISTINCT s_nationkey) FROM supplier
UNION ALL SELECT 'supplier', 's_acctbal', count(*), count(DISTINCT s_acctbal) FROM supplier
UNION ALL SELECT 'nation', 'n_nationkey', count(*), count(DISTINCT n_nationkey) FROM nation UNION ALL SELECT 'nation', 'n_name', count(*), count(DISTINCT n_name) FROM nation
UNION ALL SELECT 'nation', 'n_regionkey', count(*), count(DISTINCT n_regionkey) FROM nation""")
def introspect(spark, d):
    return readers.introspect({t: table(spark, d, t) for t in ("supplier", "nation")}).drop("type")


@query("""SELECT 'c' AS "table", * FROM (VALUES ('a', 'int', 'bigint', 'type-changed'), ('b', 'string', NULL, 'removed'), ('d', NULL, 'date', 'added'), ('e', 'int', 'int', 'unchanged')) t("column", old_type, new_type, status)""")
def schema_diff(spark, d):
    old = spark.createDataFrame([("c", "a", "int"), ("c", "b", "string"), ("c", "e", "int")], '`table` string, `column` string, type string')
    new = spark.createDataFrame([("c", "a", "bigint"), ("c", "d", "date"), ("c", "e", "int")], '`table` string, `column` string, type string')
    return readers.schema_diff(old, new)


@query("""SELECT * FROM (VALUES ('w', 'warehouse', 100, 5, NULL::INTEGER, 'table'), ('f', 'file', 100, 5, 100, 'sample'), ('n', 'file', 100, NULL, 100, NULL)) t(name, platform, row_count, distinct_count, rows_sampled, distinct_scope)""")
def distinct_scope(spark, d):
    rows = [("w", "warehouse", 100, 5), ("f", "file", 100, 5), ("n", "file", 100, None)]
    return readers.distinct_scope(spark.createDataFrame(rows, "name string, platform string, row_count int, distinct_count int"))


@query("""SELECT * FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) t("column", type)""")
def infer_schema(spark, d):
    return spark.createDataFrame(readers.read_parquet(spark, f"{d}/nation.parquet").dtypes, "`column` string, type string")


_NATION = "SELECT n_nationkey, md5(CAST(n_nationkey AS VARCHAR)) AS nation_sk FROM nation"


def nations(spark, d):
    return table(spark, d, "nation").select("n_nationkey", H.surrogate_key(F.col("n_nationkey")).alias("nation_sk"))


def customer_binding(missing: str = "null") -> Binding:
    return Binding(
        "customer", "crm.customers", "crm", ("c_custkey",), ("customer_id",),
        (Field("customer_id", {"column": "c_custkey"}, Kind("int64")), Field("customer_name", {"fn": "upper", "args": [{"column": "c_name"}]}, Kind("string")), Field("country", {"column": "c_nationkey"}, Kind("int32"))),
        (Relationship("urn:customer#country", "nation", "country", "n_nationkey", "country_sk", missing),),
    )


@query(f"""WITH n AS ({_NATION} WHERE n_nationkey % 5 <> 0)
SELECT c_custkey AS customer_id, upper(c_name) AS customer_name, c_nationkey AS country, 'crm' AS _source_system, md5('crm.customers-' || c_custkey) AS _source_record_key,
 md5(CAST(c_custkey AS VARCHAR)) AS customer_sk, coalesce(nation_sk, '__UNKNOWN__') AS country_sk, CAST(count(nation_sk) OVER (PARTITION BY c_custkey) AS BIGINT) AS matches
FROM customer LEFT JOIN n ON c_nationkey = n_nationkey""")
def fk_lookup(spark, d):
    rows, _ = compile_binding(customer_binding(), table(spark, d, "customer"), {"nation": nations(spark, d).filter("n_nationkey % 5 <> 0")})
    count = H.match_count_name("urn:customer#country")
    return rows.withColumnRenamed(count, "matches").drop("_row_hash")


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, count(*) AS parts FROM lineitem GROUP BY ALL)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, p.parts FROM lineitem l LEFT JOIN p ON l.l_orderkey = p.l_orderkey AND l.l_linenumber = p.l_linenumber AND p.parts > 1""")
def fk_composite(spark, d):
    lines = table(spark, d, "lineitem")
    p = lines.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")
    return lookup.lookup(lines.select("l_orderkey", "l_linenumber", "l_partkey"), p, [("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber")], {"n": "parts"})


@query(f"""WITH {VERSIONS_SQL}
SELECT c_custkey, v.event_type AS last_type, v.value AS last_value FROM customer LEFT JOIN versions v ON c_custkey = v.user_id AND v.is_current = 1""")
def fk_current(spark, d):
    child = table(spark, d, "customer").select("c_custkey")
    return lookup.lookup(child, versions(spark, d), [("c_custkey", "user_id")], {"event_type": "last_type", "value": "last_value"}, current="is_current")


@query(f"""WITH {VERSIONS_SQL}
SELECT e.event_id, v._cdc_sequence AS version FROM events e LEFT JOIN versions v
 ON e.user_id = v.user_id AND e.ts >= v._business_valid_from AND (v._business_valid_to IS NULL OR e.ts < v._business_valid_to)""")
def fk_as_of(spark, d):
    child = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = lookup.lookup(child, versions(spark, d), [("user_id", "user_id")], {"_cdc_sequence": "version"}, as_of=("ts", "_business_valid_from", "_business_valid_to"))
    return out.select("event_id", "version")


_COUNTED = """j AS (SELECT o_orderkey, o_custkey, p.sk FROM orders LEFT JOIN
 (SELECT c_custkey, 'a' || c_custkey AS sk FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, 'b' || c_custkey FROM customer WHERE c_custkey % 25 = 1) p ON o_custkey = p.c_custkey),
c AS (SELECT *, count(sk) OVER (PARTITION BY o_orderkey) AS matches FROM j)"""


def counted(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    sk = lambda p: F.concat(F.lit(p), F.col("c_custkey").cast("string")).alias("sk")
    parents = c.filter("c_custkey % 10 <> 0").select("c_custkey", sk("a")).union(c.filter("c_custkey % 25 = 1").select("c_custkey", sk("b")))
    child = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return lookup.with_match_count(lookup.lookup(child, parents, [("o_custkey", "c_custkey")], {"sk": "sk"}), ["o_orderkey"], "sk", "matches")


@query(f"WITH {_COUNTED} SELECT * FROM c")
def fk_match_count(spark, d):
    return counted(spark, d)


@query(f"WITH {_COUNTED} SELECT o_orderkey, o_custkey, sk, matches, CASE WHEN matches = 1 THEN 'accepted' ELSE 'quarantined' END AS route FROM c")
def fk_policy(spark, d):
    good, apart, _ = lookup.route(counted(spark, d), "matches", "sk", "quarantine", "quarantine")
    return good.withColumn("route", F.lit("accepted")).unionByName(apart.withColumn("route", F.lit("quarantined")))


@query(f"WITH {_COUNTED} SELECT o_orderkey, coalesce(sk, '__UNKNOWN__') AS sk FROM c WHERE matches <= 1")
def fk_unknown_member(spark, d):
    good, _, _ = lookup.route(counted(spark, d), "matches", "sk", "null", "quarantine")
    return good.select("o_orderkey", "sk")


_PARENTS = """p AS (SELECT c_custkey, 'a' || c_custkey AS sk FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, 'b' || c_custkey FROM customer WHERE c_custkey % 25 = 1)"""


@query(f"""WITH {_PARENTS} SELECT o_orderkey, min(sk) AS sk, count(sk) AS matches FROM orders LEFT JOIN p ON o_custkey = c_custkey GROUP BY o_orderkey""")
def fk_first(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    sk = lambda p: F.concat(F.lit(p), F.col("c_custkey").cast("string")).alias("sk")
    parents = c.filter("c_custkey % 10 <> 0").select("c_custkey", sk("a")).union(c.filter("c_custkey % 25 = 1").select("c_custkey", sk("b")))
    child = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return lookup.counted_lookup(child, parents, [("o_custkey", "c_custkey")], {"sk": "sk"}, "matches").select("o_orderkey", "sk", "matches")


_PRICES = """v AS (SELECT p_partkey, p_size, TIMESTAMP '1995-01-01' + to_days(CAST(p_partkey % 900 AS INTEGER)) AS valid_from, CASE WHEN p_partkey % 3 = 0 THEN TIMESTAMP '9999-12-31' ELSE TIMESTAMP '1996-06-01' + to_days(CAST(p_partkey % 300 AS INTEGER)) END AS valid_to, 'v' || p_partkey AS version FROM part WHERE p_partkey % 11 <> 0
 UNION ALL SELECT p_partkey, p_size, TIMESTAMP '1996-01-01', TIMESTAMP '9999-12-31', 'w' || p_partkey FROM part WHERE p_partkey % 4 = 0),
l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, CAST(l_shipdate AS TIMESTAMP) AS shipped FROM lineitem)"""


def price_versions(spark, d):
    part = table(spark, d, "part")
    day = lambda s: F.lit(s).cast("timestamp")
    plus = lambda s, n: F.timestamp_add("DAY", F.pmod("p_partkey", F.lit(n)).cast("int"), day(s))
    key = F.col("p_partkey")
    version = lambda p: F.concat(F.lit(p), key.cast("string")).alias("version")
    a = part.filter(key % 11 != 0).select("p_partkey", plus("1995-01-01", 900).alias("valid_from"), F.when(key % 3 == 0, day("9999-12-31")).otherwise(plus("1996-06-01", 300)).alias("valid_to"), version("v"))
    b = part.filter(key % 4 == 0).select("p_partkey", day("1996-01-01").alias("valid_from"), day("9999-12-31").alias("valid_to"), version("w"))
    return a.union(b)


def priced(spark, d):
    lines = table(spark, d, "lineitem").select(F.monotonically_increasing_id().alias("line"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", F.col("l_shipdate").cast("timestamp").alias("at"))
    return lookup.lookup(lines, price_versions(spark, d), [("l_partkey", "p_partkey")], {"version": "version", "valid_from": "since"}, as_of=("at", "valid_from", "valid_to"), open_end="max-value")


@query(f"""WITH {_PRICES} SELECT l_orderkey, l_linenumber, l_partkey, version FROM (SELECT l.rowid_, l_orderkey, l_linenumber, l_partkey, version, valid_from, max(valid_from) OVER (PARTITION BY l.rowid_) AS best
 FROM (SELECT row_number() OVER () AS rowid_, * FROM l) l LEFT JOIN v ON l_partkey = p_partkey AND shipped >= valid_from AND shipped < valid_to) WHERE best IS NULL OR valid_from = best""")
def fk_latest_start(spark, d):
    return lookup.latest_start(priced(spark, d), ["line"], "since").select("l_orderkey", "l_linenumber", "l_partkey", "version")


@query(f"""WITH {_PRICES} SELECT l_orderkey, l_linenumber, l_partkey, 'deferred' AS route FROM l WHERE EXISTS (SELECT 1 FROM v WHERE l_partkey = p_partkey)
 AND NOT EXISTS (SELECT 1 FROM v WHERE l_partkey = p_partkey AND shipped >= valid_from AND shipped < valid_to)""")
def fk_late_defer(spark, d):
    marked = lookup.late(priced(spark, d), price_versions(spark, d), [("l_partkey", "p_partkey")], "version", "late")
    _, deferred, _ = lookup.route_late(marked, "late", "version", "defer")
    return deferred.select("l_orderkey", "l_linenumber", "l_partkey", F.lit("deferred").alias("route"))


@query("""SELECT n.n_nationkey, s.sk FROM nation n LEFT JOIN (SELECT s_nationkey, md5(CAST(s_suppkey AS VARCHAR)) AS sk FROM supplier) s ON n.n_nationkey = s.s_nationkey""")
def fk_reverse(spark, d):
    child = table(spark, d, "supplier").select("s_nationkey", H.surrogate_key(F.col("s_suppkey")).alias("sk"))
    return lookup.reverse_key(table(spark, d, "nation").select("n_nationkey"), child, "n_nationkey", "s_nationkey", {"sk": "sk"})


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def ref_orphans(spark, d):
    return lookup.orphans(table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").filter("c_custkey % 10 <> 0"), [("o_custkey", "c_custkey")])


def branches(spark, d):
    """Customers and suppliers as two sources of parties with overlapping keys."""
    crm = table(spark, d, "customer").select(F.col("c_custkey").alias("party_key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), money("c_acctbal").alias("balance"))
    erp = table(spark, d, "supplier").select(F.col("s_suppkey").alias("party_key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), money("s_acctbal").alias("balance"))
    lineage = lambda df, s, t: df.withColumns({"_source_system": F.lit(s), "_source_record_key": H.source_record_key(t, F.col("party_key"))})
    return lineage(crm, "crm", "crm.customers"), lineage(erp, "erp", "erp.suppliers")


_PARTIES = """crm AS (SELECT c_custkey AS party_key, c_name AS name, c_nationkey AS nation, CAST(c_acctbal AS DECIMAL(18,2)) AS balance, 'crm' AS _source_system, md5('crm.customers-' || c_custkey) AS _source_record_key FROM customer),
erp AS (SELECT s_suppkey AS party_key, s_name AS name, s_nationkey AS nation, CAST(s_acctbal AS DECIMAL(18,2)) AS balance, 'erp' AS _source_system, md5('erp.suppliers-' || s_suppkey) AS _source_record_key FROM supplier),
party AS (SELECT * FROM crm UNION ALL SELECT * FROM erp)"""


@query("""SELECT c_custkey AS id, c_mktsegment AS segment, NULL::BIGINT AS supplier_id, c_nationkey AS nation_fk FROM customer UNION ALL SELECT NULL, NULL, s_suppkey, s_nationkey FROM supplier""")
def union_superset(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation_fk"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier_id"), F.col("s_nationkey").alias("nation_fk"))
    return conform.union_superset([a, b], ["nation_fk"])


@query(f"WITH {_PARTIES} SELECT * FROM party")
def conform_union_all(spark, d):
    return conform.union_all(branches(spark, d))


@query(f"WITH {_PARTIES} SELECT * FROM party QUALIFY row_number() OVER (PARTITION BY party_key ORDER BY CASE _source_system WHEN 'erp' THEN 0 WHEN 'crm' THEN 1 ELSE 2 END, _source_record_key) = 1")
def conform_dedup(spark, d):
    return conform.conform(branches(spark, d), "party_key", "_source_system", ["erp", "crm"], "_source_record_key")


@query(f"WITH {_PARTIES} SELECT nation, name, balance FROM party QUALIFY row_number() OVER (PARTITION BY nation ORDER BY balance DESC, name) = 1")
def survivor(spark, d):
    return conform.best_per_key(conform.union_all(branches(spark, d)), ["nation"], [F.desc("balance"), F.col("name")]).select("nation", "name", "balance")


@query(f"WITH {_PARTIES} SELECT party_key, name, nation FROM party QUALIFY row_number() OVER (PARTITION BY party_key ORDER BY CASE _source_system WHEN 'crm' THEN 0 ELSE 1 END) = 1")
def staging_survivor(spark, d):
    a, b = branches(spark, d)
    cols = [c for c in conform.common_columns([a, b.drop("balance")]) if c != "_source_record_key"]
    rows = conform.union_all([a.select(cols), b.select(cols)])
    return conform.best_per_key(rows, ["party_key"], [conform.precedence(F.col("_source_system"), ["crm", "erp"])]).drop("_source_system")


@query(f"""WITH {_PARTIES} SELECT coalesce(c.party_key, e.party_key) AS party_key, c.name AS crm_name, e.name AS erp_name, c.party_key IS NOT NULL AS in_crm, e.party_key IS NOT NULL AS in_erp
FROM (SELECT * FROM crm WHERE party_key % 2 = 0) c FULL JOIN erp e ON c.party_key = e.party_key""")
def merge_full_outer(spark, d):
    a, b = branches(spark, d)
    return conform.full_merge(a.filter("party_key % 2 = 0").select("party_key", F.col("name").alias("crm_name")), b.select("party_key", F.col("name").alias("erp_name")), "party_key", ("crm", "erp"))


@query(f"""WITH {_PARTIES} SELECT party_key AS parent_key, _source_system, _source_record_key, CASE _source_system WHEN 'crm' THEN 'primary' ELSE 'secondary' END AS _contribution_role, 'ref:' || _source_system AS _source_identity_ref FROM party""")
def contribution_lineage(spark, d):
    a, b = branches(spark, d)
    return conform.contribution_lineage([(a, "primary", "ref:crm"), (b, "secondary", "ref:erp")], "party_key")


@query(f"""WITH {_PARTIES}, r AS (SELECT 'party_' || _source_system AS _branch_model, _source_system, _source_record_key, party_key, CASE _source_system WHEN 'crm' THEN 'primary' ELSE 'secondary' END AS _contribution_role,
 count(*) OVER (PARTITION BY _source_system, _source_record_key) AS _source_key_occurrences, count(*) OVER (PARTITION BY party_key) AS _integration_key_occurrences FROM party)
SELECT *, CAST(_source_key_occurrences > 1 AS INTEGER) AS _source_key_collision, CAST(_integration_key_occurrences > 1 AS INTEGER) AS _equivalent_branch_overlap, 'prefer' AS _conflict_action, 'fail' AS _collision_action FROM r""")
def reconciliation(spark, d):
    a, b = branches(spark, d)
    return conform.reconciliation([(a, "party_crm", "primary"), (b, "party_erp", "secondary")], "party_key", {"conflict": "prefer", "collision": "fail"})


@query("SELECT count(*) AS events, count(DISTINCT user_id) AS users FROM events")
def scan_events(spark, d):
    return user_events(spark, d).agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"))
