"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard_join, substring_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, the probability of each category, is_toxic."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.train(documents, _table(spark, sf_dir, "labels"))
    return toxicity.judge(documents, chain).drop("text")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, class_id and the number of its links."""
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats_digest(_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item in it: doc_id, item_id and the share found."""
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {"op6_decontaminate": op6_decontaminate, "op7_suffix_array_dedup": op7_suffix_array_dedup, "op3_jaccard_join": op3_jaccard_join, "op2_toxicity_chain": op2_toxicity_chain}

_REPEATS_SQL = """
WITH d AS (
  SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), w AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)
), m AS (
  SELECT s, min(doc_id) AS least FROM w GROUP BY s
), f AS (
  SELECT w.doc_id, w.i FROM w JOIN m ON w.s = m.s WHERE m.least < w.doc_id
), g AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM f
), k AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g
), r AS (
  SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, span
), p AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM r
), kept AS (
  SELECT p.doc_id, string_agg(substr(d.h, 2 * p.before + 1, 2 * (p.a - p.before)), '' ORDER BY p.a) AS h,
         max(p.b) AS last, sum(p.b - p.a) AS gone, count(*) AS spans
  FROM p JOIN d ON p.doc_id = d.doc_id GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(kept.gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(kept.spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept.h, '') || substr(d.h, 2 * coalesce(kept.last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

_NEAR_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE common >= 0.8 * (nx.n + ny.n - common) - 1e-9
), reach(x, y) AS (
  SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), least AS (
  SELECT x, min(y) AS y FROM reach GROUP BY x
), counts AS (
  SELECT x, count(*) AS links FROM links GROUP BY x
)
SELECT t.doc_id, least(t.doc_id, coalesce(least.y, t.doc_id)) AS class_id, CAST(coalesce(counts.links, 0) AS BIGINT) AS n_links
FROM t LEFT JOIN least ON t.doc_id = least.x LEFT JOIN counts ON t.doc_id = counts.x
"""

ORACLE_SQL = {"op3_jaccard_join": _NEAR_SQL, "op7_suffix_array_dedup": _REPEATS_SQL}
