"""Queries of the sharding, mixing and URL operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .mixing import mix_digest
from .sharding import shard_digest
from .url_filter import SPAM_LABELS, judge_urls

#: The rules of the URL query.
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def op1_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op1_shuffle_shards": op1_shuffle_shards, "op4_mix_sources": op4_mix_sources, "op5_url_rules": op5_url_rules}

_URL_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), named AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(verdict, rhost, rpath) AS (
  VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)}
), fits AS (
  SELECT n.page_id, n.host, n.path, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY n.page_id ORDER BY length(r.rhost || r.rpath) DESC) AS place
  FROM named n JOIN rules r
    ON (n.host = r.rhost OR ends_with(n.host, '.' || r.rhost)) AND starts_with(n.path, r.rpath)
)
SELECT n.page_id, n.host, n.path, f.rule,
       coalesce(f.verdict, CASE WHEN list_has_any(string_split(n.host, '.'), [{", ".join(f"'{x}'" for x in SPAM_LABELS)}])
                                THEN 'block' ELSE 'allow' END) AS verdict
FROM named n LEFT JOIN fits f ON n.page_id = f.page_id AND f.place = 1
"""

ORACLE_SQL = {"op5_url_rules": _URL_SQL}
