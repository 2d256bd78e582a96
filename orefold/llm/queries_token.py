"""Queries of token output, personal data and vector search, with the SQL that can be had."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import mtree_search, pii, token_output

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public tokenizer files lie."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree_search.top_k_digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op8_exact_top_k": op8_exact_top_k, "op10_personal_data": op10_personal_data, "op9_token_output": op9_token_output}
_TOP_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

ORACLE_SQL = {"op8_exact_top_k": _TOP_SQL}
