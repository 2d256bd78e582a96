"""A corpus pipeline of five stages: filter, deduplicate, decontaminate, mix, encode.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.llm import decontaminate, jaccard_join, mixing, token_output, toxicity
from orefold.llm.queries_token import tokenizer_path
from orefold.llm.scratch import free, free_since, save, saved


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go; null and empty texts stay, copies go or stay together."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = toxicity.train(docs.select("doc_id", "text"), labels)
    return toxicity.without_toxic(docs, chain)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the document of the least id stays; rows with a null id or no words stay.

    Rows that repeat an id stay or go together.
    """
    classes = jaccard_join.near_duplicates(docs)
    gone = classes.filter("doc_id is not null and doc_id <> class_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none, copies go or stay together."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its mix has copies of it, none for 0 copies; null and empty texts have none.

    Rows that repeat an id, a source and a size all get the copies of the one that has most.
    """
    copies = mixing.mix(docs).groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies")).filter("copies > 0")
    keyed = copies.select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("__z"), F.col("copies").cast("int").alias("__n"))
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__z"))
    sized = docs.withColumn("__size", mixing.words(F.col("text")))
    return sized.join(keyed, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, in ascending id order; one row for each document in them."""
    return token_output.token_digest(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, read = saved(), docs
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
        free_since(before, docs)
        free(read)
    return docs


#: Trained models and tokenizers are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
