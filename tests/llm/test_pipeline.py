"""Every stage on what the one before it kept."""

import tracemalloc
from collections import Counter

import pyarrow as pa

import corpus_pipeline as pipeline
from orefold.llm import decontaminate, jaccard_join, queries
from orefold.llm.scratch import BATCH_BYTES, long_texts, save

from .helpers import frame, shingles


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        docs = save(stage(spark, docs, sf_dir), f"test-{name}")
        seen[name] = docs.collect()
        if name != "token_output":
            assert docs.columns == columns
    kept = [shingles(r.text) for r in seen["near_duplicates"]]
    assert not any(a and b and len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(kept) for b in kept[:i])
    before = {r.doc_id for r in seen["decontamination"]}
    copies = Counter(r.doc_id for r in seen["mixing"])
    assert set(copies) <= before and max(copies.values()) == 2
    assert Counter(r.doc_id for r in seen["token_output"]) == copies
    last = max(seen["token_output"], key=lambda r: r.start)
    assert last.start + last.n_tokens == sum(r.n_tokens for r in seen["token_output"])


def test_stages_on_odd_rows(spark, sf_dir):
    """Null, empty and long texts, null ids, repeated rows, tied copies, and columns named as the stages' own."""
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()
    rows = [tuple(r) for r in base]
    text = base[0].text
    more = [(None, None, "en", "src0", 0), (9001, None, None, None, None), (9002, "", "en", "src1", 0), (9003, "word " * 60_000, "en", None, 1)]
    more += [(9004, text, "en", "src0", 1), (9004, text, "en", "src0", 1), (None, text, "en", "src0", 1)]
    kinds = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    docs = spark.createDataFrame(rows + more, kinds).selectExpr("*", "'x' AS is_toxic", "1 AS p_toxic", "2 AS copies", "'k' AS `set`", "3 AS part")
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        docs = save(stage(spark, docs, sf_dir), f"odd-{name}")
        if name != "token_output":
            assert docs.columns == columns and {r.is_toxic for r in docs.collect()} == {"x"}
        if name == "near_duplicates":
            kept = [r.doc_id for r in docs.collect()]
            assert kept.count(9004) == 0 and kept.count(None) == 2 and {9001, 9002, 9003} <= set(kept)
    assert docs.filter("n_tokens < 1").isEmpty()


def test_registered():
    import __spark_entry__ as e

    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in queries.QUERIES}
    assert "pipeline" in e.queries() and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = save(stage(spark, docs, sf_dir), "test-empty")
    assert docs.isEmpty()


def test_batches_of_texts_are_small(spark):
    """In a session that sets nothing; a lower setting stays, a higher one doesn't."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    try:
        docs = frame(spark, ["word " * 2000] * 2000).coalesce(1)
        jaccard_join.near_duplicates(docs.limit(3))
        got = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
        assert sum(got) > 20_000_000 and max(got) < BATCH_BYTES + 50_000
        for held, want in (("1m", "1m"), ("1000", "1000"), ("64m", str(BATCH_BYTES)), ("67108864b", str(BATCH_BYTES))):
            spark.conf.set(key, held)
            long_texts(spark)
            assert spark.conf.get(key) == want
    finally:
        spark.conf.unset(key)


def test_decontamination_holds_few_large_matrices(spark, sf_dir):
    """The driver's arrays while a matcher is made: fewer than five matrices of features by signs in 64 bits."""
    tables = [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")]
    tracemalloc.start()
    try:
        next(decontaminate.matchers(*tables))
        assert tracemalloc.get_traced_memory()[1] < 5 * decontaminate.BUCKETS * decontaminate.SKETCH * 8
    finally:
        tracemalloc.stop()
