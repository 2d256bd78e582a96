"""Vector search and token files against brute force and the library."""

import struct
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from orefold.llm import mtree_search, token_output
from orefold.llm.queries_token import tokenizer_path
from orefold.llm.textkernel import hash_spans, word_hashes

from .helpers import corpus, frame


@pytest.mark.parametrize("n, shard_rows", [(700, 150), (3, 10)])
def test_top_k(spark, n, shard_rows):
    rng = np.random.default_rng(n)
    x = rng.normal(0, 0.2, (n, 8))
    x[: n // 3] = x[0]  # one vector is very common
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(50_000, None), (50_050, [0.1] * 7 + [None]), (50_100, [float("nan")] * 8), (50_150, [float("inf")] * 8), (None, [0.1] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, mtree_search.top_k(*(lambda r: (r, r.filter("vec_id % 50 = 0")))(df.select("vec_id", mtree_search.integer_vector(df.embedding).alias("v"))), shard_rows=shard_rows, block_rows=4).collect()))
    v = np.floor(256 * x.astype(np.float32).astype(float)).astype(int)
    want = []
    for q in range(0, n, 50):
        s = v @ v[q]
        best = sorted((-int(s[i]), i) for i in range(n) if i != q)[:5]
        want += [(q, k + 1, i, -m) for k, (m, i) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_edges(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert mtree_search.top_k_digest(none).isEmpty()
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert mtree_search.top_k_digest(one).isEmpty()
    mixed = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (2, []), (3, [0.5, 1.0, 9.0]), (3, [0.5, 1.0, 9.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in mtree_search.top_k_digest(mixed).orderBy("rank").collect()]
    assert got == [(0, 1, 3, 163840), (0, 2, 3, 163840), (0, 3, 1, 65536), (0, 4, 2, 0)]


def best_of(x, ids, q, own, k):
    s = x @ q
    return sorted(((int(v), int(i)) for v, i in zip(s, ids, strict=True) if i != own), key=lambda t: (-t[0], t[1]))[:k]


def test_bounds_skip_work():
    rng = np.random.default_rng(0)
    centers = rng.normal(0, 300, (20, 4))
    x = (centers[rng.integers(0, 20, 4000)] + rng.normal(0, 5, (4000, 4))).astype(int)
    tree = mtree_search.MTree(np.arange(4000), x, page=32)
    assert len(tree.pages) > 50
    asked = np.arange(0, 4000, 400)
    for block in (asked, asked[:1]):
        tree.computed = 0
        scores, ids = tree.search(x[block], block, 5)
        for q, s, i in zip(block, scores, ids, strict=True):
            assert list(zip(s.tolist(), i.tolist(), strict=True)) == best_of(x, np.arange(4000), x[q], q, 5)
        assert tree.computed < 0.5 * len(block) * len(x)


@pytest.mark.parametrize("big", [1, 1 << 23])
def test_floors_and_large_integers(big):
    rng = np.random.default_rng(2)
    x = rng.integers(-200, 200, (900, 6)) * big
    tree = mtree_search.MTree(np.arange(900) * 3, x, top=9.0 * big * big * 200**2, page=16, fan=4)
    for q in range(0, 900, 100):
        want = best_of(x, np.arange(900) * 3, x[q], 3 * q, 4)
        scores, ids = tree.search(x[[q]], np.array([3 * q]), 4, np.array([want[1][0]]))
        got = [(int(s), int(i)) for s, i in zip(scores[0], ids[0], strict=True) if s > mtree_search._NONE]
        assert got[:2] == want[:2] and all(s >= want[1][0] for s, _ in got)


def test_top_k_ties_over_shards(spark):
    """Equal scores in many shards go to the smallest ids; without room for the routes all shards are asked."""
    rows = [(i, [1.0, 0.0] if i % 3 else [0.5, 0.5]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", mtree_search.integer_vector("embedding").alias("v"))
    for route in (0, 1 << 20):
        got = mtree_search.top_k(df, df.filter("vec_id in (1, 399)"), 3, shard_rows=30, block_rows=1, route_bytes=route)
        found = {q: [(r.vec_id, r.score) for r in got.filter(f"query_id = {q}").orderBy("rank").collect()] for q in (1, 399)}
        assert found == {1: [(2, 65536), (4, 65536), (5, 65536)], 399: [(0, 32768), (1, 32768), (2, 32768)]}


def test_top_k_beyond_64_bits(spark):
    df = spark.createDataFrame([(0, [1e12, 1e12]), (1, [-1e12, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        mtree_search.top_k_digest(df)


def test_token_files(spark, tmp_path):
    texts = corpus(5) + ["a<|endoftext|>b", "don't 's '' 'll  \n x", "中文 \u3000 １２ \U0001f600", "x" * 5000]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    df = frame(spark, texts).selectExpr("doc_id", "text", "'z' AS part", "1 AS ids").repartition(3)
    rows = token_output.token_digest(df, tokenizer_path(), part_bytes=3000).orderBy("doc_id").collect()
    at = 0
    for r, t in zip(rows, texts, strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    path = str(tmp_path / "t")
    token_output.write_tokens(df, path, tokenizer_path(), part_bytes=3000)
    files = sorted((tmp_path / "t").glob("*.parquet"))
    metas = [pq.ParquetFile(f).metadata for f in files]
    assert len(files) > 1
    column = metas[0].row_group(0).column(metas[0].num_columns - 1)
    assert column.has_column_index and column.has_offset_index and any("DICT" in e for e in column.encodings)
    few = token_output.read_tokens(spark, path, [3, 7])
    picked = {r.doc_id: (r.start, r.n_tokens, [*r.ids]) for r in few.collect()}
    everything = {r.doc_id: (r.start, r.n_tokens, [*r.ids]) for r in token_output.read_tokens(spark, path).collect()}
    assert picked == {i: everything[i] for i in (3, 7)}
    assert "PushedFilters: [In(doc_id, [3,7])" in few._jdf.queryExecution().toString()
    token_output.write_tokens(df, str(tmp_path / "g"), tokenizer_path(), part_bytes=1 << 30, row_group_bytes=4096)
    groups = [pq.ParquetFile(f).metadata.num_row_groups for f in (tmp_path / "g").glob("*.parquet")]
    assert max(groups) > 1
    ordered = [i for f in files for i in pq.read_table(f, columns=["doc_id"]).column(0).to_pylist()]
    assert ordered == sorted(ordered)


def test_token_edges(spark):
    df = spark.createDataFrame([(None, "b"), (3, "same"), (3, "other"), (3, None)], "doc_id long, text string")
    rows = token_output.token_digest(df, tokenizer_path()).collect()
    assert sorted(r.start for r in rows)[0] == 0 and len({r.start for r in rows}) == 4
    assert token_output.token_digest(df.limit(0), tokenizer_path()).isEmpty()


def test_hashes_do_not_cross_documents():
    raw = np.frombuffer(b"ab cdab", np.uint8)
    whole, first = word_hashes(raw, np.array([0, 2, 5, 7]))
    assert first.tolist() == [0, 1, 2, 3] and whole[0] == whole[2] != whole[1]
    assert hash_spans(raw, np.array([0]), np.array([2]))[0] == hash_spans(raw, np.array([5]), np.array([7]))[0]
