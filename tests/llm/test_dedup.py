"""The similarity join and the suffix-array removal against brute force."""

import hashlib
import random

import numpy as np
import pytest

from orefold.llm import jaccard_join, substring_dedup
from orefold.llm import suffix_array as sa
from orefold.llm.suffix_array import common_prefixes, suffix_array

from .helpers import corpus, edited, frame, shingles, words


def brute_links(texts):
    sets = [shingles(t) for t in texts]
    links = {i: set() for i in range(len(texts))}
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i].add(j)
                links[j].add(i)
    return links


def classes(links):
    label = {i: i for i in links}
    moved = True
    while moved:
        moved = False
        for i in links:
            low = min([label[i], *(label[j] for j in links[i])])
            moved |= low != label[i]
            label[i] = low
    return label


@pytest.mark.parametrize("seed, tile", [(1, 512), (2, 3)])
def test_join(spark, seed, tile):
    texts = corpus(seed)
    rnd = random.Random(seed)
    big = " ".join(words(rnd, 150))
    texts += [edited(rnd, big, 0.006) for _ in range(25)]
    want = brute_links(texts)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(frame(spark, texts), tile=tile).collect()}
    label = classes(want)
    assert got == {i: (label[i], len(want[i])) for i in want}


def test_join_edges(spark):
    text = " ".join(words(random.Random(4), 30))
    df = spark.createDataFrame([(None, text, "x"), (7, text, "x"), (7, text, "y"), (8, None, "z"), (9, "", "z")], "doc_id long, text string, set string")
    got = sorted((r.doc_id or 0, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(df).collect())
    assert got == [(0, 7, 2), (7, 7, 2), (7, 7, 2), (8, 8, 0), (9, 9, 0)]
    assert jaccard_join.near_duplicates(df.limit(0)).isEmpty()


def test_join_null_ids(spark):
    """Null ids have links to near copies; of rows alike in id and text each counts."""
    a = words(random.Random(6), 200)
    near, other = " ".join([*a[:100], "zz", *a[101:]]), " ".join([*a[:50], "yy", *a[51:]])
    df = spark.createDataFrame([(None, " ".join(a)), (7, near), (None, other), (None, other)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(df).collect())
    assert got == [(0, 7, 3)] * 3 + [(7, 7, 3)]
    none = jaccard_join.near_duplicates(df.filter("doc_id is null")).collect()
    assert [(r.doc_id, r.class_id, r.n_links) for r in none] == [(None, None, 2)] * 3


def test_runs():
    assert jaccard_join.runs_for(0.5) < jaccard_join.runs_for(0.99) <= jaccard_join.runs_for(0.9999)


def test_components(spark):
    rows = [(i, i + 1) for i in range(20)] + [(100, 101), (200, 200)]
    got = {r.node: r.label for r in jaccard_join.components(spark.createDataFrame(rows, "node long, root long")).collect()}
    assert set(got) == {*range(21), 100, 101, 200}
    assert len({got[i] for i in range(21)}) == 1 and got[100] == got[101] and len(set(got.values())) == 3


@pytest.mark.parametrize("seed, single", [(0, 1 << 16), (1, 0), (2, 0), (3, 5)])
def test_suffix_arrays(seed, single, monkeypatch):
    monkeypatch.setattr(sa, "SINGLE", single)
    monkeypatch.setattr(sa.induce, "__defaults__", (single,))
    rng = np.random.default_rng(seed)
    for _ in range(250):
        n = int(rng.integers(1, 70))
        s = rng.integers(0, rng.integers(1, 5) + 1, n).astype(np.uint8) * 50
        b = s.tobytes()
        want = sorted(range(n), key=lambda i: b[i:])
        order = suffix_array(s)
        assert order.tolist() == want
        agree = common_prefixes(s, order, 9)
        for k in range(1, n):
            x, y = b[want[k] :][:9], b[want[k - 1] :][:9]
            assert agree[want[k]] == next((j for j in range(9) if x[j : j + 1] != y[j : j + 1] or j >= min(len(x), len(y))), 9)


def test_recursion(monkeypatch):
    """A text whose LMS substrings repeat, and the names of these again."""
    seen = []
    inner = sa._sorted_suffixes
    monkeypatch.setattr(sa.induce, "__defaults__", (2000,))
    monkeypatch.setattr(sa, "_sorted_suffixes", lambda text: seen.append(int(text.max()) + 1) or inner(text))
    rnd = random.Random(5)
    b = (" ".join(rnd.choice(["the", "then", "there", "hat", "that"]) for _ in range(6000))).encode()
    order = suffix_array(np.frombuffer(b, np.uint8))
    assert len(seen) >= 4 and max(seen) > 300
    assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])


def test_anchors_of_long_texts(monkeypatch):
    raw = np.frombuffer("".join(words(random.Random(1), 3000)).encode(), np.uint8)
    of = lambda: {w: (int(h), int(p)) for h, a, b, _, p in zip(*substring_dedup.anchors(raw, np.array([0, len(raw)])), strict=True) for w in range(a, b + 1)}
    whole = of()
    monkeypatch.setattr(substring_dedup, "PIECE_BYTES", 700)
    assert of() == whole and len(whole) == len(raw) - 49


def brute_cuts(rows, length):
    first = {}
    for rank, text in rows:
        for i in range(len(text) - length + 1):
            w = text[i : i + length]
            first[w] = min(first.get(w, rank), rank)
    out = []
    for rank, text in rows:
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            if first[text[i : i + length]] < rank:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        out.append((len(text), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed, tile", [(0, 2048), (1, 2), (2, 7)])
def test_removal(spark, seed, tile):
    texts = corpus(seed, 40) + ["ab" * 200, "b" + "ab" * 90, "a" * 300, "a" * 49, "a" * 50, "x" * 50]
    random.Random(seed).shuffle(texts)
    passage = " ".join(words(random.Random(9), 25))
    texts += [f"{' '.join(words(random.Random(90 + i), 9))} {passage} {' '.join(words(random.Random(900 + i), 9))}" for i in range(40)]
    found = substring_dedup.repeats_digest(frame(spark, texts), part_bytes=2000, bucket_bytes=4000, tile=tile).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found}
    want = brute_cuts([(i, (t or "").encode()) for i, t in enumerate(texts)], 50)
    assert got == dict(enumerate(want))


def test_removal_edges(spark):
    text = "".join(words(random.Random(3), 60))
    rows = [(5, text, 1), (5, text + "!", 1), (None, text, 2), (5, text, 3), (1, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rank int")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in substring_dedup.repeats_digest(df).collect())
    n = len(text)
    assert got == [(0, n, n), (1, 0, 0), (5, n, 0), (5, n, 0), (5, n + 1, 0)]
    assert substring_dedup.repeats_digest(df.limit(0)).isEmpty()


def test_removal_gives_texts(spark):
    text = "".join(words(random.Random(3), 60))
    rows = {r.doc_id: r for r in substring_dedup.remove_repeats(frame(spark, [text, f"é{text}ü", None])).collect()}
    n = len(text)
    assert [bytes(rows[i].kept).decode() for i in range(3)] == [text, "éü", ""]
    assert [[tuple(s) for s in rows[i].spans] for i in range(3)] == [[], [(2, n + 2)], []]
