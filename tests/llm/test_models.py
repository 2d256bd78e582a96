"""Toxicity, decontamination and personal data: held-out accuracy, recall and brute force."""

import random
import re

import numpy as np
import pytest

from orefold.llm import decontaminate, pii, toxicity

from .helpers import frame, words


def labelled(rnd, n):
    texts, toxic, quality = [], [], []
    for _ in range(n):
        w = words(rnd, rnd.randint(20, 90))
        bad = rnd.random() < 0.2
        if bad:
            for _ in range(rnd.randint(1, 5)):
                w.insert(rnd.randrange(len(w)), rnd.choice(["grobian", "wicht", "lump"]))
        junk = rnd.random() < 0.2
        texts.append(" ".join(w) + (" lorem ipsum" if junk else ""))
        toxic.append(int(bad))
        quality.append(int(not junk))
    return texts, toxic, quality


def test_toxicity_held_out(spark):
    rnd = random.Random(1)
    texts, toxic, quality = labelled(rnd, 500)
    docs = frame(spark, [*texts, None, ""]).selectExpr("*", "'c' AS is_toxic", "1 AS p_toxic")
    labels = spark.createDataFrame([(i, quality[i], toxic[i]) for i in range(400)] + [(401, None, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels)
    rows = {r.doc_id: r for r in toxicity.judge(docs, chain).collect()}
    assert len(rows) == 502 and not rows[500].is_toxic and not rows[501].is_toxic
    right = sum(rows[i].is_toxic == bool(toxic[i]) for i in range(400, 500))
    assert right >= 97
    assert chain.weights[1].shape[0] == chain.weights[0].shape[0] + 1  # an earlier category feeds the later one


def test_toxicity_edges(spark):
    docs = frame(spark, ["a b", None])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.is_toxic for r in toxicity.judge(docs, toxicity.train(docs, labels)).collect()] == [False, False]
    assert toxicity.judge(docs.limit(0), toxicity.train(docs, labels)).isEmpty()


def test_toxicity_repeated_labels_rows_and_long_texts(spark):
    rnd = random.Random(3)
    texts, toxic, quality = labelled(rnd, 300)
    long = "wort " * 80_000 + "grobian wicht lump grobian"
    docs = frame(spark, [*texts, long, texts[0], texts[0]])
    rows = [(i, quality[i], toxic[i]) for i in range(300)]
    labels = spark.createDataFrame(rows + rows[:50] + [(7, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels)
    got = toxicity.judge(docs, chain).collect()
    assert len(got) == 303 and chain.weights[1].shape[0] == chain.weights[0].shape[0] + 1
    assert len({r.p_toxic for r in got if r.doc_id in (0, 301, 302)}) == 1
    kept = toxicity.without_toxic(docs.selectExpr("*", "'c' AS is_toxic"), chain)
    assert kept.columns == ["doc_id", "text", "is_toxic"]
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.is_toxic}


def brute_leaks(texts, items):
    """Every item against every place of every text, by the operator's own measure."""
    hashed = lambda t: decontaminate.tk.word_hashes(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0]
    words_of = [hashed(t) for t in items]
    matcher = decontaminate.Matcher(list(range(len(items))), words_of, np.ones(decontaminate.BUCKETS), np.eye(decontaminate.BUCKETS, 4), 0.5, decontaminate.SHARE, decontaminate.ANSWER_SHARE)
    out = set()
    for d, text in enumerate(texts):
        w = hashed(text)
        for i, item in enumerate(words_of):
            hit = np.flatnonzero(np.isin(w, item))
            n, need = len(item), decontaminate.SHARE * len(item)
            for s in range(0, max(1, len(w)), 8):
                low, high = max(0, s - n), min(len(w), s + decontaminate.WINDOW + n)
                if np.searchsorted(hit, high) - np.searchsorted(hit, low) >= need and matcher.accepts(i, w[low:high]):
                    out.add((d, i))
                    break
    return out


def test_leaks_against_brute_force(spark, sf_dir):
    """Recall over all pairs of documents and items of the smallest tables; nothing else is found."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    rows, items = docs.orderBy("doc_id").collect(), bench.orderBy("item_id").collect()
    want = {(rows[d].doc_id, items[i].item_id) for d, i in brute_leaks([r.text for r in rows], [r.text for r in items])}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert len(got & want) >= 0.9 * len(want) and not got - want


def test_leaks_of_repeated_items_and_short_ones(spark):
    rnd = random.Random(8)
    item = " ".join(words(rnd, 20))
    docs = frame(spark, [f"{' '.join(words(rnd, 30))} {item}", f"a b c {' '.join(words(rnd, 30))}"] * 2).selectExpr("doc_id % 2 AS doc_id", "text", "'s' AS share", "1 AS item_id")
    bench = spark.createDataFrame([(1, item), (1, item), (2, item), (3, "a b c")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect())
    assert got == [(0, 1), (0, 1), (0, 2), (0, 2)]
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1, 1]


def test_leaks(spark):
    rnd = random.Random(2)
    items = [" ".join(words(rnd, rnd.randint(15, 50))) for _ in range(30)]
    texts = [" ".join(words(rnd, rnd.randint(5, 300))) for _ in range(120)]
    want = set()
    for k in range(25):
        w = items[k].split()
        if k % 2:  # a paraphrase: some words fall out, others come in
            w = [x for j, x in enumerate(w) if j % 7 != 3]
            w.insert(len(w) // 2, "quite")
        at = texts[k].split()
        cut = rnd.randrange(len(at) + 1)
        texts[k] = " ".join([*at[:cut], *w, *at[cut:]])
        want.add((k, 100 + k))
    docs = frame(spark, [*texts, None, "", "x"])
    bench = spark.createDataFrame([(100 + k, t) for k, t in enumerate(items)] + [(900, None), (901, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench, item_block=20).collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert not got - want
    kept = {r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()}
    assert kept == set(range(123)) - {d for d, _ in got}


def test_leaks_of_long_short_and_repetitive_items(spark):
    rnd = random.Random(7)
    items = [words(rnd, n) for n in (300, 500, 800, 800, 8, 10, 12)] + [["tick"] * 30, ["tock"] * 400]
    texts = [" ".join([*words(rnd, 150), *w, *words(rnd, 150)]) for w in items] + [" ".join(words(rnd, 400)) for _ in range(60)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.share for r in decontaminate.leaks(frame(spark, texts), bench).collect()}
    assert got == {(k, k): 1.0 for k in range(len(items))}


def test_leaks_edges(spark):
    docs, none = frame(spark, ["a b c", None]), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs, none).isEmpty() and decontaminate.without_leaks(docs, none).count() == 2
    assert decontaminate.leaks(docs.limit(0), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).isEmpty()


def test_common_subsequence():
    rnd = random.Random(3)
    for _ in range(200):
        a, b = [rnd.randrange(5) for _ in range(rnd.randrange(1, 20))], [rnd.randrange(5) for _ in range(rnd.randrange(30))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.common_subsequence(np.array(a), np.array(b, int)) == t[-1][-1]


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans():
    rnd = random.Random(5)
    for _ in range(20_000):
        t = "".join(rnd.choice("a.@-1234+ 0() é%\n") for _ in range(rnd.randrange(45)))
        assert pii.base_spans(t) == brute_spans(t)


def test_field_held_out():
    w = np.array(pii.fit())
    good = bad = missed = 0
    for text, spans in pii._examples(200, 99):
        base = pii.base_spans(text)
        got = set(pii.field_spans(text, base, w))
        want = {s for s in spans if not any(a < s[2] and s[1] < b for _, a, b in base)}
        good, bad, missed = good + len(got & want), bad + len(got - want), missed + len(want - got)
    assert good / (good + bad) > 0.97 and good / (good + missed) > 0.9


@pytest.mark.parametrize("text", ["1" * 60_000, "a" * 60_000 + "@", " 12345" * 5000, "@" * 5000, "+1" * 5000, "1.2." * 9000])
def test_long_texts(text):
    pii.field_spans(text, pii.base_spans(text), np.array(pii.fit()))


@pytest.mark.parametrize("lead, secret", [("password=", "AbCdEfGhIjKlMnOp"), ("the secret is: ", None), ("bearer ", "a1B2" * 60), ("İ token = ", "f" * 8 + "0123456789abcdef" * 2)])
def test_unquoted_and_long_secrets(lead, secret):
    text = f"so {lead}{secret or 'quietude'} und so weiter"
    found = pii.field_spans(text, pii.base_spans(text), np.array(pii.fit()))
    at = len(f"so {lead}")
    assert found == ([("secret", at, at + len(secret))] if secret else [])


def test_personal_data_query(spark):
    texts = [None, "", "plain text", "é mail jan@x.org or +32 470 12 34 56 78", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"']
    assert pii.find_personal_data(frame(spark, texts).limit(0)).isEmpty()
    twice = frame(spark, texts).union(frame(spark, texts)).selectExpr("*", "1 AS spans")
    assert sorted(pii.find_personal_data(twice).collect()) == sorted(pii.find_personal_data(frame(spark, texts)).collect() * 2)
    rows = sorted(pii.find_personal_data(frame(spark, texts)).collect())
    assert [r.is_personal for r in rows] == [False, False, False, True, True]
    assert [(r.n_email, r.n_phone) for r in rows] == [(0, 0), (0, 0), (0, 0), (1, 1), (0, 0)]
    assert [r.spans for r in rows] == ["", "", "", "email:7:16,phone:20:39", "secret:9:49"]
    assert pii.redact(texts[3], [("email", 7, 16)]) == "é mail <email> or +32 470 12 34 56 78"


def test_latent_space_of_all_documents(spark):
    """Every document counts: the product is that of brute force, and the space holds what only the last documents say."""
    rnd = random.Random(12)
    common = [" ".join(words(rnd, 40)) for _ in range(4000)]
    texts = [*common, *(f"{t} zyx wvu" for t in common[:50]), "zyx " * 5000, None, ""]
    docs, weights = frame(spark, texts), np.random.default_rng(1).random(decontaminate.BUCKETS) + 0.1
    product, blocks = decontaminate.passage_product(docs, weights)
    raw = [t.encode() for t in texts if t]
    hashed, first = decontaminate.tk.word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    columns, signs = decontaminate._signs()
    thin = np.zeros((decontaminate.BUCKETS, decontaminate.SKETCH))
    np.put_along_axis(thin, columns, signs, 1)
    want, n, half = np.zeros(thin.shape), 0, decontaminate.WINDOW // 2
    for a, b in zip(first, first[1:], strict=False):
        for s in range(a, b, half):
            f = decontaminate._features(hashed[s : min(s + half, b)])
            row = (weights[f, None] * thin[f]).sum(0) / (weights[f] ** 2).sum()
            np.add.at(want, f, weights[f, None] * row)
            n += 1
    assert blocks == n and np.abs(product - want).max() < 1e-5 * np.abs(want).max()
    assert decontaminate.latent_space(np.zeros(want.shape)).shape[1] == 0
    space = decontaminate.latent_space(product)
    assert space.shape[1] == decontaminate.RANK and np.abs(space.T @ space - np.eye(space.shape[1])).max() < 1e-6


def test_toxicity_learns_from_every_labelled_row(spark):
    """A toxic word that stands in 40 of 12,000 labelled rows only, none of which may be left out."""
    rnd = random.Random(21)
    texts = [" ".join(words(rnd, 12)) for _ in range(12_000)]
    order = spark.range(12_000).selectExpr("id", "xxhash64(id) AS h").orderBy("h").collect()
    bad = [r.id for r in order[-40:]]
    for i in bad:
        texts[i] += " grobian wicht"
    labels = spark.createDataFrame([(i, 1, int(i in set(bad))) for i in range(12_000)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(frame(spark, texts), labels)
    got = toxicity.judge(frame(spark, ["er on an grobian wicht", "er on an in", None]), chain).orderBy("doc_id").collect()
    assert [r.is_toxic for r in got] == [True, False, False]


def test_toxicity_fit_reaches_the_minimum(spark):
    """The passes over packed rows give the gradient of brute force, which is zero at the fitted weights."""
    rnd = np.random.default_rng(4)
    x, y = rnd.random((400, 30)) < 0.2, rnd.random(400) < 0.3
    fold = rnd.integers(0, toxicity.FOLDS, 400)
    parts = np.array_split(np.arange(400), 7)
    table = [((fold[p] * 4 + y[p]).astype(np.int8).tobytes(), x[p].sum(1).astype(np.int32).tobytes(), np.nonzero(x[p])[1].astype(np.uint16).tobytes()) for p in parts]
    rows = spark.createDataFrame([tuple(map(bytearray, r)) for r in table], "codes binary, sizes binary, words binary")
    models = [toxicity.Model(-1, np.arange(30), (2.0, 1.0)), toxicity.Model(3, np.arange(0, 30, 2), (3.0, 1.0))]
    fits = toxicity._fit(rows, models, [np.full(31, 0.05), np.full(16, 0.05)], 1, [], 30)
    for model, w in zip(models, fits, strict=True):
        dense = np.hstack([x[:, model.words], np.ones((400, 1))])
        weight = np.where(y, *model.rows) * (fold != model.apart)
        slope = dense.T @ (weight * (1 / (1 + np.exp(-dense @ w)) - y)) + toxicity.L2 * w
        assert np.abs(slope).max() < 0.3 and np.abs(w).max() > 0.1


def test_toxicity_of_labels_joined_or_looked_up(spark, monkeypatch):
    """Both ways to the labelled rows give one chain: null and repeated ids and texts, labels without a document."""
    rnd = random.Random(33)
    texts, toxic, quality = labelled(rnd, 300)
    docs = frame(spark, [*texts, None, texts[0]]).union(frame(spark, [texts[5]]).selectExpr("CAST(NULL AS BIGINT)", "text"))
    docs = docs.union(docs.filter("doc_id = 7"))
    rows = [(i, quality[i], toxic[i]) for i in range(300)] + [(300, 1, 0), (7, 1, 1), (999, 0, 1), (None, 1, 1), (8, None, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    one = toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "LOOKED_UP", 0)
    other = toxicity.train(docs, labels)
    assert len(one.vocabulary) and (one.vocabulary == other.vocabulary).all() and abs(one.threshold - other.threshold) < 1e-6
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(one.weights, other.weights, strict=True))
