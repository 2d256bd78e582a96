"""Toxicity by a classifier chain of linear models.

The categories are predicted one after another: ``low_quality``, then ``toxic``. Each model is a logistic
regression over the words present in the whole text, and gets the probabilities of the earlier categories as
further features. While training, those are out-of-fold predictions: rows are put in folds by a hash of their
words, so that copies of a text are never on both sides, and the words a model looks at are chosen
on its own training rows; when scoring, they come from the models fitted on all training rows. The threshold
of ``is_toxic`` is chosen on out-of-fold predictions, too.

Training takes every labelled row. Words are counted by Spark, and the chosen ones of each row (numbers, packed by
thousands of rows) are saved; each step of the fit is one pass over these that sends a loss and a gradient for each
model. The driver gets chosen words, gradients and cells of scores, never texts or rows. Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk
from .scratch import free, long_texts, release, save

CATEGORIES = ("low_quality", "toxic")
FOLDS = 5
#: At most so many words for each model, none of them in more than this share of its rows.
FEATURES = 1600
COMMON = 0.2
#: A word is a feature if its presence parts a class with at least this statistic (one chance in 10,000).
CHI_SQUARE = 15.0
L2 = 0.3
#: Steps of a fit at most, and the relative gain that ends it.
STEPS = 200
GAIN = 1e-5
#: Words of a task that are counted at once, rows in a pack, cells of scores between 0 and 1.
_PENDING = 1 << 17
_PACK = 1 << 13
_CELLS = 1 << 14
_CODES = FOLDS * 4
#: Up to so many labelled ids each task looks them up in sorted arrays (9 bytes an id); more are joined by a shuffle of the texts.
LOOKED_UP = 1 << 23


@dataclass(frozen=True)
class Chain:
    """Sorted word hashes, a row of weights for each category over words, earlier probabilities and 1; a threshold."""

    vocabulary: np.ndarray
    weights: np.ndarray
    threshold: float


def _looked_up(ids: np.ndarray, labels: np.ndarray) -> Callable:
    """Text, quality and toxic of the rows whose id is one of the sorted ids; a label is 2 for good quality plus 1 for toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            own = batch.column("doc_id").to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
            inside = ids[at] == own
            label = labels[at[inside]]
            text = batch.column("text").filter(pa.array(inside))
            yield pa.RecordBatch.from_arrays([text, pa.array(label // 2), pa.array(label % 2)], ["text", "quality", "toxic"])

    return run


def _labelled(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, Callable, list]:
    """Rows and what makes text, quality and toxic of each labelled one of their batches, and what to free at the end."""
    agreed = labels.dropna(subset=["doc_id", "quality", "toxic"]).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    label = (F.when(F.col("quality") < 1, 0).otherwise(2) + F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("label")
    agreed = save(agreed.select("doc_id", label), "labels")
    whole = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)
    if all(isinstance(df.schema["doc_id"].dataType, whole) for df in (documents, agreed)) and 0 < agreed.count() <= LOOKED_UP:
        table = agreed.select(F.col("doc_id").cast("long"), F.col("label").cast("byte")).toArrow().combine_chunks()
        free(agreed)
        ids, label = table.column("doc_id").to_numpy(), table.column("label").to_numpy()
        order = np.argsort(ids)
        known = documents.sparkSession.sparkContext.broadcast((ids[order], label[order]))
        return documents.select("doc_id", "text"), lambda batches: _looked_up(*known.value)(batches), [known]
    rows = documents.select("doc_id", "text").join(agreed, "doc_id")
    rows = save(rows.select("text", F.floor(F.col("label") / 2).cast("int").alias("quality"), (F.col("label") % 2).cast("int").alias("toxic")), "labelled")
    free(agreed)
    return rows, iter, [rows]


def _codes(part: pa.RecordBatch, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fold, low quality and toxic of each row in one number; the fold is that of its least word hash."""
    lead, some = np.zeros(len(first) - 1, np.uint64), np.diff(first) > 0
    if some.any():
        lead[some] = np.minimum.reduceat(words, first[:-1][some])
    low = part.column("quality").to_numpy() < 1
    toxic = part.column("toxic").to_numpy() > 0
    return (lead % np.uint64(FOLDS)).astype(np.int64) * 4 + low * 2 + toxic


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, code, n: how many rows of each code hold the word; the null word stands in every row."""
    rows, pending, held = np.zeros(_CODES, np.int64), [], 0

    def counted() -> pa.RecordBatch:
        words, at = np.unique(np.concatenate([w for w, _ in pending]), return_inverse=True)
        n = np.bincount(at * _CODES + np.concatenate([c for _, c in pending]), minlength=len(words) * _CODES)
        some = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays(
            [pa.array(words[some // _CODES].view(np.int64)), pa.array((some % _CODES).astype(np.int32)), pa.array(n[some])], ["word", "code", "n"]
        )

    for batch in batches:
        for part, raw, offsets in tk.chunks(batch, "text"):
            words, first = tk.word_hashes(raw, offsets)
            codes = _codes(part, words, first)
            rows += np.bincount(codes, minlength=_CODES)
            values, first = tk.distinct(words, tk.rows_of(first), len(first) - 1)
            pending.append((values, codes[tk.rows_of(first)]))
            held += len(values)
            if held >= _PENDING:
                yield counted()
                pending, held = [], 0
    if held:
        yield counted()
    yield pa.RecordBatch.from_arrays([pa.nulls(_CODES, pa.int64()), pa.array(np.arange(_CODES, dtype=np.int32)), pa.array(rows)], ["word", "code", "n"])


def packs(vocabulary: np.ndarray):
    """For mapInArrow: the code of each row, how many words of the vocabulary it holds, and which; packed by many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def packed() -> pa.RecordBatch:
            columns = [np.concatenate(c).astype(k).tobytes() for c, k in zip(zip(*held, strict=True), (np.int8, np.int32, np.uint16), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], ["codes", "sizes", "words"])

        for batch in batches:
            for part, raw, offsets in tk.chunks(batch, "text"):
                words, first = tk.word_hashes(raw, offsets)
                codes, size = _codes(part, words, first), len(vocabulary)
                pair = np.zeros(0, np.int64)
                if size:
                    at = np.minimum(np.searchsorted(vocabulary, words), size - 1)
                    hit = np.flatnonzero(vocabulary[at] == words)
                    pair = np.unique(tk.rows_of(first)[hit] * size + at[hit])
                held.append((codes, np.bincount(pair // max(1, size), minlength=len(codes)), pair % max(1, size)))
                if sum(len(c) for c, _, _ in held) >= _PACK:
                    yield packed()
                    held = []
        if held:
            yield packed()

    return run


@dataclass(frozen=True)
class Model:
    """A model's fold that it isn't trained on (-1: none), its words' places, and the weights of a positive and of another row."""

    apart: int
    words: np.ndarray
    rows: tuple[float, float]

    def wide(self, w: np.ndarray, size: int) -> np.ndarray:
        """Weights of its words among all words, 0 for others."""
        out = np.zeros(size)
        out[self.words] = w[: len(self.words)]
        return out


@dataclass(frozen=True)
class Held:
    """Out-of-fold predictions: for each fold the weights of all words and the dense ones, or a fixed value."""

    words: np.ndarray
    dense: np.ndarray
    fixed: np.ndarray


class Pack:
    """Rows of a pack, with the out-of-fold probabilities of earlier categories and 1 as dense columns."""

    def __init__(self, codes: bytes, sizes: bytes, words: bytes, earlier: list[Held]):
        code = np.frombuffer(codes, np.int8).astype(np.int64)
        self.fold, self.labels = code // 4, (code // 2 % 2, code % 2)
        self.row = np.repeat(np.arange(len(code)), np.frombuffer(sizes, np.int32))
        self.word = np.frombuffer(words, np.uint16).astype(np.int64)
        self.dense = np.ones((len(code), 1))
        for held in earlier:
            self.dense = np.hstack([self.dense[:, :-1], self.predicted(held)[:, None], self.dense[:, -1:]])

    def times(self, words: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=words[self.word], minlength=len(self.dense)) + self.dense @ dense

    def predicted(self, held: Held) -> np.ndarray:
        z = np.bincount(self.row, weights=held.words[self.fold[self.row], self.word], minlength=len(self.dense)) + (self.dense * held.dense[self.fold]).sum(1)
        fixed = held.fixed[self.fold]
        return np.where(np.isnan(fixed), 1 / (1 + np.exp(-np.clip(z, -30, 30))), fixed)

    def slope(self, model: Model, w: np.ndarray, label: int, size: int) -> np.ndarray:
        """The loss of the model's rows and its gradient."""
        y = self.labels[label]
        weight = np.where(y > 0, *model.rows) * (self.fold != model.apart)
        z = self.times(model.wide(w, size), w[len(model.words) :])
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss = (weight * (np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))) - y * z)).sum()
        v = weight * (p - y)
        return np.concatenate([[loss], np.bincount(self.word, weights=v[self.row], minlength=size)[model.words], v @ self.dense])


def _opened(batches: Iterator[pa.RecordBatch], earlier: list[Held]) -> Iterator[Pack]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Pack(*(batch.column(c)[k].as_py() for c in ("codes", "sizes", "words")), earlier)


def _slopes(rows: DataFrame, models: list[tuple[Model, np.ndarray]], label: int, earlier: list[Held], size: int) -> list[np.ndarray]:
    """Losses and gradients of the models over all rows, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for pack in _opened(batches, earlier):
            part = np.concatenate([pack.slope(model, w, label, size) for model, w in models])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["body"])

    total = np.zeros(sum(1 + len(w) for _, w in models))
    for r in rows.mapInArrow(run, "body binary").collect():
        total += np.frombuffer(r["body"], np.float64)
    out = np.split(total, np.cumsum([1 + len(w) for _, w in models])[:-1])
    for part, (_, w) in zip(out, models, strict=True):
        part[0] += L2 / 2 * (w @ w)
        part[1:] += L2 * w
    return out


def _minimum(scale: np.ndarray, history: int = 12) -> Generator[np.ndarray, np.ndarray, np.ndarray]:
    """Limited-memory BFGS steps: yields points, is sent the loss and the gradient there; ``scale`` guesses the inverse curvature."""
    w, kept = np.zeros(len(scale)), []
    at = yield w
    for _ in range(STEPS):
        loss, gradient = at[0], at[1:]
        d, used, factor = -gradient, [], 1.0
        for s, y in reversed(kept):
            used.append((s @ d) / (s @ y))
            d = d - used[-1] * y
        if kept:
            s, y = kept[-1]
            factor = (s @ y) / (y @ (scale * y))
        d = factor * scale * d
        for (s, y), u in zip(kept, reversed(used), strict=True):
            d = d + (u - (y @ d) / (s @ y)) * s
        fall, step = float(gradient @ d), 1.0
        if fall > -1e-12 * max(1.0, abs(loss)):
            break
        while True:
            new = w + step * d
            there = yield new
            gain = loss - there[0]
            if gain >= -1e-4 * step * fall:
                break
            step = min(step / 2, max(step / 10, -fall * step * step / (2 * max(1e-300, -gain - fall * step))))
            if step < 1e-8:
                return w
        if (new - w) @ (there[1:] - gradient) > 0:
            kept = [*kept[1 - history :], (new - w, there[1:] - gradient)]
        w, at = new, there
        if gain <= GAIN * abs(loss):
            break
    return w


def _fit(rows: DataFrame, models: list[Model], scales: list[np.ndarray], label: int, earlier: list[Held], size: int) -> list[np.ndarray]:
    """Logistic regressions, each model's own steps in passes that all share."""
    fits = [_minimum(scale) for scale in scales]
    points, done = {k: next(fit) for k, fit in enumerate(fits)}, {}
    while points:
        order = sorted(points)
        for k, at in zip(order, _slopes(rows, [(models[k], points[k]) for k in order], label, earlier, size), strict=True):
            try:
                points[k] = fits[k].send(at)
            except StopIteration as end:
                done[k] = end.value
                del points[k]
    return [done[k] for k in range(len(models))]


def _threshold(rows: DataFrame, held: list[Held], n_toxic: int) -> float:
    """The cut of the best F0.5 over all rows' out-of-fold scores, halfway to the next clean row; 0.5 at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, toxic = np.zeros(_CELLS + 1, np.int64), np.zeros(_CELLS + 1, np.int64)
        least, clean = np.full(_CELLS + 1, np.inf), np.full(_CELLS + 1, -np.inf)
        for pack in _opened(batches, held):
            score, y = pack.dense[:, -2], pack.labels[1]
            cell = (score * _CELLS).astype(np.int64)
            n += np.bincount(cell, minlength=_CELLS + 1)
            toxic += np.bincount(cell[y > 0], minlength=_CELLS + 1)
            np.minimum.at(least, cell, score)
            np.maximum.at(clean, cell[y == 0], score[y == 0])
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (np.arange(_CELLS + 1), n, toxic, least, clean)], ["cell", "n", "toxic", "least", "clean"])

    cells = rows.mapInArrow(run, "cell long, n long, toxic long, least double, clean double").groupBy("cell")
    got = sorted(cells.agg(F.sum("n"), F.sum("toxic"), F.min("least"), F.max("clean")).collect())
    n, toxic, cuts, clean = (np.array([r[k] for r in got], float) for k in range(1, 5))
    f_half = 1.25 * toxic[::-1].cumsum()[::-1] / np.maximum(1, n[::-1].cumsum()[::-1] + 0.25 * n_toxic)
    high = np.flatnonzero(cuts >= 0.5) if (cuts >= 0.5).any() else np.array([len(cuts) - 1])
    best = int(high[np.argmax(f_half[high])])
    below = clean[:best].max(initial=-np.inf)
    return float(max(0.5, (cuts[best] + (below if np.isfinite(below) else cuts[best])) / 2))


def _chosen(sums: DataFrame, totals: np.ndarray, sets: list[list[int]]) -> list:
    """The words that part one of the classes best in the rows of each set of folds, with their counts."""
    tops = []
    for k, folds in enumerate(sets):
        n = int(totals[0, folds].sum())
        seen = sum((F.col(f"n{f}") for f in folds), F.lit(0)).cast("double")
        for c in (1, 2):
            positive = int(totals[c, folds].sum())
            of_class = sum((F.col(f"{'nlt'[c]}{f}") for f in folds), F.lit(0)).cast("double")
            expected = seen * F.lit(positive / n)
            spread = F.greatest(expected * (1 - seen / n) * F.lit(1 - positive / n), F.lit(1e-9))
            fits = (seen >= min(3, n)) & (seen <= max(3.0, COMMON * n))
            tops.append(F.struct(F.lit(k).alias("set"), F.lit(c).alias("label"), F.when(fits, (of_class - expected) * (of_class - expected) / spread).alias("chi2")))
    each = sums.filter("word is not null").withColumn("top", F.explode(F.array(*tops))).filter(F.col("top.chi2") >= CHI_SQUARE)
    place = F.row_number().over(Window.partitionBy("top.set", "top.label").orderBy(F.col("top.chi2").desc(), "word"))
    return each.withColumn("place", place).filter(F.col("place") <= FEATURES // 2).collect()


def _drop(*made) -> None:
    for one in made:
        free(one) if isinstance(one, DataFrame) else one.destroy()


def train(documents: DataFrame, labels: DataFrame) -> Chain:
    """Fit on all labelled ids; rows with a null label or id take no part.

    An id with several labels is toxic if one says so, and of the lowest quality of them; an id with several
    documents gives a row for each. Without documents or labels, or without toxic ones, nothing is toxic.
    """
    long_texts(documents.sparkSession)
    rows, only, made = _labelled(documents, labels)
    code, n = F.col("code"), F.col("n")
    which = {"n": F.lit(True), "l": code % 4 >= 2, "t": code % 2 == 1}
    counts = [F.sum(F.when((F.floor(code / 4) == f) & is_of, n).otherwise(0)).alias(f"{c}{f}") for c, is_of in which.items() for f in range(FOLDS)]
    sums = rows.mapInArrow(lambda batches: count_words(only(batches)), "word long, code int, n long").groupBy("word").agg(*counts)
    # a word of fewer rows is no feature of any model
    sums = save(sums.filter(F.col("word").isNull() | (sum(F.col(f"n{f}") for f in range(FOLDS)) >= 3)), "words")
    whole = sums.filter("word is null").first()
    totals = np.array([[whole[f"{c}{f}"] if whole else 0 for f in range(FOLDS)] for c in which], np.int64)
    if not totals[2].sum():
        _drop(sums, *made)
        return Chain(np.zeros(0, np.uint64), np.zeros(0, object), 0.5)
    every = [f for f in range(FOLDS) if totals[0, f]]
    parts = every if len(every) > 1 else []
    sets = [every, *([f for f in every if f != apart] for apart in parts)]
    found = _chosen(sums, totals, sets)
    vocabulary = np.unique(np.array([r["word"] for r in found], np.int64).view(np.uint64))
    seen = {int(np.uint64(r["word"] & ((1 << 64) - 1))): np.array([[r[f"{c}{f}"] for f in range(FOLDS)] for c in which]) for r in found}
    of_words = np.array([seen[int(w)] for w in vocabulary]).reshape(len(vocabulary), 3, FOLDS)
    words = [np.unique(np.searchsorted(vocabulary, np.array([r["word"] for r in found if r["top"]["set"] == k], np.int64).view(np.uint64))) for k in range(len(sets))]
    packed = save(rows.mapInArrow(lambda batches: packs(vocabulary)(only(batches)), "codes binary, sizes binary, words binary"), "packs")
    _drop(sums, *made)
    size, earlier, weights = len(vocabulary), [], []
    for label in range(len(CATEGORIES)):
        models, scales = [], []
        for apart, folds, own in zip([-1, *parts], sets, words, strict=True):
            n, positive = int(totals[0, folds].sum()), int(totals[label + 1, folds].sum())
            models.append(Model(apart, own, (np.sqrt(n / max(1, positive)), np.sqrt(n / max(1, n - positive)))))
            in_class, in_all = of_words[own][:, label + 1, folds].sum(1), of_words[own][:, 0, folds].sum(1)
            dense = np.full(label + 1, [positive]), np.full(label + 1, [n])
            in_class, in_all = np.append(in_class, dense[0]), np.append(in_all, dense[1])
            # classes weigh as their square roots; a row's curvature is a quarter at most
            scales.append(1 / (0.25 * (models[-1].rows[0] * in_class + models[-1].rows[1] * (in_all - in_class)) + L2))
        fitted = _fit(packed, models, scales, label, earlier, size)
        held = Held(np.zeros((FOLDS, size)), np.zeros((FOLDS, label + 1)), np.full(FOLDS, totals[label + 1].sum() / totals[0].sum()))
        for apart, model, w in zip(parts, models[1:], fitted[1:], strict=True):
            held.words[apart], held.dense[apart], held.fixed[apart] = model.wide(w, size), w[len(model.words) :], np.nan
        earlier = [*earlier, held]
        weights.append(fitted[0])
    threshold = _threshold(packed, earlier, int(totals[2].sum()))
    free(packed)
    release()
    rows_of_weights = np.empty(len(CATEGORIES), object)
    rows_of_weights[:] = weights
    return Chain(vocabulary[words[0]], rows_of_weights, threshold)


def scorer(chain: Chain, columns: list[str]):
    """For mapInArrow: the columns as they are, a probability for each category and ``is_toxic``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(chain.vocabulary)
        for batch in batches:
            for part, raw, offsets in tk.chunks(batch, "__text"):
                words, first = tk.word_hashes(raw, offsets)
                n = len(offsets) - 1
                p = []
                if size:
                    at = np.minimum(np.searchsorted(chain.vocabulary, words), size - 1)
                    hit = np.flatnonzero(chain.vocabulary[at] == words)
                    pair = np.unique(tk.rows_of(first)[hit] * size + at[hit])
                    for w in chain.weights:
                        value = np.bincount(pair // size, weights=w[pair % size], minlength=n) + w[-1]
                        for k, earlier in enumerate(p):
                            value = value + w[size + k] * earlier
                        p.append(1 / (1 + np.exp(-np.clip(value, -30, 30))))
                else:
                    p = [np.zeros(n) for _ in CATEGORIES]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), *(pa.array(v, pa.float64()) for v in p), pa.array(p[-1] >= chain.threshold)],
                    [*columns, *(f"p_{c}" for c in CATEGORIES), "is_toxic"],
                )

    return run


def judge(documents: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """All columns but replaced ones, ``p_<category>`` and ``is_toxic``, for every row.

    Null and empty texts have no words; equal texts get equal probabilities. An empty table gives an empty result.
    """
    long_texts(documents.sparkSession)
    names = {"is_toxic", "__text", *(f"p_{c}" for c in CATEGORIES)}
    columns = [c for c in documents.columns if c.lower() not in names]
    source = documents.select(*columns, F.col(text).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*columns).schema.fields)
    added = ", ".join([*(f"p_{c} double" for c in CATEGORIES), "is_toxic boolean"])
    return source.mapInArrow(scorer(chain, columns), f"{kinds}, {added}")


def without_toxic(documents: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """The rows that the chain doesn't call toxic, with all their columns, whatever these are called.

    Null and empty texts stay; rows that repeat a text go or stay together. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(chain, [])
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(text))], ["__text"])
            toxic = [x.column("is_toxic").to_numpy(zero_copy_only=False) for x in score(iter([texts]))]
            yield batch.filter(pa.array(~np.concatenate([np.zeros(0, bool), *toxic])))

    long_texts(documents.sparkSession)
    return documents.mapInArrow(run, documents.schema)
