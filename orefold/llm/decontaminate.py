"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of ``WINDOW`` words in steps of half of it; their words hash to ``BUCKETS``
features, weighted by inverse document frequencies over all documents. A randomised singular value
decomposition gives the latent space: one distributed pass multiplies the sparse passages of every document
by a thin sparse matrix of signs and back, and a small eigenproblem is solved on the driver (Nystrom's
approximation). The benchmark's items get half to two thirds of the weight; their part is added on the driver, so all blocks of
items share the pass. Every passage of every document is then projected and compared.
Items of more than ``WINDOW`` words are cut into overlapping pieces of that size, and every piece is
searched; shorter ones are also compared with windows of 16 or 8 words. Passages whose latent cosine with
a piece reaches ``cosine`` are candidates for its item. A candidate counts if, in the document's words
around the passage, the longest common subsequence has at least ``share`` of the item's words, and at
least ``answer_share`` of the words of its last quarter (where the answer is).

The space gets further directions for pieces that it holds almost nothing of (one word again and again).

Items are taken in blocks of about ``item_block`` pieces, each with a space of its own, and ``SCAN_BLOCKS`` blocks are
compared in one scan, so what each task holds is bounded by these or by the longest item.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .scratch import long_texts, release

BUCKETS = 1 << 14
RANK = 96
#: Columns of the matrix of signs, and how many of them a feature is in.
SKETCH = 256
SIGNS = 1
#: The first components hold the common words of the languages; passages are compared without them.
LEADING = 8
WINDOW = 32
#: Windows of the documents, and the least words of the pieces that are compared with them alone.
SCALES = ((8, 0), (16, 10), (WINDOW, 20))
#: Pieces of which the space holds a smaller part of the length get directions of their own, so many at most.
HELD = 0.1
OWN = 128
ITEM_BLOCK = 1024
COSINE = 0.5
SHARE = 0.6
ANSWER_SHARE = 0.5
#: Shorter items stand in texts by chance and are not asked.
LEAST_WORDS = 4
#: So many blocks of items are compared in one scan of the documents.
SCAN_BLOCKS = 8
_ROWS = 1 << 6
#: So many blocks of words are multiplied at once, whatever the length of a text.
_BLOCKS = 1 << 10
#: Texts are taken in pieces of about this size, whose sums fit a processor's cache; a longer text is a piece of its own.
CHUNK_BYTES = 256 << 10


def _features(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1)


def document_frequencies(documents: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each feature stands, and how many documents there are; over all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for part, raw, offsets in tk.chunks(batch, "text", 512 << 10):
                words, first = tk.word_hashes(raw, offsets)
                pair = tk.rows_of(first) * BUCKETS + _features(words)
                seen = np.zeros((len(offsets) - 1) * BUCKETS, bool) if len(offsets) < 2048 else None
                if seen is not None:
                    seen[pair] = True
                    total += seen.reshape(-1, BUCKETS).sum(0)
                else:
                    total += np.bincount(np.unique(pair) % BUCKETS, minlength=BUCKETS)
                n += part.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], ["feature", "n"])

    rows = documents.select(F.col(text).alias("text")).mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    found, n = np.zeros(BUCKETS, np.int64), 0
    for r in rows:
        if r["feature"] < 0:
            n = r["n"]
        else:
            found[r["feature"]] = r["n"]
    return found, n


def _windows(words: np.ndarray, first: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half-window blocks of the documents: starts, ends, and for each block whether the next one is of the same document."""
    half = window // 2
    sizes = np.diff(first)
    count = -(-sizes // half)
    doc = np.repeat(np.arange(len(sizes)), count)
    starts = first[:-1][doc] + half * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
    ends = np.minimum(starts + half, first[1:][doc])
    return starts, ends, doc


def _padded(table: np.ndarray) -> np.ndarray:
    """The table as 32-bit floats with a row of zeros, the feature of places without a word."""
    return np.ascontiguousarray(np.vstack([table, np.zeros((1, table.shape[1]))]), np.float32)


def _block_sums(table: np.ndarray, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the words' rows of a padded table for each block; one word of every block at a time, so that sums stay in cache."""
    features = np.append(_features(words).astype(np.int32), np.int32(BUCKETS))
    sums = np.zeros((len(starts), table.shape[1]), np.float32)
    row = np.empty_like(sums)
    for j in range(int((ends - starts).max(initial=0))):
        np.take(table, features[np.where(starts + j < ends, starts + j, len(words))], axis=0, out=row, mode="clip")
        sums += row
    return sums


def _pairs(sums: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Sums of each block and the next of its document."""
    out = sums.copy()
    if len(doc) > 1:
        out[:-1] += np.where((doc[1:] == doc[:-1])[:, None], sums[1:], 0)
    return out


def _signs(seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The matrix of signs: for each feature ``SIGNS`` distinct columns and their signs; the same on every machine."""
    rnd = np.random.default_rng(seed)
    columns = np.vstack([rnd.random((min(_BLOCKS, BUCKETS - s), SKETCH)).argsort(1)[:, :SIGNS] for s in range(0, BUCKETS, _BLOCKS)])
    return columns, rnd.choice([-1.0, 1.0], columns.shape)


class _Product:
    """A^T (A S) for the matrix S of signs; A has a row of unit length for each block of passages."""

    def __init__(self, weights: np.ndarray):
        columns, signs = _signs()
        # one more feature, of weight 0, for places without a word
        self.squares = np.append(weights**2, 0.0)
        self.columns = np.vstack([columns, np.zeros((1, SIGNS), columns.dtype)])
        self.signed = np.vstack([signs * weights[:, None], np.zeros((1, SIGNS))])
        self.weights, self.total, self.blocks = weights, np.zeros((BUCKETS + 1) * SKETCH), 0

    def add(self, words: np.ndarray, first: np.ndarray) -> None:
        """Take in all blocks of the documents. A block adds to a cell for each two of its words: no thin matrix is read."""
        starts, ends, _ = _windows(words, first)
        features = np.append(_features(words), BUCKETS)
        for s in range(0, len(starts), _BLOCKS):
            at = starts[s : s + _BLOCKS, None] + np.arange(WINDOW // 2)
            block = features[np.where(at < ends[s : s + _BLOCKS, None], at, len(words))]
            lengths = np.maximum(self.squares[block].sum(1), 1e-9)
            for k in range(SIGNS):
                cell = (block * SKETCH)[:, :, None] + self.columns[block, k][:, None, :]
                value = np.broadcast_to((self.signed[block, k] / lengths[:, None])[:, None, :], cell.shape)
                np.add.at(self.total, cell.reshape(-1), value.reshape(-1))
        self.blocks += len(starts)

    def result(self) -> np.ndarray:
        return self.total[: BUCKETS * SKETCH].reshape(BUCKETS, SKETCH) * self.weights[:, None]


def _partial(weights: np.ndarray):
    """A task's part of the product, in blocks of rows; row -1 has the number of blocks of words, in halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product = _Product(weights)
        for batch in batches:
            for _, raw, offsets in tk.chunks(batch, "text", CHUNK_BYTES):
                product.add(*tk.word_hashes(raw, offsets))
        if not product.blocks:
            return
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([np.array([product.blocks % (1 << 16), product.blocks >> 16], np.float32).tobytes()], pa.binary())], ["block", "body"])
        for s in range(0, BUCKETS, _ROWS):
            body = product.total[s * SKETCH : (s + _ROWS) * SKETCH].reshape(-1, SKETCH) * weights[s : s + _ROWS, None]
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([body.astype(np.float32).tobytes()], pa.binary())], ["block", "body"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sum for each block of rows, taken as its parts come."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, body in zip(batch.column("block").to_pylist(), batch.column("body"), strict=True):
            part = np.frombuffer(body.as_buffer(), np.float32)
            if block in total:
                total[block] += part
            else:
                total[block] = part.astype(np.float64)
    for block, body in total.items():
        kind = np.float64 if block < 0 else np.float32
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([body.astype(kind).tobytes()], pa.binary())], ["block", "body"])


def passage_product(documents: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, int]:
    """A^T (A S) over the passages of all documents, and how many blocks of words they have."""
    shape = "block long, body binary"
    parts = documents.select("text").mapInArrow(_partial(weights), shape).repartition("block").mapInArrow(_summed, shape)
    out, blocks = np.zeros((BUCKETS, SKETCH), np.float32), 0  # as the parts come
    for r in parts.collect():
        if r["block"] < 0:
            blocks = int(np.frombuffer(r["body"], np.float64) @ [1, 1 << 16])
        else:
            out[r["block"] : r["block"] + _ROWS] = np.frombuffer(r["body"], np.float32).reshape(-1, SKETCH)
    return out, blocks


def piece_starts(n: int, window: int = WINDOW) -> list[int]:
    """Where the pieces of an item of n words start: one each half window, the last at its end."""
    return [*range(0, n - window, window // 2), n - window] if n > window else [0]


def latent_space(product: np.ndarray, rank: int = RANK, leading: int = LEADING, spent: bool = False) -> np.ndarray:
    """``rank`` eigenvectors of A^T A after the ``leading`` ones from A^T (A S), features by rank; fewer if A has fewer.

    Nystrom's approximation with a small shift: of the positive semidefinite matrices that agree with the product.
    A product that is ``spent`` (64-bit floats) is written over, so that the driver holds one large matrix less.
    """
    columns, signs = _signs()
    shift = 1e-7 * float(np.linalg.norm(product))  # about the rounding of the parts
    if not shift:
        return np.zeros((BUCKETS, 0))
    shifted, core = product if spent else product.astype(np.float64), np.zeros((SKETCH, SKETCH))
    for k in range(SIGNS):
        shifted[np.arange(BUCKETS), columns[:, k]] += shift * signs[:, k]
    for k in range(SIGNS):
        for s in range(0, BUCKETS, _BLOCKS):
            np.add.at(core, columns[s : s + _BLOCKS, k], signs[s : s + _BLOCKS, k, None] * shifted[s : s + _BLOCKS])
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    held = values > 1e-6 * values[-1]
    half = shifted @ (vectors[:, held] / np.sqrt(values[held]))
    values, vectors = np.linalg.eigh(half.T @ half)
    order = np.argsort(-values)[leading : leading + rank]
    order = order[values[order] > 1e-5 * values[-1]]
    return half @ (vectors[:, order] / np.sqrt(values[order]))


def widened(space: np.ndarray, weights: np.ndarray, pieces: list[np.ndarray], held: float = HELD, most: int = OWN) -> np.ndarray:
    """The space with orthogonal directions of the pieces of which it holds less than ``held`` of the length."""
    rest = []
    for w in pieces:
        features, n = np.unique(_features(w), return_counts=True)
        row = n * weights[features]
        row /= max(np.linalg.norm(row), 1e-9)
        inside = row @ space[features]
        if np.linalg.norm(inside) < held:
            full = -(space @ inside)
            full[features] += row
            rest.append(full.astype(np.float32))
    if not rest:
        return space
    values, vectors = np.linalg.eigh(np.array(rest) @ np.array(rest).T)
    keep = np.argsort(-values)[:most]
    keep = keep[values[keep] > 1e-3]
    return np.hstack([space, np.array(rest).T @ vectors[:, keep] / np.sqrt(values[keep])])


def common_subsequence(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, one bit for each word of the item."""
    places: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    row = full
    for w in text.tolist():
        match = places.get(w)
        if match:
            hit = row & match
            row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


class Matcher:
    """Items with their latent vectors; finds them in chunks of documents."""

    kind: pa.DataType = pa.int64()

    def __init__(self, ids: list, items: list[np.ndarray], weights: np.ndarray, space: np.ndarray, cosine: float, share: float, answer_share: float):
        self.ids, self.items = ids, items
        self.table = _padded(weights[:, None] * space)
        self.cosine, self.share, self.answer_share = cosine, share, answer_share
        self.lengths = np.array([len(w) for w in items], np.int64)
        pieces = [(i, w[s : s + WINDOW]) for i, w in enumerate(items) for s in piece_starts(len(w))]
        pieces += [(i, w) for i, w in enumerate(items) if WINDOW < len(w) <= 2 * WINDOW]
        latent = np.array([self.table[_features(w)].sum(0) for _, w in pieces], np.float32).reshape(len(pieces), -1)
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
        owner, sizes = np.array([i for i, _ in pieces], np.int64), np.array([len(w) for _, w in pieces], np.int64)
        #: Each window with the pieces compared with it: a piece meets its own scale and all larger ones.
        least = [least for _, least in SCALES[1:]] + [WINDOW + 1]
        self.scales = [(window, latent[near], owner[near]) for (window, _), most in zip(SCALES, least, strict=True) if (near := sizes < most).any()]
        self.vocabulary = np.unique(np.concatenate(items)) if items else np.zeros(0, np.uint64)
        self.counts = np.zeros((len(items), len(self.vocabulary) + 1), np.int32)
        for i, w in enumerate(items):
            np.add.at(self.counts[i], np.searchsorted(self.vocabulary, w), 1)

    def accepts(self, item: int, region: np.ndarray) -> float:
        """The share of the item's words in common order with the region; 0 if it doesn't count."""
        words = self.items[item]
        tail = max(1, -(-len(words) // 4))
        found = common_subsequence(words, region)
        if found < self.share * len(words) or common_subsequence(words[-tail:], region) < self.answer_share * tail:
            return 0.0
        return found / len(words)

    def find(self, words: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], float]:
        """(document, item) and the share for all that count."""
        found: dict[tuple[int, int], float] = {}
        if not len(words) or not self.items:
            return found
        code = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        code = np.where(self.vocabulary[code] == words, code, len(self.vocabulary))
        for doc, start, item, window in self._candidates(words, first):
            low = np.maximum(first[doc], start - self.lengths[item])
            high = np.minimum(first[doc + 1], start + window + self.lengths[item])
            possible = self._possible(code, low, high, item)
            for d, i, lo, hi in zip(doc[possible].tolist(), item[possible].tolist(), low[possible].tolist(), high[possible].tolist(), strict=True):
                if found.get((d, i), 0.0) >= 1.0:
                    continue
                value = self.accepts(i, words[lo:hi])
                if value:
                    found[d, i] = max(found.get((d, i), 0.0), value)
        return found

    def _candidates(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """Documents, starts and items of the windows that resemble a piece, in groups of one window's size."""
        size = self.scales[0][0]
        starts, ends, doc = _windows(words, first, size)
        sums = _block_sums(self.table, words, starts, ends)
        for window, latent, owner in self.scales:
            while size < window:  # blocks of twice the words: each even one of a document and the next
                place = np.arange(len(doc)) - np.searchsorted(doc, doc)
                even = place % 2 == 0
                sums, starts, doc, size = _pairs(sums, doc)[even], starts[even], doc[even], size * 2
            whole = _pairs(sums, doc)
            whole /= np.maximum(np.linalg.norm(whole, axis=1, keepdims=True), 1e-9)
            rows = max(1, min(4096, (1 << 22) // len(latent)))
            for s in range(0, len(whole), rows):
                at, piece = np.nonzero(whole[s : s + rows] @ latent.T >= self.cosine)
                pair = np.unique((at + s) * len(self.items) + owner[piece])
                at, item = pair // len(self.items), pair % len(self.items)
                yield doc[at], starts[at], item, window

    def _possible(self, code: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray, most: int = 1 << 21) -> np.ndarray:
        """Which regions hold enough of the item's words, each as often as the item at most: a bound on the subsequence."""
        out = np.zeros(len(item), bool)
        by = np.argsort(high - low, kind="stable")
        s = 0
        while s < len(by):
            # regions come by width, so twice the first one's is filled by half at least
            width = max(1, int(high[by[s]] - low[by[s]]))
            e = min(s + max(1, most // (2 * width)), int(np.searchsorted((high - low)[by], 2 * width, "right")))
            pick = by[s:e]
            at = low[pick, None] + np.arange(int((high - low)[pick].max()))
            inside = at < high[pick, None]
            seen = np.sort(np.where(inside, code[np.where(inside, at, 0)], len(self.vocabulary)), axis=1)
            once = np.ones(seen.shape, bool)
            once[:, 1:] = seen[:, 1:] != seen[:, :-1]
            held = np.where(once, self.counts[item[pick, None], seen], 0).sum(1, dtype=np.int64)
            out[pick] = held >= self.share * self.lengths[item[pick]] - 1e-9
            s = e
        return out


def matchers(
    documents: DataFrame, benchmark: DataFrame, item_block: int = ITEM_BLOCK, cosine: float = COSINE, share: float = SHARE,
    answer_share: float = ANSWER_SHARE,
) -> Iterator[Matcher]:
    """One matcher for each block of items. Items of fewer than ``LEAST_WORDS`` words (null, empty) never match."""
    spark = documents.sparkSession
    long_texts(spark)
    seen, n = document_frequencies(documents)
    weights = np.log((n + 1) / (seen + 1)) + 0.05
    product = None
    items = benchmark.filter("text is not null").select("item_id", "text").distinct()
    n_words = F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"))
    pieces = items.agg(F.sum(F.greatest(F.lit(1), F.ceil(n_words * 2 / WINDOW)))).first()[0] or 0
    blocks = max(1, -(-int(pieces) // item_block))
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        texts = rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string())
        words, first = tk.word_hashes(*tk.texts_of(texts))
        kept = [i for i in range(rows.num_rows) if first[i + 1] - first[i] >= LEAST_WORDS]
        if not kept:
            continue
        ids = rows.column("item_id").to_pylist()
        pieces = [words[first[i] + s : min(first[i] + s + WINDOW, first[i + 1])] for i in kept for s in piece_starts(int(first[i + 1] - first[i]))]
        if product is None:
            product, passages = passage_product(documents, weights)
        found = [words[first[i] : first[i + 1]] for i in kept]
        own = _Product(weights)
        own.add(np.concatenate(found), np.cumsum([0, *map(len, found)]))
        both = own.result()
        del own
        both *= max(1.0, passages / len(pieces))
        both += product
        space = latent_space(both, spent=True)
        del both
        release()
        matcher = Matcher([ids[i] for i in kept], found, weights, widened(space, weights, pieces), cosine, share, answer_share)
        del space
        release()
        matcher.kind = rows.schema.field("item_id").type
        yield matcher


def _scans(documents: DataFrame, benchmark: DataFrame, **options) -> Iterator[list]:
    """Broadcast matchers, in groups that one scan of the documents compares."""
    every = matchers(documents, benchmark, **options)
    while group := list(itertools.islice(every, SCAN_BLOCKS)):
        yield [documents.sparkSession.sparkContext.broadcast(m) for m in group]


def leaks(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, item_id, share``: every document that holds an item, with the share of the item found.

    A document that holds several items has a row for each, and rows that repeat an id each have their own; an item
    that the benchmark repeats counts once. Null and empty texts hold none. An empty table on either side gives none.
    """
    source = documents.select("doc_id", "text")
    spark = documents.sparkSession
    kinds = source.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    shape = f"doc_id {kinds[0]}, item_id {kinds[1]}, share double"
    out = spark.createDataFrame([], shape)
    for group in _scans(source, benchmark, **options):

        def run(batches: Iterator[pa.RecordBatch], group=group) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, raw, offsets in tk.chunks(batch, "text", CHUNK_BYTES):
                    words = tk.word_hashes(raw, offsets)
                    for held in group:
                        found = held.value.find(*words)
                        at = pa.array([d for d, _ in found], pa.int64())
                        ids = [held.value.ids[i] for _, i in found]
                        yield pa.RecordBatch.from_arrays(
                            [part.column("doc_id").take(at), pa.array(ids, held.value.kind), pa.array(list(found.values()), pa.float64())],
                            ["doc_id", "item_id", "share"],
                        )

        out = out.unionByName(source.mapInArrow(run, shape))
    return out


def without_leaks(documents: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows that hold no item, with all their columns, whatever these are called; nothing is shuffled.

    Null and empty texts stay; rows that repeat a text go or stay together. Without items every row stays.
    """
    out = documents
    for group in _scans(documents.select("doc_id", F.col(text).alias("text")), benchmark, **options):

        def run(batches: Iterator[pa.RecordBatch], group=group) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, raw, offsets in tk.chunks(batch, text, CHUNK_BYTES):
                    keep, words = np.ones(part.num_rows, bool), tk.word_hashes(raw, offsets)
                    for held in group:
                        keep[[d for d, _ in held.value.find(*words)]] = False
                    yield part.filter(pa.array(keep))

        out = out.mapInArrow(run, documents.schema)
    return out
