"""Exact top-k by integer inner product with M-trees.

Vectors become integers, component by component. One extra component, sqrt(M^2 - |v|^2) with M the
largest norm of all, turns the largest inner product into the smallest Euclidean distance:
|q - v|^2 = |q|^2 + M^2 - 2 q.v for queries with a 0 there. An M-tree holds pages of entries; a
routing entry has a pivot, a covering radius and the distance to its parent's pivot. A block of
queries takes pages best first by the least distance that they can hold for any of its queries, and each
query leaves a page whose covering radius keeps it beyond the query's k-th best score so far. From the
stored distance to the parent's pivot the triangle inequality tells most entries that cannot reach that
score, and their distance is never computed. Scores are exact integers; a bound only drops what
lies strictly below the k-th score, so ties are all seen and go to the smaller id.

Rows go to the nearest of at most ``CELLS`` centres (rows chosen by a hash; a documented bound), and each
cell is cut into shards of about ``shard_rows``; a shard is one tree, built in one task and stored with its
centre and radius. Query blocks first visit one shard of their own cell. With the k-th scores from there
they visit those shards that can hold better ones; where centres and radii of all shards take more than
``ROUTE_BYTES`` the shards tell so themselves. Trees and blocks meet by an equality exchange, a task holds
one tree and streams blocks by it, at most ``GROUP`` of them. Per query and shard at most k rows come back
and are reduced by a window over the query.
"""

from __future__ import annotations

import heapq
import io
import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import free, save

PAGE = 256
FAN = 16
SHARD_ROWS = 8192
BLOCK_ROWS = 512
CELLS = 1024
GROUP = 32
ROUTE_BYTES = 32 << 20
#: Below every score: all inner products are smaller in size.
_NONE = -(1 << 62)
_NO_ID = (1 << 63) - 1


def lifted(vectors: np.ndarray, top: float) -> np.ndarray:
    """Points whose distance to a query falls with the inner product."""
    wide = vectors.astype(np.float64)
    return np.hstack([wide, np.sqrt(np.maximum(top - (wide**2).sum(1), 0.0))[:, None]])


def flat(queries: np.ndarray) -> np.ndarray:
    return np.hstack([queries.astype(np.float64), np.zeros((len(queries), 1))])


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all x to all y, by one matrix product."""
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * (x @ y.T), 0.0))


class MTree:
    """Pages of an M-tree, bulk loaded. ``children`` are page numbers of routing pages."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float | None = None, page: int = PAGE, fan: int = FAN):
        self.ids, self.vectors = ids, vectors.astype(np.int64)
        own = (self.vectors.astype(np.float64) ** 2).sum(1).max(initial=0.0)
        self.top = max(own, top or 0.0)
        self.largest = float(np.sqrt(own))
        self.pages: list[dict] = []
        self.page, self.fan = page, fan
        #: Distances that searches have computed, of entries and of pivots.
        self.computed = 0
        points = lifted(self.vectors, self.top)
        self.centre, self.radius = np.zeros(points.shape[1]), 0.0
        if len(ids):
            self.centre = points.mean(0)
            self.radius = float(apart(self.centre[None, :], points).max())
            self._build(points, np.arange(len(ids)), self.centre)

    def _build(self, points: np.ndarray, rows: np.ndarray, pivot: np.ndarray) -> int:
        """A page over these rows; entries know their distance to the page's pivot."""
        me = len(self.pages)
        self.pages.append({})
        if len(rows) <= self.page:
            far = apart(pivot[None, :], points[rows])[0]
            order = np.argsort(far, kind="stable")
            self.pages[me] = {"rows": rows[order], "far": far[order]}
            return me
        near = apart(points[rows], self._spread(points, rows)).argmin(1)
        pivots, radii, parents, children = [], [], [], []
        for part in self._even(rows, near):
            center = points[part].mean(0)
            pivots.append(center)
            radii.append(float(apart(center[None, :], points[part]).max()))
            parents.append(float(apart(center[None, :], pivot[None, :])[0, 0]))
            children.append(self._build(points, part, center))
        self.pages[me] = {"pivots": np.array(pivots), "radii": np.array(radii), "far": np.array(parents), "children": np.array(children)}
        return me

    def _spread(self, points: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Seeds far from each other, among an even choice of the rows."""
        some = points[rows[np.linspace(0, len(rows) - 1, min(len(rows), 40 * self.fan)).astype(int)]]
        seeds, far = [some[0]], ((some - some[0]) ** 2).sum(1)
        while len(seeds) < self.fan and far.max() > 0:
            seeds.append(some[int(far.argmax())])
            far = np.minimum(far, ((some - seeds[-1]) ** 2).sum(1))
        return np.array(seeds)

    def _even(self, rows: np.ndarray, near: np.ndarray) -> Iterator[np.ndarray]:
        """The groups of the seeds; a group that is almost everything is cut evenly, so pages always shrink."""
        for g in np.unique(near):
            part = rows[near == g]
            if len(part) > 0.9 * len(rows):
                yield from np.array_split(part, self.fan)
            else:
                yield part

    def search(self, queries: np.ndarray, skip: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best of each query, highest first, ties to the smaller id, without the id ``skip``.

        What lies below a query's ``floor`` may be left out. Places without an entry have the score ``_NONE``.
        """
        n = len(queries)
        best, ids = np.full((n, k), _NONE, np.int64), np.full((n, k), _NO_ID, np.int64)
        if not self.pages or not n:
            return best, ids
        points = flat(queries)
        norms = (points**2).sum(1)
        exact = float(np.sqrt(norms.max())) * self.largest < 2.0**53
        slack = 1e-11 * (norms + self.top) + 1e-9  # beyond what rounding does to squares of distances
        least = np.full(n, _NONE, np.int64) if floor is None else floor.astype(np.int64)

        def reach_of(rows: np.ndarray) -> np.ndarray:
            known = least[rows] > _NONE
            inside = norms[rows] + self.top - 2.0 * np.where(known, least[rows], 0)
            return np.where(known, np.sqrt(np.maximum(inside, 0.0) + slack[rows]), np.inf) + np.sqrt(slack[rows])

        reach, turn = reach_of(np.arange(n)), itertools.count()
        to_root = apart(points, self.centre[None, :])[:, 0]
        self.computed += n
        heap = [(0.0, next(turn), 0, np.arange(n), to_root, np.maximum(0.0, to_root - self.radius))]
        while heap:
            _, _, number, active, to_pivot, bound = heapq.heappop(heap)
            near = bound <= reach[active]
            active, to_pivot = active[near], to_pivot[near]
            if not len(active):
                continue
            page = self.pages[number]
            beside = np.abs(page["far"][None, :] - to_pivot[:, None])
            if "rows" in page:
                need = beside <= reach[active][:, None]
                some = np.flatnonzero(need.any(0))
                if not len(some):
                    continue
                rows = page["rows"][some]
                self.computed += len(active) * len(some)
                if exact:
                    scores = np.rint(queries[active].astype(np.float64) @ self.vectors[rows].T.astype(np.float64)).astype(np.int64)
                else:
                    scores = queries[active] @ self.vectors[rows].T
                found = self.ids[rows]
                hit = need[:, some] & (scores >= least[active][:, None]) & (found[None, :] != skip[active][:, None])
                if len(some) > k:
                    masked = np.where(hit, scores, _NONE)
                    hit &= scores >= np.partition(masked, -k, axis=1)[:, [-k]]
                q, e = np.nonzero(hit)
                if not len(q):
                    continue
                of = np.concatenate([np.repeat(np.arange(len(active)), k), q])
                score = np.concatenate([best[active].ravel(), scores[q, e]])
                name = np.concatenate([ids[active].ravel(), found[e]])
                order = np.lexsort((name, -score, of))
                place = np.arange(len(of)) - np.searchsorted(of[order], np.arange(len(active)))[of[order]]
                keep = order[place < k]
                best[active], ids[active] = score[keep].reshape(-1, k), name[keep].reshape(-1, k)
                least[active] = np.maximum(least[active], best[active, k - 1])
                reach[active] = reach_of(active)
                continue
            may = beside - page["radii"][None, :] <= reach[active][:, None]
            some = np.flatnonzero(may.any(0))
            if not len(some):
                continue
            away = apart(points[active], page["pivots"][some])
            self.computed += away.size
            bounds = np.maximum(0.0, away - page["radii"][some][None, :])
            open_ = may[:, some] & (bounds <= reach[active][:, None])
            for c in np.flatnonzero(open_.any(0)).tolist():
                pick = open_[:, c]
                inner = bounds[pick, c]
                heapq.heappush(heap, (float(inner.min()), next(turn), int(page["children"][some[c]]), active[pick], away[pick, c], inner))
        return best, ids


def integer_vector(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null where the vector or a component is null or not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(wide, lambda x: F.floor(x * scale)))


def _packed(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def _unpacked(body: bytes) -> np.ndarray:
    return np.load(io.BytesIO(body), allow_pickle=False)


def _matrix(lists, width: int) -> np.ndarray:
    """Rows of integers, filled with zeros up to the width."""
    out = np.zeros((len(lists), width), np.int64)
    for row, v in zip(out, lists, strict=True):
        row[: len(v)] = v
    return out


def _assign(centres: np.ndarray, lift):
    """The nearest centre of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                part = batch.slice(s, 2048)
                vectors = _matrix(part.column("v").to_pylist(), centres.shape[1] - 1)
                cell = apart(lift(vectors), centres).argmin(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), pa.array(cell)], ["vec_id", "v", "cell"])

    return run


def _grown(top: float, width: int):
    """One shard's rows to its tree."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        tree = MTree(pdf["vec_id"].to_numpy(np.int64), _matrix(pdf["v"], width), top)
        return pd.DataFrame({"part": pdf["part"].iloc[:1].to_numpy(), "centre": [_packed(tree.centre)], "radius": [tree.radius], "body": [pickle.dumps(tree)]})

    return run


def _boxed(width: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        return pd.DataFrame({
            "block": pdf["block"].iloc[:1].to_numpy(), "home": pdf["home"].iloc[:1].to_numpy(),
            "q_ids": [_packed(pdf["vec_id"].to_numpy(np.int64))], "body": [_packed(_matrix(pdf["v"], width))],
        })

    return run


def _floors(held, n: int) -> np.ndarray:
    out = np.full(n, _NONE, np.int64)
    for x in held or ():
        out[x["q"]] = x["floor"]
    return out


def _visits(k: int):
    """Rows sorted by part and kind: a tree (kind 0), then the blocks that visit it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tree = None, None
        for batch in batches:
            out: list[tuple] = []
            kinds, parts, blocks = (batch.column(c).to_pylist() for c in ("kind", "part", "block"))
            for i, (kind, part) in enumerate(zip(kinds, parts, strict=True)):
                body = batch.column("body")[i].as_py()
                if not kind:
                    held, tree = part, pickle.loads(body)
                elif held == part:
                    queries, names = _unpacked(body), _unpacked(batch.column("q_ids")[i].as_py())
                    scores, ids = tree.search(queries, names, k, _floors(batch.column("floors")[i].as_py(), len(names)))
                    q, place = np.nonzero(scores > _NONE)
                    out.append((np.full(len(q), blocks[i]), q, names[q], ids[q, place], scores[q, place]))
            columns = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "q", "query_id", "vec_id", "score"])

    return run


def _routes(centres: np.ndarray, radii: np.ndarray, parts: np.ndarray, top: float):
    """For each block the shards that can hold one of the k best of one of its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            routes = []
            for i in range(batch.num_rows):
                points = flat(_unpacked(batch.column("body")[i].as_py()))
                least = _floors(batch.column("floors")[i].as_py(), len(points))
                slack = 1e-11 * ((points**2).sum(1) + top) + 1e-9
                inside = (points**2).sum(1) + top - 2.0 * np.where(least > _NONE, least, 0)
                reach = np.where(least > _NONE, np.sqrt(np.maximum(inside, 0) + slack), np.inf) + np.sqrt(slack)
                open_ = np.zeros(len(parts), bool)
                for s in range(0, len(parts), 4096):
                    open_[s : s + 4096] = (apart(points, centres[s : s + 4096]) - radii[None, s : s + 4096] <= reach[:, None]).any(0)
                routes.append(parts[open_])
            first = np.concatenate([[0], np.cumsum([len(r) for r in routes])]).astype(np.int32)
            flat_parts = np.concatenate(routes) if routes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), pa.ListArray.from_arrays(pa.array(first), pa.array(flat_parts.astype(np.int64)))], ["block", "parts"]
            )

    return run


def _stats(rows: DataFrame) -> tuple[int, int, float]:
    """How many rows, the longest vector and the largest square of a norm."""
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, width, top = rows.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    return n, width or 0, top or 0.0


def _dealt(assigned: DataFrame, each: int, cells: int) -> tuple[list[int], list[int]]:
    """The first part of each cell and how many parts it has; at most ``CELLS`` numbers come to the driver."""
    counts = {r["cell"]: r["n"] for r in assigned.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    many = [-(-counts.get(c, 0) // each) for c in range(cells)]
    return [sum(many[:c]) for c in range(cells)], many


def _part_of(first: list[int], many: list[int]) -> Column:
    """A part of the row's cell; rows that agree in all columns go apart, too."""
    at = F.col("cell") + 1
    number = F.xxhash64("vec_id", "v", F.monotonically_increasing_id())
    return F.element_at(F.lit(first).cast("array<long>"), at) + F.pmod(number, F.element_at(F.lit(many).cast("array<long>"), at))


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, route_bytes: int = ROUTE_BYTES
) -> DataFrame:
    """``query_id, rank, vec_id, score``. Both inputs have ``vec_id`` and an integer array ``v``.

    Components that the shorter of two vectors lacks count as 0. Rows whose id or vector is null take no
    part. A query's own id is no candidate for it. Fewer than k candidates give fewer rows; an empty
    table gives none. Rows that repeat an id each count as candidates; queries that repeat an id and a vector
    are asked once, those with one id and other vectors each for itself. Vectors whose scores may not fit 64
    bits (the product of the largest norms is 2**62 or more) are a ValueError.
    """
    spark = vectors.sparkSession
    rows = vectors.filter("vec_id is not null and v is not null").select("vec_id", "v")
    asked = queries.filter("vec_id is not null and v is not null").select("vec_id", "v").distinct()
    (n, wide, top), (n_asked, wide_asked, top_asked) = _stats(rows), _stats(asked)
    shape = "query_id long, rank int, vec_id long, score long"
    if not n or not n_asked:
        return spark.createDataFrame([], shape)
    if max(top, top_asked) >= 2.0**62:
        raise ValueError("scores may not fit 64 bits")
    width = max(wide, wide_asked)
    cells = max(1, min(CELLS, -(-n // shard_rows)))
    seeds = rows.orderBy(F.xxhash64("v", "vec_id"), "vec_id").limit(cells).select("v").collect() if cells > 1 else []
    centres = lifted(_matrix([r["v"] for r in seeds], width), top) if cells > 1 else np.zeros((1, width + 1))
    celled = "vec_id long, v array<long>, cell int"
    placed = save(rows.mapInArrow(_assign(centres, lambda v: lifted(v, top)), celled), "mtree-rows")
    posed = save(asked.mapInArrow(_assign(centres, flat), celled), "mtree-asked")
    first, many = _dealt(placed, shard_rows, cells)
    shards = sum(many)
    index = save(
        placed.select("vec_id", "v", _part_of(first, many).alias("part")).groupBy("part")
        .applyInPandas(_grown(top, width), "part long, centre binary, radius double, body binary"),
        "mtree-index",
    )
    free(placed)
    home = F.when(F.element_at(F.lit(many).cast("array<long>"), F.col("cell") + 1) > 0, F.element_at(F.lit(first).cast("array<long>"), F.col("cell") + 1)).otherwise(-1)
    q_first, q_many = _dealt(posed, block_rows, cells)
    boxes = save(
        posed.select("vec_id", "v", home.cast("long").alias("home"), _part_of(q_first, q_many).alias("block")).groupBy("block")
        .applyInPandas(_boxed(width), "block long, home long, q_ids binary, body binary"),
        "mtree-boxes",
    )
    free(posed)
    groups = F.lit(max(1, -(-sum(q_many) // GROUP)))
    hits = "block long, q long, query_id long, vec_id long, score long"
    floors = "array<struct<q:bigint,floor:bigint>>"

    def visit(sent: DataFrame) -> DataFrame:
        """Blocks at the part they are sent to, beside its tree."""
        trees = index.join(sent.select("part").distinct(), "part", "left_semi").select(
            "part", F.explode(F.sequence(F.lit(0).cast("long"), groups.cast("long") - 1)).alias("grp"), F.lit(0).alias("kind"),
            F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("q_ids"), F.lit(None).cast(floors).alias("floors"), "body",
        )
        going = sent.select("part", F.pmod("block", groups).cast("long").alias("grp"), F.lit(1).alias("kind"), "block", "q_ids", "floors", "body")
        met = trees.unionByName(going).repartition("part", "grp").sortWithinPartitions("part", "grp", "kind")
        return met.mapInArrow(_visits(k), hits)

    near = save(visit(boxes.filter("home >= 0").withColumns({"part": F.col("home"), "floors": F.lit(None).cast(floors)})), "mtree-near")
    known = near.groupBy("block", "q").agg(F.min("score").alias("floor"), F.count("*").alias("n")).filter(F.col("n") == k)
    held = known.groupBy("block").agg(F.collect_list(F.struct("q", "floor")).alias("floors"))  # at most block_rows each
    armed = save(boxes.join(held, "block", "left"), "mtree-armed")
    free(boxes)
    if shards * (width + 3) * 8 <= route_bytes:
        table = index.select("part", "centre", "radius").collect()
        route = _routes(np.array([_unpacked(r["centre"]) for r in table]), np.array([r["radius"] for r in table]), np.array([r["part"] for r in table]), top)
        sent = armed.join(armed.mapInArrow(route, "block long, parts array<long>"), "block").withColumn("part", F.explode("parts")).drop("parts")
    else:
        sent = armed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    far = visit(sent.filter(F.col("part") != F.col("home")))
    order = Window.partitionBy("block", "q").orderBy(F.desc("score"), "vec_id")
    ranked = near.unionByName(far).withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def top_k_digest(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The k best for each row whose id is divisible by ``every``, against all rows."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), integer_vector(F.col("embedding")).alias("v"))
    return top_k(rows, rows.filter(F.col("vec_id") % every == 0), k)
