"""Similarity self-join of texts on word shingles by chosen paths.

A text is its set of five-word shingles (fewer words: one shingle of all words; none: no set). Texts
of one set are one node with a number of copies. In every run a set goes down a tree: at each level
it chooses those of its shingles whose seeded hash with the path so far is below ``choices / size``,
so sets that share most of their shingles keep meeting and others part. Sets that meet at the last
level form a bucket, which is compared by brute force with the whole sets. One run finds a pair at
the threshold with a probability that follows from the branching process; runs repeat until the
target recall.

A pair is compared in one place only, the bucket of its least common path, so that links are counted
once although no row is made for each pair: a bucket gives one row for each set, with its links and
the root of its part of the similarity graph. Buckets above ``tile`` sets are cut into tiles of chunk
against chunk, so that every pair is still compared. Classes are the connected components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .scratch import free, long_texts, save

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
LEVELS = 2
CHOICES = 2.0
TILE = 512


def runs_for(recall: float = RECALL, threshold: float = THRESHOLD, choices: float = CHOICES, levels: int = LEVELS) -> int:
    """Runs until a pair at the threshold is missed with a probability of at most ``1 - recall``."""
    lost = 0.0
    for _ in range(levels):
        lost = math.exp(-choices * threshold * (1 - lost))
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


def chosen_paths(sets: np.ndarray, first: np.ndarray, runs: int, levels: int, choices: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of all paths of each set through all runs, and the places of the first ones."""
    size = np.diff(first)
    bound = np.where(size > choices, choices / np.maximum(size, 1) * 2.0**64, 2.0**64)
    below = np.minimum(bound, 2.0**64 - 2048).astype(np.uint64)
    found, owners = [], []
    for run in range(runs):
        path = tk.mix64(np.full(len(size), seed * 1009 + run + 1, np.uint64))
        doc = np.flatnonzero(size)
        path = path[doc]
        for _ in range(levels):
            width = size[doc]
            at = np.repeat(first[doc] - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
            value = tk.mix64(np.repeat(path, width) ^ sets[at])
            doc = np.repeat(doc, width)
            chosen = value <= below[doc]
            doc, path = doc[chosen], tk.mix64(value[chosen] + np.uint64(1))
        found.append(path)
        owners.append(doc)
    return tk.distinct(np.concatenate(found), np.concatenate(owners), len(size))


def set_ids(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    mixed = tk.mix64(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    return tk.mix64((total[first[1:]] - total[first[:-1]]) ^ np.diff(first).astype(np.uint64))


def _describe(words: int, runs: int, levels: int, choices: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in tk.chunks(batch, "text"):
                sets, first = tk.shingle_sets(*tk.word_hashes(raw, offsets), words)
                ids = pa.array(set_ids(sets, first).view(np.int64), mask=np.diff(first) == 0)
                paths, at = chosen_paths(sets, first, runs, levels, choices, seed)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("body"), ids, tk.lists(paths.view(np.int64), at)], ["id", "body", "set", "paths"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in tk.chunks(batch, "text"):
                sets, first = tk.shingle_sets(*tk.word_hashes(raw, offsets), words)
                asked = part.column("set")
                right = asked.to_numpy() == set_ids(sets, first).view(np.int64)  # another text may have the same hash
                yield pa.RecordBatch.from_arrays([asked, part.column("copies"), tk.lists(sets.view(np.int64), first)], ["set", "copies", "shingles"]).filter(pa.array(right))

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of whole groups, from rows sorted by the keys; each with the places where groups start."""
    left: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0] if left is not None else batch
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        last = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if last:
            yield batch.slice(0, last), np.concatenate([[0], np.flatnonzero(new[:last]), [last]])
            tk.give_back()
        left = batch.slice(last)
    if left is not None:
        columns = [left.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(left.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        yield left, np.concatenate([[0], np.flatnonzero(new), [left.num_rows]])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.asarray(column.offsets)
    return np.asarray(column.values)[offsets[0] : offsets[-1]].view(np.uint64), offsets - offsets[0]


def _own_pairs(path: int, chunk: np.ndarray, paths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which pairs of the group's rows have no common path below this one; across the chunks where there are two."""
    m = len(chunk)
    own = ~np.eye(m, dtype=bool)
    if chunk[0] != chunk[-1] or (chunk != chunk[0]).any():
        own &= chunk[:, None] != chunk[None, :]
    lower = paths < np.uint64(path & tk._MASK)
    value, owner = paths[lower], np.repeat(np.arange(m), np.diff(at))[lower]
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    edges = np.concatenate([[0], np.flatnonzero(value[1:] != value[:-1]) + 1, [len(value)]]) if len(value) else np.zeros(1, int)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a > 1:
            own[np.ix_(owner[a:b], owner[a:b])] = False
    return own


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that have a pair of their own in their bucket."""
    for batch, edges in _groups(batches, ["path", "a", "b"]):
        path, chunk = batch.column("path").to_numpy(), batch.column("chunk").to_numpy()
        values, at = _flat(batch.column("paths"))
        keep = np.zeros(batch.num_rows, bool)
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            if e - s > 1:
                keep[s:e] = _own_pairs(int(path[s]), chunk[s:e], values[at[s] : at[e]], at[s : e + 1] - at[s]).any(axis=1)
        yield batch.filter(pa.array(keep))


def overlaps(values: np.ndarray, at: np.ndarray, wide: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of a few sets."""
    m = len(at) - 1
    owner = np.repeat(np.arange(m), np.diff(at))
    found, place, seen = np.unique(values, return_inverse=True, return_counts=True)
    shared = seen > 1
    rank = np.cumsum(shared) - 1
    inside = shared[place]
    owner, place = owner[inside], rank[place[inside]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    total = np.zeros((m, m), np.float32)
    for start in range(0, int(shared.sum()), wide):
        a, b = np.searchsorted(place, [start, start + wide])
        block = np.zeros((m, min(wide, int(shared.sum()) - start)), np.float32)
        block[owner[a:b], place[a:b] - start] = 1
        total += block @ block.T
    return total.astype(np.int64)


def roots(linked: np.ndarray) -> np.ndarray:
    """The least member of each row's component in a small symmetric adjacency matrix."""
    m = len(linked)
    label = np.arange(m)
    reach = linked | np.eye(m, dtype=bool)
    while True:
        new = np.where(reach, label[None, :], m).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in _groups(batches, ["path", "a", "b"]):
            path, chunk = batch.column("path").to_numpy(), batch.column("chunk").to_numpy()
            ids, copies = batch.column("set").to_numpy(), batch.column("copies").to_numpy()
            paths, pat = _flat(batch.column("paths"))
            sets, sat = _flat(batch.column("shingles"))
            out: tuple[list, list, list] = ([], [], [])
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if e - s < 2:
                    continue
                own = _own_pairs(int(path[s]), chunk[s:e], paths[pat[s] : pat[e]], pat[s : e + 1] - pat[s])
                common = overlaps(sets[sat[s] : sat[e]], sat[s : e + 1] - sat[s])
                size = np.diff(sat[s : e + 1])
                linked = own & (common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9)
                some = np.flatnonzero(linked.any(axis=1))
                out[0].append(ids[s:e][some])
                out[1].append(ids[s:e][roots(linked)[some]])
                out[2].append((linked @ copies[s:e])[some])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], ["set", "root", "links"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for the nodes of ``node, root`` edges; equal labels in a component only.

    Each round takes the least label over every root and node, then jumps to the label's own label,
    until nothing changes, which labels that only fall make sure of. Labels stay in tables; one number a round
    comes to the driver.
    """
    edges = save(edges.select("node", "root").union(edges.select(F.col("root").alias("node"), "root")).distinct(), "edges")
    labels = save(edges.groupBy("node").agg(F.min("root").alias("label")), "labels")
    while True:
        by_root = edges.join(labels, "node").groupBy("root").agg(F.min("label").alias("least"))
        near = edges.join(by_root, "root").groupBy("node").agg(F.min("least").alias("least"))
        jump = labels.select(F.col("node").alias("least"), F.col("label").alias("far"))
        new = near.join(jump, "least", "left").select("node", F.least("least", F.coalesce("far", "least")).alias("label"))
        new = save(new, "labels")
        moved = new.join(labels.select("node", F.col("label").alias("was")), "node").filter("label <> was").limit(1)
        done = moved.isEmpty()
        free(labels)
        labels = new
        if done:
            return labels


def near_duplicates(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    levels: int = LEVELS,
    choices: float = CHOICES,
    tile: int = TILE,
    seed: int = 11,
) -> DataFrame:
    """``key, class_id, n_links`` for every row.

    ``class_id`` is the least key of the row's class and ``n_links`` the number of other rows at or
    above the threshold with it. Rows without words (null, empty, punctuation) are alone: class of
    their own key and no links. Rows that repeat a key each count; rows with a null key have links like
    others. A null key is never a class id unless all keys of the class are null. An empty table gives an empty result.
    """
    long_texts(documents.sparkSession)
    source = documents.select(F.col(key).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("body"), F.col(text).cast("string").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    runs = runs_for(recall, threshold, choices, levels)
    described = save(source.mapInArrow(_describe(words, runs, levels, choices, seed), f"id {id_type}, body long, set long, paths array<long>"), "near-rows")
    nodes = save(
        described.filter("set is not null").groupBy("set").agg(F.count("*").alias("copies"), F.min("id").alias("rep"), F.min(F.struct("id", "body")).alias("row"), F.min("paths").alias("paths")),
        "near-nodes",
    )
    met = nodes.select(F.explode("paths").alias("path")).groupBy("path").agg(F.count("*").alias("met")).filter("met > 1")
    cut = F.ceil(F.col("met") / tile).cast("int")
    live = (
        nodes.select("set", F.explode("paths").alias("path"))
        .join(met, "path")
        .withColumn("chunk", F.pmod(F.hash("set"), cut))
        .withColumn("other", F.explode(F.sequence(F.lit(0), cut - 1)))
        .select("set", "path", "chunk", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"))
    )
    place = ["path", "a", "b"]
    dealt = live.join(nodes.select("set", "paths"), "set").repartition(*place).sortWithinPartitions(*place)
    shape = "set long, path long, chunk int, a int, b int, paths array<long>"
    needed = save(dealt.select("set", "path", "chunk", "a", "b", "paths").mapInArrow(_needed, shape), "near-needed")
    wanted = nodes.join(needed.select("set").distinct(), "set", "left_semi").select("set", "copies", F.col("row.id").alias("of"), F.col("row.body").alias("body"))
    texts = source.join(wanted, source["id"].eqNullSafe(wanted["of"]) & (source["body"] == wanted["body"])).select("set", "copies", "text")
    # rows may repeat an id and its text
    sets = texts.dropDuplicates(["set"]).mapInArrow(_sets(words), "set long, copies long, shingles array<long>")
    full = needed.join(sets, "set").repartition(*place).sortWithinPartitions(*place)
    links = save(
        full.select("set", "path", "chunk", "a", "b", "paths", "shingles", "copies").mapInArrow(_links(threshold), "set long, root long, links long"),
        "near-links",
    )
    free(needed)
    label = components(links.select(F.col("set").alias("node"), "root"))
    counts = links.groupBy("set").agg(F.sum("links").alias("links"))
    grouped = (
        nodes.select("set", "copies", "rep")
        .join(counts, "set", "left")
        .join(label.select(F.col("node").alias("set"), "label"), "set", "left")
        .withColumn("label", F.coalesce("label", "set"))
    )
    least = grouped.groupBy("label").agg(F.min("rep").alias("class_id"))
    named = grouped.join(least, "label").select(
        "set", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")
    )
    return described.select("id", "set").join(named, "set", "left").select(
        F.col("id").alias(key), F.when(F.col("set").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )
