"""Exact removal of repeated 50-byte strings with suffix arrays.

A byte goes if a ``length``-byte string that covers it also starts in a document with a smaller id.
Steps, each linear in the text:

1. Anchors. In every window of ``length`` bytes the least of the hashed ``gram``-byte strings is its
   anchor, so equal windows have equal anchors wherever they stand. The windows of one anchor make a
   segment; anchors (one in about 16 bytes) meet by hash, each with a hash of its whole segment.
   Equal segments are one string with a least id: the others lose it whole. Of equal segments in one
   batch only that of the least id travels, so no segment is one task's load.
2. Segments. Of two segments with one anchor and a window in common, either the anchor with the bytes to its left or
   that with the bytes to its right, up to half of what a window has beside it, is common, too. Halves of segments
   for which another, different segment has that go to shards, with their bytes. A half that meets more than ``TILE``
   others is dealt into tiles, each a shard of its own.
3. Suffix arrays. Every shard is sorted by induced sorting in parts of about ``part_bytes``; permuted
   common prefixes of ``length`` or more join equal windows, and those whose least id is smaller
   than their own give the spans to remove. Windows of the least id in a tile are compared with those of the other tiles.

Equal texts count once: all but the least id lose every byte (if they have ``length`` bytes). Equal texts and equal
segments are told by 128 bits of hashes. Null texts are empty. A null id counts as larger than all others. Rows that
repeat one id are not repeats of each other. Texts may be of any length that a row can have. An empty table gives an
empty result. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .scratch import free, long_texts, save
from .suffix_array import common_prefixes, suffix_array

LENGTH = 50
GRAM = 18
PART_BYTES = 1 << 20
BUCKET_BYTES = 24 << 20
TILE = 2048
#: Texts above this size are searched in overlapping pieces.
PIECE_BYTES = 1 << 20
_CHUNK_BYTES = 256 << 10
#: Anchors of so much text go out together.
_SENT_BYTES = 2 << 20
_LAST = (1 << 63) - 1
_HIGH = np.uint64(40)


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, spans: tk.Spans | None = None) -> tuple[np.ndarray, ...]:
    """For each run of windows with one anchor: the anchor's hash, the first and last start, the document, the anchor's place."""
    if len(offsets) == 2 and len(raw) > PIECE_BYTES + length:
        pieces = []
        for s in range(0, len(raw) - length + 1, PIECE_BYTES):
            piece = raw[s : s + PIECE_BYTES + length - 1]
            hashes, a, b, owner, at = _anchors(piece, np.array([0, len(piece)]), length, gram, tk.Spans(piece))
            pieces.append((hashes, a + s, b + s, owner, at + s))
        return tuple(np.concatenate(x) for x in zip(*pieces, strict=True))
    return _anchors(raw, offsets, length, gram, spans or tk.Spans(raw))


def _anchors(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int, spans: tk.Spans) -> tuple[np.ndarray, ...]:
    none = np.zeros(0, np.int64)
    sizes = np.diff(offsets) - length + 1
    n, wide = len(raw), length - gram + 1
    if n < length or not (sizes > 0).any():
        return none.astype(np.uint64), none, none, none, none
    grams = spans.runs(gram)
    low = grams & np.uint64(_LAST ^ 0xFFFFFFF)
    low |= np.arange(len(low), dtype=np.uint64)
    span = 1
    while span * 2 <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if wide > span:
        low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
    at = (low & np.uint64(0xFFFFFFF)).astype(np.int64)  # the anchor of the window at each place
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    for s in offsets[1:-1].tolist():  # windows that reach into the next document are none
        new[max(0, s - length + 1) : s] = False
        if s < len(new):
            new[s] = True
    first = np.flatnonzero(new)
    owner = np.searchsorted(offsets, first, "right") - 1
    room = offsets[owner + 1] - length
    keep = first <= room
    last = np.minimum(np.append(first[1:], len(at)) - 1, room)
    first, last, owner = first[keep], last[keep], owner[keep]
    return grams[at[first]], first, last, owner, at[first]


def halves(a: np.ndarray, b: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Windows of the segments with at least half of their rest to the left of the anchor, and the other ones.

    For each of both: the first and last start, the string that all of them have (start, end), whether there are any.
    """
    half = (length - gram) // 2
    left = a, np.minimum(b, at - half), at - half, at + gram, a <= at - half
    right = np.maximum(a, at - half + 1), b, at, at + length - half + 1, b > at - half
    return left, right


def ordinals(owner: np.ndarray, n: int) -> np.ndarray:
    """Place of each item within its document."""
    return np.arange(len(owner)) - np.searchsorted(owner, np.arange(n))[owner]


def _least_of(keys: tuple[np.ndarray, ...], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by keys then rank, and where in it the groups of equal keys start."""
    order = np.lexsort((ranks, *keys[::-1]))
    start = np.ones(len(order), bool)
    start[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, start


#: A place: the anchor's number in its text from bit 3 on, the tiles of its halves, and these bits.
_WHOLE, _LEFT, _RIGHT = 1, 2, 4
_TILES, _LEFT_TILE, _RIGHT_TILE = 4000, 40, 52
_FOUND = "rank long, tid long, place long"
_ANCHORS = "bucket int, docs binary, anchors binary"
_DOC = np.dtype([("rank", "<i8"), ("tid", "<i8"), ("n", "<u2")])
_ANCHOR = np.dtype([("low", "u1", 5), ("body", "<u8"), ("more", "u1", 3), ("ord", "<u4"), ("left", "<u2"), ("right", "<u2")])


def _short(values: np.ndarray, width: int) -> np.ndarray:
    return values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width]


def _long(short: np.ndarray) -> np.ndarray:
    out = np.zeros((len(short), 8), np.uint8)
    out[:, : short.shape[1]] = short
    return out.reshape(-1).view(np.uint64)


def _described(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors as items with the hashes of their segments and halves, their full hashes, and their documents."""
    spans = tk.Spans(raw)
    hashes, a, b, owner, at = anchors(raw, offsets, length, gram, spans)
    items = np.zeros(len(hashes), _ANCHOR)
    if len(hashes):
        items["low"], items["body"], items["more"] = _short(hashes, 5), spans(a, b + length), _short(tk.Spans(raw, tk.OTHER)(a, b + length), 3)
        items["ord"] = ordinals(owner, len(offsets) - 1)
        for name, (_, _, s, e, some) in zip(("left", "right"), halves(a, b, at, length, gram), strict=True):
            items[name][some] = spans(s[some], e[some]) % np.uint64(0xFFFF) + np.uint64(1)
    return hashes, items, owner


def _anchor_rows(buckets: int, length: int, gram: int):
    """For each bucket and chunk: documents with counts, and the items of their anchors.

    Bucket -1 - b has anchors that need no meeting: an equal segment of a smaller id stands in the chunk.
    """

    def rows_of(held: list[tuple]) -> pa.RecordBatch:
        hashes, items, owner, ranks, tids = (np.concatenate(x) for x in zip(*held, strict=True))
        by, start = _least_of((items["body"], _long(items["more"])), ranks)
        least = np.empty(len(by), np.int64)
        least[by] = ranks[by][start][np.cumsum(start) - 1]
        bucket = ((hashes >> _HIGH) % np.uint64(buckets)).astype(np.int64)
        known = ranks > least
        bucket[known] = -1 - (owner[known] + tids[known]) % buckets
        by = np.lexsort((owner, bucket))
        edges = np.flatnonzero(np.append(True, bucket[by][1:] != bucket[by][:-1]))
        rows: tuple[list, list, list] = ([], [], [])
        for s, e in zip(edges, np.append(edges[1:], len(by)), strict=True):
            pick = by[s:e]
            turn = np.flatnonzero(np.append(True, owner[pick][1:] != owner[pick][:-1]))
            turn = np.unique(np.concatenate([turn, np.arange(0, len(pick), 60_000)]))
            docs = np.empty(len(turn), _DOC)
            docs["rank"], docs["tid"] = ranks[pick[turn]], tids[pick[turn]]
            docs["n"] = np.diff(np.append(turn, len(pick)))
            for k, x in enumerate((int(bucket[pick[0]]), docs.tobytes(), items[pick].tobytes())):
                rows[k].append(x)
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(x, pa.binary()) for x in rows[1:])], ["bucket", "docs", "anchors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, seen = [], 0, 0
            for part, raw, offsets in tk.chunks(batch, "text", _CHUNK_BYTES):
                hashes, items, owner = _described(raw, offsets, length, gram)
                if len(hashes):
                    ranks, tids = part.column("rank").to_numpy(), part.column("tid").to_numpy()
                    held.append((hashes, items, owner + seen, ranks[owner], tids[owner]))
                size, seen = size + len(raw), seen + part.num_rows
                if held and size >= _SENT_BYTES:
                    yield rows_of(held)
                    held, size, seen = [], 0, 0
            if held:
                yield rows_of(held)

    return run


def _tiles(key: np.ndarray, some: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """Which keys another row has, too, and the tile (from 1; 0: not dealt) of those that more than ``tile`` rows have."""
    _, back, many = np.unique(np.where(some, key, np.uint64(0)), return_inverse=True, return_counts=True)
    many = np.where(some, many[back], 0)
    out = np.zeros(len(key), np.int64)
    for k in np.unique(back[many > tile]):
        rows = np.flatnonzero(some & (back == k))
        out[rows] = 1 + np.arange(len(rows)) // max(tile, -(-len(rows) // _TILES))
    return many > 1, out


def _meeting(tile: int):
    """Places of segments that go whole, and of halves that have to be compared; rows come sorted by bucket."""

    def known(docs: np.ndarray, items: np.ndarray) -> pa.RecordBatch:
        return _places(np.repeat(docs["rank"], docs["n"]), np.repeat(docs["tid"], docs["n"]), items["ord"].astype(np.int64) * 8 + _WHOLE)

    def met(held: list[tuple]) -> pa.RecordBatch:
        docs, items = (np.concatenate(x) for x in zip(*held, strict=True))
        # items by rank, then stably by the hash of their segments, which has the anchor in it
        rank, tid = np.repeat(docs["rank"], docs["n"]), np.repeat(docs["tid"], docs["n"])
        by = np.argsort(rank, kind="stable")
        by = by[np.argsort(items["body"][by], kind="stable")]
        low, body, more = _long(items["low"]), items["body"][by], items["more"][by]
        start = np.ones(len(by), bool)
        start[1:] = (body[1:] != body[:-1]) | (more[1:] != more[:-1]).any(axis=1)
        group = np.cumsum(start) - 1
        whole = rank[by] > rank[by][start][group]
        one = by[start]
        place = items["ord"][by].astype(np.int64) * 8 + whole * _WHOLE
        keep = whole.copy()
        for name, bit, shift in (("left", _LEFT, _LEFT_TILE), ("right", _RIGHT, _RIGHT_TILE)):
            side = items[name][one]
            meets, tiles = _tiles((low[one] << np.uint64(16)) | side, side > 0, tile)
            asked = meets[group] & ~whole
            place += np.where(asked, bit + (tiles[group] << shift), 0)
            keep |= asked
        return _places(rank[by][keep], tid[by][keep], place[keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for k, docs, items in zip(*(batch.column(c).to_pylist() for c in ("bucket", "docs", "anchors")), strict=True):
                pair = np.frombuffer(docs, _DOC), np.frombuffer(items, _ANCHOR)
                if k < 0:
                    yield known(*pair)
                    continue
                if k != bucket and held:
                    yield met(held)
                    held = []
                bucket = k
                held.append(pair)
        if held:
            yield met(held)

    return run


def _places(rank: np.ndarray, tid: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rank), pa.array(tid), pa.array(place)], ["rank", "tid", "place"])


#: Kinds of rows: a half of a segment; a copy, whose ``start`` is its size; a text with the spans that are known to go.
_HALF, _COPY, _TEXT = 1, 2, 3
_STAGE = pa.schema([
    ("kind", pa.int32()), ("doc_id", pa.int64()), ("rank", pa.int64()), ("tid", pa.int64()), ("shard", pa.int64()), ("tile", pa.int32()),
    ("start", pa.int64()), ("known", pa.binary()), ("body", pa.binary()),
])
_STAGE_SQL = "kind int, doc_id long, rank long, tid long, shard long, tile int, start long, known binary, body binary"


def _binaries(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """An Arrow column of byte spans."""
    sizes = ends - starts
    upto = np.concatenate([[0], np.cumsum(sizes)])
    data = raw[np.repeat(starts - upto[:-1], sizes) + np.arange(upto[-1])]
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(upto.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _stage(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in _STAGE], schema=_STAGE)


def _segments(length: int, gram: int):
    """Copies, halves of segments to compare, and texts with the spans known so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in tk.chunks(batch, "text", _CHUNK_BYTES):
                n, ids = part.num_rows, part.column("doc_id")
                rank, tid = part.column("rank").to_numpy(), part.column("tid").to_numpy()
                sizes = np.diff(offsets)
                copies = part.column("copy").to_numpy(zero_copy_only=False).astype(bool) & (sizes >= length)
                at = np.flatnonzero(copies)
                if len(at):
                    yield _stage(len(at), kind=pa.array(np.full(len(at), _COPY, np.int32)), doc_id=ids.take(pa.array(at)), rank=pa.array(rank[at]), tid=pa.array(tid[at]), start=pa.array(sizes[at]))
                spans = tk.Spans(raw)
                hashes, a, b, owner, spot = anchors(raw, offsets, length, gram, spans)
                found = part.column("found").filter(pa.array(~copies))
                many = pa.compute.fill_null(pa.compute.list_value_length(found), 0).to_numpy()
                place = found.flatten().to_numpy()
                doc = np.repeat(np.flatnonzero(~copies), many)
                which = np.searchsorted(owner, np.arange(n))[doc] + (place >> 3 & ((1 << 36) - 1))
                whole = place & _WHOLE > 0
                gone = np.zeros(len(hashes), bool)
                gone[which[whole]] = True
                if len(hashes):
                    for bit, shift, (s, e, low, high, _) in zip((_LEFT, _RIGHT), (_LEFT_TILE, _RIGHT_TILE), halves(a, b, spot, length, gram), strict=True):
                        pick = (place & bit > 0) & ~gone[which]
                        g, tiles = which[pick], (place[pick] >> shift) & 0xFFF
                        if len(g):
                            shard = spans(low[g], high[g]) + np.uint64(bit)
                            yield _stage(
                                len(g), kind=pa.array(np.full(len(g), _HALF, np.int32)), rank=pa.array(rank[doc[pick]]), tid=pa.array(tid[doc[pick]]), shard=pa.array(shard.view(np.int64)),
                                tile=pa.array(tiles.astype(np.int32)), start=pa.array(s[g] - offsets[doc[pick]]), body=_binaries(raw, s[g], e[g] + length),
                            )
                rest = np.flatnonzero(~copies)
                if len(rest):
                    g = np.flatnonzero(gone)
                    known = np.stack([a[g] - offsets[owner[g]], b[g] + length - offsets[owner[g]]], 1).astype("<i8")
                    upto = 16 * np.searchsorted(owner[g], np.arange(n + 1))
                    yield _stage(
                        len(rest), kind=pa.array(np.full(len(rest), _TEXT, np.int32)), doc_id=ids.take(pa.array(rest)), rank=pa.array(rank[rest]), tid=pa.array(tid[rest]),
                        known=_binaries(np.frombuffer(known.tobytes(), np.uint8), upto[rest], upto[rest + 1]), body=_binaries(raw, offsets[rest], offsets[rest + 1]),
                    )

    return run


def repeated(text: np.ndarray, sizes: np.ndarray, ranks: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Windows of segments, joined in ``text``, that start under a smaller rank: the segment, first and last such start of each run;
    and the windows that have the least rank of their equals: the segment and the start."""
    off = np.concatenate([[0], np.cumsum(sizes)])
    order = suffix_array(text)
    agree = common_prefixes(text, order, length)[order]
    group = np.cumsum(agree < length) - 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(text)) - off[owner] <= (sizes - length)[owner]
    value = np.where(inside, ranks[owner], _LAST)[order]
    least = np.minimum.reduceat(value, np.flatnonzero(np.append(True, group[1:] != group[:-1])))[group]
    hit = np.zeros(len(text), bool)
    hit[order] = (value > least) & inside[order]
    starts, ends = tk.spans(hit, off)
    of = owner[starts]
    lead = np.flatnonzero(inside & ~hit)
    return of, starts - off[of], ends - 1 - off[of], owner[lead], lead - off[owner[lead]]


_SPANS_SQL = "kind int, rank long, tid long, start long, stop long, w1 long, w2 long"
_SPANS = [c.split()[0] for c in _SPANS_SQL.split(", ")]


def _sorted_shards(part_bytes: int, length: int):
    """Spans to remove (kind 0) and, for tiles, their windows of the least rank with hashes (kind 1); rows come sorted by shard and tile."""

    def solve(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        ranks, tids, starts = (table.column(c).to_numpy() for c in ("rank", "tid", "start"))
        # equal halves are sorted once, under their least rank; those of a larger rank go whole
        known = table.column("body").combine_chunks().dictionary_encode()
        code, n = known.indices.to_numpy().astype(np.int64), len(known.dictionary)
        least = np.full(n, _LAST, np.int64)
        np.minimum.at(least, code, ranks)
        size = pa.compute.binary_length(known.dictionary).to_numpy()
        # what is alone under its key has been compared by that, but for other tiles
        keys = table.column("shard").to_numpy()
        key = np.cumsum(np.append(False, keys[1:] != keys[:-1]))
        pair = np.unique(key * n + code)
        tiled = bool(table.column("tile")[0].as_py())
        some = np.arange(n) if tiled else np.unique(pair[np.bincount(pair // n)[pair // n] > 1] % n)
        text, off = tk.texts_of(known.dictionary.take(pa.array(some)).cast(pa.large_binary()))
        none = np.zeros(0, np.int64)
        of, first, last, lead, at = repeated(text, np.diff(off), least[some], length) if len(some) else (none,) * 5
        of, place, lead = some[of], lead, some[lead]
        later = np.flatnonzero(ranks > least[code])
        own = np.flatnonzero(ranks == least[code])
        own = own[np.argsort(code[own], kind="stable")]
        low, high = np.searchsorted(code[own], of), np.searchsorted(code[own], of, "right")

        def members(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rows that have a half under its least rank, and the places in ``of`` or ``lead`` that they belong to."""
            many = high - low
            which = np.repeat(np.arange(len(low)), many)
            return own[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())], which

        row, which = members(low, high)
        begin = np.concatenate([starts[later], starts[row] + first[which]])
        stop = np.concatenate([starts[later] + size[code[later]], starts[row] + last[which] + length])
        gone = np.concatenate([later, row])
        none = np.zeros(len(gone), np.int64)
        columns = none.astype(np.int32), ranks[gone], tids[gone], begin, stop, none, none
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _SPANS)
        if tiled:
            row, which = members(np.searchsorted(code[own], lead), np.searchsorted(code[own], lead, "right"))
            s = (off[place] + at)[which]
            begin = starts[row] + at[which]
            hashes = [tk.Spans(text, base)(s, s + length).view(np.int64) for base in (tk._ODD, tk.OTHER)]
            columns = np.ones(len(row), np.int32), ranks[row], tids[row], begin, begin + length, *hashes
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts end between two keys; a tile is a part of its own."""
        held, size, last = [], 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            shards, tiles = batch.column("shard").to_numpy(), batch.column("tile").to_numpy()
            new = np.ones(n + 1, bool)
            new[1:n] = (shards[1:] != shards[:-1]) | (tiles[1:] != tiles[:-1])
            new[0] = last != (int(shards[0]), int(tiles[0]))
            edges = np.flatnonzero(new)
            upto = np.concatenate([[0], np.cumsum(pa.compute.binary_length(batch.column("body")).to_numpy())])
            at = 0
            while at < n:
                if held and new[at] and (size >= part_bytes or tiles[at] or last[1]):
                    yield from solve(held)
                    held, size = [], 0
                after = edges[np.searchsorted(edges, at, "right") :]
                end = int(after[0])
                if not tiles[at]:  # as many whole keys as make a part, up to the next tile
                    full = int(np.searchsorted(upto[after], upto[at] + part_bytes - size))
                    end = int(after[min(full, len(after) - 1)])
                    hot = np.flatnonzero(tiles[at:end])
                    end = at + int(hot[0]) if len(hot) else end
                held.append(batch.slice(at, end - at))
                size, at, last = size + int(upto[end] - upto[at]), end, (int(shards[end - 1]), int(tiles[end - 1]))
        if held:
            yield from solve(held)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes that stay and the spans that go."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        rows = []
        for kinds, size, body, sure, spans in zip(*(batch.column(c).to_pylist() for c in ("kind", "start", "body", "known", "cuts")), strict=True):
            if kinds == _COPY:
                rows.append((size, b"", [{"start": 0, "stop": size}]))
                continue
            merged: list[list[int]] = []
            for s, e in sorted([*map(tuple, np.frombuffer(sure, "<i8").reshape(-1, 2).tolist()), *((x["start"], x["stop"]) for x in spans or ())]):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            edges = [0, *(x for span in merged for x in span), len(body)]
            kept = b"".join(body[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))
            rows.append((len(body), kept, [{"start": s, "stop": e} for s, e in merged]))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), kind), strict=True))], ["doc_id", "n_bytes", "kept", "spans"]
        )


def remove_repeats(
    documents: DataFrame, length: int = LENGTH, gram: int = GRAM, part_bytes: int = PART_BYTES, bucket_bytes: int = BUCKET_BYTES, tile: int = TILE
) -> DataFrame:
    """For every document: doc_id, n_bytes, ``kept`` (the bytes that stay) and ``spans`` (start and stop of what goes, apart and ascending)."""
    long_texts(documents.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    source = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("rank"),
        F.xxhash64(text, F.octet_length(text)).alias("tid"),
        text.alias("text"),
    )
    # written, so that the joins below read plain exchanges, of which a very common text's can be split
    ids = save(source.select("rank", "tid", F.xxhash64(F.lit(1), "text").alias("other"), F.octet_length("text").alias("size")), "repeat-ids")
    total = ids.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-total // bucket_bytes))
    found = (
        source.select("rank", "tid", "text")
        .mapInArrow(_anchor_rows(parts, length, gram), _ANCHORS)
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_meeting(tile), _FOUND)
    )
    lists = save(found.groupBy("rank", "tid").agg(F.collect_set("place").alias("found")), "repeat-found")
    least = save(ids.groupBy("tid", "other").agg(F.min("rank").alias("least")), "repeat-least")
    copies = ids.join(least, ["tid", "other"]).groupBy("rank", "tid").agg(F.max(F.col("rank") > F.col("least")).alias("copy"))
    marks = save(copies.join(lists, ["rank", "tid"], "left"), "repeat-marks")
    free(lists, least, ids)
    staged = save(
        source.join(marks, ["rank", "tid"]).select("doc_id", "rank", "tid", "text", "copy", "found").mapInArrow(_segments(length, gram), _STAGE_SQL),
        "repeat-stage",
    )
    free(marks)
    spans = save(
        staged.filter(F.col("kind") == _HALF)
        .select("shard", "tile", "rank", "tid", "start", "body")
        .repartition(parts, "shard", "tile")
        .sortWithinPartitions("shard", "tile")
        .mapInArrow(_sorted_shards(part_bytes, length), _SPANS_SQL),
        "repeat-spans",
    )
    windows = spans.filter("kind = 1")
    first = windows.groupBy("w1", "w2").agg(F.min("rank").alias("least"))
    later = windows.join(first, ["w1", "w2"]).filter("rank > least")
    every = spans.filter("kind = 0").select("rank", "tid", "start", "stop").unionByName(later.select("rank", "tid", "start", "stop"))
    cuts = every.groupBy("rank", "tid").agg(F.collect_set(F.struct("start", "stop")).alias("cuts"))
    waiting = staged.filter(F.col("kind") != _HALF).select("kind", "doc_id", "rank", "tid", "start", "known", "body").join(cuts, ["rank", "tid"], "left")
    return waiting.select("kind", "doc_id", "start", "body", "known", "cuts").mapInArrow(_cut, "doc_id long, n_bytes long, kept binary, spans array<struct<start:bigint,stop:bigint>>")


def repeats_digest(documents: DataFrame, **options) -> DataFrame:
    """For every document: doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return remove_repeats(documents, **options).select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
