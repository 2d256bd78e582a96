"""Token ids as Parquet list columns, in ascending document order.

File format: a folder of Parquet files, ordered by name and, inside, by ``doc_id``. Columns: ``doc_id``,
``part`` (the file's place), ``first`` (ids before the document inside its part), ``n_tokens`` and
``ids`` (list of int32, dictionary encoded; the integers of the other columns fall back to delta
encoding). Row groups have ``row_group_bytes``, pages ``page_bytes``, and every file has column and
offset indexes, so a reader of a few documents or of the metadata touches only those pages.

Encoding uses the ``tokenizers`` library. A byte-level BPE never joins two pre-tokens, so each
distinct pre-token is encoded once a batch and kept in a bounded cache. Pre-tokens are found on whole
arrays of code points, by the same rules as the library's own splitter. Files whose tokenizer has another splitter,
a normaliser or texts with the tokenizer's special strings go through the library whole.
"""

from __future__ import annotations

import functools
import itertools
import json
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .scratch import long_texts, new_path

END_ID = 2
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 1 << 20
PART_BYTES = 24 << 20
CHUNK_BYTES = 256 << 10
SLOTS = 1 << 21
MOST_IDS = 8 << 20
#: One row of 16 bytes for each part: at most 16 MB are broadcast, above it the join shuffles.
MOST_BROADCAST_PARTS = 1_000_000

#: The contractions of the byte-level pre-tokenizer.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3


def _classes() -> np.ndarray:
    """The class of every code point, by Unicode properties."""
    import regex

    table = np.full(0x110000, _OTHER, np.uint8)
    patterns = [(kind, regex.compile(p)) for kind, p in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+"))]
    for low in range(0, 0x110000, 0x1000):
        text = "".join(chr(c) for c in range(low, low + 0x1000) if not 0xD800 <= c < 0xE000)
        for kind, pattern in patterns:
            for m in pattern.finditer(text):
                table[np.frombuffer(m.group().encode("utf-32-le"), np.uint32)] = kind
    return table


_class_table: list[np.ndarray] = []


def _byte_chars() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + k) for k, b in enumerate(moved)}}


_BYTE_CHARS = _byte_chars()


def pretoken_starts(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True where a pre-token starts; documents begin at the offsets and share none."""
    if not _class_table:
        _class_table.append(_classes())
    n = len(codes)
    kind = _class_table[0][codes]
    opens = np.zeros(n + 1, bool)
    opens[offsets] = True
    opens = opens[:n]
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= opens
    space = kind == _SPACE
    ends = np.ones(n, bool)
    ends[:-1] = start[1:]
    closes = np.ones(n, bool)
    closes[:-1] = opens[1:]
    last = np.flatnonzero(space & ends & ~closes)
    start[last] = True
    blank = last[codes[last] == 32]
    start[blank + 1] = False
    quote = np.flatnonzero((codes == 39) & start)
    quote = quote[quote + 1 < n]
    for word in CONTRACTIONS:
        size = len(word)
        at = quote[quote + size <= n]
        fits = np.ones(len(at), bool)
        for j in range(1, size):
            fits &= (codes[at + j] == ord(word[j])) & ~opens[at + j]
        at = at[fits]
        start[at + 1] = False
        after = at[at + size < n] + size
        start[after] = True
        quote = np.setdiff1d(quote, at)
    return start


class Encoder:
    """Ids of many texts at once, the same as the library gives one by one.

    The library's model encodes each distinct pre-token. Results stay in a table with one slot for each hash
    value below ``slots``; a newer pre-token takes the slot of an older one, and a table of ``most_ids`` ids is emptied.
    """

    def __init__(self, path: str, slots: int = SLOTS, most_ids: int = MOST_IDS):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.split = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and not spec.get("normalizer") and spec["model"].get("type") == "BPE" and not spec.get("truncation") and not spec.get("padding")
        )
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        self.slots, self.most_ids = slots, most_ids
        self._clear()

    def _clear(self) -> None:
        self.keys, self.low, self.size = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32), np.zeros(self.slots, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encode pre-tokens; where the ids of each start in ``ids``, and how many there are."""
        tokenize, line = self.model.tokenize, _BYTE_CHARS[10]
        shown = "\n".join(["" if "\n" in w else w for w in words]).encode().decode("latin-1").translate(_BYTE_CHARS).split(line)
        for k in [k for k, w in enumerate(words) if "\n" in w]:
            shown[k] = words[k].encode().decode("latin-1").translate(_BYTE_CHARS)
        found = [[t.id for t in tokenize(w)] for w in shown]
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        total = int(sizes.sum())
        if self.used + total > self.most_ids:
            self._clear()
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(total, len(self.ids)), np.int32)])
        self.ids[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(found), np.int32, total)
        low = self.used + np.cumsum(sizes, dtype=np.int32) - sizes
        self.used += total
        return low, sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and the places where each text's ids start."""
        odd = [i for i, t in enumerate(texts) if not self.split or any(s in t for s in self.special)]
        if odd:
            rest = set(odd)
            values, first = self._split(["" if i in rest else t for i, t in enumerate(texts)])
            whole = dict(zip(odd, self._plain([texts[i] for i in odd]), strict=True))
            pieces = [whole[i] if i in rest else values[first[i] : first[i + 1]] for i in range(len(texts))]
            return np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        return self._split(texts)

    def _split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = np.flatnonzero(pretoken_starts(codes, offsets))
        ends = np.append(starts[1:], len(codes))
        hashes = tk.hash_spans(codes, starts, ends)
        slot = (hashes & np.uint64(self.slots - 1)).astype(np.int64)
        miss = np.flatnonzero(self.keys[slot] != hashes)
        if len(miss):
            found, some, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            at = miss[some]
            words = [joined[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            low_new, size_new = self._learn(words)
            if self.used == int(size_new.sum()) and len(miss) < len(hashes):  # the table was emptied: encode this chunk anew
                self._clear()
                return self._split(texts)
            low, size = self.low[slot], self.size[slot]
            low[miss], size[miss] = low_new[back], size_new[back]
            self.keys[slot[at]], self.low[slot[at]], self.size[slot[at]] = found, low_new, size_new
        else:
            low, size = self.low[slot], self.size[slot]
        ahead = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=ahead[1:])
        values = self.ids[np.repeat(low - ahead[:-1], size) + np.arange(ahead[-1])]
        return values, ahead[np.searchsorted(starts, offsets)]


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder for each worker process; later tasks find its cache filled."""
    return Encoder(path)


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = encoder_of(path), 0
        for batch in batches:
            for part, _, offsets in tk.chunks(batch, "text", CHUNK_BYTES):
                values, first = encoder.encode([t or "" for t in part.column("text").to_pylist()])
                n = len(offsets) - 1
                sizes = np.diff(first) + 1
                at = np.concatenate([[0], np.cumsum(sizes)])
                ids = np.full(at[-1], end_id, np.int32)
                body = np.ones(at[-1], bool)
                body[at[1:] - 1] = False
                ids[body] = values
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("part"), pa.array(before + at[:-1]), pa.array(sizes), tk.lists(ids, at)],
                    ["doc_id", "part", "first", "n_tokens", "ids"],
                )
                before += int(at[-1]) if n else 0

    return run


def write_tokens(
    documents: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES, part_bytes: int = PART_BYTES,
) -> None:
    """Encode every text (null: empty), append ``end_id`` and write the file format in ``doc_id`` order.

    Other columns are not written. An empty table gives files without rows.
    Null ids come first; rows that repeat an id are ordered by their texts. Parts are ranges of
    (doc_id, hash of the text), so one id may span parts.
    """
    long_texts(documents.sparkSession)
    text = F.coalesce("text", F.lit(""))
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    ranged = documents.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tie")).repartitionByRange(parts, "doc_id", "tie")
    rows = ranged.sortWithinPartitions("doc_id", "tie").select("doc_id", F.spark_partition_id().alias("part"), "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, part int, first long, n_tokens long, ids array<int>"
    rows.mapInArrow(_encode(tokenizer, end_id), shape).write.options(
        **{
            "parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes), "parquet.enable.dictionary": "true",
            "parquet.writer.version": "PARQUET_2_0", "parquet.page.write-checksum.enabled": "true", "compression": "zstd",
        }
    ).parquet(path)


def read_tokens(spark: SparkSession, path: str, documents: Sequence | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` from the files; ``start`` counts the ids of all documents before.

    With ``documents``, a few ids, the filter goes to the files, whose indexes leave out all other pages; the
    offsets need the columns ``part`` and ``n_tokens`` alone.
    """
    rows = spark.read.parquet(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    if rows.select("part").distinct().count() <= MOST_BROADCAST_PARTS:
        offsets = F.broadcast(offsets)
    if documents is not None:
        rows = rows.filter(F.col("doc_id").isin(*documents))
    return rows.join(offsets, "part").select("doc_id", (F.col("offset") + F.col("first")).alias("start"), "n_tokens", "ids")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        offsets = np.asarray(ids.offsets)
        raw = memoryview(np.ascontiguousarray(np.asarray(ids.values)).astype("<u4", copy=False)).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def token_digest(documents: DataFrame, tokenizer: str, end_id: int = END_ID, **options) -> DataFrame:
    """Write the token files, read them back: doc_id, start, n_tokens and the CRC-32 of the ids."""
    spark = documents.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(documents, path, tokenizer, end_id, **options)
    kind = documents.schema["doc_id"].dataType.simpleString()
    return read_tokens(spark, path).mapInArrow(_checksums, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
