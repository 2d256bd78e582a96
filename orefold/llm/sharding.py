"""Two-pass external shuffle into shards.

Pass one counts records per bucket; pass two scatters the records into buckets by seeded hashes,
shuffles each bucket (Fisher-Yates, Spark's ``shuffle`` of an array in a fixed order) and numbers
its records behind those of the shard's earlier buckets. A bucket holds about ``bucket_rows``
records or ``bucket_bytes`` of texts, whichever is less, whatever the size of the input, so no task
holds more than a few buckets. Records that are alike in every column share a hash; where that makes a bucket too large,
records part by their places in the input as well.

The law is ``key``: a shard is chosen by rendezvous hashing, so it depends on the key and the number
of shards alone, and one more shard takes records only into itself. A null key counts as a key.
Records with one key share a shard; inside it they are scattered by all their other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import new_path

LAW = "key"
BUCKET_BYTES = 8 << 20
#: So many buckets are one task's and one file's.
GROUP = 4
#: Slots of so many buckets are broadcast (some 24 bytes each); of more they are joined by a shuffle.
MOST_BROADCAST_BUCKETS = 1_000_000


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """The shard with the highest seeded hash of the key: an integer from 0 to ``shards - 1``."""
    if shards < 1:
        raise ValueError("shards must be positive")
    scores = F.array(*[F.xxhash64(key, F.lit(seed), F.lit(s)) for s in range(shards)])
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def _compare(a: Column, b: Column) -> Column:
    """The order of records that hold maps: by their other columns."""
    x, y = a["__key"], b["__key"]
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def buckets_a_shard(df: DataFrame, shards: int, bucket_rows: int, bucket_bytes: int) -> int:
    """So many buckets that each has about ``bucket_rows`` records and ``bucket_bytes`` of texts at most."""
    sizes = [F.coalesce(F.octet_length(f.name), F.lit(0)).cast("long") for f in df.schema if f.dataType.simpleString() in ("string", "binary")]
    rows, size = df.agg(F.count("*"), F.sum(sum(sizes, F.lit(0).cast("long")))).first()
    return max(1, -(-rows // (shards * bucket_rows)), -(-(size or 0) // (shards * bucket_bytes)))


def _dealt(df: DataFrame, key: str, shards: int, seed: int, bucket_rows: int, bucket_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The scattered and shuffled records (``shard, __group, __sub, __at, __rec``) and each bucket's first slot."""
    if bucket_rows < 1 or bucket_bytes < 1 or shards < 1:
        raise ValueError("shards, bucket_rows and bucket_bytes must be positive")
    per_shard = buckets_a_shard(df, shards, bucket_rows, bucket_bytes)
    hashed = [F.col(f.name) for f in df.schema if "map<" not in f.dataType.simpleString()]
    keyed = df.select(
        rendezvous(F.col(key), shards, seed).alias("shard"),
        F.xxhash64(F.lit(seed + 1), *hashed).alias("__hash"),
        F.struct(*([F.struct(*hashed).alias("__key")] if len(hashed) < len(df.columns) else []), *[F.col(c) for c in df.columns]).alias("__rec"),
    )
    buckets = lambda salt: keyed.withColumn("__sub", F.pmod(F.col("__hash"), F.lit(per_shard)) + F.lit(per_shard) * salt)
    counted = lambda placed: placed.groupBy("shard", "__sub").agg(F.count("*").alias("__n"))
    placed = buckets(F.lit(0))
    largest = counted(placed).agg(F.max("__n")).first()[0] or 0
    if largest > 4 * bucket_rows:  # records alike in every column: these part by their places in the input
        placed = buckets(F.pmod(F.monotonically_increasing_id(), F.lit(-(-largest // bucket_rows))))
    before = Window.partitionBy("shard").orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted(placed).select("shard", "__sub", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    grouped = placed.withColumn("__group", F.floor(F.col("__sub") / GROUP)).drop("__hash")
    tasks = max(32, 2 * -(-shards * per_shard // GROUP))
    scattered = grouped.repartition(tasks, "shard", "__group").groupBy("shard", "__group", "__sub").agg(F.collect_list("__rec").alias("__recs"))
    # Spark's shuffle draws on from bucket to bucket of a task: a fixed order of both makes it the same on every run
    ordered = F.array_sort("__recs", _compare) if len(hashed) < len(df.columns) else F.array_sort("__recs")
    shuffled = scattered.sortWithinPartitions("shard", "__sub").select("shard", "__sub", F.shuffle(ordered, F.lit(seed + 2)).alias("__recs"))
    if shards * per_shard <= MOST_BROADCAST_BUCKETS and largest <= 4 * bucket_rows:
        offsets = F.broadcast(offsets)
    return shuffled, offsets


def shuffle_into_shards(
    df: DataFrame, key: str, shards: int = 16, seed: int = 17, bucket_rows: int = 8192, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """All columns of ``df``, with ``shard`` and a gapless ``slot`` from 0 inside the shard.

    Columns of these names in the input are replaced. An empty table gives an empty result. Null keys are a key, null
    and empty texts are records like others, equal records stay apart.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in ("shard", "slot", "__sub", "__recs", "__hash", "__group")])
    shuffled, offsets = _dealt(df, key, shards, seed, bucket_rows, bucket_bytes)
    dealt = shuffled.join(offsets, ["shard", "__sub"]).select("shard", "__first", F.posexplode("__recs").alias("__at", "__rec"))
    return dealt.select(
        *[F.col("__rec").getField(c).alias(c) for c in df.columns],
        "shard",
        (F.col("__first") + F.col("__at")).cast("long").alias("slot"),
    )


def write_shards(df: DataFrame, path: str, key: str, **options) -> None:
    """Write the shuffled records, one folder for each shard, in slot order inside each file.

    Every task writes the buckets it has shuffled, so the records travel once. A file holds up to ``GROUP`` buckets.
    """
    out = shuffle_into_shards(df, key, **options)
    out.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; of no bytes for null."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def shard_digest(documents: DataFrame, shards: int = 16, seed: int = 17, bucket_rows: int = 8192) -> DataFrame:
    """One row for each document: its size in bytes plus one, checksum, law, shard, slot and grown shard.

    The documents are shuffled and written with their texts; all columns come from the written shards.
    """
    spark = documents.sparkSession
    path = new_path(spark, "shards")
    write_shards(documents, path, "doc_id", shards=shards, seed=seed, bucket_rows=bucket_rows)
    kinds = {c: documents.schema[c].dataType.simpleString() for c in ("doc_id", "text")}
    out = spark.read.schema(f"doc_id {kinds['doc_id']}, text {kinds['text']}, slot long, shard int").parquet(path)
    return out.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        text_crc32(F.col("text")).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        rendezvous(F.col("doc_id"), shards + 1, seed).alias("grown_shard"),
    )
