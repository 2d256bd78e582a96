"""Mixing sources to target weights by entropy balancing.

Every document i of source s gets a rate r_i between 0 and ``most`` copies. The rates maximise the
entropy -sum m_i (r_i log r_i + (most - r_i) log(most - r_i)) under one token constraint for each
source, sum r_i size_i = target_s, with entropy weights m_i = sqrt(size_i * mean size of s). The dual
is convex with one variable for each source, and its solution tilts the rates exponentially:
r_i = most * t / (1 + t), t = exp(lambda_s * sqrt(size_i / mean_s)). Newton steps run for all
sources at once as aggregates over (source, size) counts. A step that leaves the bracket known so far halves
it, or doubles its distance where the bracket is still open; steps end when every source is within half a word of its
target, or its bracket has no number left between its ends. Sums are taken in decimals, so they don't depend
on the order of rows and reruns on other partitions agree. No document row and no source is brought to the driver.

Rates become copies in three steps that are the same on every run: along the sizes of a source the copies follow the
running sum of the rates, so the words are off by one largest document at most; what then misses the target is
moved by the largest sizes that fit until none fits; inside a (source, size) group the copies go
to documents in the order of a seeded hash, ranked in hash buckets so that no group is one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import free, save

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
HALF_WORD = 0.5
#: Steps of the dual; a bracket of doubles closes in fewer, so more than these are an error.
MOST_STEPS = 200
#: Rows of one hash bucket of a group, about.
BUCKET_ROWS = 1 << 12


def words(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """``source, source_size, target`` from ``source, size, n``.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all sizes; a
    target stops at ``most`` times its source's size and the excess is shared again by weight until
    none is above. The loop brings two numbers a round to the driver. One row for each source is
    ranked in one task: sources are names of data sets, some thousands at most.
    """
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = save(totals.select("source", "source_size", weight.alias("weight")), "mix-sources")
    limit = F.col("source_size") * F.lit(float(most))
    asked = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    full, level = F.lit(False), 0.0
    for _ in range(10_000):
        left, open_weight, count = ranked.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(full, 1)),
        ).first()
        if not open_weight:
            break
        level = (asked - left) / open_weight
        now = limit <= F.lit(level) * F.col("weight")
        if ranked.filter(now | full).count() == count:
            break
        full = full | now
    target = F.when(full | F.lit(level == 0.0), F.least(limit, F.when(full, limit).otherwise(0.0))).otherwise(F.lit(level) * F.col("weight"))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def tilts(sizes: DataFrame, targets: DataFrame, most: int = MOST, steps: int = MOST_STEPS) -> DataFrame:
    """``source, size, n, rate``: the balanced rate of each (source, size) group of positive size.

    A source whose target is at ``most`` times its size gets the rate ``most`` everywhere, one with a target of 0 the rate 0.
    """
    found = sizes.filter("size > 0")
    words_of, many = F.sum((F.col("size") * F.col("n")).cast("decimal(38,0)")), F.sum("n")
    means = found.groupBy("source").agg((words_of.cast("double") / many).alias("mean"))
    none = F.lit(None).cast("double")
    state = save(
        _with(targets, means, "mean").select("source", "source_size", "target", "mean", F.lit(0.0).alias("lam"), none.alias("lo"), none.alias("hi"), F.lit(False).alias("done")),
        "mix-dual",
    )
    cap = F.lit(float(most))
    rate = cap / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("lam") * F.col("x")))))
    tilt = F.sqrt(F.col("size") / F.col("mean")).alias("x")
    whole = F.col("target") >= F.col("source_size") * cap
    for _ in range(steps):
        open_ = state.filter(~F.col("done") & ~whole & (F.col("target") > 0))
        if open_.isEmpty():
            break
        m, r = F.col("size") * F.col("n"), F.col("r")
        exact = lambda c: F.sum(c.cast("decimal(38,10)")).cast("double")
        moments = (
            _with(found, open_, "mean", "lam", how="inner")
            .select("source", "size", "n", tilt, "lam")
            .withColumn("r", rate)
            .groupBy("source")
            .agg(exact(m * r).alias("g"), exact(m * F.col("x") * r * (1 - r / cap)).alias("h"))
        )
        gap = F.col("target") - F.col("g")
        lam = F.col("lam")
        asked = _with(state, moments, "g", "h").withColumns({
            "lo": F.when(gap > 0, lam).otherwise(F.col("lo")), "hi": F.when(gap < 0, lam).otherwise(F.col("hi")),
        }).withColumn("to", lam + gap / F.greatest(F.col("h"), F.lit(1e-300)))
        lo, hi, to = F.col("lo"), F.col("hi"), F.col("to")
        further = F.when(hi.isNull(), lam + F.greatest(F.lit(1.0), F.abs(lam))).otherwise(lam - F.greatest(F.lit(1.0), F.abs(lam)))
        inside = (lo.isNull() | (to > lo)) & (hi.isNull() | (to < hi)) & (F.abs(to - lam) <= F.greatest(F.lit(4.0), F.abs(lam)))
        middle = (lo + hi) / 2
        moved = F.when(inside, to).when(lo.isNull() | hi.isNull(), further).otherwise(middle)
        closed = ~inside & lo.isNotNull() & hi.isNotNull() & ((middle <= lo) | (middle >= hi))
        done = F.col("done") | (F.abs(gap) < HALF_WORD) | closed
        old, state = state, save(
            asked.select(
                "source", "source_size", "target", "mean", F.when(F.col("g").isNull() | done, lam).otherwise(moved).alias("lam"), "lo", "hi",
                F.coalesce(done, F.lit(False)).alias("done"),
            ),
            "mix-dual",
        )
        free(old)
    else:
        raise RuntimeError(f"the dual did not converge in {steps} steps")
    return _with(found, state, "mean", "lam", "target", "source_size").select(
        "source", "size", "n", "target", "lam", "source_size", tilt
    ).select("source", "size", "n", F.when(whole, cap).when(F.col("target") <= 0, 0.0).otherwise(rate).alias("rate"))


def _with(left: DataFrame, right: DataFrame, *columns: str, how: str = "left") -> DataFrame:
    """Left's rows with right's columns of the same source; null is a source."""
    other = right.select(F.col("source").alias("__s"), *columns)
    return left.join(other, F.col("source").eqNullSafe(F.col("__s")), how).drop("__s")


def whole_copies(rates: DataFrame, targets: DataFrame, most: int = MOST, seed: int = 5) -> DataFrame:
    """``source, size, n, copies``: whole copies of each group, their words as near the targets as sizes allow.

    The running sum of exact copies, by size, is rounded down after a seeded shift, and a group gets what it adds to that; so
    the words of a source are off by less than its largest document. A later round moves the largest size that fits in
    what misses, or if none does one document of the least size that ends nearer on the other side; gaps shrink with
    every round, which ends when no document brings the words nearer.
    """
    u = (F.xxhash64("source", F.lit(seed)).bitwiseAND(F.lit(0xFFFFF))) / F.lit(float(1 << 20))
    so_far = F.sum(F.col("n") * F.col("rate")).over(Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    running = rates.withColumn("sum", F.floor(so_far + u))
    before = F.lag("sum", 1, 0).over(Window.partitionBy("source").orderBy("size"))
    copies = F.greatest(F.lit(0), F.least(F.col("n") * most, F.col("sum") - before)).cast("long")
    groups = save(running.select("source", "size", "n", copies.alias("copies")), "mix-copies")
    goal = F.round("target").cast("long")
    while True:
        held = groups
        got = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("got"))
        gaps = _with(targets.select("source", goal.alias("goal")), got, "got").select("source", (F.col("goal") - F.col("got")).alias("gap"))
        room = F.when(F.col("gap") > 0, F.col("n") * most - F.col("copies")).otherwise(F.col("copies"))
        fit = F.when(F.col("size") <= F.abs("gap"), F.col("size")).otherwise(-F.col("size"))
        steps = (
            _with(groups, gaps, "gap")
            .withColumn("room", room)
            .filter((F.col("room") > 0) & (F.col("size") / 2 < F.abs("gap")))
            .groupBy("source")
            .agg(F.max(F.struct(fit.alias("fit"), "size", "room", "gap")).alias("b"))
            .select(
                "source",
                F.col("b.size").alias("at"),
                (F.signum("b.gap") * F.least(F.col("b.room"), F.greatest(F.lit(1), F.floor(F.abs("b.gap") / F.col("b.size"))))).cast("long").alias("by"),
            )
        )
        steps = save(steps, "mix-step")
        if steps.isEmpty():
            return groups
        keyed = steps.select(F.col("source").alias("__s"), "at", "by")
        groups = groups.join(keyed, F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("at")), "left").select(
            "source", "size", "n", (F.col("copies") + F.coalesce("by", F.lit(0))).alias("copies")
        )
        old, groups = held, save(groups, "mix-copies")
        free(old, steps)


def mix(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: int = 5,
) -> DataFrame:
    """``key, source, size, source_size, target, copies`` for every row.

    A null text has size 0; documents of size 0 get no copies. Null sources form one source. Rows
    that agree in key, source and size are told apart by nothing and share their group's copies in
    any order. An empty table gives an empty result; an empty source cannot occur.
    """
    sized = save(
        documents.select(
            F.col(key).alias(key),
            F.col(source).cast("string").alias("source"),
            words(F.col(text)).alias("size"),
            F.xxhash64(F.lit(seed + 2), F.col(key), F.col(text)).alias("turn"),
        ),
        "mix-rows",
    )
    many = max(1, -(-sized.count() // BUCKET_ROWS))
    rows = sized.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "turn"), F.lit(many)))
    buckets = save(rows.groupBy("source", "size", "bucket").agg(F.count("*").alias("n")), "mix-buckets")
    sizes = save(buckets.groupBy("source", "size").agg(F.sum("n").alias("n")), "mix-sizes")
    targets = save(source_targets(sizes, weights, share, most), "mix-targets")
    copies = whole_copies(tilts(sizes, targets, most), targets, most, seed)
    earlier = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    group = copies.select(F.col("source").alias("__s"), F.col("size").alias("__z"), "copies", F.col("n").alias("group_n"))
    shares = (
        buckets.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(group, F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z")))
        .select(
            F.col("source").alias("__s"), F.col("size").alias("__z"), F.col("bucket").alias("__b"),
            F.floor(F.col("copies") / F.col("group_n")).alias("each"),
            (F.pmod("copies", "group_n") - F.col("before")).alias("more"),
        )
    )
    ranked = rows.withColumn(
        "rank", F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("turn", key))
    )
    given = ranked.join(
        shares,
        F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z")) & (F.col("bucket") == F.col("__b")),
        "left",
    )
    copies_of = F.coalesce(F.col("each") + (F.col("rank") <= F.col("more")).cast("long"), F.lit(0)).cast("long")
    return _with(given.select(key, "source", "size", copies_of.alias("copies")), targets, "source_size", "target", how="inner")


def mix_digest(documents: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` and the copies for every document."""
    return mix(documents).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )
