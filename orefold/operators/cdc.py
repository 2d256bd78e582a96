"""Change events into current rows and into versions.

Events carry a merge identity, ``_cdc_operation`` (insert, update, delete, soft-delete, snapshot),
``_source_effective_at``, ``_source_updated_at``, ``_ingested_at`` and tie-breakers. They are totally
ordered by these times, then the tie-breakers. Decisions taken where descriptions of such a runtime
differ: ignored deletes leave before a winner is chosen; two different events of one identity and
order are an error in both strategies; history of an affected key is rebuilt as a whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.macros import lookback_floor, newer

OPERATIONS = ("insert", "update", "delete", "soft-delete", "snapshot")
TIMES = ("_source_effective_at", "_source_updated_at", "_ingested_at")
#: What an authored delete policy means for hard and soft deletes.
DELETE_POLICIES = {
    "error": ("block", "block"), "hard-delete": ("tombstone", "ignore"), "soft-delete": ("ignore", "tombstone"), "ignore": ("ignore", "ignore"),
}


class ContradictionError(RuntimeError):
    """Two different events stand at the same place of the order."""


def normalize_operation(c: Column, values: Mapping[str, Sequence[str]]) -> Column:
    """Authored values to operations; the sets must be disjoint, what is in none becomes null."""
    every = [v for vs in values.values() for v in vs]
    if len(set(every)) != len(every):
        raise ValueError("operation values must be disjoint")
    out = None
    for name, vs in values.items():
        out = F.when(c.isin(*vs), F.lit(name)) if out is None else out.when(c.isin(*vs), F.lit(name))
    return out


def handle_deletes(events: DataFrame, hard: str, soft: str) -> DataFrame:
    """``ignore`` drops the events, ``tombstone`` marks them with ``_is_deleted = 1``; ``block`` leaves them to the guard."""
    op = F.col("_cdc_operation")
    drop = F.lit(False)
    if hard == "ignore":
        drop = drop | (op == "delete")
    if soft == "ignore":
        drop = drop | (op == "soft-delete")
    return events.filter(~F.coalesce(drop, F.lit(False))).withColumn("_is_deleted", F.coalesce(op.isin("delete", "soft-delete"), F.lit(False)).cast("int"))


def order_of(ties: Sequence[str], descending: bool = False) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in (*TIMES, *ties)]


def contradictions(events: DataFrame, identity: Sequence[str], ties: Sequence[str], value: str = "_row_hash") -> DataFrame:
    """Places of the order with more than one operation or value; empty on sound input."""
    return (
        events.groupBy(*identity, *TIMES, *ties)
        .agg(F.count_distinct(F.struct("_cdc_operation", value)).alias("variants"))
        .filter("variants > 1")
    )


def guard(events: DataFrame, identity: Sequence[str], ties: Sequence[str], value: str = "_row_hash") -> None:
    if not contradictions(events, identity, ties, value).isEmpty():
        raise ContradictionError(f"contradictory events for {', '.join(identity)}")


def replay_dedup(events: DataFrame, identity: Sequence[str], ties: Sequence[str], value: str = "_row_hash", clock: str = "_ingested_at") -> DataFrame:
    """Identical events collapse to the one first loaded."""
    w = Window.partitionBy(*identity, *TIMES, *ties, "_cdc_operation", value).orderBy(clock)
    return events.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def latest(events: DataFrame, identity: Sequence[str], ties: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*identity).orderBy(*order_of(ties, True))
    return events.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def lookback(events: DataFrame, target: DataFrame, clock: str, amount: int, unit: str) -> DataFrame:
    """Events from the target's newest clock less the lookback on; one value comes to the driver."""
    top = target.select(F.coalesce(lookback_floor(F.max(clock), amount, unit), F.lit("1900-01-01").cast("timestamp")).alias("t")).first()["t"]
    return events.filter(F.col("_ingested_at") >= F.lit(top))


def backfill(events: DataFrame, start: str, end: str, approved: bool) -> DataFrame:
    """Events effective in [start, end); an error unless the policy approves it."""
    if not approved or not start < end:
        raise PermissionError("a backfill needs an approved policy and start < end")
    t = F.col("_source_effective_at")
    return events.filter((t >= F.lit(start).cast("timestamp")) & (t < F.lit(end).cast("timestamp")))


def scd1_changes(newest: DataFrame, target: DataFrame, identity: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """Newest events that are new, or newer than the target and different in value or deletion."""
    old = target.select(*identity, *[F.col(c).alias(f"__t_{c}") for c in (*TIMES, *ties, "_row_hash", "_is_deleted")], F.lit(1).alias("__old"))
    joined = newest.join(old, list(identity), "left")
    order = (*TIMES, *ties)
    later = newer([F.col(c) for c in order], [F.col(f"__t_{c}") for c in order])
    differs = ~F.col("_row_hash").eqNullSafe(F.col("__t__row_hash")) | ~F.col("_is_deleted").eqNullSafe(F.col("__t__is_deleted"))
    return joined.filter(F.col("__old").isNull() | (later & differs)).select(*newest.columns)


def merge(target: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the target whose keys do not change, and the changes. A null key is a key, so a repeated merge adds nothing."""
    given = changes.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return target.join(given, same, "left_anti").unionByName(changes)


def rebuild(target: DataFrame | None, rows: DataFrame, keys: Sequence[str], full: bool, allowed: bool) -> DataFrame:
    """The whole table from the rows where a full rebuild is asked and the policy allows it, else a merge."""
    if full and not allowed:
        raise PermissionError("the load policy does not allow a full rebuild")
    return rows if full or target is None else merge(target, rows, keys)


def late_arrivals(events: DataFrame, target: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Events effective before the newest state that the target holds for their identity."""
    newest = target.groupBy(*identity).agg(F.max("_source_effective_at").alias("__newest"))
    return events.join(newest, list(identity)).filter(F.col("_source_effective_at") < F.col("__newest")).drop("__newest")


def scd1(events: DataFrame, target: DataFrame | None, identity: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """The current rows after the events."""
    guard(events, identity, ties)
    newest = latest(events, identity, ties)
    return newest if target is None else merge(target, scd1_changes(newest, target, identity, ties), identity)


def corrected(events: DataFrame, identity: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """One event for each identity and effective time: the last in the order."""
    w = Window.partitionBy(*identity, "_source_effective_at").orderBy(*order_of(ties, True))
    return events.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def compacted(events: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Events whose value or deletion differs from the one before in effective time."""
    w = Window.partitionBy(*identity).orderBy("_source_effective_at")
    state = F.struct("_row_hash", "_is_deleted")
    before = F.lag(state).over(w)
    return events.withColumn("__b", before).filter(F.col("__b").isNull() | (F.col("__b") != state)).drop("__b")


def intervals(events: DataFrame, identity: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """Half-open business and system intervals and the current flag."""
    business = Window.partitionBy(*identity).orderBy("_source_effective_at")
    system = Window.partitionBy(*identity).orderBy(F.col("_ingested_at").asc(), *order_of(ties))
    last = Window.partitionBy(*identity).orderBy(F.col("_ingested_at").desc(), *order_of(ties, True))
    return events.withColumns(
        {
            "_business_valid_from": F.col("_source_effective_at"),
            "_business_valid_to": F.lead("_source_effective_at").over(business),
            "_system_from": F.col("_ingested_at"),
            "_system_to": F.lead("_ingested_at").over(system),
            "is_current": F.when(F.row_number().over(last) == 1, 1).otherwise(0),
        }
    )


def scd2(events: DataFrame, identity: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """All versions of the events: replays dropped, corrections won, repeats compacted, intervals set.

    Events are dealt by identity once; every later step keeps to that, so it sorts and doesn't shuffle again.
    """
    guard(events, identity, ties)
    events = events.repartition(*identity)
    return intervals(compacted(corrected(replay_dedup(events, identity, ties), identity, ties), identity), identity, ties)


def affected_history(history: DataFrame, incoming: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Stored events of the keys that come in again; others need not be touched."""
    return history.join(incoming.select(*identity).distinct(), list(identity), "left_semi")


def scd2_merge(history: DataFrame, incoming: DataFrame, versions: DataFrame, identity: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """Versions after more events: those of affected keys are rebuilt from their whole history."""
    rebuilt = scd2(affected_history(history, incoming, identity).unionByName(incoming), identity, ties)
    return versions.join(incoming.select(*identity).distinct(), list(identity), "left_anti").unionByName(rebuilt)


def check_load_policy(policy: Mapping) -> list[str]:
    """Codes of what is wrong with an incremental load policy."""
    found = []
    if policy.get("strategy") not in ("scd1", "scd2"):
        found.append("load-strategy")
    allowed = {"scd1": ("error", "overwrite"), "scd2": ("error", "new-version")}.get(policy.get("strategy"), ())
    if policy.get("correction") not in allowed:
        found.append("load-correction")
    back = policy.get("lookback", {})
    if back.get("unit") not in ("hours", "days") or not isinstance(back.get("amount"), int) or back["amount"] < 1:
        found.append("load-lookback")
    clocks = [policy.get(c) for c in ("effective_at", "updated_at", "ingested_at")]
    if None in clocks or len(set(clocks)) != 3:
        found.append("load-clocks")
    if policy.get("deletes") not in DELETE_POLICIES:
        found.append("load-deletes")
    return found
