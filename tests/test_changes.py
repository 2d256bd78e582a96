"""Versions and current rows against a plain Python run over random events."""

import random
from datetime import datetime, timedelta

import pytest

from orefold.operators import cdc
from orefold.operators import quality as Q

ID, TIES = ["k"], ["seq"]
SCHEMA = "k int, seq int, _cdc_operation string, _source_effective_at timestamp, _source_updated_at timestamp, _ingested_at timestamp, _row_hash string"
T0 = datetime(2024, 1, 1)


def events(seed, n=120):
    r = random.Random(seed)
    rows = []
    for s in range(n):
        e, u, i = r.randrange(8), r.randrange(10), r.randrange(12)
        rows.append((r.randrange(6), s, r.choice(["insert", "update", "update", "delete", "soft-delete"]), T0 + timedelta(days=e), T0 + timedelta(days=u), T0 + timedelta(days=i), r.choice("abc")))
    return rows


def brute(rows):
    out = []
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k and r[2] != "soft-delete"]
        order = lambda r: (r[3], r[4], r[5], r[1])
        best = {}
        for r in own:
            if r[3] not in best or order(r) > order(best[r[3]]):
                best[r[3]] = r
        line, kept = sorted(best.values(), key=lambda r: r[3]), []
        for r in line:
            state = (r[6], int(r[2] == "delete"))
            if not kept or (kept[-1][6], int(kept[-1][2] == "delete")) != state or line[line.index(r) - 1] is not kept[-1]:
                if not kept or (line[line.index(r) - 1][6], int(line[line.index(r) - 1][2] == "delete")) != state:
                    kept.append(r)
        system = sorted(kept, key=lambda r: (r[5], *order(r)))
        for n, r in enumerate(kept):
            s = system.index(r)
            out.append((k, r[1], r[3], kept[n + 1][3] if n + 1 < len(kept) else None, r[5], system[s + 1][5] if s + 1 < len(system) else None, int(s == len(system) - 1)))
    return sorted(out, key=repr)


COLUMNS = ["k", "seq", "_business_valid_from", "_business_valid_to", "_system_from", "_system_to", "is_current"]


@pytest.mark.parametrize("seed", range(4))
def test_versions(spark, seed):
    rows = events(seed)
    df = cdc.handle_deletes(spark.createDataFrame(rows + rows[:30], SCHEMA), "tombstone", "ignore")
    out = cdc.scd2(df, ID, TIES).select(*COLUMNS)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(rows)


def test_late_events_rebuild_history(spark):
    df = cdc.handle_deletes(spark.createDataFrame(events(9), SCHEMA), "tombstone", "ignore")
    early, late = df.filter("seq % 3 <> 0"), df.filter("seq % 3 = 0")
    merged = cdc.scd2_merge(early, late, cdc.scd2(early, ID, TIES), ID, TIES)
    whole = cdc.scd2(df, ID, TIES)
    assert sorted(map(repr, merged.select(*COLUMNS).collect())) == sorted(map(repr, whole.select(*COLUMNS).collect()))
    assert Q.rt_one_current(merged, ID).isEmpty()


def test_contradiction_fails(spark):
    rows = events(1, 10)
    odd = [(*rows[0][:6], "zzz")]
    df = cdc.handle_deletes(spark.createDataFrame(rows + odd, SCHEMA), "tombstone", "tombstone")
    with pytest.raises(cdc.ContradictionError):
        cdc.scd2(df, ID, TIES)
    with pytest.raises(cdc.ContradictionError):
        cdc.scd1(df, None, ID, TIES)


def test_scd1_ignores_older_and_equal(spark):
    a = (1, 1, "insert", T0, T0, T0, "a")
    old = cdc.scd1(cdc.handle_deletes(spark.createDataFrame([a], SCHEMA), "tombstone", "ignore"), None, ID, TIES)
    later = T0 + timedelta(days=1)
    new = [(1, 0, "update", T0 - timedelta(days=1), T0, T0, "b"), (2, 5, "insert", T0, T0, T0, "c")]
    out = cdc.scd1(cdc.handle_deletes(spark.createDataFrame(new, SCHEMA), "tombstone", "ignore"), old, ID, TIES)
    assert sorted((r.k, r.seq) for r in out.collect()) == [(1, 1), (2, 5)]
    gone = cdc.scd1(cdc.handle_deletes(spark.createDataFrame([(1, 9, "delete", later, later, later, "a")], SCHEMA), "tombstone", "ignore"), old, ID, TIES)
    assert [(r.seq, r._is_deleted) for r in gone.collect()] == [(9, 1)]


def test_policies():
    good = {"strategy": "scd2", "correction": "new-version", "lookback": {"unit": "days", "amount": 2}, "effective_at": "a", "updated_at": "b", "ingested_at": "c", "deletes": "hard-delete"}
    assert cdc.check_load_policy(good) == []
    assert cdc.check_load_policy({**good, "correction": "overwrite", "lookback": {"unit": "seconds", "amount": 0}, "ingested_at": "a", "deletes": "?"}) == [
        "load-correction", "load-lookback", "load-clocks", "load-deletes",
    ]
    with pytest.raises(PermissionError):
        cdc.backfill(None, "2024-01-01", "2024-01-02", False)
    with pytest.raises(ValueError):
        cdc.normalize_operation(None, {"insert": ["a"], "update": ["a"]})


def test_merge_with_null_keys(spark):
    rows = spark.createDataFrame([(None, 1), (2, 2)], "k int, v int")
    more = spark.createDataFrame([(None, 5)], "k int, v int")
    once = cdc.merge(rows, more, ["k"])
    assert sorted((r.k or 0, r.v) for r in cdc.merge(once, more, ["k"]).collect()) == [(0, 5), (2, 2)]


def test_rebuild_needs_permission(spark):
    rows = spark.createDataFrame([(1, 1)], "k int, v int")
    with pytest.raises(PermissionError):
        cdc.rebuild(rows, rows, ["k"], True, False)
    assert cdc.rebuild(rows, rows.limit(0), ["k"], True, True).isEmpty()
    assert cdc.rebuild(rows, rows.limit(0), ["k"], False, False).count() == 1
