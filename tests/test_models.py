"""Bindings, sinks, readers, streams and products."""

import pytest
from pyspark.sql import functions as F

from orefold.functions.types import Kind
from orefold.operators import conform, gold, mdm
from orefold.operators import quality as Q
from orefold.plans.binding import Binding, BindingError, Field, Registry, Relationship, compile_binding
from orefold.sources import readers, sinks
from orefold.streaming.scd_stream import scd1_stream

from .test_changes import SCHEMA, T0


def binding(missing="null", ambiguous="error"):
    return Binding(
        "child", "s.child", "s", ("id",), ("id",), (Field("id", {"column": "id"}, Kind("int64")), Field("p", {"column": "p"}, Kind("int64"))),
        (Relationship("urn:x", "parent", "p", "id", "parent_fk", missing, ambiguous),),
    )


def tables(spark, parents):
    child = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "id long, p long")
    return child, {"parent": spark.createDataFrame(parents, "id long, parent_sk string")}


def test_missing_parents(spark):
    child, parents = tables(spark, [(10, "a")])
    rows, apart = compile_binding(binding(), child, parents)
    assert sorted((r.id, r.parent_fk) for r in rows.collect()) == [(1, "a"), (2, "__UNKNOWN__"), (3, "__UNKNOWN__")]
    assert apart.isEmpty()
    rows, apart = compile_binding(binding("quarantine"), child, parents)
    assert [r.id for r in rows.collect()] == [1] and sorted(r.id for r in apart.collect()) == [2, 3]
    with pytest.raises(RuntimeError):
        compile_binding(binding("error"), child, parents)


def test_ambiguous_parents(spark):
    child, parents = tables(spark, [(10, "a"), (10, "b"), (11, "c")])
    with pytest.raises(RuntimeError):
        compile_binding(binding(), child, parents)
    rows, apart = compile_binding(binding("null", "quarantine"), child, parents)
    assert sorted(r.id for r in rows.collect()) == [2, 3] and [r.id for r in apart.collect()] == [1]


def test_refused_binding(spark):
    child, parents = tables(spark, [(10, "a")])
    bad = Binding("c", "s", "s", ("nope",), ("zz",), (Field("id", {"column": "id"}, Kind("int32")),), (Relationship("u", "none", "q", "id", "x", "?"),), "split")
    with pytest.raises(BindingError) as e:
        compile_binding(bad, child, parents)
    assert {p.split(" at ")[0] for p in e.value.problems} == {"unknown-column", "unknown-target", "split-filter", "type", "unknown-parent", "policy"}


def test_registry(spark):
    models = Registry()
    models.register("a", ["b"], lambda s, i: i["b"], "id bigint")
    models.register("b", ["a"], lambda s, i: i["a"], "id bigint")
    with pytest.raises(ValueError, match="cycle"):
        models.get(spark, "a", {})
    models.register("c", [], lambda s, i: s.range(2), "id int")
    with pytest.raises(ValueError, match="contract"):
        models.get(spark, "c", {})


def test_merge_table(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.merge_table(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, ["k"])
    sinks.merge_table(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), path, ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    wider = spark.createDataFrame([(4, "e", 1)], "k int, v string, w int")
    with pytest.raises(ValueError):
        sinks.merge_table(wider, path, ["k"])
    sinks.merge_table(wider, path, ["k"], "append")
    assert spark.read.parquet(path).filter("w = 1").count() == 1
    with pytest.raises(Exception, match="boom"):
        sinks.replace_table(wider.select("k", F.raise_error(F.lit("boom")).cast("string").alias("v")), path)
    assert spark.read.parquet(path).count() == 4


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id;name\n1;x\n2;\n", encoding="utf-8")
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "name"] and df.count() == 2
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(tmp_path / "e.csv"))
    spark.range(3).write.parquet(str(tmp_path / "d/x/y"))
    assert readers.read_directory(spark, str(tmp_path / "d")).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, 1, "insert", T0, T0, T0, "a"), (1, 2, "update", T0, T0, T0, "b"), (2, 1, "insert", T0, T0, T0, "c")]
    src = str(tmp_path / "src")
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_is_deleted", F.lit(0))
    df.write.parquet(src)
    for turn in range(2):
        stream = spark.readStream.schema(df.schema).parquet(src)
        scd1_stream(stream, str(tmp_path / "out"), str(tmp_path / f"check{turn}"), ["k"], ["seq"]).awaitTermination()
        assert sorted((r.k, r.seq) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 2), (2, 1)]


def test_conformance_rules(spark):
    one = {"precedence": 1, "class": "A", "grain": ["id"]}
    assert conform.check_members([one]) == ["conform-too-few"]
    assert conform.check_members([one, {**one, "class": "B"}]) == ["conform-precedence", "conform-class"]
    with pytest.raises(ValueError):
        conform.union_all([spark.range(1), spark.range(1).withColumnRenamed("id", "x")])


def test_measures_and_security(spark):
    m = gold.Measures()
    m.derived("a", ["b"], lambda b: b)
    m.derived("b", ["a"], lambda a: a)
    with pytest.raises(ValueError, match="cycle"):
        m.resolve("a")
    assert gold.secured(spark.range(3), None).isEmpty()
    assert gold.calendar(spark, "2024-01-01", "2024-01-02").first()["is_holiday"] is None


def test_empty_tables_are_not_evaluated(spark):
    none = spark.range(0).withColumn("v", F.lit(1))
    status = lambda df: df.first()["status"]
    assert status(Q.contract_shape(none, Q.Rule("r", "contract-shape"), ["v"])) == "pass"
    assert status(Q.duplicate_rate(none, Q.Rule("r", "duplicate-rate"), ["v"])) == "not-evaluated"
    assert status(Q.share(none, Q.Rule("r", "range"), Q.out_of_range("v", 0, 1))) == "not-evaluated"
    assert Q.quarantine(none, [Q.Rule("r", "range", bad=Q.out_of_range("v", 0, 1))]).isEmpty()
    with pytest.raises(ValueError):
        Q.quarantine(none, [Q.Rule("r", "volume")])


def test_fuzzy_match(spark):
    a = spark.createDataFrame([(1, "Acme Ltd")], "id int, name string")
    b = spark.createDataFrame([(7, "acme ltd."), (8, "Zeta")], "id int, name string")
    got = mdm.match(a, b, "id", "name", "fuzzy", F.upper(F.substring("name", 1, 1)), 0.8).collect()
    assert [(r.left_key, r.right_key) for r in got] == [(1, 7)]


def test_swap_is_recovered(spark, tmp_path):
    """The driver died after the old table was moved away."""
    from orefold.sources import sinks

    path = str(tmp_path / "t")
    sinks.replace_table(spark.createDataFrame([(1, "a")], "k int, v string"), path)
    (tmp_path / "t").rename(tmp_path / "t.old-1234")
    assert sinks.recover_table(spark, path) and not sinks.recover_table(spark, path)
    sinks.merge_table(spark.createDataFrame([(1, "b", 5), (None, "c", 6)], "k int, v string, w int"), path, ["k"], "append")
    sinks.merge_table(spark.createDataFrame([(None, "d", 7)], "k int, v string, w int"), path, ["k"])
    assert sorted((r.k or 0, r.v, r.w) for r in spark.read.parquet(path).collect()) == [(0, "d", 7), (1, "b", 5)]


def test_columns_and_empty_sources(spark):
    from orefold.plans.binding import guarded, without_columns

    df = spark.createDataFrame([(1, 2, 3)], "Id int, rowVersion int, v int")
    assert without_columns(df, ["ROWVERSION", "id"]).columns == ["v"]
    with pytest.raises(KeyError):
        without_columns(df, ["nope"])
    assert guarded(df) is df and guarded(df.limit(0), True).isEmpty()
    with pytest.raises(ValueError):
        guarded(df.limit(0))
