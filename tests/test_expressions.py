import hashlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from orefold.functions import hashing, text_kinds
from orefold.functions.expr import MOST_DEPTH, ExpressionError, compile_expr
from orefold.functions.types import Kind, compatible, numeric_result, of_source

INT = {"a": (Kind("int64"), True), "s": (Kind("string"), True)}


@pytest.mark.parametrize(
    "code, tree",
    [
        ("relational", {"fn": "sum", "args": [{"column": "a"}]}),
        ("technical", {"fn": "cast", "args": [{"column": "a"}]}),
        ("nondeterministic", {"fn": "now", "args": []}),
        ("unknown-column", {"column": "zz"}),
        ("unknown-function", {"fn": "soundex", "args": [{"column": "s"}]}),
        ("unknown-operator", {"op": "power", "args": [{"column": "a"}]}),
        ("arity", {"op": "add", "args": [{"column": "a"}]}),
        ("type", {"op": "add", "args": [{"column": "a"}, {"column": "s"}]}),
        ("type", {"op": "equal", "args": [{"column": "a"}, {"column": "s"}]}),
        ("case", {"case": [{"when": {"literal": True, "type": "boolean"}, "then": {"column": "s"}}]}),
    ],
)
def test_refused(code, tree):
    with pytest.raises(ExpressionError) as e:
        compile_expr(tree, INT)
    assert e.value.code == code


def test_depth(spark):
    tree = {"column": "a"}
    for _ in range(MOST_DEPTH):
        tree = {"op": "negate", "args": [tree]}
    with pytest.raises(ExpressionError, match="too-deep"):
        compile_expr(tree, INT)


def test_derived_types(spark):
    df = spark.createDataFrame([(5, Decimal("1.25"))], "i int, d decimal(10,2)")
    known = {"i": (Kind("int32"), True), "d": (Kind("decimal", 10, 2), True)}
    two = {"literal": 2, "type": "int32"}
    row = df.select(
        compile_expr({"op": "divide", "args": [{"column": "i"}, two]}, known).column.alias("q"),
        compile_expr({"op": "multiply", "args": [{"column": "d"}, {"column": "i"}]}, known).column.alias("m"),
    )
    assert row.dtypes == [("q", "int"), ("m", "decimal(10,2)")]
    assert row.first()["m"] == Decimal("6.25")


def test_kinds():
    assert of_source("nvarchar(20)") == Kind("string", length=20)
    assert of_source("decimal(18,2)").spark == "decimal(18,2)"
    assert not compatible(Kind("int32"), Kind("int64"))
    assert compatible(Kind("decimal", 10, 2), Kind("decimal", 12, 2))
    assert not compatible(Kind("string"), Kind("string", length=5))
    assert numeric_result(Kind("int16"), Kind("int64")).name == "int64"


def test_hash_bytes(spark):
    df = spark.sql("SELECT 'Café' AS s, CAST(NULL AS STRING) AS n, CAST(-0.0 AS DECIMAL(18,4)) AS d, X'00FF10' AS b, TIMESTAMP '2026-07-25 17:35:33.752' AS t, true AS f")
    fields = [(F.col("s"), Kind("string")), (F.col("n"), Kind("string")), (F.col("d"), Kind("decimal")), (F.col("b"), Kind("binary")), (F.col("t"), Kind("timestamp")), (F.col("f"), Kind("boolean"))]
    texts = ["Café", None, "0.0000", "00ff10", "2026-07-25T17:35:33.752000Z", "true"]
    labels = ["string", "string", "decimal(18,4)", "binary", "timestamp", "boolean"]
    want = hashing.HEADER
    for t, label in zip(texts, labels, strict=True):
        want += f"{label}:N:0:;" if t is None else f"{label}:V:{len(t.encode())}:{t.encode().hex()};"
    assert df.select(hashing.canonical_hash(fields)).first()[0] == hashlib.sha256(want.encode()).hexdigest()
    assert df.select(hashing.canonical_hash([(F.col("n"), Kind("string"))], "X|")).first()[0] == hashlib.sha256(b"X|string:N:0:;").hexdigest()
    with pytest.raises(ValueError):
        hashing.canonical_hash([(F.col("d"), Kind("float64"))])
    with pytest.raises(ValueError):
        hashing.source_record_key("t")


#: Name, SQL of the value, kind, and the field's canonical bytes.
GOLDEN = (
    ("null-string", "CAST(NULL AS STRING)", Kind("string"), "string:N:0:;"),
    ("empty-string", "''", Kind("string"), "string:V:0:;"),
    ("unicode", "'Caf\u00e9 \U0001f642'", Kind("string"), "string:V:10:436166c3a920f09f9982;"),
    ("decimal", "CAST(123.4 AS DECIMAL(18,4))", Kind("decimal"), "decimal(18,4):V:8:3132332e34303030;"),
    ("date", "DATE '2026-07-25'", Kind("date"), "date:V:10:323032362d30372d3235;"),
    ("time", "'17:35:33.752000'", Kind("time"), "time:V:15:31373a33353a33332e373532303030;"),
    ("timestamp", "TIMESTAMP '2026-07-25 17:35:33.752'", Kind("timestamp"), "timestamp:V:27:323032362d30372d32355431373a33353a33332e3735323030305a;"),
    ("binary", "X'00FF10'", Kind("binary"), "binary:V:6:303066663130;"),
    ("unicode-gt8k-bytes", "repeat('\u00e9', 5000)", Kind("string"), "string:V:10000:" + "c3a9" * 5000 + ";"),
    ("binary-gt8k-bytes", "unhex(repeat('" + bytes(range(256)).hex() + "', 36))", Kind("binary"), "binary:V:18432:" + (bytes(range(256)) * 36).hex().encode().hex() + ";"),
)


@pytest.mark.parametrize("name, sql, kind, body", GOLDEN, ids=[g[0] for g in GOLDEN])
def test_golden_fields(spark, name, sql, kind, body):
    row = spark.sql(f"SELECT {sql} AS v").select(hashing.canonical_field(F.col("v"), kind).alias("body"), hashing.canonical_hash([(F.col("v"), kind)], "H|v1|").alias("hash")).first()
    assert row.body == body and row.hash == hashlib.sha256(f"H|v1|{body}".encode()).hexdigest()


def test_source_types():
    assert of_source("decimal(10)") == Kind("decimal", 10, 4) and of_source("numeric(9, 0)") == Kind("decimal", 9, 0)
    assert [of_source(t).name for t in ("uniqueidentifier", "xml", "ntext", "image")] == ["string", "string", "string", "binary"]


def test_values_of_personal_data(spark):
    rows = [("2026-07-29", None), ("0470-12-34", "phone"), ("  ", None), ("<redacted kind=email source=a.b datatype=c>", None), ("x 123456789", "identifier"), ("12.5", None)]
    df = spark.createDataFrame(rows, "v string, want string").withColumn("got", text_kinds.pii_value_kind(F.col("v")))
    assert [(r.v, r.got) for r in df.collect()] == rows
