"""Every query of the core against its SQL in DuckDB."""

import decimal
import re

import duckdb
import pytest

from orefold.functions import text_kinds as K
from orefold.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return str(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    cursor = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall()), key=repr)
    assert sorted(names) == sorted(df.columns)
    assert got == want


def test_personal_data_of_all_documents(spark, sf_dir):
    """Queries whose patterns DuckDB lacks, against plain Python on every document."""

    def kind(text):
        t = (text or "").strip(" ")
        number = re.fullmatch(r"[+-]?([0-9]+)(\.[0-9]+)?", t)
        if not t or re.fullmatch("<redacted kind=[^<>]*>", t):
            return None
        if number and not (len(number[1]) > 1 and number[1][0] == "0") and (number[2] or len(number[1]) <= 8):
            return None
        for name, pattern in (("email", K.EMBEDDED_EMAIL), ("iban", K.EMBEDDED_IBAN), ("identifier", K.EMBEDDED_ID)):
            if re.search(pattern, t, re.ASCII):
                return name
        phones = [m for m in re.findall(K.EMBEDDED_PHONE, t, re.ASCII) if not re.fullmatch(K.WHOLE_DATETIME[1:-1], m.strip(" "))]
        return "phone" if phones and not re.fullmatch(K.WHOLE_DATETIME[1:-1], t) else None

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = {i: kind(t) for i, t in texts.items()}
    assert {r.doc_id: r.kind for r in QUERIES["pii_values"](spark, sf_dir).collect()} == want and len(set(want.values())) > 2
    cells = {r.doc_id: (r.kind, r.cell) for r in QUERIES["redact_rows"](spark, sf_dir).collect()}
    assert cells == {i: (k, f"<redacted kind={k} source=documents.text datatype=string>" if k else texts[i]) for i, k in want.items()}


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
