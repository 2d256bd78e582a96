"""Canonical row hashes and keys.

Canonical hash, version 1: SHA-256 of a header and, for each field, ``label:V:<bytes>:<hex>;`` of its
canonical text or ``label:N:0:;`` for null. The header is a parameter, so hashes written by other
systems with their own header can be reproduced. Floats and JSON have no canonical text here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import Kind

HEADER = "CANONICAL-HASH|v1|"
#: Fixed value: stands for null in surrogate keys.
NULL_TOKEN = "_null_"
UNKNOWN_MEMBER = "__UNKNOWN__"


def canonical_text(c: Column, kind: Kind) -> Column:
    """The one text of a value of this kind."""
    if kind.name in ("float64", "json"):
        raise ValueError(f"{kind.name} can't be a hash input; map it to an exact type")
    if kind.name == "boolean":
        return F.when(c, F.lit("true")).when(~c, F.lit("false"))
    if kind.name == "decimal":
        return c.cast(kind.spark).cast("string")
    if kind.name == "timestamp":
        return F.date_format(F.to_utc_timestamp(c, "UTC"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    if kind.name == "date":
        return F.date_format(c, "yyyy-MM-dd")
    if kind.name == "binary":
        return F.lower(F.hex(c))
    return c.cast("string")


def canonical_field(c: Column, kind: Kind) -> Column:
    body = F.encode(canonical_text(c, kind), "UTF-8")
    some = F.concat(F.lit(f"{kind.label}:V:"), F.octet_length(body).cast("string"), F.lit(":"), F.lower(F.hex(body)), F.lit(";"))
    return F.coalesce(some, F.lit(f"{kind.label}:N:0:;"))


def canonical_hash(fields: Sequence[tuple[Column, Kind]], header: str = HEADER) -> Column:
    """Lowercase hex SHA-256 over the fields, in the order given."""
    return F.sha2(F.concat(F.lit(header), *[canonical_field(c, k) for c, k in fields]), 256)


def surrogate_key(*columns: Column) -> Column:
    """MD5 of the texts joined by ``-``, nulls as a token. This formula is frozen."""
    return F.md5(F.concat_ws("-", *[F.coalesce(c.cast("string"), F.lit(NULL_TOKEN)) for c in columns]))


def source_record_key(table: str, *keys: Column) -> Column:
    """The surrogate key of a table's name and its primary key columns."""
    if not keys:
        raise ValueError(f"{table} has no primary key")
    return surrogate_key(F.lit(table), *keys)


def entity_iri(class_uri: str, key_hash: Column) -> Column:
    return F.concat(F.lit(class_uri + "/instance/"), key_hash)


def match_count_name(property_uri: str) -> str:
    """The column that counts the parents matched for a relationship."""
    return f"_fk_{hashlib.sha256(property_uri.encode()).hexdigest()[:12]}_match_count"
