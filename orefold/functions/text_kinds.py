"""Shapes, formats and personal data of single values, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of formats, in the order they are tried.
FORMATS = (
    ("uuid", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"),
    ("email", r"^[^@\s]+@[^@\s]+\.[^@\s]+$"),
    ("date", r"^\d{4}-\d{2}-\d{2}"),
    ("url", r"^https?://"),
    ("phone", r"^\+?\d[\d\s\-()]{6,}$"),
    ("numeric_code", r"^\d{2,10}$"),
)
#: Words, dates and key names that shapes and types are told by.
TRUTH_WORDS = ("0", "1", "true", "false", "yes", "no", "y", "n")
ISO_DATE = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}|$)"
DATE_FORMS = (r"^\d{4}-\d{2}-\d{2}$", r"^\d{2}/\d{2}/\d{4}$", r"^\d{2}-\d{2}-\d{4}$")
DATETIME_FORM = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:\d{2})?$"
KEYISH = r"(?i)(^|_)(id|key|code|number|no)$"

#: Column names of personal data and the detectors of values.
PII_NAMES = (
    "first_name", "last_name", "date_of_birth", "national_id", "iban", "phone", "email", "address", "ssn", "passport", "tax_id",
    "gender", "ethnicity", "religion", "health", "maiden_name", "birth_place", "nationality", "marital_status", "next_of_kin",
)
EMBEDDED_EMAIL = r"(?<![\w.+-])[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}(?![\w.-])"
EMBEDDED_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}[A-Za-z0-9 ]{8,30}"
EMBEDDED_ID = r"(?<!\d)\d{9,}(?!\d)"
EMBEDDED_PHONE = r"(?<!\w)\+?\d[\d\s().-]{6,}\d(?!\w)"
WHOLE_DATETIME = (
    r"^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])"
    r"(?:[T ](?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d+)?)?(?:Z|[+-](?:[01]\d|2[0-3]):[0-5]\d)?)?$"
)
#: Ranges of coordinates and limits of samples.
LOCATION_RANGES = {"latitude": (-90.0, 90.0), "longitude": (-180.0, 180.0), "lng": (-180.0, 180.0), "coordinate": (-180.0, 180.0)}
MOST_EXEMPT_DIGITS = 8
MOST_SAMPLE_CHARS = 48
#: What is masked but for its last two characters.
MASKED_NUMBERS = (r"^[A-Z]{2}\d{2}[A-Za-z0-9]{8,30}$", r"^\+?[\d][\d\s().-]{6,}$", r"^\d{9,}$")


def sample_shape(c: Column) -> Column:
    """blank, numeric, date, boolean, email, code or text."""
    t = F.trim(c.cast("string"))
    return (
        F.when(t == "", "blank").when(t.rlike(r"^-?\d+([,.]\d+)?$"), "numeric").when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), "date")
        .when(F.lower(t).isin(*TRUTH_WORDS), "boolean").when(t.rlike(FORMATS[1][1]), "email")
        .when(t.rlike(r"(?i)^[A-Z0-9_-]{2,20}$"), "code").when(t.isNotNull(), "text")
    )


def parses_as(c: Column, sql_type: str) -> Column:
    """Whether a sample reads as the type; types other than numbers, dates and flags take any text."""
    t, name = F.trim(c.cast("string")), sql_type.lower()
    if any(x in name for x in ("int", "decimal", "numeric")):
        return F.replace(t, F.lit(","), F.lit(".")).try_cast("double").isNotNull()
    if any(x in name for x in ("date", "time")):
        return t.rlike(r"^\d{4}-\d{2}-\d{2}") | t.rlike(r"^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}")
    if any(x in name for x in ("bool", "bit")):
        return F.lower(t).isin(*TRUTH_WORDS)
    return t.isNotNull()


def pii_name_kind(column: str) -> str | None:
    """The personal-data word in a column's name, if any."""
    plain = re.sub(r"[^a-z0-9]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", column).lower())
    return next((k for k in PII_NAMES if k in plain or k.replace("_", "") in plain.replace("_", "")), None)


def exempt_number(t: Column) -> Column:
    """A plain number with a fraction or few digits and no leading zero: never an identifier."""
    whole = F.regexp_extract(t, r"^[+-]?(\d+)(\.\d+)?$", 1)
    fraction = F.regexp_extract(t, r"^[+-]?(\d+)(\.\d+)?$", 2)
    return (whole != "") & ~((F.length(whole) > 1) & whole.startswith("0")) & ((fraction != "") | (F.length(whole) <= MOST_EXEMPT_DIGITS))


def pii_value_kind(c: Column) -> Column:
    """email, iban, identifier or phone found in a value, else null. Dates and plain amounts are exempt."""
    t = F.trim(c.cast("string"))
    phones = F.filter(F.regexp_extract_all(t, F.lit(EMBEDDED_PHONE), F.lit(0)), lambda m: ~F.trim(m).rlike(WHOLE_DATETIME))
    return F.when((t == "") | t.rlike("^<redacted kind=[^<>]*>$") | exempt_number(t), F.lit(None)).otherwise(
        F.when(t.rlike(EMBEDDED_EMAIL), "email").when(t.rlike(EMBEDDED_IBAN), "iban").when(t.rlike(EMBEDDED_ID), "identifier")
        .when(~t.rlike(WHOLE_DATETIME) & (F.size(phones) > 0), "phone")
    )


def location_kind(column: str, c: Column) -> Column:
    """``location`` for a fraction in range under a latitude or longitude name, or a pair of such."""
    words = {w.rstrip("s") for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "_", column).lower())}
    ranges = [LOCATION_RANGES[w] for w in sorted(words) if w in LOCATION_RANGES]
    if not ranges:
        return F.lit(None).cast("string")
    low, high = min(r[0] for r in ranges), max(r[1] for r in ranges)
    t = F.trim(c.cast("string"))
    inside = lambda x, a, b: x.rlike(r"^[+-]?\d+\.\d+$") & x.try_cast("double").between(a, b)
    parts = F.split(t, ",")
    pair = (F.size(parts) == 2) & inside(F.trim(F.get(parts, 0)), -180.0, 180.0) & inside(F.trim(F.get(parts, 1)), -180.0, 180.0)
    return F.when(inside(t, low, high) | pair, "location")


def redacted(c: Column, kind: Column, table: str, column: str, data_type: str) -> Column:
    """The whole cell as an opaque token where there is a kind; tokens stay as they are."""
    token = F.concat(F.lit("<redacted kind="), kind, F.lit(f" source={table}.{column} datatype={data_type}>"))
    return F.when(kind.isNotNull(), token).otherwise(c.cast("string"))


def masked(c: Column) -> Column:
    """For display: an address keeps two characters and its top domain, numbers the last two, others the first."""
    t = F.trim(c.cast("string"))
    compact = F.replace(t, F.lit(" "), F.lit(""))
    local = F.substring_index(t, "@", 1)
    numeric = compact.rlike(MASKED_NUMBERS[0]) | t.rlike(MASKED_NUMBERS[1]) | t.rlike(MASKED_NUMBERS[2])
    stars = F.repeat(F.lit("*"), F.greatest(F.length(t) - 2, F.lit(1)))
    return (
        F.when(t == "", t)
        .when(t.rlike(FORMATS[1][1]), F.concat(F.substring(local, 1, 2), F.lit("***@***."), F.substring_index(t, ".", -1)))
        .when(numeric, F.concat(stars, F.when(F.length(t) > 2, F.right(t, F.lit(2))).otherwise("")))
        .otherwise(F.concat(F.substring(t, 1, 1), F.lit("***")))
    )


def clipped(c: Column, most: int = MOST_SAMPLE_CHARS) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 1), F.lit("…")))
