"""Canonical kinds, their Spark types, and which source type fits which target."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

KINDS = ("string", "boolean", "int16", "int32", "int64", "decimal", "float64", "date", "time", "timestamp", "binary", "json")
_SPARK = {
    "string": "string", "boolean": "boolean", "int16": "smallint", "int32": "int", "int64": "bigint", "float64": "double",
    "date": "date", "time": "string", "timestamp": "timestamp", "binary": "binary", "json": "string",
}
INTEGERS = ("int16", "int32", "int64")
NUMERIC = (*INTEGERS, "decimal", "float64")

#: Source type names and their canonical kinds.
ALIASES = {
    "varchar": "string", "nvarchar": "string", "char": "string", "nchar": "string", "text": "string", "ntext": "string", "string": "string",
    "uniqueidentifier": "string", "xml": "string",
    "bit": "boolean", "bool": "boolean", "boolean": "boolean",
    "smallint": "int16", "tinyint": "int16", "int": "int32", "integer": "int32", "bigint": "int64", "long": "int64",
    "decimal": "decimal", "numeric": "decimal", "money": "decimal", "float": "float64", "real": "float64", "double": "float64",
    "date": "date", "time": "time", "datetime": "timestamp", "datetime2": "timestamp", "timestamp": "timestamp",
    "binary": "binary", "varbinary": "binary", "image": "binary", "json": "json", "variant": "json",
}


@dataclass(frozen=True)
class Kind:
    """A canonical type; decimals default to a precision of 18 and a scale of 4."""

    name: str
    precision: int | None = None
    scale: int | None = None
    length: int | None = None

    def __post_init__(self) -> None:
        if self.name not in KINDS:
            raise ValueError(f"unknown kind {self.name}")
        if self.name == "decimal" and self.precision is None:
            object.__setattr__(self, "precision", 18)
            object.__setattr__(self, "scale", 4)

    @property
    def spark(self) -> str:
        return f"decimal({self.precision},{self.scale})" if self.name == "decimal" else _SPARK[self.name]

    @property
    def label(self) -> str:
        return self.spark if self.name == "decimal" else self.name


def of_source(name: str) -> Kind:
    """The kind of a source type such as ``nvarchar(20)`` or ``decimal(18,2)``."""
    head, _, rest = name.strip().lower().partition("(")
    if head.strip() not in ALIASES:
        raise ValueError(f"unknown source type {name}")
    numbers = [int(x) for x in rest.rstrip(") ").split(",") if x.strip().isdigit()]
    kind = ALIASES[head.strip()]
    if kind == "decimal" and numbers:
        return Kind(kind, numbers[0], numbers[1] if len(numbers) > 1 else 4)
    return Kind(kind, length=numbers[0] if numbers and kind == "string" else None)


def of_spark(data_type: T.DataType) -> Kind:
    if isinstance(data_type, T.DecimalType):
        return Kind("decimal", data_type.precision, data_type.scale)
    back = {"smallint": "int16", "tinyint": "int16", "int": "int32", "bigint": "int64", "double": "float64", "float": "float64"}
    text = data_type.simpleString()
    text = "timestamp" if text.startswith("timestamp") else text
    return Kind(back.get(text, text if text in KINDS else "json"))


def compatible(source: Kind, target: Kind) -> bool:
    """Exact kinds only; decimals need room, bounded strings a source that is not longer."""
    if source.name != target.name:
        return False
    if source.name == "decimal":
        return target.precision >= source.precision and target.scale >= source.scale
    if source.name == "string" and target.length is not None:
        return source.length is not None and source.length <= target.length
    return True


def numeric_result(*kinds: Kind) -> Kind:
    """float64 if any, else the widest decimal, else the widest integer."""
    if any(k.name not in NUMERIC for k in kinds):
        raise ValueError("numeric operands are needed")
    if any(k.name == "float64" for k in kinds):
        return Kind("float64")
    decimals = [k for k in kinds if k.name == "decimal"]
    if decimals:
        return Kind("decimal", max(k.precision for k in decimals), max(k.scale for k in decimals))
    return max(kinds, key=lambda k: INTEGERS.index(k.name))
