"""The closed scalar language of bindings: a tree of columns, literals, operators, functions and cases.

Trees are nested tuples or dictionaries as authored, for example
``{"op": "add", "args": [{"column": "a"}, {"literal": 1, "type": "int32"}]}``. ``compile_expr`` types the
tree, refuses what is not in the language, and gives a Column cast to the derived type.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import NUMERIC, Kind, numeric_result

#: The names of the language and its depth.
MOST_DEPTH = 64
ARITHMETIC = ("add", "subtract", "multiply", "divide", "modulo")
COMPARISONS = ("equal", "not-equal", "less-than", "less-or-equal", "greater-than", "greater-or-equal")
FUNCTIONS = ("abs", "round", "concat", "upper", "lower", "length", "coalesce", "nullif")
MACROS = ("concat", "dayOfWeek", "monthName", "quarter")
#: Names that are refused, by reason.
RELATIONAL = (
    "aggregate", "avg", "count", "dense-rank", "explode", "flatten", "join", "lag", "lead", "lookup", "max", "min", "rank",
    "row-number", "sum", "union", "window",
)
TECHNICAL = ("cast", "trim", "replace", "json-value")
NONDETERMINISTIC = ("now", "rand", "uuid", "current-date", "current-timestamp")


class ExpressionError(ValueError):
    """A tree outside the language; ``code`` is stable."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Typed:
    column: Column
    kind: Kind
    nullable: bool


def compile_expr(tree: Mapping, columns: Mapping[str, tuple[Kind, bool]], depth: int = 0) -> Typed:
    """``columns`` gives each input column's kind and nullability."""
    if depth >= MOST_DEPTH:
        raise ExpressionError("too-deep", f"more than {MOST_DEPTH} levels")
    inner = lambda t: compile_expr(t, columns, depth + 1)
    if "column" in tree:
        if tree["column"] not in columns:
            raise ExpressionError("unknown-column", tree["column"])
        kind, nullable = columns[tree["column"]]
        return Typed(F.col(tree["column"]), kind, nullable)
    if "literal" in tree:
        kind = _kind(tree["type"])
        return Typed(F.lit(tree["literal"]).cast(kind.spark), kind, False)
    if "null" in tree:
        kind = _kind(tree["null"])
        return Typed(F.lit(None).cast(kind.spark), kind, True)
    if "case" in tree:
        return _case(tree, inner)
    name, args = tree.get("op") or tree.get("fn") or tree.get("macro"), [inner(a) for a in tree.get("args", ())]
    for code, names in (("relational", RELATIONAL), ("technical", TECHNICAL), ("nondeterministic", NONDETERMINISTIC)):
        if name in names:
            raise ExpressionError(code, str(name))
    nullable = any(a.nullable for a in args)
    if "op" in tree:
        return _operator(name, args, nullable)
    if "fn" in tree and name in FUNCTIONS:
        return _function(name, args, nullable)
    if "macro" in tree and name in MACROS:
        return _macro(name, args, nullable)
    raise ExpressionError("unknown-function", str(name))


def _kind(value) -> Kind:
    return value if isinstance(value, Kind) else Kind(value)


def _arity(name: str, args: list[Typed], least: int, most: int | None = None) -> None:
    if len(args) < least or (most is not None and len(args) > most):
        raise ExpressionError("arity", f"{name} got {len(args)} arguments")


def _need(name: str, args: list[Typed], kinds: tuple[str, ...]) -> None:
    for a in args:
        if a.kind.name not in kinds:
            raise ExpressionError("type", f"{name} can't take {a.kind.label}")


def _comparable(a: Kind, b: Kind) -> bool:
    return a.name == b.name or (a.name in NUMERIC and b.name in NUMERIC)


def _operator(name: str, args: list[Typed], nullable: bool) -> Typed:
    flag = Kind("boolean")
    if name in ARITHMETIC:
        _arity(name, args, 2, 2)
        _need(name, args, NUMERIC)
        a, b = args[0].column, args[1].column
        kind = numeric_result(args[0].kind, args[1].kind)
        value = {"add": a + b, "subtract": a - b, "multiply": a * b, "divide": a / b, "modulo": a % b}[name]
        return Typed(value.cast(kind.spark), kind, nullable)
    if name == "negate":
        _arity(name, args, 1, 1)
        _need(name, args, NUMERIC)
        return Typed((-args[0].column).cast(args[0].kind.spark), args[0].kind, nullable)
    if name in COMPARISONS:
        _arity(name, args, 2, 2)
        if not _comparable(args[0].kind, args[1].kind):
            raise ExpressionError("type", f"{name} can't compare {args[0].kind.label} and {args[1].kind.label}")
        a, b = args[0].column, args[1].column
        value = {
            "equal": a == b, "not-equal": a != b, "less-than": a < b, "less-or-equal": a <= b, "greater-than": a > b, "greater-or-equal": a >= b,
        }[name]
        return Typed(value, flag, nullable)
    if name in ("and", "or"):
        _arity(name, args, 2)
        _need(name, args, ("boolean",))
        join = (lambda a, b: a & b) if name == "and" else (lambda a, b: a | b)
        return Typed(reduce(join, [a.column for a in args]), flag, nullable)
    if name == "not":
        _arity(name, args, 1, 1)
        _need(name, args, ("boolean",))
        return Typed(~args[0].column, flag, nullable)
    if name in ("is-null", "is-not-null"):
        _arity(name, args, 1, 1)
        value = args[0].column.isNull()
        return Typed(value if name == "is-null" else ~value, flag, False)
    raise ExpressionError("unknown-operator", str(name))


def _function(name: str, args: list[Typed], nullable: bool) -> Typed:
    if name in ("abs", "round"):
        _arity(name, args, 1, 1 if name == "abs" else 2)
        _need(name, args, NUMERIC)
        value = F.abs(args[0].column) if name == "abs" else F.round(*[a.column for a in args])
        return Typed(value.cast(args[0].kind.spark), args[0].kind, nullable)
    if name in ("concat", "upper", "lower", "length"):
        _arity(name, args, 2 if name == "concat" else 1, None if name == "concat" else 1)
        _need(name, args, ("string",))
        if name == "length":
            return Typed(F.length(args[0].column).cast("bigint"), Kind("int64"), nullable)
        return Typed(getattr(F, name)(*[a.column for a in args]), Kind("string"), nullable)
    _arity(name, args, 2, 2 if name == "nullif" else None)
    if any(not _comparable(args[0].kind, a.kind) for a in args):
        raise ExpressionError("type", f"{name} needs arguments of one kind")
    if name == "nullif":
        return Typed(F.nullif(args[0].column, args[1].column), args[0].kind, True)
    return Typed(F.coalesce(*[a.column for a in args]), args[0].kind, all(a.nullable for a in args))


def _macro(name: str, args: list[Typed], nullable: bool) -> Typed:
    if name == "concat":
        return _function("concat", args, nullable)
    _arity(name, args, 1, 1)
    _need(name, args, ("date", "timestamp"))
    c = args[0].column
    if name == "monthName":
        return Typed(F.date_format(c, "MMMM"), Kind("string"), nullable)
    return Typed(F.dayofweek(c) if name == "dayOfWeek" else F.quarter(c), Kind("int32"), nullable)


def _case(tree: Mapping, inner) -> Typed:
    if "else" not in tree or not tree["case"]:
        raise ExpressionError("case", "a case needs a branch and an else")
    branches = [(inner(b["when"]), inner(b["then"])) for b in tree["case"]]
    last = inner(tree["else"])
    _need("case", [w for w, _ in branches], ("boolean",))
    if any(t.kind.name != last.kind.name for _, t in branches):
        raise ExpressionError("type", "branches differ in kind")
    value = F.when(branches[0][0].column, branches[0][1].column)
    for w, t in branches[1:]:
        value = value.when(w.column, t.column)
    return Typed(value.otherwise(last.column), last.kind, last.nullable or any(t.nullable for _, t in branches))
