"""Bindings: a closed description of one entity from one relation, validated, then compiled to a DataFrame.

Validation collects every problem as ``code at pointer``; a binding with any is refused as a whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ExpressionError, compile_expr
from ..functions.hashing import canonical_hash, match_count_name, source_record_key, surrogate_key
from ..functions.types import Kind, compatible, of_spark
from ..operators.lookup import AMBIGUOUS, MISSING, counted_lookup, first_parent, lookup, unknown_member, with_match_count


@dataclass(frozen=True)
class Field:
    target: str
    expression: Mapping
    kind: Kind
    nullable: bool = True
    tracked: bool = True


@dataclass(frozen=True)
class Relationship:
    """A key to a parent model; ``as_of`` is (own time, parent from, parent to)."""

    property_uri: str
    parent: str
    local: str
    foreign: str
    name: str
    missing: str = "null"
    ambiguous: str = "error"
    current: str | None = None
    as_of: tuple[str, str, str] | None = None


@dataclass(frozen=True)
class Binding:
    model: str
    source: str
    system: str
    primary_key: tuple[str, ...]
    business_key: tuple[str, ...]
    fields: tuple[Field, ...]
    relationships: tuple[Relationship, ...] = ()
    mapping: str = "direct"
    where: Mapping | None = None
    technical: tuple[Field, ...] = field(default=())


class BindingError(ValueError):
    def __init__(self, problems: Sequence[str]):
        super().__init__("; ".join(problems))
        self.problems = tuple(problems)


def columns_of(df: DataFrame) -> dict[str, tuple[Kind, bool]]:
    return {f.name: (of_spark(f.dataType), f.nullable) for f in df.schema.fields}


def validate(binding: Binding, source: DataFrame, parents: Mapping[str, DataFrame]) -> list[str]:
    problems, known = [], columns_of(source)
    names = [f.target for f in (*binding.fields, *binding.technical)]
    problems += [f"duplicate-target at /fields/{n}" for n in sorted({n for n in names if names.count(n) > 1})]
    problems += [f"unknown-column at /primary_key/{c}" for c in binding.primary_key if c not in known]
    problems += [f"unknown-target at /business_key/{c}" for c in binding.business_key if c not in names]
    if not binding.primary_key:
        problems.append("missing-primary-key at /primary_key")
    if (binding.mapping == "split") != (binding.where is not None) or binding.mapping not in ("direct", "split"):
        problems.append("split-filter at /where")
    for f in (*binding.fields, *binding.technical):
        try:
            typed = compile_expr(f.expression, known)
            if not compatible(typed.kind, f.kind):
                problems.append(f"type at /fields/{f.target}")
            elif typed.nullable and not f.nullable and all(n for _, n in known.values()) is False:
                problems.append(f"nullable at /fields/{f.target}")
        except ExpressionError as e:
            problems.append(f"{e.code} at /fields/{f.target}")
    if binding.where is not None:
        try:
            if compile_expr(binding.where, known).kind.name != "boolean":
                problems.append("type at /where")
        except ExpressionError as e:
            problems.append(f"{e.code} at /where")
    for r in binding.relationships:
        if r.parent not in parents:
            problems.append(f"unknown-parent at /relationships/{r.name}")
        elif r.foreign not in parents[r.parent].columns:
            problems.append(f"unknown-column at /relationships/{r.name}")
        if r.local not in names:
            problems.append(f"unknown-target at /relationships/{r.name}")
        if r.missing not in MISSING or r.ambiguous not in AMBIGUOUS:
            problems.append(f"policy at /relationships/{r.name}")
        if r.as_of and r.current:
            problems.append(f"temporal at /relationships/{r.name}")
    return problems


def mapped(binding: Binding, source: DataFrame) -> DataFrame:
    """Phase one: expressions under their target names, with the record key and lineage computed on the source."""
    known = columns_of(source)
    rows = source if binding.where is None else source.filter(compile_expr(binding.where, known).column)
    return rows.select(
        *[compile_expr(f.expression, known).column.cast(f.kind.spark).alias(f.target) for f in (*binding.fields, *binding.technical)],
        F.lit(binding.system).alias("_source_system"),
        source_record_key(binding.source, *[F.col(c) for c in binding.primary_key]).alias("_source_record_key"),
    )


def compile_binding(binding: Binding, source: DataFrame, parents: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The entity's accepted rows and its quarantine. Rows that a policy calls errors stop the run.

    The surrogate key comes from the business key, or from system and record key without one.
    """
    problems = validate(binding, source, parents)
    if problems:
        raise BindingError(problems)
    rows = mapped(binding, source)
    inputs = binding.business_key or ("_source_system", "_source_record_key")
    rows = rows.withColumn(f"{binding.model}_sk", surrogate_key(*[F.col(c) for c in inputs]))
    tracked = [(F.col(f.target), f.kind) for f in binding.fields if f.tracked and f.kind.name not in ("float64", "json")]
    rows = rows.withColumn("_row_hash", canonical_hash(tracked))
    grain, errors, apart = [f"{binding.model}_sk", "_source_record_key"], [], []
    for r in binding.relationships:
        count, key = match_count_name(r.property_uri), r.name
        pairs, bring = [(r.local, r.foreign)], {f"{r.parent}_sk": key}
        if r.as_of:
            rows = with_match_count(lookup(rows, parents[r.parent], pairs, bring, r.current, r.as_of), grain, key, count)
            rows = first_parent(rows, grain, [key])
        else:
            rows = counted_lookup(rows, parents[r.parent], pairs, bring, count, r.current)
        none, many = F.col(count) == 0, F.col(count) > 1
        fate = F.when(none, F.lit(r.missing)).when(many, F.lit(r.ambiguous)).otherwise(F.lit(""))
        rows = rows.withColumn(key, F.when(none & F.lit(r.missing == "null"), unknown_member(F.col(key))).otherwise(F.col(key)))
        errors.append(F.when(fate == "error", F.lit(r.name)))
        apart.append(F.when(fate == "quarantine", F.lit(r.name)))
    none = F.lit(None).cast("string")
    marked = rows.withColumn("_reason", F.coalesce(*apart, none))
    if any("error" in (r.missing, r.ambiguous) for r in binding.relationships):
        failed = marked.select(F.coalesce(*errors, none).alias("name")).filter("name is not null").first()
        if failed:
            raise RuntimeError(f"{binding.model}.{failed['name']}: parents are missing or ambiguous")
    return marked.filter("_reason is null").drop("_reason"), marked.filter("_reason is not null")


def without_columns(df: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """The columns whose names are not excluded, in any case of letters; a name that no column has is an error."""
    plain = {c.lower() for c in excluded}
    unknown = plain - {c.lower() for c in df.columns}
    if unknown:
        raise KeyError(", ".join(sorted(unknown)))
    return df.select(*[c for c in df.columns if c.lower() not in plain])


def guarded(source: DataFrame, allow_empty: bool = False) -> DataFrame:
    """The source; an empty one is an error unless the policy allows it."""
    if not allow_empty and source.isEmpty():
        raise ValueError("the source is empty")
    return source


class Registry:
    """Contracted models: callables ``fn(spark, inputs) -> DataFrame`` with a declared schema, built by name when asked for."""

    def __init__(self) -> None:
        self._models: dict[str, tuple[tuple[str, ...], object, str]] = {}

    def register(self, name: str, inputs: Sequence[str], build, schema: str) -> None:
        self._models[name] = (tuple(inputs), build, schema)

    def get(self, spark, name: str, sources: Mapping[str, DataFrame], above: tuple[str, ...] = ()) -> DataFrame:
        if name in sources:
            return sources[name]
        if name in above:
            raise ValueError("model cycle: " + " > ".join((*above, name)))
        if name not in self._models:
            raise KeyError(name)
        inputs, build, schema = self._models[name]
        out = build(spark, {n: self.get(spark, n, sources, (*above, name)) for n in inputs})
        declared = [(c.split()[0], c.split()[1]) for c in schema.split(", ")]
        if out.dtypes != declared:
            raise ValueError(f"{name} breaks its contract: {out.dtypes}")
        return out
