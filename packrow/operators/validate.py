"""Coercion and validation with collected errors, all as Columns.

A check is a rule on a codec: ``Compare``, ``Present``, ``OneOf``, ``Expr`` or a ``Callback`` that gives its own
errors. All errors of a record are gathered, each once, in order: types, requirements, checks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packrow.layout import Codec
from packrow.operators import access, predicates

ERRORS = "array<struct<code:string,field:string,detail:string>>"


def error(code: str, field: str, detail: str = "") -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), F.lit(detail).alias("detail"))


@dataclass(frozen=True)
class Compare:
    """``field op value``, or against another field with ``other``."""

    field: str
    op: str
    value: object = None
    other: str | None = None
    allow_null: bool | None = None
    name: str | None = None

    def uses(self) -> list[str]:
        return [self.field] + ([self.other] if self.other else [])

    def holds(self, codec: Codec, v: dict[str, Column]) -> Column:
        t = codec.field(self.field).type
        right = v[self.other] if self.other else F.lit(self.value).cast(t.spark)
        return predicates._holds(predicates.three_way(t.order(v[self.field]), t.order(right)), self.op)


@dataclass(frozen=True)
class Present:
    field: str
    name: str | None = None
    allow_null: bool = False

    def uses(self) -> list[str]:
        return [self.field]

    def holds(self, codec: Codec, v: dict[str, Column]) -> Column:
        return v[self.field].isNotNull()


@dataclass(frozen=True)
class OneOf:
    field: str
    values: tuple
    allow_null: bool | None = None
    name: str | None = None

    def uses(self) -> list[str]:
        return [self.field]

    def holds(self, codec: Codec, v: dict[str, Column]) -> Column:
        return v[self.field].isin(*self.values)


@dataclass(frozen=True)
class Expr:
    """An invariant over several fields: a function from their Columns to a boolean Column."""

    name: str
    fields: tuple[str, ...]
    rule: Callable[[dict[str, Column]], Column]
    allow_null: bool | None = None

    def uses(self) -> list[str]:
        return list(self.fields)

    def holds(self, codec: Codec, v: dict[str, Column]) -> Column:
        return self.rule(v)


@dataclass(frozen=True)
class Callback:
    """Errors of your own: a function from the fields' Columns to an error message Column, null where all is well."""

    name: str
    fields: tuple[str, ...]
    rule: Callable[[dict[str, Column]], Column]

    def uses(self) -> list[str]:
        return list(self.fields)


def invariant(name: str, fields: tuple[str, ...], rule: Callable[[dict[str, Column]], Column]) -> Expr:
    return Expr(name, fields, rule)


def _allows_null(codec: Codec, check) -> bool:
    """True unless every field the check names is required, where the check doesn't say itself."""
    if getattr(check, "allow_null", None) is not None:
        return check.allow_null
    return not all(codec.field(f).presence == "required" for f in check.uses())


def type_errors(codec: Codec, values: dict[str, Column]) -> list[Column]:
    """out_of_range, invalid_format or type_mismatch for values that can't be written; required_field for nulls."""
    out = []
    for f in codec.fields:
        if f.virtual or f.presence == "constant" or f.name not in values:
            continue
        v = values[f.name]
        kind = "invalid_format" if f.type.spark in ("string", "binary") else "out_of_range"
        out.append(F.when(v.isNotNull() & ~F.coalesce(f.type.check(v), F.lit(False)), error(kind, f.name)))
        if f.presence == "required" and f.default is None:
            out.append(F.when(v.isNull(), error("required_field", f.name)))
    return out


def check_errors(codec: Codec, values: dict[str, Column]) -> list[Column]:
    out = []
    for c in codec.checks:
        label = getattr(c, "name", None) or c.uses()[0]
        if isinstance(c, Callback):
            message = c.rule(values)
            out.append(F.when(message.isNotNull(), F.struct(F.lit("invariant_failed").alias("code"), F.lit(label).alias("field"), message.alias("detail"))))
            continue
        ok = F.coalesce(c.holds(codec, values), F.lit(False))
        if _allows_null(codec, c):
            for f in c.uses():
                ok = ok | values[f].isNull()
        code = {"Present": "required_field", "OneOf": "invariant_failed", "Compare": "invariant_failed", "Expr": "invariant_failed"}[type(c).__name__]
        out.append(F.when(~ok, error(code, label, type(c).__name__.lower())))
    return out


def errors(codec: Codec, values: dict[str, Column]) -> Column:
    """All errors of a record given as Columns, each once; empty where it is valid."""
    found = [*type_errors(codec, values), *check_errors(codec, values)]
    return F.array_distinct(F.array_compact(F.array(*found))).cast(ERRORS) if found else F.array().cast(ERRORS)


def validate_columns(codec: Codec, df: DataFrame, out: str = "errors") -> DataFrame:
    """``df``, whose columns are named as the fields, with its errors."""
    return df.withColumn(out, errors(codec, {f.name: F.col(f.name) for f in codec.fields if f.name in df.columns}))


def validate_binary(codec: Codec, b: Column, header: bool = True) -> Column:
    """Errors of encoded records: only checks that need no decoded whole (comparisons, presence, sets)."""
    values = {f.name: access.get(codec, b, f.name, header) for f in codec.fields}
    bare = [c for c in codec.checks if isinstance(c, Compare | Present | OneOf)]
    found = check_errors(_with(codec, bare), values)
    return F.array_distinct(F.array_compact(F.array(*found))).cast(ERRORS) if found else F.array().cast(ERRORS)


def _with(codec: Codec, checks: list) -> Codec:
    import dataclasses

    return dataclasses.replace(codec, checks=checks)


def is_valid(errors_column: str | Column = "errors") -> Column:
    return F.size(errors_column) == 0


def coerce(codec: Codec, df: DataFrame, out: str = "errors") -> DataFrame:
    """``df`` with its columns turned into the fields' types; what can't be is null and a cast_error.

    Columns may be strings or other types. Fields without a column are null. Then everything else is
    validated, so that ``errors`` holds all that is wrong with a row.
    """
    columns, failed = {}, []
    for f in codec.fields:
        if f.presence == "constant" or f.virtual:
            columns[f.name] = F.lit(f.value if f.presence == "constant" else f.default).cast(f.type.spark)
            continue
        given = F.col(f.name) if f.name in df.columns else F.lit(None).cast("string")
        turned = f.type.coerce(given)
        failed.append(F.when(given.isNotNull() & turned.isNull(), error("cast_error", f.name)))
        columns[f.name] = F.coalesce(turned, F.lit(f.default).cast(f.type.spark)) if f.default is not None else turned
    marked = df.withColumn("_failed", F.array_compact(F.array(*failed)).cast(ERRORS)).withColumns(columns)
    bad = F.transform("_failed", lambda e: e["field"])
    rest = F.filter(errors(codec, {f.name: F.col(f.name) for f in codec.fields}), lambda e: ~F.array_contains(bad, e["field"]))
    return marked.withColumn(out, F.array_distinct(F.concat("_failed", rest))).drop("_failed")


def update(codec: Codec, df: DataFrame, changes: dict[str, Column], out: str = "errors") -> DataFrame:
    """Fields replaced, then coerced and validated again."""
    return coerce(codec, df.withColumns(changes), out)


def new_binary(codec: Codec, df: DataFrame, keep: list[str] | None = None, out: str = "data") -> DataFrame:
    """Coerce, validate and encode: ``keep``, errors, and the record where there are none."""
    made = coerce(codec, df)
    values = {f.name: F.when(is_valid(), F.col(f.name)) for f in codec.fields}
    open_codec = _with(codec, codec.checks)
    record = access.encode_columns(_optional(open_codec), values)
    return made.select(*(keep or []), "errors", F.when(is_valid(), record).alias(out))


def _optional(codec: Codec) -> Codec:
    """The same layout without requirements, for rows whose errors are kept as data."""
    import dataclasses

    return dataclasses.replace(codec, fields=[dataclasses.replace(f, presence="optional") if f.presence == "required" else f for f in codec.fields], field_defaults={})
