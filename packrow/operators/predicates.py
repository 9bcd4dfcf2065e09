"""Filters on encoded records: compiled predicates and typed comparisons.

Four rules for null exist and stay apart: reading gives null (access.get), raw matching keeps the
sentinel (access.match_raw), ``compare`` puts null before everything, and ``where`` follows SQL unless
``null_order="term"`` asks for null after every number.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packrow.layout import Codec
from packrow.operators import access
from packrow.types import WireError

OPS = ("<", "<=", ">", ">=", "==", "!=")


class Fields:
    """The fields of a record by attribute or key; only those a predicate names are read."""

    def __init__(self, codec: Codec, b: Column, header: bool = True, null_order: str = "sql"):
        self._codec, self._b, self._header, self._null_order = codec, b, header, null_order

    def __getitem__(self, name: str) -> Column:
        if name not in {f.name for f in self._codec.fields}:
            raise WireError("unknown_field", f"{self._codec.name} has no field {name}")
        value = access.get(self._codec, self._b, name, self._header)
        if self._null_order == "term" and self._codec.field(name).type.spark in ("smallint", "int", "bigint", "decimal(20,0)"):
            return F.coalesce(value.cast("decimal(38,0)"), F.lit("9" * 38).cast("decimal(38,0)"))
        return value

    __getattr__ = __getitem__


Condition = Callable[[Fields], Column]


def matcher(codec: Codec, *conditions: Condition, select: list[str] | None = None, header: bool = True, null_order: str = "sql") -> Callable[[Column], Column]:
    """A function from a binary Column to a boolean one, or with ``select`` to a struct that is null where nothing matches.

    All conditions must hold. Bytes that are null or too short match nothing. Unknown fields fail here,
    when the plan is built. Bitwise operators are those of Columns (bitwiseAND, shiftright, ...).
    """
    if null_order not in ("sql", "term"):
        raise WireError("unknown_option", null_order)

    def run(b: Column) -> Column:
        fields = Fields(codec, b, header, null_order)
        long_enough = F.octet_length(b) >= codec.block_length + 8 * header if not header else F.octet_length(b) >= 8
        matched = F.coalesce(reduce(lambda x, y: x & y, [c(fields) for c in conditions], long_enough), F.lit(False))
        if select is None:
            return matched
        plain = Fields(codec, b, header)
        return F.when(matched, F.struct(*[plain[n].alias(n) for n in select]))

    run(F.lit(None).cast("binary"))
    return run


def where(df: DataFrame, codec: Codec, *conditions: Condition, column: str = "data", select: list[str] | None = None, keep: list[str] | None = None, header: bool = True, null_order: str = "sql") -> DataFrame:
    """The rows whose record matches; with ``select`` only ``keep`` and those fields."""
    rows = df.where(matcher(codec, *conditions, header=header, null_order=null_order)(F.col(column)))
    if select is None:
        return rows
    return rows.select(*(keep or []), *[access.get(codec, F.col(column), n, header).alias(n) for n in select])


def three_way(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null is before everything and equal to null."""
    return F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, -1).when(a > b, 1).otherwise(0)


def _holds(order: Column, op: str) -> Column:
    if op not in OPS:
        raise WireError("unknown_operator", op)
    return {"<": order < 0, "<=": order <= 0, ">": order > 0, ">=": order >= 0, "==": order == 0, "!=": order != 0}[op]


def compare(codec: Codec, b: Column, name: str, op: str, value, header: bool = True) -> Column:
    """A field against a value (None is the least); decimals by value, enums by number, times by instant."""
    t = codec.field(name).type
    other = value if isinstance(value, Column) else F.lit(value).cast(t.spark)
    return _holds(three_way(t.order(access.get(codec, b, name, header)), t.order(other)), op)


def compare_spec(b: Column, spec: tuple, op: str, value) -> Column:
    """The same by (type, place, byte order)."""
    kind, at, endian = spec
    other = value if isinstance(value, Column) else F.lit(value).cast(kind.spark)
    return _holds(three_way(kind.order(kind.read(b, at, endian)), kind.order(other)), op)


def compare_binaries(codec: Codec, left: Column, right: Column, name: str, op: str, header: bool = True) -> Column:
    """A field of one record against the same field of another."""
    t = codec.field(name).type
    return _holds(three_way(t.order(access.get(codec, left, name, header)), t.order(access.get(codec, right, name, header))), op)
