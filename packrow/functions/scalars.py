"""Scalar functions on the types' values: ids, times, decimals."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from packrow.functions import bytesx as bx
from packrow.types import Bitset, Enum, PrefixedId

#: Name spaces of version 5 ids, fixed by RFC 4122.
NAMESPACES = {"dns": uuid.NAMESPACE_DNS.bytes, "url": uuid.NAMESPACE_URL.bytes, "oid": uuid.NAMESPACE_OID.bytes, "x500": uuid.NAMESPACE_X500.bytes}


def uuid_v4() -> Column:
    return bx.undashed(F.uuid())


def _stamped(digits: Column, version: int) -> Column:
    """32 hex digits with the version and variant bits set."""
    variant = F.element_at(F.array(*[F.lit("89ab"[i % 4]) for i in range(16)]), F.conv(F.substring(digits, 17, 1), 16, 10).cast("int") + 1)
    return F.unhex(F.concat(F.substring(digits, 1, 12), F.lit(str(version)), F.substring(digits, 14, 3), variant, F.substring(digits, 18, 15)))


def uuid_v5(namespace: str | bytes, name: Column) -> Column:
    """The id of a name within a name space, by SHA-1."""
    space = NAMESPACES[namespace] if isinstance(namespace, str) else namespace
    return _stamped(F.sha1(F.concat(bx.literal(space), name.cast("binary"))), 5)


def uuid_v7(at: Column) -> Column:
    """A random id that sorts by its time, to the millisecond."""
    noise = F.regexp_replace(F.uuid(), "-", "")
    return _stamped(F.concat(F.lpad(F.lower(F.hex(F.unix_millis(at))), 12, "0"), F.substring(noise, 1, 20)), 7)


def uuid_v7_time(b: Column) -> Column:
    return F.timestamp_millis(bx.unsigned(b, 0, 6, "big"))


format_uuid = bx.dashed
parse_uuid = bx.undashed


def prefixed_generate(t: PrefixedId) -> Column:
    return F.concat(F.lit(t.prefix + "-"), F.uuid())


def prefixed_from_uuid(t: PrefixedId, b: Column) -> Column:
    return F.concat(F.lit(t.prefix + "-"), bx.dashed(b))


def prefixed_to_uuid(t: PrefixedId, text: Column) -> Column:
    return F.when(t.check(text), bx.undashed(F.substring(text, len(t.prefix) + 2, 36)))


def prefixed_valid(t: PrefixedId, text: Column) -> Column:
    return F.coalesce(t.check(text), F.lit(False))


def micros_to_time(n: Column) -> Column:
    return F.timestamp_micros(n)


def nanos_to_time(n: Column) -> Column:
    return F.timestamp_micros(F.floor(n.cast("decimal(19,0)") / 1000).cast("bigint"))


def time_to_micros(t: Column) -> Column:
    return F.unix_micros(t)


def iso_to_micros(text: Column) -> Column:
    return F.unix_micros(F.try_to_timestamp(text))


def decimal_of_float(value: Column, places: int = 8) -> Column:
    """A float rounded to some places; NaN and infinities are null."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.round(value.cast(f"decimal(38,{places + 2})"), places).cast(f"decimal(38,{places})"))


def enum_number(t: Enum, name: Column) -> Column:
    return t.number_of(name)


def enum_name(t: Enum, number: Column) -> Column:
    return t.named(number)


def flags_of(t: Bitset, number: Column) -> Column:
    return F.array_compact(F.array(*[F.when(t.has(number, k), F.lit(k)) for k in t.flags]))


def flag_map(t: Bitset, number: Column) -> Column:
    return F.create_map(*[x for k in t.flags for x in (F.lit(k), t.has(number, k))])


def flags_number(t: Bitset, names: Column) -> Column:
    return bx.summed([F.when(F.array_contains(names, k), F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint") for k, bit in t.flags.items()])
