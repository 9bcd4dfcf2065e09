"""Wire types: how one value is laid out, read and written.

Every type knows its Column reader and writer (JVM-side), its scalar packer and unpacker (for layouts
that must be walked), and, where it has one, its numpy form for whole batches. Null is a sentinel
value on the wire; each type's ``null`` bytes are that sentinel, and a value equal to it reads as null.
"""

from __future__ import annotations

import datetime as dt
import decimal
import struct
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from packrow.functions import bytesx as bx

EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
_INT = {"u8": "B", "u16": "H", "u32": "I", "u64": "Q", "i8": "b", "i16": "h", "i32": "i", "i64": "q"}
_MINUS_63 = -(1 << 63)


class WireError(ValueError):
    """A value or a layout that doesn't fit: ``code`` is short and stable, ``detail`` is for people."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code, self.detail = code, detail


class WireType:
    """Base of all types; subclass it for a type of your own.

    ``size`` is None for a type with a length prefix. ``numpy`` is a dtype code without byte order, or None.
    """

    name = ""
    size: int | None = 0
    align = 1
    spark = "binary"
    numpy: str | None = None

    def null(self, endian: str = "little") -> bytes:
        raise NotImplementedError

    def pack(self, value, endian: str = "little") -> bytes:
        """Bytes of a value; None gives the sentinel."""
        raise NotImplementedError

    def unpack(self, buf: bytes, at: int, endian: str = "little"):
        raise NotImplementedError

    def raw(self, b: Column, p: bx.Place, endian: str = "little") -> Column:
        """The wire value, sentinel and all."""
        raise NotImplementedError

    def read(self, b: Column, p: bx.Place, endian: str = "little") -> Column:
        """The domain value, null for the sentinel and beyond the end."""
        raise NotImplementedError

    def write(self, value: Column, endian: str = "little") -> Column:
        raise NotImplementedError

    def order(self, value: Column) -> Column:
        """What comparisons use; by default the value itself."""
        return value

    def is_null(self, b: Column, p: bx.Place, endian: str = "little") -> Column:
        return bx.cut(b, p, self.size) == bx.literal(self.null(endian))

    def check(self, value: Column) -> Column:
        """Whether a non-null value can be written."""
        return F.lit(True)

    def coerce(self, value: Column) -> Column:
        """A value of another Spark type turned into this one's, null where it can't be."""
        return value.try_cast(self.spark)

    def __repr__(self) -> str:
        return self.name


class Int(WireType):
    """u8 to u64 and i8 to i64. Unsigned null is all ones, signed null the least value."""

    def __init__(self, name: str):
        self.name, self.fmt = name, _INT[name]
        self.size = self.align = struct.calcsize("<" + self.fmt)
        self.bits, self.is_signed = 8 * self.size, name[0] == "i"
        self.low = -(1 << (self.bits - 1)) if self.is_signed else 0
        self.high = (1 << (self.bits - self.is_signed)) - 1
        self.sentinel = self.low if self.is_signed else self.high
        self.spark = {"u8": "smallint", "u16": "int", "u32": "bigint", "u64": bx.U64, "i8": "smallint", "i16": "int", "i32": "int", "i64": "bigint"}[name]
        self.numpy = ("i" if self.is_signed else "u") + str(self.size)

    def null(self, endian="little"):
        return self.sentinel.to_bytes(self.size, endian, signed=self.is_signed)

    def pack(self, value, endian="little"):
        value = self.sentinel if value is None else int(value)
        if not self.low <= value <= self.high:
            raise WireError("out_of_range", f"{value} isn't a {self.name}")
        return value.to_bytes(self.size, endian, signed=self.is_signed)

    def unpack(self, buf, at, endian="little"):
        value = int.from_bytes(buf[at : at + self.size], endian, signed=self.is_signed)
        return None if value == self.sentinel else value

    def raw(self, b, p, endian="little"):
        return (bx.signed if self.is_signed else bx.unsigned)(b, p, self.size, endian)

    def read(self, b, p, endian="little"):
        value = self.raw(b, p, endian)
        return F.when(value != F.lit(decimal.Decimal(self.sentinel) if self.name == "u64" else self.sentinel), value.cast(self.spark))

    def write(self, value, endian="little"):
        big = self.name == "u64"
        typed = value.cast(bx.U64 if big else "bigint")
        return F.coalesce(bx.number(typed, self.size, endian, big), bx.literal(self.null(endian)))

    def check(self, value):
        wide = value.cast("decimal(38,0)")
        return (wide >= F.lit(decimal.Decimal(self.low))) & (wide <= F.lit(decimal.Decimal(self.high)))

    def coerce(self, value):
        wide = value.try_cast("decimal(38,0)")
        return F.when(self.check(wide) & (value.try_cast("decimal(38,10)") == wide), wide.try_cast(self.spark))


class Float(WireType):
    """f32 and f64; NaN reads as null and null is written as NaN."""

    def __init__(self, size: int):
        self.size = self.align = size
        self.name, self.spark, self.numpy = f"f{8 * size}", "double" if size == 8 else "float", f"f{size}"

    def null(self, endian="little"):
        return self.pack(float("nan"), endian)

    def pack(self, value, endian="little"):
        return struct.pack(("<" if endian == "little" else ">") + ("d" if self.size == 8 else "f"), float("nan") if value is None else value)

    def unpack(self, buf, at, endian="little"):
        (value,) = struct.unpack_from(("<" if endian == "little" else ">") + ("d" if self.size == 8 else "f"), buf, at)
        return None if value != value else value

    def raw(self, b, p, endian="little"):
        return self.read(b, p, endian)

    def read(self, b, p, endian="little"):
        return bx.double(b, p, endian, self.size)

    def write(self, value, endian="little"):
        return F.coalesce(bx.double_bytes(value, endian, self.size), bx.literal(self.null(endian)))

    def is_null(self, b, p, endian="little"):
        return self.read(b, p, endian).isNull()


class Bool(WireType):
    name, size, align, spark, numpy = "bool", 1, 1, "boolean", "u1"

    def null(self, endian="little"):
        return b"\xff"

    def pack(self, value, endian="little"):
        return b"\xff" if value is None else b"\x01" if value else b"\x00"

    def unpack(self, buf, at, endian="little"):
        return None if buf[at] == 255 else buf[at] != 0

    def raw(self, b, p, endian="little"):
        return bx.unsigned(b, p, 1)

    def read(self, b, p, endian="little"):
        value = self.raw(b, p)
        return F.when(value != 255, value != 0)

    def write(self, value, endian="little"):
        return F.when(value.isNull(), bx.literal(b"\xff")).when(value, bx.literal(b"\x01")).otherwise(bx.literal(b"\x00"))

    def coerce(self, value):
        text = F.lower(value.cast("string"))
        return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))


class Uuid(WireType):
    """16 raw bytes, or their dashed text (``uuid_string``); all zero is null."""

    size = 16

    def __init__(self, text: bool = False):
        self.text, self.name, self.spark = text, "uuid_string" if text else "uuid", "string" if text else "binary"

    def null(self, endian="little"):
        return bytes(16)

    def pack(self, value, endian="little"):
        if value is None:
            return bytes(16)
        try:
            raw = uuid.UUID(value).bytes if isinstance(value, str) else bytes(value)
        except ValueError as e:
            raise WireError("invalid_format", str(e)) from None
        if len(raw) != 16:
            raise WireError("invalid_format", f"{len(raw)} bytes aren't a uuid")
        return raw

    def unpack(self, buf, at, endian="little"):
        raw = bytes(buf[at : at + 16])
        return None if raw == bytes(16) else str(uuid.UUID(bytes=raw)) if self.text else raw

    def raw(self, b, p, endian="little"):
        return bx.cut(b, p, 16)

    def read(self, b, p, endian="little"):
        value = self.raw(b, p)
        return F.when(value != bx.literal(bytes(16)), bx.dashed(value) if self.text else value)

    def write(self, value, endian="little"):
        return F.coalesce(bx.undashed(value) if self.text else value, bx.literal(bytes(16)))

    def check(self, value):
        return bx.undashed(value).isNotNull() if self.text else F.octet_length(value) == 16

    def coerce(self, value):
        return F.when(bx.undashed(value.cast("string")).isNotNull(), bx.dashed(bx.undashed(value.cast("string")))) if self.text else F.coalesce(bx.undashed(value.cast("string")), F.when(F.octet_length(value.cast("binary")) == 16, value.cast("binary")))


class Decimal(WireType):
    """A mantissa of 8 bytes times ten to an exponent of 1 byte; read at ``scale`` digits."""

    size, align = 9, 8

    def __init__(self, positive: bool = False, scale: int = 8):
        self.name, self.positive, self.scale = "positive_decimal" if positive else "decimal", positive, scale
        self.spark = f"decimal(38,{scale})"

    def null(self, endian="little"):
        return _MINUS_63.to_bytes(8, "little", signed=True) + b"\0"

    def pack(self, value, endian="little"):
        if value is None:
            return self.null()
        sign, digits, exponent = decimal.Decimal(str(value) if isinstance(value, float) else value).as_tuple()
        mantissa = int("".join(map(str, digits)) or 0) * (-1 if sign else 1)
        if self.positive and mantissa < 0 or not -128 <= exponent <= 127 or not _MINUS_63 < mantissa < 1 << 63:
            raise WireError("out_of_range", f"{value} isn't a {self.name}")
        return mantissa.to_bytes(8, "little", signed=True) + exponent.to_bytes(1, "little", signed=True)

    def unpack(self, buf, at, endian="little"):
        mantissa, exponent = struct.unpack_from("<qb", buf, at)
        return None if mantissa == _MINUS_63 else decimal.Decimal(mantissa).scaleb(exponent)

    def parts(self, b, p) -> tuple[Column, Column]:
        return bx.signed(b, p, 8), bx.signed(b, bx.place(p) + 8, 1)

    def raw(self, b, p, endian="little"):
        return self.parts(b, p)[0]

    def read(self, b, p, endian="little"):
        mantissa, exponent = self.parts(b, p)
        unit = F.element_at(F.array(*[F.lit(decimal.Decimal(1).scaleb(-k)).cast(f"decimal({self.scale + 10},{self.scale})") for k in range(self.scale, -10, -1)]), (exponent + self.scale + 1).cast("int"))
        inside = (exponent >= -self.scale) & (exponent < 10)
        return F.when((mantissa != _MINUS_63) & inside, (mantissa.cast("decimal(19,0)") * F.when(inside, unit)).cast(self.spark))

    def write(self, value, endian="little"):
        typed = value.cast(f"decimal(38,{self.scale})")
        mantissa = (typed * F.lit(10**self.scale)).cast("bigint")
        return F.when(value.isNull(), bx.literal(self.null())).otherwise(F.concat(bx.number(mantissa, 8), bx.literal((-self.scale).to_bytes(1, "little", signed=True))))

    def check(self, value):
        return value >= 0 if self.positive else F.lit(True)

    def is_null(self, b, p, endian="little"):
        return self.parts(b, p)[0] == _MINUS_63


class Scaled(WireType):
    """A decimal as a plain 8-byte integer at a fixed scale (i64, or u64 where it can't be negative)."""

    size = align = 8

    def __init__(self, scale: int, positive: bool = False):
        self.inner, self.scale = Int("u64" if positive else "i64"), scale
        self.name, self.spark = f"{'positive_' * positive}decimal({scale})", f"decimal(38,{scale})"

    def null(self, endian="little"):
        return self.inner.null(endian)

    def pack(self, value, endian="little"):
        if value is None:
            return self.null(endian)
        whole = decimal.Decimal(str(value) if isinstance(value, float) else value).scaleb(self.scale)
        if whole != whole.to_integral_value():
            raise WireError("invalid_format", f"{value} has more than {self.scale} digits")
        return self.inner.pack(int(whole), endian)

    def unpack(self, buf, at, endian="little"):
        value = self.inner.unpack(buf, at, endian)
        return None if value is None else decimal.Decimal(value).scaleb(-self.scale)

    def raw(self, b, p, endian="little"):
        return self.inner.raw(b, p, endian)

    def read(self, b, p, endian="little"):
        return (self.inner.read(b, p, endian).cast("decimal(20,0)") * F.lit(decimal.Decimal(1).scaleb(-self.scale))).cast(self.spark)

    def write(self, value, endian="little"):
        return self.inner.write((value.cast(f"decimal(38,{self.scale})") * F.lit(10**self.scale)).cast("decimal(20,0)"), endian)


class Timestamp(WireType):
    """Microseconds or nanoseconds since 1970, as a number; 0 is null. Always little-endian."""

    size = align = 8
    spark = "bigint"

    def __init__(self, unit: str):
        self.unit, self.name, self.numpy = unit, f"timestamp_{unit}", "i8"

    def null(self, endian="little"):
        return bytes(8)

    def _number(self, value) -> int:
        return int(value)

    def pack(self, value, endian="little"):
        return (0 if value is None else self._number(value)).to_bytes(8, "little", signed=True)

    def unpack(self, buf, at, endian="little"):
        value = int.from_bytes(buf[at : at + 8], "little", signed=True)
        return value or None

    def raw(self, b, p, endian="little"):
        return bx.signed(b, p, 8)

    def read(self, b, p, endian="little"):
        return F.nullif(self.raw(b, p), F.lit(0).cast("bigint"))

    def write(self, value, endian="little"):
        return bx.number(F.coalesce(value.cast("bigint"), F.lit(0)), 8)


class Datetime(Timestamp):
    """The same bytes as a point in time. Nanoseconds must be whole microseconds to be written and lose the rest when read."""

    spark = "timestamp"

    def __init__(self, unit: str):
        super().__init__(unit)
        self.name, self.factor, self.numpy = f"datetime_{unit}", 1 if unit == "us" else 1000, None

    def _number(self, value) -> int:
        if isinstance(value, dt.datetime):
            value = value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)
            return (value - EPOCH) // dt.timedelta(microseconds=1) * self.factor
        if value % self.factor:
            raise WireError("invalid_format", "nanoseconds must be whole microseconds")
        return int(value)

    def unpack(self, buf, at, endian="little"):
        value = super().unpack(buf, at)
        return None if value is None else EPOCH + dt.timedelta(microseconds=value // self.factor)

    def read(self, b, p, endian="little"):
        value = super().read(b, p)
        return F.timestamp_micros(value if self.factor == 1 else F.floor(value.cast("decimal(19,0)") / self.factor).cast("bigint"))

    def write(self, value, endian="little"):
        return super().write(F.unix_micros(value.cast("timestamp")) * self.factor)

    def coerce(self, value):
        return value.try_cast("timestamp")


class Text(WireType):
    """UTF-8 with a little-endian length of 1, 2 or 4 bytes before it; length 0 is null."""

    size, spark = None, "string"

    def __init__(self, prefix: int):
        self.prefix, self.name = prefix, {1: "string8", 2: "string16", 4: "string32"}[prefix]

    def null(self, endian="little"):
        return bytes(self.prefix)

    def pack(self, value, endian="little"):
        raw = (value or "").encode() if not isinstance(value, bytes) else value
        if len(raw) >= 1 << (8 * self.prefix):
            raise WireError("out_of_range", f"{len(raw)} bytes don't fit a {self.name}")
        return len(raw).to_bytes(self.prefix, "little") + raw

    def take(self, buf: bytes, at: int) -> tuple[str | None, int]:
        """The value at a place and the place behind it."""
        n = int.from_bytes(buf[at : at + self.prefix], "little")
        end = at + self.prefix + n
        if at + self.prefix > len(buf) or end > len(buf):
            raise WireError("string_too_short", f"{self.name} at {at} needs {end} of {len(buf)} bytes")
        return buf[at + self.prefix : end].decode("utf-8", "replace") if n else None, end

    def unpack(self, buf, at, endian="little"):
        return self.take(buf, at)[0]

    def raw(self, b, p, endian="little"):
        return bx.cut(b, bx.place(p) + self.prefix, bx.unsigned(b, p, self.prefix).cast("int"))

    def read(self, b, p, endian="little"):
        n = bx.unsigned(b, p, self.prefix)
        return F.when(n > 0, F.decode(self.raw(b, p), "UTF-8"))

    def behind(self, b: Column, p: Column) -> Column:
        """The place behind the value."""
        return bx.place(p) + self.prefix + bx.unsigned(b, p, self.prefix).cast("int")

    def write(self, value, endian="little"):
        raw = F.coalesce(value.cast("binary"), bx.literal(b""))
        return F.concat(bx.number(F.octet_length(raw), self.prefix), raw)

    def check(self, value):
        return F.octet_length(value.cast("binary")) < (1 << (8 * self.prefix))


class Enum(WireType):
    """Names for numbers of 1, 2 or 4 bytes; all ones is null. A number without a name reads as its digits."""

    spark = "string"

    def __init__(self, name: str, values: dict[str, int] | list[str], base: str = "u8"):
        self.inner, self.name = Int(base), name
        self.values = dict(values) if isinstance(values, dict) else {v: i for i, v in enumerate(values)}
        self.names = {v: k for k, v in self.values.items()}
        self.size = self.align = self.inner.size

    def null(self, endian="little"):
        return self.inner.null(endian)

    def pack(self, value, endian="little"):
        if isinstance(value, str):
            if value not in self.values:
                if not value.isdigit():
                    raise WireError("cast_error", f"{self.name} has no {value}")
                return self.inner.pack(int(value), endian)
            value = self.values[value]
        return self.inner.pack(value, endian)

    def unpack(self, buf, at, endian="little"):
        value = self.inner.unpack(buf, at, endian)
        return None if value is None else self.names.get(value, str(value))

    def raw(self, b, p, endian="little"):
        return self.inner.raw(b, p, endian)

    def named(self, number: Column) -> Column:
        """The name of a number, null for one without."""
        table = F.create_map(*[F.lit(x) for k, v in self.values.items() for x in (v, k)])
        return F.element_at(table, number.cast("int"))

    def number_of(self, value: Column) -> Column:
        table = F.create_map(*[F.lit(x) for k, v in self.values.items() for x in (k, v)])
        return F.coalesce(F.element_at(table, value), value.try_cast("int")).cast("bigint")

    def read(self, b, p, endian="little"):
        number = self.raw(b, p, endian)
        return F.when(number != self.inner.sentinel, F.coalesce(self.named(number), number.cast("string")))

    def write(self, value, endian="little"):
        return self.inner.write(self.number_of(value), endian)

    def order(self, value):
        return self.number_of(value)

    def check(self, value):
        return value.isin(*self.values)


class Bitset(WireType):
    """Flags by bit number in 1 to 8 bytes; null is the empty set and reading never gives null."""

    spark = "array<string>"

    def __init__(self, name: str, flags: dict[str, int], base: str = "u8"):
        self.inner, self.name, self.flags = Int(base), name, dict(sorted(flags.items(), key=lambda x: x[1]))
        self.size = self.align = self.inner.size

    def null(self, endian="little"):
        return bytes(self.size)

    def to_integer(self, names) -> int:
        if unknown := [x for x in names if x not in self.flags]:
            raise WireError("cast_error", f"{self.name} has no {unknown[0]}")
        return sum(1 << self.flags[x] for x in set(names))

    def from_integer(self, number: int) -> list[str]:
        return [k for k, bit in self.flags.items() if number >> bit & 1]

    def pack(self, value, endian="little"):
        number = value if isinstance(value, int) else self.to_integer(value or [])
        return number.to_bytes(self.size, endian)

    def unpack(self, buf, at, endian="little"):
        return self.from_integer(int.from_bytes(buf[at : at + self.size], endian))

    def raw(self, b, p, endian="little"):
        return bx.signed(b, p, 8, endian) if self.size == 8 else bx.unsigned(b, p, self.size, endian)

    def has(self, number: Column, flag: str) -> Column:
        return F.bit_get(number, F.lit(self.flags[flag])) == 1

    def read(self, b, p, endian="little"):
        number = self.raw(b, p, endian)
        return F.when(number.isNotNull(), F.array_compact(F.array(*[F.when(self.has(number, k), F.lit(k)) for k in self.flags])))

    def write(self, value, endian="little"):
        number = bx.summed([F.when(F.array_contains(value, k), F.lit(1 << bit)).otherwise(F.lit(0)).cast(bx.U64) for k, bit in self.flags.items()])
        return bx.number(F.coalesce(number, F.lit(0).cast(bx.U64)), self.size, endian, True)

    def check(self, value):
        return F.size(F.array_except(value, F.array(*map(F.lit, self.flags)))) == 0

    def is_null(self, b, p, endian="little"):
        return F.lit(False)


class PrefixedId(WireType):
    """A tag byte and a UUID, read as ``prefix-uuid``; all zero is null and tag 0 is reserved."""

    size, spark = 17, "string"

    def __init__(self, prefix: str, tag: int):
        if not 1 <= tag <= 255:
            raise WireError("out_of_range", "tags are 1 to 255")
        self.prefix, self.tag, self.name = prefix, tag, f"prefixed_id({prefix})"

    def null(self, endian="little"):
        return bytes(17)

    def from_uuid(self, raw: bytes) -> str:
        return f"{self.prefix}-{uuid.UUID(bytes=raw)}"

    def to_uuid(self, text: str) -> bytes:
        if not text.startswith(self.prefix + "-"):
            raise WireError("invalid_format", f"{text} isn't a {self.prefix} id")
        return uuid.UUID(text[len(self.prefix) + 1 :]).bytes

    def pack(self, value, endian="little"):
        return bytes(17) if value is None else bytes([self.tag]) + (self.to_uuid(value) if isinstance(value, str) else bytes(value))

    def unpack(self, buf, at, endian="little"):
        raw = bytes(buf[at : at + 17])
        return None if raw == bytes(17) else self.from_uuid(raw[1:])

    def raw(self, b, p, endian="little"):
        return bx.cut(b, p, 17)

    def read(self, b, p, endian="little"):
        value = self.raw(b, p)
        return F.when(value != bx.literal(bytes(17)), F.concat(F.lit(self.prefix + "-"), bx.dashed(F.substring(value, 2, 16))))

    def write(self, value, endian="little"):
        raw = bx.undashed(F.substring(value, len(self.prefix) + 2, 36))
        return F.coalesce(F.concat(bx.literal(bytes([self.tag])), raw), bx.literal(bytes(17)))

    def check(self, value):
        return value.startswith(self.prefix + "-") & bx.undashed(F.substring(value, len(self.prefix) + 2, 36)).isNotNull()


class CharArray(WireType):
    """N bytes, text up to the first zero byte; null and the empty text are all zero, and both read as the empty text."""

    spark = "string"

    def __init__(self, length: int, on_overflow: str = "truncate"):
        self.size, self.on_overflow, self.name = length, on_overflow, f"char_array({length})"

    def null(self, endian="little"):
        return bytes(self.size)

    def pack(self, value, endian="little"):
        raw = (value or "").encode()
        if len(raw) > self.size and self.on_overflow == "error":
            raise WireError("out_of_range", f"{len(raw)} bytes don't fit a {self.name}")
        return raw[: self.size].ljust(self.size, b"\0")

    def unpack(self, buf, at, endian="little"):
        return bytes(buf[at : at + self.size]).split(b"\0", 1)[0].decode("utf-8", "replace")

    def raw(self, b, p, endian="little"):
        return bx.cut(b, p, self.size)

    def read(self, b, p, endian="little"):
        return F.substring_index(F.decode(self.raw(b, p), "UTF-8"), "\0", 1)

    def write(self, value, endian="little"):
        raw = F.substring(F.coalesce(value.cast("binary"), bx.literal(b"")), 1, self.size)
        return F.substring(F.concat(raw, bx.literal(bytes(self.size))), 1, self.size)

    def check(self, value):
        return F.octet_length(value.cast("binary")) <= self.size if self.on_overflow == "error" else F.lit(True)

    def is_null(self, b, p, endian="little"):
        return F.lit(False)


class Refined(WireType):
    """A base type with a rule: a function from a value's Column to a boolean Column."""

    def __init__(self, name: str, base: WireType, rule):
        self.base, self.rule, self.name = base, rule, name
        self.size, self.align, self.spark, self.numpy = base.size, base.align, base.spark, base.numpy

    def __getattr__(self, item):
        return getattr(self.base, item)

    def null(self, endian="little"):
        return self.base.null(endian)

    def pack(self, value, endian="little"):
        return self.base.pack(value, endian)

    def unpack(self, buf, at, endian="little"):
        return self.base.unpack(buf, at, endian)

    def raw(self, b, p, endian="little"):
        return self.base.raw(b, p, endian)

    def read(self, b, p, endian="little"):
        return self.base.read(b, p, endian)

    def write(self, value, endian="little"):
        return self.base.write(value, endian)

    def check(self, value):
        return self.base.check(value) & self.rule(value)

    def coerce(self, value):
        return self.base.coerce(value)

    def order(self, value):
        return self.base.order(value)


@dataclass(frozen=True)
class Builtin:
    """Types by name."""

    def __call__(self, name: str) -> WireType:
        if name not in _BUILTIN:
            raise WireError("unknown_type", name)
        return _BUILTIN[name]


_BUILTIN: dict[str, WireType] = {n: Int(n) for n in _INT} | {"f32": Float(4), "f64": Float(8), "bool": Bool(), "uuid": Uuid(), "uuid_string": Uuid(True), "decimal": Decimal(), "positive_decimal": Decimal(True), "string8": Text(1), "string": Text(2), "string16": Text(2), "string32": Text(4)}
for _u in ("us", "ns"):
    _BUILTIN[f"timestamp_{_u}"], _BUILTIN[f"datetime_{_u}"] = Timestamp(_u), Datetime(_u)
builtin = Builtin()


def typed(spec) -> WireType:
    """A type from its name or itself."""
    return spec if isinstance(spec, WireType) else builtin(spec)


def padding_for(offset: int, align: int) -> int:
    return -offset % align


def align(offset: int, to: int) -> int:
    return offset + padding_for(offset, to)


def dtype_of(t: WireType, endian: str) -> np.dtype:
    """The numpy type of a field: a number where it has one, else its bytes."""
    if t.numpy:
        return np.dtype(("<" if endian == "little" or isinstance(t, Timestamp) else ">") + t.numpy)
    return np.dtype(f"V{t.size}")
