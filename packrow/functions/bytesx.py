"""Column expressions over bytes: readers and writers of little- and big-endian numbers.

Positions are zero-based, Python ints or Columns. Readers of a place beyond the end give null.
Everything stays inside generated JVM code; nothing here is a Python UDF.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Place = int | Column
U64 = "decimal(20,0)"


def place(p: Place) -> Column:
    return F.lit(p) if isinstance(p, int) else p


def cut(b: Column, p: Place, n: Place) -> Column:
    """``n`` bytes from place ``p``, null where the value ends before."""
    p, n = place(p), place(n)
    return F.when(F.octet_length(b) >= p + n, F.substring(b, p + 1, n))


def tail(b: Column, p: Place) -> Column:
    """All bytes from place ``p`` on."""
    p = place(p)
    return F.when(F.octet_length(b) >= p, F.substring(b, p + 1, F.octet_length(b) - p))


def hex_big(b: Column, p: Place, n: int, endian: str = "little") -> Column:
    """``n`` bytes as hex digits, most significant byte first."""
    digits = F.hex(cut(b, p, n))
    if n == 1 or endian == "big":
        return digits
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n))])


def unsigned(b: Column, p: Place, n: int, endian: str = "little") -> Column:
    """An unsigned number of ``n`` bytes: bigint, for 8 bytes decimal(20,0)."""
    return F.conv(hex_big(b, p, n, endian), 16, 10).cast("bigint" if n < 8 else U64)


def signed(b: Column, p: Place, n: int, endian: str = "little") -> Column:
    """A signed number of ``n`` bytes as bigint."""
    if n == 8:
        return F.conv(hex_big(b, p, n, endian), 16, -10).cast("bigint")
    low = unsigned(b, p, n, endian)
    return F.when(low >= 1 << (8 * n - 1), low - (1 << (8 * n))).otherwise(low)


def double(b: Column, p: Place, endian: str = "little", size: int = 8) -> Column:
    """An IEEE number of 8 or 4 bytes, by exact arithmetic on its parts; NaN is null."""
    h = hex_big(b, p, size, endian)
    if size == 8:
        top, low = F.conv(F.substring(h, 1, 3), 16, 10).cast("int"), F.conv(F.substring(h, 4, 13), 16, 10).cast("bigint")
        bits, exponent, sign = 52, top % 2048, F.when(top >= 2048, -1.0).otherwise(1.0)
    else:
        whole = F.conv(h, 16, 10).cast("bigint")
        bits, exponent, sign, low = 23, (F.shiftright(whole, 23) % 256).cast("int"), F.when(whole >= 1 << 31, -1.0).otherwise(1.0), whole % (1 << 23)
    last, bias = (2047, 1075) if size == 8 else (255, 150)
    value = sign * F.when(exponent == 0, low * F.pow(F.lit(2.0), F.lit(1.0 - bias))).otherwise((low + (1 << bits)).cast("double") * F.pow(F.lit(2.0), (exponent - bias).cast("double")))
    special = F.when((exponent == last) & (low == 0), sign * F.lit(float("inf")))
    return F.when(exponent == last, special).otherwise(value).cast("double" if size == 8 else "float")


def number(value: Column, n: int, endian: str = "little", wide: bool = False) -> Column:
    """The bytes of an integer, two's complement; ``wide`` takes decimals up to 2^64 - 1."""
    wide = F.conv(value.cast("string"), 10, 16) if wide else F.hex(value.cast("bigint"))
    digits = F.right(F.concat(F.lit("0" * 16), wide), F.lit(2 * n))
    if endian == "little" and n > 1:
        digits = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n))])
    return F.unhex(digits)


def double_bytes(value: Column, endian: str = "little", size: int = 8) -> Column:
    """The bytes of an IEEE number; null gives null."""
    cls, method, kind, whole = ("Double", "doubleToRawLongBits", "double", "bigint") if size == 8 else ("Float", "floatToRawIntBits", "float", "int")
    given = F.coalesce(value, F.lit(0.0)).cast(kind)  # reflection can't take nulls
    bits = F.call_function("java_method", F.lit(f"java.lang.{cls}"), F.lit(method), given).cast(whole)
    return F.when(value.isNotNull(), number(bits, size, endian))


def let(value: Column, body) -> Column:
    """``body`` of a value computed once. Worth it inside lambdas, where common expressions aren't shared."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal(raw: bytes) -> Column:
    return F.lit(bytearray(raw))


def joined(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else literal(b"")


def dashed(b: Column) -> Column:
    """16 bytes as a lower-case UUID text."""
    h = F.lower(F.hex(b))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def undashed(text: Column) -> Column:
    """The 16 bytes of a UUID text with or without dashes, null where it is none."""
    h = F.regexp_replace(text, "-", "")
    return F.when(h.rlike("^[0-9a-fA-F]{32}$"), F.unhex(h))


def summed(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)
