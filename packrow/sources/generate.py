"""Random rows for tests: a Column for each type, and tables for codecs and schemas. Seeded, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packrow.functions import bytesx as bx
from packrow.layout import Codec, Group
from packrow.types import Bitset, Bool, CharArray, Datetime, Decimal, Enum, Float, Int, PrefixedId, Refined, Scaled, Text, Timestamp, Uuid, WireError, WireType

NULL_SHARE = 0.1


def _digits(seed: int) -> Column:
    return F.concat(*[F.lpad(F.hex((F.rand(seed * 8 + k) * (1 << 32)).cast("bigint")), 8, "0") for k in range(4)])


def for_type(t: WireType, seed: int = 0, nulls: float = NULL_SHARE) -> Column:
    """A Column of random values of a type; a share of them null. Values never equal the type's sentinel."""
    u = F.rand(seed)
    if isinstance(t, Refined):
        return for_type(t.base, seed, nulls)
    if isinstance(t, Int):
        low, high = (t.low + 1, t.high) if t.is_signed else (t.low, t.high - 1)
        low, high = max(low, -(1 << 53)), min(high, 1 << 53)
        value = (u * (high - low) + low).cast("bigint").cast(t.spark)
    elif isinstance(t, Float):
        value = ((u - 0.5) * 1e6).cast(t.spark)
    elif isinstance(t, Bool):
        value = u < 0.5
    elif isinstance(t, Uuid):
        value = bx.dashed(F.unhex(_digits(seed))) if t.text else F.unhex(_digits(seed))
    elif isinstance(t, Decimal | Scaled):
        value = F.round((u * (1 if getattr(t, "positive", False) or t.name.startswith("positive") else 2) * 1e6 - (0 if t.name.startswith("positive") else 1e6)).cast("decimal(20,2)"), 2).cast(t.spark)
    elif isinstance(t, Datetime):
        value = F.timestamp_micros((u * 1.7e15).cast("bigint") + 1)
    elif isinstance(t, Timestamp):
        value = (u * 1.7e15).cast("bigint") + 1
    elif isinstance(t, Text):
        value = F.substring(F.concat(F.lit("é"), _digits(seed)), 1, 1 + (u * 30).cast("int"))
    elif isinstance(t, Enum):
        value = F.element_at(F.array(*map(F.lit, t.values)), 1 + (u * len(t.values)).cast("int"))
    elif isinstance(t, Bitset):
        return F.array_compact(F.array(*[F.when(F.rand(seed * 97 + i) < 0.5, F.lit(k)) for i, k in enumerate(t.flags)]))
    elif isinstance(t, PrefixedId):
        value = F.concat(F.lit(t.prefix + "-"), bx.dashed(F.unhex(_digits(seed))))
    elif isinstance(t, CharArray):
        return F.substring(_digits(seed), 1, (u * min(t.size, 32)).cast("int"))
    else:
        raise WireError("unknown_type", t.name)
    return F.when(F.rand(seed + 7_919) >= nulls, value) if nulls else value


def group_entries(g: Group, seed: int = 0, most: int = 4) -> Column:
    """An array of at most ``most`` entries of a group."""
    one = lambda i: for_type(g.of, seed + i, 0) if g.is_scalar else F.struct(*[for_type(f.type, seed + 31 * i + k, 0 if f.presence == "required" else NULL_SHARE).alias(f.name) for k, f in enumerate(g.fields)])
    return F.slice(F.array(*[one(i) for i in range(most)]), F.lit(1), (F.rand(seed + 13) * (most + 1)).cast("int"))


def for_codec(spark: SparkSession, codec: Codec, rows: int, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """``rows`` random rows named as the codec's fields and groups; constants hold their value."""
    columns = []
    for k, f in enumerate(codec.fields):
        if f.virtual:
            continue
        value = F.lit(f.value).cast(f.type.spark) if f.presence == "constant" else for_type(f.type, seed * 1009 + k * 17, 0 if f.presence == "required" else NULL_SHARE)
        columns.append(value.alias(f.name))
    columns += [group_entries(g, seed * 1009 + 500 + 50 * k).alias(g.name) for k, g in enumerate(codec.groups)]
    return spark.range(0, rows, 1, partitions or 4).select(F.col("id").alias("_row"), *columns)
