"""Groups, batches and lookups.

Fixed groups and padded batches are read by arithmetic on their header, in generated code. Decoded
arrays are plain arrays of structs: map, reduce and filter are Spark's own higher-order functions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packrow.functions import bytesx as bx
from packrow.layout import MAX_GROUP_ENTRIES, Batch, Codec, Group
from packrow.operators import access
from packrow.types import WireError

# -- groups straight from the bytes ------------------------------------------------------------------------------------


def group_header(b: Column, at: Column | int) -> tuple[Column, Column]:
    """(entry size, entries)."""
    at = bx.place(at)
    return bx.unsigned(b, at, 2).cast("int"), bx.unsigned(b, at + 2, 2).cast("int")


def _headed(b: Column, at: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of struct(at, size, n) of the group at a place, each computed once."""
    return bx.let(at, lambda x: bx.let(F.struct(x.alias("at"), *[c.alias(k) for k, c in zip(("size", "n"), group_header(b, x), strict=True)]), body))


def group_count(codec: Codec, b: Column, name: str, header: bool = True) -> Column:
    """Entries of a group, from its header alone."""
    g, at = codec.group(name), access.group_place(codec, b, name, header)
    return bx.unsigned(b, at, 4).cast("int") if g.framed else group_header(b, at)[1]


def _entry(g: Group, raw: Column) -> Column:
    """A struct (or scalar) from an entry's bytes, padded with nulls where an old writer knew fewer fields."""
    null = bx.literal(g.entry.null_block)
    n = g.entry.block_length
    whole = F.when(F.octet_length(raw) >= n, raw).otherwise(F.concat(raw, F.substring(null, F.octet_length(raw) + 1, n)))
    fields = [access.get(g.entry, whole, f.name, header=False).alias(f.name) for f in g.entry.fixed]
    return fields[0] if g.is_scalar else F.struct(*fields)


def group_entries(codec: Codec, b: Column, name: str, header: bool = True) -> Column:
    """All entries of a fixed group as an array, in order."""
    g = codec.group(name)
    if g.framed:
        raise WireError("not_fixed_size", f"{name} is framed; decode the record instead")
    kind = g.spark_type().simpleString()

    def all_of(h: Column) -> Column:
        entries = F.transform(F.sequence(F.lit(0), h["n"] - 1), lambda i: bx.let(bx.cut(b, h["at"] + 4 + i * h["size"], h["size"]), lambda raw: _entry(g, raw)))
        return F.when(h["n"] > 0, entries).when(h["n"] == 0, F.array().cast(kind)).cast(kind)

    return _headed(b, access.group_place(codec, b, name, header), all_of)


def group_entry(codec: Codec, b: Column, name: str, i: int | Column, header: bool = True) -> Column:
    """struct(entry, error): the i-th entry alone, without decoding the others."""
    g, i = codec.group(name), bx.place(i)

    def one(h: Column) -> Column:
        error = F.when((i < 0) | (i >= h["n"]), F.lit("index_out_of_bounds")).when(F.octet_length(b) < h["at"] + 4 + (i + 1) * h["size"], F.lit("entry_out_of_bounds"))
        entry = bx.let(F.when(error.isNull(), bx.cut(b, h["at"] + 4 + i * h["size"], h["size"])), lambda raw: F.when(raw.isNotNull(), _entry(g, raw)))
        return F.struct(entry.alias("entry"), error.alias("error"))

    return _headed(b, access.group_place(codec, b, name, header), one)


def group_field(codec: Codec, b: Column, name: str, i: int | Column, field: str, header: bool = True) -> Column:
    """One field of one entry; null out of bounds."""
    g = codec.group(name)
    g.entry.field(field)
    return group_entry(codec, b, name, i, header)["entry"][field]


def group_error(b: Column, at: Column | int, max_entries: int = MAX_GROUP_ENTRIES, max_bytes: int = 8 * 1024 * 1024) -> Column:
    """Why a fixed group can't be read, checked in this order; null where it can."""
    at = bx.place(at)
    size, n = group_header(b, at)
    return (
        F.when(F.coalesce(F.octet_length(b) < at + 4, F.lit(True)), F.lit("insufficient_header"))
        .when((n > 0) & (size == 0), F.lit("invalid_block_length"))
        .when(n > max_entries, F.lit("max_entries_exceeded"))
        .when(n * size > max_bytes, F.lit("max_bytes_exceeded"))
        .when(F.octet_length(b) < at + 4 + n * size, F.lit("insufficient_data"))
    )


def group_rest(codec: Codec, b: Column, name: str, header: bool = True) -> Column:
    """The bytes behind a group."""
    g, at = codec.group(name), access.group_place(codec, b, name, header)
    return bx.tail(b, at + access.group_size(g, b, at))


def encode_group(g: Group, entries: Column) -> Column:
    """A fixed group from an array of structs (or scalars), in generated code."""
    if g.framed:
        raise WireError("not_fixed_size", f"{g.name} is framed; use arrowio.encode")
    one = lambda e: access.encode_columns(g.entry, {"value": e} if g.is_scalar else {f.name: e[f.name] for f in g.fields}, header=False)
    raw = F.unhex(F.array_join(F.transform(entries, lambda e: F.hex(one(e))), ""))
    n = F.size(entries)
    n = F.when(n > MAX_GROUP_ENTRIES, F.raise_error(F.lit("max_entries_exceeded")).cast("int")).otherwise(n)
    return F.concat(bx.number(F.when(n > 0, g.entry.block_length).otherwise(0), 2), bx.number(n, 2), raw)


# -- folds over decoded arrays ------------------------------------------------------------------------------------------


def reduce_group(entries: Column, start: Column, merge: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(entries, start, merge)


def map_group(entries: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(entries, f)


def stream_group(df: DataFrame, entries: str | Column, keep: list[str], entry: str = "entry") -> DataFrame:
    """One row for each entry with its place; filters and limits after it apply to entries."""
    return df.select(*keep, F.posexplode(entries).alias("pos", entry))


def take(entries: Column, n: int) -> Column:
    return F.slice(entries, 1, n)


# -- batches -----------------------------------------------------------------------------------------------------------


def batch_count(codec: Codec, b: Column, name: str, header: bool = True) -> Column:
    """Entries of a batch from its headers alone."""
    batch, at = codec.batch(name), access.group_place(codec, b, name, header)
    if batch.strategy == "padded_union":
        return group_header(b, at)[1]
    if batch.strategy == "typed_frames":
        return bx.unsigned(b, at + 4, 4).cast("int")
    total, place = F.lit(0), at + 2
    for _ in batch.any_of:
        size, n = group_header(b, place)
        total, place = total + n, place + 4 + size * n
    return total


def batch_wire_size(codec: Codec, b: Column, name: str, header: bool = True) -> Column:
    batch, at = codec.batch(name), access.group_place(codec, b, name, header)
    return access.batch_size(batch.strategy, len(batch.any_of), b, at)


def by_type(codec: Codec, b: Column, name: str, kind: str, header: bool = True) -> Column:
    """array<struct(seq, entry)> of one codec's entries of a padded batch; other payloads aren't decoded."""
    batch, at = codec.batch(name), access.group_place(codec, b, name, header)
    if batch.strategy != "padded_union":
        raise WireError("not_fixed_size", "filter the decoded entries by tag instead")
    tag, own = batch.tag_of(kind), batch.any_of[batch.tag_of(kind)]

    def entry(p: Column) -> Column:
        fields = lambda raw: F.struct(*[access.get(own, raw, f.name, header=False).alias(f.name) for f in own.fixed])
        return F.struct(bx.unsigned(b, p, 4).alias("seq"), bx.let(bx.cut(b, p + 5, own.block_length), fields).alias("entry"))

    def mine(h: Column) -> Column:
        places = F.transform(F.when(h["n"] > 0, F.sequence(F.lit(0), h["n"] - 1)).otherwise(F.array().cast("array<int>")), lambda i: h["at"] + 4 + i * h["size"])
        return F.transform(F.filter(places, lambda p: bx.cut(b, p + 4, 1) == bx.literal(bytes([tag]))), entry)

    return _headed(b, at, mine)


def entries_of(batch: Batch, entries: Column, kind: str) -> Column:
    """The decoded entries of one codec."""
    tag = batch.tag_of(kind)
    return F.filter(entries, lambda e: e["tag"] == tag)


def merged(*arrays: Column) -> Column:
    """Arrays of entries with ``seq`` as one array by seq; arrays keep their own order among equal ones."""
    return F.array_sort(F.flatten(F.array(*arrays)), lambda x, y: F.when(x["seq"] < y["seq"], -1).when(x["seq"] > y["seq"], 1).otherwise(0))


# -- lookups -----------------------------------------------------------------------------------------------------------


def lookup_list(entries: Column, **equal) -> Column:
    """Entries whose fields equal the given values, in order; None matches null."""
    return F.filter(entries, lambda e: _equal(e, equal))


def _equal(e: Column, equal: dict) -> Column:
    out = F.lit(True)
    for name, value in equal.items():
        out = out & e[name].eqNullSafe(F.lit(value))
    return out


def lookup_map(df: DataFrame, entries: str | Column, keep: list[str], key: str | Callable[[Column], Column], **equal) -> DataFrame:
    """(keep, key, entry): for each key the last matching entry; a null key is a key too.

    Exploded rather than a map column, as those can't hold null keys; the last write wins by place.
    """
    of = key if callable(key) else (lambda e: e[key])
    rows = df.select(*keep, F.posexplode(entries).alias("_pos", "entry")).where(_equal(F.col("entry"), equal))
    return rows.groupBy(*keep, of(F.col("entry")).alias("key")).agg(F.max_by("entry", "_pos").alias("entry"))


def lookup_map_column(entries: Column, key: str | Callable[[Column], Column], **equal) -> Column:
    """map<key, entry> with the last entry of each key; entries with a null key are left out."""
    of = key if callable(key) else (lambda e: e[key])
    mine = F.filter(entries, lambda e: _equal(e, equal) & of(e).isNotNull())
    keys = F.transform(mine, of)
    return F.map_from_arrays(F.array_distinct(keys), F.transform(F.array_distinct(keys), lambda k: F.element_at(F.filter(mine, lambda e: of(e) == k), -1)))


def batch_key(batch: Batch, **fields: str) -> Callable[[Column], Column]:
    """The key of a batch entry: a field for each codec by name. Codecs without one are an error."""
    if missing := [c.name for c in batch.any_of if c.name not in fields]:
        raise WireError("uncovered_types", ", ".join(missing))
    return lambda e: F.coalesce(*[e[c.name][fields[c.name]] for c in batch.any_of])


@dataclass(frozen=True)
class Lookup:
    """A named lookup of a codec: entries of a group or batch as a map by key (last write wins) or as a list, filtered by equality."""

    source: str
    into: str = "map"
    key: str | Callable[[Column], Column] | None = None
    where: tuple[tuple[str, object], ...] = ()

    def __post_init__(self) -> None:
        if self.into not in ("map", "list") or (self.into == "map") != (self.key is not None):
            raise WireError("unknown_option", f"{self.into} with key {self.key}")


def lookup(codec: Codec, df: DataFrame, name: str, column: str = "data", keep: list[str] | None = None) -> DataFrame:
    """A lookup the codec declares, over encoded records: (keep, key, entry) for maps, (keep, entries) for lists.

    Only the group it names is decoded.
    """
    from packrow.sources import arrowio

    if name not in codec.lookups:
        raise WireError("unknown_lookup", f"{codec.name} has no lookup {name}")
    found, keep = codec.lookups[name], list(keep or [])
    rows = arrowio.decode(df, codec, column, keep, [found.source], strict=True)
    if found.into == "list":
        return rows.select(*keep, lookup_list(F.col(found.source), **dict(found.where)).alias("entries"))
    return lookup_map(rows, found.source, keep, found.key, **dict(found.where))
