"""Headers and single fields straight from the bytes: what a scan reads when it needs few fields.

All functions give Columns and stay in generated code. ``header`` tells whether records carry
their 8-byte header; with it, fields behind the block length of an old record are null or their default.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packrow.functions import bytesx as bx
from packrow.layout import Codec, Field, Group
from packrow.types import Text, WireError, WireType, typed


def header_encode(template_id: int, block_length: int, schema_id: int = 0, version: int = 1) -> Column:
    import struct

    return bx.literal(struct.pack("<HHHH", block_length, template_id, schema_id, version))


def header(b: Column) -> Column:
    """block_length, template_id, schema_id, version and error, a code where the bytes are too few."""
    short = F.coalesce(F.octet_length(b) < 8, F.lit(True))
    parts = [bx.unsigned(b, 2 * i, 2).cast("int").alias(n) for i, n in enumerate(("block_length", "template_id", "schema_id", "version"))]
    return F.struct(*parts, F.when(short, F.lit("insufficient_data")).alias("error"))


def header_strict(b: Column) -> Column:
    """The header; fails the job where the bytes are too few."""
    return F.when(F.octet_length(b) >= 8, header(b)).otherwise(F.raise_error(F.lit("insufficient_data")))


def template_id(b: Column) -> Column:
    return bx.unsigned(b, 2, 2).cast("int")


def header_error(b: Column, max_block_length: int | None = None, max_version: int | None = None) -> Column:
    """A code for headers that are too short or above the limits, else null."""
    out = F.when(F.coalesce(F.octet_length(b) < 8, F.lit(True)), F.lit("insufficient_data"))
    if max_block_length is not None:
        out = out.when(bx.unsigned(b, 0, 2) > max_block_length, F.lit("block_length_exceeded"))
    if max_version is not None:
        out = out.when(bx.unsigned(b, 6, 2) > max_version, F.lit("version_exceeded"))
    return out


def record_error(codec: Codec, b: Column) -> Column:
    """The code with which decoding a framed record of this codec would stop at its header or block."""
    return (
        F.when(F.coalesce(F.octet_length(b) < 8, F.lit(True)), F.lit("insufficient_data"))
        .when(bx.unsigned(b, 2, 2) != codec.template_id, F.lit("template_id_mismatch"))
        .when(bx.unsigned(b, 4, 2) != codec.schema_id, F.lit("schema_id_mismatch"))
        .when(bx.unsigned(b, 6, 2) > codec.version, F.lit("version_too_new"))
        .when(F.octet_length(b) < bx.unsigned(b, 0, 2) + 8, F.lit("invalid_binary"))
    )


def read(b: Column, kind: str | WireType, offset: int, endian: str = "little") -> Column:
    """A value by type, place and byte order."""
    return typed(kind).read(b, offset, endian)


def block_end(codec: Codec, b: Column, header: bool = True) -> Column:
    """Where the fixed block ends, by the record's own header."""
    return bx.unsigned(b, 0, 2).cast("int") + 8 if header else F.lit(codec.block_length)


def _guarded(codec: Codec, f: Field, b: Column, value: Column, header: bool) -> Column:
    if not header:
        return value
    return F.when(block_end(codec, b) >= codec.offsets[f.name] + 8 + f.wire_type.size, value)


def get(codec: Codec, b: Column, name: str, header: bool = True) -> Column:
    """One field, null for its sentinel; its default where it has one."""
    f = codec.field(name)
    if f.virtual:
        return F.lit(f.default).cast(f.type.spark)
    if f.presence == "constant":
        return F.when(b.isNotNull(), F.lit(f.value)).cast(f.type.spark)
    if f.is_var:
        value = bx.let(var_place(codec, b, name, header), lambda p: f.wire_type.read(b, p))
    else:
        value = _guarded(codec, f, b, f.wire_type.read(b, codec.offsets[name] + 8 * header, codec.endian), header)
    value = value.cast(f.type.spark) if f.wire else value
    return F.when(b.isNotNull(), F.coalesce(value, F.lit(f.default).cast(f.type.spark))) if f.default is not None else value


def group_place(codec: Codec, b: Column, name: str, header: bool = True) -> Column:
    """Where a group begins, stepping over the ones before it by their own sizes."""
    at = block_end(codec, b, header)
    for g in codec.groups:
        if g.name == name:
            return at
        at = _behind_group(g, b, at)
    for batch in codec.batches:
        if batch.name == name:
            return at
        at = _behind_batch(batch, b, at)
    raise WireError("unknown_field", name)


def _behind_group(g: Group, b: Column, at: Column) -> Column:
    """Each place is bound once, so that expressions grow with the number of parts and not by a power of it."""
    return bx.let(at, lambda p: p + group_size(g, b, p))


def _behind_text(f: Field, b: Column, at: Column) -> Column:
    return bx.let(at, lambda p: f.wire_type.behind(b, p))


def _behind_batch(batch, b: Column, at: Column) -> Column:
    return bx.let(at, lambda p: p + batch_size(batch.strategy, len(batch.any_of), b, p))


def group_size(g: Group, b: Column, at: Column) -> Column:
    """Bytes of a group, header included. Framed groups must be walked, so only their decoder knows."""
    if g.framed:
        raise WireError("not_fixed_size", f"{g.name} is framed; decode the record instead")
    return (bx.unsigned(b, at, 2) * bx.unsigned(b, at + 2, 2)).cast("int") + 4


def batch_size(strategy: str, kinds: int, b: Column, at: Column) -> Column:
    if strategy == "padded_union":
        return (bx.unsigned(b, at, 2) * bx.unsigned(b, at + 2, 2)).cast("int") + 4
    if strategy == "typed_frames":
        return bx.unsigned(b, at, 4).cast("int") + 4
    total = F.lit(2)
    for _ in range(kinds):
        total = total + (bx.unsigned(b, at + total, 2) * bx.unsigned(b, at + total + 2, 2)).cast("int") + 4
    return total


def _behind_parts(codec: Codec, b: Column, header: bool) -> Column:
    """Where the length-prefixed fields begin."""
    at = block_end(codec, b, header)
    for g in codec.groups:
        at = _behind_group(g, b, at)
    for batch in codec.batches:
        at = _behind_batch(batch, b, at)
    return at


def var_place(codec: Codec, b: Column, name: str, header: bool = True) -> Column:
    """Where a length-prefixed field begins: behind the block, the groups and batches, and the fields before it."""
    at = _behind_parts(codec, b, header)
    for f in codec.var_fields:
        if f.name == name:
            return at
        at = _behind_text(f, b, at)
    raise WireError("unknown_field", name)


def rest_place(codec: Codec, b: Column, header: bool = True) -> Column:
    """Where the record ends."""
    last = codec.var_fields[-1] if codec.var_fields else None
    if last is not None:
        return _behind_text(last, b, var_place(codec, b, last.name, header))
    return _behind_parts(codec, b, header)


def decode_only(codec: Codec, b: Column, names: list[str]) -> Column:
    """Some fixed fields of framed records; unknown names and length-prefixed fields are null. Ids aren't checked."""
    known = {f.name for f in codec.fixed}
    return F.struct(*[(get(codec, b, n) if n in known else F.lit(None).cast("string")).alias(n) for n in names])


def decode_columns(codec: Codec, b: Column, header: bool = True) -> list[Column]:
    """All fields but groups as Columns of generated code."""
    return [get(codec, b, f.name, header).alias(f.name) for f in codec.fields]


def raw(codec: Codec, b: Column, name: str, header: bool = True) -> Column:
    """The wire value of a fixed field, sentinel and all."""
    f = codec.field(name)
    if f.is_var or f.virtual:
        raise WireError("unknown_field", f"{name} has no fixed place")
    return f.wire_type.raw(b, codec.offsets[name] + 8 * header, codec.endian)


def match_raw(codec: Codec, b: Column, bind: list[str] = (), header: bool = True, **literals) -> Column:
    """``matched`` and the raw values of ``bind``: literals compare with the wire, None with the sentinel."""
    matched = F.octet_length(b) >= codec.block_length + 8 * header
    for name, value in literals.items():
        f = codec.field(name)
        place = codec.offsets[name] + 8 * header
        matched = matched & (bx.cut(b, place, f.wire_type.size) == bx.literal(f.wire_type.pack(value, codec.endian)))
    matched = F.coalesce(matched, F.lit(False))
    return F.struct(matched.alias("matched"), *[F.when(matched, raw(codec, b, n, header)).alias(n) for n in bind])


def payload(b: Column) -> Column:
    return bx.tail(b, 8)


def content_hash(b: Column, header: bool = True) -> Column:
    """SHA-256 of the payload in hex; the header doesn't count."""
    return F.sha2(payload(b) if header else b, 256)


def detach(b: Column) -> Column:
    """The same bytes: rows of the JVM never share memory with a larger value."""
    return b


copy_field = detach


def inspect_fields(codec: Codec, b: Column, header: bool = True) -> Column:
    """array<struct(name, type, offset, size, raw_hex, value)> of the fixed fields by place; explode it for rows."""
    rows = []
    for f in sorted(codec.fixed, key=lambda f: codec.offsets[f.name]):
        at = codec.offsets[f.name] + 8 * header
        value = f.wire_type.read(b, at, codec.endian)
        text = F.lower(F.hex(value)) if f.wire_type.spark == "binary" else F.concat_ws(",", value) if f.wire_type.spark.startswith("array") else value.cast("string")
        rows.append(F.struct(F.lit(f.name).alias("name"), F.lit(f.wire_type.name).alias("type"), F.lit(at).alias("offset"), F.lit(f.wire_type.size).alias("size"), F.lower(F.hex(bx.cut(b, at, f.wire_type.size))).alias("raw_hex"), text.alias("value")))
    return F.array(*rows)


def encode_columns(codec: Codec, values: dict[str, Column], header: bool = True) -> Column:
    """A record of fixed and length-prefixed fields from Columns, in generated code. Missing fields are null or their default."""
    parts, at = ([bx.literal(codec.header_bytes())] if header else []), 0
    for f in codec.fixed:
        if codec.offsets[f.name] > at:
            parts.append(bx.literal(bytes(codec.offsets[f.name] - at)))
        at = codec.offsets[f.name] + f.wire_type.size
        parts.append(_written(codec, f, values))
    if codec.groups or codec.batches:
        raise WireError("not_fixed_size", "records with groups are encoded by arrowio.encode")
    return bx.joined(parts + [_written(codec, f, values) for f in codec.var_fields])


def _written(codec: Codec, f: Field, values: dict[str, Column]) -> Column:
    if f.presence == "constant":
        return bx.literal(f.wire_type.pack(f.value, codec.endian))
    value = values.get(f.name, F.lit(None).cast(f.type.spark))
    if f.default is not None:
        value = F.coalesce(value, F.lit(f.default).cast(f.type.spark))
    if f.presence == "required":
        value = F.coalesce(value, F.raise_error(F.lit(f"required_field: {f.name}")).cast(f.type.spark))
    return f.wire_type.write(value, codec.endian)


def text_type(f: Field) -> bool:
    return isinstance(f.wire_type, Text)
