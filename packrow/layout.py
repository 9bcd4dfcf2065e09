"""Record definitions and their layout: header, fixed block, groups and batches, length-prefixed fields.

A codec is declared once in Python (or parsed from schema text) and then only holds constants: offsets,
sizes and sentinel bytes. Operators turn those into Column expressions or Arrow batches.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property
from typing import Any

import numpy as np
from pyspark.sql import types as T

from packrow.types import Bitset, Enum, PrefixedId, Text, WireError, WireType, align, dtype_of, typed

HEADER = struct.Struct("<HHHH")
MAX_GROUP_ENTRIES, MAX_ENTRY_BYTES, MAX_GROUP_BYTES = 65_535, 65_535, 8 * 1024 * 1024
PRESENCES = ("optional", "required", "constant")


_PLAIN = {"smallint": T.ShortType(), "int": T.IntegerType(), "bigint": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType(), "binary": T.BinaryType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType())}


def spark_type(t: WireType) -> T.DataType:
    """The Spark type of a wire type, also where no session runs (in workers)."""
    if t.spark.startswith("decimal("):
        precision, scale = t.spark[8:-1].split(",")
        return T.DecimalType(int(precision), int(scale))
    return _PLAIN[t.spark] if t.spark in _PLAIN else T._parse_datatype_string(t.spark)


@dataclass(frozen=True)
class Field:
    """One field. ``wire`` reads and writes another wire type than the domain type; ``virtual`` isn't on the wire."""

    name: str
    type: Any
    presence: str = "optional"
    default: Any = None
    value: Any = None
    since: int | None = None
    wire: Any = None
    virtual: bool = False
    doc: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "type", typed(self.type))
        if self.wire is not None:
            object.__setattr__(self, "wire", typed(self.wire))
        if self.presence not in PRESENCES:
            raise WireError("unknown_presence", self.presence)

    @property
    def wire_type(self) -> WireType:
        return self.wire or self.type

    @property
    def is_var(self) -> bool:
        return self.type.size is None


@dataclass(frozen=True)
class Group:
    """A repeating group: of named fields, of another fixed-size codec, or of one scalar type (``of``).

    ``framed`` entries carry their own length and may hold length-prefixed fields.
    """

    name: str
    fields: tuple[Field, ...] = ()
    of: Any = None
    framed: bool = False
    doc: str | None = None

    def __post_init__(self) -> None:
        of = self.of
        if isinstance(of, Codec):
            if of.var_fields or of.groups or of.batches:
                raise WireError("not_fixed_size", f"group {self.name} needs a fixed-size codec")
            object.__setattr__(self, "fields", tuple(of.fields))
        elif of is not None:
            object.__setattr__(self, "of", typed(of))
            if typed(of).size is None:
                object.__setattr__(self, "framed", True)
        object.__setattr__(self, "fields", tuple(self.fields))
        if not self.framed and any(f.is_var for f in self.fields):
            raise WireError("not_fixed_size", f"group {self.name} must be framed")

    @property
    def is_scalar(self) -> bool:
        return isinstance(self.of, WireType)

    @cached_property
    def entry(self) -> Codec:
        """The entries as a codec without header; entries are never aligned."""
        if self.is_scalar:
            return Codec(self.name + "_entry", [Field("value", self.of)])
        return Codec(self.name + "_entry", list(self.fields), endian=self.of.endian if isinstance(self.of, Codec) else "little")

    def spark_type(self) -> T.DataType:
        return T.ArrayType(spark_type(self.of) if self.is_scalar else self.entry.struct_type())


STRATEGIES = ("padded_union", "typed_frames", "per_type_groups")


@dataclass(frozen=True)
class Batch:
    """An ordered mix of entries of several codecs; an entry's tag is its codec's place in ``any_of``."""

    name: str
    any_of: tuple[Codec, ...]
    strategy: str = "padded_union"

    def __post_init__(self) -> None:
        object.__setattr__(self, "any_of", tuple(self.any_of))
        if self.strategy not in STRATEGIES:
            raise WireError("unknown_strategy", self.strategy)
        if self.strategy != "typed_frames" and any(c.var_fields or c.groups or c.batches for c in self.any_of):
            raise WireError("not_fixed_size", f"batch {self.name} needs fixed-size codecs or typed_frames")

    @property
    def payload(self) -> int:
        return max(c.block_length for c in self.any_of)

    def tag_of(self, codec: Codec | str) -> int:
        name = codec if isinstance(codec, str) else codec.name
        for i, c in enumerate(self.any_of):
            if c.name == name:
                return i
        raise WireError("not_in_any_of", f"{name} isn't in {self.name}'s any_of set")

    def spark_type(self) -> T.DataType:
        parts = [T.StructField("seq", T.LongType()), T.StructField("tag", T.ShortType())]
        return T.ArrayType(T.StructType(parts + [T.StructField(c.name, c.struct_type()) for c in self.any_of]))


@dataclass(eq=False)
class Codec:
    """A named, versioned record type. Without a template id it gets one from its name."""

    name: str
    fields: list[Field]
    template_id: int | None = None
    schema_id: int = 0
    version: int = 1
    groups: list[Group] = field(default_factory=list)
    batches: list[Batch] = field(default_factory=list)
    endian: str = "little"
    aligned: bool = False
    field_defaults: dict = field(default_factory=dict)
    checks: list = field(default_factory=list)
    lookups: dict = field(default_factory=dict)
    before_encode: Callable | None = None
    after_decode: Callable | None = None
    doc: str | None = None

    def __post_init__(self) -> None:
        if self.template_id is None:
            self.template_id = zlib.crc32(self.name.encode()) & 0xFFFF
        self.fields = [self._defaulted(f) for f in self.fields]
        names = [x.name for x in (*self.fields, *self.groups, *self.batches)]
        if doubled := {n for n in names if names.count(n) > 1}:
            raise WireError("duplicate_field", ", ".join(sorted(doubled)))
        self._since(self.fixed)
        for g in self.groups:
            if not g.framed:
                self._since([f for f in g.fields if not f.is_var])

    def _defaulted(self, f: Field) -> Field:
        """Defaults of the codec fill what the field leaves at its own."""
        own = {k: v for k, v in self.field_defaults.items() if getattr(f, k) == Field.__dataclass_fields__[k].default}
        return replace(f, **own) if own and not (f.presence == "constant" and "presence" in own) else f

    @staticmethod
    def _since(fields: list[Field]) -> None:
        last = 0
        for f in fields:
            if (f.since or 0) < last:
                raise WireError("since_decreases", f"{f.name} stands behind fields of a later version")
            last = f.since or 0

    @cached_property
    def fixed(self) -> list[Field]:
        return [f for f in self.fields if not f.is_var and not f.virtual]

    @cached_property
    def var_fields(self) -> list[Field]:
        return [f for f in self.fields if f.is_var and not f.virtual]

    @cached_property
    def virtual_fields(self) -> list[Field]:
        return [f for f in self.fields if f.virtual]

    @cached_property
    def offsets(self) -> dict[str, int]:
        """Places of the fixed fields in the payload."""
        at, out = 0, {}
        for f in self.fixed:
            at = align(at, f.wire_type.align) if self.aligned else at
            out[f.name] = at
            at += f.wire_type.size
        return out

    @cached_property
    def block_length(self) -> int:
        return max((self.offsets[f.name] + f.wire_type.size for f in self.fixed), default=0)

    @cached_property
    def null_block(self) -> bytes:
        """The block in which everything is null; constants hold their value."""
        out = bytearray(self.block_length)
        for f in self.fixed:
            raw = f.wire_type.pack(f.value, self.endian) if f.presence == "constant" else f.wire_type.null(self.endian)
            out[self.offsets[f.name] : self.offsets[f.name] + len(raw)] = raw
        return bytes(out)

    @cached_property
    def dtype(self) -> np.dtype:
        return np.dtype({"names": [f.name for f in self.fixed], "formats": [dtype_of(f.wire_type, self.endian) for f in self.fixed], "offsets": [self.offsets[f.name] for f in self.fixed], "itemsize": max(self.block_length, 1)})

    @property
    def simple(self) -> bool:
        """Whether a record is header and fixed block alone."""
        return not (self.var_fields or self.groups or self.batches)

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise WireError("unknown_field", f"{self.name} has no field {name}")

    def group(self, name: str) -> Group:
        for g in self.groups:
            if g.name == name:
                return g
        raise WireError("unknown_field", f"{self.name} has no group {name}")

    def batch(self, name: str) -> Batch:
        for b in self.batches:
            if b.name == name:
                return b
        raise WireError("unknown_field", f"{self.name} has no batch {name}")

    def field_spec(self, name: str, header: bool = True) -> tuple:
        """(type, place, byte order) of a fixed field, or ("variable", name), ("group", name)."""
        if any(g.name == name for g in (*self.groups, *self.batches)):
            return "group", name
        f = self.field(name)
        return ("variable", name) if f.is_var else (f.wire_type, self.offsets[name] + 8 * header, self.endian)

    def field_specs(self, header: bool = True) -> dict[str, tuple]:
        return {f.name: self.field_spec(f.name, header) for f in self.fixed}

    def match_meta(self) -> dict[str, dict]:
        """For every fixed field its places with and without header, size and byte order."""
        return {f.name: {"offset": self.offsets[f.name] + 8, "payload_offset": self.offsets[f.name], "size": f.wire_type.size, "endian": self.endian, "type": f.wire_type.name} for f in self.fixed}

    def header_bytes(self, block_length: int | None = None) -> bytes:
        return HEADER.pack(self.block_length if block_length is None else block_length, self.template_id, self.schema_id, self.version)

    def encode_field(self, name: str, value) -> bytes:
        return self.field(name).wire_type.pack(value, self.endian)

    def struct_type(self) -> T.StructType:
        """The Spark type of a decoded record: fields in order, then groups and batches."""
        parts = [T.StructField(f.name, spark_type(f.type)) for f in self.fields]
        return T.StructType(parts + [T.StructField(g.name, g.spark_type()) for g in (*self.groups, *self.batches)])

    def types_used(self) -> list[WireType]:
        """Enums, bitsets and prefixed ids among the fields, each once."""
        found: dict[str, WireType] = {}
        for f in (*self.fields, *(x for g in self.groups for x in g.fields)):
            if isinstance(f.type, Enum | Bitset | PrefixedId):
                found.setdefault(f.type.name, f.type)
        return list(found.values())

    def schema_info(self) -> dict:
        return {
            "name": self.name, "template_id": self.template_id, "schema_id": self.schema_id, "version": self.version, "block_length": self.block_length,
            "fields": [(f.name, f.type.name) for f in self.fields], "var_fields": [f.name for f in self.var_fields], "groups": [g.name for g in (*self.groups, *self.batches)],
        }


# -- Records as bytes, one at a time: what sequential layouts need inside an Arrow batch. --------------------------------


def _filled(f: Field, value):
    """The value that reading a field gives: defaults for null, an error where a required one is absent."""
    if value is None and f.default is not None:
        value = f.default
    if value is None and f.presence == "required":
        raise WireError("required_field_absent", f.name)
    return value


def pack_block(codec: Codec, record: dict) -> bytes:
    out = bytearray(codec.null_block)
    for f in codec.fixed:
        if f.presence == "constant":
            continue
        value = record.get(f.name)
        value = f.default if value is None else value
        if value is None and f.presence == "required":
            raise WireError("required_field", f.name)
        raw = f.wire_type.pack(value, codec.endian)
        out[codec.offsets[f.name] : codec.offsets[f.name] + len(raw)] = raw
    return bytes(out)


def pack_group(g: Group, entries) -> bytes:
    entries = entries or []
    if g.is_scalar:
        entries = [{"value": x} for x in entries]
    if not g.framed and len(entries) > MAX_GROUP_ENTRIES:
        raise WireError("max_entries_exceeded", f"{len(entries)} in {g.name}")
    raw = [pack_block(g.entry, e) + b"".join(f.wire_type.pack(e.get(f.name)) for f in g.entry.var_fields) for e in entries]
    if any(len(x) > MAX_ENTRY_BYTES for x in raw) or sum(map(len, raw)) > MAX_GROUP_BYTES:
        raise WireError("max_bytes_exceeded", g.name)
    if g.framed:
        return struct.pack("<I", len(raw)) + b"".join(struct.pack("<H", len(x)) + x for x in raw)
    return struct.pack("<HH", len(raw[0]) if raw else 0, len(raw)) + b"".join(raw)


def pack_batch(b: Batch, entries) -> bytes:
    """Entries are dicts with ``seq``, ``tag`` and the record under its codec's name."""
    rows = [(e["seq"], e["tag"], pack(b.any_of[e["tag"]], e[b.any_of[e["tag"]].name], header=False)) if 0 <= e["tag"] < len(b.any_of) else b.tag_of(f"tag {e['tag']}") for e in entries or []]
    if b.strategy == "padded_union":
        if len(rows) > MAX_GROUP_ENTRIES:
            raise WireError("max_entries_exceeded", b.name)
        return struct.pack("<HH", b.payload + 5 if rows else 0, len(rows)) + b"".join(struct.pack("<IB", s, t) + p.ljust(b.payload, b"\0") for s, t, p in rows)
    if b.strategy == "typed_frames":
        body = b"".join(struct.pack("<IBH", s, t, len(p)) + p for s, t, p in rows)
        return struct.pack("<II", 4 + len(body), len(rows)) + body
    out = [struct.pack("<BB", len(b.any_of), 0)]
    for i, c in enumerate(b.any_of):
        own = [(s, p) for s, t, p in rows if t == i]
        if len(own) > MAX_GROUP_ENTRIES:
            raise WireError("max_entries_exceeded", b.name)
        out.append(struct.pack("<HH", c.block_length + 4, len(own)) + b"".join(struct.pack("<I", s) + p for s, p in own))
    return b"".join(out)


def pack(codec: Codec, record: dict, header: bool = True) -> bytes:
    """The bytes of one record."""
    parts = [codec.header_bytes()] if header else []
    parts.append(pack_block(codec, record))
    parts += [pack_group(g, record.get(g.name)) for g in codec.groups]
    parts += [pack_batch(b, record.get(b.name)) for b in codec.batches]
    for f in codec.var_fields:
        value = record.get(f.name)
        value = f.default if value is None else value
        if value is None and f.presence == "required":
            raise WireError("required_field", f.name)
        parts.append(f.wire_type.pack(value))
    return b"".join(parts)


def unpack_block(codec: Codec, buf: bytes, at: int, length: int) -> dict:
    """Fixed fields from a block of ``length`` bytes; what a shorter one lacks reads as null, then as its default."""
    block = buf[at : at + length]
    if length < codec.block_length:
        block = block + codec.null_block[length:]
    out = {}
    for f in codec.fixed:
        value = f.value if f.presence == "constant" else f.wire_type.unpack(block, codec.offsets[f.name], codec.endian)
        out[f.name] = _filled(f, value)
    return out


def unpack_group(g: Group, buf: bytes, at: int) -> tuple[list, int]:
    if g.framed:
        if len(buf) < at + 4:
            raise WireError("group_too_short", g.name)
        (n,) = struct.unpack_from("<I", buf, at)
        at += 4
        entries = []
        for _ in range(n):
            if len(buf) < at + 2 or len(buf) < at + 2 + (size := struct.unpack_from("<H", buf, at)[0]):
                raise WireError("group_too_short", g.name)
            entries.append(unpack(g.entry, buf[at + 2 : at + 2 + size], header=False))
            at += 2 + size
    else:
        if len(buf) < at + 4:
            raise WireError("group_absent" if len(buf) == at else "group_too_short", g.name)
        size, n = struct.unpack_from("<HH", buf, at)
        at += 4
        if n and not size:
            raise WireError("invalid_block_length", g.name)
        if len(buf) < at + size * n:
            raise WireError("group_too_short", g.name)
        entries = [unpack_block(g.entry, buf, at + i * size, size) for i in range(n)]
        at += size * n
    return ([e["value"] for e in entries] if g.is_scalar else entries), at


def unpack_batch(b: Batch, buf: bytes, at: int) -> tuple[list, int]:
    def entry(seq: int, tag: int, raw: bytes) -> dict:
        if tag >= len(b.any_of):
            raise WireError("unknown_tag", f"{tag} in {b.name}")
        c = b.any_of[tag]
        body = raw if b.strategy == "typed_frames" else raw[: c.block_length]
        return {"seq": seq, "tag": tag} | {x.name: None for x in b.any_of} | {c.name: unpack(c, body, header=False)}

    short = WireError("batch_too_short", b.name)
    if b.strategy == "padded_union":
        if len(buf) < at + 4:
            raise short
        size, n = struct.unpack_from("<HH", buf, at)
        at += 4
        if len(buf) < at + size * n:
            raise short
        rows = [(*struct.unpack_from("<IB", buf, p), buf[p + 5 : p + size]) for p in range(at, at + size * n, size or 1)]
        return [entry(*r) for r in rows], at + size * n
    if b.strategy == "typed_frames":
        if len(buf) < at + 8:
            raise short
        body, n = struct.unpack_from("<II", buf, at)
        p, out = at + 8, []
        for _ in range(n):
            if len(buf) < p + 7:
                raise short
            seq, tag, size = struct.unpack_from("<IBH", buf, p)
            if len(buf) < p + 7 + size:
                raise short
            out.append(entry(seq, tag, buf[p + 7 : p + 7 + size]))
            p += 7 + size
        return out, at + 4 + body
    if len(buf) < at + 2:
        raise short
    kinds = buf[at]
    at += 2
    out = []
    for tag in range(kinds):
        if len(buf) < at + 4:
            raise short
        size, n = struct.unpack_from("<HH", buf, at)
        at += 4
        if len(buf) < at + size * n:
            raise short
        out += [entry(struct.unpack_from("<I", buf, p)[0], tag, buf[p + 4 : p + size]) for p in range(at, at + size * n, size or 1)]
        at += size * n
    return sorted(out, key=lambda e: e["seq"]), at


def unpack(codec: Codec, buf: bytes, header: bool = True, missing_group: str = "error") -> dict:
    """The record in ``buf``; raises WireError with a stable code where it can't be read.

    Records of older versions are padded: their block length comes from the header. Without a header
    a short block is an error. ``missing_group="empty"`` reads a group that an old record lacks as empty.
    """
    at, length = 0, codec.block_length
    if header:
        if len(buf) < 8:
            raise WireError("insufficient_data", f"{len(buf)} of 8 header bytes")
        length, template, schema, version = HEADER.unpack_from(buf)
        if template != codec.template_id:
            raise WireError("template_id_mismatch", str(template))
        if schema != codec.schema_id:
            raise WireError("schema_id_mismatch", str(schema))
        if version > codec.version:
            raise WireError("version_too_new", str(version))
        at = 8
    if len(buf) < at + length:
        raise WireError("invalid_binary", f"block of {length} bytes in {len(buf) - at}")
    if codec.simple and not codec.fixed and len(buf) > at:
        raise WireError("expected_empty", str(len(buf) - at))
    out = unpack_block(codec, buf, at, length)
    at += length
    for g in codec.groups:
        if missing_group == "empty" and at == len(buf):
            out[g.name] = []
            continue
        out[g.name], at = unpack_group(g, buf, at)
    for b in codec.batches:
        out[b.name], at = unpack_batch(b, buf, at)
    for f in codec.var_fields:
        value, at = (None, at) if at == len(buf) else f.wire_type.take(buf, at) if isinstance(f.wire_type, Text) else f.wire_type.take(buf, at)
        out[f.name] = _filled(f, value)
    for f in codec.virtual_fields:
        out[f.name] = f.default
    return out
