"""Encoding and decoding whole records in Arrow batches.

Records of a fixed block and length-prefixed fields are handled as numpy arrays, many at a time: blocks by their
length where versions are mixed, lengths column by column. Only records that can't be read so, because of an error, are
looked at one by one for its code. Groups and batches are sequential by nature, so codecs that have them are walked
record by record inside the batch. All is narrow: no shuffle, no state, valid in streams too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from packrow import layout
from packrow.layout import HEADER, Codec
from packrow.types import Bool, Datetime, Enum, Float, Int, Scaled, Text, Timestamp, Uuid, WireError

ERROR = T.StructType([T.StructField("code", T.StringType()), T.StructField("detail", T.StringType())])


# -- numpy forms of single columns -----------------------------------------------------------------------------------


def _fast(t) -> bool:
    return isinstance(t, Bool | Datetime | Enum | Float | Int | Scaled | Timestamp) or (isinstance(t, Uuid) and not t.text)


def _read(t, raw: np.ndarray, endian: str, kind: pa.DataType) -> pa.Array:
    """An Arrow column from the wire bytes of a field: an array (rows, size) of bytes."""
    rows = len(raw)
    if isinstance(t, Uuid):
        null = ~raw.any(axis=1)
        flat = pa.py_buffer(np.ascontiguousarray(raw).tobytes())
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), rows, [_validity(null), flat]).cast(pa.binary())
    inner = t.inner if isinstance(t, Enum | Scaled) else t
    code = inner.numpy or "i8"
    order = "<" if endian == "little" or isinstance(t, Timestamp) else ">"
    values = np.ascontiguousarray(raw).view(order + code).reshape(rows).astype("=" + code)
    if isinstance(t, Float):
        return pa.array(values, mask=np.isnan(values)).cast(kind)
    if isinstance(t, Bool):
        return pa.array(values != 0, mask=values == 255)
    if isinstance(t, Timestamp):
        null = values == 0
        if isinstance(t, Datetime):
            return pa.array(values // t.factor, pa.int64(), mask=null).cast(pa.timestamp("us")).cast(kind)
        return pa.array(values, mask=null).cast(kind)
    null = values == inner.sentinel
    if isinstance(t, Enum):
        known = np.array(list(t.names), np.int64)
        at = pa.array(values.astype(np.int64), mask=null)
        names = pa.array(list(t.names.values()), pa.string())
        found = pc.take(names, pc.index_in(at, value_set=pa.array(known)))
        return pc.if_else(pc.is_valid(found), found, pc.cast(at, pa.string()))
    if isinstance(t, Scaled):
        whole = pa.array(values, mask=null).cast(pa.decimal128(38 - t.scale, 0)).cast(pa.decimal128(38, t.scale))
        import decimal

        return pc.multiply(whole.cast(pa.decimal128(20, 0)), pa.scalar(decimal.Decimal(1).scaleb(-t.scale), pa.decimal128(t.scale + 1, t.scale))).cast(kind)
    return pa.array(values, mask=null).cast(kind)


def _validity(null: np.ndarray):
    return pa.py_buffer(np.packbits(~null, bitorder="little").tobytes()) if null.any() else None


def _write(t, column: pa.Array, endian: str) -> np.ndarray:
    """Wire bytes (rows, size) of an Arrow column; raises WireError for a value that doesn't fit."""
    rows = len(column)
    if isinstance(t, Uuid):
        out = np.zeros((rows, 16), np.uint8)
        have = column.is_valid().to_numpy(zero_copy_only=False)
        raw = b"".join(column.drop_null().to_pylist())
        if len(raw) != 16 * int(have.sum()):
            raise WireError("invalid_format", "a uuid has 16 bytes")
        out[have] = np.frombuffer(raw, np.uint8).reshape(-1, 16)
        return out
    order = "<" if endian == "little" or isinstance(t, Timestamp) else ">"
    if isinstance(t, Float):
        values = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
        return np.ascontiguousarray(values.astype(order + t.numpy)).view(np.uint8).reshape(rows, t.size)
    if isinstance(t, Bool):
        values = column.cast(pa.uint8()).fill_null(255).to_numpy(zero_copy_only=False)
        return values.reshape(rows, 1)
    if isinstance(t, Timestamp):
        number = column.cast(pa.timestamp("us", tz="UTC")).cast(pa.int64()) if isinstance(t, Datetime) else column.cast(pa.int64())
        values = number.fill_null(0).to_numpy(zero_copy_only=False) * (t.factor if isinstance(t, Datetime) else 1)
        return np.ascontiguousarray(values.astype("<i8")).view(np.uint8).reshape(rows, 8)
    inner = t.inner if isinstance(t, Enum | Scaled) else t
    if isinstance(t, Enum):
        at = pc.index_in(column, value_set=pa.array(list(t.values), pa.string()))
        number = pc.take(pa.array(list(t.values.values()), pa.int64()), at)
        if (left := column.filter(pc.and_(pc.is_null(number), pc.is_valid(column)))) and not all(x.isdigit() for x in left.to_pylist()):
            raise WireError("cast_error", f"{t.name} has no {left[0]}")
        column = pc.if_else(pc.is_valid(number), number, pc.if_else(pc.utf8_is_digit(column), column, None).cast(pa.int64())) if len(left) else number
    elif isinstance(t, Scaled):
        import decimal

        column = pc.multiply(column.cast(pa.decimal128(28, t.scale)), pa.scalar(decimal.Decimal(10**t.scale), pa.decimal128(9, 0))).cast(pa.decimal128(20, 0), safe=False)
    if inner.name == "u64" and pa.types.is_decimal(column.type):
        values = np.array([inner.sentinel if x is None else int(x) for x in column.to_pylist()], np.uint64)
    else:
        whole = column.cast(pa.int64())
        values = whole.fill_null(0).to_numpy(zero_copy_only=False)
        if len(values) and not (values.min() >= inner.low and int(values.max()) <= inner.high):
            raise WireError("out_of_range", f"a value isn't a {inner.name}")
        values = values.astype("=" + inner.numpy)
        values[whole.is_null().to_numpy(zero_copy_only=False)] = inner.sentinel
    return np.ascontiguousarray(values.astype(order + inner.numpy)).view(np.uint8).reshape(rows, inner.size)


def _fixed(raw: np.ndarray, kind: pa.DataType = pa.binary()) -> pa.Array:
    """Rows of bytes as a binary column."""
    rows, width = raw.shape
    offsets = pa.py_buffer((np.arange(rows + 1, dtype=np.int64) * width).astype(np.int32).tobytes())
    return pa.BinaryArray.from_buffers(kind, rows, [None, offsets, pa.py_buffer(np.ascontiguousarray(raw).tobytes())])


# -- encode ----------------------------------------------------------------------------------------------------------


def encode_batch(codec: Codec, batch: pa.RecordBatch, header: bool = True) -> pa.Array:
    """The records of a batch whose columns are named as the fields, groups and batches."""
    have = set(batch.schema.names)
    col = lambda n: batch.column(batch.schema.get_field_index(n)) if n in have else pa.nulls(batch.num_rows)
    texts = None if codec.groups or codec.batches else _texts(codec, col)
    if texts is None or batch.num_rows > 10_000_000 // max(1, codec.block_length + 8):
        parts = [x.name for x in (*codec.fields, *codec.groups, *codec.batches) if x.name in have]
        rows = zip(*(col(n).to_pylist() for n in parts), strict=True) if parts else [()] * batch.num_rows
        return pa.array([layout.pack(codec, dict(zip(parts, r, strict=True)), header) for r in rows], pa.binary())
    lead = codec.header_bytes() if header else b""
    out = np.tile(np.frombuffer(lead + codec.null_block, np.uint8), (batch.num_rows, 1))
    for f in codec.fixed:
        if f.presence == "constant":
            continue
        column = col(f.name)
        if column.null_count:
            if f.default is not None:
                column = pc.fill_null(column.cast(to_arrow_type(layout.spark_type(f.type))), f.default)
            elif f.presence == "required":
                raise WireError("required_field", f.name)
        t, at = f.wire_type, len(lead) + codec.offsets[f.name]
        if _fast(t):
            out[:, at : at + t.size] = _write(t, column, codec.endian)
        else:
            out[:, at : at + t.size] = np.frombuffer(b"".join(t.pack(x, codec.endian) for x in column.to_pylist()), np.uint8).reshape(-1, t.size)
    return _ragged(out, texts) if texts else _fixed(out)


def _texts(codec: Codec, col) -> list[tuple[int, np.ndarray, np.ndarray]] | None:
    """(prefix size, lengths, bytes) of each length-prefixed column; None where one isn't text or all are too large for one array."""
    found, total = [], 0
    for f in codec.var_fields:
        if type(f.wire_type) is not Text:
            return None
        column = col(f.name)
        if f.default is not None:
            column = pc.fill_null(column.cast(pa.string()), f.default)
        elif column.null_count and f.presence == "required":
            raise WireError("required_field", f.name)
        column = pc.fill_null(column.cast(pa.string()).cast(pa.large_binary()), b"")
        ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
        sizes = np.diff(ends)
        if len(sizes) and sizes.max() >= 1 << (8 * f.wire_type.prefix):
            raise WireError("out_of_range", f"{sizes.max()} bytes don't fit a {f.wire_type.name}")
        raw = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
        found.append((f.wire_type.prefix, sizes, raw))
        total += len(raw) + (codec.block_length + 16) * len(sizes)
    return found if total < 1 << 31 else None


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the stretches that begin at ``starts``."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _ragged(block: np.ndarray, texts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Array:
    """Records of a block each and the texts behind it."""
    rows, width = block.shape
    ends = np.cumsum(width + sum(prefix + sizes for prefix, sizes, _ in texts))
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    out, at = np.empty(int(offsets[-1]), np.uint8), offsets[:-1].astype(np.int64)
    out[(at[:, None] + np.arange(width)).ravel()] = block.ravel()
    at += width
    for prefix, sizes, raw in texts:
        out[(at[:, None] + np.arange(prefix)).ravel()] = sizes.astype("<u4").view(np.uint8).reshape(rows, 4)[:, :prefix].ravel()
        out[_spans(at + prefix, sizes)] = raw
        at += prefix + sizes
    return pa.BinaryArray.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


def encode(df: DataFrame, codec: Codec, out: str = "data", keep: list[str] | None = None, header: bool = True) -> DataFrame:
    """``keep`` columns of ``df`` and the records made of its columns named as the codec's parts.

    Missing columns are null. A null in a required field, or a value that doesn't fit, fails the job with its
    code; ``validate`` finds such rows beforehand. Columns not named are pruned before the batches leave the JVM.
    """
    keep = list(keep or [])
    if codec.before_encode is not None:
        df = codec.before_encode(df)
    used = [x.name for x in (*codec.fields, *codec.groups, *codec.batches) if x.name in df.columns and not getattr(x, "virtual", False)]
    narrow = df.select(*dict.fromkeys([*keep, *used]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = encode_batch(codec, batch.select(used), header)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in keep), made], names=[*keep, out])

    return narrow.mapInArrow(run, T.StructType([*(df.schema[k] for k in keep), T.StructField(out, T.BinaryType())]))


# -- decode ----------------------------------------------------------------------------------------------------------


def _errors(codes: list, details: list) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(codes, pa.string()), pa.array(details, pa.string())], names=["code", "detail"], mask=pa.array([c is None for c in codes], pa.bool_()))


def decode_batch(codec: Codec, data: pa.Array, fields: list[str], header: bool = True, missing_group: str = "error") -> tuple[list[pa.Array], pa.Array]:
    """(one column for each of ``fields``, error structs) of binary records; a record with an error is null everywhere."""
    kinds = {f.name: to_arrow_type(f.dataType) for f in codec.struct_type().fields}
    if codec.groups or codec.batches or not all(type(f.wire_type) is Text for f in codec.var_fields):
        return _walked(codec, data, fields, kinds, header, missing_group)
    columns, good = _columns(codec, data, fields, kinds, header)
    if good.all():
        return columns, _errors([None] * len(data), [None] * len(data))
    rest, errors = _walked(codec, data.filter(pa.array(~good)), fields, kinds, header, missing_group)
    place = np.empty(len(data), np.int64)
    place[good], place[~good] = np.arange(good.sum()), good.sum() + np.arange((~good).sum())
    fine = _errors([None] * int(good.sum()), [None] * int(good.sum()))
    join = lambda x, y: pa.concat_arrays([x, y]).take(pa.array(place))
    return [join(x, y) for x, y in zip(columns, rest, strict=True)], join(fine, errors)


def _columns(codec: Codec, data: pa.Array, fields: list[str], kinds: dict[str, pa.DataType], header: bool) -> tuple[list[pa.Array], np.ndarray]:
    """The columns of the records without an error, and which these are."""
    rows, lead = len(data), 8 * header
    ends = np.frombuffer(data.buffers()[1], np.int32, rows + 1, data.offset * 4).astype(np.int64) if rows else np.zeros(1, np.int64)
    buf = np.frombuffer(data.buffers()[2], np.uint8) if rows and data.buffers()[2] is not None else np.zeros(0, np.uint8)
    good = data.is_valid().to_numpy(zero_copy_only=False) & (np.diff(ends) >= lead)
    length = np.full(rows, codec.block_length, np.int64)
    if header:
        heads = buf[(ends[:-1][good, None] + np.arange(8)).ravel()].view("<u2").reshape(-1, 4).astype(np.int64)
        length[good] = heads[:, 0]
        good[good] = (heads[:, 1] == codec.template_id) & (heads[:, 2] == codec.schema_id) & (heads[:, 3] <= codec.version)
    good &= np.diff(ends) >= lead + length
    if codec.simple and not codec.fixed:
        good &= np.diff(ends) == lead + length
    at, end = ends[:-1] + lead + length, ends[1:]
    texts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for f in codec.var_fields:
        prefix, size = f.wire_type.prefix, np.zeros(rows, np.int64)
        there = good & (at < end)
        good &= ~there | (at + prefix <= end)
        there &= good
        for k in range(prefix):
            size[there] |= buf[at[there] + k].astype(np.int64) << (8 * k)
        begin = at + prefix * there
        good &= begin + size <= end
        texts[f.name] = begin, size
        at = np.where(good, begin + size, end)
    required = [f for f in codec.fields if f.presence == "required" and not f.virtual]
    while True:
        made, absent = {}, np.zeros(int(good.sum()), bool)
        block = _blocks(codec, buf, ends[:-1][good] + lead, length[good])
        for f in dict.fromkeys([*[codec.field(n) for n in fields], *required]):
            column = _text(f, buf, *(x[good] for x in texts[f.name]), kinds[f.name]) if f.is_var else _vector(codec, f, block, 0, kinds[f.name])
            made[f.name] = column
            if f.presence == "required":
                absent |= column.is_null().to_numpy(zero_copy_only=False)
        if not absent.any():
            return [made[n] for n in fields], good
        good[good] = ~absent


def _blocks(codec: Codec, buf: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The fixed blocks as rows of bytes; what a shorter one lacks is null."""
    width = codec.block_length
    out = np.tile(np.frombuffer(codec.null_block, np.uint8), (len(starts), 1))
    for n in np.unique(np.minimum(length, width)).tolist():
        own = np.minimum(length, width) == n
        out[own, :n] = buf[(starts[own, None] + np.arange(n)).ravel()].reshape(-1, n)
    return out


def _text(f: layout.Field, buf: np.ndarray, begin: np.ndarray, size: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Texts by their places; empty ones are null."""
    raw, offsets = buf[_spans(begin, size)], np.concatenate([[0], np.cumsum(size)])
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [_validity(size == 0), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())])
    try:
        column = column.cast(pa.large_string())
    except pa.ArrowInvalid:  # not UTF-8
        column = pa.array([None if x is None else x.decode("utf-8", "replace") for x in column.to_pylist()], pa.large_string())
    if f.default is not None and column.null_count:
        column = pc.fill_null(column, f.default)
    return column.cast(kind)


def _walked(codec: Codec, data: pa.Array, fields: list[str], kinds: dict[str, pa.DataType], header: bool, missing_group: str) -> tuple[list[pa.Array], pa.Array]:
    """The same record by record."""
    values, codes, details = [], [], []
    for x in data.to_pylist():
        try:
            record = layout.unpack(codec, x, header, missing_group) if x is not None else {}
            values.append([record.get(n) for n in fields])
            codes.append(None)
            details.append(None)
        except WireError as e:
            values.append([None] * len(fields))
            codes.append(e.code)
            details.append(e.detail)
    columns = list(zip(*values, strict=True)) if values else [()] * len(fields)
    return [pa.array([_plain(v, kinds[n]) for v in c], kinds[n]) for n, c in zip(fields, columns, strict=True)], _errors(codes, details)


def _vector(codec: Codec, f: layout.Field, raw: np.ndarray, lead: int, kind: pa.DataType) -> pa.Array:
    import packrow.types as pt

    rows = len(raw)
    if f.virtual:
        return pa.array([f.default] * rows, kind)
    if f.presence == "constant":
        return pa.array([f.value] * rows, kind)
    t, at = f.wire_type, lead + codec.offsets[f.name]
    part = raw[:, at : at + t.size]
    if _fast(t):
        column = _read(t, part, codec.endian, kind)
    else:
        flat = np.ascontiguousarray(part).tobytes()
        column = pa.array([_plain(t.unpack(flat, i * t.size, codec.endian), kind) for i in range(rows)], kind)
    if f.default is not None and column.null_count and not isinstance(t, pt.Bitset):
        column = pc.fill_null(column, pa.scalar(f.default, kind))
    return column if column.type == kind else column.cast(kind)


def _plain(value, kind: pa.DataType):
    """Decimals at the column's scale; inside lists and structs too."""
    import decimal

    if value is None:
        return None
    if pa.types.is_decimal(kind):
        return decimal.Decimal(value).quantize(decimal.Decimal(1).scaleb(-kind.scale), context=decimal.Context(prec=60))
    if pa.types.is_list(kind):
        return [_plain(v, kind.value_type) for v in value]
    if pa.types.is_struct(kind):
        return {kind.field(i).name: _plain(value.get(kind.field(i).name), kind.field(i).type) for i in range(kind.num_fields)}
    return value


def decode(df: DataFrame, codec: Codec, column: str = "data", keep: list[str] | None = None, fields: list[str] | None = None, header: bool = True, strict: bool = False, missing_group: str = "error") -> DataFrame:
    """``keep`` columns, the decoded ``fields`` (all by default) and ``error`` (code, detail), null where a record is good.

    A null record gives nulls without an error. ``strict`` fails the job at the first error and drops the
    column. Filters on other columns belong before this call: they aren't pushed below Arrow batches.
    """
    keep, names = list(keep or []), list(fields or codec.struct_type().names)
    schema = codec.struct_type()
    out = T.StructType([*(df.schema[k] for k in keep), *(schema[n] for n in names), T.StructField("error", ERROR)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
            columns, errors = decode_batch(codec, data, names, header, missing_group)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in keep), *columns, errors], names=[*keep, *names, "error"])

    found = df.select(*dict.fromkeys([*keep, column])).mapInArrow(run, out)
    if strict:
        fail = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.col("error.code"), F.lit(": "), F.col("error.detail"))).cast("boolean")).otherwise(F.lit(True))
        found = found.where(fail).drop("error")
    return codec.after_decode(found) if codec.after_decode is not None else found


def header_of(data: bytes) -> dict:
    """The header of one record as a dict, for the driver."""
    if len(data) < 8:
        raise WireError("insufficient_data", f"{len(data)} of 8 header bytes")
    return dict(zip(("block_length", "template_id", "schema_id", "version"), HEADER.unpack_from(data), strict=True))
