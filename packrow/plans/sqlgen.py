"""The SQL surface: readers as temporary functions, and for each codec a table function and JSON functions.

Everything is plain Spark SQL text, so an installed function inlines into the query that calls it: a
``LATERAL read_x(t.data)`` is a projection, and only the columns a query names are computed.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import SparkSession

from packrow.layout import Codec, Field
from packrow.types import Bitset, Bool, CharArray, Datetime, Decimal, Enum, Float, Int, PrefixedId, Scaled, Text, Timestamp, Uuid, WireError

_HEX = "hex(substring(d, p + 1, {n}))"


def _le(n: int, base: int = 10) -> str:
    h = _HEX.format(n=n)
    digits = h if n == 1 else "concat(" + ", ".join(f"substring({h}, {2 * i + 1}, 2)" for i in reversed(range(n))) + ")"
    return f"conv({digits}, 16, {base})"


def _dash(expr: str) -> str:
    h = f"lower(hex({expr}))"
    return "concat_ws('-', " + ", ".join(f"substring({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + ")"


def _inside(n: int, expr: str) -> str:
    """Null beyond the end of the value."""
    return f"CASE WHEN octet_length(d) >= p + {n} THEN {expr} END"


def _ieee(exponent: str, low: str, negative: str, bits: int, last: int, bias: int) -> str:
    """A floating number from its parts; NaN is null."""
    sign = f"(CASE WHEN {negative} THEN -1D ELSE 1D END)"
    return f"CASE WHEN {exponent} = {last} THEN CASE WHEN {low} = 0 THEN {sign} * double('Infinity') END WHEN {exponent} = 0 THEN {sign} * {low} * pow(2D, {1 - bias}D) ELSE {sign} * CAST({low} + {1 << bits} AS DOUBLE) * pow(2D, {exponent} - {bias}) END"


def readers(prefix: str = "") -> list[str]:
    """One statement for each byte reader; all take (bytes, zero-based place)."""
    f = lambda name, kind, body: f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(d BINARY, p INT) RETURNS {kind} RETURN {body}"
    out = [f("read_u8", "SMALLINT", _inside(1, f"CAST({_le(1)} AS SMALLINT)")), f("read_u16", "INT", _inside(2, f"CAST({_le(2)} AS INT)")), f("read_u32", "BIGINT", _inside(4, f"CAST({_le(4)} AS BIGINT)")), f("read_u64", "DECIMAL(20,0)", _inside(8, f"CAST({_le(8)} AS DECIMAL(20,0))"))]
    for bits, kind in ((8, "SMALLINT"), (16, "INT"), (32, "BIGINT")):
        v = f"CAST({_le(bits // 8)} AS BIGINT)"
        out.append(f(f"read_i{bits}", kind, _inside(bits // 8, f"CAST({v} - CASE WHEN {v} >= {1 << (bits - 1)} THEN {1 << bits} ELSE 0 END AS {kind})")))
    out.append(f("read_i64", "BIGINT", _inside(8, f"CAST({_le(8, -10)} AS BIGINT)")))
    raw = "substring(d, p + 1, 16)"
    out.append(f("read_uuid", "STRING", _inside(16, _dash(raw))))
    out.append(f("read_uuid_nullable", "STRING", _inside(16, f"nullif({_dash(raw)}, '00000000-0000-0000-0000-000000000000')")))
    mantissa = f"CAST({_le(8, -10)} AS BIGINT)"
    exponent = "CAST(conv(hex(substring(d, p + 9, 1)), 16, 10) AS INT)"
    scale = f"({exponent} - CASE WHEN {exponent} >= 128 THEN 256 ELSE 0 END)"
    powers = ", ".join(f"CAST(1{'0' * k if k > 0 else ''}{'E-' + str(-k) if k < 0 else ''} AS DECIMAL(18,8))" for k in range(-8, 10))
    out.append(f("read_decimal", "DECIMAL(38,8)", _inside(9, f"CASE WHEN {mantissa} = -9223372036854775807 - 1 THEN NULL ELSE CAST(CAST({mantissa} AS DECIMAL(19,0)) * element_at(array({powers}), {scale} + 9) AS DECIMAL(38,8)) END")))
    out.append(f("read_timestamp_us", "TIMESTAMP", _inside(8, f"timestamp_micros(nullif({mantissa}, 0L))")))
    out.append(f("read_timestamp_ns", "TIMESTAMP", _inside(8, f"timestamp_micros(CAST(floor(CAST(nullif({mantissa}, 0L) AS DECIMAL(19,0)) / 1000) AS BIGINT))")))
    out.append(f("read_prefixed_id", "STRING", _inside(17, f"nullif({_dash('substring(d, p + 2, 16)')}, '00000000-0000-0000-0000-000000000000')")))
    out.append(f("read_prefixed_id_tag", "SMALLINT", _inside(1, f"CAST({_le(1)} AS SMALLINT)")))
    out.append(f("read_bool", "BOOLEAN", _inside(1, f"CASE {_le(1)} WHEN '0' THEN false WHEN '255' THEN NULL ELSE true END")))
    for name, n in (("read_string8", 1), ("read_string16", 2), ("read_string32", 4)):
        length = f"CAST({_le(n)} AS INT)"
        out.append(f(name, "STRING", _inside(n, f"CASE WHEN {length} > 0 AND octet_length(d) >= p + {n} + {length} THEN decode(substring(d, p + {n + 1}, {length}), 'UTF-8') END")))
    h8 = "concat(" + ", ".join(f"substring({_HEX.format(n=8)}, {2 * i + 1}, 2)" for i in reversed(range(8))) + ")"
    top, low = f"CAST(conv(substring({h8}, 1, 3), 16, 10) AS INT)", f"CAST(conv(substring({h8}, 4, 13), 16, 10) AS BIGINT)"
    out.append(f("read_f64", "DOUBLE", _inside(8, _ieee(f"({top} % 2048)", low, f"{top} >= 2048", 52, 2047, 1075))))
    whole = f"CAST({_le(4)} AS BIGINT)"
    out.append(f("read_f32", "FLOAT", _inside(4, f"CAST({_ieee(f'(shiftright({whole}, 23) % 256)', f'({whole} % 8388608)', f'{whole} >= 2147483648', 23, 255, 150)} AS FLOAT)")))
    header = ", ".join(f"CAST(conv(concat(substring(hex(substring(d, {a}, 2)), 3, 2), substring(hex(substring(d, {a}, 2)), 1, 2)), 16, 10) AS INT)" for a in (1, 3, 5, 7))
    out.append(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}read_header(d BINARY) RETURNS TABLE(block_length INT, template_id INT, schema_id INT, version INT) RETURN SELECT {header}")
    return out


def mangled(name: str) -> str:
    """A name as SQL functions bear it."""
    return re.sub(r"[^a-z0-9_]", "_", name.lower())


def _sql_type(f: Field) -> str:
    t = f.type
    return "STRING" if t.spark == "binary" else t.spark.upper().replace("ARRAY<STRING>", "ARRAY<STRING>")


def _read(codec: Codec, f: Field, at: str) -> str:
    """SQL that reads a field at a place; null for its sentinel and where an old record lacks it."""
    t = f.wire_type
    if codec.endian != "little" and isinstance(t, Int | Float | Scaled | Enum):
        raise WireError("unsupported", f"{f.name}: SQL functions read little-endian records")
    if isinstance(t, Scaled):
        unit = f"1E-{t.scale}" if t.scale else "1"
        body = f"CAST(CAST(nullif(read_{t.inner.name}(d, {at}), {t.inner.sentinel if t.inner.name == 'u64' else '-9223372036854775807L - 1L'}) AS DECIMAL(20,0)) * CAST({unit} AS DECIMAL({t.scale + 1},{t.scale})) AS {t.spark.upper()})"
    elif isinstance(t, Enum):
        number = f"read_{t.inner.name}(d, {at})"
        cases = " ".join(f"WHEN {v} THEN '{k}'" for k, v in t.values.items())
        body = f"CASE {number} {cases} WHEN {t.inner.sentinel} THEN NULL ELSE CAST({number} AS STRING) END"
    elif isinstance(t, Bitset):
        number = f"read_{t.inner.name}(d, {at})" if t.inner.name != "u64" else f"read_i64(d, {at})"
        body = "array_compact(array(" + ", ".join(f"CASE WHEN bit_get(CAST({number} AS BIGINT), {bit}) = 1 THEN '{k}' END" for k, bit in t.flags.items()) + "))"
    elif isinstance(t, Decimal):
        body = f"CAST(read_decimal(d, {at}) AS {t.spark.upper()})"
    elif isinstance(t, Bool):
        body = f"read_bool(d, {at})"
    elif isinstance(t, Uuid):
        body = f"read_uuid_nullable(d, {at})"
    elif isinstance(t, PrefixedId):
        body = f"'{t.prefix}-' || read_prefixed_id(d, {at})"
    elif isinstance(t, CharArray):
        body = f"substring_index(decode(substring(d, {at} + 1, {t.size}), 'UTF-8'), chr(0), 1)"
    elif isinstance(t, Datetime):
        body = f"read_timestamp_{t.unit}(d, {at})"
    elif isinstance(t, Timestamp):
        body = f"nullif(read_i64(d, {at}), 0L)"
    elif isinstance(t, Text):
        return f"read_string{8 * t.prefix}(d, {at})"
    elif isinstance(t, Float):
        body = f"read_f{8 * t.size}(d, {at})"
    elif isinstance(t, Int):
        low = "(-9223372036854775807L - 1L)" if t.name == "i64" else str(t.sentinel)
        body = f"CAST(nullif(read_{t.name}(d, {at}), {low}) AS {t.spark.upper()})"
    else:
        raise WireError("unsupported", f"{f.name}: {t.name} has no SQL reader")
    body = f"CASE WHEN read_u16(d, 0) >= {codec.offsets[f.name] + t.size} THEN {body} END"
    return f"coalesce({body}, {_literal(f)})" if f.default is not None else body


def _literal(f: Field) -> str:
    v = f.default
    return f"CAST({repr(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else v} AS {_sql_type(f)})"


def _columns(codec: Codec) -> list[tuple[Field, str]]:
    """(field, expression) of all fields; length-prefixed ones are found by stepping over what stands before."""
    out = []
    at = "(8 + read_u16(d, 0))"
    for g in codec.groups:
        if g.framed:
            at = ""
            break
        at = f"({at} + 4 + read_u16(d, {at}) * read_u16(d, {at} + 2))"
    for b in codec.batches:
        at = at and (f"({at} + 4 + read_u16(d, {at}) * read_u16(d, {at} + 2))" if b.strategy == "padded_union" else f"({at} + 4 + CAST(read_u32(d, {at}) AS INT))" if b.strategy == "typed_frames" else "")
    for f in codec.fields:
        if f.virtual:
            continue
        if f.presence == "constant":
            v = f.value
            out.append((f, f"CAST({repr(v) if isinstance(v, str) else v} AS {_sql_type(f)})"))
        elif not f.is_var:
            out.append((f, _read(codec, f, str(8 + codec.offsets[f.name]))))
        elif at:
            out.append((f, _read(codec, f, at)))
            size = {1: "read_u8", 2: "read_u16", 4: "read_u32"}[f.wire_type.prefix]
            at = f"({at} + {f.wire_type.prefix} + CAST({size}(d, {at}) AS INT))"
        else:
            raise WireError("unsupported", f"{f.name} stands behind a framed group; decode the records instead")
    return out


def generate(codec: Codec) -> list[str]:
    """read_<name>: a table function with a column for each field; read_<name>_json: a record as JSON."""
    name, columns = mangled(codec.name), _columns(codec)
    table = ", ".join(f"`{f.name}` {_sql_type(f)}" for f, _ in columns)
    values = ", ".join(f"{e} AS `{f.name}`" for f, e in columns)
    pairs = ", ".join(f"'{f.name}', {e}" for f, e in columns)
    return [
        f"CREATE OR REPLACE TEMPORARY FUNCTION read_{name}(d BINARY) RETURNS TABLE({table}) RETURN SELECT {values}",
        f"CREATE OR REPLACE TEMPORARY FUNCTION read_{name}_json(d BINARY) RETURNS STRING RETURN to_json(named_struct({pairs}), map('ignoreNullFields', 'false'))",
    ]


def generate_all(codecs: list[Codec]) -> list[str]:
    """Readers, every codec's functions by name, and read_any(name, bytes): JSON by the codec's name."""
    ordered = sorted(codecs, key=lambda c: c.name)
    out = readers()
    for c in ordered:
        out += generate(c)
    cases = " ".join(f"WHEN '{c.name}' THEN read_{mangled(c.name)}_json(d)" for c in ordered)
    unknown = "to_json(named_struct('_error', 'unknown type: ' || coalesce(n, 'null')))"
    out.append(f"CREATE OR REPLACE TEMPORARY FUNCTION read_any(n STRING, d BINARY) RETURNS STRING RETURN {f'CASE n {cases} ELSE {unknown} END' if cases else unknown}")
    return out


def enum_table(spark: SparkSession, t: Enum):
    """(id, name) of an enum, for joins; it is as small as the enum."""
    return spark.createDataFrame([(v, k) for k, v in t.values.items()], "id int, name string")


def install(spark: SparkSession, codecs: list[Codec]) -> None:
    for statement in generate_all(codecs):
        spark.sql(statement)


def to_file(codecs: list[Codec], path: str | Path, check: bool = False) -> bool:
    """Write all statements; returns whether the file differed. ``check`` writes nothing."""
    text = ";\n\n".join(generate_all(codecs)) + ";\n"
    path = Path(path)
    changed = not path.exists() or path.read_text(encoding="utf-8") != text
    if changed and not check:
        path.write_text(text, encoding="utf-8")
    return changed
