"""Records of several versions and kinds: padding, routing by type, transcoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packrow.functions import bytesx as bx
from packrow.layout import Codec
from packrow.operators import access, validate
from packrow.sources import arrowio
from packrow.types import WireError


def padded(codec: Codec, b: Column) -> Column:
    """A framed record whose block has the codec's full length: what an old writer lacked is null."""
    n, null = bx.unsigned(b, 0, 2).cast("int"), bx.literal(codec.null_block)
    full = F.concat(bx.literal(codec.block_length.to_bytes(2, "little")), F.substring(b, 3, 6), F.substring(b, 9, n), F.substring(null, n + 1, codec.block_length), bx.tail(b, n + 8))
    return F.when(n < codec.block_length, full).otherwise(b)


class Registry:
    """Codecs by (schema id, template id) and by name; two codecs for one key are refused."""

    def __init__(self, codecs: list[Codec] = ()):
        self.codecs: dict[tuple[int, int], Codec] = {}
        self.enums: dict[str, object] = {}
        self.custom: dict[str, object] = {}
        for c in codecs:
            self.register(c)

    def register(self, codec: Codec) -> Codec:
        key = (codec.schema_id, codec.template_id)
        if key in self.codecs and self.codecs[key] is not codec:
            raise WireError("dispatch_conflict", f"{self.codecs[key].name} and {codec.name} share {key}")
        self.codecs[key] = codec
        for t in codec.types_used():
            (self.enums if type(t).__name__ == "Enum" else self.custom)[t.name] = t
        return codec

    def lookup(self, schema_id: int, template_id: int) -> Codec:
        if (schema_id, template_id) not in self.codecs:
            raise WireError("unknown_message", f"{schema_id}/{template_id}")
        return self.codecs[schema_id, template_id]

    def by_name(self, name: str) -> Codec:
        for c in self.codecs.values():
            if c.name == name:
                return c
        raise WireError("unknown_type", name)

    def enum(self, name: str):
        return self.enums[name]

    def custom_type(self, name: str):
        return self.custom[name]

    def list_codecs(self, where: Callable[[Codec], bool] | None = None, schema_id: int | None = None) -> list[Codec]:
        found = sorted(self.codecs.values(), key=lambda c: (c.schema_id, c.template_id))
        return [c for c in found if (where is None or where(c)) and (schema_id is None or c.schema_id == schema_id)]

    def find_by_field(self, name: str) -> list[Codec]:
        return self.list_codecs(lambda c: any(f.name == name for f in c.fields))

    def all_fields(self) -> list[str]:
        return sorted({f.name for c in self.codecs.values() for f in c.fields})

    def dispatch_table(self) -> dict[tuple[int, int], str]:
        return {k: c.name for k, c in self.codecs.items()}

    def validate(self) -> list[str]:
        """Names that several codecs bear."""
        names = [c.name for c in self.codecs.values()]
        return sorted({n for n in names if names.count(n) > 1})

    def clear(self) -> None:
        self.codecs.clear()

    def summary(self) -> dict[str, int]:
        found = list(self.codecs.values())
        return {"codecs": len(found), "fields": sum(len(c.fields) for c in found), "block_bytes": sum(c.block_length for c in found)}

    def table(self, spark) -> DataFrame:
        """One row for each codec: a small table for reports."""
        rows = [(c.name, c.schema_id, c.template_id, c.version, len(c.fields), c.block_length) for c in self.list_codecs()]
        return spark.createDataFrame(rows, "name string, schema_id int, template_id int, version int, n_fields int, block_length int")

    # -- mixed columns ---------------------------------------------------------------------------------------------

    def type_name(self, b: Column) -> Column:
        """The name of the codec a record belongs to, null for none."""
        key = bx.cut(b, 2, 4)
        out = F.lit(None).cast("string")
        for (schema, template), c in self.codecs.items():
            out = F.when(key == bx.literal(template.to_bytes(2, "little") + schema.to_bytes(2, "little")), F.lit(c.name)).otherwise(out)
        return out

    def error(self, b: Column) -> Column:
        """insufficient_data, unknown_message, version_too_new or null."""
        version = F.lit(None).cast("int")
        for c in self.codecs.values():
            version = F.when(self.type_name(b) == c.name, F.lit(c.version)).otherwise(version)
        return F.when(F.coalesce(F.octet_length(b) < 8, F.lit(True)), F.lit("insufficient_data")).when(self.type_name(b).isNull(), F.lit("unknown_message")).when(bx.unsigned(b, 6, 2) > version, F.lit("version_too_new"))

    def decode(self, df: DataFrame, column: str = "data", keep: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
        """``keep``, type, error and one struct column for each codec, set where the record is its own.

        Records are routed by their header before anything is decoded, and all kinds are decoded in one pass over
        the table: the input is read once, however many codecs there are.
        """
        keep = list(keep or [])
        chosen = [self.by_name(n) for n in names] if names else self.list_codecs()
        import pyarrow as pa
        from pyspark.sql import types as T
        from pyspark.sql.pandas.types import to_arrow_type

        tagged = df.select(*dict.fromkeys([*keep, column]), self.type_name(F.col(column)).alias("_type"), self.error(F.col(column)).alias("_error"))
        out = T.StructType([*(df.schema[k] for k in keep), T.StructField("type", T.StringType()), T.StructField("error", arrowio.ERROR), *(T.StructField(c.name, c.struct_type()) for c in chosen)])

        def run(batches):
            for batch in batches:
                col = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: E731, B023
                data, kinds, errors = col(column).to_pylist(), col("_type").to_pylist(), col("_error").to_pylist()
                codes, details = list(errors), [None] * len(data)
                made = []
                for c in chosen:
                    at = [i for i, k in enumerate(kinds) if k == c.name and errors[i] is None]
                    fields = c.struct_type().names
                    arrays, bad = arrowio.decode_batch(c, pa.array([data[i] for i in at], pa.binary()), fields)
                    for i, e in zip(at, bad.to_pylist(), strict=True):
                        if e is not None:
                            codes[i], details[i] = e["code"], e["detail"]
                    own = pa.StructArray.from_arrays(arrays, fields=list(to_arrow_type(c.struct_type()))) if fields else pa.nulls(len(at))
                    index: list = [None] * len(data)
                    for k, i in enumerate(at):
                        index[i] = k if codes[i] is None else None
                    made.append(own.take(pa.array(index, pa.int32())))
                yield pa.RecordBatch.from_arrays([*(col(k) for k in keep), col("_type"), arrowio._errors(codes, details), *made], names=[*keep, "type", "error", *(c.name for c in chosen)])

        return tagged.mapInArrow(run, out)

    def to_json(self, b: Column, name: Column | None = None) -> Column:
        """Every record as JSON by its own type, or by the name given for each row; unknown ones say so."""
        own = self.type_name(b) if name is None else name
        label = F.coalesce(own, F.lit("null"))
        out = F.to_json(F.struct(F.concat(F.lit("unknown type: "), label).alias("_error")))
        for c in self.codecs.values():
            out = F.when(own == c.name, json_of(c, b)).otherwise(out)
        return out


def json_of(codec: Codec, b: Column, header: bool = True, pretty: bool = False) -> Column:
    """A record's fields as JSON with nulls; raw uuids are shown in hex."""
    fields = []
    for f in codec.fields:
        value = access.get(codec, b, f.name, header)
        fields.append((F.lower(F.hex(value)) if f.type.spark == "binary" else value).alias(f.name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false", "pretty": str(pretty).lower()})


to_json = json_of


def from_json(text: Column, codec: Codec) -> Column:
    """A struct of the codec's fields from JSON; what is missing is null. Encode it with arrowio.encode."""
    return F.from_json(text, codec.struct_type())


class Transcoder:
    """Records of one codec to records of another: target field -> source field, or (source field, function)."""

    def __init__(self, source: Codec, target: Codec, fields: dict[str, str | tuple[str, Callable[[Column], Column]]], validate_mode: str | bool | None = None):
        self.source, self.target, self.fields = source, target, fields
        self.mode = {True: "both", None: False}.get(validate_mode, validate_mode) if not isinstance(validate_mode, str) else validate_mode
        if self.mode not in (False, "source", "target", "both"):
            raise WireError("unknown_option", str(validate_mode))
        for t, s in fields.items():
            target.field(t)
            source.field(s if isinstance(s, str) else s[0])

    def require_all(self) -> Transcoder:
        """Every target field must be mapped."""
        if missing := [f.name for f in self.target.fields if f.name not in self.fields and f.presence != "constant" and not f.virtual]:
            raise WireError("unmapped_fields", ", ".join(missing))
        return self

    def values(self, b: Column) -> dict[str, Column]:
        out = {}
        for t, s in self.fields.items():
            name, change = (s, None) if isinstance(s, str) else s
            value = access.get(self.source, b, name)
            out[t] = (change(value) if change else value).cast(self.target.field(t).type.spark)
        return out

    def __call__(self, df: DataFrame, column: str = "data", out: str = "data") -> DataFrame:
        """``df`` with the transcoded record, and ``errors`` (empty where valid) if validation is on; both are narrow."""
        b, values = F.col(column), self.values(F.col(column))
        errors = []
        if self.mode in ("source", "both"):
            errors.append(validate.errors(self.source, {f.name: access.get(self.source, b, f.name) for f in self.source.fields}))
        if self.mode in ("target", "both"):
            errors.append(validate.errors(self.target, values))
        made = access.encode_columns(self.target, {t: v for t, v in values.items()})
        if not errors:
            return df.withColumn(out, made)
        found = F.array_distinct(F.concat(*errors))
        return df.withColumn("errors", found).withColumn(out, F.when(F.size("errors") == 0, made))
