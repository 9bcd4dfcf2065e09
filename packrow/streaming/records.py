"""Records in streams. Everything that reads bytes is stateless, so it works on a stream as it does on a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from packrow.layout import Codec
from packrow.operators import access, predicates
from packrow.sources import arrowio


def decoded(stream: DataFrame, codec: Codec, column: str = "data", keep: list[str] | None = None, fields: list[str] | None = None) -> DataFrame:
    """Decoded records of a stream, with their errors as data."""
    return arrowio.decode(stream, codec, column, keep, fields)


def matching(stream: DataFrame, codec: Codec, *conditions: Callable, column: str = "data") -> DataFrame:
    """The records of a stream that match, without decoding the rest."""
    return stream.where(predicates.matcher(codec, *conditions)(F.col(column)))


def windowed_counts(stream: DataFrame, codec: Codec, time_field: str, by: str, window: str, delay: str, column: str = "data") -> DataFrame:
    """Counts by a field in tumbling windows of a time field; what is later than ``delay`` is left out by the watermark.

    State is one row for each open window and value.
    """
    b = F.col(column)
    at = access.get(codec, b, time_field)
    t = codec.field(time_field).type
    at = at if t.spark == "timestamp" else F.timestamp_micros(at if t.name.endswith("us") else F.floor(at / 1000).cast("bigint"))
    rows = stream.select(at.alias("at"), access.get(codec, b, by).alias(by)).withWatermark("at", delay)
    return rows.groupBy(F.window("at", window), by).agg(F.count("*").alias("n"))


def measured(df: DataFrame, name: str, column: str = "data") -> DataFrame:
    """``df`` with metrics of its records (count, bytes, nulls) that a listener reads under ``name``."""
    return df.observe(name, F.count("*").alias("records"), F.sum(F.octet_length(column)).alias("bytes"), F.count(F.when(F.col(column).isNull(), 1)).alias("nulls"))


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything that is there now, written once to Parquet with exactly-once files."""
    return stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
