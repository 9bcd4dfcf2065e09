"""The record types that the catalogue's queries use, and the driver tables as such records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packrow.layout import Batch, Codec, Field, Group
from packrow.sources import arrowio
from packrow.types import Bitset, CharArray, Enum, PrefixedId, Scaled

SIDE = Enum("OrderSide", {"buy": 0, "sell": 1, "cancel": 2})
RETURN_FLAG = Enum("ReturnFlag", {"A": 0, "N": 1, "R": 2})
LINE_STATUS = Enum("LineStatus", {"F": 10, "O": 300}, "u16")
EVENT_TYPE = Enum("EventType", {"click": 0, "view": 1, "purchase": 2})
ROLES = Bitset("Roles", {"admin": 0, "moderator": 1, "verified": 2, "banned": 3})
CUSTOMER_ID = PrefixedId("cust", 7)

ORDER = Codec("OrderCreated", [
    Field("order_id", "uuid"), Field("user_id", "u64"), Field("side", SIDE), Field("price", "u64"), Field("quantity", "u32"),
    Field("timestamp", "timestamp_us"), Field("flags", "u8"), Field("symbol", "string16"),
], template_id=1, schema_id=100, version=2)
TICKET = Codec("Ticket", [Field("id", "i64", "required"), Field("price", "u64"), Field("side", SIDE), Field("rank", "i32"), Field("small", "u16", default=7)], template_id=2, schema_id=100)
LINE = Codec("Line", [
    Field("order_key", "i64"), Field("part", "u64"), Field("supplier", "u32"), Field("line", "u16"), Field("quantity", "i16"), Field("price", Scaled(2)), Field("tax", "f64"),
    Field("discount", "f32"), Field("return_flag", RETURN_FLAG), Field("status", LINE_STATUS), Field("ship", "datetime_us"), Field("unit", "decimal"),
], template_id=3, schema_id=100, version=1)
EVENT = Codec("Event", [
    Field("event_id", "i64"), Field("at", "timestamp_us"), Field("user_id", "u32"), Field("kind", EVENT_TYPE), Field("value", "f64"), Field("roles", ROLES), Field("ok", "bool"), Field("props", "string32"),
], template_id=4, schema_id=100)
SPAN = Codec("Span", [Field("span_id", "u64"), Field("flags", "u32"), Field("kind", "u8"), Field("start_ns", "timestamp_ns"), Field("end_ns", "timestamp_ns"), Field("name", "string8")], template_id=9900, schema_id=99)
ENVELOPE = Codec("Envelope", [Field("span_id", "u64"), Field("flags", "u32"), Field("message_type", "u16")], template_id=9901, schema_id=99)
CUSTOMER = Codec("Customer", [
    Field("id", CUSTOMER_ID), Field("key", "uuid_string"), Field("segment", CharArray(8)), Field("balance", "decimal"), Field("name", "string8"), Field("note", "string16"), Field("text", "string32"),
], template_id=5, schema_id=100)
ENTRY = Codec("LineEntry", [Field("part", "u64"), Field("quantity", "u32"), Field("line", "u8"), Field("returned", "bool")], template_id=6, schema_id=100)
BOOK = Codec("OrderBook", [Field("order_key", "i64"), Field("note", "string16")], template_id=7, schema_id=100, groups=[Group("lines", of=ENTRY), Group("parts", of="u64")])
BILL = Codec("Bill", [Field("order_key", "i64"), Field("done", "bool")], template_id=8, schema_id=100, groups=[Group("bills", (Field("amount", "u64"), Field("flag", "string16")), framed=True), Group("names", of="string16")])
CLICK = Codec("Click", [Field("event_id", "u64"), Field("user_id", "u32")], template_id=20, schema_id=70)
BUY = Codec("Buy", [Field("event_id", "u64"), Field("user_id", "u32"), Field("cents", "u64"), Field("level", "u8")], template_id=21, schema_id=70)


def box(strategy: str) -> Codec:
    return Codec("Box_" + strategy, [Field("user_id", "i64")], template_id=30, schema_id=70, batches=[Batch("commands", (CLICK, BUY), strategy)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_uuid(c: str) -> Column:
    return F.unhex(F.lpad(F.hex(c), 32, "0"))


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders")
    return t.select(
        "o_orderkey", key_uuid("o_orderkey").alias("order_id"), F.col("o_custkey").cast("decimal(20,0)").alias("user_id"),
        F.when(F.col("o_orderstatus") == "O", "buy").when(F.col("o_orderstatus") == "F", "sell").otherwise("cancel").alias("side"), cents("o_totalprice").cast("decimal(20,0)").alias("price"),
        (F.col("o_orderkey") % 1000).alias("quantity"), micros("o_orderdate").alias("timestamp"), (F.col("o_orderkey") % 8).cast("smallint").alias("flags"), F.col("o_orderpriority").alias("symbol"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        F.col("l_orderkey").alias("order_key"), F.col("l_partkey").cast("decimal(20,0)").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_linenumber").alias("line"),
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity").cast("int")).alias("quantity"), (cents("l_extendedprice") / 100).cast("decimal(38,2)").alias("price"), F.col("l_tax").alias("tax"),
        F.col("l_discount").cast("float").alias("discount"), F.col("l_returnflag").alias("return_flag"), F.col("l_linestatus").alias("status"), F.col("l_shipdate").cast("timestamp").alias("ship"),
        (cents("l_extendedprice").cast("decimal(20,0)") / 100).cast("decimal(38,8)").alias("unit"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null users by rule, flags from the id, and types that the enum doesn't know written as their numbers."""
    t = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "77").when(F.col("event_type") == "signup", F.lit(None)).otherwise(F.col("event_type"))
    roles = F.array_compact(F.array(*[F.when(F.bit_get(F.col("event_id") % 16, F.lit(i)) == 1, F.lit(n)) for n, i in ROLES.flags.items()]))
    return t.select(
        "event_id", micros("ts").alias("at"), F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("user_id"), kind.alias("kind"), F.col("value"), roles.alias("roles"),
        F.when(F.col("event_id") % 3 == 0, F.lit(True)).when(F.col("event_id") % 3 == 1, F.lit(False)).alias("ok"), F.col("props"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events")
    start = micros("ts") * 1000
    return t.select(
        (F.col("event_id") + 1).cast("decimal(20,0)").alias("span_id"), F.col("event_id").alias("flags"), (F.col("event_id") % 5).cast("smallint").alias("kind"),
        start.alias("start_ns"), (start + F.round(F.col("value") * 100).cast("bigint") * 1000).alias("end_ns"), F.col("event_type").alias("name"),
    )


def encoded(rows: DataFrame, codec: Codec, keep: list[str] = (), header: bool = True) -> DataFrame:
    return arrowio.encode(rows, codec, keep=list(keep), header=header)


def line_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order with its lines, sorted by every column, so that their order is defined."""
    t = table(spark, sf_dir, "lineitem")
    entry = F.struct(F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"), F.col("l_quantity").cast("bigint").alias("q"), (F.col("l_returnflag") == "R").alias("r"), cents("l_extendedprice").alias("c"), F.col("l_returnflag").alias("f"))
    grouped = t.groupBy(F.col("l_orderkey").alias("order_key")).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return grouped.select(
        "order_key", F.concat(F.lit("order "), F.col("order_key")).alias("note"),
        F.transform("e", lambda x: F.struct(x["pk"].cast("decimal(20,0)").alias("part"), x["q"].alias("quantity"), x["ln"].cast("smallint").alias("line"), x["r"].alias("returned"))).alias("lines"),
        F.transform("e", lambda x: x["pk"].cast("decimal(20,0)")).alias("parts"), (F.col("order_key") % 2 == 0).alias("done"),
        F.transform("e", lambda x: F.struct(x["c"].cast("decimal(20,0)").alias("amount"), x["f"].alias("flag"))).alias("bills"), F.transform("e", lambda x: x["f"]).alias("names"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each user with their clicks and purchases in order of event."""
    t = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase"))
    click = F.col("event_type") == "click"
    entry = F.struct(
        F.col("event_id").alias("seq"), F.when(click, 0).otherwise(1).cast("smallint").alias("tag"),
        F.when(click, F.struct(F.col("event_id").cast("decimal(20,0)").alias("event_id"), F.col("user_id").alias("user_id"))).alias("Click"),
        F.when(~click, F.struct(F.col("event_id").cast("decimal(20,0)").alias("event_id"), F.col("user_id").alias("user_id"), cents("value").cast("decimal(20,0)").alias("cents"), (F.col("event_id") % 4).cast("smallint").alias("level"))).alias("Buy"),
    )
    return t.groupBy("user_id").agg(F.sort_array(F.collect_list(entry)).alias("commands"))
