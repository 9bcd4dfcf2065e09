"""Every registered query over encoded records, with its oracle SQL.

Each query encodes a driver table, applies one operator to the bytes, and returns plain columns; the oracle
computes the same from the table itself.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packrow.functions import bytesx as bx
from packrow.functions import scalars
from packrow.layout import Codec, Field, Group
from packrow.operators import access, collections, evolution, predicates, validate
from packrow.plans import breaking, records, sqlgen
from packrow.plans.records import BILL, BOOK, BUY, CLICK, CUSTOMER, ENTRY, ENVELOPE, EVENT, LINE, ORDER, ROLES, SIDE, SPAN, TICKET, encoded
from packrow.sources import arrowio, schema_lang
from packrow.types import Int, Refined

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def data():
    """The column of records."""
    return F.col("data")


def query(oracle: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = oracle
        return f

    return register


def longs(df: DataFrame) -> DataFrame:
    """Integers of any width as bigint, decimals without a fraction too."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select(*[F.col(c).cast("bigint").alias(c) if k in ("smallint", "int", "decimal(20,0)") else F.col(c) for c, k in kinds.items()])


_SIDE = "CASE o_orderstatus WHEN 'O' THEN 'buy' WHEN 'F' THEN 'sell' ELSE 'cancel' END"
_PRICE = "CAST(round(o_totalprice * 100) AS BIGINT)"
_TS = "nullif(epoch_us(o_orderdate), 0)"


def _orders(spark, sf_dir, keep=("o_orderkey",), header=True):
    return encoded(records.orders(spark, sf_dir), ORDER, keep, header)


# -- headers, projections -------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, 46::BIGINT AS block_length, 1::BIGINT AS template_id, 100::BIGINT AS schema_id, 2::BIGINT AS version FROM orders")
def header_parse(spark, sf_dir):
    h = access.header(data())
    return longs(_orders(spark, sf_dir).select("o_orderkey", h["block_length"].alias("block_length"), h["template_id"].alias("template_id"), h["schema_id"].alias("schema_id"), h["version"].alias("version")))


@query("SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'insufficient_data' WHEN o_orderkey % 3 = 1 THEN 'version_exceeded' END AS error, count(*) AS n FROM orders GROUP BY 1")
def header_errors(spark, sf_dir):
    cut = F.when(F.col("o_orderkey") % 3 == 0, F.substring("data", 1, 5)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.substring("data", 1, 6), bx.literal(b"\x09\x00"), F.substring("data", 9, 1000))).otherwise(data())
    return _orders(spark, sf_dir).select(access.header_error(cut, max_block_length=100, max_version=5).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, count(*) OVER () AS n FROM orders WHERE 1 = 1")
def header_built(spark, sf_dir):
    """A header made in SQL equals the one the encoder writes."""
    built = access.header_encode(1, ORDER.block_length, 100, 2)
    rows = _orders(spark, sf_dir).where((F.substring("data", 1, 8) == built) & (access.template_id(data()) == 1))
    total = rows.agg(F.count("*").alias("n"))
    return rows.select("o_orderkey").join(F.broadcast(total))  # one row


_FIXED = f"SELECT o_orderkey, nullif(lpad(lower(to_hex(o_orderkey)), 32, '0'), repeat('0', 32)) AS order_id, o_custkey AS user_id, {_SIDE} AS side, {_PRICE} AS price, o_orderkey % 1000 AS quantity, {_TS} AS timestamp, o_orderkey % 8 AS flags, o_orderpriority AS symbol FROM orders"


def _shown(df):
    return longs(df.withColumn("order_id", F.lower(F.hex("order_id"))))


@query(_FIXED)
def decode_fixed(spark, sf_dir):
    return _shown(arrowio.decode(_orders(spark, sf_dir), ORDER, keep=["o_orderkey"], strict=True))


@query(_FIXED)
def decode_payload_only(spark, sf_dir):
    return _shown(arrowio.decode(_orders(spark, sf_dir, header=False), ORDER, keep=["o_orderkey"], header=False, strict=True))


@query(_FIXED)
def encode_columns(spark, sf_dir):
    """Encoding and decoding in generated code alone."""
    rows = records.orders(spark, sf_dir)
    made = rows.select("o_orderkey", access.encode_columns(ORDER, {f.name: F.col(f.name) for f in ORDER.fields}).alias("data"))
    return _shown(made.select("o_orderkey", *access.decode_columns(ORDER, data())))


@query("SELECT l_orderkey AS order_key, l_partkey AS part, l_suppkey AS supplier, l_linenumber::BIGINT AS line, CASE WHEN l_linenumber <> 3 THEN CAST(l_quantity AS BIGINT) END AS quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS price_cents, l_tax AS tax, CAST(l_discount AS FLOAT)::DOUBLE AS discount, l_returnflag AS return_flag, l_linestatus AS status, epoch_us(l_shipdate) AS ship, CAST(round(l_extendedprice * 100) AS BIGINT) AS unit_cents FROM lineitem")
def decode_lineitem(spark, sf_dir):
    d = arrowio.decode(encoded(records.lines(spark, sf_dir), LINE), LINE, strict=True)
    return longs(d).select("order_key", "part", "supplier", "line", "quantity", (F.col("price") * 100).cast("bigint").alias("price_cents"), "tax", F.col("discount").cast("double").alias("discount"), "return_flag", "status", F.unix_micros("ship").alias("ship"), (F.col("unit") * 100).cast("bigint").alias("unit_cents"))


@query(f"SELECT o_orderkey, {_PRICE} AS price, o_orderkey % 1000 AS quantity, CAST(NULL AS VARCHAR) AS nothing, CAST(NULL AS VARCHAR) AS symbol FROM orders")
def decode_only(spark, sf_dir):
    return longs(_orders(spark, sf_dir).select("o_orderkey", access.decode_only(ORDER, data(), ["price", "quantity", "nothing", "symbol"]).alias("r")).select("o_orderkey", "r.*"))


@query(f"SELECT o_orderkey, {_PRICE} AS price, {_SIDE} AS side, o_orderpriority AS symbol FROM orders")
def get_field(spark, sf_dir):
    return longs(_orders(spark, sf_dir).select("o_orderkey", access.get(ORDER, data(), "price").alias("price"), access.get(ORDER, data(), "side").alias("side"), access.get(ORDER, data(), "symbol").alias("symbol")))


@query(f"SELECT o_orderkey, {_PRICE} AS price FROM orders")
def get_by_spec(spark, sf_dir):
    kind, at, endian = ORDER.field_spec("price")
    return longs(_orders(spark, sf_dir).select("o_orderkey", access.read(data(), kind, at, endian).alias("price")))


@query("SELECT event_id, CASE WHEN user_id % 10 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 3 = 0 THEN true WHEN event_id % 3 = 1 THEN false END AS ok FROM events")
def null_sentinels(spark, sf_dir):
    e = encoded(records.events(spark, sf_dir), EVENT)
    return longs(e.select(access.get(EVENT, data(), "event_id").alias("event_id"), access.get(EVENT, data(), "user_id").alias("user_id"), access.get(EVENT, data(), "ok").alias("ok")))


@query("SELECT event_id, CASE WHEN user_id % 10 <> 0 THEN user_id ELSE 4294967295 END AS user_id FROM events WHERE event_type = 'click'")
def match_raw(spark, sf_dir):
    e = encoded(records.events(spark, sf_dir), EVENT)
    m = e.select(access.match_raw(EVENT, data(), ["event_id", "user_id"], kind="click").alias("m"))
    return longs(m.where("m.matched").select("m.event_id", "m.user_id"))


@query("SELECT event_id FROM events WHERE user_id % 10 = 0")
def match_raw_null(spark, sf_dir):
    """A literal of null matches the sentinel."""
    e = encoded(records.events(spark, sf_dir), EVENT)
    return e.select(access.match_raw(EVENT, data(), ["event_id"], user_id=None).alias("m")).where("m.matched").select("m.event_id")


# -- predicates and comparisons -----------------------------------------------------------------------------------------


@query("SELECT event_id + 1 AS span_id FROM events WHERE event_id % 5 = 3")
def match_eq(spark, sf_dir):
    s = encoded(records.spans(spark, sf_dir), SPAN)
    return longs(predicates.where(s, SPAN, lambda f: f.kind == 3, select=["span_id"]))


@query("SELECT event_id + 1 AS span_id FROM events WHERE event_id % 2 = 1")
def match_bitwise(spark, sf_dir):
    s = encoded(records.spans(spark, sf_dir), SPAN)
    return longs(predicates.where(s, SPAN, lambda f: f.flags.bitwiseAND(F.lit(1)) == 1, select=["span_id"]))


@query("SELECT event_id + 1 AS span_id FROM events WHERE CAST(round(value * 100) AS BIGINT) * 1000 > 5000000")
def match_cross_field(spark, sf_dir):
    s = encoded(records.spans(spark, sf_dir), SPAN)
    return longs(predicates.where(s, SPAN, lambda f: f.end_ns - f.start_ns > 5_000_000, select=["span_id"]))


@query("SELECT event_id + 1 AS span_id FROM events WHERE event_id % 2 = 1 AND CAST(round(value * 100) AS BIGINT) * 1000 > 10000000")
def match_and(spark, sf_dir):
    s = encoded(records.spans(spark, sf_dir), SPAN)
    return longs(predicates.where(s, SPAN, lambda f: f.flags.bitwiseAND(F.lit(1)) == 1, lambda f: f.end_ns - f.start_ns > 10_000_000, select=["span_id"]))


@query("SELECT event_id + 1 AS span_id, epoch_us(ts) * 1000 AS start_ns, event_type AS name FROM events WHERE event_id % 2 = 1")
def match_select(spark, sf_dir):
    s = encoded(records.spans(spark, sf_dir), SPAN)
    found = predicates.matcher(SPAN, lambda f: f.flags.bitwiseAND(F.lit(1)) == 1, select=["span_id", "start_ns", "name"])(data())
    return longs(s.select(found.alias("m")).where("m IS NOT NULL").select("m.*"))


@query("SELECT count(*) AS n FROM events WHERE user_id % 10 = 0 OR user_id > 20")
def match_term_order(spark, sf_dir):
    """With the order of terms a null is greater than every number."""
    e = encoded(records.events(spark, sf_dir), EVENT)
    return predicates.where(e, EVENT, lambda f: f.user_id > 20, null_order="term").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND round(o_totalprice * 100) > 10000000")
def match_payload(spark, sf_dir):
    o = _orders(spark, sf_dir, header=False)
    return predicates.where(o, ORDER, lambda f: (f.side == "buy") & (f.price > 10_000_000), header=False).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE round(o_totalprice * 100) >= 20000000")
def compare_value(spark, sf_dir):
    return _orders(spark, sf_dir).where(predicates.compare(ORDER, data(), "price", ">=", 20_000_000)).select("o_orderkey")


@query("SELECT event_id FROM events WHERE user_id % 10 = 0 OR user_id < 5")
def compare_nulls_first(spark, sf_dir):
    e = encoded(records.events(spark, sf_dir), EVENT, ["event_id"])
    return e.where(predicates.compare(EVENT, data(), "user_id", "<", 5)).select("event_id")


@query("SELECT event_id FROM events WHERE user_id % 10 = 0")
def compare_null_equal(spark, sf_dir):
    e = encoded(records.events(spark, sf_dir), EVENT, ["event_id"])
    return e.where(predicates.compare(EVENT, data(), "user_id", "==", None)).select("event_id")


@query("SELECT a.o_orderkey FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE round(a.o_totalprice * 100) < round(b.o_totalprice * 100)")
def compare_binaries(spark, sf_dir):
    a = _orders(spark, sf_dir)
    b = a.select((F.col("o_orderkey") - 1).alias("o_orderkey"), data().alias("other"))
    return a.join(b, "o_orderkey").where(predicates.compare_binaries(ORDER, data(), F.col("other"), "price", "<")).select("o_orderkey")


@query("SELECT l_orderkey AS order_key, l_linenumber::BIGINT AS line FROM lineitem WHERE CAST(round(l_extendedprice * 100) AS BIGINT) >= 5000050")
def compare_decimal(spark, sf_dir):
    """By value, whatever the number of digits."""
    d = encoded(records.lines(spark, sf_dir), LINE)
    hit = predicates.compare(LINE, data(), "unit", ">=", F.lit("50000.500").cast("decimal(38,8)"))
    return longs(d.where(hit).select(access.get(LINE, data(), "order_key").alias("order_key"), access.get(LINE, data(), "line").alias("line")))


@query(f"SELECT o_orderkey FROM orders WHERE {_SIDE} IN ('sell', 'cancel')")
def compare_enum(spark, sf_dir):
    """Enums compare by number."""
    return _orders(spark, sf_dir).where(predicates.compare(ORDER, data(), "side", ">", "buy")).select("o_orderkey")


# -- types -----------------------------------------------------------------------------------------------------------


@query(f"SELECT {_SIDE} AS side, count(*) AS n FROM orders GROUP BY 1")
def enum_name(spark, sf_dir):
    number = _orders(spark, sf_dir).select(access.raw(ORDER, data(), "side").cast("int").alias("id"))
    return number.join(F.broadcast(sqlgen.enum_table(spark, SIDE)), "id", "left").groupBy(F.col("name").alias("side")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN '77' WHEN 'signup' THEN NULL ELSE event_type END AS kind FROM events")
def enum_unknown(spark, sf_dir):
    e = encoded(records.events(spark, sf_dir), EVENT)
    return arrowio.decode(e, EVENT, fields=["event_id", "kind"], strict=True)


@query("SELECT event_id, event_id % 2 = 1 AS admin, (event_id % 16) // 8 = 1 AS banned, event_id % 16 AS number, bit_count(CAST(event_id % 16 AS INTEGER))::BIGINT AS n FROM events")
def bitset_flags(spark, sf_dir):
    e = encoded(records.events(spark, sf_dir), EVENT, ["event_id"])
    number = access.raw(EVENT, data(), "roles")
    names = access.get(EVENT, data(), "roles")
    return longs(e.select("event_id", ROLES.has(number, "admin").alias("admin"), F.array_contains(names, "banned").alias("banned"), scalars.flags_number(ROLES, names).alias("number"), F.size(scalars.flags_of(ROLES, number)).alias("n")))


@query("SELECT CASE WHEN event_id % 3 = 0 THEN true WHEN event_id % 3 = 1 THEN false END AS ok, count(*) AS n FROM events GROUP BY 1")
def bool_tristate(spark, sf_dir):
    e = encoded(records.events(spark, sf_dir), EVENT)
    return e.groupBy(access.get(EVENT, data(), "ok").alias("ok")).agg(F.count("*").alias("n"))


@query("SELECT CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n FROM lineitem")
def decimal_roundtrip(spark, sf_dir):
    d = encoded(records.lines(spark, sf_dir), LINE)
    return d.agg((F.sum(access.get(LINE, data(), "unit")) * 100).cast("bigint").alias("cents"), F.count("*").alias("n"))


@query("SELECT l_returnflag AS return_flag, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY 1")
def decimal_scaled(spark, sf_dir):
    d = encoded(records.lines(spark, sf_dir), LINE)
    return d.groupBy(access.get(LINE, data(), "return_flag").alias("return_flag")).agg((F.sum(access.get(LINE, data(), "price")) * 100).cast("bigint").alias("cents"))


@query("SELECT event_id, epoch_us(ts) AS at FROM events")
def timestamp_us(spark, sf_dir):
    e = encoded(records.events(spark, sf_dir), EVENT, ["event_id"])
    return e.select("event_id", scalars.time_to_micros(scalars.micros_to_time(access.get(EVENT, data(), "at"))).alias("at"))


@query("SELECT event_id + 1 AS span_id, epoch_us(ts) AS start_us FROM events")
def datetime_ns_trunc(spark, sf_dir):
    """What is below a microsecond is lost when nanoseconds become a time."""
    s = records.spans(spark, sf_dir).withColumn("start_ns", F.col("start_ns") + 999)
    return longs(encoded(s, SPAN).select(access.get(SPAN, data(), "span_id").alias("span_id"), F.unix_micros(scalars.nanos_to_time(access.get(SPAN, data(), "start_ns"))).alias("start_us")))


@query("SELECT event_id, value FROM events")
def float_roundtrip(spark, sf_dir):
    e = encoded(records.events(spark, sf_dir), EVENT, ["event_id"])
    return e.select("event_id", access.get(EVENT, data(), "value").alias("value"))


def _customers(spark, sf_dir):
    c = records.table(spark, sf_dir, "customer")
    raw = records.key_uuid("c_custkey")
    return c.select("c_custkey", scalars.prefixed_from_uuid(records.CUSTOMER_ID, raw).alias("id"), bx.dashed(raw).alias("key"), F.col("c_mktsegment").alias("segment"), (records.cents("c_acctbal").cast("decimal(20,0)") / 100).cast("decimal(38,8)").alias("balance"), F.col("c_name").alias("name"), F.when(F.col("c_nationkey") > 5, F.concat(F.lit("nation "), F.col("c_nationkey"))).alias("note"), F.repeat(F.col("c_mktsegment"), 3).alias("text"))


_DASHED = "format('{}-{}-{}-{}-{}', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32])"
_CUST = "(SELECT *, lpad(lower(to_hex(c_custkey)), 32, '0') AS h FROM customer)"


@query(f"SELECT c_custkey, CASE WHEN c_custkey > 0 THEN {_DASHED} END AS key FROM {_CUST}")
def uuid_string(spark, sf_dir):
    return encoded(_customers(spark, sf_dir), CUSTOMER, ["c_custkey"]).select("c_custkey", access.get(CUSTOMER, data(), "key").alias("key"))


@query(f"SELECT c_custkey, 'cust-' || {_DASHED} AS id, true AS valid FROM {_CUST}")
def prefixed_id(spark, sf_dir):
    """The tag keeps an all-zero uuid from being null."""
    c = encoded(_customers(spark, sf_dir), CUSTOMER, ["c_custkey"]).select("c_custkey", access.get(CUSTOMER, data(), "id").alias("id"))
    return c.withColumn("valid", scalars.prefixed_valid(records.CUSTOMER_ID, F.col("id")))


@query("SELECT left(c_mktsegment, 8) AS segment, count(*) AS n FROM customer GROUP BY 1")
def char_array(spark, sf_dir):
    return encoded(_customers(spark, sf_dir), CUSTOMER).groupBy(access.get(CUSTOMER, data(), "segment").alias("segment")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name AS name, CASE WHEN c_nationkey > 5 THEN 'nation ' || c_nationkey END AS note, repeat(c_mktsegment, 3) AS text FROM customer")
def strings_chain(spark, sf_dir):
    c = encoded(_customers(spark, sf_dir), CUSTOMER, ["c_custkey"])
    return c.select("c_custkey", *[access.get(CUSTOMER, data(), n).alias(n) for n in ("name", "note", "text")])


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def string32_documents(spark, sf_dir):
    codec = Codec("Doc", [Field("doc_id", "i64"), Field("text", "string32")], template_id=50)
    d = encoded(records.table(spark, sf_dir, "documents"), codec)
    return d.select(access.get(codec, data(), "doc_id").alias("doc_id"), F.md5(access.get(codec, data(), "text").cast("binary")).alias("digest"))


@query("SELECT vec_id, label::BIGINT AS label, len(embedding)::BIGINT AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def vectors_scalar_group(spark, sf_dir):
    codec = Codec("Vector", [Field("vec_id", "i64"), Field("label", "i32")], template_id=51, groups=[Group("embedding", of="f32")])
    t = records.table(spark, sf_dir, "embeddings")
    d = arrowio.decode(encoded(t, codec), codec, strict=True)
    return longs(d.select("vec_id", "label", F.size("embedding").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total")))


@query("SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def conversations_framed(spark, sf_dir):
    codec = Codec("Conversation", [Field("conv_id", "i64")], template_id=52, groups=[Group("turns", (Field("turn", "i32"), Field("role", "string8"), Field("text", "string16")), framed=True)])
    t = records.table(spark, sf_dir, "conversations")
    rows = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    d = arrowio.decode(encoded(rows, codec), codec, strict=True)
    return d.select("conv_id", F.size("turns").cast("bigint").alias("turns"), F.aggregate("turns", F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(F.length(x["text"]), F.lit(0))).alias("chars"))


@query("SELECT c_custkey, substr(sha1('q'), 1, 8) AS space, true AS same FROM customer")
def uuid_versions(spark, sf_dir):
    """Version 5 depends on its name alone; version 7 holds its time; version 4 has its version digit."""
    at = F.timestamp_millis(F.lit(1_700_000_000_123))
    c = records.table(spark, sf_dir, "customer")
    five = scalars.uuid_v5("dns", F.col("c_name"))
    seven = scalars.uuid_v7(at)
    good = (five == scalars.uuid_v5("dns", F.concat(F.col("c_name"), F.lit("")))) & (F.substring(F.hex(five), 13, 1) == "5") & (scalars.uuid_v7_time(seven) == at) & (F.substring(F.hex(scalars.uuid_v4()), 13, 1) == "4")
    return c.select("c_custkey", F.substring(F.sha1(F.lit("q").cast("binary")), 1, 8).alias("space"), good.alias("same"))


# -- groups ------------------------------------------------------------------------------------------------------------


def _books(spark, sf_dir):
    return encoded(records.line_arrays(spark, sf_dir), BOOK, ["order_key"])


@query("SELECT l_orderkey AS order_key, l_partkey AS part, CAST(l_quantity AS BIGINT) AS quantity, l_linenumber::BIGINT AS line, l_returnflag = 'R' AS returned FROM lineitem")
def group_explode(spark, sf_dir):
    b = _books(spark, sf_dir).select("order_key", collections.group_entries(BOOK, data(), "lines").alias("lines"))
    return longs(collections.stream_group(b, "lines", ["order_key"]).select("order_key", "entry.*"))


@query("SELECT l_orderkey AS order_key, l_partkey AS part FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25")
def group_stream_filter(spark, sf_dir):
    b = arrowio.decode(_books(spark, sf_dir), BOOK, fields=["order_key", "lines"], strict=True)
    rows = collections.stream_group(b, "lines", ["order_key"]).where(F.col("entry.returned") & (F.col("entry.quantity") > 25))
    return longs(rows.select("order_key", "entry.part"))


@query("SELECT l_orderkey AS order_key, count(*) AS n, count(*) AS parts FROM lineitem GROUP BY 1")
def group_count(spark, sf_dir):
    b = _books(spark, sf_dir)
    return longs(b.select("order_key", collections.group_count(BOOK, data(), "lines").alias("n"), collections.group_count(BOOK, data(), "parts").alias("parts")))


@query("SELECT l_orderkey AS order_key, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY 1")
def group_reduce(spark, sf_dir):
    b = _books(spark, sf_dir).select("order_key", collections.group_entries(BOOK, data(), "lines").alias("lines"))
    return b.select("order_key", collections.reduce_group(F.col("lines"), F.lit(0).cast("bigint"), lambda a, e: a + e["quantity"]).alias("quantity"))


_RANKED = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag = 'R', round(l_extendedprice * 100), l_returnflag) AS rn, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_quantity DESC, l_returnflag = 'R' DESC, round(l_extendedprice * 100) DESC, l_returnflag DESC) AS rev FROM lineitem)"


@query(f"SELECT o.k AS order_key, r.l_partkey AS part, CASE WHEN r.l_partkey IS NULL THEN 'index_out_of_bounds' END AS error FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) o LEFT JOIN {_RANKED} r ON r.l_orderkey = o.k AND r.rn = 2")
def group_entry_at(spark, sf_dir):
    b = _books(spark, sf_dir).select("order_key", collections.group_entry(BOOK, data(), "lines", 1).alias("e"))
    return longs(b.select("order_key", F.col("e.entry.part").alias("part"), "e.error"))


@query(f"SELECT l_orderkey AS order_key, CAST(l_quantity AS BIGINT) AS quantity FROM {_RANKED} WHERE rn = 1")
def group_field_at(spark, sf_dir):
    return longs(_books(spark, sf_dir).select("order_key", collections.group_field(BOOK, data(), "lines", 0, "quantity").alias("quantity")))


@query(f"SELECT l_orderkey AS order_key, CAST(list_sum(list(l_partkey ORDER BY rn)[1:2]) AS BIGINT) AS two FROM {_RANKED} GROUP BY 1")
def group_scalar(spark, sf_dir):
    """A group of plain numbers, encoded in generated code, and its first two entries."""
    rows = records.line_arrays(spark, sf_dir)
    only = Codec("Parts", [Field("order_key", "i64")], template_id=53, groups=[BOOK.groups[1]])
    made = rows.select("order_key", F.concat(bx.literal(only.header_bytes()), Int("i64").write(F.col("order_key")), collections.encode_group(only.groups[0], F.col("parts"))).alias("data"))
    two = collections.take(collections.group_entries(only, data(), "parts"), 2)
    return made.select("order_key", F.aggregate(two, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint")).alias("two"))


@query("SELECT l_orderkey AS order_key, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS amount, string_agg(l_returnflag, '' ORDER BY l_returnflag) AS flags, l_orderkey % 2 = 0 AS done FROM lineitem GROUP BY 1, 4")
def group_framed(spark, sf_dir):
    b = arrowio.decode(encoded(records.line_arrays(spark, sf_dir), BILL), BILL, strict=True)
    return b.select("order_key", F.aggregate("bills", F.lit(0).cast("bigint"), lambda a, e: a + e["amount"].cast("bigint")).alias("amount"), F.array_join(F.array_sort("names"), "").alias("flags"), "done")


@query("SELECT l_orderkey AS order_key, 4 + 8 * count(*) + 2 + length('order ' || l_orderkey)::BIGINT AS rest, 'order ' || l_orderkey AS note FROM lineitem GROUP BY l_orderkey")
def group_rest_size(spark, sf_dir):
    """Behind the first group stand the second and the text."""
    b = _books(spark, sf_dir)
    return longs(b.select("order_key", F.octet_length(collections.group_rest(BOOK, data(), "lines")).alias("rest"), access.get(BOOK, data(), "note").alias("note")))


@query("SELECT l_orderkey AS order_key, CASE l_orderkey % 3 WHEN 0 THEN 'insufficient_header' WHEN 1 THEN 'insufficient_data' END AS error FROM lineitem GROUP BY 1")
def group_errors(spark, sf_dir):
    b = _books(spark, sf_dir)
    cut = F.when(F.col("order_key") % 3 == 0, F.substring("data", 1, 18)).when(F.col("order_key") % 3 == 1, F.substring("data", 1, 25)).otherwise(data())
    return b.select("order_key", collections.group_error(cut, 16).alias("error"))


# -- lookups and batches -------------------------------------------------------------------------------------------------


@query(f"SELECT l_orderkey AS order_key, l_returnflag = 'R' AS returned, arg_max(l_partkey, rn) AS part FROM {_RANKED} GROUP BY 1, 2")
def lookup_map_last_wins(spark, sf_dir):
    b = arrowio.decode(_books(spark, sf_dir), BOOK, fields=["order_key", "lines"], strict=True)
    found = collections.lookup_map(b, "lines", ["order_key"], "returned")
    return longs(found.select("order_key", F.col("key").alias("returned"), F.col("entry.part").alias("part")))


@query(f"SELECT l_orderkey AS order_key, l_linenumber::BIGINT AS line, arg_max(l_partkey, rn) AS part FROM {_RANKED} GROUP BY 1, 2")
def lookup_map_column(spark, sf_dir):
    b = arrowio.decode(_books(spark, sf_dir), BOOK, fields=["order_key", "lines"], strict=True)
    m = b.select("order_key", F.explode(collections.lookup_map_column(F.col("lines"), "line")).alias("line", "e"))
    return longs(m.select("order_key", "line", "e.part"))


@query("SELECT l_orderkey AS order_key, count(*) FILTER (WHERE l_returnflag = 'R') AS n FROM lineitem GROUP BY 1")
def lookup_filtered_list(spark, sf_dir):
    b = arrowio.decode(_books(spark, sf_dir), BOOK, fields=["order_key", "lines"], strict=True)
    return longs(b.select("order_key", F.size(collections.lookup_list(F.col("lines"), returned=True)).alias("n")))


def _boxes(spark, sf_dir, strategy):
    codec = records.box(strategy)
    return codec, encoded(records.boxes(spark, sf_dir), codec)


_ENTRIES = "SELECT user_id, event_id AS seq, CASE event_type WHEN 'click' THEN 0 ELSE 1 END::BIGINT AS tag, CASE event_type WHEN 'purchase' THEN CAST(round(value * 100) AS BIGINT) END AS cents FROM events WHERE event_type IN ('click', 'purchase')"


def _entries(spark, sf_dir, strategy):
    codec, b = _boxes(spark, sf_dir, strategy)
    d = arrowio.decode(b, codec, strict=True)
    return longs(d.select("user_id", F.explode("commands").alias("e")).select("user_id", "e.seq", "e.tag", F.col("e.Buy.cents").alias("cents")))


@query(_ENTRIES)
def batch_padded(spark, sf_dir):
    return _entries(spark, sf_dir, "padded_union")


@query(_ENTRIES)
def batch_typed_frames(spark, sf_dir):
    return _entries(spark, sf_dir, "typed_frames")


@query("SELECT user_id, CAST(list(event_id ORDER BY event_id) AS VARCHAR) AS seqs FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1")
def batch_per_type_merge(spark, sf_dir):
    codec, b = _boxes(spark, sf_dir, "per_type_groups")
    d = arrowio.decode(b, codec, strict=True)
    kinds = [collections.entries_of(codec.batches[0], F.col("commands"), n) for n in ("Buy", "Click")]
    seqs = F.transform(collections.merged(*kinds), lambda e: e["seq"].cast("string"))
    return d.select("user_id", F.concat(F.lit("["), F.array_join(seqs, ", "), F.lit("]")).alias("seqs"))


@query("SELECT user_id, event_id AS seq, CAST(round(value * 100) AS BIGINT) AS cents, event_id % 4 AS level FROM events WHERE event_type = 'purchase'")
def batch_by_type(spark, sf_dir):
    codec, b = _boxes(spark, sf_dir, "padded_union")
    rows = b.select(access.get(codec, data(), "user_id").alias("user_id"), F.explode(collections.by_type(codec, data(), "commands", "Buy")).alias("e"))
    return longs(rows.select("user_id", "e.seq", "e.entry.cents", "e.entry.level"))


@query("SELECT user_id, count(*) AS n, 4 + 26 * count(*) AS bytes FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1")
def batch_wire_size(spark, sf_dir):
    codec, b = _boxes(spark, sf_dir, "padded_union")
    return longs(b.select(access.get(codec, data(), "user_id").alias("user_id"), collections.batch_count(codec, data(), "commands").alias("n"), collections.batch_wire_size(codec, data(), "commands").alias("bytes")))


@query("SELECT user_id, arg_max(event_id, event_id) AS last FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1")
def batch_lookup(spark, sf_dir):
    """A key for each kind of entry; the last write of a key wins."""
    codec, b = _boxes(spark, sf_dir, "typed_frames")
    d = arrowio.decode(b, codec, strict=True)
    key = collections.batch_key(codec.batches[0], Click="user_id", Buy="user_id")
    found = collections.lookup_map(d, "commands", ["user_id"], key)
    return longs(found.select("user_id", F.col("entry.seq").alias("last")))


# -- routing, JSON, transcoding ----------------------------------------------------------------------------------------


def _mixed(spark, sf_dir):
    return _orders(spark, sf_dir).select(F.col("o_orderkey").alias("k"), "data").union(encoded(records.events(spark, sf_dir), EVENT, ["event_id"]).select(F.col("event_id").alias("k"), "data"))


@query(f"SELECT 'OrderCreated' AS type, o_orderkey AS k, {_PRICE} AS price, CAST(NULL AS DOUBLE) AS value FROM orders UNION ALL SELECT 'Event', event_id, NULL, value FROM events")
def dispatch_mixed(spark, sf_dir):
    d = evolution.Registry([ORDER, EVENT]).decode(_mixed(spark, sf_dir), keep=["k"])
    return longs(d.select("type", "k", F.col("OrderCreated.price").alias("price"), F.col("Event.value").alias("value")))


@query("SELECT 'unknown_message' AS error, count(*) AS n FROM events UNION ALL SELECT NULL, count(*) FROM orders")
def dispatch_unknown(spark, sf_dir):
    r = evolution.Registry([ORDER])
    return _mixed(spark, sf_dir).groupBy(r.error(data()).alias("error")).agg(F.count("*").alias("n"))


@query(f"SELECT o_orderkey AS k, {_PRICE} AS price, CAST(NULL AS VARCHAR) AS error FROM orders UNION ALL SELECT event_id, NULL, 'unknown type: nope' FROM events")
def universal_json(spark, sf_dir):
    r = evolution.Registry([ORDER, EVENT])
    name = F.when(r.type_name(data()) == "OrderCreated", "OrderCreated").otherwise("nope")
    j = _mixed(spark, sf_dir).select("k", r.to_json(data(), name).alias("j"))
    return j.select("k", F.get_json_object("j", "$.price").cast("bigint").alias("price"), F.get_json_object("j", "$._error").alias("error"))


@query("SELECT c_custkey, c_name AS name, CAST(round(c_acctbal * 100) AS BIGINT) AS cents, true AS pretty FROM customer")
def json_roundtrip(spark, sf_dir):
    c = encoded(_customers(spark, sf_dir), CUSTOMER, ["c_custkey"])
    j = c.select("c_custkey", evolution.to_json(CUSTOMER, data()).alias("j"), evolution.to_json(CUSTOMER, data(), pretty=True).contains("\n").alias("pretty"))
    back = encoded(j.select("c_custkey", "pretty", evolution.from_json(F.col("j"), CUSTOMER).alias("r")).select("c_custkey", "pretty", "r.*"), CUSTOMER, ["c_custkey", "pretty"])
    return longs(back.select("c_custkey", access.get(CUSTOMER, data(), "name").alias("name"), (access.get(CUSTOMER, data(), "balance") * 100).cast("bigint").alias("cents"), "pretty"))


@query(f"SELECT 'price' AS name, 33::BIGINT AS \"offset\", 8::BIGINT AS size, CAST({_PRICE} AS VARCHAR) AS value, o_orderkey FROM orders")
def inspect_layout(spark, sf_dir):
    o = _orders(spark, sf_dir).select("o_orderkey", F.explode(access.inspect_fields(ORDER, data())).alias("f"))
    return longs(o.where("f.name = 'price'").select("f.name", "f.offset", "f.size", "f.value", "o_orderkey"))


@query("SELECT event_id + 1 AS span_id, event_id AS flags, event_id % 5 AS message_type FROM events")
def transcode_rename(spark, sf_dir):
    t = evolution.Transcoder(SPAN, ENVELOPE, {"span_id": "span_id", "flags": "flags", "message_type": "kind"}).require_all()
    out = t(encoded(records.spans(spark, sf_dir), SPAN))
    return longs(out.select(*[access.get(ENVELOPE, data(), n).alias(n) for n in ("span_id", "flags", "message_type")]))


@query("SELECT event_id + 1 AS span_id, CASE WHEN event_id % 5 < 4 THEN (event_id % 5) * 10 END AS message_type, CASE WHEN event_id % 5 < 4 THEN 0 ELSE 1 END::BIGINT AS n_errors FROM events")
def transcode_validated(spark, sf_dir):
    target = dataclasses.replace(ENVELOPE, checks=[validate.Compare("message_type", "<", 40)])
    t = evolution.Transcoder(SPAN, target, {"span_id": "span_id", "message_type": ("kind", lambda c: c * 10)}, "both")
    out = t(encoded(records.spans(spark, sf_dir), SPAN), out="made")
    return longs(out.select(access.get(SPAN, data(), "span_id").alias("span_id"), access.get(target, F.col("made"), "message_type").alias("message_type"), F.size("errors").alias("n_errors")))


# -- evolution ---------------------------------------------------------------------------------------------------------

_V1 = Codec("Evolving", [Field("id", "i64"), Field("price", "u32")], template_id=60, version=1)


def _v2(**extra) -> Codec:
    return Codec("Evolving", [*_V1.fields, Field("qty", "u32", since=2, **extra)], template_id=60, version=2)


def _old(spark, sf_dir, codec=_V1):
    o = records.table(spark, sf_dir, "orders")
    return encoded(o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("price"), F.lit("n").alias("note")), codec)


@query("SELECT o_orderkey AS id, o_custkey AS price, CAST(NULL AS BIGINT) AS qty FROM orders")
def evolve_pad(spark, sf_dir):
    return longs(arrowio.decode(_old(spark, sf_dir), _v2(), strict=True))


@query("SELECT o_orderkey AS id, o_custkey AS price, 5::BIGINT AS qty, 5::BIGINT AS got, 16::BIGINT AS block FROM orders")
def evolve_default(spark, sf_dir):
    """Decoding, reading one field, and padding the bytes all give the default."""
    codec = _v2(presence="required", default=5)
    o = _old(spark, sf_dir).withColumn("got", access.get(codec, data(), "qty")).withColumn("block", access.header(evolution.padded(codec, data()))["block_length"])
    return longs(arrowio.decode(o, codec, keep=["got", "block"], strict=True))


@query("SELECT 'required_field_absent' AS code, 'qty' AS detail, count(*) AS n FROM orders")
def evolve_required_absent(spark, sf_dir):
    d = arrowio.decode(_old(spark, sf_dir), _v2(presence="required"))
    return d.groupBy("error.code", "error.detail").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS id, o_custkey AS price, CAST(NULL AS VARCHAR) AS note FROM orders")
def evolve_missing_string(spark, sf_dir):
    codec = Codec("Evolving", [*_V1.fields, Field("note", "string16", since=2)], template_id=60, version=2)
    return longs(arrowio.decode(_old(spark, sf_dir), codec, strict=True))


@query("SELECT l_orderkey AS order_key, l_partkey AS part, CAST(NULL AS BOOLEAN) AS urgent, 7::BIGINT AS grade FROM lineitem")
def evolve_group_pad(spark, sf_dir):
    """Entries of old records are padded one by one, so the group stays aligned."""
    entry = dataclasses.replace(ENTRY, fields=[*ENTRY.fields, Field("urgent", "bool", since=2), Field("grade", "u8", "required", default=7, since=2)], version=2)
    new = dataclasses.replace(BOOK, groups=[Group("lines", of=entry), BOOK.groups[1]], version=2)
    d = arrowio.decode(_books(spark, sf_dir), new, fields=["order_key", "lines"], strict=True)
    return longs(d.select("order_key", F.explode("lines").alias("e")).select("order_key", "e.part", "e.urgent", "e.grade"))


@query("SELECT 'group_absent' AS code, 0::BIGINT AS n_empty, count(*) AS n FROM orders UNION ALL SELECT NULL, count(*), count(*) FROM orders")
def evolve_missing_group(spark, sf_dir):
    new = dataclasses.replace(_V1, groups=[Group("queue", (Field("a", "u32"),))], version=2)
    strict = arrowio.decode(_old(spark, sf_dir), new)
    lenient = arrowio.decode(_old(spark, sf_dir), new, missing_group="empty")
    return strict.union(lenient).groupBy("error.code").agg(F.count(F.when(F.size("queue") == 0, 1)).alias("n_empty"), F.count("*").alias("n"))


@query("SELECT 'version_too_new' AS code, count(*) AS n FROM orders")
def version_too_new(spark, sf_dir):
    new = _old(spark, sf_dir, _v2())
    both = arrowio.decode(new, _V1).select("error.code").join(new.select(access.record_error(_V1, data()).alias("code")).distinct(), "code")
    return both.groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT CASE o_orderkey % 4 WHEN 0 THEN 'template_id_mismatch' WHEN 1 THEN 'invalid_binary' WHEN 2 THEN 'string_too_short' END AS code, count(*) AS n FROM orders GROUP BY 1")
def decode_errors(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    o = _orders(spark, sf_dir)
    bad = F.when(k == 0, F.concat(F.substring("data", 1, 2), bx.literal(b"\x63\x00"), F.substring("data", 5, 1000))).when(k == 1, F.substring("data", 1, 30)).when(k == 2, F.substring("data", 1, 56)).otherwise(data())
    d = arrowio.decode(o.select(bad.alias("data")), ORDER)
    return d.groupBy(F.col("error.code").alias("code")).agg(F.count("*").alias("n"))


# -- validation ---------------------------------------------------------------------------------------------------------

_CHECKED = dataclasses.replace(TICKET, checks=[validate.Compare("price", ">", 10_000_000), validate.OneOf("side", ("buy", "sell")), validate.Expr("even", ("id",), lambda v: v["id"] % 2 == 0), validate.Compare("small", "<=", other="rank")])


def _tickets(spark, sf_dir):
    o = records.orders(spark, sf_dir)
    return o.select(F.col("o_orderkey").alias("id"), "price", "side", F.when(F.col("o_orderkey") % 5 != 0, F.col("quantity").cast("int")).alias("rank"), (F.col("o_orderkey") % 900).cast("int").alias("small"))


_BAD_PRICE, _BAD_SIDE, _BAD_ID = f"{_PRICE} <= 10000000", f"{_SIDE} = 'cancel'", "o_orderkey % 2 <> 0"
_BAD_RANK = "o_orderkey % 5 <> 0 AND o_orderkey % 900 > o_orderkey % 1000"


@query(f"SELECT o_orderkey AS id, (({_BAD_PRICE})::INT + ({_BAD_SIDE})::INT + ({_BAD_ID})::INT + ({_BAD_RANK})::INT)::BIGINT AS n FROM orders")
def validate_errors(spark, sf_dir):
    v = validate.validate_columns(_CHECKED, _tickets(spark, sf_dir))
    return longs(v.select("id", F.size("errors").alias("n")))


@query(f"SELECT o_orderkey AS id, concat_ws(',', CASE WHEN {_BAD_PRICE} THEN 'price' END, CASE WHEN {_BAD_SIDE} THEN 'side' END, CASE WHEN {_BAD_RANK} THEN 'small' END) AS fields FROM orders")
def validate_binary(spark, sf_dir):
    """Only checks that can be read from the bytes."""
    t = encoded(_tickets(spark, sf_dir), TICKET, ["id"])
    return t.select("id", F.array_join(F.transform(validate.validate_binary(_CHECKED, data()), lambda e: e["field"]), ",").alias("fields"))


@query(f"SELECT o_orderkey AS id, NOT ({_BAD_SIDE}) AS valid FROM orders")
def validate_one_of(spark, sf_dir):
    codec = dataclasses.replace(TICKET, checks=[validate.OneOf("side", ("buy", "sell"))])
    return validate.validate_columns(codec, _tickets(spark, sf_dir)).select("id", validate.is_valid().alias("valid"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'cast_error:id' WHEN o_orderkey % 4 = 1 THEN 'cast_error:rank' WHEN o_orderkey % 4 = 2 THEN 'required_field:id' ELSE '' END AS errors, CASE WHEN o_orderkey % 4 IN (1, 3) THEN o_orderkey END AS id FROM orders")
def coerce_strings(spark, sf_dir):
    k = F.col("o_orderkey")
    o = records.table(spark, sf_dir, "orders").select(k.alias("k"), F.when(k % 4 == 0, F.lit("x")).when(k % 4 == 2, F.lit(None)).otherwise(k.cast("string")).alias("id"), F.lit("12").alias("price"), F.lit("buy").alias("side"), F.when(k % 4 == 1, F.lit("99999999999")).otherwise(F.lit("5")).alias("rank"), F.lit("3").alias("small"))
    c = validate.coerce(TICKET, o)
    return c.select("k", F.array_join(F.transform("errors", lambda e: F.concat(e["code"], F.lit(":"), e["field"])), ",").alias("errors"), "id")


@query(f"SELECT o_orderkey AS k, CASE WHEN {_PRICE} > 10000000 THEN o_orderkey END AS id, ({_PRICE} > 10000000) AS made FROM orders")
def new_binary(spark, sf_dir):
    codec = dataclasses.replace(TICKET, checks=[validate.Compare("price", ">", 10_000_000)])
    t = _tickets(spark, sf_dir).withColumn("k", F.col("id"))
    n = validate.new_binary(codec, t, ["k"])
    return n.select("k", access.get(codec, data(), "id").alias("id"), data().isNotNull().alias("made"))


@query("SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS valid FROM orders")
def refined_type(spark, sf_dir):
    even = Refined("even", Int("i64"), lambda v: v % 2 == 0)
    codec = Codec("Even", [Field("id", even)], template_id=61)
    return validate.validate_columns(codec, _tickets(spark, sf_dir)).select("id", validate.is_valid().alias("valid"))


@query("SELECT o_orderkey AS id, o_orderkey + 1 AS updated, true AS valid FROM orders")
def update_fields(spark, sf_dir):
    t = _tickets(spark, sf_dir).withColumn("updated", F.col("id"))
    u = validate.update(TICKET, t, {"id": F.col("id") + 1})
    return u.select((F.col("id") - 1).alias("id"), F.col("id").alias("updated"), validate.is_valid().alias("valid"))


# -- identity, registry, schema language, SQL ------------------------------------------------------------------------


@query("SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem)")
def content_hash_dedup(spark, sf_dir):
    narrow = Codec("LineKey", LINE.fields[:4], template_id=62)
    d = encoded(records.lines(spark, sf_dir), narrow)
    return d.select(access.content_hash(data()).alias("h")).distinct().agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('Event', 100::BIGINT, 4::BIGINT, 8::BIGINT), ('OrderCreated', 100, 1, 8), ('Span', 99, 9900, 6)) t(name, schema_id, template_id, n_fields)")
def registry_summary(spark, sf_dir):
    r = evolution.Registry([ORDER, EVENT, SPAN])
    return longs(r.table(spark).select("name", "schema_id", "template_id", "n_fields"))


_OLD_TEXT = """
@syntax 1
schema Shop { id: 9 version: 1 }
enum Side : u8 { buy = 0 sell = 1 }
prefixed_id OrderId (prefix: "ord", tag: 3)
struct Order (template_id: 1) {
  id: u64
  side: Side
  price: u32, default: 1
  note: string16
  group fills { qty: u32 }
}
struct Gone (template_id: 2) { id: u64 }
"""
_NEW_TEXT = """
@syntax 1
schema Shop { id: 9 version: 2 }
enum Side : u8 { buy = 0 offer = 1 }
prefixed_id OrderId (prefix: "ord", tag: 4)
struct Order (template_id: 1) {
  id: i64
  side: Side
  price: u32, default: 2
  note: string16
  level: u8, presence: required
  group fills { qty: u32 lot: u8, presence: required }
}
struct Renamed (template_id: 2) { id: u64 }
"""
_EXPECTED = [
    ("WIRE_STRUCT_REMOVED", "error"), ("WIRE_FIELD_TYPE_CHANGED", "error"), ("WIRE_FIELD_ADDED_REQUIRED", "error"), ("WIRE_FIXED_APPEND_BEFORE_TAIL", "warning"),
    ("WIRE_GROUP_FIELD_ADDED_REQUIRED", "error"), ("WIRE_PREFIXED_ID_TAG_CHANGED", "error"), ("SOURCE_FIELD_DEFAULT_CHANGED", "error"), ("SOURCE_ENUM_VALUE_RENAMED", "error"), ("SOURCE_STRUCT_RENAMED", "error"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{s}')" for r, s in _EXPECTED) + ") t(rule, severity)")
def schema_diff(spark, sf_dir):
    return breaking.as_table(spark, breaking.check(_OLD_TEXT, _NEW_TEXT)).select("rule", "severity")


@query("SELECT * FROM (VALUES ('Order', 1::BIGINT, 13::BIGINT, true), ('Gone', 2, 8, true)) t(name, template_id, block_length, same)")
def schema_roundtrip(spark, sf_dir):
    schema = schema_lang.parse_schema(_OLD_TEXT)
    again = schema_lang.parse_schema(schema_lang.format_schema(schema))
    rows = [(n, c.template_id, c.block_length, again == schema) for n, c in schema_lang.codecs(again).items()]
    return spark.createDataFrame(rows, "name string, template_id bigint, block_length bigint, same boolean")


@query(f"SELECT o_orderkey, {_PRICE} AS price, {_SIDE} AS side, o_orderpriority AS symbol FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 0")
def sql_tvf_lateral(spark, sf_dir):
    """The flagship: SQL over a column of encoded orders."""
    sqlgen.install(spark, [ORDER])
    _orders(spark, sf_dir).createOrReplaceTempView("packed_orders")
    return spark.sql("SELECT e.o_orderkey, CAST(d.price AS BIGINT) AS price, d.side, d.symbol FROM packed_orders e, LATERAL read_ordercreated(e.data) d WHERE d.side = 'buy' AND d.price > 0")


@query("SELECT event_id, CASE WHEN user_id % 10 <> 0 THEN user_id END AS user_id, epoch_us(ts) AS at, value, event_id % 16 AS roles, CASE event_type WHEN 'error' THEN '77' WHEN 'signup' THEN NULL ELSE event_type END AS kind, props, event_type AS via_json FROM events WHERE event_type IN ('click', 'view')")
def sql_readers(spark, sf_dir):
    """Byte readers, a table function and JSON by name, all in SQL text."""
    sqlgen.install(spark, [EVENT])
    encoded(records.events(spark, sf_dir), EVENT).createOrReplaceTempView("packed_events")
    return spark.sql(
        "SELECT d.event_id, CAST(d.user_id AS BIGINT) AS user_id, read_i64(e.data, 16) AS at, d.value, CAST(read_u8(e.data, 37) AS BIGINT) AS roles, d.kind, d.props, get_json_object(read_any('Event', e.data), '$.kind') AS via_json"
        " FROM packed_events e, LATERAL read_event(e.data) d, LATERAL read_header(e.data) h WHERE d.kind IN ('click', 'view') AND h.template_id = 4"
    )
