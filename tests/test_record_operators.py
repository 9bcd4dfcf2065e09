import datetime as dt

import pytest
from pyspark.sql import functions as F

from packrow import layout
from packrow.functions import bytesx as bx
from packrow.functions import scalars
from packrow.layout import Codec, Field, Group
from packrow.operators import access, collections, evolution, predicates, validate
from packrow.plans import records
from packrow.sources import arrowio, generate
from packrow.streaming import records as streaming
from packrow.types import Enum, Scaled, WireError



def data():
    return F.col("data")


def test_generated_rows_roundtrip_both_ways(spark):
    """Column code and Arrow code agree with each other, byte for byte, for random rows of every type."""
    for codec in (records.ORDER, records.LINE, records.EVENT, records.CUSTOMER, Codec("Big", [Field("a", "u32"), Field("b", "i64"), Field("c", "f64"), Field("d", Enum("E", ["x"], "u16")), Field("e", Scaled(4, True))], endian="big")):
        rows = generate.for_codec(spark, codec, 60, seed=3).persist()
        a = arrowio.encode(rows, codec, keep=["_row"])
        b = rows.select("_row", access.encode_columns(codec, {f.name: F.col(f.name) for f in codec.fields}).alias("other"))
        both = a.join(b, "_row")
        decimals = [f.name for f in codec.fields if f.type.name == "decimal"]
        if not decimals:  # decimals have several forms of one value
            assert both.where("data <> other").count() == 0
        for column in ("data", "other"):
            decoded = arrowio.decode(both, codec, column=column, keep=["_row"], strict=True).collect()
            direct = {r["_row"]: r for r in both.select("_row", *[access.get(codec, F.col(column), f.name).alias(f.name) for f in codec.fields]).collect()}
            wanted = {r["_row"]: r for r in rows.collect()}
            for r in decoded:
                for f in codec.fields:
                    w = wanted[r["_row"]][f.name]
                    if f.type.name == "uuid":
                        assert (w and bytes(w)) == (r[f.name] and bytes(r[f.name]))
                        continue
                    w = w or None if f.type.spark == "string" and not f.type.name.startswith("char") else w
                    assert r[f.name] == direct[r["_row"]][f.name], (codec.name, f.name)
                    assert r[f.name] == (w or "" if f.type.name.startswith("char") else w), (codec.name, f.name)
        rows.unpersist()


def test_doubles_are_exact(spark):
    values = [0.0, 1.5, -2.25, 4.9e-324, 2.2250738585072014e-308, 1e300, -1.7976931348623157e308, 0.1, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", bx.double(bx.double_bytes(F.col("v")), 0).alias("w"), bx.double(bx.double_bytes(F.col("v").cast("float"), size=4), 0, size=4).alias("f"), F.col("v").cast("float").alias("g"))
    for r in df.collect():
        assert r.v == r.w and r.f == r.g


def test_pushed_down(spark):
    """Only the columns a predicate needs are read; no Python runs."""
    path = records.table
    o = path(spark, "/root/testdata/sf0.001", "orders").select("o_orderkey", "o_custkey", records.key_uuid("o_orderkey").alias("data"))
    plan = predicates.where(o, records.TICKET, lambda f: f.price > 3).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "o_custkey" not in plan.split("ReadSchema")[1]


def test_null_rules(spark):
    codec = Codec("N", [Field("id", "u8"), Field("n", "u32")], template_id=1)
    df = spark.createDataFrame([(1, None), (2, 3), (3, 9)], "id int, n long")
    d = arrowio.encode(df, codec, keep=["id"])
    ids = lambda x: sorted(r.id for r in x.collect())
    assert ids(predicates.where(d, codec, lambda f: f.n > 3)) == [3]
    assert ids(predicates.where(d, codec, lambda f: f.n > 3, null_order="term")) == [1, 3]
    assert ids(d.where(predicates.compare(codec, data(), "n", "<", 3))) == [1]
    assert ids(d.where(predicates.compare(codec, data(), "n", "!=", None))) == [2, 3]
    assert d.select(access.match_raw(codec, data(), ["n"], id=1).alias("m")).where("m.matched").first().m.n == 2**32 - 1
    assert d.union(spark.createDataFrame([(9, bytearray(b"x")), (8, None)], "id int, data binary")).where(predicates.matcher(codec, lambda f: f.n > 3)(data())).count() == 1
    with pytest.raises(WireError, match="unknown_field"):
        predicates.matcher(codec, lambda f: f.missing > 1)
    with pytest.raises(WireError, match="unknown_operator"):
        predicates.compare(codec, data(), "n", "~", 1)


def test_malformed_records_are_data(spark):
    codec = records.ORDER
    good = layout.pack(codec, {"price": 5})
    rows = [(1, bytearray(good)), (2, bytearray(b"abc")), (3, None), (4, bytearray(good[:20])), (5, bytearray(good[:-1]))]
    found = {r.k: r for r in arrowio.decode(spark.createDataFrame(rows, "k int, data binary"), codec, keep=["k"]).collect()}
    assert [found[k].error and found[k].error.code for k in range(1, 6)] == [None, "insufficient_data", None, "invalid_binary", "string_too_short"]
    with pytest.raises(Exception, match="insufficient_data"):
        arrowio.decode(spark.createDataFrame(rows[:2], "k int, data binary"), codec, strict=True).collect()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, data binary")
    assert arrowio.decode(empty, records.EVENT).count() == 0
    assert arrowio.encode(spark.createDataFrame([], "event_id long"), records.EVENT).count() == 0
    assert evolution.Registry([records.EVENT]).decode(empty, keep=["id"]).count() == 0


def test_registry():
    r = evolution.Registry([records.ORDER, records.EVENT])
    assert r.lookup(100, 4) is records.EVENT and r.by_name("OrderCreated") is records.ORDER
    assert r.find_by_field("price") == [records.ORDER] and "symbol" in r.all_fields()
    assert r.summary() == {"codecs": 2, "fields": 16, "block_bytes": records.ORDER.block_length + records.EVENT.block_length}
    assert r.enum("OrderSide").values["sell"] == 1 and r.custom_type("Roles") is not None
    with pytest.raises(WireError, match="dispatch_conflict"):
        r.register(Codec("Other", [Field("a", "u8")], template_id=4, schema_id=100))
    with pytest.raises(WireError, match="unknown_message"):
        r.lookup(1, 1)


def test_lookup_keeps_null_keys(spark):
    e = spark.sql("SELECT 1 AS id, array(named_struct('k', 1, 'v', 'a'), named_struct('k', CAST(NULL AS INT), 'v', 'b'), named_struct('k', 1, 'v', 'c'), named_struct('k', CAST(NULL AS INT), 'v', 'd')) AS e")
    assert {r.key: r.entry.v for r in collections.lookup_map(e, "e", ["id"], "k").collect()} == {1: "c", None: "d"}
    assert e.select(collections.lookup_map_column(F.col("e"), "k").alias("m")).first().m[1].v == "c"
    assert [x.v for x in e.select(collections.lookup_list(F.col("e"), k=None).alias("l")).first().l] == ["b", "d"]
    with pytest.raises(WireError, match="uncovered_types"):
        collections.batch_key(records.box("padded_union").batches[0], Click="user_id")


def test_declared_lookups(spark):
    codec = Codec("Account", [Field("id", "u64")], template_id=5, groups=[Group("holds", (Field("hold", "u32"), Field("active", "bool")))], lookups={
        "by_hold": collections.Lookup("holds", key="hold"), "active": collections.Lookup("holds", "list", where=(("active", True),)),
    })
    rows = spark.createDataFrame([(1, [(7, True), (8, False), (7, False), (9, True)])], "id long, holds array<struct<hold:long,active:boolean>>")
    d = arrowio.encode(rows, codec, keep=["id"])
    assert {r.key: r.entry.active for r in collections.lookup(codec, d, "by_hold", keep=["id"]).collect()} == {7: False, 8: False, 9: True}
    assert [e.hold for e in collections.lookup(codec, d, "active").first().entries] == [7, 9]
    with pytest.raises(WireError, match="unknown_lookup"):
        collections.lookup(codec, d, "none")


def test_transcoder_errors():
    with pytest.raises(WireError, match="unknown_field"):
        evolution.Transcoder(records.SPAN, records.ENVELOPE, {"nope": "kind"})
    with pytest.raises(WireError, match="unknown_option"):
        evolution.Transcoder(records.SPAN, records.ENVELOPE, {}, "sometimes")
    with pytest.raises(WireError, match="unmapped_fields"):
        evolution.Transcoder(records.SPAN, records.ENVELOPE, {"flags": "flags"}).require_all()


def test_callback_and_requirements(spark):
    codec = Codec("C", [Field("a", "i32", "required"), Field("b", "i32")], checks=[
        validate.Callback("sum", ("a", "b"), lambda v: F.when(v["a"] + v["b"] > 10, F.lit("too much"))), validate.Present("b"), validate.Compare("a", ">", 0), validate.Compare("b", ">", 0),
    ])
    df = spark.createDataFrame([(1, 2), (9, 9), (None, None), (-1, None)], "a int, b int")
    found = [[e.code for e in r.errors] for r in validate.validate_columns(codec, df).collect()]
    assert found == [[], ["invariant_failed"], ["required_field", "required_field", "invariant_failed"], ["required_field", "invariant_failed"]]


def test_hooks_and_virtual_fields(spark):
    codec = Codec("H", [Field("a", "u8"), Field("v", "i32", default=5, virtual=True)], before_encode=lambda df: df.withColumn("a", F.col("a") + 1), after_decode=lambda df: df.withColumn("double", F.col("a") * 2))
    r = arrowio.decode(arrowio.encode(spark.createDataFrame([(1,)], "a int"), codec), codec, strict=True).first()
    assert (r.a, r.v, r.double) == (2, 5, 4)


def test_uuid_v5_vector(spark):
    import uuid

    r = spark.range(1).select(bx.dashed(scalars.uuid_v5("dns", F.lit("python.org"))).alias("u")).first()
    assert r.u == str(uuid.uuid5(uuid.NAMESPACE_DNS, "python.org"))


def test_stream(spark, tmp_path):
    codec = Codec("T", [Field("at", "datetime_us"), Field("kind", "u8")], template_id=3)
    base = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(base + dt.timedelta(minutes=i), i % 2) for i in range(20)], "at timestamp, kind int")
    arrowio.encode(rows, codec).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("data binary").parquet(str(tmp_path / "in"))
    q = streaming.to_table(streaming.decoded(streaming.matching(stream, codec, lambda f: f.kind == 1), codec), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    counts = streaming.windowed_counts(stream, codec, "at", "kind", "10 minutes", "1 minute")
    q = counts.writeStream.format("memory").queryName("packrow_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.n for r in spark.sql("SELECT n FROM packrow_counts").collect()) == [5, 5, 5, 5]


def test_group_limits(spark):
    g = Group("g", of="u8")
    codec = Codec("L", [Field("a", "u8")], groups=[g])
    with pytest.raises(WireError, match="max_entries_exceeded"):
        layout.pack(codec, {"g": [1] * 70_000})
    raw = lambda size, n, body: spark.range(1).select(F.lit(bytearray(size.to_bytes(2, "little") + n.to_bytes(2, "little") + body)).alias("data")).select(collections.group_error(data(), 0, 10, 50).alias("e")).first().e
    assert raw(0, 1, b"") == "invalid_block_length" and raw(1, 11, b"") == "max_entries_exceeded" and raw(10, 9, b"") == "max_bytes_exceeded" and raw(2, 3, b"12345") == "insufficient_data" and raw(2, 3, b"123456") is None


def test_string_access_grows_linearly(spark):
    codec = Codec("Strings", template_id=611, schema_id=61, fields=[Field("id", "u64"), *(Field(f"s{k}", "string16") for k in range(20))])
    row = {"id": 7} | {f"s{k}": "x" * k for k in range(20)}
    df = spark.createDataFrame([(bytearray(layout.pack(codec, row)),)], "data binary")
    read = df.select(*(access.get(codec, F.col("data"), f"s{k}").alias(f"s{k}") for k in range(20)))
    assert read.first().asDict() == {k: v or None for k, v in row.items() if k != "id"}
    size = lambda k: len(str(access.get(codec, F.col("data"), f"s{k}")._jc.toString()))
    assert size(19) - size(10) <= 1.2 * (size(10) - size(1))


def test_arrays_and_walk_agree():
    """Numpy decoding of mixed versions, absent and broken texts equals the walk over each record, and encoding the packing."""
    import random

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    new = Codec("Doc", template_id=5, schema_id=3, version=2, fields=[Field("a", "u32", presence="required"), Field("s", "string16"), Field("t", "string8", default="none"), Field("b", "i64"), Field("u", "string32")])
    old = Codec("Doc", template_id=5, schema_id=3, version=1, fields=[Field("a", "u32"), Field("s", "string16")])
    rng, rows = random.Random(1), []
    for i in range(400):
        text = lambda n: rng.choice([None, "", "é" * rng.randint(0, n), "x" * rng.randint(0, n)])
        c = rng.choice([new, new, old])
        x = layout.pack(c, {"a": i, "s": text(40), "t": text(20), "b": rng.choice([None, -i]), "u": text(99)})
        rows.append(rng.choice([x, x, x, None, x[: rng.randint(0, len(x))], x[:10] + bytes([rng.randint(0, 255)]) + x[11:], x[:2] + b"\x09" + x[3:], x[:8] + b"\xff" * 4 + x[12:], x.replace(b"x", b"\xfe")]))
    kinds = {f.name: to_arrow_type(f.dataType) for f in new.struct_type().fields}
    names = list(kinds)
    for part in (rows, rows[:1], [], [None]):
        data = pa.array([b"lead", *part], pa.binary())[1:]
        found, errors = arrowio.decode_batch(new, data, names)
        wanted, theirs = arrowio._walked(new, data, names, kinds, True, "error")
        assert [x.to_pylist() for x in found] == [x.to_pylist() for x in wanted] and errors.to_pylist() == theirs.to_pylist()
    good = [{"a": i, "s": rng.choice([None, "é" * i]), "t": rng.choice([None, "y"]), "b": i, "u": "z" * (i * 7)} for i in range(50)]
    batch = pa.RecordBatch.from_pylist(good)
    assert arrowio.encode_batch(new, batch).to_pylist() == [layout.pack(new, r) for r in good]
    with pytest.raises(WireError, match="out_of_range"):
        arrowio.encode_batch(new, pa.RecordBatch.from_pylist([{"a": 1, "t": "w" * 256}]))
