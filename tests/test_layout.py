import datetime as dt
import decimal
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from packrow import layout, types
from packrow.layout import Batch, Codec, Field, Group
from packrow.types import Bitset, CharArray, Enum, PrefixedId, Scaled, WireError

SIDE = Enum("Side", ["buy", "sell"])
ALL = Codec("All", [
    Field("a", "u64"), Field("b", "i64"), Field("c", "bool"), Field("d", "uuid_string"), Field("e", "timestamp_us"), Field("f", "datetime_us"), Field("g", "decimal"),
    Field("h", Bitset("R", {"x": 0, "y": 3})), Field("i", CharArray(8)), Field("j", SIDE), Field("k", PrefixedId("usr", 4)), Field("l", Scaled(3)), Field("m", "f64"), Field("n", "string16"),
], template_id=1)


def test_header_bytes():
    assert layout.HEADER.pack(32, 1, 0, 1) == bytes([0x20, 0, 1, 0, 0, 0, 1, 0])


def test_offsets_and_alignment():
    fields = [Field("a", "u8"), Field("b", "u32"), Field("c", "u16"), Field("d", "u64")]
    assert Codec("P", fields).offsets == {"a": 0, "b": 1, "c": 5, "d": 7}
    aligned = Codec("Q", fields, aligned=True)
    assert aligned.offsets == {"a": 0, "b": 4, "c": 8, "d": 16} and aligned.block_length == 24
    assert types.padding_for(5, 4) == 3 and types.align(5, 4) == 8


def test_null_record_roundtrips():
    found = layout.unpack(ALL, layout.pack(ALL, {}))
    assert found.pop("h") == [] and found.pop("i") == ""
    assert set(found.values()) == {None}


def test_values_roundtrip():
    record = {
        "a": 2**64 - 2, "b": -5, "c": False, "d": str(uuid.UUID(int=7)), "e": -3, "f": dt.datetime(2024, 2, 29, 1, 2, 3, 4, tzinfo=dt.timezone.utc), "g": decimal.Decimal("12.340"),
        "h": ["x", "y"], "i": "abc", "j": "sell", "k": f"usr-{uuid.UUID(int=9)}", "l": decimal.Decimal("-1.250"), "m": 0.1, "n": "häß",
    }
    assert layout.unpack(ALL, layout.pack(ALL, record)) == record


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 2), st.integers(0, 2**32 - 2)), max_size=20), st.lists(st.text(max_size=20), max_size=8))
def test_groups_roundtrip(entries, names):
    codec = Codec("G", [Field("id", "u8")], groups=[Group("g", (Field("p", "u64"), Field("q", "u32"))), Group("n", of="string16"), Group("s", of="u32")])
    record = {"id": 1, "g": [{"p": p, "q": q} for p, q in entries], "n": names, "s": [q for _, q in entries]}
    found = layout.unpack(codec, layout.pack(codec, record))
    assert found == record | {"n": [x or None for x in names]}


@pytest.mark.parametrize("strategy", layout.STRATEGIES)
def test_batches_keep_order(strategy):
    one, two = Codec("One", [Field("x", "u32")]), Codec("Two", [Field("y", "u64"), Field("z", "u8")])
    codec = Codec("B", [Field("id", "u8")], batches=[Batch("b", (one, two), strategy)])
    rows = [{"seq": i, "tag": i % 2, "One": {"x": i} if i % 2 == 0 else None, "Two": {"y": i, "z": 1} if i % 2 else None} for i in range(7)]
    assert layout.unpack(codec, layout.pack(codec, {"id": 3, "b": rows}))["b"] == rows
    with pytest.raises(WireError, match="not_in_any_of"):
        layout.pack(codec, {"id": 3, "b": [{"seq": 0, "tag": 9}]})


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=120))
def test_random_bytes_never_crash(raw):
    for header in (True, False):
        try:
            layout.unpack(ALL, raw, header)
        except WireError as e:
            assert e.code


def test_evolution():
    old = Codec("E", [Field("id", "u64")], template_id=9)
    data = layout.pack(old, {"id": 5})
    new = lambda **o: Codec("E", [Field("id", "u64"), Field("n", "u32", since=2, **o)], template_id=9, version=2)
    assert layout.unpack(new(), data) == {"id": 5, "n": None}
    assert layout.unpack(new(presence="required", default=0), data) == {"id": 5, "n": 0}
    for codec, code in ((new(presence="required"), "required_field_absent"), (Codec("E", [Field("id", "u64")], template_id=8), "template_id_mismatch"), (Codec("E", [Field("id", "u64")], template_id=9, schema_id=3), "schema_id_mismatch")):
        with pytest.raises(WireError) as e:
            layout.unpack(codec, data)
        assert e.value.code == code
    with pytest.raises(WireError, match="version_too_new"):
        layout.unpack(old, layout.pack(new(), {"id": 1}))
    constant = Codec("E", [Field("id", "u64"), Field("lane", "u8", "constant", value=3)], template_id=9, version=2)
    assert layout.unpack(constant, data)["lane"] == 3


def test_definition_errors():
    with pytest.raises(WireError, match="since_decreases"):
        Codec("S", [Field("a", "u8", since=3), Field("b", "u8", since=2)])
    with pytest.raises(WireError, match="duplicate_field"):
        Codec("S", [Field("a", "u8"), Field("a", "u8")])
    with pytest.raises(WireError, match="not_fixed_size"):
        Group("g", (Field("s", "string16"),))
    with pytest.raises(WireError, match="out_of_range"):
        layout.pack(Codec("S", [Field("a", "u8")]), {"a": 300})
    with pytest.raises(WireError, match="required_field"):
        layout.pack(Codec("S", [Field("a", "u8", "required")]), {})
    assert Codec("S", [Field("a", "u8")], field_defaults={"presence": "required"}).field("a").presence == "required"
