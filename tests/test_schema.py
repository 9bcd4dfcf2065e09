import pytest

from packrow.__main__ import main
from packrow.plans import breaking
from packrow.sources import schema_lang

TEXT = '''
@syntax 1
schema Trading { id: 100 version: 2 }
import "other.schema"
enum Side : u8 { buy = 1, doc: "a bid" sell = 2 }
type Price { mantissa: i64 exponent: i8 }
prefixed_id OrderId (prefix: "ord", tag: 3)
bitset Flags : u16 { hot = 0 cold = 9 }
struct Order (template_id: 1001) {
  id: OrderId   # a comment
  price: decimal(scale: 8), wire_format: i64
  cost: Price
  side: Side, presence: required, doc: "say \\"hi\\""
  code: char_array(length: 4)
  lane: u8, presence: constant, value: 3
  notes?: string16
  group fills { framing: length_prefixed qty: u32 who: string8 }
  group ids: u64 { }
  batch commands { any_of: [Place, Cancel] strategy: typed_frames }
}
struct Place (template_id: 1, version: 3) { id: u64 }
struct Cancel (template_id: 2) { id: u64, default: 4 }
'''


def test_parse_format_roundtrip():
    schema = schema_lang.parse_schema(TEXT)
    assert schema_lang.parse_schema(schema_lang.format_schema(schema)) == schema
    codecs = schema_lang.codecs(schema)
    order = codecs["Order"]
    assert order.offsets == {"id": 0, "price": 17, "cost_mantissa": 25, "cost_exponent": 33, "side": 34, "code": 35, "lane": 39} and order.block_length == 40
    assert codecs["Place"].version == 3 and [g.framed for g in order.groups] == [True, False]


@pytest.mark.parametrize("bad", ["message Old { }", "struct S { a: u8 }", "enum E : u64 { a = 1 }", "@syntax 2", "struct S (template_id: 1) { a: u8, odd: 3 }", "struct S (template_id: 1) { a u8 }", "%", 'enum E : u8 { a = 1 } enum E : u8 { a = 1 }', "schema { id: }", "struct " + "x" * 200 + " (template_id: 1) { }"])
def test_rejected(bad):
    with pytest.raises(schema_lang.SchemaError):
        schema_lang.parse_schema(bad)


def test_imports(tmp_path):
    (tmp_path / "a.schema").write_text('schema A { id: 7 }\nimport "b.schema"\nimport "sub/../c.schema"')
    (tmp_path / "b.schema").write_text('import "c.schema"\nstruct B (template_id: 1) { c: C }')
    (tmp_path / "c.schema").write_text("enum C : u8 { x = 1 }")
    schema = schema_lang.parse_file_with_imports(tmp_path / "a.schema")
    assert schema.id == 7 and list(schema.enums) == ["C"] and schema_lang.codecs(schema)["B"].block_length == 1
    (tmp_path / "c.schema").write_text('import "b.schema"')
    with pytest.raises(schema_lang.SchemaError, match="circular"):
        schema_lang.parse_file_with_imports(tmp_path / "a.schema")


def test_export_and_cli(tmp_path, capsys):
    text = "schema S { id: 3 }\nenum Side : u8 { buy = 0 }\nstruct O (template_id: 1) { side: Side n: u32 }"
    (tmp_path / "s.schema").write_text(text)
    out = tmp_path / "out"
    assert main(["export", str(tmp_path / "s.schema"), str(out)]) == 0
    assert main(["export", str(tmp_path / "s.schema"), str(out), "--check"]) == 0
    assert schema_lang.parse_file_with_imports(out / "schema.schema").structs["O"].template_id == 1
    (tmp_path / "t.schema").write_text(text.replace("n: u32", "n: u64"))
    assert main(["check", str(tmp_path / "s.schema"), str(tmp_path / "t.schema")]) == 1
    assert "WIRE_FIELD_TYPE_CHANGED" in capsys.readouterr().out
    assert main(["check", str(tmp_path / "s.schema"), str(tmp_path / "none")]) == 2
    assert main(["sql", str(tmp_path / "s.schema"), str(tmp_path / "f.sql")]) == 0
    assert "read_o(d BINARY)" in (tmp_path / "f.sql").read_text()


S = "schema X {{ id: 1 }}\nstruct M (template_id: 1) {{ {} }}\n{}"


@pytest.mark.parametrize(("old", "new", "rule"), [
    (S.format("a: u8 b: u8", ""), S.format("a: u8", ""), "WIRE_FIELD_REMOVED"),
    (S.format("a: u8 b: u16", ""), S.format("b: u16 a: u8", ""), "WIRE_FIELD_REORDERED"),
    (S.format("a: u8", ""), S.format("a: u8 s: string8", ""), "WIRE_VAR_FIELD_ADDED"),
    (S.format("a: u8", ""), S.format("a: u8 b: u8", ""), "WIRE_FIELD_ADDED_REQUIRED"),
    (S.format("s: string8", ""), S.format("s: string8 b?: u8", ""), "WIRE_FIXED_APPEND_BEFORE_TAIL"),
    (S.format("a: u8, since: 1", ""), S.format("a: u8, since: 2", ""), "WIRE_FIELD_SINCE_CHANGED"),
    (S.format("a: u8", ""), S.format("a: u8, presence: optional", ""), "WIRE_FIELD_PRESENCE_CHANGED"),
    (S.format("a: decimal, wire_format: i64", ""), S.format("a: decimal, wire_format: u64", ""), "WIRE_FIELD_WIRE_FORMAT_CHANGED"),
    (S.format("a: decimal(scale: 2)", ""), S.format("a: decimal(scale: 3)", ""), "WIRE_FIELD_TYPE_PARAMS_CHANGED"),
    (S.format("a: u8, presence: constant, value: 1", ""), S.format("a: u8, presence: constant, value: 2", ""), "WIRE_FIELD_CONSTANT_VALUE_CHANGED"),
    (S.format("a: u8", ""), S.format("a: u8", "").replace("template_id: 1", "template_id: 2"), "WIRE_TEMPLATE_ID_CHANGED"),
    (S.format("group g { a: u8 }", ""), S.format("", ""), "WIRE_GROUP_REMOVED"),
    (S.format("group g { a: u8 b: u8 }", ""), S.format("group g { b: u8 a: u8 }", ""), "WIRE_GROUP_FIELD_REORDERED"),
    (S.format("group g { a: u8 b: u8 }", ""), S.format("group g { a: u8 }", ""), "WIRE_GROUP_FIELD_REMOVED"),
    (S.format("group g { a: u8 }", ""), S.format("group g { a: u16 }", ""), "WIRE_GROUP_FIELD_TYPE_CHANGED"),
    (S.format("group g { a: u8 }", ""), S.format("group g { a: u8 b: u8 }", ""), "WIRE_GROUP_FIELD_ADDED_REQUIRED"),
    (S.format("batch b { any_of: [P, Q] }", ""), S.format("", ""), "WIRE_BATCH_REMOVED"),
    (S.format("batch b { any_of: [P, Q] }", ""), S.format("batch b { any_of: [P, Q] strategy: typed_frames }", ""), "WIRE_BATCH_STRATEGY_CHANGED"),
    (S.format("batch b { any_of: [P, Q] }", ""), S.format("batch b { any_of: [P] }", ""), "WIRE_BATCH_TYPE_REMOVED"),
    (S.format("batch b { any_of: [P, Q] }", ""), S.format("batch b { any_of: [Q, P] }", ""), "WIRE_BATCH_TYPE_REORDERED"),
    (S.format("", "enum E : u8 { a = 1 }"), S.format("", "enum E : u16 { a = 1 }"), "WIRE_ENUM_UNDERLYING_CHANGED"),
    (S.format("", "enum E : u8 { a = 1 b = 2 }"), S.format("", "enum E : u8 { a = 1 }"), "WIRE_ENUM_VALUE_REMOVED"),
    (S.format("", "enum E : u8 { a = 1 }"), S.format("", "enum E : u8 { a = 2 }"), "WIRE_ENUM_VALUE_CHANGED"),
    (S.format("", "char_array C (length: 4)"), S.format("", "char_array C (length: 5)"), "WIRE_CHAR_ARRAY_LENGTH_CHANGED"),
    (S.format("", "bitset B : u8 { a = 1 }"), S.format("", "bitset B : u16 { a = 1 }"), "WIRE_BITSET_UNDERLYING_CHANGED"),
    (S.format("", "bitset B : u8 { a = 1 b = 2 }"), S.format("", "bitset B : u8 { a = 1 }"), "WIRE_BITSET_FLAG_REMOVED"),
    (S.format("", "bitset B : u8 { a = 1 }"), S.format("", "bitset B : u8 { a = 2 }"), "WIRE_BITSET_FLAG_VALUE_CHANGED"),
    (S.format("", 'prefixed_id P (prefix: "a", tag: 1)'), S.format("", 'prefixed_id P (prefix: "b", tag: 1)'), "SOURCE_PREFIXED_ID_PREFIX_CHANGED"),
    (S.format("a: u8", ""), S.format("b: u8", ""), "SOURCE_FIELD_RENAMED"),
    (S.format("a: u8", ""), S.format("a: u8, presence: required", ""), "SOURCE_FIELD_MADE_REQUIRED"),
    (S.format("", "enum E : u8 { a = 1 }"), S.format("", "enum F : u8 { a = 1 }"), "SOURCE_ENUM_RENAMED"),
    (S.format("", "type T { a: u8 }"), S.format("", "type U { a: u8 }"), "SOURCE_TYPE_RENAMED"),
    (S.format("a: u8", ""), S.format("a: u8", "").replace("id: 1 }\n", "id: 2 }\n", 1), "SOURCE_SCHEMA_ID_CHANGED"),
    (S.format('a: u8, doc: "x"', ""), S.format('a: u8, doc: "y"', ""), "DOC_FIELD_DOC_CHANGED"),
    (S.format("", "enum E : u8 { a = 1 }"), S.format("", 'enum E : u8 { a = 1, doc: "x" }'), "DOC_ENUM_VALUE_DOC_ADDED"),
])
def test_rules(old, new, rule):
    assert rule in {f.rule for f in breaking.check(old, new, breaking.Config(include_docs=True))}
    assert not breaking.check(old, old, breaking.Config(include_docs=True))
    assert rule not in {f.rule for f in breaking.check(old, new, breaking.Config(include_docs=True, excepted=(rule,)))}
