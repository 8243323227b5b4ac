"""Pointer (P1, P2), root rename (P3) and target layout (D1-D11) — FIXTURES §1, §2."""

import json

import pytest
from pyspark.sql import functions as F

from tidewater.functions import pointer as jp
from tidewater.functions.documents import rename_root_id
from tidewater.plans import layout
from tidewater.settings import EPOCH_WATERMARK

DOC = '{"ship":{"hull":"oak","masts":3},"crew":[["ann","bo"],{"0":"cy"}],"x/y":{"~":[null,false]},"no":7}'


@pytest.mark.parametrize("pointer,want", [
    ("/ship", '{"hull":"oak","masts":3}'),
    ("/ship/masts", "3"),
    ("/crew/0/1", '"bo"'),
    ("/crew/1/0", '"cy"'),
    ("/x~1y", '{"~":[null,false]}'),
    ("/x~1y/~0/1", "false"), ("/x~1y/~0/0", "null"),
    ("/keel", None), ("/crew/7", None), ("/no/deeper", None), ("/crew/-1", None),
])
def test_pointer_extract(spark, pointer, want):
    df = spark.createDataFrame([(DOC,)], "b string")
    got = df.select(jp.extract_text(F.try_parse_json("b"), jp.segments(pointer))).first()[0]
    assert got == want


def test_pointer_of_many_numeric_tokens(spark):
    depth = 40
    doc = '{"0":' * depth + "[5]" + "}" * depth
    df = spark.createDataFrame([(doc,)], "b string")
    assert len(jp.steps(["0"] * depth)) == depth
    got = df.select(jp.extract_text(F.try_parse_json("b"), ["0"] * (depth + 1))).first()[0]
    assert got == "5"


def test_pointer_tokens():
    assert jp.segments(None) == [] and jp.segments("") == [] and jp.segments("   ") == []
    assert jp.segments("/p~1q/r~0s/~01/") == ["p/q", "r~s", "~1", ""]
    with pytest.raises(jp.PointerError):
        jp.segments("ship")
    assert jp.normalise("  ") is None


def test_pointer_on_invalid_json_is_missing(spark):
    df = spark.createDataFrame([("not json",)], "b string")
    assert df.select(jp.resolve(F.try_parse_json("b"), ["ship"]).isNull()).first()[0]


@pytest.mark.parametrize("body,want", [
    ('{"depth":9,"id":[1,{"id":2}]}', '{"depth":9,"push_event_id":[1,{"id":2}]}'),
    ('{"id":null,"push_event_id":0}', '{"id":null,"push_event_id":0}'),
    ('{"cargo":[{"id":"tin"}],"ID":1}', '{"cargo":[{"id":"tin"}],"ID":1}'),
    ('{}', '{}'),
    ('["id"]', '["id"]'),
    ('"id"', '"id"'),
    ('{"id":1} x', '{"id":1} x'),
    ('{"id":1},{"id":2}', '{"id":1},{"id":2}'),
    ('{"id":1', '{"id":1'),
])
def test_rename_root_id(spark, body, want):
    df = spark.createDataFrame([(body,)], "b string")
    assert df.select(rename_root_id(F.col("b"), F.try_parse_json("b"))).first()[0] == want


def _schema(fields, name="Voyage"):
    return json.dumps({"type": "record", "name": name, "fields": fields})


def _record(name, *fields):
    return {"type": "record", "name": name, "fields": [{"name": n, "type": t} for n, t in fields]}


VOYAGE = _schema([{"name": "id", "type": "long"}, {"name": "timestampUTC", "type": "string"},
                  {"name": "hold", "type": _record("Hold", ("tons", "float"), ("sealed", "boolean"), ("lot", "bytes"),
                                                   ("grade", {"type": "enum", "name": "G", "symbols": ["A", "B"]}))}])
BY_PORT = _schema([{"name": "captain", "type": "string"}, {"name": "calls", "type": {"type": "map", "values": "int"}}])
LISTS = _schema([{"name": "log", "type": _record("Log", ("page", "int"), ("winds", {"type": "array", "items": "double"}),
                                                 ("marks", {"type": "map", "values": "string"}))}])
THREE_DEEP = _schema([{"name": "fleet", "type": _record("Fleet", ("ship", _record("Ship", ("deck", _record("Deck", ("planks", "int"))))))}])
MAYBE = _schema([{"name": "tow", "type": ["null", _record("Tow", ("length", "double"))]}])
ID_WITHIN = _schema([{"name": "id", "type": "string"}, {"name": "mate", "type": _record("Mate", ("id", "int"))}])


def names_types(schema, pointer=None, key="K"):
    return [(c.name, c.type) for c in layout.resolve_columns(schema, None, pointer, key)]


@pytest.mark.parametrize("schema,pointer,want", [
    (VOYAGE, None, [("push_event_id", "long"), ("timestampUTC", "string"), ("hold", "variant")]),
    (VOYAGE, "", [("push_event_id", "long"), ("timestampUTC", "string"), ("hold", "variant")]),
    (BY_PORT, None, [("captain", "string"), ("calls", "variant"), ("timestampUTC", "string")]),
    (LISTS, "/log", [("page", "int"), ("winds", "variant"), ("marks", "variant"), ("timestampUTC", "string")]),
    (THREE_DEEP, "/fleet/ship/deck", [("planks", "int"), ("timestampUTC", "string")]),
    (MAYBE, "/tow", [("length", "double"), ("timestampUTC", "string")]),
    (ID_WITHIN, "/mate", [("id", "int"), ("timestampUTC", "string")]),
])
def test_derived_layouts(schema, pointer, want):
    assert names_types(schema, pointer) == want + [("K", "string")]


@pytest.mark.parametrize("schema,pointer,fragment", [
    (VOYAGE, "/keel", "declares no field 'keel'"),
    (BY_PORT, "/calls", "must be an Avro record"),
    (json.dumps({"type": "array", "items": "long"}), None, "must be an Avro record"),
    (_schema([{"name": "helm", "type": "int"}, {"name": "HELM", "type": "int"}]), None, "duplicate"),
])
def test_layout_errors(schema, pointer, fragment):
    with pytest.raises(layout.LayoutError, match=fragment):
        layout.derive_columns(schema, pointer)


def test_layout_pointer_not_rfc6901():
    with pytest.raises(jp.PointerError):
        layout.derive_columns(VOYAGE, "hold")


def test_same_name_at_two_depths_and_nullable_unwrapped():
    s = _schema([{"name": "berth", "type": "int"}, {"name": "quay", "type": _record("Quay", ("berth", "int"))},
                 {"name": "fee", "type": ["null", "double"], "default": None}])
    assert names_types(s) == [("berth", "int"), ("quay", "variant"), ("fee", "double"), ("timestampUTC", "string"), ("K", "string")]


def test_hand_columns_and_precedence():
    assert [(c.name, c.type) for c in layout.resolve_columns(None, [("berth", "int"), ("note", "string")], None, "K")] == \
        [("berth", "int"), ("note", "string"), ("timestampUTC", "string"), ("K", "string")]
    upper = [("BERTH", "int"), ("TIMESTAMPUTC", "string"), ("k", "string")]
    assert [(c.name, c.type) for c in layout.resolve_columns(None, upper, None, "K")] == upper
    # payload schema beats the hand-written list
    chosen = layout.resolve_columns(VOYAGE, [("other", "int")], None, "K")
    assert [c.name for c in chosen] == ["push_event_id", "timestampUTC", "hold", "K"]


def test_types_and_properties(spark):
    assert layout.spark_type("TimeStamp", "t").simpleString() == "timestamp"
    with pytest.raises(layout.LayoutError, match="Supported: string"):
        layout.spark_type("decimal", "d")
    cols = layout.resolve_columns(VOYAGE, None, None, "K")
    assert layout.creation_properties(cols) == {"format-version": "3"}
    assert layout.creation_properties(layout.resolve_columns(None, [("a", "int")], None, "K")) == {}
    assert all(f.nullable for f in layout.struct_type(cols).fields)
    assert layout.initial_properties(None, None) == {"comment": EPOCH_WATERMARK}
    assert layout.initial_properties({"comment": "x", "a": "b"}, "  ") == {"comment": "x", "a": "b"}
    assert layout.initial_properties({"a": "b"}, "/hold") == {
        "a": "b", "comment": EPOCH_WATERMARK, "json-pointer-expression": "/hold"}


def test_pointer_key_with_both_quote_kinds(spark):
    body = json.dumps({"a'b\"c": {"x": [10, 20]}, "plain": 1})
    df = spark.createDataFrame([(body,)], "b string")
    v = F.try_parse_json("b")
    got = df.select(jp.extract_text(v, jp.segments("/a'b\"c/x/1")).alias("hit"),
                    jp.extract_text(v, jp.segments("/a'b\"c/y")).alias("miss")).first()
    assert got["hit"] == "20" and got["miss"] is None


@pytest.mark.parametrize("body, want", [
    ('{ "a" : {"id":2} ,\t"id" : 123456789012345678901234567890123456789012 }', '{ "a" : {"id":2} ,\t"push_event_id" : 123456789012345678901234567890123456789012 }'),
    ('{"z":{"b":1.50,"a":2},"id":1e0}', '{"z":{"b":1.50,"a":2},"push_event_id":1e0}'),
    (r'{"a":"x\"id\":","\u0069d":[1,  2]}', r'{"a":"x\"id\":","push_event_id":[1,  2]}'),
    (r'{"a":[{"id":1},{"id":2}],"id":"😀\\","c":"]}"}', r'{"a":[{"id":1},{"id":2}],"push_event_id":"😀\\","c":"]}"}'),
    ('\n{"id"\n:\r3,"é\\n":"id"}\n', '\n{"push_event_id"\n:\r3,"é\\n":"id"}\n'),
    ('{"id":"id"}', '{"push_event_id":"id"}'), ('{"x":"id"}', '{"x":"id"}'), ('{"id":1}{"id":2}', '{"id":1}{"id":2}'), ('{"id":1,"id":2}', '{"id":1,"id":2}'),
    ('{"k":[' + '{"id":0},' * 3000 + '0],"id":1}', '{"k":[' + '{"id":0},' * 3000 + '0],"push_event_id":1}'),
    ('{"s":"' + '\\"{[' * 5000 + '","id":1}', '{"s":"' + '\\"{[' * 5000 + '","push_event_id":1}'),
])
def test_rename_changes_nothing_but_the_name(spark, body, want):
    df = spark.createDataFrame([(body,)], "b string")
    assert df.select(rename_root_id(F.col("b"), F.try_parse_json("b"))).first()[0] == want
