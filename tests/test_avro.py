"""Schema identity and the conformity predicate (P11, F6) — FIXTURES §3, §4."""

import json

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidewater.plans import avro
from tidewater.plans.predicate import conforms

# A schema whose fingerprints are known from outside this engine.
GOLDEN = {"type": "record", "name": "Order", "namespace": "test",
          "fields": [{"name": "id", "type": "string"}, {"name": "amount", "type": "int"}]}
BUOY = {"type": "record", "name": "Buoy", "namespace": "sea", "fields": [
    {"name": "code", "type": "string"}, {"name": "drift", "type": "int"}, {"name": "lit", "type": "boolean"}]}
BUOY_TEXT = json.dumps(BUOY)


def rec(ftype, default=None):
    f = {"name": "a", "type": ftype}
    if default is not None:
        f["default"] = default
    return json.dumps({"type": "record", "name": "R", "fields": [f]})


def test_golden_fingerprints():
    assert avro.fingerprint(avro.parse_schema(json.dumps(GOLDEN))) == "76f04e43b5d19de7"
    swapped = dict(GOLDEN, fields=list(reversed(GOLDEN["fields"])))
    assert avro.fingerprint(avro.parse_schema(json.dumps(swapped))) == "cab5cea5890da432"
    # whitespace, comments and non-parsing attributes do not change the fingerprint
    noisy = json.dumps(dict(GOLDEN, doc="// d /* e */"), indent=4).replace("{", "{ // note\n /* more */", 1)
    assert avro.fingerprint(avro.parse_schema(noisy)) == "76f04e43b5d19de7"


def test_canonical_form():
    pcf = avro.canonical_form(avro.parse_schema(json.dumps(dict(BUOY, doc="ignored", aliases=["B"]))))
    assert pcf == ('{"name":"sea.Buoy","type":"record","fields":[{"name":"code","type":"string"},'
                   '{"name":"drift","type":"int"},{"name":"lit","type":"boolean"}]}')


@pytest.mark.parametrize("ftype, default, fits", [
    ("int", 5, True), ("int", "5", False), ("int", 2 ** 31, False), ("long", 2 ** 31, True), ("double", 1, True), ("float", "x", False),
    ("string", "s", True), ("string", None, False), (["null", "int"], None, True), (["null", "int"], 3, True), (["null", "int"], "x", False),
    ({"type": "array", "items": "int"}, [1], True), ({"type": "array", "items": "int"}, ["a"], False),
    ({"type": "map", "values": "string"}, {}, True), ({"type": "map", "values": "string"}, [], False), ("boolean", 0, False),
    ({"type": "record", "name": "In", "fields": [{"name": "k", "type": "int", "default": 1}]}, {}, True),
    ({"type": "record", "name": "In", "fields": [{"name": "k", "type": "int"}]}, {}, False),
])
def test_defaults_rule_the_schema(ftype, default, fits):
    text = json.dumps({"type": "record", "name": "R", "fields": [{"name": "a", "type": ftype, "default": default}]})
    if fits:
        avro.parse_schema(text)
    else:
        with pytest.raises(avro.AvroSchemaError):
            avro.parse_schema(text)


@pytest.mark.parametrize("text", ['{"type":"record","name":"B","fields":[{"name":"id"}]}', "not json",
                                  '{"type":"nope"}', '["int","int"]', '{"type":"record","name":"1x","fields":[]}'])
def test_bad_schemas_raise(text):
    with pytest.raises(avro.AvroSchemaError):
        avro.parse_schema(text)


MATRIX = [
    (BUOY_TEXT, '{"code":"b7","drift":-4,"lit":true}', True),
    (BUOY_TEXT, '{"lit":false,"drift":0,"code":""}', True),
    (BUOY_TEXT, '{"code":"b7","drift":2.0,"lit":true}', True),
    (BUOY_TEXT, '{"code":"b7","drift":2.25,"lit":true}', False),
    (BUOY_TEXT, '{"code":"b7","drift":4000000000,"lit":true}', False),
    (BUOY_TEXT, '{"code":"b7","drift":"2","lit":true}', False),
    (BUOY_TEXT, '{"code":7,"drift":2,"lit":true}', False),
    (BUOY_TEXT, '{"code":null,"drift":2,"lit":true}', False),
    (BUOY_TEXT, '{"code":"b7","drift":2}', False),
    (BUOY_TEXT, '{"w":[],"code":"b7","x":{},"drift":2,"lit":true,"z":0}', True),
    (BUOY_TEXT, '{"code":"b7","drift":2,"lit":true} tail', True),
    (BUOY_TEXT, '{"code":"b7","drift":2,"lit":', False),
    (BUOY_TEXT, '[{"code":"b7","drift":2,"lit":true}]', False),
    (BUOY_TEXT, "plain", False),
    (rec("int"), '{"a":1e-11}', False), (rec("int"), '{"a":1.00000000001}', True), (rec("int"), '{"a":1e3}', True),
    (rec("int"), '{"a":2147483647}', True), (rec("int"), '{"a":-2147483649}', False), (rec("int"), '{"a":1e300}', False),
    (rec("long"), '{"a":1e-11}', False), (rec("long"), '{"a":1.00000000001}', False), (rec("long"), '{"a":9223372036854775807}', True),
    (rec("long"), '{"a":9223372036854775808}', False), (rec("long"), '{"a":5e2}', True), (rec("long"), '{"a":99999999999999999999999999999999999999999}', False),
    (rec(["null", "int"]), '{"a":{"int":3}}', True),
    (rec(["null", "int"]), '{"a":null}', True),
    (rec(["null", "int"]), '{"a":3}', False),
    (rec(["null", "string"], "none"), "{}", False),
    (rec("int", 5), "{}", False),
    (rec("long"), '{"a":1.9}', False),
    (rec("double"), '{"a":3}', True),
    (rec("double"), '{"a":"NaN"}', False),
    (rec("float"), '{"a":1e300}', True),
    (rec("boolean"), '{"a":"true"}', False),
    (rec("boolean"), '{"a":true}', True),
    (rec("bytes"), '{"a":"anything"}', True),
    (rec({"type": "enum", "name": "E", "symbols": ["X", "Y"]}), '{"a":"X"}', True),
    (rec({"type": "enum", "name": "E", "symbols": ["X", "Y"]}), '{"a":"Z"}', False),
    (rec({"type": "map", "values": "string"}), '{"a":{"k":"v"}}', True),
    (rec({"type": "map", "values": "string"}), '{"a":{"k":1}}', False),
    (rec({"type": "array", "items": "int"}), '{"a":[1,2]}', True),
    (rec({"type": "array", "items": "int"}), '{"a":[1,"2"]}', False),
    (rec({"type": "array", "items": "int"}), '{"a":[]}', True),
    (rec({"type": "array", "items": "int"}), '{"a":{}}', False),
    (rec({"type": "fixed", "name": "F", "size": 2}), '{"a":"ab"}', True),
    (rec({"type": "fixed", "name": "F", "size": 2}), '{"a":"abc"}', False),
    (rec(["null", {"type": "record", "name": "In", "fields": [{"name": "x", "type": "int"}]}]),
     '{"a":{"In":{"x":1}}}', True),
    (rec(["null", "int", "string"]), '{"a":{"int":1,"string":"x"}}', False),
    (rec("null"), '{"a":null}', True),
    (rec({"type": "record", "name": "Q", "fields": []}), '{"a":{}}', True),
    (rec({"type": "record", "name": "Q", "fields": []}), '{"a":[]}', False),
]


def test_conformity_matrix(spark):
    rows = [(i, s, b) for i, (s, b, _) in enumerate(MATRIX)]
    df = spark.createDataFrame(rows, "i int, s string, b string").withColumn("v", F.try_parse_json("b"))
    exprs = [F.when(F.col("i") == i, conforms(avro.parse_schema(s), F.col("v"))) for i, (s, _, _) in enumerate(MATRIX)]
    got = dict(df.select("i", F.coalesce(*exprs).alias("ok")).collect())
    for i, (s, b, want) in enumerate(MATRIX):
        assert got[i] is want, (s, b)
        assert avro.conforms_text(avro.parse_schema(s), b) is want, (s, b)


def test_recursive_schema_detected():
    t = avro.parse_schema('{"type":"record","name":"Node","fields":[{"name":"next","type":["null","Node"]}]}')
    assert avro.is_recursive(t)
    assert avro.conforms_text(t, '{"next":{"Node":{"next":null}}}')
    assert not avro.conforms_text(t, '{"next":{"Node":{}}}')


NESTED = avro.parse_schema(json.dumps({
    "type": "record", "name": "Top", "fields": [
        {"name": "id", "type": "string"},
        {"name": "n", "type": ["null", "long"]},
        {"name": "tags", "type": {"type": "array", "items": "string"}},
        {"name": "attrs", "type": {"type": "map", "values": "double"}},
        {"name": "inner", "type": {"type": "record", "name": "In", "fields": [{"name": "k", "type": "int"}]}},
    ]}))

json_scalars = st.one_of(st.none(), st.booleans(), st.integers(-2 ** 40, 2 ** 40), st.text(max_size=4),
                         st.floats(allow_nan=False, allow_infinity=False, width=32))
json_values = st.recursive(json_scalars, lambda kids: st.one_of(
    st.lists(kids, max_size=3), st.dictionaries(st.sampled_from(["id", "n", "k", "long", "x"]), kids, max_size=3)),
    max_leaves=8)
bodies = st.fixed_dictionaries({}, optional={
    "id": st.one_of(st.text(max_size=3), json_scalars),
    "n": st.one_of(st.none(), st.fixed_dictionaries({"long": st.integers(-5, 5)}), json_values),
    "tags": st.one_of(st.lists(st.text(max_size=2), max_size=3), json_values),
    "attrs": st.one_of(st.dictionaries(st.text(max_size=2), st.integers(-3, 3), max_size=3), json_values),
    "inner": st.one_of(st.fixed_dictionaries({"k": st.integers(-2 ** 33, 2 ** 33)}), json_values),
    "extra": json_values,
})


@settings(max_examples=25, deadline=None)
@given(st.lists(bodies, min_size=1, max_size=20))
def test_predicate_matches_brute_force(spark, docs):
    texts = [json.dumps(d) for d in docs]
    df = spark.createDataFrame([(t,) for t in texts], "b string")
    got = [r[0] for r in df.select(conforms(NESTED, F.try_parse_json("b"))).collect()]
    assert got == [avro.conforms_text(NESTED, t) for t in texts]


def _program_verdicts(spark, cases):
    """Evaluate (schema text, body) pairs through data-driven check programs."""
    from tidewater.plans import checks as CK
    rows = []
    for i, (s, b) in enumerate(cases):
        prog = CK.program(avro.parse_schema(s))
        rows.append((i, b, prog))
    df = spark.createDataFrame(rows, f"i int, b string, checks {CK.CHECKS.simpleString()}")
    out = df.select("i", F.when(F.col("checks").isNotNull(), CK.run(F.try_parse_json("b"), F.col("checks")))
                    .alias("ok"))
    return dict(out.collect())


def test_conformity_matrix_through_programs(spark):
    got = _program_verdicts(spark, [(s, b) for s, b, _ in MATRIX])
    covered = 0
    for i, (s, b, want) in enumerate(MATRIX):
        if got[i] is not None:                     # schemas with a program
            covered += 1
            assert got[i] is want, (s, b)
    assert covered >= len(MATRIX) - 2              # only the multi-branch union needs the compiled path


@settings(max_examples=25, deadline=None)
@given(st.lists(bodies, min_size=1, max_size=20))
def test_program_matches_brute_force(spark, docs):
    from tidewater.plans import checks as CK
    prog = CK.program(NESTED)
    assert prog is not None
    texts = [json.dumps(d) for d in docs]
    df = spark.createDataFrame([(t, prog) for t in texts], f"b string, checks {CK.CHECKS.simpleString()}")
    got = [r[0] for r in df.select(CK.run(F.try_parse_json("b"), F.col("checks"))).collect()]
    assert got == [avro.conforms_text(NESTED, t) for t in texts]


def test_program_nullable_record_guards(spark):
    s = json.dumps({"type": "record", "name": "T", "fields": [
        {"name": "p", "type": ["null", {"type": "record", "name": "P", "fields": [
            {"name": "k", "type": "int"}, {"name": "q", "type": ["null", "string"]}]}]}]})
    cases = [(s, '{"p":null}'), (s, '{"p":{"P":{"k":1,"q":null}}}'), (s, '{"p":{"P":{"k":1,"q":{"string":"x"}}}}'),
             (s, '{"p":{"P":{"k":"1","q":null}}}'), (s, '{"p":{"k":1,"q":null}}'), (s, "{}"),
             (s, '{"p":{"P":{"k":1}}}')]
    got = _program_verdicts(spark, cases)
    for i, (schema, body) in enumerate(cases):
        assert got[i] is avro.conforms_text(avro.parse_schema(schema), body), body
