"""The whole gate against a direct Python statement of its rule chain, on random requests."""

import datetime as dt
import json

from hypothesis import given, settings, strategies as st

from tidewater.functions import pointer as jp
from tidewater.operators import gate as G
from tidewater.plans import avro
from tidewater.plans.routes import compile_routes
from tidewater.settings import Settings
from tidewater.sources import requests as RQ
from tidewater.sources import routes as R

MAX = 64
SCHEMA = json.dumps({"type": "record", "name": "E", "fields": [
    {"name": "id", "type": "string"}, {"name": "n", "type": ["null", "int"]},
    {"name": "p", "type": {"type": "record", "name": "P", "fields": [{"name": "k", "type": "long"}]}}]})
ROUTES = {
    "bare": {},
    "schema": {"payloadSchema": SCHEMA},
    "ptr": {"jsonExpressionPointer": "/p/k"},
    "both": {"payloadSchema": SCHEMA, "jsonExpressionPointer": "/p"},
    "badschema": {"payloadSchema": '{"type":"record"'},
    "badptr": {"jsonExpressionPointer": "p/k"},
}
PARSED = avro.parse_schema(SCHEMA)


def _doc(body):
    """The body as the gate sees it: JSON (trailing text allowed), duplicate keys rejected."""
    def no_dups(pairs):
        keys = [k for k, _ in pairs]
        if len(keys) != len(set(keys)):
            raise ValueError("dup")
        return dict(pairs)
    try:
        return json.JSONDecoder(object_pairs_hook=no_dups).raw_decode(body.lstrip())[0], True
    except ValueError:
        return None, False


def _resolves(doc, tokens):
    cur = doc
    for t in tokens:
        if isinstance(cur, dict) and t in cur:
            cur = cur[t]
        elif isinstance(cur, list) and t.lstrip("+").isdigit() and int(t) < len(cur):
            cur = cur[int(t)]
        else:
            return False
    return True


def expected(r):
    route = ROUTES.get(r["producer"]) if r["api_version"] == "v1" else None
    if route is None:
        return 404
    ct = r["content_type"]
    if ct is None or ct.split(";", 1)[0].strip().lower() != "application/json":
        return 415
    n, body = r["content_length"], r["body"]
    if n is None:
        return 411
    if n > MAX:
        return 413
    if n <= 0:
        return 400
    if body is None or body == "":
        return 400
    if "payloadSchema" in route and route["payloadSchema"] == SCHEMA and not avro.conforms_text(PARSED, body):
        return 400
    pointer = route.get("jsonExpressionPointer")
    if pointer is not None:
        try:
            tokens = jp.segments(pointer)
        except jp.PointerError:
            return 500
        doc, ok = _doc(body)
        if not ok or not _resolves(doc, tokens):
            return 400
    return 202


bodies = st.one_of(
    st.none(), st.just(""), st.just("x"), st.just('{"id":"a","id":"b","p":{"k":1}}'),
    st.builds(lambda i, n, k, junk: json.dumps({"id": i, "n": n, "p": {"k": k}}) + junk,
              st.one_of(st.text(max_size=3), st.integers(0, 3)),
              st.one_of(st.none(), st.fixed_dictionaries({"int": st.integers(-5, 5)}), st.integers(0, 3)),
              st.one_of(st.integers(-10, 10), st.text(max_size=2), st.floats(-2, 2, allow_nan=False)),
              st.sampled_from(["", " trailing"])),
    st.builds(lambda s: s[: len(s) // 2], st.builds(json.dumps, st.fixed_dictionaries({"id": st.text(max_size=3)}))),
)
requests = st.fixed_dictionaries({
    "producer": st.sampled_from(list(ROUTES) + ["unknown"]),
    "api_version": st.sampled_from(["v1", "v1", "v1", "v2"]),
    "content_type": st.sampled_from(["application/json", "APPLICATION/JSON ; charset=utf-8", "text/plain", None]),
    "length_mode": st.sampled_from(["actual", "actual", "actual", "none", "zero", "big"]),
    "body": bodies,
})


@settings(max_examples=12, deadline=None)
@given(st.lists(requests, min_size=1, max_size=40))
def test_gate_matches_rule_chain(spark, reqs):
    rows = []
    for i, r in enumerate(reqs):
        mode = r["length_mode"]
        actual = len(r["body"].encode()) if r["body"] is not None else 10
        length = {"actual": actual, "none": None, "zero": 0, "big": MAX + 1 + i}[mode]
        rows.append({"request_id": f"q{i}", "received_at": dt.datetime(2024, 1, 1), "api_version": r["api_version"],
                     "producer": r["producer"], "content_type": r["content_type"], "content_length": length,
                     "body": r["body"]})
    resources = [{"name": f"route-{p}", "spec": dict({"consumerId": p, "schemaSubject": p, "schemaVersion": 1}, **spec)}
                 for p, spec in ROUTES.items()]
    table = compile_routes(R.flatten_routes(R.route_resources_df(spark, resources)), Settings(max_content_length=MAX))
    df = RQ.conform(spark.createDataFrame(rows, RQ.REQUEST_SCHEMA))
    got = {r["request_id"]: r["status"] for r in G.gate(df, table, spark).select("request_id", "status").collect()}
    for row in rows:
        assert got[row["request_id"]] == expected(row), row
