"""Request gate (F1-F8, E1, J1-J3, P4-P10) — FIXTURES §2 with a 4096-byte limit."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tidewater.operators import gate as G
from tidewater.operators import landing as L
from tidewater.operators import metrics as M
from tidewater.plans import avro
from tidewater.plans.routes import compile_routes
from tidewater.settings import Settings
from tidewater.sources import requests as RQ
from tidewater.sources import routes as R

SETTINGS = Settings(max_content_length=4096)
TIDE = json.dumps({"type": "record", "name": "Tide", "namespace": "harbour",
                   "fields": [{"name": "id", "type": "long"}, {"name": "level", "type": "int"}]})
TIDE_AT = json.dumps({"type": "record", "name": "TideAt", "namespace": "harbour", "fields": [
    {"name": "station", "type": "string"},
    {"name": "reading", "type": {"type": "record", "name": "Reading", "fields": [{"name": "level", "type": "int"}]}}]})
TARGET = {"catalogUri": "c", "warehouse": "w", "namespace": "ns", "tableName": "t", "columns": [],
          "initialProperties": {}}


def route(name, producer, **spec):
    return {"name": name, "spec": dict({"consumerId": producer, "schemaSubject": f"{producer}-s",
                                        "schemaVersion": 1}, **spec)}


def table(spark, routes, settings=SETTINGS):
    return compile_routes(R.flatten_routes(R.route_resources_df(spark, routes)), settings)


def req(i, producer, body="x", ctype="application/json", length="auto", version="v1"):
    if length == "auto":
        length = None if body is None else len(body.encode())
    return {"request_id": f"r{i}", "received_at": dt.datetime(2024, 1, 1, 0, 0, i), "api_version": version,
            "producer": producer, "content_type": ctype, "content_length": length, "body": body,
            "method": "POST", "path": f"/api/{version}/{producer}/data"}


def run(spark, routes, reqs, settings=SETTINGS):
    df = RQ.conform(spark.createDataFrame(reqs, RQ.REQUEST_SCHEMA))
    out = G.gate(df, table(spark, routes, settings), spark)
    return {r["request_id"]: r for r in out.collect()}


def test_header_gates(spark):
    routes = [route("a", "a")]
    got = run(spark, routes, [
        req(1, "a"), req(2, "unknown"), req(3, "a", length=4097), req(4, "a", length=None),
        req(5, "a", ctype="text/plain"), req(6, "a", ctype="application/json; charset=utf-8"),
        req(7, "a", ctype=None), req(8, "a", body=""), req(9, "a", length=0), req(10, "a", body=None, length=3),
        req(11, "a", version="v2"), req(12, "a", length=4096, body="x")])
    assert (got["r1"]["status"], got["r1"]["message"]) == (202, "accepted for a: 1 bytes")
    assert got["r2"]["status"] == 404 and got["r11"]["status"] == 404
    assert (got["r3"]["status"], got["r3"]["message"]) == (413, "Payload too large: 4097 bytes (max 4096)")
    assert (got["r4"]["status"], got["r4"]["message"]) == (411, "Content-Length header is required")
    assert (got["r5"]["status"], got["r5"]["message"]) == (415, "Only application/json is accepted")
    assert got["r6"]["status"] == 202 and got["r7"]["status"] == 415
    assert (got["r8"]["status"], got["r8"]["message"]) == (400, "Request body is required")
    assert got["r9"]["status"] == 400 and got["r9"]["error_code"] == "no_content"
    assert got["r10"]["status"] == 400 and got["r10"]["error_code"] == "serialization"
    assert got["r12"]["status"] == 202


def test_schema_routes_land_bytes_unchanged(spark):
    body = '{"level" : -3,   "id":88}'
    routes = [route("s", "s", payloadSchema=TIDE), route("b", "b")]
    got = run(spark, routes, [req(1, "s", body), req(2, "b", body), req(3, "s", '{"id":88,"level":"high"}')])
    assert got["r1"]["status"] == 202 and got["r1"]["payload"] == body and got["r2"]["payload"] == body
    assert got["r1"]["schema_fingerprint"] == avro.fingerprint(avro.parse_schema(TIDE)) and got["r2"]["schema_fingerprint"] is None
    assert got["r3"]["status"] == 400 and got["r3"]["message"].startswith("Schema validation failed: ")


def test_pointer_routes(spark):
    nested = '{"station":"north","reading":{"level":5}}'
    got = run(spark, [route("p", "p", payloadSchema=TIDE_AT, jsonExpressionPointer="/reading"),
                      route("q", "q", jsonExpressionPointer="/reading")],
              [req(1, "p", nested), req(2, "q", '{"station":"north"}'), req(3, "q", "<xml/>"),
               req(4, "q", '{"reading":null}')])
    assert got["r1"]["status"] == 202 and got["r1"]["payload"] == nested
    assert (got["r2"]["status"], got["r2"]["message"]) == (
        400, "application error: invalid json path for payload: '/reading'")
    assert got["r3"]["status"] == 400
    assert got["r4"]["status"] == 202      # JSON null is a value


def test_rename_only_with_target_and_no_pointer(spark):
    body = '{"level":5,"id":88}'
    target = dict(TARGET, columns=[{"name": "level", "type": "int"}])
    got = run(spark, [route("t", "t", iceberg=target), route("n", "n"), route("tp", "tp", jsonExpressionPointer="/level", iceberg=target)],
              [req(1, "t", body), req(2, "n", body), req(3, "tp", body)])
    assert got["r1"]["payload"] == '{"level":5,"push_event_id":88}'
    assert got["r1"]["message"] == "accepted for t: 30 bytes"
    assert got["r2"]["payload"] == body and got["r3"]["payload"] == body


def test_bad_schema_and_bad_pointer_routes(spark):
    routes = [route("bad", "bad", payloadSchema='{"type":"record"'),
              route("ptr", "ptr", jsonExpressionPointer="payload")]
    tbl = table(spark, routes)
    assert {r.producer: r.compile_status for r in tbl.routes} == {"bad": "schema_invalid", "ptr": "pointer_invalid"}
    assert tbl.errors_df(spark).count() == 2
    got = run(spark, routes, [req(1, "bad", "anything"), req(2, "ptr", '{"payload":1}')])
    assert got["r1"]["status"] == 202 and got["r1"]["schema_fingerprint"] is None
    assert got["r2"]["status"] == 500 and got["r2"]["error_code"] == "invalid_route"


def test_duplicate_producers_first_route_wins(spark):
    tbl = table(spark, [route("b-route", "p", schemaSubject="second"), route("a-route", "p", schemaSubject="first")])
    assert [r.schema_subject for r in tbl.routes] == ["first"] and len(tbl.duplicates) == 1


def test_route_swap_applies_to_later_requests(spark):
    reqs = [req(1, "a"), req(2, "b")]
    before = run(spark, [route("a", "a")], reqs)
    after = run(spark, [route("b", "b")], reqs)
    assert (before["r1"]["status"], before["r2"]["status"]) == (202, 404)
    assert (after["r1"]["status"], after["r2"]["status"]) == (404, 202)


def test_watched_routes_compile_only_on_change(spark):
    from tidewater.plans.routes import watched_routes
    current = [route("a", "a", payloadSchema=TIDE)]
    routes = watched_routes(lambda: R.flatten_routes(R.route_resources_df(spark, current)), SETTINGS)
    first = routes()
    assert routes() is first and [r.producer for r in first.routes] == ["a"]
    current.append(route("b", "b"))
    second = routes()
    assert second is not first and [r.producer for r in second.routes] == ["a", "b"] and routes() is second


def test_recursive_schema_uses_fallback(spark):
    node = '{"type":"record","name":"Node","fields":[{"name":"v","type":"int"},{"name":"next","type":["null","Node"]}]}'
    got = run(spark, [route("r", "r", payloadSchema=node)],
              [req(1, "r", '{"v":1,"next":{"Node":{"v":2,"next":null}}}'), req(2, "r", '{"v":1,"next":{"Node":{}}}')])
    assert got["r1"]["status"] == 202 and got["r2"]["status"] == 400


def test_envelope_metrics_and_access_log(spark):
    reqs = [req(1, "a", '{"k":1}'), req(2, "a", ""), req(3, "zzz")]
    reqs[0].update(x_forwarded_for=" 10.0.0.1 , 10.0.0.2", x_correlation_id="c-1")
    reqs[1].update(x_real_ip="192.168.0.9")
    df = RQ.conform(spark.createDataFrame(reqs, RQ.REQUEST_SCHEMA))
    gated = G.gate(df, table(spark, [route("a", "a")]), spark)
    env = L.envelope(G.accepted(gated)).first()
    assert env["timestampUTC"] == "2024-01-01T00:00:01.000000Z" and env["createdAt"] == 1704067201000
    assert env["schemaSubject"] == "a-s" and env["schemaVersion"] == 1 and len(env["id"]) == 36
    totals = {(r["producer"], r["outcome"]): r["requests"] for r in M.requests_total(gated).collect()}
    assert totals == {("a", "ok"): 1, ("a", "error"): 1}
    assert M.bytes_total(gated, {"service": "ingest"}).first().asDict() == {"producer": "a", "bytes": 7,
                                                                             "service": "ingest"}
    log = {r["request_id"]: r for r in M.access_log(gated).collect()}
    assert log["r1"]["client_ip"] == "10.0.0.1" and log["r1"]["correlation_id"] == "c-1"
    assert log["r2"]["client_ip"] == "192.168.0.9" and log["r3"]["client_ip"] == "unknown"
    assert G.rejected(gated).count() == 2
    assert [r["request_id"] for r in G.unrouted(df, table(spark, [route("a", "a")]), spark).collect()] == ["r3"]


def test_gate_plan_is_one_narrow_stage(spark):
    df = RQ.conform(spark.createDataFrame([req(1, "a")], RQ.REQUEST_SCHEMA))
    plan = G.gate(df, table(spark, [route("a", "a", payloadSchema=TIDE)]), spark)._jdf.queryExecution() \
        .executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_route_resources_from_json_and_collisions(spark, scratch):
    from tidewater.operators.metrics import name_collisions
    path = f"{scratch}/routes.json"
    docs = [route("r1", "p1", iceberg=dict(TARGET, columns=[{"name": "source", "type": "string"},
                                                             {"name": "Source", "type": "string"}])),
            route("r2", "p2", iceberg=dict(TARGET, columns=[{"name": "a", "type": "int"}]),
                  jsonExpressionPointer=" "),
            {"name": "r3", "spec": {"consumerId": "p3"}},          # incomplete: ignored, and reported
            {"metadata": {"name": "r4", "labels": {}}, "spec": dict(route("r4", "p4")["spec"])}]
    with open(path, "w") as f:
        f.write("\n".join(json.dumps(d) for d in docs))
    resources = R.read_route_resources(spark, path)
    flat = R.flatten_routes(resources)
    rows = {r["route_name"]: r for r in flat.collect()}
    assert set(rows) == {"r1", "r2", "r4"} and rows["r2"]["pointer"] is None
    assert [(r["route_name"], r["message"]) for r in R.incomplete_resources(resources).collect()] == [
        ("r3", "incomplete route resource, without spec.schemaSubject, spec.schemaVersion")]
    got = name_collisions(R.route_columns(flat)).collect()
    assert [(r["route_name"], r["lower_name"], r["names"]) for r in got] == [("r1", "source", ["Source", "source"])]
    # hand-written columns are not checked at compile (only schema-derived ones are); A8 reports them
    tbl = compile_routes(flat, SETTINGS)
    assert [c.name for c in tbl.by_producer()["p1"].columns][:2] == ["source", "Source"]


def test_route_join_falls_back_to_shuffle_above_limit(spark):
    reqs = [req(i, p) for i, p in enumerate(["a", "b", "c", "a"])]
    routes = [route("a", "a"), route("b", "b")]
    small = run(spark, routes, reqs)
    big = run(spark, routes, reqs, Settings(max_content_length=4096, route_broadcast_limit=0))
    assert {k: r["status"] for k, r in small.items()} == {k: r["status"] for k, r in big.items()}
    df = RQ.conform(spark.createDataFrame(reqs, RQ.REQUEST_SCHEMA))
    tbl = table(spark, routes, Settings(route_broadcast_limit=0))
    plan = G.gate(df, tbl, spark)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan


def test_pointers_ride_on_the_route_rows(spark):
    pointers = ["/reading", "/reading/level", "/marks/1", "/p~1q", "/gone", "/marks/01"]
    routes = [route(f"r{i}", f"p{i}", jsonExpressionPointer=p) for i, p in enumerate(pointers)]
    body = '{"reading":{"level":1},"marks":["x","y"],"p/q":null}'
    got = run(spark, routes, [req(i, f"p{i}", body) for i in range(len(pointers))])
    assert {k: r["status"] for k, r in got.items()} == {"r0": 202, "r1": 202, "r2": 202, "r3": 202, "r4": 400, "r5": 202}


def test_many_schemas_do_not_grow_the_expression(spark):
    def size(n):
        routes = [route(f"r{i}", f"p{i}", jsonExpressionPointer=f"/f{i}", payloadSchema=json.dumps(
            {"type": "record", "name": f"T{i}", "fields": [{"name": f"f{i}", "type": "int"}]})) for i in range(n)]
        tbl = table(spark, routes)
        return len(str(G.schema_ok(tbl, F.col("v"), F.col("body")))) + len(str(G.pointer_ok(tbl, F.col("v"))))
    assert abs(size(40) - size(2)) < 200


def test_one_bad_route_touches_no_other(spark):
    node = '{"type":"record","name":"Node","fields":[{"name":"next","type":["null","Node"]}]}'
    routes = [route("bad", "bad", payloadSchema=node, jsonExpressionPointer="next"), route("good", "good", payloadSchema=node),
              route("fine", "fine")]
    got = run(spark, routes, [req(1, "bad", '{"next":null}'), req(2, "good", '{"next":null}'), req(3, "good", "{}"), req(4, "fine", "x")])
    assert [(got[k]["status"], got[k]["error_code"]) for k in ("r1", "r2", "r3", "r4")] == [
        (500, "invalid_route"), (202, None), (400, "schema_validation"), (202, None)]


def test_route_table_sorted_by_producer(spark):
    tbl = table(spark, [route("z", "b"), route("y", "c"), route("x", "a")])
    assert [r.producer for r in tbl.routes] == ["a", "b", "c"]


def test_no_routes_everything_unrouted(spark):
    got = run(spark, [], [req(1, "a"), req(2, "b", body=None, length=None)])
    assert {k: (r["status"], r["error_code"]) for k, r in got.items()} == {
        "r1": (404, "unrouted"), "r2": (404, "unrouted")}


def test_pointer_without_path_syntax_in_path_list_mode(spark):
    routes = [route(f"r{i}", f"p{i}", jsonExpressionPointer=p) for i, p in enumerate(["/a'b\"c", "/ok", "/a'b\"c/z"])]
    body = json.dumps({"a'b\"c": 1, "ok": 2})
    reqs = [req(i, f"p{i}", body) for i in range(3)]
    got = run(spark, routes, reqs)
    assert {k: r["status"] for k, r in got.items()} == {"r0": 202, "r1": 202, "r2": 400}


def test_route_broadcast_checks_bytes_too(spark):
    routes = [route("a", "a", payloadSchema=TIDE)]
    assert table(spark, routes).broadcastable()
    small = table(spark, routes, Settings(route_broadcast_bytes=10))
    assert not small.broadcastable()
    plan = G.gate(RQ.conform(spark.createDataFrame([req(1, "a")], RQ.REQUEST_SCHEMA)), small, spark) \
        ._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan


def test_body_length_is_checked_where_asked(spark):
    from dataclasses import replace
    long = '{"k":"' + "é" * 50 + '"}'
    reqs = [dict(req(1, "a", long), content_length=10), req(2, "a", '{"k":1}')]
    for check, want in ((False, 202), (True, 413)):
        settings = replace(SETTINGS, max_content_length=60, check_body_length=check)
        tbl = compile_routes(R.flatten_routes(R.route_resources_df(spark, [route("a", "a")])), settings)
        got = {r["request_id"]: r["status"] for r in G.gate(RQ.conform(spark.createDataFrame(reqs, RQ.REQUEST_SCHEMA)), tbl, spark).collect()}
        assert got == {"r1": want, "r2": 202}
