"""Provisioning (S4, S5, D13) and the pull side (S6, C1-C7) end to end on Parquet tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewater.operators import gate as G
from tidewater.operators import landing as L
from tidewater.operators import provision as PV
from tidewater.operators import pull as P
from tidewater.plans.routes import compile_routes
from tidewater.settings import EPOCH_WATERMARK, Settings
from tidewater.sources import requests as RQ
from tidewater.sources import routes as R

SCHEMA = json.dumps({"type": "record", "name": "Evt", "namespace": "t", "fields": [
    {"name": "id", "type": "string"}, {"name": "n", "type": ["null", "int"]},
    {"name": "payload", "type": {"type": "record", "name": "P", "fields": [{"name": "k", "type": "string"}]}}]})


def tgt(table, **kw):
    return dict({"catalogUri": "c", "warehouse": "w", "namespace": "pv", "tableName": table,
                 "columns": [], "initialProperties": {}}, **kw)


def test_provision_once_and_failures_isolated(spark, scratch):
    routes = [
        {"name": "a", "spec": {"consumerId": "a", "schemaSubject": "a", "schemaVersion": 1, "payloadSchema": SCHEMA,
                               "iceberg": tgt("a_tbl")}},
        {"name": "b", "spec": {"consumerId": "b", "schemaSubject": "b", "schemaVersion": 1,
                               "jsonExpressionPointer": "/payload",
                               "iceberg": tgt("b_tbl", columns=[{"name": "k", "type": "STRING", "required": True}],
                                              initialProperties={"team": "me"})}},
        {"name": "c", "spec": {"consumerId": "c", "schemaSubject": "c", "schemaVersion": 1,
                               "iceberg": tgt("c_tbl", columns=[{"name": "k", "type": "decimal"}])}},
        {"name": "d", "spec": {"consumerId": "d", "schemaSubject": "d", "schemaVersion": 1,
                               "iceberg": tgt("d_tbl")}},   # no columns, no schema → no target
    ]
    table = compile_routes(R.flatten_routes(R.route_resources_df(spark, routes)), Settings())
    log = {r["producer"]: r["outcome"] for r in PV.provision(spark, table, location_root=scratch).collect()}
    assert log == {"a": "created", "b": "created", "c": "failed"}
    assert P.table_comment(spark, "pv.a_tbl") == EPOCH_WATERMARK
    assert P.table_property(spark, "pv.b_tbl", "json-pointer-expression") == "/payload"
    assert P.table_property(spark, "pv.b_tbl", "team") == "me"
    assert [f.name for f in spark.table("pv.a_tbl").schema.fields] == [
        "push_event_id", "n", "payload", "timestampUTC", "merge_key"]
    again = {r["producer"]: r["outcome"] for r in PV.provision(spark, table, provisioned={"a"}).collect()}
    assert again == {"b": "exists", "c": "failed"}


def test_watermark_parse_and_refusal():
    assert P.parse_watermark(EPOCH_WATERMARK) == dt.datetime(1970, 1, 1)
    for bad in (None, "", "watermark: x", '{"ts": 1}'):
        with pytest.raises(P.WatermarkError):
            P.parse_watermark(bad)


def test_pull_merge_and_advance(spark, scratch):
    routes = [{"name": "a", "spec": {"consumerId": "a", "schemaSubject": "a", "schemaVersion": 1,
                                     "payloadSchema": SCHEMA, "iceberg": tgt("pull_tbl")}}]
    table = compile_routes(R.flatten_routes(R.route_resources_df(spark, routes)), Settings())
    PV.provision(spark, table, location_root=scratch)
    t0 = dt.datetime(2024, 1, 1)
    bodies = ['{"id":"e1","n":{"int":5},"payload":{"k":"x"}}', '{"id":"e2","n":null,"payload":{"k":"y"}}',
              '{"id":"e3","n":{"int":7},"payload":{"k":"z"}}']
    reqs = [{"request_id": f"r{i}", "received_at": t0 + dt.timedelta(minutes=i), "api_version": "v1",
             "producer": "a", "content_type": "application/json", "content_length": len(b), "body": b}
            for i, b in enumerate(bodies)]
    df = RQ.conform(spark.createDataFrame(reqs, RQ.REQUEST_SCHEMA))
    landing = f"{scratch}/landing"
    L.write_landing(L.envelope(G.accepted(G.gate(df, table, spark))), landing)
    route = table.by_producer()["a"]
    wm = P.read_watermark(spark, "pv.pull_tbl")
    rows = P.pull(L.read_landing(spark, landing), "a", wm, route.columns, route.pointer, "merge_key")
    got = {r["push_event_id"]: (r["n"], r["payload"] is not None) for r in rows.collect()}
    assert got == {"e1": (5, True), "e2": (None, True), "e3": (7, True)}
    merged = P.merge(spark.table("pv.pull_tbl"), rows, ["merge_key"], ["timestampUTC"])
    assert merged.count() == 3
    P.merge_into_table(spark, "pv.pull_tbl", rows, ["merge_key"], ["timestampUTC"], version=1)
    assert spark.table("pv.pull_tbl").count() == 3
    # replaying the same rows (e.g. a re-run batch) changes nothing: same deterministic merge keys
    P.merge_into_table(spark, "pv.pull_tbl", rows, ["merge_key"], ["timestampUTC"], version=2)
    assert spark.table("pv.pull_tbl").count() == 3
    assert P.table_comment(spark, "pv.pull_tbl") == EPOCH_WATERMARK
    newest = rows.agg(F.max("timestampUTC")).first()[0]
    P.advance_watermark(spark, "pv.pull_tbl", dt.datetime.strptime(newest, "%Y-%m-%dT%H:%M:%S.%fZ"))
    wm2 = P.read_watermark(spark, "pv.pull_tbl")
    assert wm2 == t0 + dt.timedelta(minutes=2)
    assert P.pull(L.read_landing(spark, landing), "a", wm2, route.columns, None, "merge_key").count() == 0


def test_explode_and_pointer_on_read(spark):
    df = spark.createDataFrame([("[{\"a\":1},{\"a\":2}]",), ("{\"a\":3}",)], "payload string")
    docs = P.explode_payload(df)
    assert sorted(r["v"] for r in docs.select(F.try_variant_get("doc", "$.a", "int").alias("v")).collect()) == [1, 2, 3]
    nested = spark.createDataFrame([('{"env":{"body":{"x":1}}}',)], "payload string")
    got = P.apply_pointer(P.explode_payload(nested), "/env/body")
    assert got.select(F.to_json("doc")).first()[0] == '{"x":1}'


def test_ensure_landing_table(spark, scratch):
    assert L.ensure_landing_table(spark, "default.landing_s4", f"{scratch}/l", auto_create=True)
    assert not L.ensure_landing_table(spark, "default.landing_s4", f"{scratch}/l", auto_create=False)
    with pytest.raises(RuntimeError):
        L.ensure_landing_table(spark, "default.landing_missing", f"{scratch}/m", auto_create=False)
    assert "producer" in spark.table("default.landing_s4").columns


def test_consumer_run_end_to_end(spark, scratch):
    """Provision a pointer route's table, land pushes, pull twice: the second run only sees new rows."""
    schema = json.dumps({"type": "record", "name": "Env", "namespace": "t", "fields": [
        {"name": "id", "type": "string"},
        {"name": "body", "type": {"type": "record", "name": "B", "fields": [
            {"name": "k", "type": "int"}, {"name": "tags", "type": {"type": "array", "items": "string"}}]}}]})
    routes = [{"name": "e", "spec": {"consumerId": "e", "schemaSubject": "e", "schemaVersion": 1,
                                     "payloadSchema": schema, "jsonExpressionPointer": "/body",
                                     "iceberg": tgt("consumer_tbl")}}]
    table = compile_routes(R.flatten_routes(R.route_resources_df(spark, routes)), Settings())
    PV.provision(spark, table, location_root=scratch)
    route = table.by_producer()["e"]
    assert [c.name for c in route.columns] == ["k", "tags", "timestampUTC", "merge_key"]
    t0 = dt.datetime(2024, 1, 1)

    def push(i):
        b = json.dumps({"id": f"x{i}", "body": {"k": i, "tags": ["a"] * i}})
        return {"request_id": f"r{i}", "received_at": t0 + dt.timedelta(minutes=i), "api_version": "v1",
                "producer": "e", "content_type": "application/json", "content_length": len(b), "body": b}

    landing = f"{scratch}/landing"
    for batch in ([push(i) for i in range(3)], [push(i) for i in range(3, 5)]):
        df = RQ.conform(spark.createDataFrame(batch, RQ.REQUEST_SCHEMA))
        L.write_landing(L.envelope(G.accepted(G.gate(df, table, spark))), landing)
        out = P.pull_into_table(spark, L.read_landing(spark, landing), "pv.consumer_tbl", "e", route.columns,
                                "merge_key", version=len(batch))
        assert out["pulled"] == len(batch)
    got = sorted((r["k"], r["n"]) for r in spark.table("pv.consumer_tbl").select(
        "k", F.array_size(F.col("tags").try_cast("array<variant>")).alias("n")).collect())
    assert got == [(i, i) for i in range(5)]
    assert P.read_watermark(spark, "pv.consumer_tbl") == t0 + dt.timedelta(minutes=4)
    again = P.pull_into_table(spark, L.read_landing(spark, landing), "pv.consumer_tbl", "e", route.columns,
                              "merge_key", version=9)
    assert again["pulled"] == 0


def test_consumer_absorbs_replays(spark, scratch):
    routes = [{"name": "z", "spec": {"consumerId": "z", "schemaSubject": "z", "schemaVersion": 1,
                                     "payloadSchema": SCHEMA, "iceberg": tgt("replay_tbl")}}]
    table = compile_routes(R.flatten_routes(R.route_resources_df(spark, routes)), Settings())
    PV.provision(spark, table, location_root=scratch)
    route = table.by_producer()["z"]
    t0 = dt.datetime(2024, 1, 1)
    bodies = [json.dumps({"id": f"e{i}", "n": None, "payload": {"k": str(i)}}) for i in range(4)]
    reqs = [{"request_id": f"r{i}", "received_at": t0 + dt.timedelta(minutes=i), "api_version": "v1",
             "producer": "z", "content_type": "application/json", "content_length": len(b), "body": b}
            for i, b in enumerate(bodies)]
    df = RQ.conform(spark.createDataFrame(reqs, RQ.REQUEST_SCHEMA))
    landing = f"{scratch}/landing"
    for _ in range(2):                                   # the same batch landed twice (replayed)
        L.write_landing(L.envelope(G.accepted(G.gate(df, table, spark))), landing)
    landed = L.read_landing(spark, landing)
    assert landed.count() == 8
    out = P.pull_into_table(spark, landed, "pv.replay_tbl", "z", route.columns, "merge_key", version=1)
    assert out["pulled"] == 8 and out["inserted"] == 4 and spark.table("pv.replay_tbl").count() == 4
    # a crash before the watermark moved: the same rows are pulled and offered again
    rows = P.pull(landed, "z", dt.datetime(1970, 1, 1), route.columns, None, "merge_key")
    P.append_missing(spark, "pv.replay_tbl", rows, ["merge_key"], "timestampUTC")
    assert spark.table("pv.replay_tbl").count() == 4
    assert sorted(r[0] for r in spark.table("pv.replay_tbl").select("push_event_id").collect()) == \
        ["e0", "e1", "e2", "e3"]


def test_merge_into_table_versions(spark, scratch):
    spark.sql(f"CREATE TABLE default.mv (k STRING, v INT, t STRING) USING parquet LOCATION '{scratch}/mv'")
    rows = spark.createDataFrame([("a", 1, "1"), ("b", 2, "1")], "k string, v int, t string")
    first = P.merge_into_table(spark, "default.mv", rows, ["k"], ["t"])
    assert first.endswith("/mv/_v1")
    newer = spark.createDataFrame([("a", 9, "2")], "k string, v int, t string")
    second = P.merge_into_table(spark, "default.mv", newer, ["k"], ["t"])
    assert second.endswith("/mv/_v2")
    assert sorted(tuple(r) for r in spark.table("default.mv").collect()) == [("a", 9, "2"), ("b", 2, "1")]
    with pytest.raises(ValueError):
        P.merge_into_table(spark, "default.mv", newer, ["k"], ["t"], version=2)


def test_hand_written_date_and_timestamp_columns(spark, scratch):
    cols = [{"name": "day", "type": "DATE"}, {"name": "at", "type": "Timestamp"}, {"name": "n", "type": "long"}]
    routes = [{"name": "h", "spec": {"consumerId": "h", "schemaSubject": "h", "schemaVersion": 1,
                                     "iceberg": tgt("typed_tbl", columns=cols)}}]
    table = compile_routes(R.flatten_routes(R.route_resources_df(spark, routes)), Settings())
    PV.provision(spark, table, location_root=scratch)
    types = {f.name: f.dataType.simpleString() for f in spark.table("pv.typed_tbl").schema.fields}
    assert types == {"day": "date", "at": "timestamp", "n": "bigint", "timestampUTC": "string", "merge_key": "string"}
    body = '{"day":"2024-02-29","at":"2024-02-29T10:11:12Z","n":5}'
    req = {"request_id": "r1", "received_at": dt.datetime(2024, 3, 1), "api_version": "v1", "producer": "h",
           "content_type": "application/json", "content_length": len(body), "body": body}
    df = RQ.conform(spark.createDataFrame([req], RQ.REQUEST_SCHEMA))
    landed = L.envelope(G.accepted(G.gate(df, table, spark)))
    route = table.by_producer()["h"]
    row = P.pull(landed, "h", dt.datetime(1970, 1, 1), route.columns, None, "merge_key").first()
    assert row["day"] == dt.date(2024, 2, 29) and row["n"] == 5
    assert row["at"] == dt.datetime(2024, 2, 29, 10, 11, 12)


def test_durable_provision_log_retries_failures(spark, scratch):
    log = f"{scratch}/provision_log"
    bad = [{"name": "x", "spec": {"consumerId": "x", "schemaSubject": "x", "schemaVersion": 1,
                                  "iceberg": tgt("retry_tbl", columns=[{"name": "k", "type": "decimal"}])}},
           {"name": "y", "spec": {"consumerId": "y", "schemaSubject": "y", "schemaVersion": 1,
                                  "iceberg": tgt("ok_tbl", columns=[{"name": "k", "type": "int"}])}}]
    first = PV.provision(spark, compile_routes(R.flatten_routes(R.route_resources_df(spark, bad)), Settings()),
                         location_root=scratch, log_path=log)
    assert {r["producer"]: r["outcome"] for r in first.collect()} == {"x": "failed", "y": "created"}
    fixed = [dict(bad[0], spec=dict(bad[0]["spec"], iceberg=tgt("retry_tbl", columns=[{"name": "k", "type": "long"}]))),
             bad[1]]
    second = PV.provision(spark, compile_routes(R.flatten_routes(R.route_resources_df(spark, fixed)), Settings()),
                          location_root=scratch, log_path=log)
    assert {r["producer"]: r["outcome"] for r in second.collect()} == {"x": "created"}   # y is skipped
    assert PV.provisioned_producers(spark, log) == {"x", "y"}


def _land(spark, table, landing, requests):
    df = RQ.conform(spark.createDataFrame(requests, RQ.REQUEST_SCHEMA))
    L.write_landing(L.envelope(G.accepted(G.gate(df, table, spark))), landing)


def _push(producer, i, body, at):
    return {"request_id": f"{producer}-{i}", "received_at": at, "api_version": "v1", "producer": producer,
            "content_type": "application/json", "content_length": len(body.encode()), "body": body}


def _consumer(spark, scratch, name, schema=None, columns=None, **spec):
    routes = [{"name": name, "spec": dict({"consumerId": name, "schemaSubject": name, "schemaVersion": 1, "payloadSchema": schema,
                                           "iceberg": tgt(f"{name}_tbl", columns=columns or [])}, **spec)}]
    table = compile_routes(R.flatten_routes(R.route_resources_df(spark, routes)), Settings())
    PV.provision(spark, table, location_root=scratch)
    route = table.by_producer()[name]
    landing = f"{scratch}/landing"
    pull = lambda v=1: P.pull_into_table(spark, L.read_landing(spark, landing), f"pv.{name}_tbl", name, route.columns, "merge_key", v)
    return table, landing, pull


def test_every_element_of_an_array_body_is_kept(spark, scratch):
    table, landing, pull = _consumer(spark, scratch, "arr", columns=[{"name": "x", "type": "int"}])
    t0 = dt.datetime(2024, 1, 1)
    _land(spark, table, landing, [_push("arr", 0, '[{"x":1},{"x":2},{"x":3}]', t0), _push("arr", 1, '{"x":9}', t0)])
    assert pull()["inserted"] == 4
    rows = spark.table("pv.arr_tbl").collect()
    assert sorted(r["x"] for r in rows) == [1, 2, 3, 9] and len({r["merge_key"] for r in rows}) == 4
    assert pull()["inserted"] == 0 and spark.table("pv.arr_tbl").count() == 4


@pytest.mark.parametrize("stamp", ["2024-01-01T00:00:00Z", "2099-12-31T00:00:00Z", "no time at all"])
def test_documents_move_neither_key_nor_watermark(spark, scratch, stamp):
    name = f"own{abs(hash(stamp)) % 10 ** 6}"
    schema = json.dumps({"type": "record", "name": "W", "fields": [
        {"name": "x", "type": "int"}, {"name": "timestampUTC", "type": "string"}, {"name": "Merge_Key", "type": "string"}]})
    table, landing, pull = _consumer(spark, scratch, name, schema)
    t0 = dt.datetime(2024, 5, 1)
    for i in range(2):
        body = json.dumps({"x": i, "timestampUTC": stamp, "Merge_Key": "one"})
        _land(spark, table, landing, [_push(name, i, body, t0 + dt.timedelta(minutes=i))])
        out = pull()
        assert out["pulled"] == 1 and out["watermark"] == t0 + dt.timedelta(minutes=i)
    rows = sorted((r["x"], r["timestampUTC"]) for r in spark.table(f"pv.{name}_tbl").collect())
    assert rows == [(0, "2024-05-01T00:00:00.000000Z"), (1, "2024-05-01T00:01:00.000000Z")]
    assert P.read_watermark(spark, f"pv.{name}_tbl") == t0 + dt.timedelta(minutes=1)


def test_hand_declared_envelope_column(spark, scratch):
    table, landing, pull = _consumer(spark, scratch, "hand", columns=[{"name": "timestampUTC", "type": "string"}, {"name": "x", "type": "int"}])
    _land(spark, table, landing, [_push("hand", 0, '{"x":5}', dt.datetime(2024, 1, 2))])
    assert pull()["inserted"] == 1
    assert [(r["timestampUTC"], r["x"]) for r in spark.table("pv.hand_tbl").collect()] == [("2024-01-02T00:00:00.000000Z", 5)]


def test_rows_that_land_late_are_pulled(spark, scratch):
    table, landing, pull = _consumer(spark, scratch, "late", columns=[{"name": "x", "type": "int"}])
    t0 = dt.datetime(2024, 1, 1)
    _land(spark, table, landing, [_push("late", 0, '{"x":0}', t0)])
    assert pull()["inserted"] == 1
    _land(spark, table, landing, [_push("late", 1, '{"x":1}', t0 - dt.timedelta(seconds=10))])
    out = pull()
    assert (out["pulled"], out["inserted"], out["watermark"]) == (0, 1, t0)
    assert sorted(r["x"] for r in spark.table("pv.late_tbl").collect()) == [0, 1]


def test_watermark_bound_ignores_the_process_time_zone(spark, monkeypatch):
    import time
    wm = P.parse_watermark('{"timestamp":"2024-01-15T00:00:00Z"}')
    rows = spark.sql("SELECT 'a' AS producer, timestamp_micros(1705276800000000 + id * 3600000000) AS ts FROM range(-8, 8)")
    counts = []
    for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
        monkeypatch.setenv("TZ", zone)
        time.tzset()
        counts.append(L.incremental_pull(rows, "a", wm).count())
        counts.append(L.incremental_pull(rows, "a", wm.replace(tzinfo=dt.timezone.utc)).count())
    monkeypatch.undo()
    time.tzset()
    assert counts == [7] * 6


def test_bytes_are_read_as_avro_writes_them(spark):
    schema = json.dumps({"type": "record", "name": "B", "fields": [{"name": "b", "type": "bytes"}]})
    from tidewater.plans import layout
    cols = layout.derive_columns(schema)
    df = P.explode_payload(spark.createDataFrame([("i", r'{"b":"\u00ff\u0000A"}')], "id string, payload string"))
    assert bytes(P.decode(df, cols, "merge_key").first()["b"]) == b"\xff\x00A"


def test_many_producers_in_one_pass(spark, scratch):
    schema = json.dumps({"type": "record", "name": "M", "fields": [{"name": "x", "type": "int"}]})
    routes = [{"name": f"m{k}", "spec": {"consumerId": f"m{k}", "schemaSubject": "m", "schemaVersion": 1, "payloadSchema": schema,
                                         "iceberg": tgt(f"m{k}")}} for k in range(5)]
    table = compile_routes(R.flatten_routes(R.route_resources_df(spark, routes)), Settings())
    t0 = dt.datetime(2024, 1, 1)
    _land(spark, table, f"{scratch}/landing", [_push(f"m{i % 5}", i, json.dumps({"x": i}), t0) for i in range(20)])
    landed = L.read_landing(spark, f"{scratch}/landing")
    wm = dt.datetime(1970, 1, 1)
    out = P.pull_many(landed, table.routes[:4], wm, "merge_key")
    one_by_one = sorted(r["x"] for t in table.routes[:4] for r in P.pull(landed, t.producer, wm, t.columns, t.pointer, "merge_key").collect())
    assert sorted(r["x"] for r in out.collect()) == one_by_one
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_merge_rewrites_touched_buckets_alone(spark, scratch, monkeypatch):
    name = "default.bucketed"
    P.create_bucketed_target(spark, name, "k INT, v STRING, t STRING", f"{scratch}/bucketed", 64)
    rows = lambda ks, v, t: spark.createDataFrame([(k, v, t) for k in ks], "k int, v string, t string")
    P.merge_into_table(spark, name, rows(range(1000), "old", "1"), ["k"], ["t"])
    files = lambda: {r[0]: r[1] for r in spark.table(name).select("_bucket", F.input_file_name()).distinct().collect()}
    before = files()
    assert len(before) == 64 and spark.table(name).count() == 1000
    touched = P.merge_buckets(spark, name, rows([5, 5000], "new", "2").unionByName(rows([7], "older", "0")), ["k"], ["t"])
    after = files()
    assert len(touched) <= 3 and {b for b in after if after[b] != before.get(b)} <= set(touched)
    got = {r["k"]: r["v"] for r in spark.table(name).collect()}
    assert len(got) == 1001 and got[5] == got[5000] == "new" and got[7] == "old"

    def dead(*a, **k):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:                              # after the new files are written, before any bucket points there
        sql = type(spark).sql
        m.setattr(type(spark), "sql", lambda self, text, *a, **k: dead() if text.startswith("ALTER") else sql(self, text, *a, **k))
        with pytest.raises(RuntimeError):
            P.merge_buckets(spark, name, rows(range(10), "lost", "3"), ["k"], ["t"])
    assert {r["k"]: r["v"] for r in spark.table(name).collect()} == got
    P.merge_buckets(spark, name, rows(range(10), "won", "3"), ["k"], ["t"])
    assert {r["v"] for r in spark.table(name).where("k < 10").collect()} == {"won"} and spark.table(name).count() == 1001
    assert P.merge_buckets(spark, name, rows([], "x", "9"), ["k"], ["t"]) == []


def test_a_row_two_hours_behind_is_pulled_once_through_the_manifest(spark, scratch):
    table, landing, _ = _consumer(spark, scratch, "behind", columns=[{"name": "x", "type": "int"}])
    route = table.by_producer()["behind"]
    pull = lambda: P.pull_into_table(spark, landing, "pv.behind_tbl", "behind", route.columns, "merge_key", 1)
    t0 = dt.datetime(2024, 1, 1, 12)
    assert pull()["read"] == 0
    _land(spark, table, landing, [_push("behind", 0, '{"x":0}', t0)])
    assert pull()["inserted"] == 1
    _land(spark, table, landing, [_push("behind", 1, '{"x":1}', t0 - dt.timedelta(hours=2))])
    out = pull()
    assert (out["read"], out["pulled"], out["inserted"], out["watermark"]) == (1, 0, 1, t0)
    assert pull()["read"] == 0
    assert sorted(r["x"] for r in spark.table("pv.behind_tbl").collect()) == [0, 1]


def test_hand_written_id_column_reads_the_renamed_member(spark, scratch):
    table, landing, pull = _consumer(spark, scratch, "handid", columns=[{"name": "id", "type": "string"}, {"name": "x", "type": "int"}])
    bodies = ['{"id":"e1","x":1}', '{"x":2}', '{"id":"own","push_event_id":"other","x":3}']
    _land(spark, table, landing, [_push("handid", i, b, dt.datetime(2024, 1, 1)) for i, b in enumerate(bodies)])
    assert pull()["inserted"] == 3
    assert {(r["x"], r["id"]) for r in spark.table("pv.handid_tbl").collect()} == {(1, "e1"), (2, None), (3, "own")}


def test_arrays_are_merged_by_as_many_tasks_as_their_lines_call_for(spark, scratch, monkeypatch):
    """What a task sorts is bounded by the lines, not by the session's shuffle partitions; every line stays."""
    from tidewater import scenarios as S
    spark.range(300).select(F.col("id").alias("o_orderkey"), F.timestamp_seconds(F.col("id") * 86_400).cast("timestamp_ntz").alias("o_orderdate"),
                            F.concat((F.col("id") % 5 + 1).cast("string"), F.lit("-X")).alias("o_orderpriority")).write.parquet(f"{scratch}/orders.parquet")
    spark.range(1200).select((F.col("id") % 300).alias("l_orderkey"), (F.col("id") / 300).cast("int").alias("l_linenumber"),
                             (F.col("id") * 7).alias("l_partkey"), F.lit("A").alias("l_returnflag")).write.parquet(f"{scratch}/lineitem.parquet")
    monkeypatch.setattr(S, "LINES_A_TASK", 50)
    merged = S.array_merge(spark, scratch)
    per = merged.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(per) > 16 and max(r["count"] for r in per) < 200
    got = merged.select("l_orderkey", "l_linenumber", "l_partkey").collect()
    assert sorted(tuple(r) for r in got) == sorted((i % 300, i // 300, i * 7) for i in range(1200))
    assert S.payload_explode(spark, scratch).count() == 1200
