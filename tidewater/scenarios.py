"""Registered scenarios: each reads the shared test tables and runs engine operators.

Each scenario is ``fn(spark, sf_dir) -> DataFrame``; ``tidewater.oracle`` holds the
matching SQL that an independent engine runs on the same tables.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import gate as G
from tidewater.operators import landing as L
from tidewater.operators import manifest as MF
from tidewater.operators import metrics as M
from tidewater.operators import provision as PV
from tidewater.operators import pull as P
from tidewater.operators import route_log as RL
from tidewater.plans import layout as LY
from tidewater.plans.routes import RouteTable, compile_routes
from tidewater.session import checkpoint_dir, ensure_utc, materialised
from tidewater.settings import Settings
from tidewater.sources import requests as RQ
from tidewater.sources import routes as R
from tidewater.sources import testdata as TD
from tidewater.streaming import landing_stream as LS
from tidewater.streaming import window_metrics as WM

# The demo route configuration served to the event-derived pushes.
EVENT_SCHEMA = json.dumps({
    "type": "record", "name": "Event", "namespace": "demo.events",
    "fields": [
        {"name": "id", "type": "string"},
        {"name": "seq", "type": "long"},
        {"name": "payload", "type": {"type": "record", "name": "Props",
                                     "fields": [{"name": "k", "type": "int"}]}},
    ],
})
BROKEN_SCHEMA = '{"type":"record","name":"Broken","fields":[{"name":"id"}]}'
TARGET = {"catalogUri": "local", "warehouse": "local", "namespace": "landing", "tableName": None,
          "columns": [], "initialProperties": {}}

EVENT_ROUTES = [
    {"name": "route-click", "spec": {"consumerId": "click", "schemaSubject": "click-raw", "schemaVersion": 1}},
    {"name": "route-view", "spec": {"consumerId": "view", "schemaSubject": "view-event", "schemaVersion": 2,
                                    "payloadSchema": EVENT_SCHEMA}},
    {"name": "route-purchase", "spec": {"consumerId": "purchase", "schemaSubject": "purchase-raw",
                                        "schemaVersion": 1, "jsonExpressionPointer": "/payload/k",
                                        "iceberg": dict(TARGET, tableName="purchase",
                                                        columns=[{"name": "k", "type": "int",
                                                                  "required": True}])}},
    {"name": "route-signup", "spec": {"consumerId": "signup", "schemaSubject": "signup-event", "schemaVersion": 3,
                                      "payloadSchema": EVENT_SCHEMA,
                                      "iceberg": dict(TARGET, tableName="signup")}},
    {"name": "route-error", "spec": {"consumerId": "error", "schemaSubject": "error-raw", "schemaVersion": 1,
                                     "payloadSchema": BROKEN_SCHEMA, "jsonExpressionPointer": "  "}},
]

SETTINGS = Settings()


_COMPILED: dict = {}


def event_routes(spark: SparkSession, names: list[str] | None = None, settings: Settings = SETTINGS) -> RouteTable:
    """The demo routes, compiled once per session and settings (the configuration is constant)."""
    key = (spark.sparkContext.applicationId, tuple(names) if names is not None else None, repr(settings))
    if key not in _COMPILED:
        chosen = [r for r in EVENT_ROUTES if names is None or r["spec"]["consumerId"] in names]
        _COMPILED[key] = compile_routes(R.flatten_routes(R.route_resources_df(spark, chosen)), settings)
    return _COMPILED[key]


def event_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_utc(spark)
    return TD.requests_from_events(TD.table(spark, sf_dir, "events"), SETTINGS.max_content_length)


def gated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.gate(event_requests(spark, sf_dir), event_routes(spark), spark)


def gate_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.outcomes(gated_events(spark, sf_dir))


def landing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = L.envelope(G.accepted(gated_events(spark, sf_dir)))
    return landed.select("producer", "timestampUTC", "id", "payload", "createdAt", "schemaSubject",
                         "schemaVersion", "schemaFingerprint",
                         F.octet_length("payload").cast("long").alias("payload_bytes"))


def unrouted(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = event_routes(spark, ["click", "view", "purchase"])
    return G.unrouted(event_requests(spark, sf_dir), table, spark).select("request_id", "api_version", "producer")




def landed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.envelope(G.accepted(gated_events(spark, sf_dir)))


# --- metrics (A1, A2, A6, A7, P8-P10) -------------------------------------------------------------

def requests_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.requests_total(gated_events(spark, sf_dir))


def bytes_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.bytes_total(gated_events(spark, sf_dir))


def accept_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.accept_rate(gated_events(spark, sf_dir), window="1 day")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "producer", "accepted", "rejected",
                      F.round("accept_rate", 6).alias("accept_rate"))


def slo_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.slo_check(gated_events(spark, sf_dir)).withColumns({
        "failed_rate": F.round("failed_rate", 6), "accepted_rate": F.round("accepted_rate", 6)})


def client_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.access_log(gated_events(spark, sf_dir))


# --- landing readers (S8, T6, W1) -----------------------------------------------------------------

def producers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.producers(landed_events(spark, sf_dir))


def keyed_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed landing with (producer, hour) keys: the newest write per key wins."""
    landed = landed_events(spark, sf_dir).withColumn("key_hour", F.date_format(F.date_trunc("hour", "ts"),
                                                                               "yyyy-MM-dd'T'HH"))
    win = L.keyed_last_write(landed.select("producer", "key_hour", "ts", "id", "batch_id", "timestampUTC"),
                             ["producer", "key_hour"], ["batch_id", "ts", "id"])
    return win.select("producer", "key_hour", "id", "timestampUTC")


def last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 3 turns per conversation (bounded buffer per key)."""
    conv = TD.table(spark, sf_dir, "conversations")
    out = L.last_n(conv.select("conv_id", "turn", "role"), ["conv_id"], [F.col("turn").desc()], 3,
                   SETTINGS.salt_buckets, tie="turn")
    return out.select("conv_id", "turn", "role", "rank")


# --- pointer, size limit (P1, P2, F4, P6) ---------------------------------------------------------

def pointer_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.functions import pointer as jp
    ev = TD.table(spark, sf_dir, "events")
    doc = F.concat(F.lit('{"m":{"a/b":{"t~1":['), F.col("user_id").cast("string"), F.lit(","),
                   F.col("event_id").cast("string"), F.lit(']}},"p":'), F.col("props"), F.lit("}"))
    v = F.try_parse_json(doc)
    return ev.select("event_id",
                     jp.extract_text(v, jp.segments("/p/k")).alias("k"),
                     jp.extract_text(v, jp.segments("/m/a~1b/t~01/1")).alias("escaped"),
                     jp.extract_text(v, jp.segments("/m/a~1b/t~01/2")).alias("missing"))


DOC_SETTINGS = Settings(max_content_length=16_384)
# The document sources that have a route; documents of other sources are unrouted.
#: Documents are pushed under one of these by a hash of their source, so that every one is gated whatever its source is called.
DOC_PRODUCERS = [f"docs-{i:x}" for i in range(16)]


def oversize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents pushed as bodies to bare routes, dealt by source, under a 16 KiB limit."""
    ensure_utc(spark)
    docs = TD.table(spark, sf_dir, "documents")
    reqs = docs.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("request_id"),
        F.lit(None).cast("string").alias("x_correlation_id"),
        F.timestamp_seconds(F.col("doc_id")).alias("received_at"),
        F.lit("v1").alias("api_version"), F.concat(F.lit("docs-"), F.substring(F.md5(F.coalesce("source", F.lit(""))), 1, 1)).alias("producer"),
        F.lit("application/json").alias("content_type"),
        F.octet_length("text").cast("long").alias("content_length"), F.col("text").alias("body"))
    routes = [{"name": f"route-{p}", "spec": {"consumerId": p, "schemaSubject": f"{p}-text", "schemaVersion": 1}} for p in DOC_PRODUCERS]
    table = compile_routes(R.flatten_routes(R.route_resources_df(spark, routes)), DOC_SETTINGS)
    return G.gate(reqs, table, spark).select("request_id", "producer", "status", "content_length",
                                             "payload_bytes")


# --- pull side (S6, C1-C7) ------------------------------------------------------------------------

def incremental_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signup rows past a mid-range watermark, decoded onto the derived target layout."""
    table = event_routes(spark, ["signup"])
    route = table.by_producer()["signup"]
    wm = P.parse_watermark('{"timestamp":"2024-01-15T00:00:00Z"}')
    rows = P.pull(landed_events(spark, sf_dir), "signup", wm, route.columns, route.pointer, SETTINGS.merge_key)
    return rows.select("push_event_id", "seq", F.try_variant_get("payload", "$.k", "int").alias("k"),
                       "timestampUTC", SETTINGS.merge_key)


ORDER_LINES = json.dumps({
    "type": "record", "name": "Line", "namespace": "demo.orders",
    "fields": [{"name": "l_orderkey", "type": "long"}, {"name": "l_linenumber", "type": "int"},
               {"name": "l_partkey", "type": "long"}, {"name": "l_returnflag", "type": "string"},
               {"name": "l_comment", "type": ["null", "string"]}],
})


#: Order lines that a task joins, collects, explodes and merges; what it sorts does not grow with the tables.
LINES_A_TASK = 250_000


def _line_parts(spark: SparkSession, sf_dir: str) -> int | None:
    """Tasks that the lines call for, where those are more than the session's shuffle partitions."""
    parts = -(-TD.table(spark, sf_dir, "lineitem").count() // LINES_A_TASK)
    return parts if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def landed_orders(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Orders pushed as JSON arrays of their lines, landed.

    ``l_comment`` is a nullable union, so it arrives tagged (``{"string": ...}``) on even lines.  With ``parts`` lines
    and orders are dealt by order to so many tasks.
    """
    ensure_utc(spark)
    li = TD.table(spark, sf_dir, "lineitem")
    comment = F.when(F.col("l_linenumber") % 2 == 0, F.struct(
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("string")))
    line = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", comment.alias("l_comment"))
    orders = TD.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    if parts is not None:
        li, orders = li.repartition(parts, "l_orderkey"), orders.repartition(parts, "o_orderkey")
    per_order = (li.join(orders, li.l_orderkey == orders.o_orderkey)
                 .groupBy("o_orderkey", "o_orderdate", "o_orderpriority")
                 .agg(F.to_json(F.collect_list(line)).alias("body")))
    reqs = per_order.select(
        F.concat(F.lit("ord-"), F.col("o_orderkey").cast("string")).alias("request_id"),
        F.col("o_orderdate").cast("timestamp").alias("received_at"), F.lit("v1").alias("api_version"),
        F.concat(F.lit("orders-"), F.substring("o_orderpriority", 1, 1)).alias("producer"),
        F.lit("application/json").alias("content_type"),
        F.octet_length("body").cast("long").alias("content_length"), "body")
    routes = [{"name": f"route-orders-{i}", "spec": {"consumerId": f"orders-{i}", "schemaSubject": "orders-lines",
                                                     "schemaVersion": 1}} for i in range(1, 6)]
    table = compile_routes(R.flatten_routes(R.route_resources_df(spark, routes)), SETTINGS)
    return L.envelope(G.accepted(G.gate(RQ.conform(reqs), table, spark)))


def payload_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders pushed as JSON arrays of their lines, exploded and decoded."""
    landed = landed_orders(spark, sf_dir, _line_parts(spark, sf_dir))
    cols = LY.with_envelope_columns(LY.derive_columns(ORDER_LINES), SETTINGS.merge_key)
    out = P.decode(P.explode_payload(landed), cols, SETTINGS.merge_key)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_comment")


def merge_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events merged by user in two overlapping halves; the newest event per user wins."""
    ev = TD.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    split = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    first = P.merge(None, ev.where(F.col("ts") < split), ["user_id"], ["ts", "event_id"])
    merged = P.merge(first, ev.where(F.col("ts") >= split), ["user_id"], ["ts", "event_id"])
    return merged.select("user_id", "event_id", "event_type",
                         F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"))


EPOCH = '{"timestamp":"1970-01-01T00:00:00Z"}'
EMBEDDING_SCHEMA = json.dumps({
    "type": "record", "name": "Embedding", "namespace": "demo.vectors",
    "fields": [{"name": "id", "type": "long"}, {"name": "embedding", "type": {"type": "array", "items": "float"}},
               {"name": "label", "type": "int"}],
})


def embedding_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings pushed through a schema route with a target; the vector lands as one variant column."""
    ensure_utc(spark)
    emb = TD.table(spark, sf_dir, "embeddings")
    body = F.to_json(F.struct(F.col("vec_id").alias("id"), F.col("embedding"), F.col("label")))
    reqs = emb.select(
        F.concat(F.lit("vec-"), F.col("vec_id").cast("string")).alias("request_id"),
        F.timestamp_seconds(F.col("vec_id") + F.lit(1_704_067_200)).alias("received_at"), F.lit("v1").alias("api_version"),
        F.concat(F.lit("vectors-"), (F.col("label") % 2).cast("string")).alias("producer"),
        F.lit("application/json").alias("content_type"),
        F.octet_length(body).cast("long").alias("content_length"), body.alias("body"))
    labels = (0, 1)
    routes = [{"name": f"route-vectors-{k}", "spec": {
        "consumerId": f"vectors-{k}", "schemaSubject": "vectors", "schemaVersion": 1,
        "payloadSchema": EMBEDDING_SCHEMA, "iceberg": dict(TARGET, tableName=f"vectors_{k}")}} for k in labels]
    table = compile_routes(R.flatten_routes(R.route_resources_df(spark, routes)), SETTINGS)
    landed = L.envelope(G.accepted(G.gate(reqs, table, spark)))
    rows = P.pull_many(landed, table.routes, P.parse_watermark(EPOCH), SETTINGS.merge_key)
    return rows.select("push_event_id", F.array_size(F.col("embedding").try_cast("array<variant>")).alias("n_elems"),
                       "label")


# --- route changelog (T1, T2, J3, A3, A4, W3) -----------------------------------------------------

def route_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TD.route_events_from_orders(TD.table(spark, sf_dir, "orders"))


def route_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RL.ordered(RL.snapshot(route_events(spark, sf_dir)))


def route_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RL.intervals(route_events(spark, sf_dir))


def route_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RL.changes(route_events(spark, sf_dir)).select("seq", "event_type", "name", "changed")


def route_reloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RL.reload_stats(route_events(spark, sf_dir))


def route_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item pushed by its customer's producer at its order's position in the route log."""
    li = TD.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    orders = TD.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    reqs = li.join(orders, li.l_orderkey == orders.o_orderkey).select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
        .alias("request_id"),
        F.concat(F.lit("p-"), F.col("o_custkey").cast("string")).alias("producer"),
        F.col("l_orderkey").alias("at"))
    ivs = RL.intervals(route_events(spark, sf_dir)).select(
        "producer", "valid_from", "valid_to", "schema_subject")
    out = RL.route_asof(reqs, ivs, "at")
    return out.select("request_id", "producer", "routed",
                      F.when(F.col("routed"), F.col("schema_subject")).alias("schema_subject"))


def reject_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reject sink rows (S9): every failing request with its status and message."""
    out = G.rejected(gated_events(spark, sf_dir))
    return out.select("request_id", L.docs.utc_text(F.col("received_at")).alias("received_at"), "producer",
                      "status", "error_code", "message")


def route_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first complete spec per producer in the changelog (T3): what triggers provisioning."""
    upserts = RL.effective(route_events(spark, sf_dir)).where(F.col("event_type").isin(*RL.UPSERTS))
    flat = upserts.select("seq", "name", "spec.*")
    return RL.first_seen(flat).select("producer", "seq", "name", "schema_subject", "schema_version")


PAGE_SCHEMA = json.dumps({
    "type": "record", "name": "Page", "namespace": "demo.web",
    "fields": [{"name": "id", "type": "long"}, {"name": "url", "type": "string"}, {"name": "html", "type": "string"}],
})


def page_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw web pages pushed as JSON (escaping long HTML), validated, landed, pulled and decoded back."""
    ensure_utc(spark)
    pages = TD.table(spark, sf_dir, "pages")
    body = F.to_json(F.struct(F.col("page_id").alias("id"), "url", "html"))
    reqs = pages.select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("request_id"),
        F.timestamp_seconds(F.col("page_id") + F.lit(1_704_067_200)).alias("received_at"),
        F.lit("v1").alias("api_version"),
        F.concat(F.lit("pages-"), (F.col("page_id") % 3).cast("string")).alias("producer"),
        F.lit("application/json; charset=utf-8").alias("content_type"),
        F.octet_length(body).cast("long").alias("content_length"), body.alias("body"))
    routes = [{"name": f"route-pages-{k}", "spec": {
        "consumerId": f"pages-{k}", "schemaSubject": "pages", "schemaVersion": 1, "payloadSchema": PAGE_SCHEMA,
        "iceberg": dict(TARGET, tableName=f"pages_{k}")}} for k in range(3)]
    table = compile_routes(R.flatten_routes(R.route_resources_df(spark, routes)), SETTINGS)
    landed = L.envelope(G.accepted(G.gate(reqs, table, spark)))
    pulled = P.pull_many(landed, table.routes, P.parse_watermark(EPOCH), SETTINGS.merge_key)
    return pulled.select(F.col("push_event_id").alias("page_id"), "url",
                         F.octet_length("html").cast("long").alias("html_bytes"),
                         F.sha2("html", 256).alias("html_sha256"))


def metric_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a metric batch writes (T7), over the batch of requests in hourly windows."""
    out = M.window_counts(gated_events(spark, sf_dir), "1 hour")
    return out.select(F.date_format("window.start", "yyyy-MM-dd'T'HH:mm:ss").alias("window_start"), "producer",
                      "requests_ok", "requests_error", "bytes", "accepted", "rejected")


def array_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders pushed as arrays of their lines, exploded, decoded and merged by key: every line stays."""
    cols = LY.with_envelope_columns(LY.derive_columns(ORDER_LINES), SETTINGS.merge_key)
    parts = _line_parts(spark, sf_dir)
    rows = P.decode(P.explode_payload(landed_orders(spark, sf_dir, parts)), cols, SETTINGS.merge_key)
    twice = rows.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("_copy")).drop("_copy")     # each row offered two times
    merged = P.merge(None, twice, [SETTINGS.merge_key], ["timestampUTC"], parts)
    return merged.select("l_orderkey", "l_linenumber", "l_partkey", "timestampUTC")


DECLARED_SCHEMA = json.dumps({
    "type": "record", "name": "Stamped", "namespace": "demo.events",
    "fields": [{"name": "key", "type": "long"}, {"name": "TimestampUTC", "type": "string"}, {"name": "merge_key", "type": "string"}],
})


def declared_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A route whose schema declares the envelope's columns: they hold landing values, not the document's."""
    ensure_utc(spark)
    ev = TD.table(spark, sf_dir, "events")
    body = F.to_json(F.struct(F.col("event_id").alias("key"), F.lit("2099-01-01T00:00:00Z").alias("TimestampUTC"),
                              F.lit("same").alias("merge_key")))
    reqs = ev.select(
        F.concat(F.lit("st-"), F.col("event_id").cast("string")).alias("request_id"), F.col("ts").cast("timestamp").alias("received_at"),
        F.lit("v1").alias("api_version"), F.lit("stamped").alias("producer"), F.lit("application/json").alias("content_type"),
        F.octet_length(body).cast("long").alias("content_length"), body.alias("body"))
    routes = [{"name": "route-stamped", "spec": {"consumerId": "stamped", "schemaSubject": "stamped", "schemaVersion": 1,
                                                 "payloadSchema": DECLARED_SCHEMA, "iceberg": dict(TARGET, tableName="stamped")}}]
    table = compile_routes(R.flatten_routes(R.route_resources_df(spark, routes)), SETTINGS)
    landed = L.envelope(G.accepted(G.gate(reqs, table, spark)))
    route = table.by_producer()["stamped"]
    rows = P.pull(landed, "stamped", P.parse_watermark(EPOCH), route.columns, route.pointer, SETTINGS.merge_key)
    return rows.select("key", F.col("TimestampUTC").alias("stamp"), "merge_key")


def conformity_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies with fractional, out-of-range, tagged and untagged values against one schema."""
    ensure_utc(spark)
    ev = TD.table(spark, sf_dir, "events")
    k = F.col("event_id") % len(MIX_VALUES)
    number = F.element_at(F.array(*[F.lit(v) for v, _ in MIX_VALUES]), (k + 1).cast("int"))
    union = F.element_at(F.array(*[F.lit(v) for v, _ in MIX_UNIONS]), (F.floor(F.col("event_id") / len(MIX_VALUES)) % len(MIX_UNIONS) + 1).cast("int"))
    body = F.concat(F.lit('{"n":'), number, F.lit(',"u":'), union, F.lit("}"))
    reqs = ev.select(
        F.concat(F.lit("mx-"), F.col("event_id").cast("string")).alias("request_id"), F.col("ts").cast("timestamp").alias("received_at"),
        F.lit("v1").alias("api_version"), F.lit("mix").alias("producer"), F.lit("application/json").alias("content_type"),
        F.octet_length(body).cast("long").alias("content_length"), body.alias("body"))
    routes = [{"name": "route-mix", "spec": {"consumerId": "mix", "schemaSubject": "mix", "schemaVersion": 1, "payloadSchema": MIX_SCHEMA}}]
    table = compile_routes(R.flatten_routes(R.route_resources_df(spark, routes)), SETTINGS)
    return G.outcomes(G.gate(RQ.conform(reqs), table, spark)).select("request_id", "status", "error_code")


MIX_SCHEMA = json.dumps({"type": "record", "name": "Mix", "fields": [
    {"name": "n", "type": "int"}, {"name": "u", "type": ["null", "long"]}]})
# JSON texts and whether they hold an int, and a nullable long in Avro's JSON encoding.
MIX_VALUES = [("7", True), ("7.0", True), ("7.5", False), ("2147483647", True), ("2147483648", False), ("1e-11", False), ('"7"', False),
              ("null", False), ("-2147483648", True), ("1e3", True), ("true", False)]
MIX_UNIONS = [("null", True), ('{"long":5}', True), ("5", False), ('{"int":5}', False), ('{"long":9223372036854775808}', False),
              ('{"long":1,"x":2}', False)]


# --- state kept between runs (S3, S6, S7, C5, C7, T1, T2) --------------------------------------------

def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Commits that event rows land in, by the millisecond they arrived.
COMMITS = 3


def _commits(spark: SparkSession, sf_dir: str):
    """The landing folder and, one after the other, its commits written: yields each one's number."""
    landed = materialised(landed_events(spark, sf_dir), "landed")
    root = _folder(spark, "landing")
    for k in range(COMMITS):
        L.write_landing(landed.where(F.unix_seconds("ts") % COMMITS == k), root, "events", k)
        yield root, k


def drained_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events land commit by commit, and after each `click` is drained, once across a compaction: every record by the
    drain after its commit, and no other (S3, S7, W2)."""
    out = None
    for root, k in _commits(spark, sf_dir):
        if k == COMMITS - 1:
            MF.compact(spark, root, "click")
            MF.fold(spark, root)
        rows = LS.drain(spark, root, "click", f"{root}_reader", f"{root}_drain{k}").select(F.lit(k).alias("drain"), "id", "timestampUTC")
        out = rows if out is None else out.unionByName(rows)
    return out


def pulled_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What landed for `signup` after the first commit, read by position from a compacted run and a slice."""
    for root, _ in _commits(spark, sf_dir):
        pass
    MF.compact(spark, root, "signup")
    rows, _ = MF.read_new(spark, root, "signup", {"events": 0})
    return rows.select("id", "timestampUTC", "payload")


def bucket_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events merged by user into a bucketed target in three batches; the newest event per user wins."""
    ev = TD.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"))
    name = f"merged_{uuid.uuid4().hex}"
    P.create_bucketed_target(spark, name, "user_id BIGINT, event_id BIGINT, event_type STRING, ts STRING", _folder(spark, "target"), 16)
    for k in range(3):
        P.merge_buckets(spark, name, ev.where(F.col("event_id") % 3 == k), ["user_id"], ["ts", "event_id"])
    return spark.table(name).drop(P.BUCKET)


def route_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route log folded in three runs, each reading its new events alone, judged as the whole log is."""
    events = route_events(spark, sf_dir)
    end = events.agg(F.max("seq")).first()[0] or 0
    fold = RL.RouteFold(spark, _folder(spark, "route-fold"))
    out = None
    for k in (1, 2, 3):
        rows = fold.run(events.where(F.col("seq") <= end * k // 3)).select("seq", "event_type", "name", "changed")
        out = rows if out is None else out.unionByName(rows)
    return out


def window_slo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p95 and p99 per hour and producer from merged sketches of minutes (T7's totals, A7); so few values are held exactly."""
    minutes = WM.windowed(gated_events(spark, sf_dir), "1 minute")
    hours = WM.slo_of_windows(minutes.withColumn("hour", F.date_trunc("hour", "window.start")), ["hour", "producer"])
    return hours.select(F.date_format("hour", "yyyy-MM-dd'T'HH").alias("hour"), "producer", "requests", "p95_ms", "p99_ms")


NODE_SCHEMA = json.dumps({"type": "record", "name": "Node", "fields": [
    {"name": "v", "type": ["long", "string", {"type": "array", "items": "Node"}]}, {"name": "next", "type": ["null", "Node"]}]})
# Documents (# stands for a number) and whether they are such a chain in Avro's JSON encoding.
NODES = [
    ('{"v":{"long":#},"next":null}', True),
    ('{"v":{"string":"a"},"next":{"Node":{"v":{"long":#},"next":null}}}', True),
    ('{"v":{"long":"#"},"next":null}', False),
    ('{"v":{"int":#},"next":null}', False),
    ('{"v":{"long":#},"next":{"Node":{"v":{"long":#},"next":{"Node":{"v":{"long":1.5},"next":null}}}}}', False),
    ('{"v":{"long":#},"next":{"Node":{"v":{"long":#}}}}', False),
    ('{"next":{"Node":{"next":{"Node":{"v":{"array":[]},"next":null}},"v":{"long":#}}},"v":{"long":7.0},"x":#}', True),
    ('{"v":{"array":[{"v":{"long":#},"next":null},{"v":{"string":"#"},"next":null}]},"next":null}', True),
    ('{"v":{"array":[{"v":{"long":#},"next":null},{"v":{"string":#},"next":null}]},"next":null}', False),
    ('{"v":{"long":1,"string":"#"},"next":null}', False),
    ('{"v":null,"next":null}', False),
]


def _pushed(ev: DataFrame, producer: str, body) -> DataFrame:
    return RQ.conform(ev.select(
        F.concat(F.lit(f"{producer}-"), F.col("event_id").cast("string")).alias("request_id"), F.col("ts").cast("timestamp").alias("received_at"),
        F.lit("v1").alias("api_version"), F.lit(producer).alias("producer"), F.lit("application/json").alias("content_type"),
        F.octet_length(body).cast("long").alias("content_length"), body.alias("body")))


def conformity_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a schema that refers to itself, with unions of several types and arrays of records."""
    ensure_utc(spark)
    ev = TD.table(spark, sf_dir, "events")
    text = F.element_at(F.array(*[F.lit(t) for t, _ in NODES]), (F.col("event_id") % len(NODES) + 1).cast("int"))
    reqs = _pushed(ev, "chain", F.replace(text, F.lit("#"), F.col("user_id").cast("string")))
    routes = [{"name": "route-chain", "spec": {"consumerId": "chain", "schemaSubject": "chain", "schemaVersion": 1, "payloadSchema": NODE_SCHEMA}}]
    table = compile_routes(R.flatten_routes(R.route_resources_df(spark, routes)), SETTINGS)
    return G.outcomes(G.gate(reqs, table, spark)).select("request_id", "status", "error_code")


# Documents (# stands for a number) and what the rename makes of them.
RENAMES = [
    ('{"id":#}', '{"push_event_id":#}'),
    ('{ "k" : {"id":#} ,  "id" : 1#1234567890123456789012345678901234567890 , "z":1.50}',
     '{ "k" : {"id":#} ,  "push_event_id" : 1#1234567890123456789012345678901234567890 , "z":1.50}'),
    ('{"b":[{"id":1},"id",#],"a":"\\"id\\":","id":{"y":1,"x":2}}', '{"b":[{"id":1},"id",#],"a":"\\"id\\":","push_event_id":{"y":1,"x":2}}'),
    ('{"id":#,"push_event_id":1}', '{"id":#,"push_event_id":1}'),
    ('[{"id":#}]', '[{"id":#}]'),
    ('{"k":{"id":#}}', '{"k":{"id":#}}'),
    ('{"id":#} and more', '{"id":#} and more'),
]


def renamed_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root ids renamed in place: numbers of any length, member order, white space and escapes stay as sent."""
    ensure_utc(spark)
    ev = TD.table(spark, sf_dir, "events")
    text = F.element_at(F.array(*[F.lit(t) for t, _ in RENAMES]), (F.col("event_id") % len(RENAMES) + 1).cast("int"))
    reqs = _pushed(ev, "renamed", F.replace(text, F.lit("#"), F.col("user_id").cast("string")))
    routes = [{"name": "route-renamed", "spec": {"consumerId": "renamed", "schemaSubject": "renamed", "schemaVersion": 1,
                                                 "iceberg": dict(TARGET, tableName="renamed", columns=[{"name": "x", "type": "int"}])}}]
    table = compile_routes(R.flatten_routes(R.route_resources_df(spark, routes)), SETTINGS)
    return G.gate(reqs, table, spark).select("request_id", "status", "payload", "payload_bytes")


def landing_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events landed in two commits, read through the table that was ensured over their folder."""
    landed = materialised(landed_events(spark, sf_dir), "landed")
    root, name = _folder(spark, "landing"), f"landing_{uuid.uuid4().hex}"
    L.ensure_landing_table(spark, name, root, auto_create=True)
    for k in range(2):
        L.write_landing(landed.where(F.unix_seconds("ts") % 2 == k), root, "events", k, name)
    return spark.table(name).select("producer", "batch_id", "id", "timestampUTC", "schemaSubject", "schemaVersion")


CONSUMED = [{"name": "route-consumed", "spec": {"consumerId": "signup", "schemaSubject": "signup-event", "schemaVersion": 3, "payloadSchema": EVENT_SCHEMA,
                                                "jsonExpressionPointer": "/payload"}}]


def consumed_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target provisioned from its route's schema and pointer, filled by a consumer run after each of three commits, the
    second one twice: layout, properties, pointer on read, decode, envelope, merge, position (S5, D13, C2-C5, C7)."""
    name = f"t{uuid.uuid4().hex}"
    routes = [dict(r, spec=dict(r["spec"], iceberg=dict(TARGET, tableName=name))) for r in CONSUMED]
    table = compile_routes(R.flatten_routes(R.route_resources_df(spark, routes)), SETTINGS)
    PV.provision(spark, table, location_root=_folder(spark, "targets"))
    route = table.by_producer()["signup"]
    landed = materialised(L.envelope(G.accepted(G.gate(event_requests(spark, sf_dir), table, spark))), "landed")
    root, target = _folder(spark, "landing"), PV.table_name(route.iceberg)
    for k in range(COMMITS):
        L.write_landing(landed.where(F.unix_seconds("ts") % COMMITS == k), root, "events", k)
        for _ in range(1 + (k == 1)):
            P.pull_into_table(spark, root, target, "signup", route.columns, SETTINGS.merge_key, version=1)
    return spark.table(target)


#: The request files of a stream are read in this many batches, and none of them holds many more rows than this.
REQUEST_BATCHES = 3
REQUEST_FILE_ROWS = 50_000


def _request_files(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    """The requests written as files of a bounded number of rows, in no order of time, and how many of them make a batch: what
    writes them and what gates a batch are as many tasks as the rows call for."""
    path = _folder(spark, "requests")
    rows = TD.table(spark, sf_dir, "events").count()
    batch = max(1, -(-rows // (REQUEST_BATCHES * REQUEST_FILE_ROWS)))
    event_requests(spark, sf_dir).repartition(REQUEST_BATCHES * batch, "request_id").write.parquet(path)
    return path, batch


def streamed_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pushes read as a stream, some files a batch, gated and landed with routes read anew each batch."""
    (requests, files), root = _request_files(spark, sf_dir), _folder(spark, "landing")
    LS.start_landing(RQ.stream_requests(spark, requests, max_files_per_trigger=files), lambda: event_routes(spark), root, f"{root}_rejects").awaitTermination()
    landed = L.read_landing(spark, root).select("producer", "id", F.lit(None).cast("string").alias("error_code"))
    rejects = spark.read.parquet(f"{root}_rejects").select("producer", F.col("request_id").alias("id"), "error_code")
    return landed.unionByName(rejects)


def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windowed totals kept by a stateful stream over files out of order, some batches folded."""
    (requests, files), path = _request_files(spark, sf_dir), _folder(spark, "windows")
    WM.start_window_metrics(RQ.stream_requests(spark, requests, max_files_per_trigger=files), lambda: event_routes(spark), path, window="1 hour",
                            watermark="400 days", fold_every=2).awaitTermination()
    rows = WM.read_windows(spark, path)
    return rows.select(F.date_format("window.start", "yyyy-MM-dd'T'HH:mm:ss").alias("window_start"), "producer", *M.WINDOW_COUNTS)


def tagged_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by producer and outcome with static tags (A1, A5)."""
    return M.requests_total(gated_events(spark, sf_dir), {"service": "ingest", "env": "demo"})


def name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column names that collide ignoring case, over column lists derived from events."""
    ev = TD.table(spark, sf_dir, "events")
    name = F.concat(F.when(F.col("event_id") % 3 == 0, F.lit("Col")).when(F.col("event_id") % 3 == 1, F.lit("COL")).otherwise(F.lit("other")),
                    (F.col("user_id") % 40).cast("string"))
    cols = ev.select(F.concat(F.lit("r"), (F.col("event_id") % 50).cast("string")).alias("route_name"), name.alias("column_name")).distinct()
    return M.name_collisions(cols).select("route_name", "lower_name", "n", F.concat_ws(",", "names").alias("names"))


REGISTRY = {
    "gate_outcomes": gate_outcomes,
    "landing_rows": landing_rows,
    "unrouted": unrouted,
    "requests_total": requests_total,
    "bytes_total": bytes_total,
    "accept_rate": accept_rate,
    "slo_check": slo_check,
    "client_address": client_address,
    "producers": producers,
    "keyed_lww": keyed_lww,
    "last_n": last_n,
    "pointer_extract": pointer_extract,
    "oversize_docs": oversize_docs,
    "incremental_pull": incremental_pull,
    "payload_explode": payload_explode,
    "merge_target": merge_target,
    "embedding_variant": embedding_variant,
    "route_snapshot": route_snapshot,
    "route_intervals": route_intervals,
    "route_changes": route_changes,
    "route_reloads": route_reloads,
    "route_asof": route_asof,
    "reject_rows": reject_rows,
    "route_first_seen": route_first_seen,
    "page_roundtrip": page_roundtrip,
    "metric_windows": metric_windows,
    "array_merge": array_merge,
    "declared_envelope": declared_envelope,
    "conformity_mix": conformity_mix,
    "drained_rows": drained_rows,
    "pulled_commits": pulled_commits,
    "bucket_merge": bucket_merge,
    "route_folds": route_folds,
    "window_slo": window_slo,
    "conformity_chains": conformity_chains,
    "renamed_bodies": renamed_bodies,
    "landing_table": landing_table,
    "consumed_target": consumed_target,
    "streamed_landing": streamed_landing,
    "streamed_windows": streamed_windows,
    "tagged_totals": tagged_totals,
    "name_collisions": name_collisions,
}

#: Queries that keep state between runs of their own: they write while they are built.
STATEFUL = frozenset({"drained_rows", "pulled_commits", "bucket_merge", "route_folds", "landing_table", "consumed_target", "streamed_landing",
                      "streamed_windows"})
