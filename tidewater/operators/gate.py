"""The request gate.

One narrow stage: requests ⋈ broadcast(routes) on (api_version, producer), then a
single CASE chain where the first failing rule wins:

  unrouted 404 → media type 415 → length missing 411 → too large 413 →
  length <= 0 400 → unreadable body 400 → empty body 400 →
  schema conformity 400 → invalid route 500 → pointer resolves 400 → accepted 202

The body is parsed to a variant once, and only for rows that passed the cheap
header checks on a route that needs it (schema, pointer or rename).  Check programs
and pointer paths are data on the route's row, so the expression does not grow with
the number of routes; its Columns are built once a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import documents as docs
from tidewater.functions import errors as E
from tidewater.functions import pointer as jp
from tidewater.plans import checks as CK
from tidewater.plans import tree_checks as TC
from tidewater.plans.routes import RouteTable


def schema_ok(table: RouteTable, v: Column, body: Column) -> Column:
    """True when the route has no active schema, else the conformity verdict.

    A schema is evaluated from the program on its route's row: a flat list of checks where that can say it, a table of
    nodes otherwise (unions of several types, containers in containers, types that refer to themselves).  Both are one
    expression for all routes, and the second is left out where no route needs it.
    """
    if not table.schemas():
        return F.lit(True)
    expr = F.when(F.col("schema_checks").isNotNull(), CK.run(v, F.col("schema_checks")))
    if any(r.nodes for r in table.schemas().values()):
        expr = expr.when(F.col("schema_nodes").isNotNull(), TC.run(v, body, F.col("schema_nodes"), F.col("schema_levels")))
    return expr.otherwise(F.lit(True))


def pointer_ok(table: RouteTable, v: Column) -> Column:
    """True when the route has no pointer, else whether the pointer selects a value.  Whole paths, or the
    steps of a pointer that has none, ride on the route's row, so one expression serves all pointers."""
    if not any(r.tokens for r in table.routes):
        return F.lit(True)
    whole, steps = F.col("pointer_paths"), F.col("pointer_steps")
    found = F.exists(whole, lambda p: F.try_variant_get(v, p, "variant").isNotNull())
    expr = F.when(steps.isNull(), F.lit(True)).when(whole.isNotNull(), found)
    if any(r.tokens and jp.paths(r.tokens) is None for r in table.routes):
        expr = expr.otherwise(jp.follow(v, steps).isNotNull())
    return expr


_BUILT: dict[tuple, dict[str, Column]] = {}


def _columns(table: RouteTable, spark: SparkSession) -> dict[str, Column]:
    """The gate's Columns, in the order they are added.  They name columns only, so every plan of a session with the same
    limit and kinds of routes shares them; building them costs more than planning a small batch."""
    s = table.settings
    key = (spark.sparkContext.applicationId, s.max_content_length, s.check_body_length, bool(table.schemas()), any(r.nodes for r in table.schemas().values()),
           any(r.tokens for r in table.routes), any(r.tokens and jp.paths(r.tokens) is None for r in table.routes))
    if key in _BUILT:
        return _BUILT[key]
    length, body, v, code = F.col("content_length"), F.col("body"), F.col("v"), F.col("error_code")
    routed, is_json = F.col("route_name").isNotNull(), docs.is_json_media_type(F.col("content_type"))
    header_ok = (routed & is_json & length.isNotNull() & (length <= F.lit(s.max_content_length)) & (length > 0) & body.isNotNull()
                 & (body != F.lit("")))
    needs_doc = F.col("schema_key").isNotNull() | F.col("pointer").isNotNull() | F.col("rename")
    error_code = (
        F.when(~routed, F.lit("unrouted"))
        .when(~is_json, F.lit("content_type"))
        .when(length.isNull(), F.lit("length_required"))
        .when(length > F.lit(s.max_content_length), F.lit("too_large"))
        .when(length <= 0, F.lit("no_content"))
        .when(body.isNull(), F.lit("serialization"))
        .when(body == F.lit(""), F.lit("no_content"))
        .when(F.lit(s.check_body_length) & (F.octet_length(body) > F.lit(s.max_content_length)), F.lit("too_large"))
        .when(~schema_ok(table, v, body), F.lit("schema_validation"))
        .when(~F.col("pointer_ok"), F.lit("invalid_route"))
        .when(~pointer_ok(table, v), F.lit("invalid_json_path"))
    )
    accepted = code.isNull()
    payload = (F.when(accepted & F.coalesce(F.col("rename"), F.lit(False)), docs.rename_root_id(body, v))
               .when(accepted, body))
    cause = (F.when(code == "serialization", F.lit("request body could not be read"))
             .when(code == "schema_validation",
                   F.concat(F.lit("body does not conform to schema "), F.col("schema_subject"), F.lit(" v"),
                            F.col("schema_version").cast("string")))
             .when(code == "invalid_route",
                   F.concat(F.lit("invalid jsonExpressionPointer '"), F.col("pointer"), F.lit("'"))))
    payload_bytes = F.octet_length(F.col("payload")).cast("long")
    values = {
        "producer": F.col("producer"), "length": length, "max": F.lit(s.max_content_length),
        "pointer": F.coalesce(F.col("pointer"), F.lit("")), "cause": cause, "bytes": payload_bytes,
    }
    _BUILT[key] = {"v": F.when(header_ok & needs_doc, F.try_parse_json(body)), "error_code": error_code, "payload": payload,
                   "payload_bytes": payload_bytes, "status": E.status_col(code), "message": E.message_col(code, values)}
    return _BUILT[key]


def gate(requests: DataFrame, table: RouteTable, spark: SparkSession | None = None) -> DataFrame:
    """Annotate every request with status, error_code, message and the payload to land."""
    spark = spark or requests.sparkSession
    columns = dict(_columns(table, spark))
    gated = requests.join(table.join_side(spark), on=["api_version", "producer"], how="left")
    for name in ("v", "error_code", "payload"):                 # each reads the one before
        gated = gated.withColumn(name, columns.pop(name))
    return gated.withColumns(columns)


# What the sinks read from a gated batch (landing envelope, rejects, metrics): persisting only
# these keeps the raw body and the parsed variant out of the cache.
SINK_COLUMNS = ["request_id", "received_at", "producer", "payload", "payload_bytes", "schema_subject",
                "schema_version", "schema_fingerprint", "status", "error_code", "message"]


def _select_rows(gated: DataFrame, keep: Column, columns: list[str]) -> DataFrame:
    """Rows where ``keep`` holds, in one pass over the gate.

    A plain ``where`` on ``error_code`` is pushed below the gate's projection with the
    whole CASE chain inlined, so the chain (body parse, schema predicate) would run
    twice.  Emitting each row through a generator (a one-element array, NULL when
    dropped) leaves no filter to push: the chain runs once per row.
    """
    row = F.struct(*[F.col(c) for c in columns])
    return gated.select(F.inline(F.when(keep, F.array(row))))


def accepted(gated: DataFrame) -> DataFrame:
    """Accepted rows (F8), every gate column but the parsed body."""
    return _select_rows(gated, F.col("error_code").isNull(), [c for c in gated.columns if c != "v"])


def rejected(gated: DataFrame) -> DataFrame:
    """Reject rows (S9): nothing of these is landed."""
    return _select_rows(gated, F.col("error_code").isNotNull(),
                        ["request_id", "received_at", "producer", "status", "error_code", "message"])


def outcomes(gated: DataFrame) -> DataFrame:
    return gated.select("request_id", "producer", "status", "error_code", "message")


def unrouted(requests: DataFrame, table: RouteTable, spark: SparkSession | None = None) -> DataFrame:
    """Requests no route serves (J2): an anti join against the broadcast routes."""
    spark = spark or requests.sparkSession
    routes = table.join_side(spark).select("api_version", "producer")
    return requests.join(routes, on=["api_version", "producer"], how="left_anti")
