"""Requests and route changelogs derived from the shared test tables.

The test tables hold no HTTP traffic, so pushes are derived from them with
string/integer arithmetic both Spark and the SQL oracle can reproduce exactly.
Every row of the source table becomes one request; defects (bad media type,
missing or oversized length, empty or unreadable body, broken JSON, wrong
types, missing members) are assigned by residues of the row key, so each
defect class grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.settings import DEFAULT_MAX_CONTENT_LENGTH


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(c) -> F.Column:
    return c.cast("string")


def requests_from_events(events: DataFrame, max_content_length: int = DEFAULT_MAX_CONTENT_LENGTH) -> DataFrame:
    """One push per event: producer = event_type, body wraps ``props``."""
    eid, uid = F.col("event_id"), F.col("user_id")
    ident = F.concat(F.lit('{"id":"evt-'), _s(eid), F.lit('","seq":'))
    good = F.concat(ident, _s(uid), F.lit(',"payload":'), F.col("props"), F.lit("}"))
    body = (F.when(eid % 17 == 4, F.lit(""))
            .when(eid % 17 == 5, F.concat(ident, _s(uid)))                                   # truncated JSON
            .when(eid % 17 == 6, F.concat(ident, F.lit('"'), _s(uid), F.lit('","payload":'),
                                          F.col("props"), F.lit("}")))                      # seq as text
            .when(eid % 17 == 7, F.concat(ident, _s(uid), F.lit("}")))                       # no payload
            .when(eid % 17 == 8, F.lit(None).cast("string"))                                 # unreadable
            .otherwise(good))
    length = (F.when(eid % 19 == 9, F.lit(None).cast("long"))
              .when(eid % 19 == 10, F.lit(max_content_length) + eid)
              .when(eid % 19 == 11, F.lit(0).cast("long"))
              .otherwise(F.coalesce(F.octet_length(body), F.lit(16)).cast("long")))
    content_type = (F.when(eid % 13 == 1, F.lit("text/plain"))
                    .when(eid % 13 == 2, F.lit(None).cast("string"))
                    .when(eid % 13 == 3, F.lit("Application/JSON; charset=utf-8"))
                    .otherwise(F.lit("application/json")))
    api_version = F.when(eid % 29 == 11, F.lit("v2")).otherwise(F.lit("v1"))
    return events.select(
        F.concat(F.lit("req-"), _s(eid)).alias("request_id"),
        F.when(eid % 3 == 0, F.concat(F.lit("corr-"), _s(eid))).alias("x_correlation_id"),
        F.col("ts").cast("timestamp").alias("received_at"),
        api_version.alias("api_version"),
        F.col("event_type").alias("producer"),
        content_type.alias("content_type"),
        length.alias("content_length"),
        body.alias("body"),
        F.lit("POST").alias("method"),
        F.concat(F.lit("/api/"), api_version, F.lit("/"), F.col("event_type"), F.lit("/data")).alias("path"),
        F.when(eid % 5 == 0, F.concat(F.lit(" 10.0."), _s(eid % 256), F.lit("."), _s(uid % 256),
                                      F.lit(" , 172.16.0.1"))).alias("x_forwarded_for"),
        F.when(eid % 7 == 1, F.concat(F.lit("192.168."), _s(uid % 256), F.lit(".1"))).alias("x_real_ip"),
        F.when(eid % 11 != 3, F.concat(F.lit("203.0.113."), _s(eid % 256))).alias("remote_addr"),
        ((eid * 37 + uid * 11) % 450 + 5).cast("long").alias("duration_ms"),
    )


def route_events_from_orders(orders: DataFrame) -> DataFrame:
    """A route changelog: one event per order, resource name per customer.

    seq = order key; Deleted / Reseted / incomplete / Modified / Added by residues.
    The spec maps the customer to a producer with a subject from the priority.
    """
    k = F.col("o_orderkey")
    etype = (F.when(k % 997 == 0, F.lit("Reseted"))
             .when(k % 11 == 3, F.lit("Deleted"))
             .when(k % 2 == 0, F.lit("Modified"))
             .otherwise(F.lit("Added")))
    spec = F.struct(
        F.concat(F.lit("p-"), _s(F.col("o_custkey"))).alias("producer"),
        F.col("o_orderpriority").alias("schema_subject"),
        (F.year(F.col("o_orderdate")) - 1990).cast("int").alias("schema_version"),
        F.col("o_orderstatus").alias("status"),
    )
    return orders.select(
        k.alias("seq"),
        etype.alias("event_type"),
        F.concat(F.lit("route-"), _s(F.col("o_custkey"))).alias("name"),
        F.when((etype == "Deleted") | (k % 13 == 5), F.lit(None)).otherwise(spec).alias("spec"),
    )
