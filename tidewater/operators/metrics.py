"""Ingestion metrics (A1-A8) and the access-log projection.

All aggregates group by producer (and optionally a time window); Spark's partial
aggregation combines map-side, so a producer holding a third of all requests
still shuffles one row per task, not its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import documents as docs
from tidewater.functions.errors import ACCEPTED


def _with_tags(df: DataFrame, tags: dict | None) -> DataFrame:
    """Static tags on every metric row (A5)."""
    if not tags:
        return df
    return df.withColumns({k: F.lit(v) for k, v in tags.items()})


def requests_total(gated: DataFrame, tags: dict | None = None) -> DataFrame:
    """Requests by (producer, ok/error); unrouted requests are not counted (A1).

    Conditional counts rather than a filter on ``error_code``: a filter would be pushed
    below the gate's projection and evaluate its rule chain a second time.
    """
    routed = F.col("error_code").isNull() | (F.col("error_code") != "unrouted")
    ok = F.col("status") < 300
    per = gated.groupBy("producer").agg(F.count_if(routed & ok).alias("ok"), F.count_if(routed & ~ok).alias("error"))
    rows = F.explode(F.array(F.struct(F.lit("ok").alias("outcome"), F.col("ok").alias("requests")),
                             F.struct(F.lit("error").alias("outcome"), F.col("error").alias("requests"))))
    out = per.select("producer", rows.alias("r")).select("producer", "r.outcome", "r.requests") \
        .where(F.col("requests") > 0)
    return _with_tags(out, tags)


def bytes_total(gated: DataFrame, tags: dict | None = None) -> DataFrame:
    """Landed payload bytes by producer, accepted requests only (A2); conditional sums, no filter
    on the gate (see :func:`requests_total`)."""
    accepted = F.col("error_code").isNull()
    out = (gated.groupBy("producer")
           .agg(F.sum(F.when(accepted, F.col("payload_bytes"))).cast("long").alias("bytes"),
                F.count_if(accepted).alias("_n"))
           .where(F.col("_n") > 0).drop("_n"))
    return _with_tags(out, tags)


def accept_rate(gated: DataFrame, window: str | None = None) -> DataFrame:
    """Accepted (202), rejected (anything else) and accepted share, by producer and window."""
    keys: list[Column] = [F.col("producer")]
    if window:
        keys.insert(0, F.window("received_at", window).alias("window"))
    ok = F.col("status") == ACCEPTED
    return gated.groupBy(*keys).agg(
        F.count_if(ok).alias("accepted"),
        F.count_if(~ok).alias("rejected"),
        F.avg(ok.cast("int")).alias("accept_rate"),
    )


def slo_check(gated: DataFrame, p95_ms: float = 200, p99_ms: float = 500, max_failed: float = 0.01,
              min_accepted: float = 0.99, exact: bool = True) -> DataFrame:
    """Load-test thresholds over request durations.

    ``exact`` uses ``percentile`` (state = distinct durations with counts, bounded for
    integer milliseconds); otherwise ``percentile_approx`` with bounded sketches.
    """
    d = F.col("duration_ms")
    if exact:
        p95, p99 = F.percentile(d, 0.95), F.percentile(d, 0.99)
    else:
        p95, p99 = F.percentile_approx(d, 0.95, 10000), F.percentile_approx(d, 0.99, 10000)
    failed = F.avg((F.col("status") >= 400).cast("int"))
    acc = F.avg((F.col("status") == ACCEPTED).cast("int"))
    agg = gated.agg(F.count(F.lit(1)).alias("requests"), p95.alias("p95_ms"), p99.alias("p99_ms"),
                    failed.alias("failed_rate"), acc.alias("accepted_rate"))
    return agg.withColumns({
        "p95_ok": F.col("p95_ms") < p95_ms,
        "p99_ok": F.col("p99_ms") < p99_ms,
        "failed_ok": F.col("failed_rate") < max_failed,
        "accepted_ok": F.col("accepted_rate") > min_accepted,
    })


def name_collisions(route_columns: DataFrame) -> DataFrame:
    """Columns whose names collide ignoring case, per route.

    ``route_columns``: (route_name, column_name) rows, e.g. exploded route specs.
    """
    return (route_columns.groupBy("route_name", F.lower("column_name").alias("lower_name"))
            .agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("column_name")).alias("names"))
            .where(F.col("n") > 1))


def access_log(gated: DataFrame) -> DataFrame:
    """One access-log row per request: who hit which endpoint, with what outcome."""
    return gated.select(
        "request_id",
        docs.correlation_id(F.col("x_correlation_id"), F.col("request_id")).alias("correlation_id"),
        docs.client_ip(F.col("x_forwarded_for"), F.col("x_real_ip"), F.col("remote_addr")).alias("client_ip"),
        "method", "path", "producer", "status",
    )


WINDOW_COUNTS = ("requests_ok", "requests_error", "bytes", "accepted", "rejected")


def window_count_columns() -> list[Column]:
    """A1 / A2 / A6 as aggregates: routed ok/error requests, landed bytes, accepted and rejected."""
    ok = F.col("status") == ACCEPTED
    routed = F.col("error_code").isNull() | (F.col("error_code") != "unrouted")
    return [F.count_if(ok & routed).alias("requests_ok"),
            F.count_if(~ok & routed).alias("requests_error"),
            F.sum(F.when(ok, F.col("payload_bytes")).otherwise(F.lit(0))).cast("long").alias("bytes"),
            F.count_if(ok).alias("accepted"),
            F.count_if(~ok).alias("rejected")]


def window_counts(gated: DataFrame, window: str = "1 minute") -> DataFrame:
    """:func:`window_count_columns` per (time window, producer), the counts a metric stream keeps current."""
    return gated.groupBy(F.window("received_at", window).alias("window"), "producer").agg(*window_count_columns())
