"""Target-table provisioning.

For every route with a target: create the table from the derived layout when it
does not exist yet, with the seeded comment (watermark) and properties; leave an
existing table untouched.  One route failing does not stop the others, and only
successes count as provisioned, so failures retry on the next run.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tidewater.plans import layout
from tidewater.plans.routes import RouteTable
from tidewater.settings import COMMENT_PROPERTY

PROVISION_LOG = T.StructType([
    T.StructField("producer", T.StringType()),
    T.StructField("table", T.StringType()),
    T.StructField("outcome", T.StringType()),     # created / exists / failed
    T.StructField("message", T.StringType()),
    T.StructField("at", T.TimestampType()),
])


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _sql_text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def table_name(iceberg: dict) -> str:
    return f"{_q(iceberg['namespace'])}.{_q(iceberg['tableName'])}"


def create_statement(name: str, cols: list[layout.Column], declared: dict | None, pointer: str | None,
                     fmt: str, location: str | None = None) -> str:
    props = layout.initial_properties(declared, pointer)
    comment = props.pop(COMMENT_PROPERTY)
    if fmt.lower() == "iceberg":
        props.update(layout.creation_properties(cols))
    stmt = f"CREATE TABLE {name} ({layout.ddl(cols)}) USING {fmt} COMMENT {_sql_text(comment)}"
    if location:
        stmt += f" LOCATION {_sql_text(location)}"
    if props:
        stmt += " TBLPROPERTIES (" + ", ".join(f"{_sql_text(k)} = {_sql_text(v)}" for k, v in props.items()) + ")"
    return stmt


def provisioned_producers(spark: SparkSession, log_path: str) -> set[str]:
    """Producers whose target a previous run created or found (T3: only successes count)."""
    try:
        log = spark.read.schema(PROVISION_LOG).parquet(log_path)
    except AnalysisException:
        return set()
    return {r[0] for r in log.where(F.col("outcome").isin("created", "exists")).select("producer").distinct()
            .collect()}


def provision(spark: SparkSession, table: RouteTable, provisioned: set[str] | None = None,
              location_root: str | None = None, log_path: str | None = None) -> DataFrame:
    """Provision every route's target once; returns this run's provision log.

    With ``log_path`` the log is durable: producers provisioned by earlier runs are
    skipped, this run's outcomes are appended, and failed routes retry next time.
    """
    done = set(provisioned or ())
    if log_path:
        done |= provisioned_producers(spark, log_path)
    log = []
    fmt = table.settings.table_format
    for r in table.routes:
        if not r.has_target or r.producer in done:
            continue
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        name = table_name(r.iceberg) if r.iceberg.get("tableName") else None
        try:
            if name is None or r.columns is None:
                reason = "; ".join(m for _, m in r.errors) or "route declares no table name"
                raise ValueError(reason)
            ns = r.iceberg["namespace"]
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {_q(ns)}")
            if spark.catalog.tableExists(f"{ns}.{r.iceberg['tableName']}"):
                log.append((r.producer, name, "exists", None, now))
            else:
                loc = f"{location_root}/{ns}/{r.iceberg['tableName']}" if location_root else None
                spark.sql(create_statement(name, r.columns, r.iceberg.get("initialProperties"), r.pointer, fmt, loc))
                log.append((r.producer, name, "created", None, now))
            done.add(r.producer)
        except Exception as e:  # one bad route must not stop the others
            log.append((r.producer, name, "failed", str(e).splitlines()[0][:500], now))
    out = spark.createDataFrame(log, PROVISION_LOG)
    if log_path and log:
        out.coalesce(1).write.mode("append").parquet(log_path)
    return out
