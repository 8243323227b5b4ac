"""Route-table source (S2): route resources → one flat row per route.

A route resource is a JSON document ``{"name": ..., "spec": {...}}`` or, as custom
resources are written, ``{"metadata": {"name": ...}, "spec": {...}}`` (one per line for
``spark.read.json``).  The spec fields follow the route definition:
consumerId, schemaSubject, schemaVersion, payloadSchema?, jsonExpressionPointer?
and an optional iceberg block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMN_SPEC = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("required", T.BooleanType()),
])

ICEBERG_SPEC = T.StructType([
    T.StructField("catalogUri", T.StringType()),
    T.StructField("warehouse", T.StringType()),
    T.StructField("namespace", T.StringType()),
    T.StructField("tableName", T.StringType()),
    T.StructField("columns", T.ArrayType(COLUMN_SPEC)),
    T.StructField("initialProperties", T.MapType(T.StringType(), T.StringType())),
])

ROUTE_SPEC = T.StructType([
    T.StructField("consumerId", T.StringType()),
    T.StructField("schemaSubject", T.StringType()),
    T.StructField("schemaVersion", T.LongType()),
    T.StructField("payloadSchema", T.StringType()),
    T.StructField("jsonExpressionPointer", T.StringType()),
    T.StructField("iceberg", ICEBERG_SPEC),
])

ROUTE_RESOURCE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("spec", ROUTE_SPEC),
    T.StructField("metadata", T.StructType([T.StructField("name", T.StringType())])),
])


def read_route_resources(spark: SparkSession, path: str) -> DataFrame:
    """Route resources stored as JSON lines (or multi-line JSON with ``multiLine``)."""
    return spark.read.schema(ROUTE_RESOURCE).json(path)


def route_resources_df(spark: SparkSession, resources: list[dict]) -> DataFrame:
    """Route resources given inline (configuration, a handful of rows)."""
    return spark.createDataFrame(resources, ROUTE_RESOURCE)


def _name(resources: DataFrame):
    named = F.col("name")
    return F.coalesce(named, F.col("metadata.name")) if "metadata" in resources.columns else named


def _complete(resources: DataFrame):
    s = F.col("spec")
    return (_name(resources).isNotNull() & s.isNotNull() & s["consumerId"].isNotNull()
            & s["schemaSubject"].isNotNull() & s["schemaVersion"].isNotNull())


def incomplete_resources(resources: DataFrame) -> DataFrame:
    """``route_name, producer, stage, message`` of every resource that :func:`flatten_routes` drops,
    in the shape of the route errors."""
    s = F.col("spec")
    missing = F.concat_ws(", ", F.when(_name(resources).isNull(), F.lit("name")), F.when(s.isNull(), F.lit("spec")),
                          *[F.when(s.isNotNull() & s[c].isNull(), F.lit(f"spec.{c}"))
                            for c in ("consumerId", "schemaSubject", "schemaVersion")])
    return resources.where(~_complete(resources)).select(
        _name(resources).alias("route_name"), s["consumerId"].alias("producer"), F.lit("resource").alias("stage"),
        F.concat(F.lit("incomplete route resource, without "), missing).alias("message"))


def flatten_routes(resources: DataFrame) -> DataFrame:
    """Flatten route resources: incomplete resources dropped (see :func:`incomplete_resources`), blank
    pointer → NULL, and the iceberg block kept only when it declares columns or the route has a payload
    schema."""
    s = F.col("spec")
    pointer = F.when(F.length(F.trim(s["jsonExpressionPointer"])) > 0, s["jsonExpressionPointer"])
    has_target = s["iceberg"].isNotNull() & (
        (F.coalesce(F.size(s["iceberg"]["columns"]), F.lit(0)) > 0) | s["payloadSchema"].isNotNull())
    return (resources
            .where(_complete(resources))
            .select(
                _name(resources).alias("route_name"),
                s["consumerId"].alias("producer"),
                s["schemaSubject"].alias("schema_subject"),
                s["schemaVersion"].cast("int").alias("schema_version"),
                s["payloadSchema"].alias("payload_schema"),
                pointer.alias("pointer"),
                F.when(has_target, s["iceberg"]).alias("iceberg"),
            ))


def route_columns(flat_routes: DataFrame) -> DataFrame:
    """(route_name, column_name, column_type) for every hand-written target column (A8 input)."""
    return (flat_routes.where(F.col("iceberg").isNotNull())
            .select("route_name", F.explode("iceberg.columns").alias("c"))
            .select("route_name", F.col("c.name").alias("column_name"), F.col("c.type").alias("column_type")))
