"""Push-request source.

A request row carries exactly what the gate reads off an HTTP push: path parts,
headers, the body text and arrival time.  Batch jobs read any table with this
schema; streams use ``readStream`` with the same schema (JSON or Parquet files, or
a message bus decoded into it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("x_correlation_id", T.StringType()),
    T.StructField("received_at", T.TimestampType()),
    T.StructField("api_version", T.StringType()),
    T.StructField("producer", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("content_length", T.LongType()),
    T.StructField("body", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("x_forwarded_for", T.StringType()),
    T.StructField("x_real_ip", T.StringType()),
    T.StructField("remote_addr", T.StringType()),
    T.StructField("duration_ms", T.LongType()),
])


def read_requests(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(REQUEST_SCHEMA).format(fmt).load(path)


def stream_requests(spark: SparkSession, path: str, fmt: str = "parquet", max_files_per_trigger: int | None = None
                    ) -> DataFrame:
    reader = spark.readStream.schema(REQUEST_SCHEMA).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path)


def conform(df: DataFrame) -> DataFrame:
    """Select and cast to the request schema (missing optional columns become NULL)."""
    cols = []
    for f in REQUEST_SCHEMA.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)
