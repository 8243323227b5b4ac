"""Landing: envelope stamp (P5-P7), landing sink (S3, S4), and landed-row readers
(S6-S8, T6, W1, W2).

The landing table is Parquet in slices: ``stream=<writer>/batch_id=<n>/producer=<p>``.
A batch owns its slice and writes it by overwriting, so running a batch again replaces
what its first attempt left and can neither double nor skip a record.  The manifest beside the
table (:mod:`tidewater.operators.manifest`) says which slices are committed.  Files are sorted
by ``ts``, so the pull predicate ``ts > watermark`` prunes row groups by min/max
statistics; ``producer`` prunes folders.  Records never collapse on write; the keyed
last-write-wins view (T6) is an explicit operator.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidewater.functions import documents as docs
from tidewater.operators.manifest import record_slice

LANDING_COLUMNS = ["producer", "timestampUTC", "ts", "id", "payload", "createdAt",
                   "schemaSubject", "schemaVersion", "schemaFingerprint", "batch_id"]

LANDING_DDL = ("timestampUTC STRING, ts TIMESTAMP, id STRING, payload STRING, createdAt BIGINT, "
               "schemaSubject STRING, schemaVersion INT, schemaFingerprint STRING, stream STRING, "
               "batch_id BIGINT, producer STRING")
SLICE_COLUMNS = ["stream", "batch_id", "producer"]


def envelope(accepted: DataFrame, batch_id: int | Column = 0) -> DataFrame:
    """Wrap accepted gate rows in the landing envelope."""
    ts = F.col("received_at")
    return accepted.select(
        F.col("producer"),
        docs.utc_text(ts).alias("timestampUTC"),
        ts.alias("ts"),
        docs.landing_id(F.col("request_id"), F.col("producer")).alias("id"),
        F.col("payload"),
        F.unix_millis(ts).alias("createdAt"),
        F.col("schema_subject").alias("schemaSubject"),
        F.col("schema_version").alias("schemaVersion"),
        F.col("schema_fingerprint").alias("schemaFingerprint"),
        (batch_id if isinstance(batch_id, Column) else F.lit(batch_id)).cast("long").alias("batch_id"),
    )


def slice_path(path: str, stream: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/stream={stream}/batch_id={batch_id}"


def write_landing(landed: DataFrame, path: str, stream: str | None = None, batch_id: int = 0,
                  table: str | None = None, stats: list[tuple] | None = None) -> None:
    """Write a batch's slice, replacing what an earlier attempt at the same batch wrote, and commit it in the
    manifest (S3); ``stats`` are its rows by producer where the caller has them.

    Without ``stream`` the rows are a slice of their own.  ``rebalance`` lets AQE size the
    write tasks from the data: a producer holding a third of the batch is split into
    advisory-size partitions (no single task holds it whole) and small producers are
    coalesced, so file sizes stay near the target.  With ``table`` the slice's partitions
    are registered there (as many as the batch has producers, at most one per route).
    """
    stream = stream or f"once-{uuid.uuid4().hex}"
    target = slice_path(path, stream, batch_id)
    (landed.drop("batch_id", "stream").hint("rebalance", "producer")
     .sortWithinPartitions("producer", "ts")
     .write.mode("overwrite").partitionBy("producer").parquet(target))
    if table:
        register_slice(landed.sparkSession, table, target, stream, batch_id)
    record_slice(landed.sparkSession, path, target, stream, batch_id, stats)


def register_slice(spark: SparkSession, table: str, target: str, stream: str, batch_id: int) -> None:
    """Tell the catalog of the slice's partitions, and nothing else's; a replay changes none."""
    rows = spark.read.schema(LANDING_DDL).parquet(target)
    written = [r[0] for r in rows.select("producer").distinct().collect()]
    quoted = [p.replace("\\", "\\\\").replace("'", "\\'") for p in written]
    if quoted:
        specs = " ".join(f"PARTITION (stream='{stream}', batch_id={batch_id}, producer='{p}')" for p in quoted)
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {specs}")
    spark.catalog.refreshTable(table)


def ensure_landing_table(spark: SparkSession, name: str, path: str, auto_create: bool) -> bool:
    """Exists → use it; missing and auto_create → create it; missing otherwise → fail.
    Returns True when the table was created.  The table reads what :func:`write_landing` writes."""
    if spark.catalog.tableExists(name):
        return False
    if not auto_create:
        raise RuntimeError(f"landing table {name} does not exist and auto-create is disabled")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({LANDING_DDL}) USING parquet "
              f"PARTITIONED BY ({', '.join(SLICE_COLUMNS)}) LOCATION '{path}'")
    return True


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LANDING_DDL).parquet(path)


_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def utc_micros(ts: dt.datetime) -> int:
    """Microseconds since the epoch; naive means UTC."""
    aware = ts if ts.tzinfo else ts.replace(tzinfo=dt.timezone.utc)
    return (aware - _EPOCH) // dt.timedelta(microseconds=1)


def utc_literal(ts: dt.datetime) -> Column:
    """A timestamp literal that no time zone of process or session moves; naive means UTC."""
    return F.timestamp_micros(F.lit(utc_micros(ts)))


def incremental_pull(landed: DataFrame, producer: str, watermark_ts: dt.datetime) -> DataFrame:
    """``producer = X AND ts > watermark`` (S6): partition pruning plus Parquet pushdown."""
    return landed.where((F.col("producer") == F.lit(producer)) & (F.col("ts") > utc_literal(watermark_ts)))


def producers(landed: DataFrame) -> DataFrame:
    """Every producer that has landed a record."""
    return landed.select("producer").distinct()


def chronological(landed: DataFrame) -> DataFrame:
    """Oldest first."""
    return landed.orderBy("ts", "id")


def keyed_last_write(landed: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the newest by ``order`` kept.

    An aggregate with max_by, not a window: partial aggregation collapses each key
    map-side, so a key holding a third of all rows never lands in one task whole.
    """
    others = [c for c in landed.columns if c not in key]
    row = F.struct(*[F.col(c) for c in others])
    ordering = F.struct(*[F.col(c) for c in order])
    agg = landed.groupBy(*key).agg(F.max_by(row, ordering).alias("_w"))
    return agg.select(*key, *[F.col("_w")[c].alias(c) for c in others])


def last_n(landed: DataFrame, partition: list[str], order: list[Column], n: int, salt_buckets: int = 64,
           tie: str = "id") -> DataFrame:
    """The newest ``n`` rows per partition key (W1), skew-safe.

    Phase 1 ranks within (key, salt) groups, so a hot key is split over
    ``salt_buckets`` tasks and each keeps at most n rows; phase 2 ranks the at most
    n * salt_buckets survivors per key.  Exact: the global top n of a key is
    contained in the union of its per-salt top n.
    """
    salt = F.pmod(F.xxhash64(F.col(tie)), F.lit(salt_buckets))
    salted = landed.withColumn("_salt", salt)
    w1 = Window.partitionBy(*partition, "_salt").orderBy(*order, F.col(tie).desc())
    phase1 = salted.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= n)
    w2 = Window.partitionBy(*partition).orderBy(*order, F.col(tie).desc())
    return (phase1.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= n)
            .drop("_salt", "_r"))

