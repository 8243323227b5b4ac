"""Continuous landing (T4, T5, S3, S9) and consume-once drains.

Each micro-batch: reload and compile the routes (hot route swap, T4), gate the
batch once (persisted, since all sinks read it), and write accepted envelopes,
rejects, metrics and the batch's commit record, each into the slice of (stream, batch
id) and nowhere else.  The stream's id is the one its checkpoint holds, so two streams,
or one started over with a new checkpoint, never share a slice; a batch that runs
again overwrites its own slices, so nothing is skipped and nothing lands twice.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.operators import gate as G
from tidewater.operators import landing as L
from tidewater.operators import manifest as MF
from tidewater.operators import metrics as M
from tidewater.plans.routes import RouteTable

COMMIT_SCHEMA = T.StructType([
    T.StructField("landed", T.LongType()),
    T.StructField("rejected", T.LongType()),
    T.StructField("committed_at", T.TimestampType()),
    T.StructField("stream", T.StringType()),
    T.StructField("batch_id", T.LongType()),
])


def write_slice(df: DataFrame, path: str, stream: str, batch_id: int) -> None:
    """Overwrite what an earlier attempt at the same batch wrote; touch nothing else."""
    df.write.mode("overwrite").parquet(L.slice_path(path, stream, batch_id))


def batch_metrics(gated: DataFrame, window: str = "1 minute") -> DataFrame:
    """Per (window, producer) counts of one gated batch (A1, A2, A6); partial sums that
    :func:`read_metrics` adds up across batches."""
    return M.window_counts(gated, window)


def read_metrics(spark: SparkSession, metrics_path: str) -> DataFrame:
    """Current metrics: the per-batch partial counts summed per (window, producer)."""
    parts = spark.read.parquet(metrics_path)
    return parts.groupBy("window", "producer").agg(*[F.sum(c).cast("long").alias(c) for c in M.WINDOW_COUNTS])


def read_commits(spark: SparkSession, commits_path: str) -> DataFrame:
    return spark.read.schema(COMMIT_SCHEMA).parquet(commits_path)


def land_batch(batch: DataFrame, batch_id: int, routes: Callable[[], RouteTable], landing_path: str,
               rejects_path: str, commits_path: str, stream: str, metrics_path: str | None = None,
               table: str | None = None) -> dict:
    """Gate one batch and write its slice of every sink; returns the batch counts.

    Rejects are foldered by batch alone: what callers put into a request never names a folder.
    """
    spark = batch.sparkSession
    gated = G.gate(batch, routes(), spark).select(*G.SINK_COLUMNS).persist()
    try:
        # one pass that also fills the cache: rejects in all (they may name any producer), accepted by producer, one a route
        ok, us = F.col("error_code").isNull(), F.unix_micros("received_at")
        per = gated.groupBy(F.when(ok, F.col("producer")).alias("producer"), ok.alias("ok")).agg(
            F.count(F.lit(1)).alias("n"), F.min(us).alias("first"), F.max(us).alias("last")).collect()
        stats = [(r["producer"], r["n"], r["first"], r["last"]) for r in per if r["ok"]]
        counts = {"landed": sum(s[1] for s in stats), "rejected": sum(r["n"] for r in per if not r["ok"])}
        sinks = [(L.write_landing, L.envelope(G.accepted(gated), batch_id), landing_path, stream, batch_id, table, stats),
                 (write_slice, G.rejected(gated).hint("rebalance"), rejects_path, stream, batch_id)]
        if metrics_path:
            # metrics from the same gated frame: no second gate pass, and route swaps apply
            sinks.append((write_slice, batch_metrics(gated), metrics_path, stream, batch_id))
        # the sinks share nothing but the cached batch, and each write is mostly a job's fixed cost: side by side
        with ThreadPoolExecutor(len(sinks)) as pool:
            for written in [pool.submit(*sink) for sink in sinks]:
                written.result()
    finally:
        gated.unpersist()
    record = spark.range(1).select(F.lit(counts["landed"]).cast("long").alias("landed"),
                                   F.lit(counts["rejected"]).cast("long").alias("rejected"),
                                   F.current_timestamp().alias("committed_at"))
    write_slice(record.coalesce(1), commits_path, stream, batch_id)
    return {"stream": stream, "batch_id": batch_id, **counts}


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that the checkpoint holds: the same after a restart, new with a new checkpoint."""
    return spark.read.json(f"{checkpoint.rstrip('/')}/metadata").first()["id"]


def _per_batch(requests_stream: DataFrame, checkpoint: str, name: str | None, trigger: dict | None,
               run: Callable[[DataFrame, int, str], None]):
    """Start a query that calls ``run(batch, batch_id, stream)`` for each micro-batch."""
    ids: list[str] = []

    def each(batch: DataFrame, batch_id: int) -> None:
        if not ids:
            ids.append(stream_id(batch.sparkSession, checkpoint))
        run(batch, batch_id, ids[0])

    writer = requests_stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def start_landing(requests_stream: DataFrame, routes: Callable[[], RouteTable], landing_path: str,
                  rejects_path: str, checkpoint: str | None = None, trigger: dict | None = None,
                  name: str | None = None, metrics_path: str | None = None, table: str | None = None,
                  auto_create: bool = True):
    """Start the landing stream (T5).  ``routes`` is called per micro-batch (T4).

    With ``table`` the landing table is ensured first (S4) and every batch is registered there.
    Without an explicit ``checkpoint`` the stream checkpoints beside the landing data, in a folder
    named after the query: restarting the same stream resumes it.
    """
    root = landing_path.rstrip("/")
    if table:
        L.ensure_landing_table(requests_stream.sparkSession, table, landing_path, auto_create)

    def run(batch: DataFrame, batch_id: int, stream: str) -> None:
        land_batch(batch, batch_id, routes, landing_path, rejects_path, f"{root}_commits", stream, metrics_path, table)

    return _per_batch(requests_stream, checkpoint or f"{root}_checkpoints/{name or 'landing'}", name, trigger, run)


def start_metrics(requests_stream: DataFrame, routes: Callable[[], RouteTable], metrics_path: str,
                  checkpoint: str | None = None, trigger: dict | None = None, name: str | None = None,
                  window: str = "1 minute"):
    """Keep A1/A2/A6 current without landing anything (T7): each micro-batch is gated with the routes
    of the moment and its partial counts are written; :func:`read_metrics` reads them."""
    def run(batch: DataFrame, batch_id: int, stream: str) -> None:
        gated = G.gate(batch, routes(), batch.sparkSession).select(*G.SINK_COLUMNS)
        write_slice(batch_metrics(gated, window), metrics_path, stream, batch_id)

    return _per_batch(requests_stream, checkpoint or f"{metrics_path.rstrip('/')}_checkpoints/{name or 'metrics'}",
                      name, trigger, run)


def drain(spark: SparkSession, landing_path: str, producer: str, checkpoint: str, out_path: str,
          capacity: int | None = None) -> DataFrame:
    """Everything committed for ``producer`` since the previous drain with this checkpoint, oldest first and each record
    once (S7, W2), any number of times.

    The checkpoint holds the last batch read of each stream, so what a batch that runs again rewrites is not drained a
    second time, nor rows that compaction has moved.  ``out_path`` is a folder of each drain's own: its rows are
    written there before the position moves, and a drain that died, before or after that, is repeated whole by calling
    it again with the same folder.  With ``capacity`` only the newest ``capacity`` records are kept, as a bounded
    per-producer buffer would (W1; the service's default is ``settings.DEFAULT_BUFFER_CAPACITY``).  An unknown producer
    drains nothing.
    """
    out_path = out_path.rstrip("/")
    log = MF.PositionLog(spark, checkpoint)
    position, done = log.last()
    if done != out_path:
        rows, position = MF.read_new(spark, landing_path, producer, position)
        # two streams that landed one request, or an attempt whose slice was read before it was rewritten: one id, one record
        rows = L.keyed_last_write(rows, ["id"], ["batch_id", "stream"]).select(*rows.columns)
        if capacity is not None:
            rows = L.last_n(rows, ["producer"], [F.col("ts").desc()], capacity).drop("rank")
        rows.write.mode("overwrite").parquet(out_path)
        log.commit(position, out_path)
    return L.chronological(spark.read.schema(L.LANDING_DDL).parquet(out_path))
