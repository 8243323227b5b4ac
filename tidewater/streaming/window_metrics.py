"""Event-time metrics with bounded state (T7, A1, A2, A6) and mergeable percentiles.

The stream itself is gated, windowed and counted: Spark's state store holds one row per open (window, producer), a watermark
on ``received_at`` closes windows, and late rows inside it correct their window.  Update mode hands on the current totals
of what changed in a batch, never increments, so a batch that runs again writes the same rows.

The result lies in one table a day.  A batch's totals are written under its number; every few batches they are folded
into the tables of the days they touch, and the switch to those is one commit, so a reader sees each total once and what
it reads does not grow with the batches.

Durations are kept as quantile sketches (KLL), which merge in any order: p95 and p99 of any span of windows and producers
come from the stored sketches, within the rank error that :data:`SKETCH_K` stands for.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import gate as G
from tidewater.operators import metrics as M
from tidewater.operators.manifest import PositionLog
from tidewater.plans.routes import RouteTable
from tidewater.sources import folders

#: Sketch size: a rank error of about 1.65 % for single quantiles at 99 % confidence at 200, a third of that here.
SKETCH_K = 800
WATERMARK = "10 minutes"
#: Batches between two folds.
FOLD_EVERY = 20

TOTALS_DDL = ("window struct<start:timestamp,end:timestamp>, producer string, requests_ok bigint, requests_error bigint, bytes bigint, "
              "accepted bigint, rejected bigint, durations binary, batch_id bigint, day string")


def windowed(gated: DataFrame, window: str = "1 minute") -> DataFrame:
    """:func:`metrics.window_counts` with a sketch of ``duration_ms`` (NULL where no request has one)."""
    counts = M.window_count_columns()
    sketch = F.kll_sketch_agg_bigint(F.col("duration_ms").cast("bigint"), SKETCH_K)
    return gated.groupBy(F.window("received_at", window).alias("window"), "producer").agg(*counts, sketch.alias("durations"))


def _totals(spark: SparkSession, path: str) -> tuple[DataFrame, dict, list[str]]:
    """Every stored total, its days' versions, and the batches beside them."""
    position, _ = PositionLog(spark, f"{path}/log").last()
    batches = [n for n in folders.names(spark, f"{path}/batches") if folders.exists(spark, f"{path}/batches/{n}/_SUCCESS")]
    fresh = [n for n in batches if int(n.split("=")[1]) > position.get("batch", -1)]
    paths = [f"{path}/batches/{n}" for n in fresh] + [f"{path}/days/v={v}/day={d}" for d, v in position.items() if d != "batch"]
    if not paths:
        return spark.createDataFrame([], TOTALS_DDL), position, batches
    # a folder of a day holds its column in its name alone
    rows = spark.read.schema(TOTALS_DDL.rsplit(",", 1)[0]).parquet(*paths)
    return rows.withColumn("day", F.date_format(F.col("window.start"), "yyyy-MM-dd")), position, batches


def _latest(rows: DataFrame) -> DataFrame:
    others = [c for c in rows.columns if c not in ("window", "producer")]
    last = rows.groupBy("window", "producer").agg(F.max_by(F.struct(*others), F.col("batch_id")).alias("t"))
    return last.select("window", "producer", *[F.col("t")[c].alias(c) for c in others])


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """The current totals: one row per (window, producer), open windows included."""
    return _latest(_totals(spark, path.rstrip("/"))[0]).drop("batch_id", "day")


def fold_windows(spark: SparkSession, path: str) -> int:
    """Fold the batches' totals into the tables of the days they touch; returns how many days that were."""
    path = path.rstrip("/")
    rows, position, batches = _totals(spark, path)
    fresh = [int(n.split("=")[1]) for n in batches if int(n.split("=")[1]) > position.get("batch", -1)]
    if not fresh:
        return 0
    touched = sorted(r[0] for r in spark.read.schema(TOTALS_DDL.rsplit(",", 1)[0]).parquet(*[f"{path}/batches/batch={b}" for b in fresh])
                     .select(F.date_format(F.col("window.start"), "yyyy-MM-dd")).distinct().collect())
    log = PositionLog(spark, f"{path}/log")
    version = max((v for d, v in position.items() if d != "batch"), default=0) + 1
    _latest(rows.where(F.col("day").isin(*touched))).write.mode("overwrite").partitionBy("day").parquet(f"{path}/days/v={version}")
    log.commit({**position, **dict.fromkeys(touched, version), "batch": max(fresh)}, uuid.uuid4().hex)
    for n in batches:                                       # a version that no day points to any more is left to a clean-up
        if int(n.split("=")[1]) <= max(fresh):
            folders.delete(spark, f"{path}/batches/{n}")
    return len(touched)


def start_window_metrics(requests_stream: DataFrame, routes: Callable[[], RouteTable], path: str, checkpoint: str | None = None,
                         trigger: dict | None = None, name: str | None = None, window: str = "1 minute", watermark: str = WATERMARK,
                         fold_every: int = FOLD_EVERY):
    """Keep windowed totals current under ``path`` (:func:`read_windows` reads them).

    State is bounded by the windows that the watermark keeps open; rows later than that are dropped, as a watermark
    does.  Routes are those of the query's start: a scheduled query (``availableNow``) takes them anew each run, a
    restart resumes state and totals.
    """
    path = path.rstrip("/")
    gated = G.gate(requests_stream.withWatermark("received_at", watermark), routes(), requests_stream.sparkSession)

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # rebalanced, not coalesced: a coalesce would pull the state's partitions into the one task that writes
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).hint("rebalance").write.mode("overwrite").parquet(f"{path}/batches/batch={batch_id}")
        if batch_id % fold_every == fold_every - 1:
            fold_windows(spark, path)

    writer = windowed(gated, window).writeStream.outputMode("update").foreachBatch(each) \
        .option("checkpointLocation", checkpoint or f"{path}_checkpoints/{name or 'windows'}")
    if name:
        writer = writer.queryName(name)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def quantiles(durations: Column, ranks: tuple[float, ...] = (0.95, 0.99)) -> list[Column]:
    """Quantiles of the durations that sketches hold together: an aggregate expression a rank."""
    merged = F.kll_merge_agg_bigint(durations, SKETCH_K)
    return [F.kll_sketch_get_quantile_bigint(merged, F.lit(r)) for r in ranks]


def slo_of_windows(windows: DataFrame, keys: list[str] = [], p95_ms: float = 200, p99_ms: float = 500, max_failed: float = 0.01,
                   min_accepted: float = 0.99) -> DataFrame:
    """The load-test thresholds (A7) over stored windows, in all or per ``keys``: what :func:`metrics.slo_check` says of
    the requests themselves, its percentiles within the sketches' error.  Every answer but 202 counts as failed."""
    total = F.sum(F.col("accepted") + F.col("rejected"))
    p95, p99 = quantiles(F.col("durations"))
    out = windows.groupBy(*keys).agg(total.cast("bigint").alias("requests"), p95.alias("p95_ms"), p99.alias("p99_ms"),
                                     F.try_divide(F.sum("rejected"), total).alias("failed_rate"), F.try_divide(F.sum("accepted"), total).alias("accepted_rate"))
    return out.withColumns({"p95_ok": F.col("p95_ms") < p95_ms, "p99_ok": F.col("p99_ms") < p99_ms,
                            "failed_ok": F.col("failed_rate") < max_failed, "accepted_ok": F.col("accepted_rate") > min_accepted})
