"""Event-time metrics: stream = batch, late rows, restarts, bounded state, folds; sketches against exact percentiles."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tests.test_gate import req, route, table
from tidewater.operators import gate as G
from tidewater.operators import metrics as M
from tidewater.sources import requests as RQ
from tidewater.streaming import window_metrics as WM

T0 = dt.datetime(2024, 1, 1, 23, 50)
COUNTS = list(M.WINDOW_COUNTS)


def requests(spark, start, n, seed=0, minutes=20):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        r = req(0, rng.choice(["a", "b", "zzz"]), rng.choice(['{"k":1}', '{"k":22}', ""]))
        r["request_id"] = f"r{start + i}"
        r["received_at"] = T0 + dt.timedelta(seconds=rng.randrange(60 * minutes))
        r["duration_ms"] = rng.randrange(1, 600)
        rows.append(r)
    return RQ.conform(spark.createDataFrame(rows, RQ.REQUEST_SCHEMA))


def land(spark, df, src):
    df.coalesce(1).write.mode("append").parquet(src)


def totals(df):
    return sorted((r["window"]["start"], r["producer"], *[r[c] for c in COUNTS]) for r in df.collect())


def test_stream_equals_batch_through_late_rows_folds_and_restarts(spark, scratch):
    src, out = f"{scratch}/src", f"{scratch}/out"
    routes = lambda: table(spark, [route("a", "a"), route("b", "b")])
    every = None
    for k in range(4):
        df = requests(spark, 1000 * k, 60, seed=k)                        # each run holds rows earlier than the last one's newest
        every = df if every is None else every.unionByName(df)
        land(spark, df, src)
        q = WM.start_window_metrics(RQ.stream_requests(spark, src), routes, out, watermark="1 hour", fold_every=2)
        q.awaitTermination()                                              # started anew each time: state and totals go on
    want = totals(M.window_counts(G.gate(every, routes(), spark)))
    assert totals(WM.read_windows(spark, out)) == want
    WM.fold_windows(spark, out)
    assert totals(WM.read_windows(spark, out)) == want and WM.fold_windows(spark, out) == 0
    assert len(WM.read_windows(spark, out).inputFiles()) <= 4             # two days, whatever the batches
    slo, exact = WM.slo_of_windows(WM.read_windows(spark, out)).first(), M.slo_check(G.gate(every, routes(), spark)).first()
    assert slo["requests"] == exact["requests"] and abs(slo["accepted_rate"] - exact["accepted_rate"]) < 1e-12
    ranks = sorted(r["duration_ms"] for r in every.collect())
    for got, p in ((slo["p95_ms"], 0.95), (slo["p99_ms"], 0.99)):
        assert abs(sum(x <= got for x in ranks) / len(ranks) - p) < 0.02


def test_state_is_bounded_by_the_watermark(spark, scratch):
    src, out = f"{scratch}/src", f"{scratch}/out"
    routes = lambda: table(spark, [route("a", "a")])
    rows = []
    for day in range(3):
        df = requests(spark, 1000 * day, 30, seed=day, minutes=5).withColumn("received_at", F.col("received_at") + F.expr(f"INTERVAL {day} DAYS"))
        land(spark, df, src)
        q = WM.start_window_metrics(RQ.stream_requests(spark, src), routes, out, watermark="1 minute")
        q.awaitTermination()
        rows.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert max(rows) <= 2 * 5 * 3                                         # the windows of one day, not of all


def test_merging_sketches_in_any_order(spark):
    rng = random.Random(9)
    values = [int(rng.paretovariate(1.2) * 10) for _ in range(20000)]
    df = spark.createDataFrame([(i % 37, v) for i, v in enumerate(values)], "part int, v bigint")
    parts = df.groupBy("part").agg(F.kll_sketch_agg_bigint("v", WM.SKETCH_K).alias("durations")).persist()
    answers = []
    for order in ("part", "hash"):
        p = parts.repartitionByRange(5, "part" if order == "part" else F.hash("part"))
        answers.append(tuple(p.agg(*[q.alias(str(i)) for i, q in enumerate(WM.quantiles(F.col("durations")))]).first()))
    ranked = sorted(values)
    for got in answers:
        for x, p in zip(got, (0.95, 0.99)):
            assert abs(sum(v <= x for v in ranked) / len(ranked) - p) < 0.01
