"""Streaming (T4, T5, T7, S7, S9): the stream lands what one batch lands; drains are consume-once."""


from pyspark.sql import functions as F

from tidewater import scenarios as S
from tidewater.operators import gate as G
from tidewater.operators import landing as L
from tidewater.sources import requests as RQ
from tidewater.streaming import landing_stream as LS

SF = "/root/testdata/sf0.001"


def _write_request_files(spark, path, n_files=4):
    reqs = S.event_requests(spark, SF)
    reqs.repartition(n_files, "request_id").write.mode("overwrite").parquet(path)
    return reqs


def test_stream_equals_batch(spark, scratch):
    src = f"{scratch}/requests"
    reqs = _write_request_files(spark, src)
    stream = RQ.stream_requests(spark, src, max_files_per_trigger=1)
    landing, rejects = f"{scratch}/landing", f"{scratch}/rejects"
    q = LS.start_landing(stream, lambda: S.event_routes(spark), landing, rejects, f"{scratch}/ckpt")
    q.awaitTermination()
    batch = L.envelope(G.accepted(G.gate(reqs, S.event_routes(spark), spark)))
    cols = ["producer", "timestampUTC", "id", "payload", "schemaSubject", "schemaVersion", "schemaFingerprint"]
    streamed = L.read_landing(spark, landing).select(*cols)
    assert streamed.exceptAll(batch.select(*cols)).count() == 0
    assert batch.select(*cols).exceptAll(streamed).count() == 0
    n_rejects = spark.read.parquet(rejects).count()
    assert n_rejects + streamed.count() == reqs.count()
    commits = LS.read_commits(spark, f"{landing}_commits")
    assert commits.count() == 4 and commits.agg(F.sum("landed")).first()[0] == streamed.count()


def test_two_streams_into_one_path_lose_nothing(spark, scratch):
    src = f"{scratch}/requests"
    reqs = _write_request_files(spark, src, 2)
    want = G.accepted(G.gate(reqs, S.event_routes(spark), spark)).count()
    for k in range(2):
        LS.start_landing(RQ.stream_requests(spark, src), lambda: S.event_routes(spark), f"{scratch}/landing", f"{scratch}/rej",
                         f"{scratch}/ckpt{k}", metrics_path=f"{scratch}/metrics").awaitTermination()
        # the same stream again has nothing to do
        LS.start_landing(RQ.stream_requests(spark, src), lambda: S.event_routes(spark), f"{scratch}/landing", f"{scratch}/rej",
                         f"{scratch}/ckpt{k}", metrics_path=f"{scratch}/metrics").awaitTermination()
    assert L.read_landing(spark, f"{scratch}/landing").count() == 2 * want
    assert LS.read_metrics(spark, f"{scratch}/metrics").agg(F.sum("accepted")).first()[0] == 2 * want


def test_default_checkpoint_lies_beside_the_landing_data(spark, scratch):
    src = f"{scratch}/requests"
    reqs = _write_request_files(spark, src, 2)
    for _ in range(2):
        LS.start_landing(RQ.stream_requests(spark, src), lambda: S.event_routes(spark), f"{scratch}/landing", f"{scratch}/rej",
                         name="again").awaitTermination()
    want = G.accepted(G.gate(reqs, S.event_routes(spark), spark)).count()
    assert L.read_landing(spark, f"{scratch}/landing").count() == want
    assert spark.read.json(f"{scratch}/landing_checkpoints/again/metadata").count() == 1


def test_landing_table_reads_what_the_stream_writes(spark, scratch):
    src = f"{scratch}/requests"
    _write_request_files(spark, src, 2)
    name = "default.streamed_landing"
    for k in range(2):
        LS.start_landing(RQ.stream_requests(spark, src, max_files_per_trigger=1), lambda: S.event_routes(spark), f"{scratch}/landing",
                         f"{scratch}/rej", f"{scratch}/ckpt{k}", table=name).awaitTermination()
    rows = spark.table(name)
    assert rows.count() == L.read_landing(spark, f"{scratch}/landing").count() > 0
    plan = rows.where("producer = 'click'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(producer" in plan
    assert spark.sql(f"SHOW PARTITIONS {name}").count() == rows.select("stream", "batch_id", "producer").distinct().count()


def test_drain_is_consume_once(spark, scratch):
    src = f"{scratch}/requests"
    _write_request_files(spark, src, 2)
    landing = f"{scratch}/landing"
    LS.start_landing(RQ.stream_requests(spark, src), lambda: S.event_routes(spark), landing, f"{scratch}/rej",
                     f"{scratch}/ckpt").awaitTermination()
    first = LS.drain(spark, landing, "click", f"{scratch}/drain_ckpt", f"{scratch}/drain1")
    n = first.count()
    assert n > 0
    ts = [r["ts"] for r in first.collect()]
    assert ts == sorted(ts)
    second = LS.drain(spark, landing, "click", f"{scratch}/drain_ckpt", f"{scratch}/drain2")
    assert second.count() == 0
    assert LS.drain(spark, landing, "nobody", f"{scratch}/drain_ckpt3", f"{scratch}/drain3").count() == 0
    newest = LS.drain(spark, landing, "click", f"{scratch}/drain_ckpt4", f"{scratch}/drain4", capacity=4).collect()
    assert [r["ts"] for r in newest] == ts[-4:]


def test_metric_stream_matches_batch(spark, scratch):
    src = f"{scratch}/requests"
    reqs = _write_request_files(spark, src, 2)
    for _ in range(2):                                   # the second run finds nothing new
        LS.start_metrics(RQ.stream_requests(spark, src, max_files_per_trigger=1), lambda: S.event_routes(spark),
                         f"{scratch}/metrics", f"{scratch}/mckpt").awaitTermination()
    streamed = LS.read_metrics(spark, f"{scratch}/metrics").groupBy("producer").agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r"))
    gated = G.gate(reqs, S.event_routes(spark), spark)
    batch = gated.groupBy("producer").agg(F.count_if(F.col("status") == 202).alias("a"),
                                          F.count_if(F.col("status") != 202).alias("r"))
    assert sorted(streamed.collect()) == sorted(batch.collect())


def test_replay_after_crash_replaces_the_first_attempt(spark, scratch):
    """A batch that landed in part before a crash runs again: landing, rejects and metrics hold it once, also
    when the routes have changed in between."""
    reqs = S.event_requests(spark, SF)
    landing, rejects, metrics = f"{scratch}/landing", f"{scratch}/rejects", f"{scratch}/metrics"
    run = lambda routes: LS.land_batch(reqs, 7, routes, landing, rejects, f"{landing}_commits", "s1", metrics)
    run(lambda: S.event_routes(spark))
    out = run(lambda: S.event_routes(spark, ["click", "view"]))
    assert L.read_landing(spark, landing).count() == out["landed"] > 0
    assert L.read_landing(spark, landing).select("producer").distinct().count() == 2
    assert spark.read.parquet(rejects).count() == out["rejected"] == reqs.count() - out["landed"]
    assert LS.read_metrics(spark, metrics).agg(F.sum("accepted")).first()[0] == out["landed"]
    assert LS.read_commits(spark, f"{landing}_commits").count() == 1
    # another stream's batch of the same number is another slice
    LS.land_batch(reqs, 7, lambda: S.event_routes(spark, ["click", "view"]), landing, rejects, f"{landing}_commits", "s2", metrics)
    assert L.read_landing(spark, landing).count() == 2 * out["landed"]


def test_callers_name_no_folders(spark, scratch):
    import os
    reqs = S.event_requests(spark, SF).withColumn("producer", F.concat(F.lit("any/"), F.col("request_id")))
    assert reqs.count() > 0
    LS.land_batch(reqs, 0, lambda: S.event_routes(spark), f"{scratch}/l", f"{scratch}/rej", f"{scratch}/c", "s")
    assert os.listdir(f"{scratch}/rej/stream=s/batch_id=0") and not any("=" in f for f in os.listdir(f"{scratch}/rej/stream=s/batch_id=0"))


def test_json_request_files_batch_and_stream(spark, scratch):
    src = f"{scratch}/json_requests"
    reqs = S.event_requests(spark, SF)
    reqs.write.json(src)
    batch = RQ.read_requests(spark, src, fmt="json")
    assert batch.count() == reqs.count()
    q = (RQ.stream_requests(spark, src, fmt="json").writeStream.format("memory").queryName("json_reqs")
         .option("checkpointLocation", f"{scratch}/jck").trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.table("json_reqs").count() == reqs.count()
    assert spark.table("json_reqs").exceptAll(batch).count() == 0


def test_landing_stream_metrics_match_batch(spark, scratch):
    src = f"{scratch}/requests"
    reqs = _write_request_files(spark, src, 3)
    q = LS.start_landing(RQ.stream_requests(spark, src, max_files_per_trigger=1), lambda: S.event_routes(spark),
                         f"{scratch}/landing", f"{scratch}/rejects", f"{scratch}/ckpt",
                         metrics_path=f"{scratch}/metrics")
    q.awaitTermination()
    got = LS.read_metrics(spark, f"{scratch}/metrics").groupBy("producer").agg(
        F.sum("accepted").alias("a"), F.sum("rejected").alias("r"), F.sum("bytes").alias("b"))
    gated = G.gate(reqs, S.event_routes(spark), spark)
    want = gated.groupBy("producer").agg(
        F.count_if(F.col("status") == 202).alias("a"), F.count_if(F.col("status") != 202).alias("r"),
        F.sum(F.when(F.col("status") == 202, F.col("payload_bytes")).otherwise(0)).alias("b"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())


def _events(spark, scratch, rows):
    types = F.element_at(F.array(*[F.lit(x) for x in ("click", "view", "purchase", "signup", "error")]), (F.col("id") % 5 + 1).cast("int"))
    spark.range(rows).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 97 % 86_400).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 50).alias("user_id"), types.alias("event_type"), F.col("id").cast("double").alias("value"),
        F.concat(F.lit('{"k":'), (F.col("id") % 100).cast("string"), F.lit("}")).alias("props")).coalesce(1).write.parquet(f"{scratch}/events.parquet")
    return scratch


def test_request_files_are_bounded_in_rows_and_read_in_three_batches(spark, scratch, monkeypatch):
    """Neither what writes the requests nor what gates a batch is a fixed number of tasks: files grow with the rows."""
    sf = _events(spark, scratch, 900)
    monkeypatch.setattr(S, "REQUEST_FILE_ROWS", 100)
    monkeypatch.setattr(S, "_folder", lambda spark, name: f"{scratch}/{name}")
    landed = S.streamed_landing(spark, sf)
    files = spark.read.parquet(f"{scratch}/requests").select(F.input_file_name().alias("f")).groupBy("f").count().collect()
    assert len(files) == 9 and max(r["count"] for r in files) < 200
    commits = LS.read_commits(spark, f"{scratch}/landing_commits").collect()
    assert len(commits) == 3 and sum(r["landed"] + r["rejected"] for r in commits) == 900
    gated = G.gate(S.event_requests(spark, sf), S.event_routes(spark), spark)
    want = gated.select("producer", "error_code").exceptAll(landed.select("producer", "error_code"))
    assert want.count() == 0 and landed.count() == 900


def test_windows_over_many_request_files_equal_the_batch(spark, scratch, monkeypatch):
    sf = _events(spark, scratch, 900)
    monkeypatch.setattr(S, "REQUEST_FILE_ROWS", 100)
    monkeypatch.setattr(S, "_folder", lambda spark, name: f"{scratch}/{name}")
    rows = S.streamed_windows(spark, sf).collect()
    assert sorted(rows) == sorted(S.metric_windows(spark, sf).collect())
    assert spark.read.parquet(f"{scratch}/requests").select(F.input_file_name()).distinct().count() == 9
