"""Landing readers: bounded buffer (W1), chronological drain order (W2), keyed last write."""

import datetime as dt

from pyspark.sql import functions as F

from tidewater.operators import landing as L


def rows(spark, items):
    return spark.createDataFrame(items, "producer string, ts timestamp, id string, batch_id long, payload string")


def test_last_n_keeps_newest_oldest_first(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = rows(spark, [("p", t0 + dt.timedelta(seconds=i), f"id{i}", 0, str(i)) for i in range(1, 7)])
    kept = L.chronological(L.last_n(df, ["producer"], [F.col("ts").desc()], 4, salt_buckets=3))
    assert [r["payload"] for r in kept.collect()] == ["3", "4", "5", "6"]
    assert L.last_n(df.where("producer = 'unknown'"), ["producer"], [F.col("ts").desc()], 4).count() == 0


def test_last_n_hot_key_exact(spark):
    t0 = dt.datetime(2024, 1, 1)
    items = [("hot", t0 + dt.timedelta(seconds=i), f"h{i}", 0, str(i)) for i in range(500)]
    items += [("cold", t0 + dt.timedelta(seconds=i), f"c{i}", 0, str(i)) for i in range(5)]
    kept = L.last_n(rows(spark, items), ["producer"], [F.col("ts").desc()], 10, salt_buckets=8)
    got = sorted(int(r["payload"]) for r in kept.where("producer = 'hot'").collect())
    assert got == list(range(490, 500)) and kept.where("producer = 'cold'").count() == 5


def test_keyed_last_write_wins(spark):
    t = dt.datetime(2024, 1, 1)
    df = rows(spark, [("p", t, "a", 0, "first"), ("p", t, "b", 1, "second"), ("q", t, "c", 0, "only")])
    df = df.withColumn("timestampUTC", F.lit("2024-01-01T00:00:00.000000Z"))
    out = {r["producer"]: r["payload"] for r in
           L.keyed_last_write(df, ["producer", "timestampUTC"], ["batch_id", "ts", "id"]).collect()}
    assert out == {"p": "second", "q": "only"}


def test_write_read_pull_and_producers(spark, scratch):
    t0 = dt.datetime(2024, 1, 1)
    df = rows(spark, [(p, t0 + dt.timedelta(hours=i), f"{p}{i}", 0, "{}") for p in "ab" for i in range(5)])
    df = df.withColumn("timestampUTC", F.lit("x")).withColumn("createdAt", F.lit(0).cast("long")) \
        .withColumn("schemaSubject", F.lit("s")).withColumn("schemaVersion", F.lit(1)) \
        .withColumn("schemaFingerprint", F.lit(None).cast("string"))
    path = f"{scratch}/landing"
    L.write_landing(df, path)
    landed = L.read_landing(spark, path)
    assert sorted(r[0] for r in L.producers(landed).collect()) == ["a", "b"]
    pulled = L.incremental_pull(landed, "a", t0 + dt.timedelta(hours=2))
    assert sorted(r["id"] for r in pulled.collect()) == ["a3", "a4"]
    plan = pulled._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(producer" in plan and "PushedFilters" in plan
