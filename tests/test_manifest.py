"""Manifest, positions, drains and compaction: by when rows land, each once, however often anything runs again."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidewater import scenarios as S
from tidewater.operators import gate as G
from tidewater.operators import landing as L
from tidewater.operators import manifest as MF
from tidewater.streaming import landing_stream as LS

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def rows(spark, ids, producer="p", minutes=0):
    """Envelopes with the given numbers as ids, one a minute."""
    data = [(producer, T0 + dt.timedelta(minutes=minutes + i), f"{producer}-{i}", f'{{"x":{i}}}') for i in ids]
    df = spark.createDataFrame(data, "producer string, ts timestamp, id string, payload string")
    return df.select("producer", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestampUTC"), "ts", "id", "payload",
                     F.unix_millis("ts").alias("createdAt"), F.lit("s").alias("schemaSubject"), F.lit(1).alias("schemaVersion"),
                     F.lit(None).cast("string").alias("schemaFingerprint"), F.lit(0).cast("long").alias("batch_id"))


def ids_of(df):
    return [r["id"] for r in df.collect()]


def test_three_drains_with_rows_and_a_replay_between_them(spark, scratch):
    landing, ckpt = f"{scratch}/l", f"{scratch}/c"
    drain = lambda k: LS.drain(spark, landing, "p", ckpt, f"{scratch}/out{k}")
    L.write_landing(rows(spark, [2, 0, 1]), landing, "s", 0)
    assert ids_of(drain(1)) == ["p-0", "p-1", "p-2"]
    L.write_landing(rows(spark, [4, 3]).unionByName(rows(spark, [9], "q")), landing, "s", 1)
    assert ids_of(drain(2)) == ["p-3", "p-4"]
    L.write_landing(rows(spark, [4, 3, 5]).unionByName(rows(spark, [9], "q")), landing, "s", 1)     # the batch runs again, and differs
    L.write_landing(rows(spark, [7]), landing, "other", 0)
    L.write_landing(rows(spark, [6]), landing, "s", 2)
    assert ids_of(drain(3)) == ["p-6", "p-7"]
    assert ids_of(drain(4)) == []
    L.write_landing(rows(spark, [8]), landing, "s", 3)
    assert ids_of(drain(5)) == ["p-8"]
    assert ids_of(LS.drain(spark, landing, "q", f"{scratch}/cq", f"{scratch}/outq")) == ["q-9"]


@pytest.mark.parametrize("dies", ["write", "commit", "return"])
def test_a_drain_that_dies_is_repeated_whole(spark, scratch, monkeypatch, dies):
    landing, ckpt = f"{scratch}/l", f"{scratch}/c"
    L.write_landing(rows(spark, [0, 1]), landing, "s", 0)

    def dead(*a, **k):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as m:
        m.setattr(*{"write": (LS.L, "keyed_last_write"), "commit": (MF.PositionLog, "commit"), "return": (LS.L, "chronological")}[dies], dead)
        with pytest.raises(RuntimeError):
            LS.drain(spark, landing, "p", ckpt, f"{scratch}/out1")
    L.write_landing(rows(spark, [2]), landing, "s", 1)
    again = ids_of(LS.drain(spark, landing, "p", ckpt, f"{scratch}/out1"))
    later = ids_of(LS.drain(spark, landing, "p", ckpt, f"{scratch}/out2"))
    assert again[:2] == ["p-0", "p-1"] and again + later == ["p-0", "p-1", "p-2"]


def test_the_stream_commits_what_it_lands(spark, scratch):
    landing = f"{scratch}/l"
    reqs = S.event_requests(spark, "/root/testdata/sf0.001")
    out = LS.land_batch(reqs, 0, lambda: S.event_routes(spark), landing, f"{scratch}/r", f"{scratch}/cm", "s")
    found, _, _ = MF._committed(spark, landing)
    got = {r["producer"]: (r["rows"], r["min_us"], r["max_us"]) for r in found.collect()}
    us = F.unix_micros("ts")
    want = {r[0]: tuple(r[1:]) for r in L.read_landing(spark, landing).groupBy("producer").agg(F.count("*"), F.min(us), F.max(us)).collect()}
    assert got == want and sum(v[0] for v in got.values()) == out["landed"]
    assert out["rejected"] == G.rejected(G.gate(reqs, S.event_routes(spark), spark)).count()


def test_a_pull_reads_a_bounded_number_of_folders(spark, scratch):
    landing = f"{scratch}/l"
    for b in range(12):
        L.write_landing(rows(spark, [2 * b, 2 * b + 1]), landing, "s", b)
        if b % 4 == 3:
            assert MF.compact(spark, landing, "p", target_bytes=1 << 20) is not None
            assert len(MF.entries_of(spark, landing, "p").rows) <= 2      # a run and the last batch
            MF.fold(spark, landing)
            assert os.listdir(f"{landing}_manifest/entries") == []
    everything, position = MF.read_new(spark, landing, "p", {})
    assert sorted(ids_of(everything)) == sorted(f"p-{i}" for i in range(24)) and position == {"s": 11}
    assert len(everything.inputFiles()) <= 3
    some, _ = MF.read_new(spark, landing, "p", {"s": 5})                  # a position inside a run
    assert sorted(ids_of(some)) == sorted(f"p-{i}" for i in range(12, 24))
    late, _ = MF.read_new(spark, landing, "p", {}, after=dt.datetime(2024, 1, 1, 0, 20))
    assert sorted(ids_of(late)) == ["p-21", "p-22", "p-23"]
    assert L.read_landing(spark, landing).count() == 24                   # the slices stay for readers of the folder


def test_runs_are_sorted_and_split(spark, scratch):
    landing = f"{scratch}/l"
    for b in range(4):
        L.write_landing(rows(spark, range(100 * b, 100 * b + 100)), landing, "s", b)
    size = sum(e["bytes"] for e in MF.entries_of(spark, landing, "p").rows)
    assert MF.compact(spark, landing, "p", target_bytes=size // 3)
    run = next(e for e in MF.entries_of(spark, landing, "p").rows if e["stream"] is None)
    files = spark.read.parquet(run["path"]).groupBy(F.col("_metadata.file_path")).agg(F.min("ts").alias("a"), F.max("ts").alias("b")).orderBy("a").collect()
    assert len(files) >= 2 and all(x["b"] < y["a"] for x, y in zip(files, files[1:]))
    assert run["rows"] == 300


def test_a_crash_between_write_and_swap_loses_and_doubles_nothing(spark, scratch, monkeypatch):
    landing = f"{scratch}/l"
    for b in range(3):
        L.write_landing(rows(spark, [b]), landing, "s", b)

    def dead(*a, **k):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(MF.folders, "size_bytes", dead)                         # after the run is written, before its entry
        with pytest.raises(RuntimeError):
            MF.compact(spark, landing, "p")
    assert len(os.listdir(f"{landing}_compacted")) == 1
    assert sorted(ids_of(MF.read_new(spark, landing, "p", {})[0])) == ["p-0", "p-1", "p-2"]
    assert MF.compact(spark, landing, "p") is not None                    # and the next one does the work
    assert sorted(ids_of(MF.read_new(spark, landing, "p", {})[0])) == ["p-0", "p-1", "p-2"]


def test_one_compaction_at_a_time(spark, scratch, monkeypatch):
    landing = f"{scratch}/l"
    for b in range(3):
        L.write_landing(rows(spark, [b]), landing, "s", b)
    with monkeypatch.context() as m:
        m.setattr(MF.folders, "delete", lambda *a: None)                  # a compaction that never lets go of its mark
        MF.compact(spark, landing, "p")
    L.write_landing(rows(spark, [3]), landing, "s", 3)
    L.write_landing(rows(spark, [4]), landing, "s", 4)
    assert MF.compact(spark, landing, "p") is None
    assert MF.compact(spark, landing, "p", stale_seconds=0) is not None
    assert sorted(ids_of(MF.read_new(spark, landing, "p", {})[0])) == [f"p-{i}" for i in range(5)]


def test_nothing_landed(spark, scratch):
    landing = f"{scratch}/l"
    assert MF.read_new(spark, landing, "p", {})[0].count() == 0
    assert MF.compact(spark, landing, "p") is None
    L.write_landing(rows(spark, []), landing, "s", 0)
    assert MF.read_new(spark, landing, "p", {"s": 4}) [1] == {"s": 4}
