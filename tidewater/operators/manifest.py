"""The manifest of a landing table: which slices are committed, what they hold, and how far a reader has come.

Beside ``<landing>`` lie

* ``<landing>_manifest/entries/...``: a folder per commit with a row per producer: its slice, rows, bytes, the range of
  ``ts``.  A batch's entry is written after its slice, so a reader that starts from the manifest sees whole batches;
* ``<landing>_manifest/snapshots/n=<k>``: live entries folded into one table, so reading the manifest does not grow
  with the commits behind it (:func:`fold`);
* ``<landing>_compacted/run=<id>``: many small slices of one producer rewritten as sorted files (:func:`compact`).  The
  run's own entry names the entries it replaces, and writing that entry is the swap: before it the run is not seen,
  after it the slices are not.

The commit sequence of a stream is its batch ids, so a reader's position is the last batch it has read of each stream:
rows are new by when they were *landed*, whatever their ``ts``.  Compacted rows keep stream and batch id, so a position
reads the same from a run.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidewater.sources import folders

ENTRY_DDL = ("entry string, producer string, stream string, batch_id bigint, path string, rows bigint, bytes bigint, "
             "min_us bigint, max_us bigint, upto map<string,bigint>, replaces array<string>")
#: Slices and runs below this are rewritten together.
TARGET_BYTES = 256 * 1024 * 1024
#: A compaction that holds its producer's mark for longer is taken for dead.
STALE_SECONDS = 6 * 3600

Position = dict[str, int]


def _root(landing: str) -> str:
    return f"{landing.rstrip('/')}_manifest"


def slice_stats(spark: SparkSession, slice_folder: str) -> list[tuple]:
    """``(producer, rows, min_us, max_us)`` of a written slice, from its ``ts`` column alone."""
    from tidewater.operators.landing import LANDING_DDL
    us = F.unix_micros("ts")
    return [tuple(r) for r in spark.read.schema(LANDING_DDL).parquet(slice_folder).groupBy("producer").agg(
        F.count(F.lit(1)), F.min(us), F.max(us)).collect()]


def record_slice(spark: SparkSession, landing: str, slice_folder: str, stream: str, batch_id: int, stats: list[tuple] | None = None) -> None:
    """Commit a batch's slice: an entry per producer it holds (at most one per route), from ``stats`` or else from what
    was written.  Bytes are the slice's, shared out by rows.  A batch that runs again replaces its entries."""
    stats = slice_stats(spark, slice_folder) if stats is None else stats
    total, size = sum(s[1] for s in stats), folders.size_bytes(spark, slice_folder)
    entries = [(f"{stream}/{batch_id}/{producer}", producer, stream, batch_id, slice_folder, rows, size * rows // total, first, last,
                {stream: batch_id}, None) for producer, rows, first, last in stats]
    spark.createDataFrame(entries, ENTRY_DDL).coalesce(1).write.mode("overwrite").parquet(
        f"{_root(landing)}/entries/stream={stream}-batch={batch_id}")


def _snapshots(spark: SparkSession, landing: str) -> list[int]:
    at = f"{_root(landing)}/snapshots"
    return [int(n[2:]) for n in folders.names(spark, at) if n.startswith("n=") and folders.exists(spark, f"{at}/{n}/_SUCCESS")]


def _committed(spark: SparkSession, landing: str) -> tuple[DataFrame, int, list[str]]:
    """All entries (replaced ones too), the number of the snapshot used, and the commits beside it."""
    root = _root(landing)
    last = max(_snapshots(spark, landing), default=0)
    commits = [f"{root}/entries/{n}" for n in folders.names(spark, f"{root}/entries") if folders.exists(spark, f"{root}/entries/{n}/_SUCCESS")]
    paths = commits + ([f"{root}/snapshots/n={last}"] if last else [])
    if not paths:
        return spark.createDataFrame([], ENTRY_DDL), last, commits
    return spark.read.schema(ENTRY_DDL).parquet(*paths).dropDuplicates(["entry"]), last, commits


@dataclass
class Entries:
    """The live entries of one producer, and its last batch of each stream."""

    rows: list = field(default_factory=list)
    head: Position = field(default_factory=dict)

    def after(self, position: Position) -> list:
        """Entries with a row past ``position``."""
        return [e for e in self.rows if any(b > position.get(s, -1) for s, b in e["upto"].items())]


def entries_of(spark: SparkSession, landing: str, producer: str) -> Entries:
    """The producer's live entries: as many as it has slices that are not compacted yet, and runs."""
    while True:
        found, snapshot, _ = _committed(spark, landing)
        try:
            rows = [r.asDict() for r in found.where(F.col("producer") == producer).collect()]
        except Exception:
            if max(_snapshots(spark, landing), default=0) == snapshot:
                raise
            continue                                        # folded meanwhile: the commits are in the new snapshot
        if max(_snapshots(spark, landing), default=0) == snapshot:
            break
    gone = {e for r in rows for e in r["replaces"] or ()}
    head: Position = {}
    for r in rows:
        for s, b in r["upto"].items():
            head[s] = max(b, head.get(s, -1))
    return Entries(sorted((r for r in rows if r["entry"] not in gone), key=lambda r: r["entry"]), head)


def past(position: Position) -> Column:
    """Rows that landed after ``position``, from their stream and batch id alone (partition columns of the slices)."""
    if not position:
        return F.lit(True)
    seen = F.create_map(*[x for s, b in sorted(position.items()) for x in (F.lit(s), F.lit(b).cast("bigint"))])
    return F.col("batch_id") > F.coalesce(F.try_element_at(seen, F.col("stream")), F.lit(-1))


def read_entries(spark: SparkSession, landing: str, producer: str, entries: list) -> DataFrame:
    """The producer's rows in ``entries``, from their folders alone."""
    from tidewater.operators.landing import LANDING_DDL
    slices = sorted({e["path"] for e in entries if e["stream"] is not None})
    runs = sorted({e["path"] for e in entries if e["stream"] is None})
    parts = []
    if slices:
        parts.append(spark.read.schema(LANDING_DDL).option("basePath", landing.rstrip("/")).parquet(*slices))
    if runs:
        parts.append(spark.read.schema(LANDING_DDL).parquet(*runs))
    if not parts:
        return spark.createDataFrame([], LANDING_DDL)
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.where(F.col("producer") == producer)


def read_new(spark: SparkSession, landing: str, producer: str, position: Position, after=None) -> tuple[DataFrame, Position]:
    """What landed for ``producer`` after ``position``, and the position after it.  ``after`` (a datetime, UTC) also drops
    rows that are not later, and whole entries by their range of ``ts``."""
    from tidewater.operators.landing import utc_literal, utc_micros
    found = entries_of(spark, landing, producer)
    entries = found.after(position)
    if after is not None:
        entries = [e for e in entries if e["max_us"] > utc_micros(after)]
    rows = read_entries(spark, landing, producer, entries).where(past(position))
    if after is not None:
        rows = rows.where(F.col("ts") > utc_literal(after))
    return rows, {**position, **found.head}


def compact(spark: SparkSession, landing: str, producer: str, target_bytes: int = TARGET_BYTES, least: int = 2,
            stale_seconds: float = STALE_SECONDS) -> str | None:
    """Rewrite a producer's small slices and runs into files sorted by ``ts`` and swap the manifest's entries; the new
    entry's name, or None where there is nothing to gain or another compaction of the producer is at work.

    The last batch of a stream is left alone: it may run again.  A compaction that dies before the swap leaves a run
    that no entry names; one that dies after it has done its work.
    """
    mark = f"{_root(landing)}/compacting/{uuid.uuid5(uuid.NAMESPACE_URL, producer).hex}"
    if not folders.claim(spark, mark):
        if folders.age_seconds(spark, mark) < stale_seconds:
            return None
        folders.delete(spark, mark)
        if not folders.claim(spark, mark):
            return None
    try:
        found = entries_of(spark, landing, producer)
        small = [e for e in found.rows if e["bytes"] < target_bytes and (e["stream"] is None or e["batch_id"] < found.head[e["stream"]])]
        if len(small) < least:
            return None
        run = f"run-{uuid.uuid4().hex}"
        path = f"{landing.rstrip('/')}_compacted/{run}"
        files = max(1, round(sum(e["bytes"] for e in small) / target_bytes))
        rows = read_entries(spark, landing, producer, small)
        (rows.repartitionByRange(files, "ts", "id") if files > 1 else rows.coalesce(1)).sortWithinPartitions("ts", "id").write.parquet(path)
        upto: Position = {}
        for e in small:
            for s, b in e["upto"].items():
                upto[s] = max(b, upto.get(s, -1))
        entry = (run, producer, None, None, path, sum(e["rows"] for e in small), folders.size_bytes(spark, path), min(e["min_us"] for e in small),
                 max(e["max_us"] for e in small), upto, [e["entry"] for e in small])
        spark.createDataFrame([entry], ENTRY_DDL).coalesce(1).write.parquet(f"{_root(landing)}/entries/{run}")
        return run
    finally:
        folders.delete(spark, mark)


def fold(spark: SparkSession, landing: str) -> int:
    """Fold the commits into a new snapshot and drop them; returns its number.  One fold at a time (the caller's schedule);
    readers go on meanwhile."""
    found, last, commits = _committed(spark, landing)
    gone = found.select(F.explode("replaces").alias("entry")).distinct()
    live = found.join(gone, "entry", "left_anti")
    # of a replaced entry only its place in the streams' order is still needed: the run that replaced it says that too
    live.withColumn("replaces", F.lit(None).cast("array<string>")).select(*[c.split()[0] for c in ENTRY_DDL.split(", ")]) \
        .write.parquet(f"{_root(landing)}/snapshots/n={last + 1}")
    for path in commits:
        folders.delete(spark, path)
    for n in _snapshots(spark, landing):
        if n < last:                                        # the one before stays for readers that have just opened it
            folders.delete(spark, f"{_root(landing)}/snapshots/n={n}")
    return last + 1


POSITION_DDL = "position map<string,bigint>, note string"


class PositionLog:
    """How far a reader has come, kept in a folder of its own: ``n=1, n=2, ...``, the last complete one counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder.rstrip("/")

    def _numbers(self) -> list[int]:
        return sorted(int(n[2:]) for n in folders.names(self._spark, self._folder)
                      if n.startswith("n=") and folders.exists(self._spark, f"{self._folder}/{n}/_SUCCESS"))

    def last(self) -> tuple[Position, str | None]:
        """The position and the note written with it."""
        numbers = self._numbers()
        if not numbers:
            return {}, None
        try:
            row = self._spark.read.schema(POSITION_DDL).parquet(f"{self._folder}/n={numbers[-1]}").first()
        except AnalysisException:
            return {}, None
        return dict(row["position"]), row["note"]

    def commit(self, position: Position, note: str | None = None) -> None:
        numbers = self._numbers()
        n = (numbers[-1] if numbers else 0) + 1
        self._spark.createDataFrame([(position, note)], POSITION_DDL).coalesce(1).write.mode("overwrite").parquet(f"{self._folder}/n={n}")
        for old in numbers[:-1]:
            folders.delete(self._spark, f"{self._folder}/n={old}")
