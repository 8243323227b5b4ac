"""Helpers shared by the training-data operators: table reads, the shared scratch folder,
cut lineage, and vectorised 64-bit hashing."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import checkpoint_dir

#: The white space that the text contracts name: space and the controls 9 to 13.
ASCII_SPACE = " \t\n\x0b\x0c\r"

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared ``spark.checkpoint.dir``; never a machine-local one on a cluster."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and no lineage behind it
    that a lost executor would make Spark repeat."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows of ``df``, those whose ``key`` has the smallest hashes.

    A hash threshold comes first, so that tasks hand on about ``4 * rows`` rows in all however many there
    are; it lies far enough above the share wanted to leave ``rows`` of them."""
    n = df.count()
    if n > 4 * rows:
        df = df.where(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 40)) < int((1 << 40) * 4 * rows / n))
    return df.orderBy(F.xxhash64(key), key).limit(rows)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, unless they find it as the driver does
    (from PYTHONPATH, or from the working folder of a local session)."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parents[2]
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in paths or (sc.master.startswith("local[") and Path.cwd().resolve() == root) or getattr(sc, "_tidewater_sent", False):
        return
    target = Path(tempfile.mkdtemp()) / "tidewater.zip"            # read by the driver's own file server
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((root / "tidewater").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(target))
    sc._tidewater_sent = True


def release_memory() -> None:
    """Give memory that this worker has freed back to the system, which allocators keep otherwise: two
    workers share an executor's overhead with its JVM."""
    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):        # only glibc has it
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser over a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def ascii_lower(column):
    """A-Z lower-cased and nothing else, whatever the locale."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_LOWER = {i: i + 32 for i in range(65, 91)}


def py_ascii_lower(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LOWER)


class Memo(dict):
    """A dictionary that computes what it lacks.  It holds two generations of at most ``limit``
    entries: when the young one is full it becomes the old one, and what is asked for again moves
    back.  A worker's memory stays bounded on any vocabulary and frequent keys stay at hand."""

    def __init__(self, make, limit: int):
        super().__init__()
        self._make, self._limit, self._old = make, limit, {}

    def __missing__(self, key):
        out = self._old.get(key)
        if out is None:
            out = self._make(key)
        if len(self) >= self._limit:
            self._old = dict(self)
            self.clear()
        self[key] = out
        return out
