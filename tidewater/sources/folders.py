"""Folders of any store Spark reaches, through Hadoop's file systems: what exists, and marks that only one job can set."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none where there is no folder."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def size_bytes(spark: SparkSession, path: str) -> int:
    """Bytes below a folder."""
    fs, p = _at(spark, path)
    return fs.getContentSummary(p).getLength()


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def claim(spark: SparkSession, path: str) -> bool:
    """Set a mark; False where it is set already."""
    fs, p = _at(spark, path)
    fs.mkdirs(p.getParent())
    return fs.createNewFile(p)


def age_seconds(spark: SparkSession, path: str) -> float:
    fs, p = _at(spark, path)
    now = spark.sparkContext._jvm.java.lang.System.currentTimeMillis()
    return (now - fs.getFileStatus(p).getModificationTime()) / 1000
