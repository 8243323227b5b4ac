"""Line deduplication with two Bloom filters.

Pass 1 hashes every line key into a pair of bitmaps, *once* and *twice*, which merge like
saturating counters: ``once = a | b`` and ``twice = a2 | b2 | (a & b)``.  Partitions send
compressed segments; a tree of bounded groups merges them.  Pass 2 sends on only keys whose every
bit is seen twice (a true repeat always is); their documents are counted exactly, and the largest
document id keeps the line.  Pass 3 rewrites the texts.

The filter has ``bits_per_row`` bits a document, ``max_bits`` at most, which bounds what the driver
holds and broadcasts.  A fuller filter only lets more keys through to the exact count.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import ASCII_SPACE, mix64, py_ascii_lower, release_memory, written

MIN_CHARS = 20
MIN_DOCS = 3
BITS_PER_ROW = 128
MAX_BITS = 1 << 28
_SEGMENT_BITS = 1 << 18
_FAN_IN = 64
_SALTS = 32


def line_key(line: str) -> str:
    return py_ascii_lower(line.strip(ASCII_SPACE))


def _digests(text: str | None, min_chars: int) -> list[bytes | None]:
    """A 128-bit digest for each line's key, None for keys that are too short."""
    out = []
    for line in (text or "").split("\n"):
        key = line_key(line)
        out.append(xxhash.xxh3_128_digest(key.encode("utf-8")) if len(key) >= min_chars else None)
    return out


def _positions(digests: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two bit positions of each digest (an n x 2 uint64 array)."""
    mask = np.uint64(bits - 1)
    return [mix64(digests[:, 0]) & mask, mix64(digests[:, 1]) & mask]


def _as_words(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), dtype=np.uint64).reshape(-1, 2)


class _Marks:
    """The two bitmaps of one partition, by position."""

    def __init__(self, bits: int):
        self.once = np.zeros(bits // 8, np.uint8)
        self.twice = np.zeros(bits // 8, np.uint8)

    def add(self, positions: np.ndarray) -> None:
        at, n = np.unique(positions, return_counts=True)
        byte, bit = (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.int64)).astype(np.uint8)
        again = (n > 1) | ((self.once[byte] & bit) != 0)
        np.bitwise_or.at(self.once, byte, bit)
        np.bitwise_or.at(self.twice, byte[again], bit[again])


def _is_set(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _twice_filter(docs: DataFrame, bits: int, min_chars: int) -> np.ndarray:
    """The merged *twice* bitmap over all rows of ``docs`` (``_id``, ``_text``)."""
    segment = min(_SEGMENT_BITS, bits) // 8

    def mark(batches):
        marks = _Marks(bits)
        for b in batches:
            keys = [k for t in b["_text"] for k in {*_digests(t, min_chars)} if k is not None]
            if keys:
                words = _as_words(keys)
                for at in _positions(words, bits):
                    marks.add(at)
            del keys
            release_memory()
        rows = []
        for s in range(0, bits // 8, segment):
            once = marks.once[s:s + segment]
            if once.any():
                rows.append([s // segment, zlib.compress(once.tobytes(), 1), zlib.compress(marks.twice[s:s + segment].tobytes(), 1)])
        yield pd.DataFrame(rows, columns=["segment", "once", "twice"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        once = np.zeros(segment, np.uint8)
        twice = np.zeros(segment, np.uint8)
        for o, t in zip(group["once"], group["twice"]):
            o, t = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, t))
            twice |= t | (once & o)
            once |= o
        return pd.DataFrame([[int(group["segment"].iloc[0]), int(group["source"].iloc[0]), zlib.compress(once.tobytes(), 1),
                              zlib.compress(twice.tobytes(), 1)]], columns=["segment", "source", "once", "twice"])

    marked = written(docs.select("_text").mapInPandas(mark, "segment int, once binary, twice binary")
                     .withColumn("source", F.spark_partition_id()), "line-marks")
    sources = (marked.agg(F.max("source")).first()[0] or 0) + 1
    while sources > 1:
        sources = -(-sources // _FAN_IN)
        marked = marked.withColumn("source", F.expr(f"CAST(source / {_FAN_IN} AS INT)")) \
            .groupBy("segment", "source").applyInPandas(merge, "segment int, source int, once binary, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in marked.select("segment", "twice").toLocalIterator():
        out[row.segment * segment:(row.segment + 1) * segment] = np.frombuffer(zlib.decompress(row.twice), np.uint8)
    return out


def filter_bits(rows: int, bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS) -> int:
    return min(max_bits, 1 << max(13, (rows * bits_per_row - 1).bit_length()))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                   min_docs: int = MIN_DOCS, bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS) -> DataFrame:
    """``_id, keys``: for each document the digests of the line keys that it loses.  Documents that
    lose none have no row.  Rows that share an id are one document; rows without id take no part."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_id IS NOT NULL")
    bits = filter_bits(rows.count(), bits_per_row, max_bits)
    seen_twice = spark.sparkContext.broadcast(_twice_filter(rows, bits, min_chars).tobytes())

    def suspects(batches):
        bitmap = np.frombuffer(seen_twice.value, np.uint8)
        for b in batches:
            ids, keys = [], []
            for i, t in zip(b["_id"].tolist(), b["_text"]):
                own = {*_digests(t, min_chars)} - {None}
                ids += [i] * len(own)
                keys += own
            if keys:
                words = _as_words(keys)
                first, second = _positions(words, bits)
                hit = _is_set(bitmap, first) & _is_set(bitmap, second)
                signed = words[hit].view(np.int64)
                yield pd.DataFrame({"_id": np.array(ids, np.int64)[hit], "_k1": signed[:, 0], "_k2": signed[:, 1]})

    found = written(rows.mapInPandas(suspects, "_id bigint, _k1 bigint, _k2 bigint"), "line-suspects")
    confirmed = found.groupBy("_k1", "_k2").agg(F.countDistinct("_id").alias("_n"), F.max("_id").alias("_keeper")) \
        .where(F.col("_n") >= min_docs)
    # a line may be in a third of all documents: deal its rows out over salts
    lost = found.withColumn("_salt", F.expr(f"CAST(pmod(xxhash64(_id), {_SALTS}) AS INT)")).join(
        confirmed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))), ["_k1", "_k2", "_salt"]) \
        .where("_id < _keeper")
    return lost.groupBy("_id").agg(F.collect_set(F.struct("_k1", "_k2")).alias("keys"))


def _without(text: str | None, keys, min_chars: int) -> tuple[str, int, int]:
    """(text without the lines under ``keys``, lines before, lines dropped)."""
    text = text or ""
    lines = text.split("\n")
    if keys is None or not len(keys):
        return text, len(lines), 0
    drop = {np.array([k["_k1"], k["_k2"]], np.int64).tobytes() for k in keys}
    kept = [x for x, d in zip(lines, _digests(text, min_chars)) if d is None or d not in drop]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def rewrite_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, **settings) -> DataFrame:
    """``docs`` with the repeated lines gone from ``text_col``; every other column as it is."""
    lost = repeated_lines(docs, id_col, text_col, min_chars, **settings) \
        .select(F.col("_id").alias("__lost_id"), F.col("keys").alias("__lost_keys"))

    @F.pandas_udf("string")
    def rewrite(text: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([t if k is None else _without(t, k, min_chars)[0] for t, k in zip(text, keys)], dtype=object)

    joined = docs.join(lost, F.col(id_col).cast("bigint") == F.col("__lost_id"), "left")
    return joined.withColumn(text_col, rewrite(F.col(text_col), F.col("__lost_keys"))).select(docs.columns)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                        min_docs: int = MIN_DOCS, bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS) -> DataFrame:
    """``id_col, n_lines, n_dropped, kept``: every document without the lines whose key (stripped,
    A-Z lower-cased, at least ``min_chars`` code points) is in at least ``min_docs`` documents,
    except in the largest id holding it.

    Null and empty texts are one empty line; rows without id keep all lines; repeated rows are one
    document and give a row each; an empty table gives no rows; other columns are not looked at.
    """
    lost = repeated_lines(docs, id_col, text_col, min_chars, min_docs, bits_per_row, max_bits)
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def rewrite(batches):
        for b in batches:
            out = []
            for i, text, keys in zip(b["_id"].tolist(), b["_text"], b["keys"]):
                kept, lines, gone = _without(text, keys, min_chars)
                out.append([None if i is None or i != i else int(i), lines, gone, kept])
            frame = pd.DataFrame(out, columns=[id_col, "n_lines", "n_dropped", "kept"])
            yield frame.astype({id_col: "Int64"})

    return rows.join(lost, "_id", "left").mapInPandas(rewrite, f"{id_col} bigint, n_lines bigint, n_dropped bigint, kept string")
