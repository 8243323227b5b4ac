"""Removal of long substrings that an earlier document holds, by run-length indexes.

A byte goes if a ``length``-byte string that covers it also starts in a document of a smaller id.

* *Anchors.*  Of the ``ANCHOR``-byte strings inside each window of ``length`` bytes the one with the
  smallest hash is its anchor, so equal windows have equal anchors wherever they lie.  Neighbouring
  windows mostly share theirs; together they form a *context* of at most ``2 * length - ANCHOR`` bytes.
* Pass 1 finds the anchors that lie in two documents or more: each chunk of documents sends its distinct
  anchors, a few bytes each, to buckets; the answer is a bitmap of bounded size (a full one only lets
  more contexts through).
* Pass 2 sends the distinct contexts of such anchors, once a chunk, to the buckets.  A bucket gives
  each context its smallest document.  Contexts of one anchor that differ in part are put, in pieces of
  bounded size, into a run-length index (``RunIndex``), and the matching statistics streamed from it say
  which of a context's windows lie in another context of a smaller document.
* Answers go back to the chunks, which turn them into spans; a last pass cuts the spans out of the texts.

* *Hot anchors*, with more than ``HOT_CONTEXTS`` contexts over all chunks (a phrase of 24 bytes or the
  edge of a passage, among other words in each document), are split: each of their windows is a context
  of its own under the window's hash, so equal windows still meet while the anchor's spread over all buckets.

So a group is bounded: what all documents share comes once from each chunk, an anchor brings at most
``HOT_CONTEXTS`` contexts, a window one from each chunk, and more input means more buckets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import mix64, release_memory, written
from tidewater.llm.run_index import RunIndex

LENGTH = 50
ANCHOR = 24
CHUNK_BYTES = 6 << 20
ROWS_PER_BUCKET = 1024
BUCKET_BITS = 1 << 19
MIN_BUCKETS = 64
MAX_BITS = 1 << 30
INDEX_BYTES = 1 << 18
HOT_CONTEXTS = 1 << 12
_PIECE = 1 << 18                       # bytes hashed at a time
_LOW = np.uint64(0xFFFFFF)             # room for a position in a piece
_GONE = np.uint32(0xFFFFFFFF)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_PIECE + 4 * LENGTH, n)
    if size not in _POWERS:
        _POWERS[size] = (_powers(int(_BASE), size + 1), _powers(pow(int(_BASE), -1, 2 ** 64), size + 1))
    return _POWERS[size]


_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def anchors(data: np.ndarray, windows: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """(first window, number of windows, anchor hash, context hash) of each context of ``data``, where
    ``windows`` are the sorted positions at which a window may begin."""
    n = len(data)
    powers, inverse = _power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[:n], out=sums[1:])
    hashes = mix64((sums[anchor:] - sums[:-anchor]) * inverse[:n - anchor + 1])
    least = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
    want, size = length - anchor + 1, 1
    while 2 * size <= want:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < want:
        least = np.minimum(least[:len(least) - (want - size)], least[want - size:])
    at = (least[windows] & _LOW).astype(np.int64)
    new = np.ones(len(windows), bool)
    new[1:] = (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(new)
    begin = windows[first]
    count = np.diff(np.append(first, len(windows)))
    context = mix64((sums[begin + count - 1 + length] - sums[begin]) * inverse[begin] + count.astype(np.uint64))
    # an anchor is the smallest of many hashes, so its top bits are mostly zero: mixed once more, buckets and bitmaps fill evenly
    return begin, count, mix64(hashes[at[first]] ^ _SPREAD), context


def _pieces(ids: np.ndarray, texts: list[bytes], length: int):
    """Documents in pieces of bounded size: (data, windows, document number and its offset by window)."""
    part: list[bytes] = []
    starts, numbers, offsets = [], [], []
    size = 0

    def close():
        begin = [np.arange(a, a + k) for a, k in starts]
        counts = np.array([k for _, k in starts])
        return (np.frombuffer(b"".join(part), np.uint8), np.concatenate(begin), np.repeat(np.array(numbers), counts),
                np.repeat(np.array(offsets) - np.array([a for a, _ in starts]), counts))

    for number, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, _PIECE):
            data = text[at:at + _PIECE + length - 1]
            if size and size + len(data) > _PIECE:
                yield close()
                part, starts, numbers, offsets, size = [], [], [], [], 0
            part.append(data)
            starts.append((size, len(data) - length + 1))
            numbers.append(number)
            offsets.append(at)
            size += len(data)
    if size:
        yield close()


def _chunks(batches: Iterator[pa.RecordBatch]):
    """Batches put together to chunks of about CHUNK_BYTES: (ids, text hashes, texts as UTF-8 bytes)."""
    ids, marks, texts, size = [], [], [], 0
    for b in batches:
        raw = b.column("_text").cast(pa.binary())
        for k, (i, m) in enumerate(zip(b.column("_id").to_pylist(), b.column("_mark").to_pylist())):
            texts.append(raw[k].as_py())
            ids.append(i)
            marks.append(m)
            size += len(texts[-1])
            if size >= CHUNK_BYTES:
                yield np.array(ids, np.int64), np.array(marks, np.int64), texts
                ids, marks, texts, size = [], [], [], 0
                release_memory()
    if ids:
        yield np.array(ids, np.int64), np.array(marks, np.int64), texts


def _rows(rows: list[tuple], **columns) -> pa.RecordBatch:
    """A batch of ``rows`` with the named columns of the given Arrow types."""
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), columns.values())], names=list(columns))


def _short(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, the next 32 bits) of anchor hashes."""
    top = np.uint64(buckets.bit_length() - 1)
    bucket = (hashes >> (np.uint64(64) - top)).astype(np.int64)
    return bucket, ((hashes >> (np.uint64(32) - top)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _keys(bucket: np.ndarray, short: np.ndarray) -> np.ndarray:
    return bucket.astype(np.uint64) << np.uint64(32) | short


def _repeated_anchors(rows: DataFrame, buckets: int, bits: int, length: int, hot_contexts: int) -> tuple[bytes, bytes]:
    """A bitmap, ``bits`` a bucket, over anchors that lie in two documents or more, and the sorted keys
    of those with more than ``hot_contexts`` contexts, counted once a chunk."""
    def distinct(ids, texts):
        found, many, pairs = [], [], []
        for data, windows, number, _ in _pieces(ids, texts, length):
            begin, _, hashes, context = anchors(data, windows, length)
            owner = number[np.searchsorted(windows, begin)]
            order = np.lexsort((owner, hashes))
            h, o = hashes[order], owner[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            many.append(h[1:][~new[1:] & (o[1:] != o[:-1])])
            found.append(h[new])
            pairs.append((hashes, context))
        if not found:
            return None
        # contexts beyond an anchor's first, each once
        hashes, context = (np.concatenate(x) for x in zip(*pairs))
        order = np.lexsort((context, hashes))
        hashes, context = hashes[order], context[order]
        more, weight = np.unique(hashes[1:][(hashes[1:] == hashes[:-1]) & (context[1:] != context[:-1])], return_counts=True)
        del pairs, hashes, context, order
        h, n = np.unique(np.concatenate(found), return_counts=True)
        twice = np.unique(np.concatenate([h[n > 1], *many]))
        bucket, short = _short(h, buckets)
        bucket2, short2 = _short(twice, buckets)
        bucket3, short3 = _short(more, buckets)
        weight = weight.astype(np.uint32)
        cut, cut2, cut3 = (np.searchsorted(b, np.arange(buckets + 1)) for b in (bucket, bucket2, bucket3))
        return _rows([(k, short[cut[k]:cut[k + 1]].tobytes(), short2[cut2[k]:cut2[k + 1]].tobytes(),
                       short3[cut3[k]:cut3[k + 1]].tobytes(), weight[cut3[k]:cut3[k + 1]].tobytes())
                      for k in range(buckets) if cut[k] < cut[k + 1]],
                     bucket=pa.int32(), seen=pa.binary(), twice=pa.binary(), more=pa.binary(), weight=pa.binary())

    def collect(batches):
        for ids, _, texts in _chunks(batches):
            out = distinct(ids, texts)
            if out is not None:
                yield out
            del ids, texts, out
        release_memory()

    def decide(group: pd.DataFrame) -> pd.DataFrame:
        seen = np.concatenate([np.frombuffer(x, np.uint32) for x in group["seen"]])
        seen.sort()
        repeated = np.concatenate([seen[1:][seen[1:] == seen[:-1]], *[np.frombuffer(x, np.uint32) for x in group["twice"]]])
        flags = np.zeros(bits, np.uint8)
        flags[repeated >> np.uint32(33 - bits.bit_length())] = 1
        # contexts of an anchor: one for each chunk, and those beyond the first in a chunk
        edge = np.flatnonzero(np.append(True, seen[1:] != seen[:-1]))
        names, load = seen[edge], np.diff(np.append(edge, len(seen)))
        more, weight = (np.concatenate([np.frombuffer(x, np.uint32) for x in group[c]]) for c in ("more", "weight"))
        np.add.at(load, np.searchsorted(names, more), weight)
        return pd.DataFrame([(int(group["bucket"].iloc[0]), zlib.compress(np.packbits(flags).tobytes(), 1),
                              names[load > hot_contexts].tobytes())], columns=["bucket", "bits", "hot"])

    found = rows.mapInArrow(collect, "bucket int, seen binary, twice binary, more binary, weight binary").groupBy("bucket") \
        .applyInPandas(decide, "bucket int, bits binary, hot binary")
    out, hot = np.zeros((buckets, bits // 8), np.uint8), [np.zeros(0, np.uint64)]
    for r in found.toLocalIterator():                            # MAX_BITS in all, whatever the input
        out[r.bucket] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
        short = np.frombuffer(r.hot, np.uint32)                  # one for every HOT_CONTEXTS contexts at most
        hot.append(_keys(np.full(len(short), r.bucket), short))
    return out.tobytes(), np.sort(np.concatenate(hot)).tobytes()


def _single_windows(data: np.ndarray, begin: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of each window of the given contexts."""
    at = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    powers = _power_tables(len(data))[0]
    out = np.zeros(len(at), np.uint64)
    for j in range(length):
        out += _BYTE[data[at + j]] * powers[j]
    return at, mix64(out)


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[a.nbytes for a in arrays]], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=6).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, np.int64, int(np.frombuffer(raw, np.int64, 1)[0]), 8)
    at = 8 + sizes.nbytes + np.concatenate([[0], np.cumsum(sizes)])
    return [np.frombuffer(raw, k, int(s) // np.dtype(k).itemsize, int(a)) for k, s, a in zip(kinds, sizes, at)]


_MESSAGE = "bucket int, chunk string, blob binary"


def _contexts(rows: DataFrame, repeated, buckets: int, bits: int, length: int, split=None) -> DataFrame:
    """``bucket, chunk, blob``: for each chunk and bucket its distinct contexts under repeated anchors, and
    under a bucket below 0 where in the chunk's documents they lie.  Anchors in ``split`` go window by window."""
    def messages(bitmap, hot, ids, marks, texts, part_id, serial):
        parts = []
        for data, windows, number, shift in _pieces(ids, texts, length):
            begin, count, hashes, context = anchors(data, windows, length)
            bucket, short = _short(hashes, buckets)
            place = bucket * bits + (short >> np.uint32(33 - bits.bit_length())).astype(np.int64)
            hit = np.flatnonzero((bitmap[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1)
            if len(hot):
                big = np.isin(_keys(bucket[hit], short[hit]), hot)
                at, own = _single_windows(data, begin[hit[big]], count[hit[big]], length)
                w = np.searchsorted(windows, at)
                parts.append((number[w], at + shift[w], np.full(len(at), length), own, own))
                hit = hit[~big]
            begin, w = begin[hit], np.searchsorted(windows, begin[hit])
            size = count[hit] + length - 1
            parts.append((number[w], begin + shift[w], size, hashes[hit], context[hit]))
        if not parts:
            return None
        number, offset, size, hashes, context = (np.concatenate(x) for x in zip(*parts))
        if not len(number):
            return None
        # distinct contexts in order of anchor, the document of smallest id first
        order = np.lexsort((ids[number], context, hashes))
        new = np.ones(len(order), bool)
        new[1:] = (context[order][1:] != context[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
        one = order[new]
        local = np.empty(len(order), np.uint32)
        local[order] = np.cumsum(new) - 1
        bucket, short = _short(hashes[one], buckets)
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        # the same on a second attempt at this task, so that answers and places still meet
        digest = xxhash.xxh3_64_hexdigest(ids.tobytes() + marks.tobytes())
        chunk = f"{digest}-{part_id}-{serial}"
        out = []
        for k in np.flatnonzero(np.diff(cut)).tolist():
            some = one[cut[k]:cut[k + 1]]
            text = b"".join([texts[d][a:a + n] for d, a, n in zip(number[some].tolist(), offset[some].tolist(), size[some].tolist())])
            out.append((k, chunk, _pack(short[cut[k]:cut[k + 1]], ids[number[some]], size[some].astype(np.uint8),
                                        np.frombuffer(text, np.uint8))))
        out.append((-1 - int(digest[:6], 16), chunk, _pack(ids, marks, number.astype(np.uint32), offset.astype(np.int64),
                                                          size.astype(np.uint8), local)))
        return _rows(out, bucket=pa.int32(), chunk=pa.string(), blob=pa.binary())

    def run(batches):
        bitmap = np.frombuffer(repeated.value, np.uint8)
        hot = np.frombuffer(split.value if split else b"", np.uint64)
        task = TaskContext.get()
        part_id = task.partitionId() if task else 0
        for serial, (ids, marks, texts) in enumerate(_chunks(batches)):
            out = messages(bitmap, hot, ids, marks, texts, part_id, serial)
            if out is not None:
                yield out
            del ids, marks, texts, out
        release_memory()

    return rows.mapInArrow(run, _MESSAGE)


def _masks(hashes: np.ndarray, owner: np.ndarray, size: np.ndarray, begin: np.ndarray, text: np.ndarray, length: int) -> np.ndarray:
    """For distinct contexts, sorted by anchor: bits of the windows that lie in a context of a smaller
    owner.  Contexts alone under their anchor have nothing to be matched with."""
    out = np.zeros(len(hashes), np.uint32)
    edge = np.ones(len(hashes) + 1, bool)
    edge[1:-1] = hashes[1:] != hashes[:-1]
    alone = edge[:-1] & edge[1:]
    rest = np.flatnonzero(~alone)
    if not len(rest):
        return out
    group = np.cumsum(edge[:-1])[rest]
    # whole anchors, INDEX_BYTES of contexts at a time
    piece = np.cumsum(size[rest]) // INDEX_BYTES
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    piece = np.repeat(piece[first], np.diff(np.append(first, len(rest))))
    for part in np.split(rest, np.flatnonzero(np.diff(piece)) + 1):
        n = size[part]
        at = np.repeat(begin[part] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        index = RunIndex(text[at], np.concatenate([[0], np.cumsum(n)[:-1]]), owner[part], length)
        out[part] = index.matches().astype(np.uint32)
    return out


def _answers(length: int):
    """Per bucket: for each chunk's contexts, whether a smaller document holds all of it or which windows.
    The chunks' own notes of where their contexts lie pass through to the next shuffle."""
    def decide(group: pd.DataFrame) -> pd.DataFrame:
        if group["bucket"].iloc[0] < 0:
            return group
        release_memory()
        parts = [_unpack(x, np.uint32, np.int64, np.uint8, np.uint8) for x in group["blob"]]
        short, owner, size, text = (np.concatenate(x) for x in zip(*parts))
        size = size.astype(np.int64)
        end = np.cumsum(size)
        begin = end - size
        view = memoryview(text)
        context = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(begin.tolist(), end.tolist())), np.uint64, len(size))
        order = np.lexsort((owner, context, short))
        new = np.ones(len(order), bool)
        new[1:] = (context[order][1:] != context[order][:-1]) | (short[order][1:] != short[order][:-1])
        one = order[new]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        masks = _masks(short[one], owner[one], size[one], begin[one], text, length)
        code = np.where(owner[one][which] < owner, _GONE, masks[which])
        cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
        return pd.DataFrame({"bucket": group["bucket"].tolist(), "chunk": group["chunk"].tolist(),
                             "blob": [_pack(c) for c in np.split(code.astype(np.uint32), cuts)]})

    return decide


def _spans(length: int):
    """Per chunk: where its contexts lie, and the answers, to merged spans of each document."""
    def merge(group: pd.DataFrame) -> pd.DataFrame:
        release_memory()
        group = group.sort_values("bucket")                       # the places, then the answers in order of bucket
        ids, marks, number, offset, size, local = _unpack(group["blob"].iloc[0], np.int64, np.int64, np.uint32, np.int64, np.uint8, np.uint32)
        code = np.concatenate([_unpack(x, np.uint32)[0] for x in group["blob"].iloc[1:]])
        size = size.astype(np.int64)
        smallest = np.full(len(code), np.iinfo(np.int64).max)
        np.minimum.at(smallest, local, ids[number])
        whole = (code[local] == _GONE) | (ids[number] > smallest[local])
        parts = [(number[whole], offset[whole], offset[whole] + size[whole])]
        some = np.flatnonzero(~whole & (code[local] != 0))
        for w in range(int(size[some].max()) - length + 1 if len(some) else 0):
            hit = some[(code[local[some]] >> np.uint32(w)) & 1 == 1]
            parts.append((number[hit], offset[hit] + w, offset[hit] + w + length))
        n, a, b = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((a, n))
        n, a, b = n[order].astype(np.int64), a[order], b[order]
        rows = []
        if len(n):
            step = int(b.max()) + 1                               # one axis for all documents
            reach = np.maximum.accumulate(b + n * step)
            new = np.ones(len(n), bool)
            new[1:] = a[1:] + n[1:] * step > reach[:-1]
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(n)) - 1
            docs, begin, end = n[first], a[first], reach[last] - n[last] * step
            for g in np.split(np.arange(len(docs)), np.flatnonzero(np.diff(docs)) + 1):
                d = docs[g[0]]
                rows.append((int(ids[d]), int(marks[d]), np.stack([begin[g], end[g]], axis=1).ravel().tolist()))
        return pd.DataFrame(rows, columns=["_id", "_mark", "_spans"])

    return merge


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """``_id, _mark, _spans``: for each document (id and text hash) that loses bytes the begins and ends, in
    turn, of its maximal spans.  ``docs`` has ``_id`` (not null), ``_mark`` (hash of the text) and ``_text``."""
    if not ANCHOR < length <= 56:
        raise ValueError("length must be above 24 and at most 56: a context's windows are held in 32 bits")
    spark = docs.sparkSession
    n = docs.count()
    buckets = max(MIN_BUCKETS, 1 << max(0, (n // ROWS_PER_BUCKET).bit_length()))
    bits = min(BUCKET_BITS, MAX_BITS // buckets)
    repeated, split = map(spark.sparkContext.broadcast, _repeated_anchors(docs, buckets, bits, length, hot_contexts))
    return _contexts(docs, repeated, buckets, bits, length, split).groupBy("bucket").applyInPandas(_answers(length), _MESSAGE) \
        .groupBy("chunk").applyInPandas(_spans(length), "_id bigint, _mark bigint, _spans array<bigint>")


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
                   hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept`` for every row: ``kept`` the bytes left of the UTF-8 text.

    Null and empty texts have no bytes; rows without id hold nothing back from others and keep their text;
    rows that share an id do not match each other; repeated rows give a row each; an empty table gives none;
    other columns are not looked at."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.xxhash64(text).alias("_mark"), text.alias("_text"))
    spans = written(repeated_spans(rows.where("_id IS NOT NULL"), length, hot_contexts), "repeated-spans").dropDuplicates(["_id", "_mark"])

    def cut(batches):
        for b in batches:
            out = []
            for i, t, s in zip(b["_id"].tolist(), b["_text"], b["_spans"]):
                raw = t.encode("utf-8", "surrogatepass")
                s = [] if s is None else [int(x) for x in s]
                edges = [0, *s, len(raw)]
                kept = b"".join([raw[a:e] for a, e in zip(edges[::2], edges[1::2])])
                out.append((None if i is None or i != i else int(i), len(raw), len(raw) - len(kept), s, kept))
            frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "spans", "kept"])
            del out
            yield frame.astype({"doc_id": "Int64"})
            del frame
            release_memory()

    return rows.join(spans, ["_id", "_mark"], "left").mapInPandas(
        cut, "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<bigint>, kept binary")
