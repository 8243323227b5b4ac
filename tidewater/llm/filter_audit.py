"""Filter interaction audit: what each text filter removes alone, after others, and over all orders.

One finite-state pass over the UTF-8 bytes of a document, driven by two small tables (byte to class, and state by class
to what is emitted), counts words, capitals, code points and symbols.  The word spans that it emits go into an
open-addressing hash table that compares bytes before it calls two spans equal, which counts distinct words.  The
state after a byte depends on that byte's class alone, so a block of bytes is run through the tables as arrays, and state
and open word are carried from block to block of a long document.

From the measures each document gets a bit per filter it fails.  Rows are then counted by (part, bits, labels): a table of
at most 128 rows a part, from which every order of the filters is worked out.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import mix64, release_memory
from tidewater.llm.text_bytes import BEGINS, IS_SPACE, groups

SYMBOLS = "#$%&*|"
#: Bytes of a document that pass through the tables at a time.
BLOCK_BYTES = 1 << 22
#: Spans of so many bytes are hashed one by one, shorter ones eight bytes at a time together.
LONG_SPAN = 256
#: Orders are enumerated: at most this many filters.
MOST_FILTERS = 6

# byte classes
_OTHER, _SPACE, _CAPITAL, _SYMBOL, _INNER = range(5)
CLASS = np.full(256, _OTHER, np.uint8)
CLASS[~BEGINS] = _INNER
CLASS[IS_SPACE] = _SPACE
CLASS[65:91] = _CAPITAL
CLASS[list(SYMBOLS.encode())] = _SYMBOL
# states: between words, inside a word; the state after a byte, by its class
_BETWEEN, _INSIDE = 0, 1
NEXT = np.array([_INSIDE, _BETWEEN, _INSIDE, _INSIDE, _INSIDE], np.uint8)
# emitted bits, by state and class
_STARTS, _ENDS, _POINT, _UPPER, _SIGN = 1, 2, 4, 8, 16
EMIT = np.zeros((2, 5), np.uint8)
EMIT[:, [_OTHER, _SPACE, _CAPITAL, _SYMBOL]] |= _POINT
EMIT[:, _CAPITAL] |= _UPPER
EMIT[:, _SYMBOL] |= _SIGN
EMIT[_BETWEEN, [_OTHER, _CAPITAL, _SYMBOL, _INNER]] |= _STARTS
EMIT[_INSIDE, _SPACE] |= _ENDS


class SpanTable:
    """Distinct byte spans of ``data``, told apart by owner.  Open addressing with linear probing; a span counts as known
    only when owner, hash, length and then every byte agree.  It grows with the distinct spans."""

    def __init__(self, data: np.ndarray):
        self._data = data
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self._words = np.ndarray(len(data) + 1, "<u8", buffer=padded, strides=(1,))     # the eight bytes from each place on
        self._slots = np.full(1 << 10, -1, np.int64)
        self._entries = np.zeros((4, 0), np.int64)                                      # owner, start, length, hash

    def _window(self, start, length, k):
        """Eight bytes at ``start + 8 * k``, those past the span's end as zero."""
        left = length - 8 * k
        word = self._words[start + 8 * k]
        short = left < 8
        word[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        return word

    def _hash(self, owner, start, length):
        h = mix64(mix64(owner.astype(np.uint64)) ^ length.astype(np.uint64))
        live = np.flatnonzero(length < LONG_SPAN)
        k = 0
        while live.size:
            h[live] = mix64(h[live] ^ self._window(start[live], length[live], k))
            k += 1
            live = live[length[live] > 8 * k]
        for i in np.flatnonzero(length >= LONG_SPAN):
            raw = self._data[start[i]:start[i] + length[i]].tobytes()
            h[i] = mix64(h[i:i + 1] ^ np.frombuffer(hashlib.blake2b(raw, digest_size=8).digest(), np.uint64))[0]
        return h.view(np.int64)

    def _same_bytes(self, start, other, length):
        same = np.ones(len(start), bool)
        live = np.flatnonzero(length < LONG_SPAN)
        k = 0
        while live.size:
            same[live] = self._window(start[live], length[live], k) == self._window(other[live], length[live], k)
            k += 1
            live = live[same[live] & (length[live] > 8 * k)]
        for i in np.flatnonzero(length >= LONG_SPAN):
            same[i] = np.array_equal(self._data[start[i]:start[i] + length[i]], self._data[other[i]:other[i] + length[i]])
        return same

    def _grow(self, more: int) -> None:
        """Room for ``more`` spans at half load; what is there is placed anew."""
        need = 2 * (self._entries.shape[1] + more)
        if need <= len(self._slots):
            return
        self._slots = np.full(1 << int(need - 1).bit_length(), -1, np.int64)
        known = np.arange(self._entries.shape[1])
        slot = self._entries[3] & (len(self._slots) - 1)
        while known.size:
            free = self._slots[slot] < 0
            self._slots[slot[free]] = known[free]
            left = self._slots[slot] != known
            known, slot = known[left], (slot[left] + 1) & (len(self._slots) - 1)

    def add(self, owner: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Which of the spans are new (of equal ones in this call, one)."""
        self._grow(len(start))
        base = self._entries.shape[1]
        spans = np.stack([owner, start, length, self._hash(owner, start, length)])
        every = np.concatenate([self._entries, spans], axis=1)
        new = np.zeros(len(start), bool)
        open_ = np.arange(len(start))
        slot = spans[3] & (len(self._slots) - 1)
        places = np.zeros(len(start), np.int64)
        while open_.size:
            free = self._slots[slot] < 0
            self._slots[slot[free]] = base + open_[free]            # of several, the last one stays
            there = self._slots[slot]
            mine = there == base + open_
            new[open_[mine]], places[open_[mine]] = True, slot[mine]
            known = np.flatnonzero(~mine & (every[:, there] == spans[:, open_])[[0, 2, 3]].all(axis=0))
            at = open_[known]
            done = mine
            done[known] = self._same_bytes(start[at], every[1, there[known]], length[at])
            open_, slot = open_[~done], (slot[~done] + 1) & (len(self._slots) - 1)
        self._entries = np.concatenate([self._entries, spans[:, new]], axis=1)
        self._slots[places[new]] = base + np.arange(int(new.sum()))
        return new


def _run(data: np.ndarray, begins: np.ndarray, state: int) -> np.ndarray:
    """What the transducer emits for each byte; ``begins``: where documents begin, in the state between words."""
    cls = CLASS[data]
    before = np.empty(len(data), np.uint8)
    if len(data):
        before[0] = state
        before[1:] = NEXT[cls[:-1]]
        before[begins[begins < len(data)]] = _BETWEEN
    return EMIT[before, cls]


def measure_group(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per document (rows) words, distinct words, capitals, code points, symbols."""
    n = len(offsets) - 1
    out = np.zeros((n, 5), np.int64)
    table = SpanTable(data)
    if n == 1 and len(data) > BLOCK_BYTES:
        blocks = [(a, min(a + BLOCK_BYTES, len(data))) for a in range(0, len(data), BLOCK_BYTES)]
    else:
        blocks = [(0, len(data))]
    state, opened = _BETWEEN, np.zeros(0, np.int64)
    for a, b in blocks:
        begins = offsets[:-1] if a == 0 else np.zeros(0, np.int64)
        emitted = _run(data[a:b], begins, state)
        last = np.flatnonzero(np.diff(offsets) > 0) if b == len(data) else np.zeros(0, np.int64)
        ends_open = offsets[last + 1][~IS_SPACE[data[offsets[last + 1] - 1]]]      # a document's end ends its word
        starts = np.concatenate([opened, a + np.flatnonzero(emitted & _STARTS)])
        ends = np.sort(np.concatenate([a + np.flatnonzero(emitted & _ENDS), ends_open]))
        opened, starts = starts[len(ends):], starts[:len(ends)]
        owner = np.searchsorted(offsets, starts, side="right") - 1
        new = table.add(owner, starts, ends - starts)
        out[:, 0] += np.bincount(owner, minlength=n)
        out[:, 1] += np.bincount(owner[new], minlength=n)
        full = np.flatnonzero(np.diff(offsets) > 0)
        if full.size:
            where = offsets[full] if len(blocks) == 1 else np.zeros(1, np.int64)
            for column, bit in ((2, _UPPER), (3, _POINT), (4, _SIGN)):
                out[full, column] += np.add.reduceat((emitted & bit) > 0, where, dtype=np.int64)
        state = int(NEXT[CLASS[data[b - 1]]]) if b else state
    return out


_MEASURES = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("words", pa.int64()), ("distinct_words", pa.int64()),
                       ("capitals", pa.int64()), ("code_points", pa.int64()), ("symbols", pa.int64()), ("digest", pa.binary())])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``doc_id, part, words, distinct_words, capitals, code_points, symbols, digest`` of every whole text.

    One narrow pass.  A null text is empty (all zero, the digest of nothing), a null part the empty string; null ids stay
    null; repeated rows give a row each; an empty table gives none; other columns are not looked at.  ``digest`` is the
    text's SHA-256, by which equal texts meet.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, stop, data, offsets in groups(b.column("_text")):
                counts = measure_group(data, offsets)
                raw = memoryview(data)
                digests = [hashlib.sha256(raw[i:j]).digest() for i, j in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id")[first:stop], b.column("part")[first:stop], *(pa.array(counts[:, k]) for k in range(5)),
                     pa.array(digests, pa.binary())], schema=_MEASURES)
            release_memory()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, "doc_id bigint, part string, words bigint, distinct_words bigint, capitals bigint, "
                                "code_points bigint, symbols bigint, digest binary")


#: The letter of the filter that is judged across the table: repeated texts.
REPEAT = "E"


def default_filters() -> dict[str, Column]:
    return {
        "A": F.col("words") < 100,
        "B": 100 * F.col("distinct_words") < 80 * F.col("words"),
        "C": 100 * F.col("capitals") > 10 * F.col("code_points"),
        "D": F.col("symbols") > 0,
    }


def count_failures(measured: DataFrame, labels: DataFrame, filters: dict[str, Column], repeat: str | None = REPEAT) -> DataFrame:
    """``part, bits, good, toxic, n``: documents by the filters that they fail (bit k: the k-th letter).

    ``repeat`` is failed by each document whose text a smaller id of the table has as well; a null id is smaller than none
    and has none smaller.  Labels of one id are taken together (good: any quality 1; toxic: any toxic 1).  Copies are
    counted per text and part before they meet, so a text that a third of all documents hold is a few rows by then; rows
    without an id are dealt out before the join, which they cannot match.
    """
    bits = F.lit(0)
    for k, fails in enumerate(filters.values()):
        bits = bits + F.when(fails, F.lit(1 << k)).otherwise(F.lit(0))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("_label_id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")).withColumn("_label_salt", F.lit(0))
    rows = measured.select("doc_id", "part", "digest", bits.alias("bits"),
                           F.when(F.col("doc_id").isNull(), 1 + F.spark_partition_id()).otherwise(F.lit(0)).alias("_salt"))
    rows = rows.join(marks, (F.col("doc_id") == F.col("_label_id")) & (F.col("_salt") == F.col("_label_salt")), "left") \
        .select("doc_id", "_salt", "part", "digest", "bits", F.coalesce("good", F.lit(False)).alias("good"),
                F.coalesce("toxic", F.lit(False)).alias("toxic"))
    keys = ["part", "bits", "good", "toxic"]
    if repeat is None:
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    per_doc = rows.groupBy("doc_id", "_salt", "digest", *keys).agg(F.count(F.lit(1)).alias("n"))
    per_text = per_doc.groupBy("digest", *keys).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_free"))
    smallest = F.min("first").over(Window.partitionBy("digest"))
    own = F.col("n_free") + F.when(F.col("first") == smallest, F.col("n_first")).otherwise(F.lit(0))
    copied = 1 << len(filters)
    return per_text.withColumn("own", own).select(
        "part", "good", "toxic", F.explode(F.array(F.struct("bits", F.col("own").alias("n")), F.struct(
            (F.col("bits") + F.lit(copied)).alias("bits"), (F.col("n") - F.col("own")).alias("n")))).alias("r")) \
        .select("part", "r.bits", "good", "toxic", "r.n").groupBy(*keys).agg(F.sum("n").alias("n"))


def interactions(counted: DataFrame, letters: str) -> DataFrame:
    """Per part, order of ``letters`` and step: what stays, what its filter removes here, what it would have removed but for
    earlier ones, what no other filter removes, labelled losses, and the filter's removals over all orders.

    ``counted`` is :func:`count_failures`'s table; every part in it gives every order and step, zeros included.
    """
    if not 1 <= len(letters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters, not {len(letters)}")
    orders = list(permutations(range(len(letters))))
    steps = [{"o": "".join(letters[k] for k in order), "s": s + 1, "bit": 1 << order[s], "before": sum(1 << k for k in order[:s])}
             for order in orders for s in range(len(letters))]
    every = F.from_json(F.lit(json.dumps(steps)), "array<struct<o string, s int, bit int, before int>>")
    x = counted.select("part", "bits", "good", "toxic", "n", F.explode(every).alias("x")).select(
        "part", "bits", "good", "toxic", "n", F.col("x.o").alias("filter_order"), F.col("x.s").alias("step"), "x.bit", "x.before")
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    earlier = F.col("bits").bitwiseAND(F.col("before")) != 0
    removed = fails & ~earlier
    # of the filters that a document fails, each comes first in as many orders
    share = F.col("n") * F.element_at(F.array(F.lit(0), *[F.lit(len(orders) // k) for k in range(1, len(letters) + 1)]), F.bit_count("bits") + 1)
    total = lambda when, value=F.col("n"): F.coalesce(F.sum(F.when(when, value)), F.lit(0)).cast("bigint")
    return x.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier).alias("kept"), total(removed).alias("removed"), total(fails & earlier).alias("redundant"),
        total(F.col("bits") == F.col("bit")).alias("unique_fails"), total(removed & F.col("good")).alias("good_lost"),
        total(removed & F.col("toxic")).alias("toxic_lost"), total(fails, share).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, repeat: str | None = REPEAT) -> DataFrame:
    """The audit of ``filters`` (and of repeated texts under the letter ``repeat``) over whole ``docs``."""
    filters = default_filters() if filters is None else filters
    return interactions(count_failures(measure(docs), labels, filters, repeat), "".join(filters) + (repeat or ""))
