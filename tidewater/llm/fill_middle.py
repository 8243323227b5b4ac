"""Fill-in-the-middle transformation with a piecewise-linear learned rank index.

A text's tokens (a run of white space with the word after it; white space at the end is a token of its own) have
boundary offsets 0 = b0 < b1 < ... < bn.  All boundary offsets of a group of documents, in order, are one increasing
sequence, and an index is fitted to it: straight segments that miss no offset by more than ``ERROR`` bytes, grown as far as
a shrinking cone of slopes allows, and what each offset differs from its segment by, in one signed byte.  A cut before
token k of a document is then an arithmetic prediction plus its stored residual, which is exact.

Cut places and form of a document follow from a hash of its id alone, so a task that runs again gives the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import release_memory
from tidewater.llm.text_bytes import BEGINS, IS_SPACE, groups

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: What a prediction may differ from the offset by: residuals fit a signed byte.
ERROR = 127
#: Offsets that a cone is tried on at a time.
STRIDE = 512


@dataclass
class RankIndex:
    """Offsets by rank: segments ``(first rank, offset there, slope)`` and a residual per offset."""

    first: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    @classmethod
    def fit(cls, offsets: np.ndarray, error: int = ERROR) -> RankIndex:
        """``offsets`` must not decrease.  Each segment starts at an offset and runs on as long as one slope keeps all of
        them within ``error`` (less one, for rounding)."""
        n, room = len(offsets), float(error - 1)
        first, slopes = [], []
        i = 0
        while i < n:
            lo, hi, j = -np.inf, np.inf, i + 1
            while j < n:
                k = np.arange(j, min(j + STRIDE, n))
                rise, run = offsets[k] - offsets[i], k - i
                los = np.maximum(np.maximum.accumulate((rise - room) / run), lo)
                his = np.minimum(np.minimum.accumulate((rise + room) / run), hi)
                good = int(np.argmax(los > his)) if (los > his).any() else len(k)
                if good:
                    lo, hi = los[good - 1], his[good - 1]
                j += good
                if good < len(k):
                    break
            first.append(i)
            slopes.append((lo + hi) / 2 if j > i + 1 else 0.0)
            i = j
        first, slopes = np.array(first, np.int64), np.array(slopes, np.float64)
        index = cls(first, offsets[first] if n else np.zeros(0, np.int64), slopes, np.zeros(0, np.int8))
        rest = offsets - index.predict(np.arange(n))
        index.residual = rest.astype(np.int8 if error <= ERROR else np.int64)
        return index

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        segment = np.searchsorted(self.first, ranks, side="right") - 1
        return self.base[segment] + np.rint(self.slope[segment] * (ranks - self.first[segment])).astype(np.int64)

    def offset(self, ranks: np.ndarray) -> np.ndarray:
        """The offsets of ``ranks``, exactly."""
        return self.predict(ranks) + self.residual[ranks]


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All boundary offsets of a group's documents, and the rank of each document's first.

    A document of n tokens has n + 1 of them, an empty one its start alone."""
    space = IS_SPACE[data]
    ends = np.zeros(len(data), bool)
    if len(data):
        ends[:-1] = ~space[:-1] & space[1:]
        last = offsets[1:][np.diff(offsets) > 0] - 1
        ends[last] = True                                   # a word, or white space that no word follows
    at = np.flatnonzero(ends) + 1
    starts = np.searchsorted(at, offsets[:-1], side="right") + np.arange(len(offsets) - 1)
    every = np.empty(len(at) + len(starts), np.int64)
    is_start = np.zeros(len(every), bool)
    is_start[starts] = True
    every[starts] = offsets[:-1]
    every[~is_start] = at
    return every, starts


def draws(doc_id: int | None, seed: int = 42) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 from the id (nothing where it is null)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * k:4 * k + 4], "big") for k in range(4))


_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                  ("middle_chars", pa.int64()), ("output", pa.large_string())])


def _transform_group(ids: list, data: np.ndarray, offsets: np.ndarray, rate: int, spm_rate: int, seed: int) -> pa.RecordBatch:
    every, starts = boundaries(data, offsets)
    index = RankIndex.fit(every)
    n = np.diff(np.append(starts, len(every))) - 1
    drawn = [draws(i, seed) for i in ids]
    h = np.array(drawn, np.int64).reshape(-1, 4)
    one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    cut1, cut2 = index.offset(starts + np.minimum(one, two)), index.offset(starts + np.maximum(one, two))
    forms, prefix_chars, middle_chars, outputs = [], [], [], []
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    for k in range(len(ids)):
        a, b, c, d = int(offsets[k]), int(cut1[k]), int(cut2[k]), int(offsets[k + 1])
        raw = data[a:d].tobytes()
        if not raw or h[k, 2] % 100 >= rate or any(m in raw for m in marks):
            forms.append("plain")
            prefix_chars.append(None)
            middle_chars.append(None)
            outputs.append(raw)
            continue
        prefix, middle, suffix = raw[:b - a], raw[b - a:c - a], raw[c - a:]
        spm = h[k, 3] % 100 < spm_rate
        forms.append("spm" if spm else "psm")
        prefix_chars.append(int(BEGINS[data[a:b]].sum()))
        middle_chars.append(int(BEGINS[data[b:c]].sum()))
        parts = (marks[1], suffix, marks[0], prefix, marks[2], middle) if spm else (marks[0], prefix, marks[1], suffix, marks[2], middle)
        outputs.append(b"".join(parts))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(n), pa.array(forms, pa.string()), pa.array(prefix_chars, pa.int64()),
         pa.array(middle_chars, pa.int64()), pa.array(outputs, pa.large_binary()).cast(pa.large_string())], schema=_OUT)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 50, spm_rate: int = 80,
              seed: int = 42) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every whole text: of a hundred documents about ``rate`` are
    rearranged, of those about ``spm_rate`` with the suffix first.

    A null text is empty and, like one that holds a marker, stays plain (null counts of characters); a null id draws as
    an empty one and stays null; repeated rows give equal rows; an empty table gives none; other columns are not looked
    at.  One narrow pass; a group of texts is held at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for first, stop, data, offsets in groups(b.column("_text")):
                out = _transform_group(ids[first:stop], data, offsets, rate, spm_rate, seed)
                yield out.set_column(5, "output", out.column(5).cast(pa.string()))
            release_memory()

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(
        run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of :func:`transform` was made from.  No part of a rearranged text holds a marker, and none
    begins inside another, so the first of each after the leading one is the place."""
    psm_at, spm_at = F.instr(output, SUFFIX), F.instr(output, PREFIX)
    middle_at = F.instr(output, MIDDLE)
    width = len(PREFIX)
    cut = lambda start, stop: F.substring(output, start, stop - start)
    middle = F.substring(output, middle_at + width, F.length(output))
    psm = F.concat(cut(F.lit(width + 1), psm_at), middle, cut(psm_at + width, middle_at))
    spm = F.concat(cut(spm_at + width, middle_at), middle, cut(F.lit(width + 1), spm_at))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
