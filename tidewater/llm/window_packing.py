"""Sum-of-squares online packing of tokenised documents into windows.

A document is its tokens and an end id.  What of it fills whole windows goes into windows of its own; the rest is placed
online: of the fill levels that partly filled windows have (and a new window), into the one that leaves the smallest sum
of squared counts of partly filled windows over all levels.  The counts are an array by level, so a choice is a few array
operations whatever has been packed.  Balanced counts keep a window at hand for what comes next, which is why few stay
unfilled.

Every task packs the documents it reads, with nothing shuffled.  Only a bounded number of windows is open at a time:
beyond it a document is cut to fill the fullest ones.  At a task's end the emptiest windows are cut up to fill the others,
and the one that is left becomes sequences at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.bpe_codec import BpeCodec
from tidewater.llm.common import release_memory
from tidewater.llm.text_bytes import groups

WINDOW = 2048
END_ID = 1
#: Windows that a task holds open at most, with their ids.
MOST_OPEN = 1024
#: Sequences of one task are numbered in a block of their own.
TASK_BITS = 36
ID_BYTES = 4


class LevelPacker:
    """Places items of 1 to ``size - 1`` units; counts of partly filled windows by level decide."""

    def __init__(self, size: int, most_open: int):
        self.size, self.most_open = size, most_open
        self.count = np.zeros(size + 1, np.int64)           # count[0] and count[size] stay zero
        self.at = [[] for _ in range(size + 1)]             # open windows by level
        self.fill: dict[int, int] = {}
        self.windows = 0

    def choose(self, units: int) -> int:
        """The level to place ``units`` at (0: a new window); of equal ones the fullest."""
        below = self.count[:self.size - units + 1]
        change = 2 * (self.count[units:] - below) + 2       # of the sum of squares, a window going from h to h + units
        change[0] -= 1                                      # a new window leaves no level
        change[-1] -= 1                                     # a full one reaches none
        change[1:][below[1:] == 0] = np.iinfo(np.int64).max
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def _move(self, window: int, level: int, units: int) -> None:
        if level:
            self.count[level] -= 1
        if level + units < self.size:
            self.count[level + units] += 1
            self.at[level + units].append(window)
            self.fill[window] = level + units
        else:
            self.fill.pop(window, None)

    def place(self, units: int) -> Iterator[tuple[int, int, int]]:
        """``(window, level, units)`` for each part of an item: one, unless no window may be opened any more."""
        while units:
            level = self.choose(units) if units < self.size else 0
            if level == 0 and units < self.size and len(self.fill) >= self.most_open:
                level = int(np.flatnonzero(self.count).max())
            part = min(units, self.size - level)
            if level:
                window = self.at[level].pop()
            else:
                window, self.windows = self.windows, self.windows + 1
            self._move(window, level, part)
            yield window, level, part
            units -= part


class Packer:
    """Packs encoded documents; yields pieces ``(doc, start, ids, doc_tokens, sequence, offset)`` of finished sequences."""

    def __init__(self, size: int = WINDOW, most_open: int = MOST_OPEN):
        self.size = size
        self._levels = LevelPacker(size, most_open)
        self._open: dict[int, list] = {}
        self._extra = 0

    def _finish(self, pieces: list, sequence: int) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, tokens in pieces:
            yield doc, start, ids, tokens, sequence, offset
            offset += len(ids) // ID_BYTES

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        """``ids``: little-endian 32-bit ids, the end id included."""
        tokens, start = len(ids) // ID_BYTES, 0
        while start < tokens:
            for window, level, units in self._levels.place(min(tokens - start, self.size)):
                piece = (doc, start, ids[ID_BYTES * start:ID_BYTES * (start + units)], tokens)
                self._open.setdefault(window, []).append(piece)
                start += units
                if level + units == self.size:
                    yield from self._finish(self._open.pop(window), window)

    def close(self) -> Iterator[tuple]:
        """Fill the fullest windows from the emptiest; what is left is cut at powers of two."""
        units = lambda pieces: sum(len(p[2]) // ID_BYTES for p in pieces)
        rest = sorted(([units(p), w, p] for w, p in self._open.items()), key=lambda x: (x[0], x[1]), reverse=True)
        self._open = {}
        while len(rest) > 1:
            fill, window, pieces = rest[0]
            gap, donor = self.size - fill, rest[-1]
            doc, start, ids, tokens = donor[2].pop()
            here = len(ids) // ID_BYTES
            take = min(gap, here)
            if take < here:                                 # the later part of the piece stays
                donor[2].append((doc, start + take, ids[ID_BYTES * take:], tokens))
            pieces.append((doc, start, ids[:ID_BYTES * take], tokens))
            donor[0] -= take
            rest[0][0] += take
            if not donor[2]:
                rest.pop()
            if rest[0][0] == self.size:
                yield from self._finish(rest.pop(0)[2], window)
        if rest:
            left, sequence = rest[0][2][::-1], self._levels.windows
            remaining = rest[0][0]
            while remaining:
                room = 1 << (remaining.bit_length() - 1)
                remaining, pieces = remaining - room, []
                while room:
                    doc, start, ids, tokens = left.pop()
                    take = min(room, len(ids) // ID_BYTES)
                    if take < len(ids) // ID_BYTES:
                        left.append((doc, start + take, ids[ID_BYTES * take:], tokens))
                    pieces.append((doc, start, ids[:ID_BYTES * take], tokens))
                    room -= take
                yield from self._finish(pieces, sequence)
                sequence += 1


@lru_cache(maxsize=1)
def _codec(tokenizer: str) -> BpeCodec:
    return BpeCodec(tokenizer)


#: Pieces handed on at a time.
_ROWS = 1 << 14


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, end_id: int = END_ID,
         with_ids: bool = False, most_open: int = MOST_OPEN) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece (``with_ids``: also ``ids``).

    Whole texts are encoded and get ``end_id``; each id lies in one piece, and sequences hold ``size`` ids or a power of
    two.  A null text is empty: the end id alone.  Null ids pass through; repeated rows are documents of their own; an
    empty table gives no piece; other columns are not looked at.  Sequences are numbered by partition and in it by
    order, so a task that runs again gives the same rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")),
                        *([("ids", pa.list_(pa.int32()))] if with_ids else [])])

    def rows(pieces: list, block: int) -> pa.RecordBatch:
        doc, start, ids, tokens, sequence, offset = zip(*pieces)
        columns = [doc, start, [len(x) // ID_BYTES for x in ids], [zlib.crc32(x) for x in ids], tokens, [block + s for s in sequence], offset]
        if with_ids:
            columns.append([np.frombuffer(x, "<i4") for x in ids])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, packer = _codec(tokenizer), Packer(size, most_open)
        block = TaskContext.get().partitionId() << TASK_BITS
        end = int(end_id).to_bytes(ID_BYTES, "little")
        done: list = []
        for b in batches:
            docs_here = iter(b.column("doc_id").to_pylist())
            for _, _, data, offsets in groups(b.column("_text")):
                for ids in codec.encode_group(data, offsets):
                    done.extend(packer.add(next(docs_here), ids + end))
                    if len(done) >= _ROWS:
                        yield rows(done, block)
                        done = []
            release_memory()
        done.extend(packer.close())
        if done:
            yield rows(done, block)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(
        run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
             + (", ids array<int>" if with_ids else ""))
