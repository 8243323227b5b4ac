"""Texts of Arrow batches as UTF-8 bytes: bounded groups of documents, and the byte classes of the text contracts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tidewater.llm.common import ASCII_SPACE

#: Bytes that a group of documents holds at most, unless it is one longer document.
GROUP_BYTES = 1 << 22

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(ASCII_SPACE.encode())] = True
#: Bytes that begin a code point: all but 10xxxxxx.
BEGINS = (np.arange(256) & 0xC0) != 0x80


def groups(texts: pa.Array, most: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``texts`` (null: empty) in order as ``(first, stop, data, offsets)``: rows ``first`` to ``stop``, their bytes
    and where each row's bytes begin and end in ``data``.  No copy of the text is made."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        stop = max(first + 1, int(np.searchsorted(ends, ends[first] + most, side="right")) - 1)
        yield first, stop, data[ends[first]:ends[stop]], ends[first:stop + 1] - ends[first]
        first = stop
