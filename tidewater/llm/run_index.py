"""A run-length index over a collection of strings: suffix order, run-compressed Burrows-Wheeler
transform with sampled run ends, and streamed matching statistics.

Rows of the transform are the suffixes of all strings in order, each string's empty suffix included;
equal suffixes go by string number, so the LF mapping is exact.  Only runs are kept: where each begins,
its character's LF target, and the text position of its last row.
``matches`` finds smallest owners in a table of suffix intervals; the sampled run ends serve ``locate`` alone.
"""

from __future__ import annotations

import numpy as np

_STEP = 5          # characters packed into one sort key, beside how many there are
_NARROW = 21       # bits of a position, where two ranks and a position fit one key


def _sorted(major: np.ndarray, minor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text positions by (major, minor, position), and the ranks 1, 2, ... of (major, minor), equal
    pairs alike (0 stands for what lies behind an end)."""
    n = len(major)
    if n < 1 << _NARROW:                                 # one plain sort of packed keys
        key = major.astype(np.uint64) << np.uint64(2 * _NARROW) | minor.astype(np.uint64) << np.uint64(_NARROW)
        key |= np.arange(n, dtype=np.uint64)
        key.sort()
        order = (key & np.uint64((1 << _NARROW) - 1)).astype(np.int64)
        key >>= np.uint64(_NARROW)
        step = key[1:] != key[:-1]
    else:
        order = np.lexsort((minor, major))
        step = (major[order][1:] != major[order][:-1]) | (minor[order][1:] != minor[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.concatenate([[1], 1 + np.cumsum(step)])
    return order, rank


class RunIndex:
    """Index of the strings ``text[start:end]`` (uint8 array; consecutive, non-empty).

    ``length`` is the length of matches that ``matches`` looks for and ``owner`` gives each string's owner.
    """

    def __init__(self, text: np.ndarray, start: np.ndarray, owner: np.ndarray, length: int):
        if length < _STEP:
            raise ValueError(f"matches of fewer than {_STEP} characters")
        n, m = len(text), len(start)
        self.length, self.owner, self.count = length, np.asarray(owner), m
        self.start, self.end = np.asarray(start), np.append(start[1:], n)
        size = self.end - self.start
        string = np.repeat(np.arange(m), size)
        left = self.end[string] - np.arange(n)                   # characters up to the string's end
        # suffix order by doubling, from keys of _STEP characters
        packed = np.zeros(n, np.uint64)
        padded = np.concatenate([text, np.zeros(_STEP, np.uint8)])
        for j in range(_STEP):
            c = padded[j:j + n].astype(np.uint64)
            c[left <= j] = 0
            packed |= c << np.uint64(8 * (_STEP - 1 - j))
        packed = packed << np.uint64(3) | np.minimum(left, _STEP).astype(np.uint64)     # 43 bits
        order, rank = _sorted(packed >> np.uint64(_NARROW), packed & np.uint64((1 << _NARROW) - 1))
        ranks = {_STEP: rank}
        span, longest = _STEP, int(size.max())

        def behind(rank: np.ndarray, by: int) -> np.ndarray:
            out = np.zeros(n, np.int64)
            out[:n - by] = rank[by:]
            out[left <= by] = 0
            return out

        while span < longest:
            order, ranks[2 * span] = _sorted(ranks[span], behind(ranks[span], span))
            span *= 2
        # intervals of suffixes that share their first ``length`` characters, with their smallest owner
        part = max(s for s in ranks if s <= length)
        keys = [ranks[part]]
        for by in [*range(part, length - part + 1, part), length - part]:
            keys.append(behind(ranks[part], by))
        same = left[order] >= length
        same[1:] &= same[:-1]
        same[0] = False
        for k in keys:
            same[1:] &= k[order[1:]] == k[order[:-1]]
        first = np.flatnonzero(~same)
        self.interval_start = first
        self.interval_owner = np.minimum.reduceat(self.owner[string[order]], first)
        row_of = np.empty(n, np.int64)
        row_of[order] = np.arange(m, n + m)
        self.entry = row_of[np.maximum(self.end - length, self.start)]   # where a string's last match begins
        # the transform and its runs; the last symbol, past all characters, marks a string's beginning
        symbol = np.full(n + m, 256, np.int64)
        symbol[:m] = text[self.end - 1]
        inner = order > self.start[string[order]]
        symbol[m:][inner] = text[order[inner] - 1]
        change = np.ones(n + m, bool)
        change[1:] = symbol[1:] != symbol[:-1]
        self.run_start = np.flatnonzero(change)
        self.run_symbol = symbol[self.run_start]
        lengths = np.diff(np.append(self.run_start, n + m))
        by_symbol = np.argsort(self.run_symbol, kind="stable")
        before = np.empty(len(lengths), np.int64)
        before[by_symbol] = np.cumsum(lengths[by_symbol]) - lengths[by_symbol]
        self.run_target = m + before                              # rows of smaller symbols, then of this one's earlier runs
        self.whole_row = np.flatnonzero(symbol == 256)            # rows of whole strings, and which they are
        self.whole_string = string[order[self.whole_row - m]]
        last = np.append(self.run_start[1:], n + m) - 1
        self.run_sample = np.where(last < m, self.end[np.minimum(last, m - 1)], order[np.maximum(last - m, 0)])

    @property
    def runs(self) -> int:
        return len(self.run_start)

    def _step(self, row: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.run_start, row, side="right") - 1
        return self.run_target[run] + row - self.run_start[run]

    def locate(self, row: int) -> int:
        """Text position of a row: LF steps up to a sampled run end or a string's beginning."""
        steps = 0
        while True:
            run = int(np.searchsorted(self.run_start, row, side="right")) - 1
            end = self.run_start[run + 1] if run + 1 < self.runs else len(self.owner) + int(self.end[-1])
            if row == end - 1:
                return int(self.run_sample[run]) + steps
            if self.run_symbol[run] == 256:
                return int(self.start[self.whole_string[np.searchsorted(self.whole_row, row)]]) + steps
            row = int(self.run_target[run] + row - self.run_start[run])
            steps += 1

    def matches(self) -> np.ndarray:
        """Streams all strings against the index, from their last ``length`` characters back, one LF step at
        a time, and marks in bit
        w of a string's result that its substring of ``length`` from w on also lies in a string of a smaller
        owner.  Strings hold up to 63 such substrings."""
        count = self.end - self.start - self.length + 1            # substrings of that length
        out = np.zeros(self.count, np.uint64)
        active = np.argsort(-count, kind="stable")
        ordered, row = count[active], self.entry[active]
        for back in range(int(ordered[0]) if self.count else 0):
            n = int(np.searchsorted(-ordered, -back, side="left"))     # strings with more than ``back``
            active, ordered, row = active[:n], ordered[:n], row[:n]
            if back:
                row = self._step(row)
            at = np.searchsorted(self.interval_start, row - self.count, side="right") - 1
            hit = self.interval_owner[at] < self.owner[active]
            out[active[hit]] |= np.uint64(1) << (ordered[hit] - back - 1).astype(np.uint64)
        return out
