"""Byte-level BPE ids of whole texts, as the ``tokenizers`` library gives them for a vocabulary file.

Where the file's merges are in the order of their ids (which is checked), merging by rank gives the same ids, and
``tiktoken`` does that several times faster: whole texts go to it.  Texts whose characters the two libraries might class
differently, and those with very long words or runs of white space (which cost it the square of their length), are encoded
word by word: a pretoken never spans the edge of a word but for one space before it.  White space follows the
pretokeniser's rule: all but the last character of a run are one pretoken, the last one joins the next word if it is a
space and stands alone otherwise, and a run at the end of the text is one pretoken.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from tidewater.llm.common import Memo
from tidewater.llm.text_bytes import IS_SPACE

#: The pretokeniser's split, without backtracking into runs: contractions, words, numbers, signs, white space.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_RUNS = re.compile(r"(\s+)")
#: White space to Python's ``str`` and not to the pretokeniser.
_ODD = "\x1c\x1d\x1e\x1f"
#: Code points up to U+027F, which have been classed alike since the first versions of Unicode: in UTF-8 no byte above this.
_SETTLED = 0xC9
#: Words and runs of more bytes are left to the library.
_LONG = 400
#: Words that are remembered in each of two generations, if they have at most so many characters.
_REMEMBERED, _REMEMBER_CHARS = 50_000, 64


class _Words(Memo):
    """Remembers short words alone: memory is bounded on any text."""

    def __missing__(self, word):
        return super().__missing__(word) if len(word) <= _REMEMBER_CHARS else self._make(word)


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary file: printable Latin-1 for itself, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def _by_rank(file: str) -> tiktoken.Encoding | None:
    """An encoder over the file's ranks, or None where ids are not the order of merging."""
    with open(file, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = _byte_letters()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"].get(a + b) for a, b in merges]
    if model["type"] != "BPE" or None in ids or ids != sorted(set(ids)) or not set("".join(model["vocab"])) <= set(letters):
        return None
    ranks = {bytes(letters[c] for c in word): i for word, i in model["vocab"].items()}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class BpeCodec:
    """``encode(text)``: the ids, little-endian 32-bit.  Strings of special tokens are ordinary text."""

    def __init__(self, file: str):
        self._library = Tokenizer.from_file(file)
        self._library.encode_special_tokens = True
        self._fast = _by_rank(file)
        self._words = _Words(self._by_library, _REMEMBERED)

    def _by_library(self, text: str) -> bytes:
        return np.array(self._library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _by_word(self, text: str) -> bytes:
        parts = _RUNS.split(text)                                       # word, run, word, ..., word
        ids = self._words
        out = [ids[parts[0]]] if parts[0] else []
        for run, word in zip(parts[1::2], parts[2::2]):
            if not word:
                out.append(ids[run])
                continue
            if len(run) > 1:
                out.append(ids[run[:-1]])
            if run[-1] == " ":
                out.append(ids[" " + word])
            else:
                out += (ids[run[-1]], ids[word])
        return b"".join(out)

    def _slow(self, text: str) -> bytes:
        return self._by_library(text) if any(c in text for c in _ODD) else self._by_word(text)

    def _settled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which of a group's texts go to the fast encoder whole."""
        out = np.full(len(offsets) - 1, self._fast is not None)
        if not len(data):
            return out
        full = np.flatnonzero(np.diff(offsets))
        out[full] &= ~np.logical_or.reduceat((data > _SETTLED) | ((data >= ord(_ODD[0])) & (data <= ord(_ODD[-1]))), offsets[full])
        space = IS_SPACE[data]
        edge = np.ones(len(data), bool)
        edge[1:] = space[1:] != space[:-1]
        edge[offsets[full]] = True
        at = np.flatnonzero(edge)
        long = at[np.diff(at, append=len(data)) > _LONG]
        out[np.searchsorted(offsets, long, side="right") - 1] = False
        return out

    def encode_group(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        """The ids of each text of a group (:func:`text_bytes.groups`); the texts are judged together."""
        for first, stop, fast in zip(offsets[:-1].tolist(), offsets[1:].tolist(), self._settled(data, offsets).tolist()):
            text = data[first:stop].tobytes().decode("utf-8", "replace")
            if fast:
                yield self._fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            else:
                yield self._slow(text)

    def encode(self, text: str) -> bytes:
        data = np.frombuffer(text.encode(), np.uint8)
        return next(self.encode_group(data, np.array([0, len(data)])))
