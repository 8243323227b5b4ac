"""SentencePiece (BPE) encoding and decoding with a merge-type prefix table.

For every prefix of a text BPE has one encoding, so a table that holds the *last* token of each
prefix's encoding determines the whole encoding: the ids come out backwards, from the end, by
stepping over each last token.  The last token of a prefix is the only vocabulary match ending
there (found by one Aho-Corasick pass) whose left neighbour, the last token of the prefix before
it, is compatible with it: merging the two tokens' characters alone gives the same two tokens.

A text is cut first where no piece of the vocabulary can cross: before a run of spaces and around
characters that occur in no longer piece (line ends, say).  Pieces of spaces only all have one
score in the model, so BPE merges them by position, leftmost first; a stack over the run does that.

Public interface: ``PieceCodec`` (driver or worker side), ``encode_documents`` (DataFrame).
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Memo, release_memory

SPACE = "▁"
END_ID = 2
REMEMBERED = 500_000


class PieceCodec:
    """Encoder and decoder for one model file.  ``special`` tokens in a text are ordinary text."""

    def __init__(self, model_file: str, remembered: int = REMEMBERED):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.ids: dict[str, int] = {}
        self.pieces: list[str] = []
        self.score: dict[str, float] = {}
        self.bytes_ids = [0] * 256
        self.id_bytes: dict[int, int] = {}
        self.hidden: set[int] = set()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.pieces.append(piece)
            if sp.is_byte(i):
                b = int(piece[3:5], 16)
                self.bytes_ids[b], self.id_bytes[i] = i, b
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.hidden.add(i)
            else:
                self.ids[piece] = i
                self.score[piece] = sp.get_score(i)
        self.visible = set(self.ids.values())
        words = [p for p in self.ids if len(p) > 1 and p.strip(SPACE)]
        if any(SPACE in p[1:] for p in words):
            raise ValueError("pieces that hold a space inside a word are not supported")
        self.runs = {len(p) for p in self.ids if not p.strip(SPACE)}
        self.joinable = set("".join(words)) - {SPACE}
        self.automaton = ahocorasick.Automaton()
        for p in words:
            if self._merge(p) == [p]:               # a piece that merging never reaches is no match
                self.automaton.add_word(p, (p, len(p)))
        self.automaton.make_automaton()
        self.compatible = Memo(lambda ab: self._merge(ab[0] + ab[1]) == [ab[0], ab[1]], remembered)
        self.word = Memo(self._word, 20_000)
        self.run = Memo(self._run, 10_000)

    # -- merging a short string, the definition that the pair test rests on ----------------
    def _merge(self, text: str) -> list[str]:
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    # -- the prefix table over one stretch that no piece crosses ---------------------------
    def tokens(self, text: str) -> list[str]:
        """BPE of ``text`` (a SPACE at the start at most), by the table of last tokens."""
        last = ["", *text]                           # one character, where no longer match fits
        compatible = self.compatible
        settled = 0
        for at, (piece, size) in self.automaton.iter(text):     # by end, so what lies left is final
            if at >= settled:
                start = at + 1 - size
                if not start or compatible[last[start], piece]:
                    last[at + 1] = piece
                    settled = at + 1
        out, end = [], len(text)
        while end:
            piece = last[end]
            out.append(piece)
            end -= len(piece)
        out.reverse()
        return out

    def _word(self, word: str) -> tuple[bool, list[int]]:
        """(does it begin with a lone space?, ids of the rest) of ``word``, which begins with SPACE
        or at a place that no piece crosses."""
        parts = self.tokens(word)
        lone = parts[:1] == [SPACE]
        out: list[int] = []
        for p in parts[lone:]:
            i = self.ids.get(p)
            out += [i] if i is not None else [self.bytes_ids[b] for b in p.encode("utf-8")]
        return lone, out

    def _run(self, n: int) -> list[int]:
        """Ids of ``n`` spaces that no word has taken: leftmost merges first."""
        stack: list[int] = []
        for _ in range(n):
            stack.append(1)
            while len(stack) > 1 and stack[-1] + stack[-2] in self.runs:
                stack[-2:] = [stack[-1] + stack[-2]]
        return [self.ids[SPACE * k] for k in stack]

    def chunk(self, chunk: str) -> list[int]:
        """Ids of one chunk: spaces, then characters other than the space."""
        body = chunk.lstrip(SPACE)
        spaces = len(chunk) - len(body)
        if not body:
            return self.run[spaces]
        if not spaces:
            return self._stretches(body)
        head, rest = self._split(body)
        lone, ids = self.word[SPACE + head] if head else (True, [])
        out = (self.run[spaces - (not lone)] if spaces - (not lone) else []) + ids
        return out + self._stretches(rest) if rest else out

    def _split(self, body: str) -> tuple[str, str]:
        if self.joinable.issuperset(body):
            return body, ""
        for i, c in enumerate(body):
            if c not in self.joinable:
                return body[:i], body[i:]
        return body, ""

    def _stretches(self, body: str) -> list[int]:
        out: list[int] = []
        while body:
            head, rest = self._split(body)
            if head:
                out += self.word[head][1]
            stop = 0
            while stop < len(rest) and rest[stop] not in self.joinable:
                out += self.word[rest[stop]][1]
                stop += 1
            body = rest[stop:]
        return out

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, spaces restored, the one that encoding put in front dropped; runs of byte
        pieces are read as UTF-8 with U+FFFD for what is not; control ids give nothing."""
        if self.visible.issuperset(ids):
            text = "".join(map(self.pieces.__getitem__, ids)).replace(SPACE, " ")
            return text[1:] if text.startswith(" ") else text
        out, raw = [], bytearray()
        for i in ids:
            b = self.id_bytes.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            if i not in self.hidden:
                out.append(self.pieces[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        if text:
            for c in _CHUNKS.findall(_spaced(text)):
                out += self.chunk(c)
        return [*out, END_ID]


_CHUNKS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


def _spaced(text: str) -> str:
    return SPACE + text.replace(" ", SPACE)


class _Digester:
    """Encodes whole texts to (count, ids as text, decoded text), each chunk's part remembered."""

    def __init__(self, model_file: str, remembered: int = REMEMBERED):
        codec = self.codec = PieceCodec(model_file, remembered)

        def one(chunk: str) -> tuple[int, str, str]:
            ids = codec.chunk(chunk)
            # a chunk never begins or ends inside a character, so its decoding is its share of the whole
            text = codec.decode([codec.ids[SPACE], *ids])
            return len(ids), " ".join(map(str, ids)), text

        self.parts = Memo(one, remembered)

    def __call__(self, text: str | None) -> tuple[int, str, str]:
        if not text:
            return 1, str(END_ID), ""
        get = self.parts.__getitem__
        counts, ids, decoded = zip(*map(get, _CHUNKS.findall(_spaced(text))))
        whole = "".join(decoded)
        return sum(counts) + 1, f"{' '.join(ids)} {END_ID}", whole[1:] if whole.startswith(" ") else whole


@lru_cache(maxsize=1)
def _digester(model_file: str, remembered: int) -> _Digester:
    return _Digester(model_file, remembered)


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """Encode every whole text with an end id, decode it back, and return
    ``id_col, n_tokens, ids_sha256, decoded_sha256`` (``with_ids``: also ``ids``, ``decoded``).

    Null and empty texts are the end id alone; null ids pass through; repeated rows give a row each;
    an empty table gives none; other columns are not looked at.  One narrow pass, no shuffle; a
    worker remembers at most twice ``remembered`` chunks, whatever the vocabulary: memory against time.
    """
    schema = f"{id_col} bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded string"

    def run(batches):
        digest = _digester(model_file, remembered)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            rows = []
            for key, text in zip(b[id_col].tolist(), b["_text"].tolist()):
                n, ids, decoded = digest(text)
                row = [None if key != key else key, n, sha(ids), sha(decoded)]
                rows.append(row + [list(map(int, ids.split())), decoded] if with_ids else row)
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
            out[id_col] = out[id_col].astype("Int64")
            del rows
            yield out
            release_memory()

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string").alias("_text")) \
        .mapInPandas(run, schema)
