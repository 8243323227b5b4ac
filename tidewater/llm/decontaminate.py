"""Benchmark decontamination by template canonicalisation.

Words are lower-cased and typed slots replaced: numbers and units in the *literal* template, names
(capitalised inside a sentence) as well in the *typed* one.  The *open* one takes every word with a capital
for a name, also one that begins a sentence or is all capitals, unless it is a function word, and a run of
them for one name.  Names in a text all of capitals cannot be told.  A benchmark item is found in a document
when at least ``min_coverage`` of its windows of five template words lie there, close to one diagonal,
and every slot value of the item maps to one value of the document throughout; so verbatim copies, case
changes and re-parameterised questions are caught and chance phrases are not.

Candidates come from a hash join of *anchor* windows.  An item with n windows that has coverage c must
share one of any ``n - ceil(c n) + 1`` of them, so only its rarest that many are joined (prefix filtering,
exact).  A bitmap of fixed size over the anchors goes to all tasks; documents send on only windows that
hit it.  Candidate documents, and no others, are read again and verified in full.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from functools import cached_property
from itertools import compress

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import Memo, mix64, release_memory, written

WINDOW = 5
MIN_LITERALS = 3
MIN_COVERAGE = 0.8
DRIFT = 5
BITMAP_BITS = 1 << 26
_BUCKET = 32768                       # bits in one of Spark's bitmaps

# Fixed word lists of the canonical form.
NUMBER_WORDS = frozenset("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
                         "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand "
                         "million billion".split())
UNITS = frozenset("mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs "
                  "pound pounds oz ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds "
                  "min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz w kw mw v a "
                  "n j kj pa kpa c f k degree degrees percent dollar dollars usd euro euros eur cent cents mph kmh".split())
COMMON = frozenset("a an the this that these those i you he she it we they me him her us them my your his its our their who whom "
                   "whose which what when where why how if then else so because since as while until before after during although "
                   "though unless and or but nor yet for of in on at by to from with without into onto over under between among "
                   "through about against above below near per than is are was were be been being am do does did has have had can "
                   "could will would shall should may might must not no yes there here now later next finally also each every all "
                   "both some any many much more most few less least another other such same only just again once let".split())

#: Words and numbers, and the marks that end sentences (or lines) as tokens of their own.
_TOKENS = re.compile(r"\d+(?:[.,]\d+)*|\w+|[.!?\n]")
_MARKS = frozenset(".!?\n")
LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3
_CAPITAL, _START = 4, 8               # flags beside a word's kind, and of a mark
_SLOT = {k: np.uint64(xxhash.xxh3_64_intdigest(f"<slot {k}>")) for k in (NUMBER, UNIT, NAME)}
_FACTORS = mix64(np.arange(1, WINDOW + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _classify(word: str) -> int:
    """Hash of the lower-cased word with its kind, as far as the word alone tells it inside a sentence, in the two lowest
    bits, then whether the open template takes it for a name; of a mark the flag alone that the next word begins a
    sentence."""
    if word in _MARKS:
        return _START
    low = word.lower()
    if word[0].isdigit() or low in NUMBER_WORDS:
        kind = NUMBER
    elif low in UNITS:
        kind = UNIT
    elif word[0].isupper() and word[1:].islower():
        kind = NAME
    else:
        kind = LITERAL
    capital = kind in (LITERAL, NAME) and word[0].isupper() and low not in COMMON
    return xxhash.xxh3_64_intdigest(low) & ~15 | kind | _CAPITAL * capital


_WORDS = Memo(_classify, 150_000)


class Template:
    """A text's words: hashes, kinds, and window hashes of its literal, its typed and its open template."""

    def __init__(self, text: str | None):
        self._tokens = _TOKENS.findall(text) if text else []
        known = np.fromiter(map(_WORDS.__getitem__, self._tokens), np.uint64, len(self._tokens))
        mark = (known & np.uint64(_START)) != 0
        start = np.ones(len(known), bool)                         # the text begins a sentence
        start[1:] = mark[:-1]
        self._is_word = ~mark
        known, start = known[self._is_word], start[self._is_word]
        self.word = known & ~np.uint64(15)
        kind = (known & np.uint64(3)).astype(np.int8)
        kind[(kind == NAME) & start] = LITERAL                    # a capital there says nothing
        after_number = np.zeros(len(kind), bool)
        after_number[1:] = kind[:-1] == NUMBER
        kind[(kind == UNIT) & ~after_number] = LITERAL            # a unit is one behind a number only
        self.kind = kind
        literal = self.word.copy()
        for k in (NUMBER, UNIT):
            literal[kind == k] = _SLOT[k]
        typed = literal
        if (kind == NAME).any():
            typed = literal.copy()
            typed[kind == NAME] = _SLOT[NAME]
        self.size = min(WINDOW, len(kind))
        self.literal = self._windows(literal)
        self.typed = self.literal if typed is literal else self._windows(typed)
        self.name = (known & np.uint64(_CAPITAL)) != 0
        inner = self.name.copy()                                  # goes on with the name before it
        inner[1:] &= self.name[:-1] & ~start[1:]
        inner[:1] = False
        self.first = np.flatnonzero(~inner)                       # where the open template's words begin
        if len(self.first) == len(kind) and (self.name == (kind == NAME)).all():
            self.open = self.typed
        else:
            free = literal.copy()
            free[self.name] = _SLOT[NAME]
            self.open = self._windows(free[self.first])

    def _windows(self, words: np.ndarray, size: int = WINDOW) -> np.ndarray:
        """Hashes of all windows of ``size`` words; a text of fewer than ``WINDOW`` is one window unless asked for less."""
        size = min(size, len(words))
        if not size:
            return np.zeros(0, np.uint64)
        n = len(words) - size + 1
        out = np.full(n, size if size < WINDOW else 0, np.uint64)
        for j in range(size):
            out += words[j:j + n] * _FACTORS[j]
        return mix64(out)

    def exact(self, size: int) -> np.ndarray:
        """Hashes of all windows of ``size`` words as they are, lower-cased; none in a shorter text."""
        return self._windows(self.word, size) if size <= len(self.word) else np.zeros(0, np.uint64)

    def windows(self) -> list[np.ndarray]:
        """The window hashes of all templates that differ."""
        return [self.literal] + [self.typed] * (self.typed is not self.literal) + [self.open] * (self.open is not self.typed)

    @cached_property
    def raw(self) -> list[str]:
        """The words as they stand; only candidates are asked."""
        return list(compress(self._tokens, self._is_word))

    def _word(self, at: int) -> str:
        return self.raw[at].lower()

    def value(self, at: int, family: str = "literal") -> str:
        """A word of a template; in the open one a name may be of several words."""
        if family != "open":
            return self._word(at)
        end = self.first[at + 1] if at + 1 < len(self.first) else len(self.raw)
        return " ".join(map(self._word, range(self.first[at], end)))

    def families(self) -> list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        """(name, window hashes, which words are slots, positions of the windows that count) of the literal
        and, if there are names, of the typed and the open template.  A text of fewer words than a window has too little
        wording to stand without its values: it is one window as it is."""
        if len(self.word) < WINDOW:
            return [("exact", self.exact(len(self.word)), np.zeros(len(self.word), bool), np.arange(1))] if len(self.word) else []
        out = []
        measure = (self.kind == NUMBER) | (self.kind == UNIT)
        for family, hashes, slot, same in (("literal", self.literal, measure, None), ("typed", self.typed, self.kind != LITERAL, self.literal),
                                           ("open", self.open, (measure | self.name)[self.first], self.typed)):
            if hashes is same:
                continue
            size = min(WINDOW, len(slot))
            sums = np.concatenate([[0], np.cumsum(~slot)])
            literals = sums[size:] - sums[:-size] if size else np.zeros(0, int)
            counts = np.flatnonzero(literals >= min(MIN_LITERALS, size))
            if len(counts):
                out.append((family, hashes, slot, counts))
            elif not out:
                out.append((family, hashes, slot, np.arange(len(hashes))))
        return out


def needed(n: int, coverage: float) -> int:
    return max(1, math.ceil(coverage * n - 1e-9))


def covered(doc: Template, item: Template, coverage: float = MIN_COVERAGE) -> float:
    """The best share of the item's windows found in the document near one diagonal with consistent
    slots, over all templates; below ``coverage`` it may be reported lower than it is."""
    best = 0.0
    for family, hashes, slot, counts in item.families():
        size = min(WINDOW, len(slot))
        doc_hashes = doc.exact(size) if family == "exact" else getattr(doc, family)
        at = defaultdict(list)
        for q in counts.tolist():
            at[hashes[q]].append(q)
        hits = np.flatnonzero(np.isin(doc_hashes, hashes[counts]))
        pairs = sorted((p - q, p, q) for p in hits.tolist() for q in at[doc_hashes[p]])
        runs, run = [], []
        for x in pairs:
            if run and x[0] - run[-1][0] > DRIFT:
                runs.append(run)
                run = []
            run.append(x)
        if run:
            runs.append(run)
        for run in runs:
            if len({q for _, _, q in run}) < needed(len(counts), coverage):
                continue
            votes: dict[str, Counter] = defaultdict(Counter)
            for _, p, q in run:
                for j in np.flatnonzero(slot[q:q + size]).tolist():
                    votes[item.value(q + j, family)][doc.value(p + j, family)] += 1
            means = {k: v.most_common(1)[0][0] for k, v in votes.items()}
            good = {q for _, p, q in run if all(means[item.value(q + j, family)] == doc.value(p + j, family)
                                                for j in np.flatnonzero(slot[q:q + size]).tolist())}
            best = max(best, len(good) / len(counts))
    return best


def _anchors(items: DataFrame, coverage: float) -> tuple[DataFrame, list[int]]:
    """``_hash, _item``: of each item and template the rarest windows, as many as prefix filtering needs; and the lengths
    below ``WINDOW`` that items have."""
    def windows(batches):
        for b in batches:
            rows = []
            for i, text in zip(b["_item"].tolist(), b["_text"]):
                for f, (_, hashes, slot, counts) in enumerate(Template(text).families()):
                    rows += [(i, f, min(WINDOW, len(slot)), len(counts), h) for h in hashes[counts].view(np.int64).tolist()]
            yield pd.DataFrame(rows, columns=["_item", "_family", "_size", "_n", "_hash"]).astype("int64")

    flat = written(items.mapInPandas(windows, "_item bigint, _family bigint, _size bigint, _n bigint, _hash bigint"), "item-windows")
    short = sorted(r[0] for r in flat.where(F.col("_size") < WINDOW).select("_size").distinct().collect())
    rarity = flat.groupBy("_hash").agg(F.count(F.lit(1)).alias("_seen"))
    order = Window.partitionBy("_item", "_family").orderBy("_seen", "_hash")
    keep = F.col("_n") - F.greatest(F.lit(1), F.ceil(F.col("_n") * coverage - 1e-9)) + 1
    return flat.join(rarity, "_hash").withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= keep) \
        .select("_hash", "_item").distinct(), short


def find_leaks(docs: DataFrame, items: DataFrame, min_coverage: float = MIN_COVERAGE, id_col: str = "doc_id",
               text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, coverage``: one row for each benchmark item found in each document.

    Null and empty texts hold and are nothing; rows without id take no part; items that repeat word for
    word are reported under their smallest id; repeated documents give one row; an item of fewer than five
    words is found where those words stand in a row, wherever in a text; empty tables give no rows; other columns are not looked at."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("_doc"), F.col(text_col).cast("string").alias("_text")) \
        .where("_doc IS NOT NULL AND _text IS NOT NULL")
    texts = items.select(F.col(item_col).cast("bigint").alias("_item"), F.col(item_text_col).cast("string").alias("_text")) \
        .where("_item IS NOT NULL AND _text IS NOT NULL").groupBy("_text").agg(F.min("_item").alias("_item"))
    anchors, short = _anchors(texts, min_coverage)
    anchors = written(anchors, "item-anchors")
    slot = F.pmod(F.col("_hash"), F.lit(BITMAP_BITS))
    marks = anchors.groupBy(F.floor(slot / _BUCKET).alias("bucket")).agg(F.bitmap_construct_agg(slot % _BUCKET).alias("bits"))
    bitmap = np.zeros(BITMAP_BITS // 8, np.uint8)                 # of fixed size, whatever the benchmark's
    for m in marks.toLocalIterator():
        bitmap[m.bucket * _BUCKET // 8:(m.bucket + 1) * _BUCKET // 8] = np.frombuffer(m.bits, np.uint8)
    shared = spark.sparkContext.broadcast(bitmap.tobytes())

    def hits(batches):
        bits = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            ids, found = [], []
            for i, text in zip(b["_doc"].tolist(), b["_text"]):
                own, template = [], Template(text)
                for hashes in template.windows() + [template.exact(n) for n in short]:
                    at = hashes & np.uint64(BITMAP_BITS - 1)
                    own.append(hashes[(bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1])
                own = np.unique(np.concatenate(own))
                ids.append(np.full(len(own), i, np.int64))
                found.append(own.view(np.int64))
            if ids:
                yield pd.DataFrame({"_doc": np.concatenate(ids), "_hash": np.concatenate(found)})
            del ids, found
            release_memory()

    candidates = rows.mapInPandas(hits, "_doc bigint, _hash bigint").join(anchors, "_hash").select("_doc", "_item").distinct()
    per_doc = candidates.join(texts, "_item").groupBy("_doc").agg(
        F.collect_list(F.struct("_item", F.col("_text").alias("_question"))).alias("_items"))

    def verify(batches):
        remembered = Memo(Template, 2000)
        for b in batches:
            out = []
            for i, text, found in zip(b["_doc"].tolist(), b["_text"], b["_items"]):
                doc = Template(text)
                for x in found:
                    share = covered(doc, remembered[x["_question"]], min_coverage)
                    if share >= min_coverage - 1e-9:
                        out.append((i, x["_item"], share))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "coverage"]).astype(
                {"doc_id": "int64", "item_id": "int64", "coverage": "float64"})

    return rows.join(per_doc, "_doc").mapInPandas(verify, "doc_id bigint, item_id bigint, coverage double") \
        .groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"))
