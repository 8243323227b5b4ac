import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import clashing, prose
from tidewater.llm import window_packing as WP
from tidewater.llm.bpe_codec import BpeCodec

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(FILE)
    out.encode_special_tokens = True
    return out


def test_ids_are_the_librarys(library):
    rng = random.Random(1)
    pool = ["a", "b", " ", " ", "\n", "\t", "\x1c", "\xa0", "'s", "'ll", "é", "ß", "中", "😀", "1", "23", "!", "<|endoftext|>", "\r\n", "  ", "ſ", "word",
            "The", "q" * 401, " " * 450, "́", "İ", "'S", "ɏ", "Ⅷ", "٣", " ", "᠎"]
    codec = BpeCodec(FILE)
    assert codec._fast is not None
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(25)))
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_new_words_by_the_library_where_ranks_do_not_serve(library):
    codec = BpeCodec(public_tokenizers.path("byte_bpe_50k.json"))
    codec._fast = None
    text = "A text  with runs,\n\nand words.  "
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_choice_is_the_smallest_sum_of_squares():
    rng = random.Random(2)
    p = WP.LevelPacker(32, 1000)
    for _ in range(600):
        units = rng.randrange(1, 32)
        squares = {}
        for h in range(0, 32 - units + 1):
            if h and not p.count[h]:
                continue
            after = p.count.copy()
            after[h] -= h > 0
            after[h + units] += h + units < 32
            squares[h] = int((after[1:32] ** 2).sum())
        best = min(squares.values())
        assert p.choose(units) == max(h for h, s in squares.items() if s == best)
        list(p.place(units))
        assert p.count.sum() == len(p.fill) and p.count[0] == p.count[32] == 0


def check(pieces, docs, size):
    """``pieces``: rows of the operator (with ids); ``docs``: the ids of each row's document."""
    windows, parts = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, tokens, sequence, offset, ids in pieces:
        assert length == len(ids) > 0 and crc == zlib.crc32(np.array(ids, "<u4").tobytes())
        windows[sequence].append((offset, length))
        parts[doc].append((start, tokens, list(ids)))
    for places in windows.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at == size or (at < size and at & (at - 1) == 0)      # no padding
    for doc, found in parts.items():
        want = [d for i, d in docs if i == doc]
        if len(want) == 1:
            found.sort()
            assert [x for _, _, ids in found for x in ids] == want[0]
            assert [s for s, _, _ in found] == np.cumsum([0] + [len(ids) for _, _, ids in found])[:-1].tolist()
            assert all(t == len(want[0]) for _, t, _ in found)
        else:                                                        # repeated rows: as many ids in all
            assert sorted(x for _, _, ids in found for x in ids) == sorted(x for d in want for x in d)
    assert set(parts) == {i for i, _ in docs}
    return windows


@pytest.mark.parametrize("size, most_open", [(32, 1000), (32, 3), (2048, 8), (16, 1)])
def test_packer_covers_every_id_once(size, most_open):
    rng = random.Random(size + most_open)
    packer, docs, pieces = WP.Packer(size, most_open), [], []
    for i in range(400):
        ids = [rng.randrange(50257) for _ in range(rng.choice([1, 2, 5, size - 1, size, size + 1, rng.randrange(1, 3 * size)]))]
        docs.append((i, ids))
        pieces.extend(packer.add(i, np.array(ids, "<u4").tobytes()))
        assert len(packer._open) <= most_open
    pieces.extend(packer.close())
    rows = [(d, s, len(ids) // 4, zlib.crc32(ids), t, q, o, np.frombuffer(ids, "<u4").tolist()) for d, s, ids, t, q, o in pieces]
    windows = check(rows, docs, size)
    assert sum(sum(n for _, n in w) < size for w in windows.values()) <= size.bit_length()


def test_few_documents_are_cut():
    rng = random.Random(5)
    packer, pieces = WP.Packer(), []
    sizes = [64 * rng.randrange(1, 32) for _ in range(5000)]      # sizes that can fill windows whole
    for i, n in enumerate(sizes):
        pieces.extend(packer.add(i, bytes(4 * n)))
    pieces.extend(packer.close())
    assert len(pieces) < 1.1 * len(sizes)


ROWS = [(i, prose(i, 5 + 7 * i % 400)) for i in range(80)] + [
    (200, None), (201, ""), (202, prose(1, 9000)), (203, " \n "), (None, "no id"), (204, "é 中 <|endoftext|>"), (5, prose(5, 40)), (5, prose(5, 40)),
    (205, "x" * 50000)]


def test_documents(spark, library):
    df = clashing(spark, ROWS, "doc_id bigint, text string").repartition(3)
    docs = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in ROWS]
    rows = [tuple(r) for r in WP.pack(df, FILE, with_ids=True).collect()]
    check(rows, docs, WP.WINDOW)
    assert WP.pack(clashing(spark, [], "doc_id bigint, text string"), FILE).count() == 0


def test_a_task_that_runs_again_gives_the_same_rows(spark):
    df = clashing(spark, ROWS, "doc_id bigint, text string").repartition(2, "doc_id")
    packed = WP.pack(df, FILE)
    assert sorted(map(tuple, packed.collect()), key=repr) == sorted(map(tuple, packed.collect()), key=repr)
