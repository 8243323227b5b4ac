import numpy as np
import pytest

from tests.llm.helpers import clashing, prose, rows_of
from tidewater.llm import suffix_dedup
from tidewater.llm.run_index import RunIndex
from tidewater.llm.suffix_dedup import anchors, remove_repeats


def brute(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1 if i is not None else 0):
            w = b[p:p + length]
            first[w] = min(i, first.get(w, i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1 if i is not None else 0):
            if first[b[p:p + length]] < i:
                gone[p:p + length] = True
        gone = gone[:len(b)]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((i, len(b), int(gone.sum()), edge.tolist(), bytes(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    return sorted(out, key=repr)


def run(spark, rows, **settings):
    df = remove_repeats(clashing(spark, rows, "doc_id bigint, text string"), **settings)
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, list(r.spans), bytes(r.kept)) for r in df.collect()], key=repr)


def corpus():
    passage = [prose(k, 30) for k in range(8)]
    rng = np.random.default_rng(6)
    rows = []
    for i in range(120):
        parts = [prose(500 + 7 * i + j, 15) if rng.random() < 0.6 else passage[rng.integers(8)][rng.integers(30):] for j in range(6)]
        rows.append((int((i * 37) % 997), "\n".join(parts)))
    base = prose(3, 200)
    for k in range(25):                                          # near copies, each with its own changes
        words = base.split()
        for at in rng.integers(0, 200, 4):
            words[at] = f"é{rng.integers(1000)}"
        rows.append((2000 - 3 * k, " ".join(words)))
    rows += [(3000 + k, base) for k in range(5)]
    return rows


def test_corpus(spark):
    rows = corpus()
    assert run(spark, rows) == brute(rows)


def test_small_chunks_pieces_and_indexes(spark, monkeypatch):
    rows = corpus()[:70]
    text = prose(9, 3000)
    rows += [(9000, text), (9001, text[:7000] + "x" + text[7001:])]
    by_hand = brute(rows)
    for name, value in (("CHUNK_BYTES", 5000), ("_PIECE", 4096), ("INDEX_BYTES", 300)):
        monkeypatch.setattr(suffix_dedup, name, value)
    docs = [(i, t) for i, t in rows]
    # the tasks of a local session import the module anew, so the small sizes are tried in this process
    found = in_process(docs)
    assert found == {i: s for i, _, _, s, _ in by_hand if s}


def in_process(rows, length=50):
    import pandas as pd
    import pyarrow as pa

    class Shared:
        value = b""

    batch = pa.RecordBatch.from_pydict({"_id": [i for i, _ in rows], "_mark": [0] * len(rows), "_text": [t for _, t in rows]})
    buckets, bits = 64, 1 << 13

    class Rows:
        def mapInArrow(self, f, schema):
            return pd.concat([b.to_pandas() for b in f(iter([batch]))])

    Shared.value = b"\xff" * (buckets * bits // 8)
    contexts = suffix_dedup._contexts(Rows(), Shared, buckets, bits, length)
    decide, merge = suffix_dedup._answers(length), suffix_dedup._spans(length)
    answers = pd.concat([decide(g) for _, g in contexts.groupby("bucket")])
    out = {}
    for _, group in answers.groupby("chunk"):
        for r in merge(group).itertuples():
            out[r[1]] = r[3]
    return out


def phrases(n):
    """Documents that share a phrase among words of their own, some of them the words of another too."""
    out = [(i, f"{prose(4000 + i, 6)} the one phrase that all of them hold {prose(7000 + i, 6)}") for i in range(n)]
    return out + [(n + i, f"x{out[3 * i][1]}") for i in range(n // 4)]


def test_hot_anchors_are_split_exactly(spark):
    rows = corpus()[:60] + [(5000 + i, t) for i, t in phrases(80)]
    want = brute(rows)
    for hot in (0, 3, 40):
        assert run(spark, rows, hot_contexts=hot) == want


def test_a_hot_anchor_is_spread_over_buckets(spark):
    """The largest group stays small however many documents hold the phrase."""
    docs = spark.createDataFrame([(i, 0, t) for i, t in phrases(1000)], "_id bigint, _mark bigint, _text string")
    buckets, bits = 64, 1 << 13
    bitmap, hot = suffix_dedup._repeated_anchors(docs, buckets, bits, 50, 100)
    assert len(hot)

    class Shared:
        def __init__(self, value):
            self.value = value

    def largest(split):
        found = suffix_dedup._contexts(docs, Shared(bitmap), buckets, bits, 50, split).where("bucket >= 0").collect()
        sizes = {}
        for r in found:
            short = suffix_dedup._unpack(r.blob, np.uint32, np.int64, np.uint8, np.uint8)[0]
            for h, k in zip(*np.unique(short, return_counts=True)):
                sizes[r.bucket, int(h)] = sizes.get((r.bucket, int(h)), 0) + int(k)
        return max(sizes.values())

    assert largest(None) > 900 and largest(Shared(hot)) <= 100


def test_cases(spark):
    line = prose(1, 12)[:60]
    rows = [(1, None), (2, ""), (3, line[:49]), (4, line[:50]), (5, f"{line[:50]}"), (6, f"é{line[:50]}é"), (7, line[:50] * 3), (8, "x" * 400),
            (9, "x" * 49), (10, "x" * 50), (None, line), (11, "\x00" * 60), (12, "a" + "\x00" * 60), (4, line[:50]), (13, "漢字" * 30), (14, "字漢" * 30),
            (-5, line), (15, prose(2, 20_000)), (16, prose(2, 20_000)[5000:9000])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 0, [], b"")]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    data[2000:2300] = data[100:400]
    windows = np.arange(3000 - 49)
    begin, count, hashes, _ = anchors(data, windows)
    of = np.repeat(hashes, count)
    assert len(of) == len(windows) and (of[2000:2251] == of[100:351]).all()
    assert count.max() <= 50 - 24 + 1


def test_index_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(60):
        length, m = int(rng.integers(5, 14)), int(rng.integers(1, 30))
        base = rng.integers(0, 2, 60).astype(np.uint8)
        strings = []
        for _ in range(m):
            a = rng.integers(0, 30)
            x = base[a:a + rng.integers(length, length + 15)].copy()
            x[rng.integers(0, len(x))] = rng.integers(0, 3)
            strings.append(x)
        owner = rng.integers(0, 20, m)
        start = np.cumsum([0] + [len(x) for x in strings[:-1]])
        index = RunIndex(np.concatenate(strings), start, owner, length)
        got = index.matches()
        for i, x in enumerate(strings):
            for w in range(len(x) - length + 1):
                sub = x[w:w + length].tobytes()
                want = any(owner[j] < owner[i] and sub in strings[j].tobytes() for j in range(m))
                assert bool(got[i] >> np.uint64(w) & np.uint64(1)) == want
        total = sum(map(len, strings))
        assert sorted(index.locate(r) for r in range(m, m + total)) == list(range(total))


def test_runs_follow_what_is_distinct():
    text = np.frombuffer(prose(1, 2000).encode()[:70 * 100], np.uint8)
    once = RunIndex(text, np.arange(0, len(text), 70), np.arange(100), 50)
    many = RunIndex(np.tile(text, 20), np.arange(0, 20 * len(text), 70), np.arange(2000), 50)
    assert many.runs < 3 * once.runs                             # twenty copies, and their twenty ends


def test_lengths_that_do_not_fit(spark):
    with pytest.raises(ValueError):
        remove_repeats(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), length=80)
    with pytest.raises(ValueError):
        RunIndex(np.zeros(9, np.uint8), np.array([0]), np.array([0]), 3)
    assert rows_of(remove_repeats(spark.createDataFrame([(1, prose(1, 9)), (2, prose(1, 9))], "doc_id bigint, text string"), length=30),
                   "doc_id", "n_removed") == [(1, 0), (2, len(prose(1, 9)))]


def test_buckets_fill_evenly():
    texts = [prose(k, 400, 5000).encode() for k in range(60)]
    found = []
    for data, windows, _, _ in suffix_dedup._pieces(np.arange(len(texts)), texts, 50):
        found.append(suffix_dedup.anchors(data, windows, 50)[2])
    hashes = np.unique(np.concatenate(found))
    for buckets in (16, 64):
        counts = np.bincount(suffix_dedup._short(hashes, buckets)[0], minlength=buckets)
        assert len(hashes) > 50 * buckets and counts.max() < 2 * counts.mean() and counts.min() > 0
