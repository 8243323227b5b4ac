import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import clashing, prose, rows_of
from tidewater.llm.components import components
from tidewater.llm.minhash_odd import (_forest, _linked, minhashes, near_duplicates, odd_sketch, shingles, sketch_similarity)


def brute(rows, words):
    sets = [(i, set(shingles(t, words).tolist())) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted([(i, len(s), find(i), find(i) == i) for i, s in sets], key=repr)


def run(spark, rows, **settings):
    df = near_duplicates(clashing(spark, rows, "doc_id bigint, text string"), **settings)
    return rows_of(df, "doc_id", "n_shingles", "component_id", "kept")


def mutated(text, share, seed):
    rng = random.Random(seed)
    return " ".join(w if rng.random() > share else f"zz{rng.randrange(10 ** 6)}" for w in text.split())


@pytest.mark.parametrize("words", [2, 5])
def test_near_copies_in_small_blocks(spark, words):
    base = [prose(k, 80 + 30 * k) for k in range(4)]
    rows = [(i, prose(1000 + i, 60)) for i in range(40)]
    rows += [(100 + i, mutated(base[i % 4], (i % 9) * 0.012, i)) for i in range(160)]
    rows += [(400 + i, base[0]) for i in range(20)]
    want = brute(rows, words)
    assert run(spark, rows, words=words, block=7) == want        # many blocks a family, documents outside its core
    assert run(spark, rows, words=words) == want
    assert 40 < len({c for _, _, c, _ in want}) < 200


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One\x0bTWO"), (8, "Éa b"), (9, "éa b"),
            (None, "one two"), (10, "a a a a a a"), (11, "a a"), (12, prose(1, 30_000)), (13, prose(1, 30_000) + " end"), (6, "one two")]
    assert run(spark, rows, words=2) == brute(rows, 2)
    assert run(spark, [], words=2) == []
    assert run(spark, [(1, ""), (2, None)], words=2) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_many_unlinked_documents_in_one_family(spark):
    shared = prose(7, 60)                                        # alike enough for a family, not for a link
    rows = [(i, f"{shared} {prose(100 + i, 35)}") for i in range(60)] + [(100 + i, f"{shared} {prose(100 + i, 34)} x") for i in range(6)]
    want = brute(rows, 2)
    assert run(spark, rows, words=2, block=5) == want and len({c for _, _, c, _ in want}) == 60


def test_threshold_is_inclusive(spark):
    a = " ".join(f"w{i}" for i in range(19))                     # 18 shingles; 16 of 20 shared below
    b = " ".join([f"w{i}" for i in range(17)] + ["x1", "x2"])
    assert run(spark, [(1, a), (2, b)], words=2) == brute([(1, a), (2, b)], 2) == [(1, 18, 1, True), (2, 18, 1, False)]


def test_odd_sketches_estimate_high_similarities(spark):
    rng = np.random.default_rng(3)
    for share in (0.95, 0.9, 0.8, 0.6):
        diffs = []
        for _ in range(30):
            common = rng.integers(0, 2 ** 63, 1000, dtype=np.uint64)
            k = int(1000 * (1 - share) / (1 + share))
            a, b = (np.concatenate([common[:1000 - k], rng.integers(0, 2 ** 63, k, dtype=np.uint64)]) for _ in range(2))
            x, y = odd_sketch(minhashes(a)), odd_sketch(minhashes(b))
            diffs.append(int(np.unpackbits((x ^ y).view(np.uint8)).sum()))
        estimate = spark.createDataFrame([(d,) for d in diffs], "d int").select(F.avg(sketch_similarity(F.col("d")))).first()[0]
        assert abs(estimate - share) < 0.04


def test_links_by_blocks_of_columns():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 6000, 5000).astype(np.uint64)) for _ in range(6)]
    sets += [np.unique(np.concatenate([s[: int(len(s) * 0.9)], [np.uint64(99_999)]])) for s in sets[:3]]
    raw = [s.tobytes() for s in sets]
    want = [[100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) for b in sets] for a in sets]
    got = _linked(raw, raw, 80)
    assert got.tolist() == want
    assert len(_forest(got, list(range(9)), list(range(9)))) == 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(0, k) for k in range(1, 60)] + [(200, 201), (201, 200), (300, 300)]
    got = dict(rows_of(components(spark.createDataFrame(edges, "a bigint, b bigint")), "node", "component"))
    want = {i: 100 for i in range(100, 141)} | {k: 0 for k in range(60)} | {200: 200, 201: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_recall_at_the_threshold(spark):
    """Pairs of a similarity of 0.8 or little more, each of words of its own: every one is linked; none just below is."""
    rows, above = [], set()
    for k in range(2000):
        n = 41 + k % 40                                           # shingles of the first text
        words = [f"w{k}x{j}" for j in range(n + 1)]
        new = k % 3                                               # words replaced at the end: as many shingles differ each way
        cut = (n // 9) - new
        other = words[:len(words) - cut] + [f"v{k}y{j}" for j in range(cut)] if cut else words + ["z"]
        a, b = ({tuple(t[i:i + 2]) for i in range(len(t) - 1)} for t in (words, other))
        if 100 * len(a & b) >= 80 * len(a | b):
            above.add(2 * k)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words=2).collect()}
    assert len(above) > 1000
    assert {i for i in range(0, 4000, 2) if got[i + 1] == i} == above
