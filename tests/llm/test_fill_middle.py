import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import clashing, prose, rows_of
from tidewater.llm import fill_middle as FM
from tidewater.llm.text_bytes import groups
from pyspark.sql import functions as F

TOKENS = re.compile("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, rate=50, spm_rate=80):
    text = text or ""
    units = TOKENS.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < spm_rate
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


CASES = [(i, prose(i, 1 + i % 60)) for i in range(60)] + [
    (100, None), (101, ""), (102, "  "), (103, " a"), (104, "a "), (105, "\n\na\tb  \x0bc\n"), (106, "é 中 😀  ñ " * 50), (107, "has <P> in it"),
    (108, "has <S"), (109, "<M>"), (110, "x" * 70000), (111, prose(5, 20000)), (None, prose(6, 30)), (112, "< P> S> M> <<S >"), (3, prose(3, 4)), (3, prose(3, 4)),
    (-5, prose(9, 50))]


@pytest.mark.parametrize("rate, spm_rate", [(50, 80), (100, 50), (0, 0), (100, 0)])
def test_against_brute_force(spark, rate, spm_rate):
    out = FM.transform(clashing(spark, CASES, "doc_id bigint, text string"), rate=rate, spm_rate=spm_rate)
    out = out.withColumn("back", FM.restored(F.col("output"), F.col("form")))
    got = rows_of(out, "doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back")
    assert got == sorted(((*brute(i, t, rate, spm_rate), t or "") for i, t in CASES), key=repr)


def test_empty_table(spark):
    assert FM.transform(clashing(spark, [], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("error", [2, 5, 127, 1000])
def test_index_is_exact_and_bounded(error):
    rng = np.random.default_rng(error)
    for offsets in (np.cumsum(rng.integers(0, 12, 20000)), np.cumsum(rng.pareto(0.6, 3000).astype(np.int64) % 10 ** 7),
                    np.zeros(50, np.int64), np.arange(5000) * 7, np.array([0]), np.zeros(0, np.int64)):
        index = FM.RankIndex.fit(offsets, error)
        assert (index.offset(np.arange(len(offsets))) == offsets).all()
        assert len(offsets) == 0 or np.abs(index.residual.astype(np.int64)).max() <= error
    line = FM.RankIndex.fit(np.arange(100000) * 7, error)
    assert len(line.first) == 1                                     # one segment says it all


def test_segments_are_few_on_prose():
    data = np.frombuffer(prose(1, 50000).encode(), np.uint8)
    every, _ = FM.boundaries(data, np.array([0, len(data)]))
    assert len(FM.RankIndex.fit(every).first) < len(every) / 300


def test_boundaries_of_groups():
    texts = [t for _, t in CASES]
    for most in (1, 1000, 1 << 22):
        for first, stop, data, offsets in groups(pa.array(texts), most):
            every, starts = FM.boundaries(data, offsets)
            for k, t in enumerate(texts[first:stop]):
                ends = np.cumsum([0] + [len(u.encode()) for u in TOKENS.findall(t or "")])
                assert every[starts[k]:starts[k] + len(ends)].tolist() == (offsets[k] + ends).tolist()
