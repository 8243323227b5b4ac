import duckdb
import numpy as np
import pytest

from tests.llm.helpers import clashing, prose, rows_of
from tidewater.llm import oracle
from tidewater.llm.line_dedup import ASCII_SPACE, _Marks, drop_repeated_lines, filter_bits, line_key, rewrite_documents

LONG = "a line of well over twenty characters"


def brute(rows, min_chars=20, min_docs=3):
    seen = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            k = line_key(x)
            if i is not None and len(k) >= min_chars:
                seen.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or not (len(s := seen.get(line_key(x), ())) >= min_docs and max(s) != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def run(spark, rows, **settings):
    df = drop_repeated_lines(clashing(spark, rows, "doc_id bigint, text string"), **settings)
    return rows_of(df, "doc_id", "n_lines", "n_dropped", "kept")


CASES = [
    (1, f"{LONG}\nown line one that is long enough\n  {LONG.upper()}\t"), (2, f"\x0b{LONG} "), (3, f"x\n{LONG}\nx\nx"), (4, None), (5, ""),
    (6, "short\nshort"), (7, "short"), (8, "short"), (None, f"{LONG}\nno id"), (9, "Äbcdefghijklmnopqrstuvwxyz"), (10, "äbcdefghijklmnopqrstuvwxyz"),
    (11, "twice only in these two docs"), (12, "twice only in these two docs\ntwice only in these two docs\ntwice only in these two docs"),
    (13, " nbsp at the front of a line"), (14, "\n\n\n"), (2, f"\x0b{LONG} "),
]


def test_cases(spark):
    assert run(spark, CASES) == brute(CASES)
    assert run(spark, []) == []


def test_many_lines_and_a_full_filter(spark):
    common = [prose(k, 8) for k in range(30)]
    rng = np.random.default_rng(4)
    rows = [(i, "\n".join([common[0]] + [common[rng.integers(30)] if rng.random() < 0.4 else prose(1000 + i * 20 + j, 7) for j in range(12)]))
            for i in range(300)]
    rows.append((1000, "\n".join(prose(k, 20) for k in range(400))))
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, max_bits=1 << 13, bits_per_row=1) == brute(rows)   # saturated: still exact


def test_two_bitmaps_never_miss_a_repeat():
    marks = _Marks(1 << 13)
    first, second = np.arange(0, 900, dtype=np.uint64), np.arange(600, 1500, dtype=np.uint64)
    marks.add(first)
    marks.add(second)
    set_bits = lambda m: set(np.flatnonzero(np.unpackbits(m, bitorder="little")).tolist())
    assert set_bits(marks.once) == set(range(1500)) and set_bits(marks.twice) == set(range(600, 900))


def test_filter_size_is_bounded():
    assert filter_bits(10) == 1 << 13 and filter_bits(10 ** 12) == 1 << 28 and filter_bits(1000, 128) == 1 << 17


def test_rewriting_keeps_the_other_columns(spark):
    docs = clashing(spark, [(i, f"{LONG}\nline {i}") for i in range(4)] + [(None, LONG)], "doc_id bigint, text string")
    out = rewrite_documents(docs)
    assert out.schema == docs.schema
    assert rows_of(out, "doc_id", "text", "kept") == sorted(
        [(i, f"line {i}", "x") for i in range(3)] + [(3, f"{LONG}\nline 3", "x"), (None, LONG, "x")], key=repr)


@pytest.mark.parametrize("c", [chr(i) for i in range(9, 14)] + [" ", "\x1c", "\x85", " "])
def test_only_the_six_named_characters_are_stripped(c):
    assert (line_key(f"{c}A{c}") == "a") == (c in ASCII_SPACE)


def test_query_is_its_oracle(spark, scratch):
    from tidewater.llm.queries import QUERIES
    rows = [r for r in CASES if r[0] is not None][:-1]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{scratch}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{scratch}/documents.parquet/*.parquet')")
    want = sorted(con.execute(oracle.OP7).fetchall(), key=repr)
    assert rows_of(QUERIES["op7_line_dedup"](spark, scratch), "doc_id", "n_lines", "n_dropped", "kept_sha256") == want
