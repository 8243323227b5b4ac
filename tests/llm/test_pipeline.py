import hashlib
import importlib.util
import json
import subprocess
import sys
from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from tests.llm.helpers import prose, rows_of
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_minhash_odd import brute as brute_groups
from tests.llm.test_quality_mil import junk
from tidewater.llm.decontaminate import Template, covered

ROOT = Path(__file__).resolve().parents[2]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    items = [(k, prose(9000 + k, 20)) for k in range(5)]
    shared = prose(1, 8) + " shared line"
    docs = []
    for i in range(160):
        text = f"{prose(i, 70)}\n{shared}\n{prose(i + 500, 50)}" if i % 2 else prose(i, 90 + i)
        if i % 16 == 3:
            text += "\n" + items[i % 5][1]
        docs.append((i, junk(i, 100) if i % 8 == 0 else text, "en", f"s{i % 3}", 0))
    docs += [(1000 + k, docs[1][1] if k % 2 else docs[1][1] + " more", "en", None, 0) for k in range(6)]
    docs += [(2000, None, None, None, None), (2001, "", "en", "s", 0), (None, prose(77, 60), "en", "s", 0), (2002, prose(78, 9000), "en", "s", 0)]
    docs = [(i, t, a, b, n if t is None else len(t)) for i, t, a, b, n in docs]
    labels = [(i, int(i % 8 != 0), 0) for i in range(160) if i % 3]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, items


def test_every_stage_against_brute_force(spark, tables):
    folder, docs, items = tables
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "repeated_lines", "near_duplicates", "benchmark_leaks", "tokens"]
    # rejected documents go, clean ones stay
    frame = stages["quality"](spark, frame, folder)
    kept = rows_of(frame, "doc_id", "text")
    ids = {i for i, _ in kept}
    assert {i for i, *_ in docs if i is None or i % 8 or i >= 1000} <= ids | {2000, 2001} and not ids & set(range(0, 160, 8))
    # repeated lines
    frame = stages["repeated_lines"](spark, frame, folder)
    want = sorted([(i, t) for i, _, _, t in brute_lines(kept)], key=repr)
    got = rows_of(frame, "doc_id", "text", "n_chars")
    assert [(i, t or "") for i, t, _ in got] == want and all(n == len(t) for _, t, n in got if t is not None)
    assert any("shared line" not in (t or "") and i is not None and i % 2 for i, t in want)
    # one document of each group
    before = [(i, t) for i, t, _ in got]
    frame = stages["near_duplicates"](spark, frame, folder)
    stay = {i for i, _, c, k in brute_groups(before, 5) if k}
    after = rows_of(frame, "doc_id", "text")
    assert {i for i, _ in after} == stay | {None} and len(stay) < len(before)
    # benchmark items
    frame = stages["benchmark_leaks"](spark, frame, folder)
    clean = [(i, t) for i, t in after if i is None or not any(covered(Template(t), Template(q)) >= 0.8 for _, q in items)]
    left = rows_of(frame, "doc_id", "text")
    assert left == sorted(clean, key=repr) and len(left) < len(after)
    assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    # tokens
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    encoded = [(i, sp.encode(t or "") + [2]) for i, t in left]
    want = sorted([(i, len(x), sha(" ".join(map(str, x))), sha(sp.decode(x))) for i, x in encoded], key=repr)
    columns = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert rows_of(stages["tokens"](spark, frame, folder), *columns) == want
    assert rows_of(corpus_pipeline.run(spark, folder), *columns) == want


def test_empty_documents(spark, tables, tmp_path):
    folder, _, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
        docs = out if name != "tokens" else docs


def test_entry_lists_the_operators_and_works_without_them(tmp_path):
    import __spark_entry__ as entry
    names = {f"op{n}_" for n in range(1, 11)}
    assert {q.partition("_")[0] + "_" for q in entry.queries() if q.startswith("op") and q[2].isdigit()} >= names
    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
    code = """
import importlib.util, json, sys
real = importlib.util.find_spec
importlib.util.find_spec = lambda n, *a: None if n.startswith(('tidewater.llm', 'corpus_pipeline')) else real(n, *a)
import __spark_entry__ as e
print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql()), [m for m in sys.modules if 'llm' in m and 'tidewater' in m]]))
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    queries, oracle, loaded = json.loads(out.stdout.strip().splitlines()[-1])
    assert "pipeline" not in queries and not any(q.startswith("op1") for q in queries) and queries and oracle and not loaded
    assert importlib.util.find_spec("tidewater.llm") is not None
