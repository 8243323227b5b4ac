import random
import zlib

import numpy as np
import pytest

from tests.llm.helpers import clashing, prose, rows_of
from tidewater.llm.quality_mil import FEATURES, classify, fit, keep_good, passages, train


def junk(seed, n):
    rng = random.Random(seed)
    kind = seed % 4
    words = prose(seed, n).split()
    if kind == 0:
        return " ".join(w + rng.choice(["***", "%%%", "###"]) for w in words)
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 2:
        return " | ".join(words)
    return " ".join(" ".join([w] * 20) for w in words[: max(1, n // 20)])


def corpus(n=1200):
    docs, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        docs.append((i, junk(i // 5, 120) if bad else prose(i, 40 + i % 150)))
        if i % 7 != 3:
            labels.append((i, int(not bad), 0))
    return docs, labels


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    out = classify(clashing(spark, docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    truth = {i: int(i % 5 != 0) for i, _ in docs}
    rows = out.collect()
    assert {r.doc_id: r.held_out for r in rows} == {i: held_out(i) for i in truth}
    mine = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in mine]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = corpus(200)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    schema = "doc_id bigint, quality int, toxic int"
    flipped = [(i, 1 - q if held_out(i) else q, t) for i, q, t in labels]
    a = rows_of(classify(frame, spark.createDataFrame(labels, schema)), "doc_id", "score")
    b = rows_of(classify(frame, spark.createDataFrame(flipped, schema)), "doc_id", "score")
    assert a == b


def test_scores_look_at_texts_only(spark):
    docs, labels = corpus(200)
    label_frame = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = train(spark.createDataFrame(docs, "doc_id bigint, text string"), label_frame)
    from tidewater.llm.quality_mil import score
    twice = spark.createDataFrame([(1, docs[0][1]), (999, docs[0][1])], "doc_id bigint, text string")
    a, b = score(twice, model).collect()
    assert a.score == b.score


def test_cases(spark):
    docs, labels = corpus(150)
    docs += [(1000, None), (1001, ""), (1002, " \n\t"), (None, "no id"), (1003, prose(5, 30_000)), (0, docs[0][1]), (1004, "é" * 5000), (1005, "\x00")]
    labels += [(None, 1, 0), (1000, None, 1), (1001, 7, 0), (5, 1, 1), (77_777, 1, 0)]
    out = classify(clashing(spark, docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    rows = out.collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[1000].score == by[1001].score == by[1002].score and by[None].held_out is False


def test_no_labels_one_class_and_no_documents(spark):
    schema = "doc_id bigint, quality int, toxic int"
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string")
    assert [r.score for r in classify(docs, spark.createDataFrame([], schema)).collect()] == [0.5, 0.5]
    one = classify(docs, spark.createDataFrame([(i, 1, 0) for i in range(9)], schema)).collect()
    assert {r.predicted for r in one} == {1} and one[0].score == one[1].score
    assert classify(docs.where("false"), spark.createDataFrame([(1, 1, 0)], schema)).count() == 0


def test_attention_finds_the_telling_passage():
    """Bad documents are prose but for one passage, and only documents are labelled: the weights single that passage out."""
    def document(k, at):
        return " ".join(junk(4 * (10 * k + j), 64) if j == at else prose(10 * k + j, 64) for j in range(6))

    rng = np.random.default_rng(2)
    at = [int(rng.integers(6)) if k % 2 else None for k in range(300)]
    bags = [passages(document(k, j)) for k, j in enumerate(at)]
    model = fit(bags, np.array([float(j is None) for j in at]), epochs=60)
    found = 0
    for k in range(40):
        j = k % 6
        x = passages(document(1000 + k, j))
        a = model.attention(x)
        assert a.shape == (6,) == (len(x),) and a.sum() == pytest.approx(1) and (a >= 0).all()
        found += a.argmax() == j and model.score(x, np.array([0]))[0] < 0.5
    assert found >= 36


def test_fits_a_rule_of_one_passage():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(int(rng.integers(1, 5)), 7)).astype(np.float32) for _ in range(40)]
    y = np.array([float(b[:, 0].max() > 0.8) for b in bags])
    model = fit(bags, y, hidden=8, gate=4, epochs=200, batch=16, decay=0.0)
    starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
    assert ((model.score(np.concatenate(bags), starts) >= 0.5) == (y == 1)).mean() > 0.95


def test_passages_cover_the_whole_text():
    assert passages(None).shape == passages("").shape == (1, FEATURES)
    assert len(passages(prose(1, 64 * 5 + 1))) == 6
    assert not np.allclose(passages("ok " * 64 + "!!! " * 64)[1], passages("ok " * 128)[1])


def test_filtering_keeps_rows_as_they_are(spark):
    docs, labels = corpus(200)
    frame = clashing(spark, [*docs, (None, prose(1, 50))], "doc_id bigint, text string")
    model = train(frame, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    good = keep_good(frame, model)
    assert good.schema == frame.schema
    ids = {r.doc_id for r in good.collect()}
    assert None in ids and {i for i, _ in docs if i % 5} <= ids
