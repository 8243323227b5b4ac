"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 64 words.  Each passage is encoded from what it looks like: the
frequencies of pairs of character classes, how many words repeat, how long words are.  A small network
maps it to a hidden vector, gated attention (``softmax(w . (tanh(Vh) * sigmoid(Uh)))``) weighs the
passages of a document, and the weighted mean is scored.  Only document labels are known, so the
attention learns which passages tell.

Training runs on the driver over a bounded sample of labelled documents (``max_documents``, and for
them at most ``max_passages`` evenly spread passages), features computed by tasks; scoring is one narrow
pass over every passage of every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import bounded_sample, release_memory

PASSAGE_WORDS = 64
MAX_DOCUMENTS = 4000
MAX_PASSAGES = 64
_CLASSES = 16
_EXTRA = 5
FEATURES = _CLASSES * _CLASSES + _EXTRA


def _class_table() -> np.ndarray:
    """A class for each byte: lower, upper, digit, space, line end, marks by kind, the rest of UTF-8."""
    out = np.full(256, 15, np.uint8)
    groups = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c", b".", b",;:",
              b"!?", b"'\"`", b"()[]{}<>", b"-_/\\|", b"*#", b"$%&@", b"=+~^", ]
    for k, group in enumerate(groups):
        out[np.frombuffer(group, np.uint8)] = k
    out[128:] = 14
    return out


_CLASS = _class_table()
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(b" \t\n\x0b\x0c\r")] = True


def passages(text: str | None) -> np.ndarray:
    """Feature rows, one a passage; an empty text has one row of zeros."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return np.zeros((1, FEATURES), np.float32)
    count = -(-n // PASSAGE_WORDS)
    b = np.frombuffer(raw, np.uint8)
    space = _IS_SPACE[b]
    start = ~space
    start[1:] &= space[:-1]
    passage = np.maximum(np.cumsum(start) - 1, 0) // PASSAGE_WORDS
    cls = _CLASS[b].astype(np.int64)
    pair = passage[:-1] * (_CLASSES * _CLASSES) + cls[:-1] * _CLASSES + cls[1:]
    width = _CLASSES * _CLASSES
    counts = np.bincount(pair, minlength=count * width).reshape(count, width).astype(np.float32)
    out = np.zeros((count, FEATURES), np.float32)
    out[:, :width] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    ids = np.fromiter(map(hash, words), np.int64, n)
    at = np.arange(n) // PASSAGE_WORDS
    size = np.bincount(at, minlength=count)
    same = np.zeros(n)
    same[1:] = ids[1:] == ids[:-1]
    order = np.lexsort((ids, at))
    new = np.ones(n)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (at[order][1:] != at[order][:-1])
    length = np.fromiter(map(len, words), np.float64, n)
    out[:, width] = np.bincount(at, same, count) / size
    out[:, width + 1] = np.bincount(at, new[np.argsort(order)], count) / size
    out[:, width + 2] = np.bincount(at, length, count) / size / 10
    out[:, width + 3] = size / PASSAGE_WORDS
    out[:, width + 4] = 1
    return out


@dataclass
class AttentionModel:
    """Weights of the network.  ``constant`` replaces it where the labels hold one class only."""

    weights: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """All layers for bags that begin at ``starts`` in the passage rows ``x``."""
        w = self.weights
        h = np.tanh(x @ w["W"])
        t, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-np.clip(h @ w["U"], -30, 30)))
        s = (t * u) @ w["a"]
        bag = np.zeros(len(x), np.int64)
        bag[starts[1:]] = 1
        bag = np.cumsum(bag)
        e = np.exp(s - np.maximum.reduceat(s, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        y = z @ w["out"] + w["bias"][0]
        return {"h": h, "t": t, "u": u, "bag": bag, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(y, -30, 30)))}

    def score(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(starts), self.constant)
        return self.forward(x, starts)["p"]

    def attention(self, x: np.ndarray) -> np.ndarray:
        """Weights of the passages of one document."""
        return np.full(len(x), 1 / len(x)) if self.constant is not None else self.forward(x, np.array([0]))["a"]


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 32, gate: int = 16, epochs: int = 30, batch: int = 128,
        rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> AttentionModel:
    """Adam on the log loss of the document labels."""
    if len(set(labels.tolist())) < 2:
        return AttentionModel({}, float((labels.sum() + 1) / (len(labels) + 2)))
    rng = np.random.default_rng(seed)
    size = bags[0].shape[1]
    model = AttentionModel({
        "W": rng.normal(0, 1 / np.sqrt(16), (size, hidden)), "V": rng.normal(0, 1 / np.sqrt(hidden), (hidden, gate)),
        "U": rng.normal(0, 1 / np.sqrt(hidden), (hidden, gate)), "a": rng.normal(0, 1 / np.sqrt(gate), gate),
        "out": rng.normal(0, 1 / np.sqrt(hidden), hidden), "bias": np.zeros(1)})
    w = model.weights
    m1, m2, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            part = order[i:i + batch]
            x = np.concatenate([bags[j] for j in part]).astype(np.float64)
            starts = np.concatenate([[0], np.cumsum([len(bags[j]) for j in part])[:-1]])
            f = model.forward(x, starts)
            h, t, u, a, bag = f["h"], f["t"], f["u"], f["a"], f["bag"]
            dy = (f["p"] - labels[part]) / len(part)
            dz = dy[:, None] * w["out"]
            dh = a[:, None] * dz[bag]
            da = (h * dz[bag]).sum(1)
            ds = a * (da - np.add.reduceat(a * da, starts)[bag])
            dg = ds[:, None] * w["a"]
            dt, du = dg * u * (1 - t * t), dg * t * u * (1 - u)
            dh += dt @ w["V"].T + du @ w["U"].T
            dx = dh * (1 - h * h)
            grads = {"W": x.T @ dx, "V": h.T @ dt, "U": h.T @ du, "a": (t * u).T @ ds, "out": f["z"].T @ dy, "bias": np.array([dy.sum()])}
            step += 1
            for k, g in grads.items():
                g = g + decay * w[k]
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                w[k] -= rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def is_held_out(doc_id):
    """Documents whose labels are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_documents: int = MAX_DOCUMENTS, max_passages: int = MAX_PASSAGES) -> AttentionModel:
    """Fit on at most ``max_documents`` labelled documents that are not held out, drawn by a hash of
    their ids.  Null ids and labels and labels other than 0 and 1 are not used; of several labels of one
    document the smallest counts."""
    chosen = labels.select(F.col(id_col).cast("bigint").alias("_id"), F.col(label_col).cast("int").alias("_label")) \
        .where("_id IS NOT NULL AND _label IN (0, 1)").where(~is_held_out(F.col("_id"))) \
        .groupBy("_id").agg(F.min("_label").alias("_label"))
    chosen = bounded_sample(chosen, "_id", max_documents)
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text")) \
        .join(F.broadcast(chosen), "_id")                       # max_documents rows at most

    def encode(batches):
        for b in batches:
            out = []
            for i, label, text in zip(b["_id"], b["_label"], b["_text"]):
                x = passages(text)
                if len(x) > max_passages:
                    x = x[np.linspace(0, len(x) - 1, max_passages).astype(int)]
                out.append((i, label, x.astype(np.float16).tobytes()))
            yield pd.DataFrame(out, columns=["_id", "_label", "_x"])

    found = rows.mapInPandas(encode, "_id bigint, _label int, _x binary").groupBy("_id").agg(
        F.first("_label").alias("_label"), F.min("_x").alias("_x")).collect()   # bounded by the sample
    found.sort(key=lambda r: r._id)
    bags = [np.frombuffer(r._x, np.float16).reshape(-1, FEATURES).astype(np.float32) for r in found]
    return fit(bags, np.array([r._label for r in found], np.float64))


def score(docs: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row: 0 to 1, predicted 1 from 0.5 on.

    Null and empty texts are one empty passage; null ids pass through (not held out); repeated rows
    give a row each; an empty table gives none; other columns are not looked at."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), is_held_out(F.col(id_col).cast("bigint")).alias("held_out"),
                       F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        for b in batches:
            scores = np.zeros(len(b))
            texts = b["_text"].tolist()
            for at in range(0, len(texts), 256):
                bags = [passages(t) for t in texts[at:at + 256]]
                starts = np.concatenate([[0], np.cumsum([len(x) for x in bags])[:-1]]).astype(np.int64)
                scores[at:at + 256] = model.score(np.concatenate(bags), starts)
            out = b[["doc_id", "held_out"]].copy()
            out["doc_id"] = out["doc_id"].astype("Int64")
            out["score"] = scores
            out["predicted"] = (scores >= 0.5).astype("int32")
            yield out

    return rows.mapInPandas(run, "doc_id bigint, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **training) -> DataFrame:
    """``train`` on the labelled documents, then ``score`` all of them."""
    return score(docs, train(docs, labels, id_col, text_col, **training), id_col, text_col)


def keep_good(docs: DataFrame, model: AttentionModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores at least ``threshold``."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            keep: list[bool] = []
            for at in range(0, len(texts), 256):
                bags = [passages(t) for t in texts[at:at + 256]]
                starts = np.concatenate([[0], np.cumsum([len(x) for x in bags])[:-1]]).astype(np.int64)
                keep += (model.score(np.concatenate(bags), starts) >= threshold).tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))
            del texts
            release_memory()

    return docs.mapInArrow(run, docs.schema)
