"""Exact top-k inner-product search with a pivot table.

Every vector's distances to a set of pivots are computed once.  For a query q and a candidate x the
triangle inequality gives ``|q-x| >= max_p |d(q,p) - d(x,p)|``, and with it the upper bound
``(|q|^2 + |x|^2 - lower^2) / 2`` of the inner product.  Candidates are scored in order of that
bound; as soon as the k-th best score lies above the next bound, the rest is eliminated, exactly.

Work is a grid: candidates in hashed blocks, queries in hashed blocks, one group a cell, top-k of a
query in each cell, then top-k of the cells.  Both block sizes are fixed, so a cell's memory is bounded
and identical vectors (however many) spread evenly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import bounded_sample, written

SCALE = 1024
TOP = 10
PIVOTS = 32
PIVOT_SAMPLE = 512
BLOCK = 2048
QUERY_BLOCK = 4096
_STEP = 256


def integer_vectors(frame: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """``_id, _v``: floor(scale * x) of each component, whole numbers as doubles; vectors that are null or hold a component
    that is null or not finite (scaled or not), and rows without id, are left out."""
    v = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x * scale)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    whole = lambda x: F.when(F.abs(x) < 2.0 ** 53, F.floor(x).cast("double")).otherwise(x)  # noqa: E731  (beyond, doubles are whole)
    return frame.select(F.col(id_col).cast("bigint").alias("_id"), v.alias("_x")) \
        .where(F.col("_id").isNotNull() & F.col("_x").isNotNull() & F.forall("_x", finite)) \
        .select("_id", F.transform("_x", whole).alias("_v"))


def choose_pivots(vectors: DataFrame, count: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> dict[int, np.ndarray]:
    """Up to ``count`` pivots for each vector length, farthest-first among ``sample`` vectors drawn by
    hash (a bounded sample; it moves the bounds, never the result)."""
    rows = bounded_sample(vectors, "_id", sample).collect()
    out: dict[int, np.ndarray] = {}
    for size in {len(r._v) for r in rows}:
        own = [r._v for r in rows if len(r._v) == size]
        x = np.array(own, np.float64).reshape(len(own), size)
        chosen = [0]
        gap = np.linalg.norm(x - x[0], axis=1)
        while len(chosen) < min(count, len(x)) and gap.max() > 0:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, np.linalg.norm(x - x[chosen[-1]], axis=1))
        out[size] = x[chosen]
    return out


def _with_distances(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    def measure(batches):
        for b in batches:
            rows = []
            for v in b["_v"]:
                x = np.asarray(v, np.float64)
                p = pivots.get(len(x))
                rows.append(np.linalg.norm(p - x, axis=1) if p is not None else np.zeros(0))
            yield b.assign(_d=rows)

    return vectors.mapInPandas(measure, "_id bigint, _v array<double>, _d array<double>")


def search_cell(q_ids, q, q_d, x_ids, x, x_d, k: int):
    """Top-k of each query among the candidates of one cell: yields (query id, vector id, score).
    All arrays hold vectors of one length, candidates in ascending id.  Candidates that share an id take
    one of the k places, with their best score."""
    repeats = bool((x_ids[1:] == x_ids[:-1]).any())
    big = int(max(np.abs(q).max(initial=0), 1)) * int(max(np.abs(x).max(initial=0), 1)) * max(q.shape[1], 1)
    xe, qe = (x, q) if big < 2 ** 52 else (_integers(x, big), _integers(q, big))     # below, doubles are exact
    with np.errstate(over="ignore", invalid="ignore"):
        xx, qq = (x ** 2).sum(1), (q ** 2).sum(1)
    for i in range(len(q)):
        with np.errstate(over="ignore", invalid="ignore"):
            lower = np.abs(x_d - q_d[i]).max(axis=1, initial=0.0)
            bound = (qq[i] + xx - lower * lower) / 2
            bound += 1e-9 * (qq[i] + xx) + 1                      # above any rounding of the distances
        bound[~np.isfinite(bound)] = np.inf                       # squares beyond doubles bound nothing
        order = np.argsort(-bound, kind="stable")
        ids, scores = np.zeros(0, np.int64), np.zeros(0, xe.dtype)
        for at in range(0, len(order), _STEP):
            if len(ids) >= k and scores[k - 1] > bound[order[at]]:
                break
            part = order[at:at + _STEP]
            part = part[x_ids[part] != q_ids[i]]
            ids, scores = np.concatenate([ids, x_ids[part]]), np.concatenate([scores, xe[part] @ qe[i]])
            best = np.lexsort((ids, -scores))
            if repeats:
                best = best[np.sort(np.unique(ids[best], return_index=True)[1])]
            ids, scores = ids[best[:k]], scores[best[:k]]
        for j, s in zip(ids.tolist(), scores.tolist()):
            yield int(q_ids[i]), j, int(s)


def _reported(score: int) -> tuple[int, str]:
    """A score as a long, the nearest one where it passes them; then a text by which those still sort exactly."""
    if -2 ** 63 < score < 2 ** 63:
        return score, ""
    digits = str(abs(score))
    if score > 0:
        return 2 ** 63 - 1, f"1{len(digits):04}{digits}"
    return -2 ** 63, f"0{9999 - len(digits):04}{digits.translate(str.maketrans('0123456789', '9876543210'))}"


def _integers(v: np.ndarray, big: int) -> np.ndarray:
    """Whole doubles as 64-bit integers where no inner product passes them, else as Python's, which have no end."""
    return v.astype(np.int64) if big < 2 ** 62 else np.array([[int(c) for c in row] for row in v], object).reshape(v.shape)


def top_k(frame: DataFrame, query_filter, k: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = SCALE, pivots: int = PIVOTS, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``query_filter`` (a condition on ``_id``)
    picks, its ``k`` highest inner products with all other rows, ties to the smaller id.

    Scores are whole numbers of any size and ranked as such; one beyond a long is reported as the nearest long.
    Vectors of different lengths are not compared.  Rows that share an id count as that id's own row
    (never each other's neighbours) and once in a result; empty tables give no rows; other columns are
    not looked at."""
    vectors = integer_vectors(frame, id_col, vector_col, scale)
    measured = written(_with_distances(vectors.dropDuplicates(["_id", "_v"]), choose_pivots(vectors, pivots)), "pivot-table")
    queries = measured.where(query_filter)
    n_block = max(1, -(-measured.count() // block))
    q_block = max(1, -(-queries.count() // query_block))
    own = lambda salt, n: F.expr(f"CAST(pmod(xxhash64(_id, {salt}), {n}) AS INT)")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("_q", own(1, q_block)).withColumn("_b", every(n_block))
    right = measured.withColumn("_b", own(2, n_block)).withColumn("_q", every(q_block))

    def cell(key, qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(qs) and len(xs):
            xs = xs.sort_values("_id")
            sizes_q, sizes_x = qs["_v"].map(len).to_numpy(), xs["_v"].map(len).to_numpy()
            stack = lambda col, width: np.array(col.tolist(), np.float64).reshape(len(col), width)
            for size in np.intersect1d(sizes_q, sizes_x):
                a, b = qs[sizes_q == size], xs[sizes_x == size]
                width = len(a["_d"].iloc[0])
                rows += [(q, x, *_reported(s)) for q, x, s in search_cell(
                    a["_id"].to_numpy(), stack(a["_v"], size), stack(a["_d"], width),
                    b["_id"].to_numpy(), stack(b["_v"], size), stack(b["_d"], width), k)]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score", "key"]).astype({"query_id": "int64", "vec_id": "int64", "score": "int64"})

    found = left.groupBy("_b", "_q").cogroup(right.groupBy("_b", "_q")).applyInPandas(
        cell, "query_id bigint, vec_id bigint, score bigint, key string")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.max("key").alias("key"))
    limits = F.col("score").isin(2 ** 63 - 1, -2 ** 63)           # the key of another row with this id says nothing
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.when(limits, F.col("key")).otherwise(F.lit(""))), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
