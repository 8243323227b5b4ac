"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation.

1. One pass hashes each document's set of word shingles, its MinHash samples, the keys of its bands and
   an odd sketch: the samples folded into a bitmap of parities, so that the XOR of two sketches counts
   the samples that differ and with them estimates a high similarity.
2. Equal sets are one class, carried by its smallest id from here on.
3. In each band bucket every class is paired with the bucket's smallest; pairs whose sketches say
   ``loose`` or more make *families* (connected components).  What a bucket's smallest did not fit is
   compared with one another by sketch, in blocks of bounded size.
4. Families are cut into blocks of bounded size, and full sets are compared block against block inside
   tasks; only the links of a spanning forest come out, never all pairs.  First every block meets itself
   and the family's first block; then documents outside the family's largest component meet the rest, and
   of those only the ones whose sketches allow a link there.
5. Confirmed links make the components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Memo, mix64, release_memory, written
from tidewater.llm.components import components

THRESHOLD = 80                 # percent
BANDS, ROWS = 32, 5            # a pair at 80 % shares no band with probability (1 - 0.8^5)^32 = 3e-6
SKETCH_BITS = 512
LOOSE = 0.4
MARGIN = 0.16                  # five standard deviations of an estimate at 80 %
BLOCK = 384
MEMBER_BITS = 1 << 26

_K = BANDS * ROWS
_MULTIPLY = (mix64(np.arange(1, _K + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (mix64(np.arange(_K + 1, 2 * _K + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_FACTORS = mix64(np.arange(1001, 1065, dtype=np.uint64)) | np.uint64(1)
_SAMPLE = np.arange(_K, dtype=np.uint64) << np.uint64(32)
_BAND = mix64(np.arange(2001, 2001 + BANDS, dtype=np.uint64))
_WORDS = Memo(xxhash.xxh3_64_intdigest, 120_000)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles (A-Z lower-cased, ASCII white space);
    fewer words than a shingle make one shingle, none make an empty set."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, parts), np.uint64, len(parts))
    size = min(words, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out += h[j:j + n] * _FACTORS[j]
        out = mix64(out)
    return np.unique(out)


def minhashes(elements: np.ndarray) -> np.ndarray:
    """The MinHash samples of a non-empty set."""
    x = (elements >> np.uint64(32)).astype(np.uint32)
    out = np.full(_K, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        h = np.multiply.outer(_MULTIPLY, x[at:at + 2048])
        h += _ADD[:, None]
        np.minimum(out, h.min(axis=1), out=out)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    key = _BAND.copy()
    rows = samples.reshape(BANDS, ROWS).astype(np.uint64)
    for j in range(ROWS):
        key = mix64(key + rows[:, j])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parities of the samples' positions, as 64-bit words."""
    at = mix64(_SAMPLE | samples.astype(np.uint64)) & np.uint64(SKETCH_BITS - 1)
    odd = np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketch_similarity(differing):
    """Estimated Jaccard similarity from the number of differing sketch bits (a column)."""
    share = F.least(2 * differing / SKETCH_BITS, F.lit(0.999))
    return 1 + F.log(1 - share) * (SKETCH_BITS / 2) / (2 * _K)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """``_id, _n, _d1, _d2, _bands, _sketch`` of every row with an id (no bands for an empty set)."""
    def run(batches):
        for b in batches:
            rows = []
            for i, text in zip(b["_id"].tolist(), b["_text"]):
                s = shingles(text, words)
                if not len(s):
                    rows.append((i, 0, 0, 0, None, None))
                    continue
                d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                m = minhashes(s)
                rows.append((i, len(s), int(d[0]), int(d[1]), band_keys(m), odd_sketch(m)))
            yield pd.DataFrame(rows, columns=["_id", "_n", "_d1", "_d2", "_bands", "_sketch"])
            del rows
            release_memory()

    return docs.mapInPandas(run, "_id bigint, _n bigint, _d1 bigint, _d2 bigint, _bands array<bigint>, _sketch array<bigint>")


def _estimates(x: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Estimated similarities of the sketches ``x`` (rows of uint64) with the sketch ``one``."""
    differ = np.bitwise_count(x ^ one).sum(axis=1)
    return 1 + np.log(1 - np.minimum(2 * differ / SKETCH_BITS, 0.999)) * (SKETCH_BITS / 2) / (2 * _K)


def _sketches(frame: pd.DataFrame) -> np.ndarray:
    return np.array(frame["_sketch"].tolist(), np.int64).reshape(len(frame), -1).view(np.uint64)


def _near_in_bucket(loose: float):
    """A spanning forest of the pairs of one bucket (or of two of its blocks) that sketches call near."""
    def cell(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["rep", "block"])
        i, j = key[1], key[2]
        x, y = frame[frame["block"] == i], frame[frame["block"] == j]
        rows = []
        if len(x) and len(y):
            a, b = _sketches(x), _sketches(y)
            near = np.stack([_estimates(b, one) >= loose for one in a])
            rows = _forest(near, x["rep"].tolist(), y["rep"].tolist())
        return pd.DataFrame(rows, columns=["a", "b"]).astype("int64")

    return cell


def families(classes: DataFrame, loose: float = LOOSE, block: int = 1024) -> DataFrame:
    """``node, component`` over classes (``rep, _bands, _sketch``) that band buckets and sketches join."""
    rows = classes.select("rep", F.explode("_bands").alias("key"))
    sketches = classes.select("rep", "_sketch")
    centres = written(rows.groupBy("key").agg(F.min("rep").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
                      .select("key", "centre"), "band-centres")
    star = written(rows.join(centres, "key").where("rep <> centre"), "band-stars")
    pairs = star.select("centre", "rep").distinct() \
        .join(sketches.withColumnRenamed("_sketch", "_s"), "rep") \
        .join(sketches.select(F.col("rep").alias("centre"), F.col("_sketch").alias("_c")), "centre")
    differing = F.aggregate(F.zip_with("_s", "_c", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    judged = written(pairs.select("centre", "rep", (sketch_similarity(differing) >= loose).alias("near")), "band-pairs")
    near = judged.where("near").select(F.col("centre").alias("a"), F.col("rep").alias("b"))
    # what a bucket's smallest does not fit is compared with one another, by blocks of the bucket
    rest = written(star.join(judged.where("NOT near").select("centre", "rep"), ["centre", "rep"], "left_semi").select("rep", "key"), "band-rest")
    sizes = rest.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1") \
        .select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    placed = rest.join(written(sizes, "band-rest-sizes"), "key").join(sketches, "rep") \
        .withColumn("block", F.expr("CAST(pmod(xxhash64(rep), blocks) AS INT)")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = placed.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "block", "_sketch")
    more = cells.groupBy("key", "i", "j").applyInPandas(_near_in_bucket(loose), "a bigint, b bigint")
    return components(near.unionByName(more))


def _linked(left: list[bytes], right: list[bytes], percent: int) -> np.ndarray:
    """Which sets (sorted 64-bit hashes) of ``left`` and ``right`` are similar enough, as a matrix."""
    sizes = [np.array([len(s) // 8 for s in side]) for side in (left, right)]
    elements = [np.frombuffer(b"".join(side), np.uint64) for side in (left, right)]
    shared = np.intersect1d(*elements)
    common = np.zeros((len(left), len(right)), np.float32)
    columns = []
    for e, n in zip(elements, sizes):
        at = np.searchsorted(shared, e)
        hit = at < len(shared)
        hit[hit] = shared[at[hit]] == e[hit]
        columns.append((np.repeat(np.arange(len(n)), n)[hit], at[hit]))
    step = 4096
    order = [np.argsort(c[1], kind="stable") for c in columns]
    columns = [(c[0][o], c[1][o]) for c, o in zip(columns, order)]
    for at in range(0, len(shared), step):
        dense = []
        for (row, col), n in zip(columns, sizes):
            lo, hi = np.searchsorted(col, [at, at + step])
            m = np.zeros((len(n), min(step, len(shared) - at)), np.float32)
            m[row[lo:hi], col[lo:hi] - at] = 1
            dense.append(m)
        common += dense[0] @ dense[1].T
    inter = np.rint(common).astype(np.int64)
    union = sizes[0][:, None] + sizes[1][None, :] - inter
    return 100 * inter >= percent * union


def _forest(links: np.ndarray, left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """Links of a spanning forest of the bipartite graph ``links`` (ids may be on both sides)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in np.argwhere(links).tolist():
        a, b = find(left[i]), find(right[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((left[i], right[j]))
    return out


def _sets(frame: pd.DataFrame, words: int) -> tuple[list[int], list[bytes]]:
    frame = frame.drop_duplicates(["rep", "_text"])
    return frame["rep"].tolist(), [shingles(t, words).tobytes() for t in frame["_text"]]


def _texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``rep, _text`` of the documents that ``members`` names: a bitmap of fixed size over their ids
    keeps (nearly) all others from crossing the network."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(MEMBER_BITS))
    bitmap = np.zeros(MEMBER_BITS // 8, np.uint8)
    marks = members.select(slot("rep").alias("s")).groupBy(F.floor(F.col("s") / 32768).alias("k")) \
        .agg(F.bitmap_construct_agg(F.col("s") % 32768).alias("bits"))
    for m in marks.toLocalIterator():
        bitmap[m.k * 4096:(m.k + 1) * 4096] = np.frombuffer(m.bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def hits(batches):
        import pyarrow as pa
        bits = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            at = b.column(2).to_numpy(zero_copy_only=False)
            mask = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1) == 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["rep", "_text"]).filter(pa.array(mask))

    return docs.select("_id", "_text", slot("_id").alias("_slot")).mapInArrow(hits, "rep bigint, _text string")


def _near_rows(percent: int):
    """Which documents of a cell, by size and sketch, may be linked with one on its other side at all."""
    floor = percent / 100 - MARGIN

    def cell(key, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(x) and len(y):
            a, b = _sketches(x), _sketches(y)
            na, nb = x["_n"].to_numpy(float), y["_n"].to_numpy(float)
            near_b = np.zeros(len(y), bool)
            for i in range(len(x)):
                estimate = _estimates(b, a[i])
                fits = (np.minimum(nb, na[i]) * 100 >= percent * np.maximum(nb, na[i])) & (estimate >= floor)
                fits &= y["rep"].to_numpy() != x["rep"].iloc[i]
                if fits.any():
                    rows.append((*key, int(x["rep"].iloc[i]), 0))
                    near_b |= fits
            rows += [(*key, int(r), 1) for r in y["rep"].to_numpy()[near_b]]
        return pd.DataFrame(rows, columns=["family", "i", "j", "rep", "side"])

    return cell


def _links(docs: DataFrame, classes: DataFrame, family: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    """Confirmed links between classes of one family, as a forest."""
    sizes = family.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    members = written(family.join(sizes, "component").select(
        F.col("component").alias("family"), F.col("node").alias("rep"), F.ceil(F.col("size") / block).cast("int").alias("blocks")),
        "family-members").withColumn("block", F.expr("CAST(pmod(xxhash64(rep), blocks) AS INT)"))
    # every block with itself and with the family's first block
    full = members.join(_texts(docs, members), "rep")
    own = full.select("family", F.col("block").alias("i"), "rep", "_text", F.lit(0).alias("side"))
    first = full.where("block = 0 AND blocks > 1").select(
        "family", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)).alias("i"), "rep", "_text", F.lit(1).alias("side"))

    def own_cell(frame: pd.DataFrame) -> pd.DataFrame:
        ids, sets = _sets(frame[frame["side"] == 0], words)
        more, others = _sets(frame[frame["side"] == 1], words)
        rows = _forest(_linked(sets, sets + others, percent), ids, ids + more) if ids else []
        return pd.DataFrame(rows, columns=["a", "b"]).astype("int64")

    links = written(own.unionByName(first).groupBy("family", "i").applyInPandas(own_cell, "a bigint, b bigint"), "family-links")
    if members.where("blocks > 1").isEmpty():
        return links
    # then what lies outside the largest component of a family of many blocks, with all of its blocks
    labels = members.where("blocks > 1").join(components(links).withColumnRenamed("node", "rep"), "rep", "left") \
        .withColumn("component", F.coalesce("component", "rep"))
    counts = labels.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy("family").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("main"))
    outside = labels.join(largest, "family").where("component <> main")
    parts = outside.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    outside = written(outside.join(parts, "family").select("rep", "parts"), "family-outside")
    if outside.isEmpty():
        return links
    # sketches first: only documents that may be linked in a cell send their texts there
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    sketched = members.join(classes.select("rep", "_n", "_sketch"), "rep")
    columns = ["family", "i", "j", "rep", "_n", "_sketch"]
    left = sketched.join(outside, "rep").withColumn("i", F.expr("CAST(pmod(xxhash64(rep, 3), parts) AS INT)")) \
        .withColumn("j", spread(F.col("blocks"))).select(columns)
    right = sketched.join(written(parts, "family-parts"), "family").withColumn("j", F.col("block")) \
        .withColumn("i", spread(F.col("parts"))).select(columns).toDF(*columns)
    keys = ["family", "i", "j"]
    near = written(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        _near_rows(percent), "family bigint, i int, j int, rep bigint, side int"), "family-near")

    def cell(frame: pd.DataFrame) -> pd.DataFrame:
        ids, sets = _sets(frame[frame["side"] == 0], words)
        more, others = _sets(frame[frame["side"] == 1], words)
        rows = _forest(_linked(sets, others, percent), ids, more) if ids and more else []
        return pd.DataFrame(rows, columns=["a", "b"]).astype("int64")

    asked = near.select("rep").distinct()
    rest = near.join(_texts(docs, asked), "rep").groupBy(*keys).applyInPandas(cell, "a bigint, b bigint")
    return links.unionByName(written(rest, "family-more-links"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
                    loose: float = LOOSE, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: documents linked by sets with a Jaccard similarity of
    at least ``percent``; a component carries its smallest id, which is kept.

    Null, empty and blank texts have an empty set and are linked with nothing (each keeps itself); rows
    without id are no documents and are left out; rows that share an id are one document (a row each,
    linked through all of their texts); an empty table gives none; other columns are not looked at."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_id IS NOT NULL")
    signed = written(signatures(rows, words), "minhash")
    classes = written(signed.where("_n > 0").groupBy("_d1", "_d2").agg(
        F.min("_id").alias("rep"), F.min_by(F.struct("_n", "_bands", "_sketch"), "_id").alias("s"))
        .select("_d1", "_d2", "rep", "s._n", "s._bands", "s._sketch"), "minhash-classes")
    family = written(families(classes, loose), "families")
    found = written(components(_links(rows, classes, family, words, percent, block)), "near-components")
    carried = written(classes.select("_d1", "_d2", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
                      .select("_d1", "_d2", F.coalesce("component", "rep").alias("component")), "class-components")
    labelled = signed.where("_n > 0").join(carried, ["_d1", "_d2"]).select(
        F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), F.col("component").alias("component_id"))
    empty = signed.where("_n = 0").select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), F.col("_id").alias("component_id"))
    return labelled.unionByName(empty).withColumn("kept", F.col("doc_id") == F.col("component_id"))
