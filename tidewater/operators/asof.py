"""Skew-safe as-of lookup: for each left row, the nearest right "time" on the same key.

A window per key would put a hot key (a third of all rows) into one task.  Here
rows are windowed per (key, time bucket), so a task holds one bucket of one key;
a small per-bucket summary carries the last right time across buckets.  Exact for
any data: the nearest right time is either in the row's own bucket or is the
latest one of an earlier bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SIDE = "_asof_side"      # 0 = right, 1 = left
_MIN_WIDTH = 1024


def auto_width(*cols_of: tuple[DataFrame, Column]) -> int:
    """A bucket width of about sqrt(time range): rows per bucket (times are unique per key)
    and buckets per key both stay near sqrt(range).  Reads two scalars from the data."""
    lo, hi = None, None
    for df, c in cols_of:
        row = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi")).first()
        if row["lo"] is not None:
            lo = row["lo"] if lo is None else min(lo, row["lo"])
            hi = row["hi"] if hi is None else max(hi, row["hi"])
    if lo is None:
        return _MIN_WIDTH
    return max(_MIN_WIDTH, int(math.isqrt(int(hi) - int(lo) + 1)) + 1)
_T = "_asof_t"
_B = "_asof_b"


def asof_time(left: DataFrame, right: DataFrame, by: list[str], left_t: Column, right_t: Column,
              width: int | None, out: str = "match_t", forward: bool = False, strict: bool = False) -> DataFrame:
    """Left rows plus column ``out``: the greatest right time <= left time (backward), or the
    least right time >= left time (``forward``); ``strict`` excludes equality.  Times are longs;
    ``width=None`` picks the bucket width from the data (:func:`auto_width`)."""
    if width is None:
        width = auto_width((left, left_t), (right, right_t))
    sign = -1 if forward else 1
    lft = left.withColumn(_T, left_t.cast("long") * sign).withColumn(_SIDE, F.lit(1))
    rgt = right.select(*by, (right_t.cast("long") * sign).alias(_T)).withColumn(_SIDE, F.lit(0))
    both = lft.unionByName(rgt, allowMissingColumns=True).withColumn(_B, F.floor(F.col(_T) / width))

    # Right rows sort before left rows at equal time (<=); after them when strict (<).
    tie = F.col(_SIDE) if not strict else -F.col(_SIDE)
    w = (Window.partitionBy(*by, _B).orderBy(F.col(_T), tie)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = F.max(F.when(F.col(_SIDE) == 0, F.col(_T))).over(w)
    marked = both.withColumn("_asof_within", within).where(F.col(_SIDE) == 1)

    # one row per (key, bucket) holding any row, with its latest right time (NULL if none)
    summary = both.groupBy(*by, _B).agg(F.max(F.when(F.col(_SIDE) == 0, F.col(_T))).alias("_asof_last"))
    carry_w = Window.partitionBy(*by).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.withColumn("_asof_carry", F.max("_asof_last").over(carry_w)).select(*by, _B, "_asof_carry")

    joined = marked.join(carry, on=[*by, _B], how="left")
    match = F.coalesce(F.col("_asof_within"), F.col("_asof_carry")) * sign
    return joined.withColumn(out, match).drop(_T, _SIDE, _B, "_asof_within", "_asof_carry")


def neighbour(df: DataFrame, by: list[str], seq: str, width: int | None, out: str,
              forward: bool = True, carry: list[str] | None = None) -> DataFrame:
    """The next (``forward``) or previous value of ``seq`` among rows with the same key; with ``carry``
    a struct of that row's ``seq`` and those columns.

    ``lead``/``lag`` within (key, bucket of ``seq``), and for the first/last row of a
    bucket the nearest value in the key's neighbouring non-empty bucket, taken from a
    per-bucket summary.  A hot key is spread over its buckets; ``seq`` must be unique
    per key.
    """
    if width is None:
        width = auto_width((df, F.col(seq)))
    value = F.struct(seq, *carry) if carry else F.col(seq)
    tagged = df.withColumn(_B, F.floor(F.col(seq) / width))
    w = Window.partitionBy(*by, _B).orderBy(seq)
    within = F.lead(value).over(w) if forward else F.lag(value).over(w)
    nearest = F.min_by if forward else F.max_by
    summary = tagged.groupBy(*by, _B).agg(nearest(value, F.col(seq)).alias("_edge"))
    ws = Window.partitionBy(*by).orderBy(_B)
    edge = F.lead("_edge").over(ws) if forward else F.lag("_edge").over(ws)
    summary = summary.select(*by, _B, edge.alias("_nb_edge"))
    joined = tagged.withColumn("_nb_within", within).join(summary, on=[*by, _B], how="left")
    return joined.withColumn(out, F.coalesce(F.col("_nb_within"), F.col("_nb_edge"))).drop(
        _B, "_nb_within", "_nb_edge")
