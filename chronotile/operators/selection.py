"""Exact order statistics by selection (A6): histogram passes that narrow the range, no sort and no exchange of values.

Each pass counts the values between two bounds in ``BUCKETS`` equal parts, with the least and greatest value of every part
that holds any; at most that many rows reach the driver, whatever the size of the data. The part with the wanted rank gives
the next bounds; the search ends when the ranks are told apart from each other or a part holds one value only. The
bounds are values of the data, so every pass shrinks the range: n evenly spread values take about log(n) / log(BUCKETS) passes.

Nulls take no part. Infinities are values; NaN is greater than any other, as in Spark's order. An empty column gives None.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096


def _bucket(v: Column, lo: float, hi: float) -> Column:
    """Number of the part of [lo, hi] that holds ``v``: rising with ``v``, the first for lo, a later one for hi."""
    width = max(hi / BUCKETS - lo / BUCKETS, math.ulp(0.0))
    inside = F.least(F.lit(BUCKETS - 1), F.floor((v - F.lit(lo)) / F.lit(width)))
    return (F.when(F.isnan(v), F.lit(BUCKETS + 1)).when(v == float("inf"), F.lit(BUCKETS))
            .when(v == float("-inf"), F.lit(-1)).otherwise(inside).cast("int"))


def _histogram(values: DataFrame, lo: float, hi: float) -> list[tuple[float, float, int]]:
    """(least, greatest, rows) of every part that holds a value, in rising order."""
    v = F.col("v")
    rows = values.groupBy(_bucket(v, lo, hi).alias("part")).agg(F.min(v), F.max(v), F.count(v)).collect()
    return [tuple(r)[1:] for r in sorted(rows)]


def _at(parts: list[tuple[float, float, int]], rank: int) -> tuple[int, int]:
    """Place of the part that holds the rank (from 0), and the ranks before it."""
    before = 0
    for i, (_, _, n) in enumerate(parts):
        if rank < before + n:
            return i, before
        before += n
    raise ValueError(f"no rank {rank} in {before} values")


def exact_median(values: DataFrame, col: str) -> float | None:
    """The middle value of a numeric column, or the mean of the two in the middle. The column is read once for its bounds and
    once for every pass: store or checkpoint a column that is costly to compute."""
    v = F.col("v")
    values = values.select(F.col(col).cast("double").alias("v")).where(v.isNotNull())
    finite = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    lo, hi, n = values.agg(F.min(finite), F.max(finite), F.count(v)).first()
    if n == 0:
        return None
    first, second = (n - 1) // 2, n // 2
    parts = _histogram(values, lo if lo is not None else 0.0, hi if hi is not None else 0.0)
    while True:
        (i, before), (j, _) = _at(parts, first), _at(parts, second)
        if i != j:
            return (parts[i][1] + parts[j][0]) / 2
        lo, hi, _ = parts[i]
        if lo == hi or math.isnan(lo):
            return lo
        first, second = first - before, second - before
        parts = _histogram(values.where(v.between(lo, hi)), lo, hi)
