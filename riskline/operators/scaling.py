"""Batch-wide scaling and exact order statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1024


def bounds(df: DataFrame, column: str) -> tuple[float | None, float | None]:
    row = df.agg(F.min(column), F.max(column)).first()
    return row[0], row[1]


def scaled(value: Column | str, low: float | None, high: float | None) -> Column:
    """``(x - low) / (high - low)`` within 0 and 1, or zero where the range is empty.

    The bounds may be those of an earlier fit, which new values can exceed.
    """
    value = F.col(value) if isinstance(value, str) else value
    if low is None or high is None or high - low == 0:
        return F.lit(0.0)
    share = (value - F.lit(float(low))) / F.lit(float(high) - float(low))
    return F.when(share < 0, 0.0).when(share > 1, 1.0).otherwise(share)


def minmax_scale(df: DataFrame, column: str, name: str) -> DataFrame:
    """Min-max scale over the whole batch. The bounds are one aggregate, run at once."""
    x = F.col(column).cast("double")
    low, high = bounds(df.select(x.alias("_x")), "_x")
    return df.withColumn(name, scaled(x, low, high))


def standardize(df: DataFrame, columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Zero mean and unit population variance; a constant column becomes zero."""
    values = {c: F.col(c).cast("double") for c in columns}
    stats = df.agg(
        *[F.avg(x) for x in values.values()], *[F.stddev_pop(x) for x in values.values()]
    ).first()
    half = len(values)
    scaled_columns = {}
    for i, (c, x) in enumerate(values.items()):
        mean, spread = stats[i] or 0.0, stats[half + i] or 1.0
        scaled_columns[f"{c}{suffix}"] = (x - F.lit(mean)) / F.lit(spread)
    return df.withColumns(scaled_columns)


def _ranks(df: DataFrame, column: str, weight: str | None) -> tuple[DataFrame, dict[float, int]]:
    """The finite values with their weights, and the weight of the values that are not.

    Nulls have no rank. As in a sort, NaN stands after infinity.
    """
    x = F.col(column).cast("double")
    n = F.lit(1) if weight is None else F.col(weight)
    values = df.select(x.alias("_x"), n.cast("long").alias("_n")).filter(F.col("_x").isNotNull())
    odd = {"low": -math.inf, "high": math.inf, "nan": math.nan}
    kinds = F.when(F.isnan("_x"), "nan").when(F.col("_x") == -math.inf, "low").when(F.col("_x") == math.inf, "high")
    kinds = kinds.otherwise("finite")
    weights = {r[0]: r[1] for r in values.groupBy(kinds.alias("kind")).agg(F.sum("_n")).collect()}
    finite = values.filter(~F.isnan("_x") & (F.abs("_x") != math.inf))
    return finite, {"finite": weights.get("finite", 0), **{v: weights.get(k, 0) for k, v in odd.items()}}


def _finite_of_rank(values: DataFrame, k: int) -> tuple[float, int]:
    """The finite value of rank ``k`` and the weight up to and including it."""
    low, high = bounds(values, "_x")
    below = 0
    while True:
        # Halves, so that the range of no two doubles overflows.
        span = high / 2 - low / 2
        share = (F.col("_x") / 2 - F.lit(low / 2)) / F.lit(span or 1.0)
        bin_ = F.least(F.floor(share * BINS), F.lit(BINS - 1)) if span else F.lit(0)
        rows = (
            values.filter(F.col("_x").between(low, high))
            .groupBy(bin_.alias("_bin"))
            .agg(F.sum("_n"), F.min("_x"), F.max("_x"))
            .collect()
        )
        for _, n, lo, hi in sorted(rows):
            if below + n > k:
                # A bin is narrowed to the values found in it. Were all of them in one bin
                # again, for a range too small to divide, the ends are told apart.
                if lo == hi:
                    return lo, below + n
                if (lo, hi) == (low, high):
                    hi = values.filter((F.col("_x") >= lo) & (F.col("_x") < hi)).agg(F.max("_x")).first()[0]
                    inside = values.filter(F.col("_x").between(lo, hi)).agg(F.sum("_n")).first()[0]
                    if below + inside <= k:
                        return high, below + n
                low, high = lo, hi
                break
            below += n


def kth_smallest(df: DataFrame, column: str, k: int, weight: str | None = None) -> float:
    """The value of rank ``k`` (from 0), exact, without a global sort.

    Each pass counts the values in up to 1024 equal bins, partially aggregated, and
    goes on inside the bin that holds the rank. A bin is narrowed to the values found
    in it, so a value that a third of the rows share ends the search at once.
    ``weight`` names a column that says how often a row counts.
    """
    return _of_rank(*_ranks(df, column, weight), k)[0]


def _of_rank(values: DataFrame, kinds: dict, k: int) -> tuple[float, int]:
    lows, finite, highs = kinds[-math.inf], kinds["finite"], kinds[math.inf]
    if k < lows:
        return -math.inf, lows
    if k < lows + finite:
        value, upto = _finite_of_rank(values, k - lows)
        return value, lows + upto
    if k < lows + finite + highs:
        return math.inf, lows + finite + highs
    return math.nan, lows + finite + highs + kinds[math.nan]


def percentile(df: DataFrame, column: str, percent: float, weight: str | None = None) -> float | None:
    """Linearly interpolated percentile (0 to 100), exact, the same way at any size.

    Between a finite value and one that is not, it is the one that is not.
    """
    values, kinds = _ranks(df, column, weight)
    rows = sum(kinds.values())
    if rows == 0:
        return None
    place = percent / 100.0 * (rows - 1)
    k = math.floor(place)
    low, upto = _of_rank(values, kinds, k)
    if place == k or upto > k + 1 or not math.isfinite(low):
        return low
    high = _of_rank(values, kinds, k + 1)[0]
    return low + (place - k) * (high - low) if math.isfinite(high) else high


def percentile_threshold(df: DataFrame, column: str, percent: float) -> DataFrame:
    """The percentile as a one-row frame."""
    value = percentile(df, column, percent)
    return df.sparkSession.createDataFrame([(value,)], "threshold double")
