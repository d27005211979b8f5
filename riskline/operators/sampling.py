"""Numbering, exact-size sampling and appending of labelled rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskline.config import ScaleConfig
from riskline.operators.scaling import kth_smallest
from riskline.operators.timeline import Running, Stage, Timeline


def sequential_event_id(
    df: DataFrame,
    order: Sequence[str] = ("timestamp", "event_id"),
    name: str = "event_id",
    scale: ScaleConfig = ScaleConfig(),
) -> DataFrame:
    """Number the events in time order as ``EVT-000000``, ``EVT-000001``, ...

    The whole log is one timeline: past the slice size it is numbered per time slice,
    with the count of the earlier slices added.
    """
    log = df.withColumn("_log", F.lit(0))
    timeline = Timeline.plan(log, scale, key="_log", order=order)
    stage = Stage(
        whole={"_pos": Running(F.lit(1))},
        early={name: F.format_string("EVT-%06d", F.col("_pos") - 1)},
    )
    return timeline.run(timeline.arrange(log), stage).drop("_log", *timeline.keys)


def draw(column: str, seed: int) -> Column:
    """52 bits of the value's MD5, which other engines have too; exact as a double."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(column).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def sample_normal_rows(df: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """Random sample of normal rows whose size is a share of all rows, exactly.

    Rows with the smallest hashes of their id are taken: the cutoff is an exact order statistic,
    so the sample is a filter and is never gathered in one place. Only the rows of the
    hash at the cutoff, copies of one id as a rule, are numbered to fill the size.
    """
    total = df.count()
    normal = df.filter(~F.col("is_attack"))
    size = max(1, int(total * ratio))
    ranked = normal.withColumn("_h", draw("event_id", seed))
    available = ranked.count()
    if available <= size:
        return normal
    cut = int(kth_smallest(ranked, "_h", size - 1))
    below = ranked.filter(F.col("_h") < cut)
    tied = ranked.filter(F.col("_h") == cut).limit(size - below.count())
    return below.unionByName(tied).drop("_h")


def append_labeled(log: DataFrame, extra: DataFrame) -> DataFrame:
    """Append rows; columns that only one side has are null on the other."""
    return log.unionByName(extra, allowMissingColumns=True)


def apply_appends(log: DataFrame, extras: Iterable[DataFrame]) -> DataFrame:
    return reduce(append_labeled, extras, log)
