"""Joins of the log with a lookup table whose keys may be very unevenly used."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from riskline.session import materialize


def lookup_join(log: DataFrame, lookup: DataFrame, keys: Sequence[str], stored: bool = False) -> DataFrame:
    """Left join with a table that has one row per key.

    The table is written first (unless it is ``stored`` already), so Spark knows its bytes: below
    ``spark.sql.autoBroadcastJoinThreshold`` it is broadcast and the log stays where it
    is. Beyond, the log moves by the key, and adaptive execution splits the partitions of
    keys that much of the log carries.
    """
    if not stored:
        lookup = materialize(lookup, "lookup")
    return log.join(lookup, list(keys), "left")
