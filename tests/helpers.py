"""Small logs and comparisons for the tests."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskline.schema import EVENT_SCHEMA
from riskline.sources.activity import read_activity

START = datetime(2024, 3, 4, 9, 0, 0)
SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


def make_log(spark, rows: list[dict]) -> DataFrame:
    """A log from partial rows; ``at`` is in seconds after START, ids follow the order."""
    filled = []
    for i, row in enumerate(rows):
        at = row.get("timestamp") or START + timedelta(seconds=row.get("at", i))
        filled.append(
            (
                row.get("event_id", f"EVT-{i:06d}"), at, row.get("user_id", "u1"),
                row.get("username", "name"), row.get("event_type", "login"),
                row.get("source_ip", "10.0.0.1"), row.get("device_id", "d1"), "IT",
                row.get("resource", "r1"), row.get("success", True),
                row.get("bytes_transferred", 0), row.get("is_attack", False),
                row.get("attack_type", "none"),
            )
        )
    return spark.createDataFrame(filled, EVENT_SCHEMA)


def positions(df: DataFrame) -> list[int]:
    """Positions of the rows in the list a log was made from."""
    return sorted(int(r.event_id[4:]) for r in df.select("event_id").collect())


def column(df: DataFrame, name: str) -> list:
    return [r[name] for r in df.orderBy("event_id").select("event_id", name).collect()]


def crowded_log(spark, folder: str = SMALL) -> DataFrame:
    """The activity log with a third of its rows moved to one user."""
    log = read_activity(spark, folder)
    third = F.pmod(F.xxhash64("event_id"), F.lit(3)) == 0
    return log.withColumn("user_id", F.when(third, "user_0001").otherwise(F.col("user_id")))


def rounded(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(
        [F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in sorted(df.columns)]
    )


def assert_same(left: DataFrame, right: DataFrame) -> None:
    """Same columns and same rows, fractions to six digits; not empty."""
    left, right = rounded(left), rounded(right)
    assert left.columns == right.columns
    a = sorted(map(repr, left.collect()))
    b = sorted(map(repr, right.collect()))
    assert a, "nothing to compare"
    assert a == b
