"""Readers, writers and shaping of event logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskline.schema import EVENT_COLUMNS, EVENT_SCHEMA, GEO_COLUMNS, GEO_SCHEMA

DISPLAY_COLUMNS = (
    "event_id", "timestamp", "user_id", "username", "event_type", "source_ip",
    "device_id", "predicted_attack_type", "risk_score", "risk_level", "rule_names",
)


def conform_events(df: DataFrame) -> DataFrame:
    """Fixed column order and types; coordinates are kept where the source has them."""
    types = {f.name: f.dataType for f in [*EVENT_SCHEMA, *GEO_SCHEMA]}
    names = [*EVENT_COLUMNS, *[c for c in GEO_COLUMNS if c in df.columns]]
    return df.select([F.col(c).cast(types[c]).alias(c) for c in names])


def read_events(spark: SparkSession, path: str, format: str = "parquet", geo: bool = False, **options) -> DataFrame:
    """Read a log in the fixed schema (parquet, orc, json or csv), without inference."""
    schema = T.StructType([*EVENT_SCHEMA, *GEO_SCHEMA]) if geo else EVENT_SCHEMA
    return conform_events(spark.read.format(format).options(**options).schema(schema).load(path))


def read_event_stream(
    spark: SparkSession, path: str, format: str = "parquet", geo: bool = False, **options
) -> DataFrame:
    schema = T.StructType([*EVENT_SCHEMA, *GEO_SCHEMA]) if geo else EVENT_SCHEMA
    return conform_events(spark.readStream.format(format).options(**options).schema(schema).load(path))


def project_existing(df: DataFrame, columns: Sequence[str] = DISPLAY_COLUMNS) -> DataFrame:
    """The display columns that the frame has."""
    return df.select([c for c in columns if c in df.columns])


def save_scored(df: DataFrame, path: str) -> None:
    """Write a scored log for later queries, split by date so that they prune it.

    The rebalance lets AQE merge small dates and split a date that is too large for one
    file, by size, whatever the spread of events over the dates.
    """
    dated = df.withColumn("event_date", F.to_date("timestamp"))
    balanced = dated.hint("rebalance", F.col("event_date"))
    balanced.write.mode("overwrite").partitionBy("event_date").parquet(path)


def load_scored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
