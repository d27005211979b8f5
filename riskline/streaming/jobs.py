"""Structured Streaming versions of the detectors.

Windowed counts use watermarked aggregation. The others run the batch operators on each
micro-batch together with what they must remember. That is kept as one folder per batch,
divided by a hash of its key, and a batch reads only the divisions its own keys are in. A batch
that is run again after a failure overwrites its own folder and reads only those of earlier
batches, so its result is the same. Other tables that a batch writes on its way are deleted
when it ends.

Every job takes a stream of events and an output folder on shared storage, and returns the
running query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskline.config import RuleConfig, ScaleConfig
from riskline.functions import scalar as S
from riskline.operators import rules as R
from riskline.operators.joins import lookup_join
from riskline.operators.markov import MarkovModel, context_stage
from riskline.operators.timeline import Timeline
from riskline.plans.scoring import ScoringModel
from riskline.session import materialize, scratch

BATCH, DIVISION = "batch", "division"
DIVISIONS = 64
Advance = Callable[[DataFrame, int], None]


def _each_batch(
    events: DataFrame, out: str, advance: Advance, mode: str = "append", trigger: str | None = None
) -> StreamingQuery:
    when = {"availableNow": True} if trigger is None else {"processingTime": trigger}

    def step(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            advance(batch, batch_id)

    return (
        events.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(**when)
        .foreachBatch(step)
        .start()
    )


def _write(df: DataFrame, out: str, table: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{out}/{table}/{BATCH}={batch_id}")


def _division(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(DIVISIONS)).cast("int")


def _keep(df: DataFrame, out: str, table: str, batch_id: int, key: str) -> None:
    """Remember rows for later batches."""
    divided = df.withColumn(DIVISION, _division(key))
    divided.write.mode("overwrite").partitionBy(DIVISION).parquet(f"{out}/{table}/{BATCH}={batch_id}")


def _earlier(batch: DataFrame, out: str, table: str, batch_id: int, key: str) -> DataFrame | None:
    """What earlier batches remembered of the keys in this one; nothing before the first one.

    Only the divisions of these keys are read, at most DIVISIONS numbers on the driver.
    """
    if batch_id == 0:
        return None
    wanted = [r[0] for r in batch.select(_division(key)).distinct().collect()]
    kept = batch.sparkSession.read.parquet(f"{out}/{table}")
    kept = kept.filter((F.col(BATCH) < batch_id) & F.col(DIVISION).isin(wanted)).drop(BATCH, DIVISION)
    keys = materialize(batch.select(F.struct(key).alias("_key")).distinct(), "batch-keys")
    return kept.withColumn("_key", F.struct(key)).join(keys, "_key", "left_semi").drop("_key")


def read_alerts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/alerts").drop(BATCH)


def brute_force(
    events: DataFrame,
    out: str,
    window: str = "15 minutes",
    slide: str = "1 minute",
    failures: int = RuleConfig.brute_force_failures,
    delay: str = "1 hour",
    trigger: str | None = None,
) -> StreamingQuery:
    """Users with many failed logins in a sliding window.

    Window-level alerts approximate the trailing window of the batch rule. Counts are
    merged before the shuffle, so a user under attack sends one row per window and task.
    """
    failed = events.filter(S.is_login() & ~F.col("success")).withWatermark("timestamp", delay)
    counts = failed.groupBy(F.window("timestamp", window, slide), "user_id").agg(
        F.count(F.lit(1)).alias("failures")
    )
    alerts = counts.filter(F.col("failures") >= failures).select(
        "user_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "failures"
    )
    return _each_batch(alerts, out, lambda df, i: _write(df, out, "alerts", i), "update", trigger)


def latest_brute_force(spark: SparkSession, out: str) -> DataFrame:
    """The last update of each window: its count only grows."""
    return read_alerts(spark, out).groupBy("user_id", "start", "end").agg(
        F.max("failures").alias("failures")
    )


def daily_exfiltration(
    events: DataFrame,
    out: str,
    daily_kb: float = RuleConfig.exfiltration_kb,
    delay: str = "1 day",
    trigger: str | None = None,
) -> StreamingQuery:
    """Users whose transfers of one day exceed the bound."""
    moved = events.filter(S.is_transfer()).withWatermark("timestamp", delay)
    totals = moved.groupBy(F.window("timestamp", "1 day"), "user_id").agg(
        F.sum("bytes_transferred").alias("moved")
    )
    alerts = totals.filter(F.col("moved") > F.lit(daily_kb * 1024)).select(
        "user_id", F.to_date("window.start").alias("event_date"), "moved"
    )
    return _each_batch(alerts, out, lambda df, i: _write(df, out, "alerts", i), "update", trigger)


def latest_daily_exfiltration(spark: SparkSession, out: str) -> DataFrame:
    return read_alerts(spark, out).groupBy("user_id", "event_date").agg(F.max("moved").alias("moved"))


def new_devices(events: DataFrame, out: str, trigger: str | None = None) -> StreamingQuery:
    """First login of a user from a device, unless it is the user's first login at all."""
    logins = events.filter(S.is_login()).select("user_id", "device_id", "timestamp", "event_id")

    def advance(batch: DataFrame, batch_id: int) -> None:
        # One row per user and device before anything is joined.
        first = F.min(F.struct("timestamp", "event_id")).alias("first")
        fresh = batch.groupBy("user_id", "device_id").agg(first)
        users = fresh.groupBy("user_id").agg(F.min("first").alias("_opening"))
        seen = _earlier(batch, out, "devices", batch_id, "user_id")
        if seen is not None:
            fresh = fresh.join(seen.select("user_id", "device_id"), ["user_id", "device_id"], "left_anti")
            known = seen.select("user_id").distinct()
            users = users.join(known, "user_id", "left_anti")
        fresh = lookup_join(fresh, users, ["user_id"])
        _keep(fresh.drop("_opening"), out, "devices", batch_id, "user_id")
        alerts = fresh.filter(F.col("_opening").isNull() | (F.col("first") > F.col("_opening")))
        _write(alerts.select("user_id", "device_id", "first.*"), out, "alerts", batch_id)

    return _each_batch(logins, out, advance, trigger=trigger)


def sequence_scores(
    events: DataFrame,
    out: str,
    model: MarkovModel,
    scale: ScaleConfig = ScaleConfig(),
    trigger: str | None = None,
) -> StreamingQuery:
    """Log-probability of every event under a fitted sequence model.

    The events of the batch's users, four narrow columns, are read back, so an event that comes
    late is scored after the events it follows in time, as far as they have come.
    """
    order = model.cfg.order
    columns = ["user_id", "timestamp", "event_id", "event_type"]

    def advance(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("_new", F.lit(True))
        past = _earlier(batch, out, "history", batch_id, "user_id")
        if past is not None:
            rows = rows.unionByName(past.withColumn("_new", F.lit(False)))
        timeline = Timeline.plan(rows, scale)
        rows = timeline.run(timeline.arrange(rows), context_stage(order))
        scored = model.label(model.score(rows.filter("_new")))
        _keep(batch, out, "history", batch_id, "user_id")
        _write(scored.select(*columns, "markov_raw", "markov_is_anomaly"), out, "alerts", batch_id)

    return _each_batch(events.select(*columns), out, advance, trigger=trigger)


def risk_scores(
    events: DataFrame, out: str, model: ScoringModel, trigger: str | None = None
) -> StreamingQuery:
    """Full risk scoring of each micro-batch with fitted detectors and frozen bounds.

    Features look back over the stored history of the users in the batch. Rules over addresses
    also count the users of earlier batches that are not in this one: their login pairs are
    remembered by address, each once.
    """

    def advance(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("_new", F.lit(True))
        past = _earlier(batch, out, "history", batch_id, "user_id")
        pairs = R.login_pairs(batch)
        known = _earlier(pairs, out, "logins", batch_id, "source_ip")
        if past is not None:
            rows = rows.unionByName(past.withColumn("_new", F.lit(False)))
            pairs = pairs.join(known, ["source_ip", "user_id"], "left_anti")
        rules = R.default_rules(model.cfg.rules, known)
        scored = model.score(rows, rules).filter("_new").drop("_new")
        _write(scored, out, "alerts", batch_id)
        _keep(batch, out, "history", batch_id, "user_id")
        _keep(pairs, out, "logins", batch_id, "source_ip")

    return _each_batch(events, out, advance, trigger=trigger)
