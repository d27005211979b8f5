"""Analyst queries over a scored log. Each returns a frame; none collects rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskline.functions import scalar as S
from riskline.schema import ATTACK_SEVERITY, ATTACK_TYPES

FEED_LEVELS = ("MEDIUM", "HIGH", "CRITICAL")
BINS = 50


def _alert_count() -> Column:
    return F.count_if(S.is_alert())


def _mean_risk() -> Column:
    """Mean risk score to one decimal; summed as decimals, so row order cannot change it."""
    exact = F.avg(F.col("risk_score").cast("decimal(18,10)"))
    return F.bround(exact, 1).cast("double")


def filter_alerts(df: DataFrame) -> DataFrame:
    return df.filter(S.is_alert())


def filter_alert_feed(
    df: DataFrame, types: Sequence[str] = ATTACK_TYPES, levels: Sequence[str] = FEED_LEVELS
) -> DataFrame:
    chosen = F.col("predicted_attack_type").isin(*types) & F.col("risk_level").isin(*levels)
    return df.filter(S.is_alert() & chosen)


def alert_topk(
    df: DataFrame,
    n: int = 50,
    types: Sequence[str] = ATTACK_TYPES,
    levels: Sequence[str] = FEED_LEVELS,
) -> DataFrame:
    """The n riskiest alerts of the feed. Filter first: the sort and limit become a top-k."""
    return filter_alert_feed(df, types, levels).orderBy(F.desc("risk_score"), "event_id").limit(n)


def alert_feed_counts(df: DataFrame, n: int = 50, types=ATTACK_TYPES, levels=FEED_LEVELS) -> DataFrame:
    """Alerts shown (the feed, at most n) and alerts in all."""
    chosen = F.col("predicted_attack_type").isin(*types) & F.col("risk_level").isin(*levels)
    return df.agg(
        F.least(F.count_if(S.is_alert() & chosen), F.lit(n).cast("long")).alias("shown"),
        _alert_count().alias("total"),
    )


def alert_detail_json(df: DataFrame) -> DataFrame:
    """One JSON object per alert; a column the log lacks gets its default."""

    def field(name: str, default) -> Column:
        return F.col(name) if name in df.columns else F.lit(default)

    detail = F.struct(
        "event_id",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        F.col("username").alias("user"),
        "user_id", "event_type", "source_ip", "device_id",
        field("resource", "N/A").alias("resource"),
        field("bytes_transferred", 0).alias("bytes_transferred"),
        "predicted_attack_type", "risk_score", "risk_level",
        field("rule_names", "").alias("rule_names"),
        S.round_half_even(field("iso_anomaly_score", 0.0), 4).alias("iso_anomaly_score"),
        S.round_half_even(field("markov_score", 0.0), 4).alias("markov_score"),
        field("is_attack", False).alias("is_attack_ground_truth"),
    )
    json = F.to_json(detail, {"ignoreNullFields": "false"})
    return df.select("event_id", json.alias("detail"))


def overview_kpis(df: DataFrame) -> DataFrame:
    facts = df.agg(
        F.count(F.lit(1)).alias("total_events"),
        _alert_count().alias("total_anomalies"),
        F.countDistinct("user_id").alias("unique_users"),
        F.countDistinct(F.to_date("timestamp")).alias("days_covered"),
    )
    rate = S.safe_divide("total_anomalies", "total_events") * 100
    average = S.safe_divide("total_events", F.col("unique_users") * F.col("days_covered"))
    return facts.withColumns(
        {
            "anomaly_rate_pct": S.round_half_even(rate, 2),
            "avg_events_day_user": S.round_half_even(average, 1),
        }
    )


def sidebar_stats(df: DataFrame) -> DataFrame:
    """Counts of the whole log next to the count and severity of every attack type."""
    types = df.sparkSession.createDataFrame(
        list(ATTACK_SEVERITY.items()), "attack_type string, severity int"
    )
    events, users, anomalies = df.agg(
        F.count(F.lit(1)), F.countDistinct("user_id"), _alert_count()
    ).first()
    rate = S.round_half_even(S.safe_divide(F.lit(anomalies), F.lit(events)) * 100, 1)
    counts = df.groupBy(F.col("predicted_attack_type").alias("attack_type")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # One row per label: eight at most.
    return types.join(F.broadcast(counts), "attack_type", "left").withColumns(
        {
            "n": F.coalesce("n", F.lit(0)),
            "title": S.attack_type_title("attack_type"),
            "tier": S.severity_tier("severity"),
            "events": F.lit(events),
            "users": F.lit(users),
            "anomalies": F.lit(anomalies),
            "anomaly_rate_pct": rate,
        }
    )


def daily_event_volume(df: DataFrame) -> DataFrame:
    """Events per calendar day, with the empty days between as zero."""
    daily = df.groupBy(F.to_date("timestamp").alias("event_date")).agg(F.count(F.lit(1)).alias("n"))
    span = daily.agg(F.min("event_date").alias("a"), F.max("event_date").alias("b"))
    days = span.filter(F.col("a").isNotNull()).select(
        F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("event_date")
    )
    return days.join(daily, "event_date", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def attack_type_distribution(df: DataFrame) -> DataFrame:
    counts = filter_alerts(df).groupBy("predicted_attack_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "predicted_attack_type")


def risk_histogram(df: DataFrame, bins: int = BINS) -> DataFrame:
    """Counts in equal bins of 0..100 by level; the top edge belongs to the last bin."""
    bin_ = F.least(F.width_bucket("risk_score", F.lit(0.0), F.lit(100.0), F.lit(bins)), F.lit(bins))
    return df.groupBy(bin_.cast("int").alias("bin"), "risk_level").agg(F.count(F.lit(1)).alias("n"))


def filter_entity(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.filter(F.col(key) == value)


def entity_values(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct().orderBy(key)


def entity_summary(df: DataFrame, key: str) -> DataFrame:
    """Events, anomalies, mean risk and attack types of every entity at once."""
    alert_type = F.when(S.is_alert(), F.col("predicted_attack_type"))
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("events"),
        _alert_count().alias("anomalies"),
        _mean_risk().alias("avg_risk"),
        F.countDistinct(alert_type).alias("attack_types"),
    )


def entity_timeline(df: DataFrame, key: str, value: str) -> DataFrame:
    return filter_entity(df, key, value).select(
        "timestamp", "event_type", "predicted_attack_type", "risk_score",
        "event_id", "source_ip", "device_id",
    ).orderBy("timestamp", "event_id")


def entity_risk_series(df: DataFrame, key: str, value: str) -> DataFrame:
    return filter_entity(df, key, value).select(
        "timestamp", "event_id", "risk_score",
        (F.col("risk_score") >= 50).alias("above_medium"),
        (F.col("risk_score") >= 75).alias("above_high"),
    ).orderBy("timestamp", "event_id")


def event_type_breakdown(df: DataFrame, key: str, value: str) -> DataFrame:
    counts = filter_entity(df, key, value).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "event_type")


def detector_agreement(df: DataFrame) -> DataFrame:
    """Pairwise counts include rows all three agree on; the `only` counts are exclusive."""
    iso, rule, mk = (F.col(c) == 1 for c in ("iso_is_anomaly", "rule_anomaly", "markov_is_anomaly"))
    cases: Mapping[str, Column] = {
        "All three": iso & rule & mk,
        "IF + Rule": iso & rule,
        "IF + Markov": iso & mk,
        "Rule + Markov": rule & mk,
        "IF only": iso & ~rule & ~mk,
        "Rule only": ~iso & rule & ~mk,
        "Markov only": ~iso & ~rule & mk,
    }
    counts = df.agg(*[F.count_if(c).alias(name) for name, c in cases.items()])
    return counts.unpivot([], list(cases), "agreement", "n")


def attack_by_detector(df: DataFrame) -> DataFrame:
    sources = ["Rule Engine", "Isolation Forest", "Markov"]
    alerts = filter_alerts(df).withColumn("detector_source", S.detector_source())
    return alerts.groupBy("predicted_attack_type").pivot("detector_source", sources).count().na.fill(0)


def hourly_attacks(df: DataFrame) -> DataFrame:
    hour = F.hour("timestamp").alias("hour")
    return filter_alerts(df).groupBy(hour, "predicted_attack_type").agg(F.count(F.lit(1)).alias("n"))


def risk_box_stats(df: DataFrame) -> DataFrame:
    """Box-plot figures by attack type.

    A risk score has one decimal, so the exact percentile counts at most 1001 values.
    """
    quartiles = F.percentile("risk_score", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = filter_alerts(df).groupBy("predicted_attack_type").agg(
        F.min("risk_score").alias("low"), quartiles.alias("_q"), F.max("risk_score").alias("high")
    )
    return stats.select(
        "predicted_attack_type", "low",
        F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"), "high",
    )


def confusion_matrix(df: DataFrame) -> DataFrame:
    flagged, actual = S.is_alert(), F.col("is_attack")
    counts = df.agg(
        F.count_if(flagged & actual).alias("tp"),
        F.count_if(flagged & ~actual).alias("fp"),
        F.count_if(~flagged & actual).alias("fn"),
        F.count_if(~flagged & ~actual).alias("tn"),
        F.count(F.lit(1)).alias("_n"),
    )
    p, r = F.col("precision"), F.col("recall")
    return (
        counts.withColumns(
            {
                "precision": S.safe_divide("tp", F.col("tp") + F.col("fp")),
                "recall": S.safe_divide("tp", F.col("tp") + F.col("fn")),
                "accuracy": S.safe_divide(F.col("tp") + F.col("tn"), "_n"),
            }
        )
        .withColumn("f1", S.safe_divide(2 * p * r, p + r))
        .drop("_n")
    )


def attack_summary(df: DataFrame) -> DataFrame:
    """Figures by attack type, and a total row that has no maximum, addresses or severity."""
    alerts = filter_alerts(df)
    known = alerts.filter(F.col("predicted_attack_type").isin(*ATTACK_TYPES))
    by_type = known.groupBy(F.col("predicted_attack_type").alias("attack_type")).agg(
        F.count(F.lit(1)).alias("n"),
        _mean_risk().alias("avg_risk_score"),
        S.round_half_even(F.max("risk_score"), 1).alias("max_risk_score"),
        F.countDistinct("user_id").alias("unique_users"),
        F.countDistinct("source_ip").alias("unique_ips"),
    ).withColumn("severity", S.severity_of("attack_type"))
    total = alerts.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(_mean_risk(), F.lit(0.0)).alias("avg_risk_score"),
        F.countDistinct("user_id").alias("unique_users"),
    ).withColumn("attack_type", F.lit("total"))
    return by_type.unionByName(total, allowMissingColumns=True)


def ground_truth_counts(df: DataFrame) -> DataFrame:
    """Events and share of the log by labelled attack type."""
    counts = df.groupBy("attack_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_attack").alias("attacks")
    )
    return counts.withColumn("share", S.safe_divide("n", F.lit(df.count())))


def column_entropy(df: DataFrame, key: str, column: str) -> DataFrame:
    """Shannon entropy in bits of a column's values within each key."""
    counts = df.groupBy(key, column).agg(F.count(F.lit(1)).cast("double").alias("c"))
    sums = counts.groupBy(key).agg(
        F.sum("c").alias("_n"),
        F.sum(F.col("c") * F.log2("c")).alias("_clogc"),
        F.count(F.lit(1)).alias("_values"),
    )
    floor = F.col("_values") * F.lit(S.LOG_FLOOR) / F.log(F.lit(2.0))
    entropy = F.log2("_n") - F.col("_clogc") / F.col("_n") - floor
    return sums.select(key, entropy.alias("entropy"))
