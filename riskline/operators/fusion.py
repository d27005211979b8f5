"""Weighted fusion of the three detectors into risk score, level and attack label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskline.config import RiskConfig
from riskline.functions import scalar as S
from riskline.operators.scaling import bounds, scaled


def composite_score(cfg: RiskConfig = RiskConfig()) -> Column:
    def part(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    return (
        F.lit(cfg.forest_weight) * part("iso_anomaly_score")
        + F.lit(cfg.rule_weight) * part("rule_anomaly")
        + F.lit(cfg.markov_weight) * part("markov_score")
    )


def risk_score(low: float | None, high: float | None) -> Column:
    """Batch min-max of the composite score in percent, one decimal, half to even."""
    return S.round_half_even(scaled("composite_score", low, high) * 100, 1)


def heuristic_attack_type() -> Column:
    """Best guess for an event that only the statistical detectors flag."""
    return (
        F.when(F.col("login_failure_rate") > 0.4, "brute_force")
        .when((F.col("is_new_device") == 1) & (F.col("iso_anomaly_score") > 0.7), "device_spoofing")
        .when(F.col("unique_resources") > 5, "lateral_movement")
        .when(F.col("bytes_transferred") > 10000, "low_and_slow_exfiltration")
        .when(F.col("is_night") == 1, "insider_drift")
        .otherwise("brute_force")
    )


def predicted_attack_type() -> Column:
    flagged = (F.col("iso_is_anomaly") == 1) | (F.col("markov_is_anomaly") == 1)
    return (
        F.when(F.col("rule_attack_type") != "none", F.col("rule_attack_type"))
        .when(flagged, heuristic_attack_type())
        .otherwise("normal")
    )


def label_risk(
    df: DataFrame, low: float | None, high: float | None, cfg: RiskConfig = RiskConfig()
) -> DataFrame:
    """Score, label, level and colour, given the bounds of the composite score."""
    df = df.withColumn("composite_score", composite_score(cfg))
    df = df.withColumn("risk_score", risk_score(low, high))
    return df.withColumns(
        {
            "predicted_attack_type": predicted_attack_type(),
            "risk_level": S.risk_level("risk_score", cfg.bands),
            "risk_color": S.risk_color("risk_score", cfg.bands),
        }
    )


def classify(df: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """Fuse detector columns; the bounds come from one aggregate over three columns."""
    low, high = bounds(df.select(composite_score(cfg).alias("composite_score")), "composite_score")
    return label_risk(df, low, high, cfg)
