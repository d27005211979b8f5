import pytest

from riskline.config import RiskConfig
from riskline.operators.fusion import classify

SCHEMA = (
    "event_id string, iso_anomaly_score double, rule_anomaly int, markov_score double, "
    "rule_attack_type string, iso_is_anomaly int, markov_is_anomaly int, login_failure_rate double, "
    "is_new_device int, unique_resources long, bytes_transferred long, is_night int"
)


def frame(spark, *rows):
    return spark.createDataFrame([(f"e{i}", *r) for i, r in enumerate(rows)], SCHEMA)


def fused(iso, rule, markov):
    return (iso, rule, markov, "none", 0, 0, 0.0, 0, 0, 0, 0)


def test_scores_and_levels(spark):
    df = frame(spark, fused(0.0, 0, 0.0), fused(0.2, 1, 0.4), fused(1.0, 1, 1.0))
    out = classify(df).orderBy("event_id").collect()
    assert [r.composite_score for r in out] == pytest.approx([0, 0.57, 1])
    assert [r.risk_score for r in out] == [0.0, 57.0, 100.0]
    assert [r.risk_level for r in out] == ["LOW", "HIGH", "CRITICAL"]


def test_constant_scores_and_nulls(spark):
    out = classify(frame(spark, fused(None, 0, None), fused(0.0, None, 0.0))).collect()
    assert {r.risk_score for r in out} == {0.0}


def test_weights(spark):
    cfg = RiskConfig(forest_weight=1.0, rule_weight=0.0, markov_weight=0.0)
    out = classify(frame(spark, fused(0.0, 1, 1.0), fused(0.5, 0, 0.0)), cfg).orderBy("event_id")
    assert [r.risk_score for r in out.collect()] == [0.0, 100.0]


def test_heuristic_order(spark):
    def odd(score, rate=0.0, device=0, resources=0, size=0, night=0):
        return (score, 0, 0.0, "none", 1, 0, rate, device, resources, size, night)

    df = frame(
        spark,
        odd(0.9, rate=0.41, device=1),
        odd(0.71, device=1),
        odd(0.7, device=1, resources=6),
        odd(0.0, resources=5, size=10_001),
        odd(0.0, size=10_000, night=1),
        odd(0.0),
        (0.0, 1, 0.0, "impossible_travel", 1, 1, 0.9, 1, 9, 0, 1),
        (0.0, 0, 0.0, "none", 0, 0, 0.9, 1, 9, 0, 1),
        (0.0, 0, 0.0, "none", 0, 1, 0.0, 0, 0, 0, 1),
    )
    got = [r.predicted_attack_type for r in classify(df).orderBy("event_id").collect()]
    assert got == [
        "brute_force", "device_spoofing", "lateral_movement", "low_and_slow_exfiltration",
        "insider_drift", "brute_force", "impossible_travel", "normal", "insider_drift",
    ]


def test_empty_log(spark):
    assert classify(frame(spark).limit(0)).count() == 0
