import math

import pytest
from pyspark.sql import functions as F

from riskline.functions import scalar as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_divisions(spark):
    assert one(spark, S.safe_divide(F.lit(3), F.lit(0))) == 0.0
    assert one(spark, S.safe_divide(F.lit(3), F.lit(0), 7)) == 7.0
    assert one(spark, S.safe_divide(F.lit(3), F.lit(-2))) == -1.5
    assert one(spark, S.safe_divide_positive(F.lit(3), F.lit(-2))) == 0.0


def test_haversine(spark):
    d = S.haversine_km(F.lit(40.7128), F.lit(-74.0060), F.lit(51.5074), F.lit(-0.1278))
    assert one(spark, d) == pytest.approx(5570.2, abs=0.5)
    antipodes = S.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))
    assert one(spark, antipodes) == pytest.approx(math.pi * 6371)


def test_bands(spark):
    scores = spark.createDataFrame([(s,) for s in (0.0, 24.9, 25.0, 50.0, 74.9, 75.0, 100.0)], "s double")
    got = [r.x for r in scores.select(S.risk_level("s").alias("x")).collect()]
    assert got == ["LOW", "LOW", "MEDIUM", "HIGH", "HIGH", "CRITICAL", "CRITICAL"]
    assert one(spark, S.risk_color(F.lit(60))) == "#e67e22"


def test_rounding_is_half_to_even(spark):
    assert one(spark, S.round_half_even(F.lit(2.25), 1)) == 2.2
    assert one(spark, S.round_half_even(F.lit(2.35), 1)) == 2.4


def test_labels(spark):
    assert one(spark, S.severity_of(F.lit("lateral_movement"))) == 5
    assert one(spark, S.severity_of(F.lit("normal"))) == 0
    assert one(spark, S.attack_type_title(F.lit("low_and_slow_exfiltration"))) == "Low And Slow Exfiltration"
    assert one(spark, S.severity_tier(F.lit(3))) == "yellow"
    assert one(spark, S.detector_source(F.lit(0), F.lit(1))) == "Isolation Forest"


def test_clean_numeric(spark):
    values = [(None,), (float("nan"),), (float("inf"),), (float("-inf"),), (1.5,)]
    df = spark.createDataFrame(values, "v double")
    assert [r.x for r in df.select(S.clean_numeric("v").alias("x")).collect()] == [0, 0, 0, 0, 1.5]


def test_log_prob_floor(spark):
    assert one(spark, S.log_prob(F.lit(0.0))) == pytest.approx(math.log(1e-12))
