import numpy as np
import pytest
from pyspark.sql import functions as F

from riskline.operators.scaling import kth_smallest, minmax_scale, percentile, standardize


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(7)
    skewed = np.concatenate([rng.lognormal(0, 4, 3000), np.full(1500, 2.5), -rng.random(200)])
    rng.shuffle(skewed)
    return skewed


def frame(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "x double")


def test_kth_smallest_is_exact_with_a_heavy_value(spark, values):
    df = frame(spark, values).cache()
    ordered = np.sort(values)
    for k in (0, 1, 199, 200, 1700, 2500, len(values) - 1):
        assert kth_smallest(df, "x", k) == ordered[k]


@pytest.mark.parametrize("p", [0, 5, 8, 37.5, 92, 100])
def test_percentile_agrees_with_linear_interpolation(spark, values, p):
    df = frame(spark, values).cache()
    want = np.percentile(values, p)
    assert percentile(df, "x", p) == pytest.approx(want, rel=1e-12)
    twice = df.withColumn("w", F.lit(3))
    assert percentile(twice, "x", p, "w") == pytest.approx(np.percentile(np.repeat(values, 3), p), rel=1e-12)


def test_percentile_of_nothing(spark):
    assert percentile(frame(spark, []), "x", 5) is None


def test_minmax(spark):
    df = minmax_scale(frame(spark, [2, 4, 6]), "x", "y")
    assert sorted(r.y for r in df.collect()) == [0, 0.5, 1]
    constant = minmax_scale(frame(spark, [3, 3]), "x", "y")
    assert [r.y for r in constant.collect()] == [0, 0]
    assert minmax_scale(frame(spark, []), "x", "y").count() == 0


def test_standardize_uses_the_population_deviation(spark):
    df = standardize(frame(spark, [1, 2, 3, 4]).withColumn("c", F.lit(5)), ["x", "c"])
    assert sorted(r.x_z for r in df.collect()) == pytest.approx(
        list((np.arange(1, 5) - 2.5) / np.std([1, 2, 3, 4]))
    )
    assert {r.c_z for r in df.collect()} == {0.0}
