"""Scores from a user's state against scores from the whole history up to each batch."""

import pytest
from pyspark.sql import functions as F

from checks.queries import CONFIG
from riskline.config import ForestConfig, ScoringConfig
from riskline.plans.scoring import fit_and_score
from riskline.schema import FEATURES
from riskline.streaming import jobs, scoring

from .helpers import assert_same
from .test_keyed import log, place, stream  # noqa: F401


@pytest.mark.parametrize("order", [1, 2])
def test_equals_scores_from_the_whole_history(spark, log, order):  # noqa: F811
    """Every feature, rule column and score, with missing users and devices and ties in time."""
    log = log.filter("timestamp IS NOT NULL").withColumn("success", F.when(F.pmod(F.xxhash64("event_id"), F.lit(50)) != 7, F.col("success")))
    cfg = ScoringConfig(rules=CONFIG.rules, forest=ForestConfig(trees=20, sample_size=64), markov=CONFIG.markov.__class__(order=order))
    model = fit_and_score(log, cfg)[0]
    cuts = [r[0] for r in log.selectExpr("explode(percentile(unix_micros(timestamp), array(0.25, 0.5, 0.75)))").collect()]
    number = sum(((F.unix_micros("timestamp") > c).cast("int") for c in cuts), F.lit(0))
    parts = [log.filter(number == i) for i in range(4)]
    outs = place(spark), place(spark)
    jobs.risk_scores(stream(spark, parts), outs[0], model).awaitTermination()
    scoring.risk_scores(stream(spark, parts), outs[1], model, partitions=2).awaitTermination()
    columns = ["event_id", "rule_names", "rule_severity", "rule_attack_type", "predicted_attack_type", "risk_level"]
    numbers = [c for c in FEATURES if c != "success"] + ["iso_anomaly_score", "markov_score", "risk_score"]
    want, got = (
        jobs.read_alerts(spark, out).select(*columns, "success", *[F.round(F.col(c).cast("double"), 7).alias(c) for c in numbers]) for out in outs
    )
    rules = {n for r in want.select("rule_names").distinct().collect() for n in r[0].split(",")}
    assert len(rules - {""}) >= 6
    for c in [*columns[1:], *numbers]:
        assert_same(got.select("event_id", c), want.select("event_id", c))


def test_a_batch_reads_nothing_of_earlier_ones(spark, log):  # noqa: F811
    model = fit_and_score(log, ScoringConfig(rules=CONFIG.rules, forest=ForestConfig(trees=5, sample_size=32)))[0]
    out = place(spark)
    scoring.risk_scores(stream(spark, [log.limit(200), log.limit(0), log.limit(50)]), out, model, partitions=2).awaitTermination()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(out)
    names = {s.getPath().getName() for s in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)}
    assert names == {"alerts", "checkpoint"}
    assert jobs.read_alerts(spark, out).count() == 250
