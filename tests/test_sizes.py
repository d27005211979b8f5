"""The same answer at every size: cut plans, percentiles, models stored and read back, streams."""

import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.queries import RULES
from riskline.config import ForestConfig, MarkovConfig, RuleConfig, ScaleConfig, ScoringConfig
from riskline.operators import rules as R
from riskline.operators.features import feature_matrix
from riskline.operators.markov import MarkovModel
from riskline.operators.scaling import kth_smallest, percentile
from riskline.operators.timeline import Timeline
from riskline.plans.scoring import ScoringModel, fit_and_score
from riskline.session import scratch, work_dir
from riskline.sources.activity import read_activity
from riskline.streaming import jobs

from .helpers import SMALL, assert_same, crowded_log, make_log
from .test_scoring import finish, stream_of

NULLABLE = ("event_type", "device_id", "resource", "source_ip", "user_id", "timestamp", "bytes_transferred", "success")


def gappy_log(spark):
    """A crowded log in which every nullable column is null for some rows."""
    log = crowded_log(spark)
    for i, c in enumerate(NULLABLE):
        gone = F.pmod(F.xxhash64("event_id", F.lit(i)), F.lit(5 if c == "event_type" else 9)) == 0
        log = log.withColumn(c, F.when(~gone, F.col(c)))
    return log


@pytest.mark.parametrize("limit", [40])
def test_cut_plan_equals_plain_plan_with_nulls(spark, limit):
    log = gappy_log(spark)
    cut = Timeline.plan(log, ScaleConfig(max_rows_per_slice=limit))
    assert cut.sliced
    assert_same(feature_matrix(log, Timeline()), feature_matrix(log, cut))
    assert_same(R.evaluate(log, None, Timeline(), RULES), R.evaluate(log, None, cut, RULES))


def test_a_null_value_is_not_an_absent_row(spark):
    log = make_log(spark, [{"event_type": t} for t in ("login", None, "database_query", "login", None, "login")])
    cut = Timeline.plan(log, ScaleConfig(max_rows_per_slice=1))
    assert_same(feature_matrix(log, Timeline()), feature_matrix(log, cut))


@pytest.mark.parametrize("null_user", [False, True])
def test_one_instant_is_divided(spark, null_user):
    """90 % of the rows in one microsecond, of one user or of none."""
    rows = [{"at": 0 if i % 10 else i, "resource": f"r{i % 23}", "event_type": "login" if i % 3 else "file_access",
             "success": i % 4 > 0, "user_id": None if null_user else "u1", "device_id": f"d{i % 5}"} for i in range(400)]
    log = make_log(spark, rows).repartition(4)
    cut = Timeline.plan(log, ScaleConfig(max_rows_per_slice=60))
    sizes = [r["count"] for r in cut.arrange(log).groupBy(*cut.keys).count().collect()]
    assert max(sizes) <= 150 and sum(sizes) == 400
    assert_same(feature_matrix(log, Timeline()), feature_matrix(log, cut))
    small = RuleConfig(lateral_resources=10, exfiltration_kb=0.0)
    assert_same(R.evaluate(log, None, Timeline(), small), R.evaluate(log, None, cut, small))


def test_plan_ends_without_times(spark):
    log = make_log(spark, [{} for _ in range(40)]).withColumn("timestamp", F.lit(None).cast("timestamp"))
    cut = Timeline.plan(log, ScaleConfig(max_rows_per_slice=5))
    assert_same(feature_matrix(log, Timeline()), feature_matrix(log, cut))


VALUES = {
    "nan": [*range(999), math.nan],
    "infinite": [-math.inf, -math.inf, 1.0, 2.0, 3.5, math.inf, math.nan],
    "wide": [-1.7e308, 0.0, 1.0, 1.7e308],
    "tiny": [0.0, 5e-324, 5e-324, 1e-323],
    "ties": [3.0] * 50 + [1.0, 9.0],
}


@pytest.mark.parametrize("name", VALUES)
def test_ranks_with_odd_values(spark, name):
    values = VALUES[name]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    ordered = np.sort(values)  # NaN last
    for k in {0, 1, len(values) // 3, len(values) - 2, len(values) - 1}:
        assert kth_smallest(df, "x", k) == pytest.approx(ordered[k], nan_ok=True)
    if name in ("nan", "ties"):
        assert percentile(df, "x", 30) == pytest.approx(np.sort(values)[math.floor(0.3 * (len(values) - 1))], abs=1)


def test_models_keep_their_settings(spark, tmp_path):
    log = read_activity(spark, SMALL)
    cfg = ScoringConfig(rules=RULES, markov=MarkovConfig(order=2), forest=ForestConfig(trees=10, sample_size=300))
    model, scored = fit_and_score(log, cfg)
    model.save(str(tmp_path / "chain"))
    again = ScoringModel.load(spark, str(tmp_path / "chain"))
    assert again.cfg == cfg and again.markov.cfg.order == 2 and again.forest.cfg.sample_size == 300
    assert_same(again.score(log), scored)
    markov = MarkovModel.fit(log, MarkovConfig(order=3, smoothing=1e-4))
    markov.save(str(tmp_path / "markov"))
    assert_same(MarkovModel.load(spark, str(tmp_path / "markov")).raw_scores(log), markov.raw_scores(log))


def test_scores_stay_in_range_beyond_the_fit(spark):
    log = read_activity(spark, SMALL)
    cfg = ScoringConfig(rules=RULES, forest=ForestConfig(trees=10, sample_size=64))
    model, _ = fit_and_score(log.filter(F.col("event_type").isin("logout", "file_access")), cfg)
    ends = model.score(log).agg(*[f(c) for c in ("markov_score", "iso_anomaly_score", "risk_score") for f in (F.min, F.max)]).first()
    assert all(0 <= e <= 1 for e in ends[:4]) and 0 <= ends[4] and ends[5] <= 100


def test_stream_counts_users_of_earlier_batches(spark):
    """Every batch sees the address hits of the log up to it, also of users who are quiet now."""
    rows = [{"at": 100 * i, "user_id": f"u{i}", "source_ip": "X"} for i in range(8)]
    rows += [{"at": 100 * i + 50, "user_id": "u9", "source_ip": "Y"} for i in range(8)]
    log = make_log(spark, rows)
    for c in ("latitude", "longitude"):
        log = log.withColumn(c, F.lit(None).cast("double"))
    log = log.withColumn("city", F.lit(None).cast("string"))
    cfg = ScoringConfig(forest=ForestConfig(trees=5, sample_size=8))
    model, _ = fit_and_score(log, cfg)
    events = stream_of(spark, log.withColumn("_t", F.unix_micros("timestamp").cast("double")), 4)
    out = f"{work_dir(spark)}/out-{uuid.uuid4().hex}"
    finish(jobs.risk_scores(events, out, model), spark, out)
    got = {r.event_id: "credential_stuffing" in r.rule_names for r in jobs.read_alerts(spark, out).collect()}
    # Batches hold users 0-1, 2-3, 4-5 and 6-7 of address X; the bound is five users.
    want = {f"EVT-{i:06d}": i in (4, 5, 6, 7) for i in range(16)}
    assert got == want


def test_late_events_of_a_stream_have_a_context(spark):
    log = read_activity(spark, SMALL)
    model = MarkovModel.fit(log)
    late = log.withColumn("_t", F.pmod(F.xxhash64("event_id"), F.lit(1000)).cast("double"))
    events = stream_of(spark, late, 4)
    out = f"{work_dir(spark)}/out-{uuid.uuid4().hex}"
    finish(jobs.sequence_scores(events, out, model), spark, out)
    got = jobs.read_alerts(spark, out)
    assert got.count() == log.count()
    alone = got.filter("markov_raw = 0").count()
    assert alone < 0.35 * log.count()


def test_scratch_tables_go(spark):
    from riskline.session import materialize

    with scratch(spark):
        table = materialize(spark.range(3), "gone")
        assert table.count() == 3
        path = table.inputFiles()[0].rpartition("/")[0]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def test_a_larger_log_has_more_tasks_not_larger_ones(spark):
    """The layout follows the rows, not the stored bytes that adaptive execution goes by."""
    log = read_activity(spark, SMALL)
    many = log.join(spark.range(40).withColumnRenamed("id", "copy")).withColumn("user_id", F.concat("user_id", F.lit("-"), "copy")).drop("copy")
    scale = ScaleConfig(rows_per_task=1000)
    timeline = Timeline.plan(many, scale)
    sizes = timeline.arrange(many).groupBy(F.spark_partition_id()).count()
    assert timeline.tasks == 40 and sizes.agg(F.max("count")).first()[0] < 3000
    assert Timeline.plan(log, scale).tasks is None
