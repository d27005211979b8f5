"""The whole chain: invariants, cut users, streams against batch, and the SQL checks."""

import uuid

import pytest
from pyspark.sql import functions as F

from checks.compare import connect, difference
from checks.queries import QUERIES, RULES
from riskline.config import ForestConfig, ScaleConfig, ScoringConfig
from riskline.operators import rules as R
from riskline.operators.markov import MarkovModel
from riskline.operators.timeline import Timeline
from riskline.plans.scoring import fit_and_score
from riskline.schema import ATTACK_TYPES, FEATURES
from riskline.session import work_dir
from riskline.sources.activity import read_activity
from riskline.sources.events import read_event_stream
from riskline.streaming import jobs

from .helpers import MEDIUM, SMALL, assert_same, crowded_log

FOREST = ForestConfig(trees=20, sample_size=64)
CONFIG = ScoringConfig(rules=RULES, forest=FOREST)


@pytest.fixture(scope="module")
def fitted(spark):
    log = read_activity(spark, SMALL)
    model, scored = fit_and_score(log, CONFIG)
    return log, model, scored.cache()


def test_invariants_of_the_scored_log(fitted):
    log, _, scored = fitted
    assert scored.count() == log.count()
    ends = scored.agg(
        *[f(c) for c in ("iso_anomaly_score", "markov_score", "risk_score") for f in (F.min, F.max)]
    ).first()
    assert tuple(ends) == (0, 1, 0, 1, 0, 100)
    bad = [F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))) for c in FEATURES]
    assert set(scored.agg(*bad).first()) == {0}
    assert scored.select("risk_level").distinct().count() >= 2
    labels = {r[0] for r in scored.select("predicted_attack_type").distinct().collect()}
    assert labels <= {*ATTACK_TYPES, "normal"}
    share = scored.agg(F.avg("iso_is_anomaly")).first()[0]
    assert share == pytest.approx(0.08, abs=0.01)


def test_model_scores_its_own_batch_as_the_fit_did(fitted):
    log, model, scored = fitted
    assert_same(model.score(log), scored)


def test_cut_users_change_nothing(spark):
    log = crowded_log(spark)
    plain = fit_and_score(log, CONFIG)[1]
    small = ScoringConfig(rules=RULES, forest=FOREST, scale=ScaleConfig(100, 20))
    assert_same(plain, fit_and_score(log, small)[1])


def stream_of(spark, log, parts):
    """The log as a stream of files in time order, one per micro-batch."""
    folder = f"{work_dir(spark)}/input-{uuid.uuid4().hex}"
    rows = log.count()
    cuts = [log.approxQuantile("_t", [i / parts], 0.0)[0] for i in range(1, parts)]
    low = None
    for high in [*cuts, None]:
        part = log
        part = part if low is None else part.filter(F.col("_t") > low)
        part = part if high is None else part.filter(F.col("_t") <= high)
        part.drop("_t").coalesce(1).write.mode("append").parquet(folder)
        low = high
    assert spark.read.parquet(folder).count() == rows
    return read_event_stream(spark, folder, geo=True, maxFilesPerTrigger=1)


@pytest.fixture(scope="module")
def replayed(spark):
    log = read_activity(spark, SMALL)
    return log, stream_of(spark, log.withColumn("_t", F.unix_micros("timestamp").cast("double")), 4)


def finish(query, spark, out):
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 4, "four micro-batches"


def test_stream_of_new_devices_equals_the_rule(spark, replayed):
    log, events = replayed
    out = f"{work_dir(spark)}/out-{uuid.uuid4().hex}"
    finish(jobs.new_devices(events, out), spark, out)
    rule = next(r for r in R.default_rules(RULES) if r.name == "device_spoofing")
    want = R.flag_rows(log, rule).select("event_id", "user_id", "device_id")
    assert_same(jobs.read_alerts(spark, out).select("event_id", "user_id", "device_id"), want)


@pytest.mark.parametrize("order", [1, 2])
def test_stream_of_sequence_scores_equals_the_batch(spark, replayed, order):
    log, events = replayed
    model = MarkovModel.fit(log, CONFIG.markov.__class__(order=order))
    out = f"{work_dir(spark)}/out-{uuid.uuid4().hex}"
    finish(jobs.sequence_scores(events, out, model), spark, out)
    got = jobs.read_alerts(spark, out).select("event_id", "markov_raw")
    assert_same(got, model.raw_scores(log).select("event_id", "markov_raw"))


def test_stream_of_daily_totals_equals_the_rule(spark, replayed):
    log, events = replayed
    out = f"{work_dir(spark)}/out-{uuid.uuid4().hex}"
    finish(jobs.daily_exfiltration(events, out, RULES.exfiltration_kb), spark, out)
    rule = next(r for r in R.default_rules(RULES) if r.name == "low_and_slow_exfiltration")
    days = R.flag_rows(log, rule).select("user_id", F.to_date("timestamp").alias("event_date")).distinct()
    assert_same(jobs.latest_daily_exfiltration(spark, out).drop("moved"), days)


def test_stream_of_brute_force_counts_windows(spark, replayed):
    log, events = replayed
    out = f"{work_dir(spark)}/out-{uuid.uuid4().hex}"
    finish(jobs.brute_force(events, out, "3 days", "12 hours", 3), spark, out)
    failed = log.filter(F.col("event_type").isin("login", "vpn_login") & ~F.col("success"))
    want = failed.groupBy("user_id", F.window("timestamp", "3 days", "12 hours").start.alias("start")).agg(
        F.count(F.lit(1)).alias("failures")
    ).filter("failures >= 3")
    assert_same(jobs.latest_brute_force(spark, out).drop("end"), want)


def test_stream_of_risk_scores(spark, fitted, replayed):
    log, model, scored = fitted
    out = f"{work_dir(spark)}/out-{uuid.uuid4().hex}"
    finish(jobs.risk_scores(replayed[1], out, model), spark, out)
    got = jobs.read_alerts(spark, out)
    # Columns that look back only are the same as in batch; lifetime counts are as of the batch.
    columns = ["event_id", "cumulative_event_count", "event_type_entropy", "is_new_device", "seconds_since_prev"]
    assert_same(got.select(columns), scored.select(columns))


def test_a_batch_run_again_gives_the_same_result(spark, replayed):
    log, _ = replayed
    out = f"{work_dir(spark)}/out-{uuid.uuid4().hex}"
    half = log.filter(F.col("timestamp") < "2024-01-15")
    rest = log.filter(F.col("timestamp") >= "2024-01-15")
    steps = {}

    class Sink:
        """Catches the micro-batch function of a job."""

        def __getattr__(self, name):
            return lambda *a, **k: steps.setdefault("fn", a[0]) and self if name == "foreachBatch" else self

    class Stream:
        writeStream = Sink()

        def filter(self, *_):
            return self

        select = filter

    jobs.new_devices(Stream(), out)
    logins = ["user_id", "device_id", "timestamp", "event_id"]
    parts = [d.filter(F.col("event_type").isin("login", "vpn_login")).select(logins) for d in (half, rest)]
    steps["fn"](parts[0], 0)
    steps["fn"](parts[1], 1)
    once = jobs.read_alerts(spark, out).collect()
    steps["fn"](parts[1], 1)
    assert sorted(once) == sorted(jobs.read_alerts(spark, out).collect())


def test_timeline_is_only_cut_when_needed(spark):
    assert not Timeline.plan(read_activity(spark, SMALL)).sliced


CHECKED = [
    "conform_events", "sequential_event_id", "feature_matrix", "rules_combined", "rule_credential_stuffing",
    "rule_credential_stuffing_windowed", "rule_impossible_travel_geo", "rolling_unique_resources",
    "markov_threshold", "markov_score", "markov_score_raw_order2", "classify", "attack_summary",
    "entity_summary", "detector_agreement", "confusion_matrix", "risk_box_stats", "risk_histogram",
    "alert_topk", "sidebar_stats", "stream_daily_exfil",
]


@pytest.fixture(scope="module")
def sql():
    return connect(MEDIUM)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, sql, name):
    assert name in QUERIES
    assert difference(spark, sql, MEDIUM, name) is None
