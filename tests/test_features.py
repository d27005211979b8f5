"""Features on hand-made logs, and equality of the plain and the cut plan."""

from datetime import datetime

import pytest

from riskline.config import ScaleConfig
from riskline.operators import features as FT
from riskline.operators.timeline import Timeline
from riskline.schema import FEATURES

from .helpers import assert_same, column, crowded_log, make_log


def add(log, stage):
    return FT.add_features(log, stage)


def test_running_entropy(spark):
    log = make_log(spark, [{"event_type": t} for t in ("login", "login", "file_access", "file_access")])
    got = column(add(log, FT.running_entropy()), "event_type_entropy")
    assert got == pytest.approx([-1.442695e-12, -1.442695e-12, 0.918296, 1.0], abs=1e-6)
    assert got[0] == pytest.approx(-1.442695e-12, rel=1e-3)


def test_entropy_counts_types_outside_the_vocabulary_apart(spark):
    log = make_log(spark, [{"event_type": t} for t in ("x", "y", "x", "z")])
    got = column(add(log, FT.running_entropy()), "event_type_entropy")
    assert got == pytest.approx([0, 1, 0.918296, 1.5], abs=1e-6)


def test_novelty(spark):
    log = make_log(spark, [{"device_id": d, "source_ip": d} for d in "abac"])
    out = add(log, FT.novelty_features())
    assert column(out, "cumulative_devices_seen") == [1, 2, 2, 3]
    assert column(out, "is_new_device") == [1, 1, 0, 1]
    assert column(out, "is_new_ip") == [1, 1, 0, 1]


def test_sequence(spark):
    log = make_log(
        spark,
        [{"at": 0}, {"at": 30, "event_type": "file_access"}, {"at": 90}, {"at": 86400}],
    )
    out = add(log, FT.sequence_features())
    assert column(out, "seconds_since_prev") == [-1, 30, 60, 86310]
    assert column(out, "minutes_since_prev")[:3] == pytest.approx([-1 / 60, 0.5, 1])
    assert column(out, "seconds_since_prev_same_type") == [-1, -1, 90, 86310]
    assert column(out, "cumulative_event_count") == [1, 2, 3, 4]
    assert column(out, "is_first_event_of_day") == [1, 0, 0, 1]
    assert column(out, "is_last_event_of_day") == [0, 0, 1, 1]


def test_night_and_calendar(spark):
    times = [(21, 59), (22, 0), (5, 59), (6, 0)]
    log = make_log(spark, [{"timestamp": datetime(2024, 3, 9, h, m)} for h, m in times])
    out = add(log, FT.temporal_features())
    assert column(out, "is_night") == [0, 1, 1, 0]
    assert column(out, "day_of_week") == [5] * 4 and column(out, "is_weekend") == [1] * 4
    assert column(out, "week_of_year") == [10] * 4


def test_login_failure_rate_only_on_logins(spark):
    log = make_log(
        spark,
        [{}, {"success": False}, {"event_type": "vpn_login", "success": False}, {"event_type": "file_access"}],
    )
    got = column(add(log, FT.frequency_features()), "login_failure_rate")
    assert got == pytest.approx([2 / 3, 2 / 3, 2 / 3, 0.0])


def test_ties_in_time_are_broken_by_event_id(spark):
    log = make_log(spark, [{"at": 5, "event_type": t} for t in ("login", "database_query", "login")])
    out = add(log, FT.transition_flags())
    assert column(out, "trans_login_to_database_query") == [0, 1, 0]


def test_matrix_has_the_43_columns(spark):
    log = make_log(spark, [{}, {"event_type": "logout"}])
    df = FT.feature_matrix(log)
    assert len(FEATURES) == 43
    assert sorted(FT.infer_feature_columns(df)) == sorted(FEATURES)
    assert df.columns[: len(log.columns)] == log.columns


def test_a_user_with_a_third_of_the_log_is_cut(spark):
    log = crowded_log(spark)
    cut = Timeline.plan(log, ScaleConfig(max_rows_per_slice=60))
    assert cut.sliced
    sizes = cut.cut.groupBy("user_id", "_slice").count()
    largest = sizes.agg({"count": "max"}).first()[0]
    assert largest <= 90, "about the slice size"
    assert not Timeline.plan(log, ScaleConfig(max_rows_per_slice=2000)).sliced


def test_a_burst_inside_a_slice_is_cut_again(spark):
    rows = [{"at": 86400 * i} for i in range(50)] + [{"at": 86400 * 20 + i} for i in range(200)]
    log = make_log(spark, rows)
    cut = Timeline.plan(log, ScaleConfig(max_rows_per_slice=25))
    assert cut.bursts
    assert cut.cut.groupBy("_slice").count().agg({"count": "max"}).first()[0] <= 25
    assert_same(FT.feature_matrix(log, Timeline()), FT.feature_matrix(log, cut))


def test_cut_plan_gives_the_same_matrix(spark):
    log = crowded_log(spark)
    cut = Timeline.plan(log, ScaleConfig(max_rows_per_slice=60))
    assert_same(FT.feature_matrix(log, Timeline()), FT.feature_matrix(log, cut))


def shuffles_of_the_log(df) -> int:
    """Exchanges between the result and the scan that feeds it, through left sides of joins."""
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    scan = next(i for i, line in enumerate(plan) if "Scan" in line)
    return sum("Exchange hashpartitioning" in line for line in plan[:scan])


def test_the_log_is_shuffled_once(spark):
    assert shuffles_of_the_log(FT.feature_matrix(crowded_log(spark), Timeline())) == 1


def test_the_log_is_shuffled_once_with_cut_users_and_large_carries(spark):
    log = crowded_log(spark)
    cut = Timeline.plan(log, ScaleConfig(max_rows_per_slice=60))
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        df = FT.feature_matrix(log, cut)
        assert shuffles_of_the_log(df) == 1
        assert_same(df, FT.feature_matrix(log, Timeline()))
    finally:
        spark.conf.set(threshold, before)
