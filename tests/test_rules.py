"""Rule boundaries on hand-made logs, with the production thresholds."""

import warnings

import pytest
from pyspark.sql import functions as F

from riskline.config import RuleConfig, ScaleConfig
from riskline.operators import rules as R
from riskline.operators.timeline import Timeline

from .helpers import column, make_log, positions

CUT = ScaleConfig(max_rows_per_slice=3)


def hits(spark, name, rows, scale=ScaleConfig()):
    log = make_log(spark, rows)
    rule = next(r for r in R.default_rules() if r.name == name)
    return positions(R.flag_rows(log, rule, scale=scale))


@pytest.fixture(params=["plain", "cut"])
def scale(request):
    return ScaleConfig() if request.param == "plain" else CUT


def test_brute_force_window_is_closed_and_flags_successes(spark, scale):
    rows = [{"at": t, "success": False} for t in (0, 60, 120, 180, 900)]
    rows += [{"at": 900}, {"at": 901}]
    assert hits(spark, "brute_force_login", rows, scale) == [4, 5]


def test_impossible_travel_bounds_are_strict(spark, scale):
    rows = [
        {"at": 0, "source_ip": "A"},
        {"at": 600, "source_ip": "B"},
        {"at": 700, "source_ip": "C", "event_type": "file_access"},
        {"at": 1500, "source_ip": "A"},
        {"at": 1500, "source_ip": "B"},
    ]
    assert hits(spark, "impossible_travel", rows, scale) == [1]


def test_credential_stuffing_counts_users_over_the_batch(spark):
    rows = [{"at": i * 86400, "user_id": f"u{i}", "source_ip": "X"} for i in range(1, 6)]
    rows += [{"at": i, "user_id": f"u{i}", "source_ip": "Y"} for i in range(1, 5)]
    rows += [{"source_ip": "X", "event_type": "file_access"}]
    assert hits(spark, "credential_stuffing", rows) == [0, 1, 2, 3, 4]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert hits(spark, "credential_stuffing", rows) == [0, 1, 2, 3, 4]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_windowed_stuffing_needs_the_users_together(spark, scale):
    rows = [{"at": i * 60, "user_id": f"u{i}", "source_ip": "X"} for i in range(5)]
    rows += [{"at": 100 + i * 3600, "user_id": f"u{i}", "source_ip": "Y"} for i in range(5)]
    log = make_log(spark, rows)
    rule = R.Rule(
        "w", "", "credential_stuffing", 4,
        batch=lambda df, hit: R.credential_stuffing_windowed(df, hit, cfg=RuleConfig(), scale=scale),
    )
    assert positions(R.flag_rows(log, rule)) == [4]


def test_lateral_movement_counts_distinct_resources(spark, scale):
    def visits(user, extra):
        rows = [
            {"user_id": user, "at": 60 * i, "resource": f"r{i + 1}", "event_type": "file_access"}
            for i in range(18)
        ]
        return rows + [
            {"user_id": user, "at": 60 * m, "resource": r, "event_type": "file_access"} for m, r in extra
        ]

    rows = visits("u1", [(120, "r1")]) + visits("u2", [(121, "r2")]) + visits("u3", [])[:17]
    assert hits(spark, "lateral_movement", rows, scale) == [17, 18, 36]


def test_device_spoofing_looks_at_logins_alone(spark, scale):
    rows = [{"device_id": d} for d in ("d1", "d1", "d2", "d2")]
    rows += [{"device_id": "d3", "event_type": "file_access"}, {"device_id": "d3"}]
    assert hits(spark, "device_spoofing", rows, scale) == [2, 5]


def test_exfiltration_bound_is_strict_and_skips_logins(spark, scale):
    day, move = 86400, "file_access"
    rows = [
        {"at": 0, "event_type": move, "bytes_transferred": 20_480_000},
        {"at": 1, "event_type": move, "bytes_transferred": 20_480_000},
        {"at": 2, "bytes_transferred": 5},
        {"at": day, "event_type": move, "bytes_transferred": 20_480_000},
        {"at": day + 1, "event_type": move, "bytes_transferred": 20_480_001},
    ]
    assert hits(spark, "low_and_slow_exfiltration", rows, scale) == [3, 4]


def test_insider_drift_compares_the_halves(spark, scale):
    # START is 09:00, so 14 hours later it is night.
    def user(name, first, night, rest):
        times = [60 * i for i in range(first)]
        times += [14 * 3600 + 60 * i for i in range(night)]
        times += [24 * 3600 + 60 * i for i in range(rest)]
        return [{"user_id": name, "at": t, "event_type": "logout"} for t in times]

    rows = user("a", 10, 4, 6) + user("b", 10, 3, 7) + user("c", 10, 9, 0)
    assert hits(spark, "insider_drift", rows, scale) == [10, 11, 12, 13]


def test_combined_columns(spark):
    log = spark.range(3).select(
        (F.col("id") == 0).alias("hit_brute_force_login"),
        F.lit(False).alias("hit_impossible_travel"),
        F.lit(False).alias("hit_credential_stuffing"),
        F.lit(False).alias("hit_lateral_movement"),
        (F.col("id") <= 1).alias("hit_device_spoofing"),
        F.lit(False).alias("hit_low_and_slow_exfiltration"),
        (F.col("id") == 1).alias("hit_insider_drift"),
        F.format_string("EVT-%06d", "id").alias("event_id"),
    )
    out = R.combine(log, R.default_rules()).orderBy("event_id").collect()
    assert [tuple(r[c] for c in R.RULE_COLUMNS) for r in out] == [
        (1, "brute_force_login,device_spoofing", 4, "brute_force"),
        (1, "device_spoofing,insider_drift", 4, "device_spoofing"),
        (0, "", 0, "none"),
    ]


def test_trigger_counts(spark):
    df = spark.createDataFrame([("a,b",), ("a",), ("",)], "rule_names string")
    assert [tuple(r) for r in R.rule_trigger_counts(df).collect()] == [("a", 2), ("b", 1)]


def test_rules_with_missing_columns_are_skipped_and_own_rules_run(spark):
    log = make_log(spark, [{"bytes_transferred": 7}, {}]).drop("device_id")
    own = R.Rule.where("big", "", "low_and_slow_exfiltration", 1, F.col("bytes_transferred") > 5)
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        out = R.evaluate(log, [*R.default_rules(), own], Timeline())
    assert any("device_spoofing skipped" in str(w.message) for w in seen)
    assert column(out, "rule_names") == ["big", ""]


def test_geo_travel_uses_the_distance(spark):
    log = make_log(spark, [{"at": 0}, {"at": 300}, {"at": 600}])
    places = {"EVT-000000": (40.7, -74.0), "EVT-000001": (51.5, -0.1), "EVT-000002": (51.6, -0.2)}
    geo = spark.createDataFrame(
        [(k, *v) for k, v in places.items()], "event_id string, latitude double, longitude double"
    )
    stage, condition = R.impossible_travel_geo(RuleConfig())
    rule = R.Rule.where("geo", "", "impossible_travel", 5, condition, stage)
    assert positions(R.flag_rows(log.join(geo, "event_id"), rule)) == [1]
