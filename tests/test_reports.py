from datetime import datetime

import pytest

from riskline.plans import reports
from riskline.sources.events import load_scored, project_existing, read_events, save_scored

from .helpers import make_log

SCHEMA = (
    "event_id string, timestamp timestamp, user_id string, username string, event_type string, "
    "source_ip string, device_id string, predicted_attack_type string, risk_score double, "
    "risk_level string, iso_is_anomaly int, rule_anomaly int, markov_is_anomaly int, is_attack boolean"
)


@pytest.fixture(scope="module")
def log(spark):
    def row(i, day, label, score, level, flags, truth, user="u1"):
        return (
            f"e{i}", datetime(2024, 3, day, 10), user, "name", "login", "ip", "dev",
            label, score, level, *flags, truth,
        )

    return spark.createDataFrame(
        [
            row(0, 1, "brute_force", 90.0, "CRITICAL", (1, 1, 1), True),
            row(1, 1, "brute_force", 30.1, "MEDIUM", (1, 1, 0), False),
            row(2, 3, "normal", 2.0, "LOW", (0, 0, 0), True, "u2"),
            row(3, 3, "normal", 0.0, "LOW", (0, 0, 0), False, "u2"),
            row(4, 3, "insider_drift", 100.0, "CRITICAL", (0, 0, 1), True, "u2"),
        ],
        SCHEMA,
    )


def test_daily_volume_fills_gaps(log):
    got = reports.daily_event_volume(log).orderBy("event_date").collect()
    assert [r.n for r in got] == [2, 0, 3]


def test_detector_agreement(log):
    got = {r.agreement: r.n for r in reports.detector_agreement(log).collect()}
    assert got == {
        "All three": 1, "IF + Rule": 2, "IF + Markov": 1, "Rule + Markov": 1,
        "IF only": 0, "Rule only": 0, "Markov only": 1,
    }


def test_confusion(log):
    r = reports.confusion_matrix(log).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 1)
    assert (r.precision, r.recall, r.f1) == pytest.approx((2 / 3, 2 / 3, 2 / 3))
    assert r.accuracy == pytest.approx(0.6)


def test_confusion_of_nothing(log):
    r = reports.confusion_matrix(log.limit(0)).first()
    assert (r.precision, r.recall, r.f1, r.accuracy) == (0, 0, 0, 0)


def test_kpis_and_sidebar(log):
    k = reports.overview_kpis(log).first()
    assert (k.total_events, k.total_anomalies, k.unique_users, k.days_covered) == (5, 3, 2, 2)
    assert (k.anomaly_rate_pct, k.avg_events_day_user) == (60.0, 1.2)
    side = {r.attack_type: r.n for r in reports.sidebar_stats(log).collect()}
    assert len(side) == 7 and side["brute_force"] == 2 and side["device_spoofing"] == 0
    assert reports.sidebar_stats(log.limit(0)).count() == 7


def test_topk_and_feed(log):
    assert [r.event_id for r in reports.alert_topk(log, 2).collect()] == ["e4", "e0"]
    assert reports.alert_feed_counts(log, 2).first().asDict() == {"shown": 2, "total": 3}
    only = reports.filter_alert_feed(log, types=["insider_drift"])
    assert [r.event_id for r in only.collect()] == ["e4"]


def test_histogram_puts_100_in_the_last_bin(log):
    got = {(r.bin, r.risk_level): r.n for r in reports.risk_histogram(log).collect()}
    assert got == {(46, "CRITICAL"): 1, (16, "MEDIUM"): 1, (2, "LOW"): 1, (1, "LOW"): 1, (50, "CRITICAL"): 1}


def test_summary_has_a_total_row(log):
    got = {r.attack_type: r for r in reports.attack_summary(log).collect()}
    assert got["brute_force"].avg_risk_score == 60.0 and got["brute_force"].severity == 4
    assert got["total"].n == 3 and got["total"].severity is None


def test_cross_tab_and_detail(log):
    cross = {r.predicted_attack_type: r for r in reports.attack_by_detector(log).collect()}
    assert cross["brute_force"]["Rule Engine"] == 2 and cross["insider_drift"]["Markov"] == 1
    detail = reports.alert_detail_json(reports.filter_alerts(log)).orderBy("event_id").first().detail
    assert '"resource":"N/A"' in detail and '"bytes_transferred":0' in detail


def test_saved_log_is_pruned_by_date(spark, log, tmp_path):
    path = str(tmp_path / "scored")
    save_scored(log, path)
    back = load_scored(spark, path)
    assert back.count() == 5
    one = back.filter("event_date = date '2024-03-01'")
    assert "PartitionFilters: [isnotnull(event_date" in one._jdf.queryExecution().toString()
    assert one.count() == 2


@pytest.mark.parametrize("kind", ["json", "csv", "orc", "parquet"])
def test_readers_conform(spark, tmp_path, kind):
    log = make_log(spark, [{"bytes_transferred": 7}, {"success": False}])
    options = {"header": "true"} if kind == "csv" else {}
    log.write.format(kind).options(**options).save(str(tmp_path / kind))
    back = read_events(spark, str(tmp_path / kind), kind, **options)
    assert back.schema == log.schema
    assert sorted(back.collect()) == sorted(log.collect())
    assert project_existing(back).columns[:3] == ["event_id", "timestamp", "user_id"]
