"""Detectors on keyed state against their batch twins, with late, mixed and missing rows."""

import time
import uuid

import pytest
from pyspark.sql import functions as F

from checks.queries import CONFIG, RULES
from riskline.operators import rules as R
from riskline.operators.markov import MarkovModel
from riskline.session import work_dir
from riskline.sources.activity import read_activity
from riskline.sources.events import read_event_stream
from riskline.streaming import jobs, keyed

from .helpers import assert_same

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark):
    """With users and devices that are missing, and ties in time."""
    events = read_activity(spark, SMALL)
    spot = F.pmod(F.xxhash64("event_id"), F.lit(40))
    return events.withColumns(
        {
            "user_id": F.when(spot != 0, F.when(spot < 12, F.lit("user_9999")).otherwise(F.col("user_id"))),
            "device_id": F.when(spot != 1, F.col("device_id")),
            "timestamp": F.when(spot < 20, F.date_trunc("hour", "timestamp")).otherwise(F.col("timestamp")),
        }
    )


def stream(spark, parts):
    folder = f"{work_dir(spark)}/input-{uuid.uuid4().hex}"
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
    return read_event_stream(spark, folder, geo=True, maxFilesPerTrigger=1)


def mixed(log, n=4):
    return [log.filter(F.pmod(F.xxhash64("event_id", F.lit(1)), F.lit(n)) == i) for i in range(n)]


def by_time(log, n=4, hours=6):
    """Quarters of the log by time, rows up to so many hours early or late."""
    at = F.unix_micros("timestamp") + F.pmod(F.xxhash64("event_id"), F.lit(2 * hours * R.HOUR)) - hours * R.HOUR
    cuts = log.select(at.cast("double").alias("at")).approxQuantile("at", [i / n for i in range(1, n)], 0.0)
    number = sum(((at > c).cast("int") for c in cuts), F.lit(0))
    return [log.filter(number == i) for i in range(n)]


def closing(log, hours):
    last = log.orderBy(F.desc("timestamp")).limit(1)
    return last.withColumns({"timestamp": F.col("timestamp") + F.expr(f"INTERVAL {hours} HOURS"), "event_id": F.lit("closing")})


def place(spark):
    return f"{work_dir(spark)}/out-{uuid.uuid4().hex}"


def flagged(log, name):
    rule = next(r for r in R.default_rules(RULES) if r.name == name)
    return R.flag_rows(log, rule)


def test_new_devices_in_any_order(spark, log):
    out = place(spark)
    keyed.new_devices(stream(spark, mixed(log)), out, partitions=2).awaitTermination()
    columns = ["event_id", "user_id", "device_id", "timestamp"]
    want = flagged(log, "device_spoofing").select(columns)
    assert want.count() > 20
    assert_same(keyed.latest_new_devices(spark, out).select(columns), want)
    # Some alert was overturned by an earlier login.
    assert spark.read.parquet(f"{out}/alerts").filter("withdrawn").count() > 0


def test_new_devices_read_nothing_of_earlier_batches(spark, log):
    """Neither tables of earlier batches nor their number show in what a batch reads."""
    out = place(spark)
    query = keyed.new_devices(stream(spark, mixed(log)), out, partitions=2)
    query.awaitTermination()
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [m.count() for m in mixed(log)]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(out)
    names = {s.getPath().getName() for s in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)}
    assert names == {"alerts", "checkpoint"}


def test_a_forgotten_device_is_new_again(spark, log):
    out = place(spark)
    one = log.filter("user_id = 'user_9999' AND event_type = 'login'").orderBy("event_id").limit(6)
    later = one.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 DAY"))
    with pytest.raises(ValueError):
        keyed.new_devices(stream(spark, [one]), out, expiry="1 day")
    query = keyed.new_devices(stream(spark, [one, later]), out, trigger="1 second", expiry="1 millisecond", partitions=1)
    try:
        until = time.time() + 90
        while sum(p["numInputRows"] > 0 for p in query.recentProgress) < 2 and time.time() < until:
            time.sleep(1)
    finally:
        query.stop()
    devices = one.select("device_id").distinct().count()
    assert spark.read.parquet(f"{out}/alerts").groupBy("batch").count().filter(F.col("count") == devices).count() == 2


@pytest.mark.parametrize("order", [1, 2])
def test_sequence_scores_with_late_rows(spark, log, order):
    model = MarkovModel.fit(log, CONFIG.markov.__class__(order=order))
    out = place(spark)
    parts = [*by_time(log), closing(log, 14)]
    query = keyed.sequence_scores(stream(spark, parts), out, model, delay="13 hours", partitions=2)
    query.awaitTermination()
    got = jobs.read_alerts(spark, out).select("event_id", "markov_raw", "markov_is_anomaly")
    want = model.label(model.raw_scores(log)).select("event_id", "markov_raw", "markov_is_anomaly")
    assert_same(got, want)


def test_rows_beyond_the_delay_are_dropped_and_counted(spark, log):
    model = MarkovModel.fit(log)
    out = place(spark)
    timed = log.filter("user_id IS NOT NULL")
    late = timed.orderBy("timestamp").limit(5).withColumn("event_id", F.concat(F.lit("late-"), "event_id"))
    query = keyed.sequence_scores(stream(spark, [*by_time(timed, 2, 1), late, closing(timed, 14)]), out, model, delay="13 hours", partitions=2)
    query.awaitTermination()
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    assert dropped == 5
    assert_same(jobs.read_alerts(spark, out).select("event_id", "markov_raw"), model.raw_scores(timed).select("event_id", "markov_raw"))


def test_brute_force_flags_the_rows_of_the_rule(spark, log):
    out = place(spark)
    minutes, failures = RULES.brute_force_minutes, RULES.brute_force_failures
    parts = [*by_time(log), closing(log, 14)]
    keyed.brute_force(stream(spark, parts), out, minutes, failures, "13 hours", partitions=2).awaitTermination()
    want = flagged(log, "brute_force_login").select("event_id", "user_id")
    assert want.count() > 20
    assert_same(jobs.read_alerts(spark, out).select("event_id", "user_id"), want)


def test_a_stopped_query_goes_on_from_its_state(spark, log):
    """The second half comes to a query started anew on the same checkpoint."""
    out, folder = place(spark), f"{work_dir(spark)}/input-{uuid.uuid4().hex}"
    parts = mixed(log)
    for half in (parts[:2], parts[2:]):
        for part in half:
            part.coalesce(1).write.mode("append").parquet(folder)
        keyed.new_devices(read_event_stream(spark, folder, geo=True, maxFilesPerTrigger=1), out, partitions=2).awaitTermination()
    columns = ["event_id", "user_id", "device_id"]
    assert_same(keyed.latest_new_devices(spark, out).select(columns), flagged(log, "device_spoofing").select(columns))
