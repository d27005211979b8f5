from pyspark.sql import functions as F

from riskline.config import ScaleConfig
from riskline.operators.sampling import (
    append_labeled, apply_appends, sample_normal_rows, sequential_event_id,
)
from riskline.sources.activity import read_activity

from .helpers import SMALL, make_log


def test_sample_has_the_exact_size_and_only_normal_rows(spark):
    log = read_activity(spark, SMALL)
    sample = sample_normal_rows(log, 0.03)
    assert sample.count() == 30
    assert sample.filter("is_attack").count() == 0
    assert sample.select("event_id").distinct().count() == 30
    again = sample_normal_rows(log.repartition(5), 0.03)
    assert sample.exceptAll(again.select(sample.columns)).count() == 0
    assert sample_normal_rows(log, 0.03, seed=1).exceptAll(sample).count() > 0


def test_sample_is_at_least_one_row_and_at_most_all(spark):
    log = make_log(spark, [{"is_attack": True}, {}, {}])
    assert sample_normal_rows(log, 0.0001).count() == 1
    assert sample_normal_rows(log, 5.0).count() == 2


def test_ids_follow_time_also_when_the_log_is_cut(spark):
    log = read_activity(spark, SMALL).withColumnRenamed("event_id", "source_id")
    for rows in (1_000_000, 100):
        scale = ScaleConfig(max_rows_per_slice=rows)
        out = sequential_event_id(log, ("timestamp", "source_id"), scale=scale)
        got = [r.event_id for r in out.orderBy("timestamp", "source_id").collect()]
        assert got == [f"EVT-{i:06d}" for i in range(1000)]


def test_appending_widens_the_schema(spark):
    log = make_log(spark, [{}, {}])
    extra = make_log(spark, [{"event_id": "ATT-1", "is_attack": True}]).withColumn("city", F.lit("london"))
    out = append_labeled(log, extra)
    assert out.count() == 3 and out.filter("city is null").count() == 2
    assert apply_appends(log, [extra, extra]).count() == 4
    assert apply_appends(log, []).count() == 2
