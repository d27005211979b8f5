import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import queries
from riskline.config import ForestConfig
from riskline.operators.forest import (
    ForestModel, _entered, average_path, grow_tree, tree_samples, walk,
)

CFG = ForestConfig(trees=40, sample_size=64, contamination=0.1)


@pytest.fixture(scope="module")
def points(spark):
    """A dense cloud of 500 points with five far outliers."""
    base = spark.range(505).select(F.format_string("e%05d", "id").alias("event_id"), "id")
    far = F.col("id") >= 500
    return base.select(
        "event_id",
        "id",
        F.when(far, 40.0 + F.col("id") - 500).otherwise(F.rand(1)).alias("x"),
        F.when(far, -30.0).otherwise(F.rand(2)).alias("y"),
        F.lit(1.0).alias("constant"),
    ).cache()


@pytest.fixture(scope="module")
def model(points):
    return ForestModel.fit(points, ["x", "y", "constant"], CFG)


def test_average_path():
    assert list(average_path(np.array([0, 1, 2]))) == [0, 0, 1]
    assert average_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_walk_equals_a_walk_by_hand():
    rng = np.random.default_rng(3)
    sample = rng.random((32, 4))
    nodes = grow_tree(sample, (1, 2), height=5)
    arrays = tuple(np.array([n[i] for n in nodes]) for i in range(4))
    got = walk(sample, [arrays], height=5)
    for row, path in zip(sample, got):
        node = 0
        while nodes[node][2] != node:
            feature, cut, child, _ = nodes[node]
            node = child + int(row[feature] > cut)
        assert path == pytest.approx(nodes[node][3])


def test_walk_in_the_jvm_equals_numpy(points, model):
    odd = points.withColumn("x", F.when(F.col("id") == 3, float("nan")).when(F.col("id") == 4, float("inf")).when(F.col("id") != 5, F.col("x")))
    a = {r.event_id: r.iso_raw for r in model.score(odd).collect()}
    b = {r.event_id: r.iso_raw for r in model.walked(odd).collect()}
    assert a == pytest.approx(b, abs=1e-12)
    plan = model.walked(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_the_score_query_walks_blocks_of_rows(spark, points, model, monkeypatch):
    monkeypatch.setattr(queries, "forest", lambda spark, folder: model)
    monkeypatch.setattr(queries, "features", lambda spark, folder: points)
    out = queries.QUERIES["iforest_score"](spark, "")
    assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString()
    got = {r[0]: r[1] for r in out.collect()}
    assert got == pytest.approx({r.event_id: r.iso_raw for r in model.walked(points).collect()}, abs=1e-6)


@pytest.mark.parametrize("share", [0.01, 0.1, 0.5])
def test_rows_enter_each_tree_with_the_same_chance(spark, share):
    rows, trees = 4000, 60
    df = spark.range(rows).select(F.format_string("e%06d", "id").alias("event_id"))
    got = df.select("event_id", F.explode(_entered(trees, share, 7)).alias("tree")).groupBy("tree").count().collect()
    assert {r.tree for r in got} == set(range(trees))
    spread = (rows * share * (1 - share)) ** 0.5
    assert all(abs(r["count"] - rows * share) < 5 * spread for r in got)


def test_outliers_rank_first(points, model):
    scored = model.transform(points).orderBy(F.desc("iso_anomaly_score")).collect()
    assert {r.id for r in scored[:5]} == set(range(500, 505))
    assert scored[0].iso_anomaly_score == 1.0 and scored[-1].iso_anomaly_score == 0.0


def test_flagged_share_is_the_contamination(points, model):
    flagged = model.transform(points).agg(F.avg("iso_is_anomaly")).first()[0]
    assert flagged == pytest.approx(0.1, abs=0.01)


def test_result_does_not_depend_on_the_layout(points, model):
    again = ForestModel.fit(points.repartition(7), ["x", "y", "constant"], CFG)
    assert again.threshold == pytest.approx(model.threshold)
    a = {r.event_id: r.iso_raw for r in model.score(points).collect()}
    b = {r.event_id: r.iso_raw for r in again.score(points.coalesce(1)).collect()}
    assert a == pytest.approx(b)


@pytest.mark.parametrize("rows", [505, 40_000])
def test_each_tree_gets_its_sample(spark, rows):
    df = spark.range(rows).select(F.format_string("e%06d", "id").alias("event_id"), F.col("id").alias("x"))
    drawn = tree_samples(df, ["x"], CFG, rows).groupBy("tree_id").agg(
        F.count("event_id").alias("n"), F.countDistinct("event_id").alias("d")
    ).collect()
    assert len(drawn) == CFG.trees
    assert {(r.n, r.d) for r in drawn} == {(64, 64)}


def test_fewer_rows_than_the_sample_size(spark):
    df = spark.range(10).select(F.format_string("e%d", "id").alias("event_id"), F.col("id").alias("x"))
    model = ForestModel.fit(df, ["x"], CFG)
    assert model.sample_size == 10
    assert model.transform(df).count() == 10


def test_save_and_load(spark, points, model, tmp_path):
    model.save(str(tmp_path / "forest"))
    again = ForestModel.load(spark, str(tmp_path / "forest"))
    assert again.threshold == model.threshold and again.columns == model.columns
    a = model.score(points).agg(F.sum("iso_raw")).first()[0]
    assert again.score(points).agg(F.sum("iso_raw")).first()[0] == pytest.approx(a)
