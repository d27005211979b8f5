import math

import pytest

from riskline.config import MarkovConfig, ScaleConfig
from riskline.operators import markov as M
from riskline.operators.markov import MarkovModel
from riskline.operators.timeline import Timeline

from .helpers import assert_same, column, crowded_log, make_log

TYPES = ["A", "B", "A", "B", "A", "C"]


@pytest.fixture
def log(spark):
    return make_log(
        spark, [{"event_type": t, "is_attack": i == 4} for i, t in enumerate(TYPES)]
    )


@pytest.mark.parametrize("rows", [1_000_000, 2])
def test_training_drops_attacks_first_and_scoring_keeps_them(log, rows):
    model = MarkovModel.fit(log, scale=ScaleConfig(max_rows_per_slice=rows))
    got = {(r.prefix[0], r.next): (r.cnt, r.prob) for r in model.probs.collect()}
    assert {k: v[0] for k, v in got.items()} == {("A", "B"): 2, ("B", "A"): 1, ("B", "C"): 1}
    assert got[("A", "B")][1] == pytest.approx(1) and got[("B", "C")][1] == pytest.approx(0.5)
    half = math.log(0.5 + 1e-12)
    raw = column(model.raw_scores(log), "markov_raw")
    assert raw == pytest.approx([0, 0, half, 0, half, -13.81551], abs=1e-5)


def test_rows_equal_to_the_threshold_are_not_flagged(log):
    model = MarkovModel.fit(log)
    assert model.threshold == pytest.approx(math.log(0.5), abs=1e-6)
    out = model.transform(log)
    assert column(out, "markov_label") == [1, 1, 1, 1, 1, -1]
    assert column(out, "markov_is_anomaly") == [0, 0, 0, 0, 0, 1]
    assert max(column(out, "markov_score")) == 1 and min(column(out, "markov_score")) == 0


def test_no_training_pairs(spark):
    model = MarkovModel.fit(make_log(spark, [{}]))
    assert model.threshold == -10.0
    assert column(model.transform(make_log(spark, [{}, {}])), "markov_label") == [1, -1]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_cut_plan_gives_the_same_transitions(spark, order):
    log = crowded_log(spark)
    cut = Timeline.plan(log, ScaleConfig(max_rows_per_slice=60))
    assert_same(
        M.training_transitions(log, Timeline(), order), M.training_transitions(log, cut, order)
    )


def test_contexts_reach_over_slices_of_one_row(spark):
    log = make_log(spark, [{"event_type": t} for t in "abcdef"])
    cut = Timeline.plan(log, ScaleConfig(max_rows_per_slice=1))
    got = {r.next: "".join(r.prefix) for r in M.transitions(log, cut, 3).collect()}
    assert got == {"d": "abc", "e": "bcd", "f": "cde"}


def test_sequences_come_in_parts_where_a_user_is_cut(spark):
    rows = [{"event_type": t} for t in "abcdefgh"] + [{"user_id": "u2"}, {"user_id": "u3"}, {"user_id": "u3"}]
    log = make_log(spark, rows)
    cut = Timeline.plan(log, ScaleConfig(max_rows_per_slice=3))
    parts = M.user_sequences(log, cut).orderBy("user_id", "part").collect()
    u1 = [p.sequence for p in parts if p.user_id == "u1"]
    assert len(u1) > 1 and "".join(t for p in u1 for t in p) == "abcdefgh"
    assert {p.user_id for p in parts} == {"u1", "u3"}


def test_save_and_load(spark, log, tmp_path):
    model = MarkovModel.fit(log)
    model.save(str(tmp_path / "m"))
    again = MarkovModel.load(spark, str(tmp_path / "m"))
    assert again.threshold == model.threshold
    assert column(again.raw_scores(log), "markov_raw") == column(model.raw_scores(log), "markov_raw")
