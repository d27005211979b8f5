"""The whole chain: log -> features -> rules, sequence model, forest -> risk per event."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskline.config import ScoringConfig
from riskline.operators import rules as R
from riskline.operators.features import all_features
from riskline.operators.forest import ForestModel
from riskline.operators.fusion import composite_score, label_risk
from riskline.operators.markov import MarkovModel, context_stage
from riskline.operators.scaling import bounds, scaled
from riskline.operators.timeline import Timeline
from riskline.schema import FEATURES
from riskline.session import materialize, read_facts, write_facts


@dataclass(frozen=True)
class ScoringModel:
    """Fitted detectors with the batch bounds that turn raw scores into 0..1 and 0..100."""

    forest: ForestModel
    markov: MarkovModel
    iso_bounds: tuple[float, float]
    markov_bounds: tuple[float, float]
    composite_bounds: tuple[float, float] | None
    cfg: ScoringConfig

    def detector_columns(self, df: DataFrame) -> DataFrame:
        """Labels, flags and 0..1 scores from the raw scores."""
        df = self.markov.label(self.forest.label(df))
        return df.withColumns(
            {
                "iso_anomaly_score": scaled(-F.col("iso_raw"), *self.iso_bounds),
                "markov_score": scaled(-F.col("markov_raw"), *self.markov_bounds),
            }
        )

    def score(self, events: DataFrame, rules=None) -> DataFrame:
        """Score a log with the fitted detectors; the bounds stay those of the fit."""
        timeline = Timeline.plan(events, self.cfg.scale)
        df = detected(events, self.markov, timeline, self.cfg, rules)
        return self.finish(self.forest.score(df))

    def save(self, path: str) -> None:
        """Store the detectors, their bounds and all settings below a folder."""
        self.forest.save(f"{path}/forest")
        self.markov.save(f"{path}/markov")
        ends = {n: getattr(self, n) for n in ("iso_bounds", "markov_bounds", "composite_bounds")}
        write_facts(self.markov.probs.sparkSession, {**ends, "cfg": asdict(self.cfg)}, f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ScoringModel:
        facts = read_facts(spark, f"{path}/facts")
        parts = {f.name: f.default_factory for f in fields(ScoringConfig)}
        cfg = ScoringConfig(**{n: make(**facts["cfg"][n]) for n, make in parts.items()})
        ends = [tuple(facts[n]) for n in ("iso_bounds", "markov_bounds", "composite_bounds")]
        return cls(ForestModel.load(spark, f"{path}/forest"), MarkovModel.load(spark, f"{path}/markov"), *ends, cfg)

    def finish(self, df: DataFrame) -> DataFrame:
        """Fuse rows that have features, rule columns and raw scores."""
        df = label_risk(self.detector_columns(df), *self.composite_bounds, self.cfg.risk)
        return df.drop("iso_raw", "markov_raw")


def detected(events: DataFrame, markov: MarkovModel, timeline: Timeline, cfg: ScoringConfig, rules=None) -> DataFrame:
    """Features, rule columns and raw sequence score in one layout of the log."""
    rules = R.runnable(
        R.default_rules(cfg.rules) if rules is None else rules, events.columns
    )
    stage = R.user_stage(rules) | all_features() | context_stage(cfg.markov.order)
    df = timeline.run(timeline.arrange(R.batch_flags(events, rules)), stage)
    df = markov.score(R.combine(df, rules))
    added = [c for c in FEATURES if c not in events.columns]
    return df.select(*events.columns, *added, *R.RULE_COLUMNS, "markov_raw")


def fit_and_score(
    events: DataFrame, cfg: ScoringConfig = ScoringConfig(), rules=None
) -> tuple[ScoringModel, DataFrame]:
    """Fit all detectors on the batch and score it.

    Two tables are written: the log with features and rule columns (the forest is grown
    from it) and the same with forest scores (the thresholds and bounds are taken from
    it). Everything after that is a projection.
    """
    timeline = Timeline.plan(events, cfg.scale)
    markov = MarkovModel.fit(events, cfg.markov, timeline, cfg.scale)
    table = materialize(detected(events, markov, timeline, cfg, rules), "features")
    forest = ForestModel.grow(table, FEATURES, cfg.forest)

    scored = materialize(forest.score(table), "scores")
    iso, mk = -F.col("iso_raw"), -F.col("markov_raw")
    ends = scored.agg(F.min(iso), F.max(iso), F.min(mk), F.max(mk)).first()
    model = ScoringModel(
        forest.calibrate(scored),
        markov,
        (ends[0], ends[1]),
        (ends[2], ends[3]),
        None,
        cfg,
    )
    fused = model.detector_columns(scored).select(composite_score(cfg.risk).alias("composite_score"))
    model = replace(model, composite_bounds=bounds(fused, "composite_score"))
    return model, model.finish(scored)


def score_events(events: DataFrame, cfg: ScoringConfig = ScoringConfig(), rules=None) -> DataFrame:
    """The log with features, detector outputs, risk score, level and attack label."""
    return fit_and_score(events, cfg, rules)[1]
