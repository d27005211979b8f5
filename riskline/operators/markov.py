"""Event-sequence model: transition probabilities of each user's event types."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskline.config import MarkovConfig, ScaleConfig
from riskline.functions import scalar as S
from riskline.operators.joins import lookup_join
from riskline.operators.scaling import percentile, scaled
from riskline.operators.timeline import Context, Stage, Timeline
from riskline.session import materialize, read_facts, write_facts


def training_rows(events: DataFrame) -> DataFrame:
    """The rows labelled normal, or all of them when there is no label."""
    if "is_attack" in events.columns:
        return events.filter(~F.col("is_attack"))
    return events


def context_stage(order: int) -> Stage:
    """``prefix``: the user's ``order`` previous event types, null on the first rows."""
    return Stage(
        whole={"_prefix": Context("event_type", order)}, early={"prefix": F.col("_prefix")}
    )


def transitions(
    events: DataFrame, timeline: Timeline, order: int = 1, source: DataFrame | None = None
) -> DataFrame:
    """(prefix, next) of every event that has a full prefix.

    ``source`` holds the cut users' share of ``events`` where that is not all their rows.
    """
    df = timeline.arrange(events.select("user_id", "timestamp", "event_id", "event_type"))
    df = timeline.run(df, context_stage(order), source).filter(F.col("prefix").isNotNull())
    return df.select("user_id", "event_id", "prefix", F.col("event_type").alias("next"))


def training_transitions(events: DataFrame, timeline: Timeline, order: int = 1) -> DataFrame:
    """Transitions of the normal rows alone: a removed row makes its neighbours adjacent."""
    source = training_rows(timeline.cut) if timeline.sliced else None
    return transitions(training_rows(events), timeline, order, source)


def transition_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("prefix", "next").agg(F.count(F.lit(1)).alias("cnt"))


def transition_probs(counts: DataFrame, smoothing: float) -> DataFrame:
    """Smoothed over the nexts that were observed after the prefix."""
    row = Window.partitionBy("prefix")
    total = F.sum("cnt").over(row) + F.lit(smoothing) * F.count("next").over(row)
    return counts.withColumn("prob", (F.col("cnt") + F.lit(smoothing)) / total)


def threshold_of(model: DataFrame, percent: float) -> float:
    """Percentile of the training events' log-probabilities, weighted by the counts.

    The model holds one row per transition, so no pass over the events is needed.
    """
    weighed = model.select(S.log_prob(F.col("prob")).alias("_lp"), "cnt")
    value = percentile(weighed, "_lp", percent, "cnt")
    return -10.0 if value is None else value


def user_sequences(events: DataFrame, timeline: Timeline | None = None, order: int = 1) -> DataFrame:
    """Ordered event types of each user with more than ``order`` events.

    A user is one list, unless they are cut: then each slice is a list of its own and
    ``part`` numbers them in time order, so no list outgrows a slice. For export only;
    the model never builds a list.
    """
    timeline = timeline or Timeline.plan(events)
    item = F.struct("timestamp", "event_id", "event_type")
    rows = timeline.arrange(events.select("user_id", "timestamp", "event_id", "event_type"))
    parts = rows.groupBy(*dict.fromkeys(["user_id", *timeline.keys])).agg(
        F.array_sort(F.collect_list(item)).alias("_items"), F.min("timestamp").alias("_start")
    )
    parts = parts.select("user_id", "_start", F.col("_items.event_type").alias("sequence"))
    user = Window.partitionBy("user_id")
    parts = parts.withColumns(
        {
            "part": F.row_number().over(user.orderBy("_start")) - 1,
            "_n": F.sum(F.size("sequence")).over(user),
        }
    )
    return parts.filter(F.col("_n") > order).select("user_id", "part", "sequence")


@dataclass(frozen=True)
class MarkovModel:
    """Fitted transition table with its threshold."""

    probs: DataFrame  # prefix array<string>, next string, cnt long, prob double
    threshold: float
    cfg: MarkovConfig = MarkovConfig()
    scale: ScaleConfig = ScaleConfig()

    @classmethod
    def fit(
        cls,
        events: DataFrame,
        cfg: MarkovConfig = MarkovConfig(),
        timeline: Timeline | None = None,
        scale: ScaleConfig = ScaleConfig(),
    ) -> MarkovModel:
        timeline = timeline or Timeline.plan(events, scale)
        pairs = training_transitions(events, timeline, cfg.order)
        probs = materialize(transition_probs(transition_counts(pairs), cfg.smoothing), "markov")
        return cls(probs, threshold_of(probs, cfg.threshold_percentile), cfg, scale)

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``markov_raw`` to rows that have a ``prefix``: log-probability of the event."""
        lookup = self.probs.select("prefix", F.col("next").alias("event_type"), "prob")
        df = lookup_join(df, lookup, ["prefix", "event_type"], stored=True)
        seen = F.coalesce(F.col("prob"), F.lit(self.cfg.smoothing))
        raw = F.when(F.col("prefix").isNull(), 0.0).otherwise(S.log_prob(seen))
        return df.withColumn("markov_raw", raw).drop("prob")

    def raw_scores(self, events: DataFrame, timeline: Timeline | None = None) -> DataFrame:
        """Add ``markov_raw`` to the log; higher is more usual, a user's first rows are 0."""
        timeline = timeline or Timeline.plan(events, self.scale)
        df = timeline.run(timeline.arrange(events), context_stage(self.cfg.order))
        return self.score(df).select(*events.columns, "markov_raw")

    def label(self, df: DataFrame) -> DataFrame:
        odd = F.col("markov_raw") < F.lit(self.threshold)
        return df.withColumns(
            {
                "markov_label": F.when(odd, -1).otherwise(1),
                "markov_is_anomaly": odd.cast("int"),
            }
        )

    def transform(self, events: DataFrame, timeline: Timeline | None = None) -> DataFrame:
        """Add label, score in [0, 1] (1 = most unusual) and flag."""
        df = self.label(materialize(self.raw_scores(events, timeline), "markov-scores"))
        low, high = df.agg(F.min(-F.col("markov_raw")), F.max(-F.col("markov_raw"))).first()
        df = df.withColumn("markov_score", scaled(-F.col("markov_raw"), low, high))
        return df.drop("markov_raw")

    def save(self, path: str) -> None:
        facts = {"threshold": self.threshold, "cfg": asdict(self.cfg), "scale": asdict(self.scale)}
        self.probs.write.mode("overwrite").parquet(f"{path}/probs")
        write_facts(self.probs.sparkSession, facts, f"{path}/facts")

    @classmethod
    def load(cls, spark, path: str) -> MarkovModel:
        """The model as it was saved, with its own configuration."""
        facts = read_facts(spark, f"{path}/facts")
        probs = spark.read.parquet(f"{path}/probs")
        return cls(probs, facts["threshold"], MarkovConfig(**facts["cfg"]), ScaleConfig(**facts["scale"]))
