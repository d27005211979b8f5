"""Registered queries: every operator of the engine over the whole activity table.

The activity data has about two events per user and day, so the rules run with the
thresholds below; the production ones would find almost nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskline.config import ForestConfig, MarkovConfig, RuleConfig, ScoringConfig
from riskline.functions import scalar as S
from riskline.operators import features as FT
from riskline.operators import markov as M
from riskline.operators import rules as R
from riskline.operators import sampling
from riskline.operators.forest import ForestModel, tree_samples
from riskline.operators.fusion import classify, composite_score, heuristic_attack_type
from riskline.operators.markov import MarkovModel
from riskline.operators.scaling import minmax_scale, percentile_threshold, standardize
from riskline.operators.timeline import Level, Stage, Timeline
from riskline.plans import reports
from riskline.plans.scoring import ScoringModel, detected, fit_and_score, score_events
from riskline.schema import EVENT_COLUMNS, EVENT_TYPE_FEATURES, FEATURES, TRANSITION_FEATURES
from riskline.session import configure, materialize, work_dir
from riskline.sources.activity import read_activity
from riskline.sources.events import load_scored, project_existing, save_scored
from riskline.streaming import jobs, keyed, scoring

RULES = RuleConfig(
    brute_force_minutes=4320,
    brute_force_failures=3,
    travel_max_hours=12,
    stuffing_minutes=10080,
    lateral_hours=48,
    lateral_resources=7,
    exfiltration_kb=15000.0,
    drift_rate_increase=0.1,
)
CONFIG = ScoringConfig(rules=RULES)
ENTITY = ("username", "name_7")

_tables: dict[tuple, DataFrame] = {}


def _once(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries read, written once per session."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _tables:
        _tables[key] = materialize(build(), name)
    return _tables[key]


def log(spark: SparkSession, folder: str) -> DataFrame:
    return read_activity(configure(spark), folder)


def timeline(spark: SparkSession, folder: str) -> Timeline:
    key = (spark.sparkContext.applicationId, folder, "timeline")
    if key not in _tables:
        _tables[key] = Timeline.plan(log(spark, folder), CONFIG.scale)
    return _tables[key]


def markov_model(spark: SparkSession, folder: str) -> MarkovModel:
    key = (spark.sparkContext.applicationId, folder, "markov")
    if key not in _tables:
        _tables[key] = MarkovModel.fit(log(spark, folder), timeline=timeline(spark, folder))
    return _tables[key]


def detector_log(spark: SparkSession, folder: str) -> DataFrame:
    """Log with features, rules and sequence scores, and a stand-in for the forest score.

    The stand-in (bytes moved as a share of the largest transfer) lets SQL check the
    fusion and the reports; ``score_events`` is the query with the forest itself.
    """

    def build() -> DataFrame:
        events = log(spark, folder)
        model = markov_model(spark, folder)
        df = detected(events, model, timeline(spark, folder), CONFIG)
        df = minmax_scale(model.label(df), "bytes_transferred", "iso_anomaly_score")
        return df.withColumn("iso_is_anomaly", (F.col("iso_anomaly_score") > 0.25).cast("int"))

    df = _once(spark, folder, "detectors", build)
    df = df.withColumn("_inv", -F.col("markov_raw"))
    return minmax_scale(df, "_inv", "markov_score").drop("_inv")


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, folder, "scored", lambda: classify(detector_log(spark, folder)))


def features(spark: SparkSession, folder: str) -> DataFrame:
    return _once(
        spark, folder, "features", lambda: FT.feature_matrix(log(spark, folder), timeline(spark, folder))
    )


def forest(spark: SparkSession, folder: str) -> ForestModel:
    key = (spark.sparkContext.applicationId, folder, "forest")
    if key not in _tables:
        _tables[key] = ForestModel.fit(features(spark, folder), FEATURES)
    return _tables[key]


def scoring_model(spark: SparkSession, folder: str) -> ScoringModel:
    key = (spark.sparkContext.applicationId, folder, "model")
    if key not in _tables:
        _tables[key] = fit_and_score(log(spark, folder), CONFIG)[0]
    return _tables[key]


def r6(column: str) -> Column:
    return F.round(F.col(column).cast("double"), 6).alias(column)


def ntz(df: DataFrame) -> DataFrame:
    """The log's time as the source's own zoneless type."""
    return df.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def _log_query(fn: Callable[[DataFrame], DataFrame]):
    return lambda spark, folder: fn(log(spark, folder))


def _scored_query(fn: Callable[[DataFrame], DataFrame]):
    return lambda spark, folder: fn(scored(spark, folder))


def _stage_query(stage: Callable[[], Stage], *columns: str):
    """A feature stage over the log; fractions are rounded for the comparison."""

    def query(spark, folder):
        df = FT.add_features(log(spark, folder), stage(), timeline(spark, folder))
        kinds = dict(df.dtypes)
        return df.select("event_id", *[r6(c) if kinds[c] == "double" else c for c in columns])

    return query


def _rule_query(name: str):
    def query(spark, folder):
        rule = next(r for r in R.default_rules(RULES) if r.name == name)
        hits = R.flag_rows(log(spark, folder), rule, timeline(spark, folder))
        return hits.select("event_id", "user_id")

    return query


def _variant(name: str, attack_type: str, parts=None, batch=None):
    def query(spark, folder):
        if parts is not None:
            stage, condition = parts(RULES)
            rule = R.Rule.where(name, name, attack_type, 4, condition, stage)
        else:
            rule = R.Rule(name, name, attack_type, 4, batch=batch)
        hits = R.flag_rows(log(spark, folder), rule, timeline(spark, folder))
        return hits.select("event_id", "user_id")

    return query


def _sequential(df: DataFrame) -> DataFrame:
    source = df.select("timestamp", F.col("event_id").alias("source_id"))
    return sampling.sequential_event_id(source, ("timestamp", "source_id")).select("event_id", "source_id")


def _labeled(df: DataFrame) -> DataFrame:
    """Located attack rows: copies of the failed logins under new names."""
    failed = df.filter(S.is_login() & ~F.col("success"))
    return failed.withColumns(
        {"event_id": F.concat(F.lit("ATT-"), "event_id"), "is_attack": F.lit(True),
         "attack_type": F.lit("brute_force")}
    )


def _append_columns(df: DataFrame) -> DataFrame:
    return df.select("event_id", "attack_type", "is_attack", "city")


def _append(df: DataFrame) -> DataFrame:
    plain = df.select(*EVENT_COLUMNS)
    return _append_columns(sampling.append_labeled(plain, _labeled(df)))


def _appends(df: DataFrame) -> DataFrame:
    plain = df.select(*EVENT_COLUMNS)
    second = plain.filter(F.col("event_type") == "usb_usage").withColumns(
        {"event_id": F.concat(F.lit("ATU-"), "event_id"), "is_attack": F.lit(True),
         "attack_type": F.lit("low_and_slow_exfiltration")}
    )
    return _append_columns(sampling.apply_appends(plain, [_labeled(df), second]))


def _saved(spark, folder):
    path = f"{work_dir(spark)}/scored-by-date-{uuid.uuid4().hex}"
    save_scored(scored(spark, folder), path)
    back = load_scored(spark, path)
    return back.groupBy(F.col("event_date").cast("string").alias("event_date")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(S.is_alert()).alias("alerts")
    )


def _min_group(spark, folder):
    df = FT.add_features(log(spark, folder), FT.frequency_features(), timeline(spark, folder))
    return df.filter(F.col("events_in_window") >= 68).select("event_id", "user_id")


def _inferred(spark, folder):
    """Each inferred feature column with its mean, from the feature table."""
    df = features(spark, folder)
    names = FT.infer_feature_columns(df)
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in names])
    return means.unpivot([], names, "feature", "mean").select("feature", r6("mean"))


def _clean(df: DataFrame) -> DataFrame:
    # Not-a-number, an infinity and null made from the table's own values.
    raw = F.when(F.col("bytes_transferred") == 0, F.lit(float("nan"))).when(
        F.col("success"), F.col("bytes_transferred").cast("double")
    ).when(F.col("is_attack"), F.lit(float("inf")))
    return df.select("event_id", S.clean_numeric(raw).alias("cleaned"))


def _scalar(name: str, column: Callable[[], Column]):
    return _log_query(lambda df: df.select("event_id", column().alias(name)))


def _scored_scalar(name: str, column: Callable[[], Column]):
    return _scored_query(lambda df: df.select("event_id", column().alias(name)))


def _entropy(df: DataFrame) -> DataFrame:
    return reports.column_entropy(df, "user_id", "event_type").select("user_id", r6("entropy"))


def _minmax(df: DataFrame) -> DataFrame:
    return minmax_scale(df, "bytes_transferred", "scaled").select("event_id", r6("scaled"))


def _standardize(spark, folder):
    df = standardize(log(spark, folder), ["bytes_transferred"])
    return df.select("event_id", r6("bytes_transferred_z"))


def _percentile(df: DataFrame) -> DataFrame:
    return percentile_threshold(df, "bytes_transferred", 92.0).select(r6("threshold"))


def _trailing_count(spark, folder):
    stage = Stage(
        levels={"_rows": Level(F.lit(1), F.lit(1), 48 * R.HOUR)}, early={"in_window": F.col("_rows")}
    )
    return _stage_query(lambda: stage, "in_window")(spark, folder)


def _failed_logins(spark, folder):
    stage = R.failed_logins(RULES.brute_force_minutes) | Stage(early={"failures": F.col("_failures")})
    df = FT.add_features(log(spark, folder), stage, timeline(spark, folder))
    return df.filter(S.is_login()).select("event_id", "failures")


def _unique_resources(spark, folder):
    stage = R.distinct_resources(RULES.lateral_hours) | Stage(early={"resources": F.col("_distinct")})
    return _stage_query(lambda: stage, "resources")(spark, folder)


def _half_rates(spark, folder):
    df = FT.add_features(log(spark, folder), R.half_rates(), timeline(spark, folder))
    return df.select("event_id", "half", r6("first_rate"), r6("second_rate"))


def _daily_total(spark, folder):
    stage = R.daily_transfer() | Stage(early={"day_bytes": F.col("_moved")})
    return _stage_query(lambda: stage, "day_bytes")(spark, folder)


def _ip_semi_join(df: DataFrame) -> DataFrame:
    return R.logins_from_crowded(df, RULES).select("event_id", "source_ip")


def _agg_join_back(spark, folder):
    df = FT.add_features(log(spark, folder), FT.frequency_features(), timeline(spark, folder))
    return df.select("event_id", "events_in_window", "max_bytes_user")


def _pairs(spark, folder, order=1):
    return M.training_transitions(log(spark, folder), timeline(spark, folder), order)


def _prefix(df: DataFrame) -> DataFrame:
    return df.withColumn("prefix", F.concat_ws(">", "prefix"))


def _markov_transitions(order):
    return lambda spark, folder: _prefix(_pairs(spark, folder, order)).select("event_id", "prefix", "next")


def _markov_counts(order):
    return lambda spark, folder: _prefix(M.transition_counts(_pairs(spark, folder, order)))


def _markov_probs(spark, folder):
    return _prefix(markov_model(spark, folder).probs).select("prefix", "next", "cnt", r6("prob"))


def _markov_threshold(spark, folder):
    value = markov_model(spark, folder).threshold
    rows = markov_model(spark, folder).probs.agg(F.sum("cnt").alias("training_pairs"))
    return rows.select("training_pairs", F.round(F.lit(value), 6).alias("threshold"))


def _markov_raw(spark, folder):
    df = markov_model(spark, folder).raw_scores(log(spark, folder), timeline(spark, folder))
    return df.select("event_id", r6("markov_raw"))


def _markov_second_order(spark, folder):
    model = MarkovModel.fit(log(spark, folder), MarkovConfig(order=2), timeline(spark, folder))
    df = model.raw_scores(log(spark, folder), timeline(spark, folder))
    return df.select("event_id", r6("markov_raw"))


def _markov_table(spark, folder):
    def build():
        return markov_model(spark, folder).transform(log(spark, folder), timeline(spark, folder))

    return _once(spark, folder, "markov-scored", build)


def _prob_lookup(spark, folder):
    pairs = _pairs(spark, folder)
    df = markov_model(spark, folder).score(pairs.withColumnRenamed("next", "event_type"))
    return df.select("event_id", r6("markov_raw"))


def _sequences(spark, folder):
    df = M.user_sequences(log(spark, folder), timeline(spark, folder))
    return df.select("user_id", F.concat_ws(",", "sequence").alias("sequence"))


def _forest_fit(spark, folder):
    """Nodes, cuts (sum of their logarithms) and features of every grown tree."""
    model = forest(spark, folder)
    inner = F.col("child") != F.col("node_id")
    return model.nodes.groupBy("tree_id").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.round(F.sum(F.when(inner, F.log1p(F.abs("threshold")))), 6).alias("cuts"),
        F.sum(F.when(inner, F.col("feature"))).cast("long").alias("features"),
    )


def _forest_sample(spark, folder):
    df = features(spark, folder)
    drawn = tree_samples(df, FEATURES, ForestConfig(), df.count())
    return drawn.groupBy("tree_id").agg(F.count(F.lit(1)).alias("rows"))


def _forest_score(spark, folder):
    # By blocks of rows in numpy, some 35 times as fast as the walk by array functions.
    df = forest(spark, folder).score(features(spark, folder))
    return df.select("event_id", r6("iso_raw"))


def _forest_table(spark, folder):
    def build():
        return forest(spark, folder).transform(features(spark, folder))

    return _once(spark, folder, "forest-labelled", build)


def _trigger_counts(spark, folder):
    return R.rule_trigger_counts(scored(spark, folder))


def _custom_rule(spark, folder):
    """A user's own rule next to the registered ones."""
    large = R.Rule.where(
        "large_transfer", "One event moves over 10 MB", "low_and_slow_exfiltration", 1,
        F.col("bytes_transferred") > 10_000_000, needs=("bytes_transferred",),
    )
    rules = [*R.default_rules(RULES)[:1], large]
    df = R.evaluate(log(spark, folder), rules, timeline(spark, folder))
    return df.select("event_id", "rule_anomaly", "rule_names", "rule_severity", "rule_attack_type")


def _score_events(spark, folder):
    df = score_events(log(spark, folder), CONFIG)
    return df.select(
        "event_id", r6("iso_anomaly_score"), r6("markov_score"), "rule_names", r6("composite_score"),
        "risk_score", "risk_level", "predicted_attack_type",
    )


def entity(fn):
    return _scored_query(lambda df: fn(df, *ENTITY))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # Shaping
    "conform_events": _log_query(ntz),
    "sequential_event_id": _log_query(_sequential),
    "sample_normal_rows": _log_query(lambda df: sampling.sample_normal_rows(df, 0.03).select("event_id")),
    "append_labeled": _log_query(_append),
    "apply_appends": _log_query(_appends),
    "union_all": _log_query(lambda df: _append_columns(df.unionByName(_labeled(df)))),
    "save_scored": _saved,
    # Filters and projections
    "filter_logins": _log_query(lambda df: df.filter(S.is_login()).select("event_id", "event_type")),
    "filter_transfers": _log_query(
        lambda df: df.filter(S.is_transfer()).select("event_id", "bytes_transferred")
    ),
    "filter_training_normals": _log_query(lambda df: M.training_rows(df).select("event_id", "is_attack")),
    "filter_alerts": _scored_query(
        lambda df: reports.filter_alerts(df).select("event_id", "predicted_attack_type")
    ),
    "filter_alert_feed": _scored_query(
        lambda df: reports.filter_alert_feed(df).select("event_id", "predicted_attack_type", "risk_level")
    ),
    "filter_entity": entity(lambda df, k, v: reports.filter_entity(df, k, v).select("event_id", k)),
    "filter_min_group_size": _min_group,
    "project_existing": _scored_query(lambda df: ntz(project_existing(df))),
    "infer_feature_columns": _inferred,
    "clean_numeric": _log_query(_clean),
    # Scalars
    "temporal_features": _stage_query(
        FT.temporal_features, "hour", "minute", "day_of_week", "is_weekend", "is_night",
        "day_of_month", "week_of_year",
    ),
    "event_type_onehot": _stage_query(
        FT.event_type_onehot, *EVENT_TYPE_FEATURES[:-1]
    ),
    "safe_divide": _scalar(
        "ratio", lambda: F.round(S.safe_divide("bytes_transferred", F.hour("timestamp"), -1.0), 6)
    ),
    "safe_divide_series": _scalar(
        "ratio",
        lambda: F.round(S.safe_divide_positive("bytes_transferred", F.minute("timestamp") - 30), 6),
    ),
    "haversine_km": _log_query(
        lambda df: df.filter(F.col("latitude").isNotNull()).select(
            "event_id",
            F.round(S.haversine_km("latitude", "longitude", F.lit(40.7128), F.lit(-74.006)), 6).alias("km"),
        )
    ),
    "time_delta_hours": _scalar(
        "hours",
        lambda: F.round(
            S.time_delta_hours("timestamp", F.to_timestamp(F.lit("2024-01-15 12:00:00"))), 6
        ),
    ),
    "format_timestamp": _scalar("text", lambda: S.format_timestamp("timestamp")),
    "risk_level": _scored_scalar("level", lambda: S.risk_level()),
    "risk_color": _scored_scalar("color", lambda: S.risk_color()),
    "detector_source": _scored_query(
        lambda df: reports.filter_alerts(df).select("event_id", S.detector_source().alias("source"))
    ),
    "severity_of": _scored_scalar("severity", lambda: S.severity_of()),
    "round_scores": _scalar("rounded", lambda: S.round_half_even(F.col("bytes_transferred") / 4, 1)),
    "severity_tier": _scored_scalar("tier", lambda: S.severity_tier(S.severity_of())),
    "attack_type_title": _scored_scalar("title", lambda: S.attack_type_title("predicted_attack_type")),
    "event_date": _scalar("event_date", lambda: S.event_date().cast("string")),
    "alert_detail_json": _scored_query(
        lambda df: reports.alert_detail_json(reports.filter_alerts(df)).select(
            "event_id",
            F.get_json_object("detail", "$.event_id").alias("event"),
            *[
                F.get_json_object("detail", f"$.{f}").alias(f)
                for f in (
                    "timestamp", "user", "user_id", "event_type", "source_ip", "device_id", "resource",
                    "predicted_attack_type", "risk_level", "rule_names", "is_attack_ground_truth",
                )
            ],
            *[
                F.get_json_object("detail", f"$.{f}").cast("double").alias(f)
                for f in ("bytes_transferred", "risk_score", "iso_anomaly_score", "markov_score")
            ],
        )
    ),
    "log_prob": _scalar("lp", lambda: F.round(S.log_prob(F.col("bytes_transferred") / 1e9), 6)),
    # Aggregates
    "user_frequency_features": _stage_query(
        FT.frequency_features, "events_in_window", "unique_ips", "unique_devices",
        "unique_resources", "total_bytes_user", "mean_bytes_user", "max_bytes_user",
    ),
    "login_failure_rate": _stage_query(
        FT.frequency_features, "login_failure_rate"),
    "entropy": _log_query(_entropy),
    "overview_kpis": _scored_query(reports.overview_kpis),
    "sidebar_stats": _scored_query(reports.sidebar_stats),
    "daily_event_volume": _log_query(
        lambda df: reports.daily_event_volume(df).withColumn("event_date", F.col("event_date").cast("string"))
    ),
    "alert_feed_counts": _scored_query(reports.alert_feed_counts),
    "attack_type_distribution": _scored_query(reports.attack_type_distribution),
    "event_type_breakdown": entity(reports.event_type_breakdown),
    "risk_histogram": _scored_query(reports.risk_histogram),
    "entity_summary": _scored_query(
        lambda df: reports.entity_summary(df, "source_ip")
    ),
    "detector_agreement": _scored_query(reports.detector_agreement),
    "attack_by_detector": _scored_query(
        lambda df: reports.attack_by_detector(df).select(
            "predicted_attack_type",
            F.col("Rule Engine").alias("rules"),
            F.col("Isolation Forest").alias("forest"),
            F.col("Markov").alias("markov"),
        )
    ),
    "hourly_attacks": _scored_query(reports.hourly_attacks),
    "risk_box_stats": _scored_query(
        lambda df: reports.risk_box_stats(df).select(
            "predicted_attack_type", *[r6(c) for c in ("low", "q1", "median", "q3", "high")]
        )
    ),
    "confusion_matrix": _scored_query(
        lambda df: reports.confusion_matrix(df).select(
            "tp", "fp", "fn", "tn", *[r6(c) for c in ("precision", "recall", "accuracy", "f1")]
        )
    ),
    "attack_summary": _scored_query(reports.attack_summary),
    "ground_truth_counts": _log_query(
        lambda df: reports.ground_truth_counts(df).select("attack_type", "n", "attacks", r6("share"))
    ),
    "minmax_scale": _log_query(_minmax),
    "percentile_threshold": _log_query(_percentile),
    "standardize": _standardize,
    # Windows
    "running_entropy": _stage_query(
        FT.running_entropy, "event_type_entropy"),
    "seconds_since_prev": _stage_query(
        FT.seconds_since_prev, "seconds_since_prev"),
    "minutes_since_prev": _stage_query(
        FT.seconds_since_prev, "minutes_since_prev"),
    "seconds_since_prev_same_type": _stage_query(
        FT.seconds_since_prev_same_type, "seconds_since_prev_same_type"
    ),
    "cumulative_event_count": _stage_query(
        FT.cumulative_event_count, "cumulative_event_count"),
    "is_first_event_of_day": _stage_query(
        FT.day_boundaries, "is_first_event_of_day"),
    "is_last_event_of_day": _stage_query(
        FT.day_boundaries, "is_last_event_of_day"),
    "transition_flags": _stage_query(
        FT.transition_flags, *TRANSITION_FEATURES),
    "cumulative_devices_seen": _stage_query(
        FT.novelty_features, "cumulative_devices_seen"),
    "is_new_device": _stage_query(
        FT.novelty_features, "is_new_device"),
    "is_new_ip": _stage_query(
        FT.novelty_features, "is_new_ip"),
    "feature_matrix": lambda spark, folder: features(spark, folder).select(
        "event_id",
        *[F.round(F.col(c).cast("double"), 6).alias(c) for c in FEATURES],
    ),
    "rolling_window_mask": _trailing_count,
    "rolling_failed_logins": _failed_logins,
    "rolling_unique_resources": _unique_resources,
    "half_split_rates": _half_rates,
    "daily_user_total": _daily_total,
    # Joins, sorts, limits
    "ip_semi_join": _log_query(_ip_semi_join),
    "agg_join_back": _agg_join_back,
    "prob_lookup_join": _prob_lookup,
    "sort_user_time": _log_query(
        lambda df: ntz(df.orderBy("user_id", "timestamp", "event_id").select("user_id", "timestamp", "event_id"))
    ),
    "alert_topk": _scored_query(
        lambda df: reports.alert_topk(df).select("event_id", "predicted_attack_type", "risk_score", "risk_level")
    ),
    "entity_values": _log_query(lambda df: reports.entity_values(df, "device_id")),
    "entity_timeline": entity(lambda df, k, v: ntz(reports.entity_timeline(df, k, v))),
    "entity_risk_series": entity(lambda df, k, v: ntz(reports.entity_risk_series(df, k, v))),
    # Rules
    "rule_brute_force": _rule_query("brute_force_login"),
    "rule_impossible_travel": _rule_query("impossible_travel"),
    "rule_credential_stuffing": _rule_query("credential_stuffing"),
    "rule_lateral_movement": _rule_query("lateral_movement"),
    "rule_device_spoofing": _rule_query("device_spoofing"),
    "rule_exfiltration": _rule_query("low_and_slow_exfiltration"),
    "rule_insider_drift": _rule_query("insider_drift"),
    "rules_combined": lambda spark, folder: R.evaluate(
        log(spark, folder), None, timeline(spark, folder), RULES
    ).select("event_id", *R.RULE_COLUMNS),
    "rule_trigger_counts": _trigger_counts,
    "add_rule": _custom_rule,
    "rule_credential_stuffing_windowed": _variant(
        "stuffing_windowed", "credential_stuffing",
        batch=lambda df, hit: R.credential_stuffing_windowed(df, hit, cfg=RULES, scale=CONFIG.scale),
    ),
    "rule_impossible_travel_geo": _variant(
        "travel_geo", "impossible_travel", parts=R.impossible_travel_geo
    ),
    # Sequence model
    "user_sequences": _sequences,
    "markov_transitions": _markov_transitions(1),
    "markov_transitions_order2": _markov_transitions(2),
    "markov_counts": _markov_counts(1),
    "markov_counts_order2": _markov_counts(2),
    "markov_probs": _markov_probs,
    "markov_threshold": _markov_threshold,
    "markov_score_raw": _markov_raw,
    "markov_score_raw_order2": _markov_second_order,
    "markov_predict": lambda spark, folder: _markov_table(spark, folder).select(
        "event_id", "markov_label", "markov_is_anomaly"
    ),
    "markov_score": lambda spark, folder: _markov_table(spark, folder).select("event_id", r6("markov_score")),
    # Forest
    "iforest_sample": _forest_sample,
    "iforest_fit": _forest_fit,
    "iforest_score": _forest_score,
    "iforest_predict": lambda spark, folder: _forest_table(spark, folder).select(
        "event_id", "iso_anomaly_label", "iso_is_anomaly"
    ),
    "iforest_normalized": lambda spark, folder: _forest_table(spark, folder).select(
        "event_id", r6("iso_anomaly_score")
    ),
    # Fusion
    "composite_score": lambda spark, folder: detector_log(spark, folder).select(
        "event_id", F.round(composite_score(), 6).alias("composite_score")
    ),
    "risk_score": _scored_query(lambda df: df.select("event_id", "risk_score")),
    "predicted_attack_type": _scored_query(lambda df: df.select("event_id", "predicted_attack_type")),
    "heuristic_attack_type": lambda spark, folder: detector_log(spark, folder).select(
        "event_id", heuristic_attack_type().alias("guess")
    ),
    "classify": _scored_query(
        lambda df: df.select(
            "event_id", r6("composite_score"), "risk_score", "predicted_attack_type", "risk_level", "risk_color"
        )
    ),
    "score_events": _score_events,
    # Streams, replayed from the activity table
    "stream_brute_force": lambda spark, folder: keyed.replay(
        configure(spark), folder,
        lambda events, out: jobs.brute_force(
            events, out, window="3 days", slide="12 hours", failures=RULES.brute_force_failures
        ),
        jobs.latest_brute_force, spread="0 seconds",
    ).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "failures"),
    "stream_daily_exfil": lambda spark, folder: keyed.replay(
        configure(spark), folder,
        lambda events, out: jobs.daily_exfiltration(events, out, RULES.exfiltration_kb),
        jobs.latest_daily_exfiltration, spread="0 seconds",
    ).select("user_id", F.col("event_date").cast("string").alias("event_date"), "moved"),
    # The keyed ones get all times in every batch, or rows up to a day early or late.
    "stream_new_device": lambda spark, folder: keyed.replay(
        configure(spark), folder, lambda events, out: keyed.new_devices(events, out, partitions=8),
        keyed.latest_new_devices,
    ).select("event_id", "user_id"),
    "stream_brute_force_rows": lambda spark, folder: keyed.replay(
        configure(spark), folder,
        lambda events, out: keyed.brute_force(
            events, out, RULES.brute_force_minutes, RULES.brute_force_failures, "3 days", partitions=8
        ),
        jobs.read_alerts, spread="1 day", closing="4 days",
    ).select("event_id", "user_id"),
    "stream_markov": lambda spark, folder: keyed.replay(
        configure(spark), folder,
        lambda events, out: keyed.sequence_scores(events, out, markov_model(spark, folder), "3 days", partitions=8),
        jobs.read_alerts, spread="1 day", closing="4 days",
    ).select("event_id", r6("markov_raw")),
    "stream_score": lambda spark, folder: keyed.replay(
        configure(spark), folder,
        lambda events, out: scoring.risk_scores(events, out, scoring_model(spark, folder), partitions=8),
        jobs.read_alerts, spread="0 seconds",
    ).select("event_id", "risk_score", "risk_level", "predicted_attack_type"),
}
