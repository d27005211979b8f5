"""The 43 behavioural features as column expressions and windows over each user's time order.

Each function returns a :class:`Stage`; ``Timeline.run`` adds its columns to the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskline.functions import scalar as S
from riskline.operators.timeline import Previous, Running, Stage, Timeline, Total
from riskline.schema import EVENT_TYPES, FEATURES, NOT_FEATURES, TRANSITIONS


def temporal_features() -> Stage:
    ts = F.col("timestamp")
    weekday = F.weekday(ts)
    return Stage(
        early={
            "hour": F.hour(ts),
            "minute": F.minute(ts),
            "day_of_week": weekday,
            "is_weekend": (weekday >= 5).cast("int"),
            "is_night": S.is_night(ts),
            "day_of_month": F.dayofmonth(ts),
            "week_of_year": F.weekofyear(ts),
        }
    )


def event_type_onehot() -> Stage:
    def flag(label: str) -> Column:
        return F.coalesce((F.col("event_type") == label).cast("int"), F.lit(0))

    return Stage(early={f"etype_{t}": flag(t) for t in EVENT_TYPES})


def _first_sighting(column: str) -> Column:
    return (F.col(f"_last_{column}").isNull() & F.col(column).isNotNull()).cast("int")


def _sightings(*columns: str) -> dict[str, Previous]:
    return {f"_last_{c}": Previous(by=(c,)) for c in columns}


def frequency_features() -> Stage:
    """Per-user counts, distinct counts, login failure rate and byte statistics.

    A distinct count is the number of first sightings, so no set is ever collected.
    """
    login, failed, size = S.is_login(), ~F.col("success"), F.col("bytes_transferred")
    rate = S.safe_divide_positive("_failed", "_logins")
    mean = S.safe_divide_positive("_bytes", "_events")
    return Stage(
        grouped=_sightings("source_ip", "device_id", "resource"),
        whole={
            "_ips": Total(F.sum, _first_sighting("source_ip")),
            "_devices": Total(F.sum, _first_sighting("device_id")),
            "_resources": Total(F.sum, _first_sighting("resource")),
            "_events": Total(F.sum, F.lit(1)),
            "_logins": Total(F.sum, login.cast("int")),
            "_failed": Total(F.sum, (login & failed).cast("int")),
            "_bytes": Total(F.sum, size),
            "_largest": Total(F.max, size),
        },
        early={
            "events_in_window": F.col("_events"),
            "unique_ips": F.col("_ips"),
            "unique_devices": F.col("_devices"),
            "unique_resources": F.col("_resources"),
            "login_failure_rate": F.when(login, rate).otherwise(0.0),
            "total_bytes_user": F.col("_bytes"),
            "mean_bytes_user": mean,
            "max_bytes_user": F.col("_largest"),
        },
    )


def running_entropy() -> Stage:
    """Entropy in bits of the user's event types so far, the current row included.

    With counts c summing to n it equals log2(n) - sum(c * log2(c)) / n. A row takes
    its own type from c-1 to c, so the sum is a running sum of differences: one pass
    serves any set of types. The last term is the floor inside the logarithm.
    """
    c = F.col("_of_type").cast("double")
    gain = c * F.log2(c) - F.when(c > 1, (c - 1) * F.log2(c - 1)).otherwise(0.0)
    floor = F.col("_types") * F.lit(S.LOG_FLOOR) / F.log(F.lit(2.0))
    entropy = F.log2(F.col("_position")) - F.col("_clogc") / F.col("_position") - floor
    return Stage(
        grouped={"_of_type": Running(F.lit(1), by=("event_type",))},
        whole={
            "_position": Running(F.lit(1)),
            "_clogc": Running(gain),
            "_types": Running((F.col("_of_type") == 1).cast("int")),
        },
        late={"event_type_entropy": entropy},
    )


def _seconds_since(column: str) -> Column:
    gap = (S.micros("timestamp") - S.micros(column)) / F.lit(float(S.MICROS))
    return F.coalesce(gap, F.lit(-1.0))


def seconds_since_prev() -> Stage:
    seconds = _seconds_since("_prev_time")
    return Stage(
        whole={"_prev_time": Previous()},
        early={"seconds_since_prev": seconds, "minutes_since_prev": seconds / 60.0},
    )


def seconds_since_prev_same_type() -> Stage:
    return Stage(
        grouped={"_prev_of_type": Previous(by=("event_type",))},
        early={"seconds_since_prev_same_type": _seconds_since("_prev_of_type")},
    )


def cumulative_event_count() -> Stage:
    return Stage(
        whole={"_position": Running(F.lit(1))},
        early={"cumulative_event_count": F.col("_position")},
    )


def day_boundaries() -> Stage:
    """First and last event of the user's day: the neighbour lies on another date."""

    def other_day(column: str) -> Column:
        differs = F.to_date(column) != F.to_date("timestamp")
        return F.coalesce(differs, F.lit(True)).cast("int")

    return Stage(
        whole={"_prev_time": Previous(), "_next_time": Previous(ahead=True)},
        early={
            "is_first_event_of_day": other_day("_prev_time"),
            "is_last_event_of_day": other_day("_next_time"),
        },
    )


def sequence_features() -> Stage:
    return (
        seconds_since_prev()
        | seconds_since_prev_same_type()
        | cumulative_event_count()
        | day_boundaries()
    )


def transition_flags() -> Stage:
    def flag(source: str, target: str) -> Column:
        follows = (F.col("_prev_type") == source) & (F.col("event_type") == target)
        return F.coalesce(follows.cast("int"), F.lit(0))

    return Stage(
        whole={"_prev_type": Previous(F.col("event_type"))},
        early={f"trans_{a}_to_{b}": flag(a, b) for a, b in TRANSITIONS},
    )


def novelty_features() -> Stage:
    return Stage(
        grouped=_sightings("source_ip", "device_id"),
        whole={"_devices_so_far": Running(_first_sighting("device_id"))},
        early={
            "is_new_device": _first_sighting("device_id"),
            "is_new_ip": _first_sighting("source_ip"),
        },
        late={"cumulative_devices_seen": F.col("_devices_so_far")},
    )


def all_features() -> Stage:
    return (
        temporal_features()
        | frequency_features()
        | event_type_onehot()
        | running_entropy()
        | sequence_features()
        | transition_flags()
        | novelty_features()
    )


def add_features(
    events: DataFrame, stage: Stage | None = None, timeline: Timeline | None = None
) -> DataFrame:
    """Add the columns of a feature stage (all of them by default) to the log."""
    stage = all_features() if stage is None else stage
    if not (stage.grouped or stage.levels or stage.whole or stage.second):
        return events.withColumns({**stage.early, **stage.late})
    timeline = timeline or Timeline.plan(events)
    df = timeline.run(timeline.arrange(events), stage)
    return df.drop(*[k for k in timeline.keys if k not in events.columns])


def feature_matrix(events: DataFrame, timeline: Timeline | None = None) -> DataFrame:
    """The log with its 43 feature columns; the names are in ``schema.FEATURES``."""
    df = add_features(events, None, timeline)
    return df.select(*events.columns, *[c for c in FEATURES if c not in events.columns])


def infer_feature_columns(df: DataFrame) -> list[str]:
    """Numeric or boolean columns that are neither labels nor coordinates."""
    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, (T.NumericType, T.BooleanType))
        and f.name not in NOT_FEATURES
        and not f.name.startswith("_")
    ]
