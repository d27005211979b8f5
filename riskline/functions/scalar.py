"""Column expressions. All of them stay inside whole-stage code generation."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskline.schema import (
    ATTACK_SEVERITY, LOGIN_TYPES, RISK_COLORS, RISK_LEVELS, TRANSFER_TYPES,
)

MICROS = 1_000_000
EARTH_RADIUS_KM = 6371.0
LOG_FLOOR = 1e-12


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _num(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def is_login(event_type="event_type") -> Column:
    return _c(event_type).isin(*LOGIN_TYPES)


def is_transfer(event_type="event_type") -> Column:
    return _c(event_type).isin(*TRANSFER_TYPES)


def is_alert(label="predicted_attack_type") -> Column:
    return _c(label) != "normal"


def is_night(timestamp="timestamp") -> Column:
    hour = F.hour(_c(timestamp))
    return ((hour >= 22) | (hour <= 5)).cast("int")


def micros(timestamp="timestamp") -> Column:
    return F.unix_micros(_c(timestamp))


def safe_divide(numerator, denominator, default: float = 0.0) -> Column:
    """``numerator / denominator``, or ``default`` where the denominator is zero."""
    num, den = _c(numerator), _c(denominator)
    return F.when(den == 0, F.lit(float(default))).otherwise(F.try_divide(num, den))


def safe_divide_positive(numerator, denominator) -> Column:
    """``numerator / denominator`` where the denominator is positive, else zero."""
    num, den = _c(numerator), _c(denominator)
    return F.when(den > 0, F.try_divide(num, den)).otherwise(F.lit(0.0))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in kilometres."""
    lat1, lon1, lat2, lon2 = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    half_lat, half_lon = F.sin((lat2 - lat1) / 2), F.sin((lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(lat1) * F.cos(lat2) * half_lon * half_lon
    # Rounding may take the haversine of antipodes a hair above one.
    a = F.least(a, F.lit(1.0))
    return 2 * EARTH_RADIUS_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def time_delta_hours(first, second) -> Column:
    return F.abs(micros(second) - micros(first)) / F.lit(3600.0 * MICROS)


def format_timestamp(timestamp, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(_c(timestamp), pattern)


def _banded(score, bands, labels) -> Column:
    score = _c(score)
    out = F.when(score < bands[0], labels[0])
    for bound, label in zip(bands[1:], labels[1:]):
        out = out.when(score < bound, label)
    return out.otherwise(labels[-1])


def risk_level(score="risk_score", bands=(25, 50, 75)) -> Column:
    return _banded(score, bands, RISK_LEVELS)


def risk_color(score="risk_score", bands=(25, 50, 75)) -> Column:
    return _banded(score, bands, RISK_COLORS)


def detector_source(rule="rule_anomaly", forest="iso_is_anomaly") -> Column:
    """The detector an alert is credited to: rules before forest before sequence model."""
    return (
        F.when(_c(rule) == 1, "Rule Engine")
        .when(_c(forest) == 1, "Isolation Forest")
        .otherwise("Markov")
    )


def severity_of(attack_type="predicted_attack_type", default: int = 0) -> Column:
    pairs = chain.from_iterable((F.lit(k), F.lit(v)) for k, v in ATTACK_SEVERITY.items())
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _c(attack_type)), F.lit(default))


def severity_tier(severity) -> Column:
    sev = _c(severity)
    return F.when(sev >= 4, "red").when(sev >= 3, "yellow").otherwise("green")


def attack_type_title(attack_type) -> Column:
    return F.initcap(F.replace(_c(attack_type), F.lit("_"), F.lit(" ")))


def round_half_even(value, digits: int) -> Column:
    return F.bround(_c(value), digits)


def event_date(timestamp="timestamp") -> Column:
    return F.to_date(_c(timestamp))


def log_prob(probability) -> Column:
    return F.log(_num(probability) + F.lit(LOG_FLOOR))


def clean_numeric(column) -> Column:
    """The value as a double, with null, NaN and infinities replaced by zero."""
    x = _c(column).cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, 0.0).otherwise(x)
