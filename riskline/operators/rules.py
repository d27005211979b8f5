"""Declarative detection rules over the event log.

A rule yields one boolean column. Rules over a user's own events are merged into one
stage of the timeline, so windows in the same order are computed together.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskline.config import RuleConfig, ScaleConfig
from riskline.functions import scalar as S
from riskline.operators.joins import lookup_join
from riskline.operators.timeline import Level, Previous, Running, Stage, Timeline, Total
from riskline.schema import ATTACK_SEVERITY

RULE_COLUMNS = ("rule_anomaly", "rule_names", "rule_severity", "rule_attack_type")
MINUTE = 60 * S.MICROS
HOUR = 60 * MINUTE


@dataclass(frozen=True)
class Rule:
    """A named condition. Its ``stage`` holds one boolean column called ``hit_<name>``.

    A rule over the whole batch has a function instead, ``batch(df, hit)``, which adds
    that column and keeps all rows.
    """

    name: str
    description: str
    attack_type: str
    severity: int
    stage: Stage = Stage()
    batch: Callable[[DataFrame, str], DataFrame] | None = None
    needs: tuple[str, ...] = ()

    @classmethod
    def where(
        cls, name: str, description: str, attack_type: str, severity: int,
        condition: Column, stage: Stage = Stage(), needs: Sequence[str] = (),
    ) -> Rule:
        """A rule given by a condition on the log's columns and those of ``stage``."""
        hit = {f"hit_{name}": F.coalesce(condition, F.lit(False))}
        stage = stage | (Stage(late=hit) if stage.second else Stage(early=hit))
        return cls(name, description, attack_type, severity, stage, None, tuple(needs))

    @property
    def hit(self) -> str:
        return f"hit_{self.name}"


def failed_logins(minutes: int, name: str = "_failures") -> Stage:
    """Failed logins of the user in the closed window that ends at each row."""
    failed = F.coalesce((S.is_login() & ~F.col("success")).cast("int"), F.lit(0))
    return Stage(levels={name: Level(failed, failed, minutes * MINUTE)})


def _stays(previous: str, following: str, span: int) -> tuple[Column, Column]:
    """Whether a sighting begins or ends a run of sightings at most a window apart."""
    us = S.micros("timestamp")
    begins = F.coalesce(us - S.micros(previous) > span, F.lit(True))
    ends = F.coalesce(S.micros(following) - us > span, F.lit(True))
    return begins, ends


def distinct_resources(hours: int, name: str = "_distinct") -> Stage:
    """Distinct resources of the user in the closed window that ends at each row.

    Sightings of one resource at most a window apart form one stay, so each resource
    counts once however often it is touched.
    """
    span = hours * HOUR
    begins, ends = _stays("_last_resource", "_next_resource", span)
    known = F.col("resource").isNotNull()
    return Stage(
        grouped={
            "_last_resource": Previous(by=("resource",)),
            "_next_resource": Previous(by=("resource",), ahead=True),
        },
        levels={name: Level((begins & known).cast("int"), (ends & known).cast("int"), span)},
    )


def daily_transfer(name: str = "_moved") -> Stage:
    """Bytes the user's transfer events moved on the row's calendar date."""
    moved = F.when(S.is_transfer(), F.col("bytes_transferred")).otherwise(0)
    return Stage(
        keys={"_date": F.to_date("timestamp")},
        grouped={name: Total(F.sum, moved, by=("_date",))},
    )


def half_rates() -> Stage:
    """Night share of the first half of a user's events and of the rest."""
    night = S.is_night()
    n1 = F.floor(F.col("_events") / 2)
    in_first = F.col("_position") <= n1
    return Stage(
        whole={"_position": Running(F.lit(1)), "_events": Total(F.sum, F.lit(1))},
        second={
            "_night1": Total(F.sum, F.when(in_first, night).otherwise(0)),
            "_night2": Total(F.sum, F.when(in_first, 0).otherwise(night)),
        },
        late={
            "half": F.when(in_first, 1).otherwise(2),
            "first_rate": F.try_divide(F.col("_night1"), n1),
            "second_rate": F.try_divide(F.col("_night2"), F.col("_events") - n1),
        },
    )


def brute_force(cfg: RuleConfig) -> tuple[Stage, Column]:
    stage = failed_logins(cfg.brute_force_minutes)
    return stage, S.is_login() & (F.col("_failures") >= cfg.brute_force_failures)


def impossible_travel(cfg: RuleConfig) -> tuple[Stage, Column]:
    last = Previous(F.struct("timestamp", "source_ip"), where=S.is_login())
    gap = S.micros("timestamp") - S.micros("_login.timestamp")
    moved = F.col("source_ip") != F.col("_login.source_ip")
    soon = (gap > 0) & (gap < F.lit(cfg.travel_max_hours * HOUR))
    return Stage(whole={"_login": last}), S.is_login() & moved & soon


def impossible_travel_geo(cfg: RuleConfig) -> tuple[Stage, Column]:
    """Located logins further apart than the distance bound within the time bound."""
    located = S.is_login() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    last = Previous(F.struct("timestamp", "latitude", "longitude"), where=located)
    gap = S.micros("timestamp") - S.micros("_place.timestamp")
    km = S.haversine_km("_place.latitude", "_place.longitude", "latitude", "longitude")
    soon = (gap > 0) & (gap < F.lit(cfg.travel_max_hours * HOUR))
    return Stage(whole={"_place": last}), located & soon & (km >= cfg.travel_min_km)


def login_pairs(df: DataFrame) -> DataFrame:
    """The distinct (address, user) of logins."""
    return df.filter(S.is_login()).select("source_ip", "user_id").distinct()


def users_per_ip(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Distinct users that logged in from each address: pairs are merged before they move.

    ``known`` are pairs from elsewhere, such as earlier parts of a stream.
    """
    pairs = login_pairs(df)
    pairs = pairs if known is None else pairs.union(known.select("source_ip", "user_id")).distinct()
    return pairs.groupBy("source_ip").agg(F.count("user_id").alias("users"))


def crowded_addresses(df: DataFrame, cfg: RuleConfig, known: DataFrame | None = None) -> DataFrame:
    flagged = users_per_ip(df, known).filter(F.col("users") >= cfg.stuffing_users)
    return flagged.select("source_ip", F.lit(True).alias("_flagged"))


def logins_from_crowded(df: DataFrame, cfg: RuleConfig) -> DataFrame:
    """The logins from addresses that many users log in from."""
    joined = lookup_join(df.filter(S.is_login()), crowded_addresses(df, cfg), ["source_ip"])
    return joined.filter("_flagged").drop("_flagged")


def credential_stuffing(
    df: DataFrame, hit: str, *, cfg: RuleConfig, known: DataFrame | None = None
) -> DataFrame:
    df = lookup_join(df, crowded_addresses(df, cfg, known), ["source_ip"])
    return df.withColumn(hit, S.is_login() & F.col("_flagged").isNotNull()).drop("_flagged")


def users_per_ip_in_window(df: DataFrame, name: str, minutes: int, scale: ScaleConfig) -> DataFrame:
    """Logins with the distinct users of their address in the closed trailing window."""
    logins = df.filter(S.is_login())
    span = minutes * MINUTE
    begins, ends = _stays("_last_user", "_next_user", span)
    stage = Stage(
        grouped={
            "_last_user": Previous(by=("user_id",)),
            "_next_user": Previous(by=("user_id",), ahead=True),
        },
        levels={"_users": Level(begins.cast("int"), ends.cast("int"), span)},
        early={name: F.col("_users")},
    )
    per_ip = Timeline.plan(logins, scale, key="source_ip")
    return per_ip.run(per_ip.arrange(logins), stage).select(*df.columns, name)


def credential_stuffing_windowed(
    df: DataFrame, hit: str, *, cfg: RuleConfig, scale: ScaleConfig
) -> DataFrame:
    logins = users_per_ip_in_window(df, "_users", cfg.stuffing_minutes, scale)
    logins = logins.withColumn(hit, F.col("_users") >= cfg.stuffing_users).drop("_users")
    others = df.filter(~F.coalesce(S.is_login(), F.lit(False)))
    return logins.unionByName(others.withColumn(hit, F.lit(False)))


def lateral_movement(cfg: RuleConfig) -> tuple[Stage, Column]:
    stage = distinct_resources(cfg.lateral_hours)
    return stage, F.col("_distinct") >= cfg.lateral_resources


def device_spoofing(cfg: RuleConfig) -> tuple[Stage, Column]:
    login = S.is_login()
    stage = Stage(
        grouped={"_device_login": Previous(by=("device_id",), where=login)},
        whole={"_any_login": Previous(where=login)},
    )
    return stage, login & F.col("_device_login").isNull() & F.col("_any_login").isNotNull()


def exfiltration(cfg: RuleConfig) -> tuple[Stage, Column]:
    bound = F.lit(cfg.exfiltration_kb * 1024)
    return daily_transfer(), S.is_transfer() & (F.col("_moved") > bound)


def insider_drift(cfg: RuleConfig) -> tuple[Stage, Column]:
    rates = half_rates()
    column = rates.late
    rises = column["second_rate"] > column["first_rate"] + F.lit(cfg.drift_rate_increase)
    flagged = (
        (F.col("_events") >= cfg.drift_min_events)
        & (column["half"] == 2)
        & (S.is_night() == 1)
        & rises
    )
    return Stage(whole=rates.whole, second=rates.second), flagged


def default_rules(cfg: RuleConfig = RuleConfig(), known: DataFrame | None = None) -> list[Rule]:
    """The seven rules in registration order; the order decides name lists and ties.

    ``known`` are (address, user) pairs of logins outside the log, for credential stuffing.
    """

    def rule(name, attack_type, description, parts, needs):
        stage, condition = parts
        severity = ATTACK_SEVERITY[attack_type]
        return Rule.where(name, description, attack_type, severity, condition, stage, needs)

    return [
        rule(
            "brute_force_login", "brute_force",
            "Many failed logins of one account within minutes",
            brute_force(cfg), ("event_type", "success"),
        ),
        rule(
            "impossible_travel", "impossible_travel",
            "Logins from two addresses in too short a time",
            impossible_travel(cfg), ("event_type", "source_ip"),
        ),
        Rule(
            "credential_stuffing",
            "Many accounts tried from one address",
            "credential_stuffing", ATTACK_SEVERITY["credential_stuffing"],
            batch=partial(credential_stuffing, cfg=cfg, known=known),
            needs=("event_type", "source_ip"),
        ),
        rule(
            "lateral_movement", "lateral_movement",
            "Unusually many resources touched within hours",
            lateral_movement(cfg), ("resource",),
        ),
        rule(
            "device_spoofing", "device_spoofing",
            "Login from a device the user has not logged in from",
            device_spoofing(cfg), ("event_type", "device_id"),
        ),
        rule(
            "low_and_slow_exfiltration", "low_and_slow_exfiltration",
            "Daily transfer volume above the bound",
            exfiltration(cfg), ("event_type", "bytes_transferred"),
        ),
        rule(
            "insider_drift", "insider_drift",
            "Night activity rises in the second half of the user's history",
            insider_drift(cfg), ("timestamp",),
        ),
    ]


def runnable(rules: Sequence[Rule], columns: Sequence[str]) -> list[Rule]:
    """The rules whose columns exist; the others are skipped with a warning."""
    ready = []
    for rule in rules:
        missing = [c for c in rule.needs if c not in columns]
        if missing:
            warnings.warn(f"rule {rule.name} skipped: no column {', '.join(missing)}", stacklevel=2)
        else:
            ready.append(rule)
    return ready


def combine(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Fold the hit columns into flag, names, highest severity and first attack type."""
    if not rules:
        return df.withColumns(
            {
                "rule_anomaly": F.lit(0), "rule_names": F.lit(""),
                "rule_severity": F.lit(0), "rule_attack_type": F.lit("none"),
            }
        )
    names = [F.when(F.col(r.hit), F.lit(r.name)) for r in rules]
    severities = [F.when(F.col(r.hit), F.lit(r.severity)) for r in rules]
    types = [F.when(F.col(r.hit), F.lit(r.attack_type)) for r in rules]
    return df.withColumns(
        {
            "rule_anomaly": F.coalesce(*[F.when(F.col(r.hit), F.lit(1)) for r in rules], F.lit(0)),
            "rule_names": F.concat_ws(",", *names),
            "rule_severity": F.greatest(*severities, F.lit(0)),
            "rule_attack_type": F.coalesce(*types, F.lit("none")),
        }
    ).drop(*[r.hit for r in rules])


def batch_flags(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Hits of the rules over the whole batch, taken before the log is laid out by user."""
    for rule in rules:
        if rule.batch is not None:
            df = rule.batch(df, rule.hit)
    return df


def user_stage(rules: Sequence[Rule]) -> Stage:
    """The stages of all rules over a user's own events, as one."""
    return reduce(or_, [rule.stage for rule in rules], Stage())


def evaluate(
    events: DataFrame,
    rules: Sequence[Rule] | None = None,
    timeline: Timeline | None = None,
    cfg: RuleConfig = RuleConfig(),
    scale: ScaleConfig = ScaleConfig(),
) -> DataFrame:
    """Run the rules over the log and add the four combined columns."""
    timeline = timeline or Timeline.plan(events, scale)
    rules = runnable(default_rules(cfg) if rules is None else rules, events.columns)
    df = timeline.run(timeline.arrange(batch_flags(events, rules)), user_stage(rules))
    return combine(df, rules).select(*events.columns, *RULE_COLUMNS)


def flag_rows(
    events: DataFrame,
    rule: Rule,
    timeline: Timeline | None = None,
    scale: ScaleConfig = ScaleConfig(),
) -> DataFrame:
    """The rows one rule hits."""
    df = batch_flags(events, [rule])
    if rule.batch is None:
        timeline = timeline or Timeline.plan(events, scale)
        df = timeline.run(timeline.arrange(df), rule.stage)
    return df.filter(rule.hit).select(*events.columns)


def rule_trigger_counts(df: DataFrame) -> DataFrame:
    """Hits per rule, taken from the comma-joined names."""
    names = df.select(F.explode(F.split("rule_names", ",")).alias("rule_name"))
    counts = names.filter(F.col("rule_name") != "").groupBy("rule_name").agg(
        F.count(F.lit(1)).alias("hits")
    )
    return counts.orderBy(F.desc("hits"), "rule_name")
