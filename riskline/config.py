"""Parameters of every stage. The defaults are the production thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class RuleConfig:
    brute_force_minutes: int = 15
    brute_force_failures: int = 5
    travel_max_hours: float = 0.25
    travel_min_km: float = 500.0
    stuffing_users: int = 5
    stuffing_minutes: int = 30
    lateral_hours: int = 2
    lateral_resources: int = 18
    exfiltration_kb: float = 40000.0
    drift_rate_increase: float = 3.5 * 0.1
    drift_min_events: int = 20


@dataclass(frozen=True)
class MarkovConfig:
    order: int = 1
    smoothing: float = 1e-6
    threshold_percentile: float = 5.0


@dataclass(frozen=True)
class ForestConfig:
    trees: int = 200
    sample_size: int = 256
    contamination: float = 0.08
    seed: int = 42


@dataclass(frozen=True)
class RiskConfig:
    forest_weight: float = 0.35
    rule_weight: float = 0.40
    markov_weight: float = 0.25
    low: float = 25
    medium: float = 50
    high: float = 75

    @property
    def bands(self) -> tuple[float, float, float]:
        return (self.low, self.medium, self.high)


@dataclass(frozen=True)
class ScaleConfig:
    """Bounds on what one task or one broadcast may hold."""

    # A user with more events than this is cut into time slices of about this many.
    max_rows_per_slice: int = 1_000_000
    # A log of more rows than this for each core is laid out over tasks of about this many.
    rows_per_task: int = 65_536
    # Slices grow rather than that the list of cut users exceeds this many rows.
    max_broadcast_rows: int = 500_000


@dataclass(frozen=True)
class ScoringConfig:
    rules: RuleConfig = field(default_factory=RuleConfig)
    markov: MarkovConfig = field(default_factory=MarkovConfig)
    forest: ForestConfig = field(default_factory=ForestConfig)
    risk: RiskConfig = field(default_factory=RiskConfig)
    scale: ScaleConfig = field(default_factory=ScaleConfig)
