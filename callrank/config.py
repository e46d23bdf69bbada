"""Job parameters. All are plain values known before any Spark job starts."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from datetime import date

from callrank.sources.schemas import COMPETITORS, CONTACTS, LEADS

WEIGHT_TOLERANCE = 0.001


# Names and defaults below are those that users of the scoring model carry over.


@dataclass(frozen=True)
class Weights:
    """Share of each component in the readiness score.

    ``extra`` names the weights of added scorers; a scorer without one counts 0.
    """

    engagement: float = 0.40
    profile: float = 0.25
    account: float = 0.20
    momentum: float = 0.15
    extra: tuple[tuple[str, float], ...] = ()

    def by_column(self) -> dict[str, float]:
        return {
            "score_engagement": self.engagement,
            "score_profile": self.profile,
            "score_account": self.account,
            "score_momentum": self.momentum,
            **dict(self.extra),
        }

    def total(self) -> float:
        return sum(self.by_column().values())

    def validate(self) -> Weights:
        if abs(self.total() - 1.0) > WEIGHT_TOLERANCE:
            raise ValueError(f"weights must sum to 1, they sum to {self.total()}")
        return self

    def normalised(self) -> Weights:
        """Divide by the total, as the what-if explorer does."""
        total = self.total()
        if total == 0:
            raise ValueError("weights cannot all be zero")
        return Weights(
            self.engagement / total,
            self.profile / total,
            self.account / total,
            self.momentum / total,
            tuple((name, weight / total) for name, weight in self.extra),
        )

    @classmethod
    def parse(cls, text: str) -> Weights:
        """Read ``0.4,0.25,0.2,0.15``."""
        parts = [float(p) for p in text.split(",")]
        if len(parts) != 4:
            raise ValueError("four comma-separated weights are needed")
        return cls(*parts).validate()


@dataclass(frozen=True)
class EngagementParams:
    half_life_days: float = 45.0
    volume_weight_30d: float = 20.0
    volume_weight_90d: float = 5.0
    diversity_bonus_per_type: float = 10.0
    diversity_cap: float = 30.0
    automation_penalty_factor: float = 30.0
    webinar_value: float = 15.0
    event_value: float = 20.0
    content_value: float = 10.0
    high_value_cap: float = 40.0
    recency_weight: float = 0.4
    volume_weight: float = 0.3


@dataclass(frozen=True)
class TierThresholds:
    hot: float = 70.0
    warm: float = 45.0
    nurture: float = 20.0


@dataclass(frozen=True)
class JobConfig:
    input_dir: str = ""
    output_dir: str = ""
    input_format: str = "csv"
    output_format: str = "parquet"
    reference_date: date = date(2025, 5, 15)
    weights: Weights = field(default_factory=Weights)
    tiers: TierThresholds = field(default_factory=TierThresholds)
    engagement: EngagementParams = field(default_factory=EngagementParams)
    competitors: tuple[str, ...] = COMPETITORS
    lead_etl_threshold: int = 20
    contact_etl_threshold: int = 10
    lead_baseline: float = 15.0
    # "null" keeps an unknown intent unknown, so the record has no score and sorts last;
    # "zero" counts it as no intent.
    missing_intent: str = "null"
    # Count the raw dq_reason and dq_date columns of leads as two more issues.
    legacy_dq_count: bool = False
    # Also call a conversion broken when its contact id exists in no contact.
    check_dangling: bool = False
    # CSV: keep quoted line breaks inside their record, which makes each file one task; what to do with values
    # that don't fit their column ("null" or "fail").
    multi_line: bool = True
    on_malformed: str = "null"
    # Columns of leads or contacts beside the known ones, with their types, for added scorers.
    own_columns: tuple[tuple[str, str], ...] = ()

    def __post_init__(self):
        self.weights.validate()
        if not self.engagement.half_life_days > 0:
            raise ValueError(f"the half-life must be above 0, it is {self.engagement.half_life_days}")
        if not self.tiers.hot >= self.tiers.warm >= self.tiers.nurture:
            raise ValueError(f"tier thresholds must not rise from hot to nurture: {self.tiers}")
        if self.missing_intent not in ("null", "zero"):
            raise ValueError("missing_intent is 'null' or 'zero'")
        if self.on_malformed not in ("null", "fail"):
            raise ValueError("on_malformed is 'null' or 'fail'")
        known = {name for table in (LEADS, CONTACTS) for name in table.names}
        if taken := sorted(known & {name for name, _ in self.own_columns}):
            raise ValueError(f"own columns that the tables have anyway: {taken}")

    @classmethod
    def from_env(cls, env: Mapping[str, str], **overrides) -> JobConfig:
        """Parameters from environment variables, unset ones at their defaults."""
        base = cls()

        def number(name: str, default: float) -> float:
            return float(env.get(name, default))

        return replace(
            base,
            input_dir=env.get("DATA_DIR", base.input_dir),
            weights=Weights(
                number("ENGAGEMENT_WEIGHT", base.weights.engagement),
                number("PROFILE_WEIGHT", base.weights.profile),
                number("ACCOUNT_WEIGHT", base.weights.account),
                number("MOMENTUM_WEIGHT", base.weights.momentum),
            ),
            tiers=TierThresholds(
                number("HOT_THRESHOLD", base.tiers.hot),
                number("WARM_THRESHOLD", base.tiers.warm),
                number("NURTURE_THRESHOLD", base.tiers.nurture),
            ),
            engagement=replace(
                base.engagement,
                half_life_days=number("HALF_LIFE_DAYS", base.engagement.half_life_days),
            ),
            **overrides,
        )
