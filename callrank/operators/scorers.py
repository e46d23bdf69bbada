"""Component scorers and the readiness score.

A scorer is a name and a function that gives a Column. To add a dimension or swap one, build another
tuple of scorers; nothing is mutated.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callrank.config import EngagementParams, JobConfig, TierThresholds, Weights
from callrank.functions.exprs import add_columns, cap, clip, number, round_half_even
from callrank.sources.crm import require_columns
from callrank.sources.schemas import DECAY_RATE, NO_ENGAGEMENT_DAYS

COMPONENTS = ["score_engagement", "score_profile", "score_account", "score_momentum"]


@dataclass(frozen=True)
class Scorer:
    name: str
    expr: Callable[[], Column]


def engagement_scorer(params: EngagementParams = EngagementParams()) -> Scorer:
    """Recency with exponential decay, volume, variety and high-value touches, less automation."""
    n = {name: number(value) for name, value in vars(params).items()}
    recency = (
        f"CASE WHEN days_since_last_engagement >= {NO_ENGAGEMENT_DAYS} THEN 0D ELSE 100D * "
        f"exp({number(-DECAY_RATE)} * days_since_last_engagement / {n['half_life_days']}) END"
    )
    volume = cap(
        f"engagement_last_30d * {n['volume_weight_30d']} "
        f"+ engagement_last_90d * {n['volume_weight_90d']}",
        100.0,
    )
    variety = cap(
        f"campaign_type_diversity * {n['diversity_bonus_per_type']}", params.diversity_cap
    )
    high_value = cap(
        f"webinar_attendances * {n['webinar_value']} + event_attendances * {n['event_value']} "
        f"+ content_responses * {n['content_value']}",
        params.high_value_cap,
    )
    raw = (
        f"({recency}) * {n['recency_weight']} + ({volume}) * {n['volume_weight']} + ({variety}) "
        f"+ ({high_value}) - automation_ratio * {n['automation_penalty_factor']}"
    )
    return Scorer("score_engagement", lambda: F.expr(clip(raw, 0.0, 100.0)))


def profile_scorer() -> Scorer:
    raw = "level_score * 50D + persona_score * 50D + (has_title + has_persona) * 10D"
    return Scorer("score_profile", lambda: F.expr(clip(raw, 0.0, 100.0)))


def account_scorer(lead_baseline: float = 15.0) -> Scorer:
    """Records without an account get a baseline, so leads are not punished for having none."""
    raw = (
        "account_is_named * 30D + account_is_icp * 25D + account_intent * 30D "
        "+ (account_employee_score + account_revenue_score) * 7.5D"
    )
    sql = f"CASE WHEN has_account = 0 THEN {number(lead_baseline)} ELSE {clip(raw, 0.0, 100.0)} END"
    return Scorer("score_account", lambda: F.expr(sql))


def momentum_scorer() -> Scorer:
    raw = f"({cap('momentum_score * 40D', 80.0)}) + IF(is_accelerating, 20D, 0D)"
    sql = f"CASE WHEN engagement_last_30d = 0 THEN 0D ELSE {clip(raw, 0.0, 100.0)} END"
    return Scorer("score_momentum", lambda: F.expr(sql))


def pandas_scorer(
    name: str, inputs: Sequence[str], score: Callable[[pd.DataFrame], pd.Series]
) -> Scorer:
    """Scorer in Python over whole Arrow batches of the named columns. Slower than a Column.

    Row-level code fits as ``lambda batch: batch.apply(score_row, axis=1)``.
    """
    columns = list(inputs)

    def scored(batch: pd.DataFrame) -> pd.Series:
        return score(batch).astype("float64")

    scored.__annotations__ = {"batch": pd.DataFrame, "return": pd.Series}
    udf = F.pandas_udf(scored, "double")
    return Scorer(name, lambda: udf(F.struct(*[F.col(c) for c in columns])))


def default_scorers(config: JobConfig = JobConfig()) -> tuple[Scorer, ...]:
    return (
        engagement_scorer(config.engagement),
        profile_scorer(),
        account_scorer(config.lead_baseline),
        momentum_scorer(),
    )


def add_scorer(scorers: Sequence[Scorer], scorer: Scorer) -> tuple[Scorer, ...]:
    return (*scorers, scorer)


def replace_scorer(scorers: Sequence[Scorer], name: str, scorer: Scorer) -> tuple[Scorer, ...]:
    return tuple(scorer if s.name == name else s for s in scorers)


def weighted_sum(columns: Sequence[str], weights: Weights) -> str:
    """Sum in the given order, so rounding ties come out the same everywhere."""
    by_column = weights.by_column()
    return " + ".join(f"{c} * {number(by_column.get(c, 0.0))}" for c in columns)


def compute_scores(
    features: DataFrame,
    weights: Weights = Weights(),
    scorers: Sequence[Scorer] | None = None,
) -> DataFrame:
    """Add each component and ``readiness_score``, rounded to one decimal."""
    weights.validate()
    require_columns(features, [], "features")
    scorers = tuple(scorers) if scorers is not None else default_scorers()
    scored = features.select("*", *[s.expr().alias(s.name) for s in scorers])
    total = weighted_sum([s.name for s in scorers], weights)
    return add_columns(scored, {"readiness_score": round_half_even(total, 1)})


def tier_of(score: str, tiers: TierThresholds = TierThresholds()) -> str:
    """A null score falls through to the last tier."""
    return (
        f"CASE WHEN {score} >= {number(tiers.hot)} THEN 'Hot' "
        f"WHEN {score} >= {number(tiers.warm)} THEN 'Warm' "
        f"WHEN {score} >= {number(tiers.nurture)} THEN 'Nurture' ELSE 'Cold' END"
    )


def assign_tiers(scored: DataFrame, tiers: TierThresholds = TierThresholds()) -> DataFrame:
    return add_columns(scored, {"tier": tier_of("readiness_score", tiers)})
