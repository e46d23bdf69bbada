"""Features per lead and contact: engagement, momentum, profile and account."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callrank.config import JobConfig
from callrank.functions.exprs import add_columns, cap, days_ago, lookup, quoted, true_flag
from callrank.operators.clean import (
    ACCOUNT_DETAILS,
    CONTACT_DETAILS,
    ENTITY,
    EXCLUSIONS,
    LEAD_DETAILS,
    LEAD_DQ,
    SHARED_DETAILS,
    CleaningResult,
    mark_shared,
)
from callrank.sources.crm import present
from callrank.sources.schemas import (
    CAMPAIGN_TYPES,
    LEVEL_SCORES,
    NO_ENGAGEMENT_DAYS,
    NON_PROSPECT,
    PERSONA_SCORES,
    UNKNOWN_SCORE,
)

ENGAGEMENT_DEFAULTS = {
    "total_engagements": 0,
    "real_engagements": 0,
    "engagement_last_30d": 0,
    "engagement_last_90d": 0,
    "engagement_last_180d": 0,
    "days_since_last_engagement": NO_ENGAGEMENT_DAYS,
    "automation_ratio": 0.0,
    "campaign_type_diversity": 0,
    "webinar_attendances": 0,
    "event_attendances": 0,
    "content_responses": 0,
    "momentum_score": 0.0,
    "is_accelerating": False,
}
MOMENTUM = ["momentum_score", "is_accelerating"]
ENGAGEMENT = [c for c in ENGAGEMENT_DEFAULTS if c not in MOMENTUM]
PROFILE = ["level_score", "persona_score", "has_title", "has_persona"]
ACCOUNT = [
    "account_is_icp",
    "account_is_named",
    "account_intent",
    "account_employee_score",
    "account_revenue_score",
    "has_account",
]
FEATURES = ENGAGEMENT + PROFILE + ACCOUNT + MOMENTUM


def engagement_features(members: DataFrame, reference: date) -> DataFrame:
    """One row per entity that has memberships, from a single scan of them.

    The seven known campaign types are bits of one number, so an entity is one row after the first shuffle.
    Only types outside that list are grouped by name, which keeps the count of distinct types exact for
    any data. Both steps combine before they shuffle: an entity in a third of all memberships
    sends one row per task.
    """
    age = days_ago("response_date", members.schema["response_date"].dataType, reference)
    known = ", ".join(quoted(t) for t in CAMPAIGN_TYPES)
    bits = " ".join(f"WHEN {quoted(t)} THEN {1 << i}" for i, t in enumerate(CAMPAIGN_TYPES))
    rows = members.selectExpr(
        *ENTITY,
        "campaign_type",
        f"IF(campaign_type IN ({known}), NULL, campaign_type) AS rare_type",
        f"CASE campaign_type {bits} ELSE 0 END AS type_bit",
        "member_status",
        f"{true_flag('is_responded')} AS real",
        f"{age} AS age",
    )
    counters = {
        "total_engagements": "true",
        "real_engagements": "real",
        "last_30d": "real AND age <= 30",
        "last_60d": "real AND age <= 60",
        "last_90d": "real AND age <= 90",
        "last_180d": "real AND age <= 180",
        "automated": "campaign_type = 'Email' AND member_status = 'Sent'",
        "webinar_attendances": "campaign_type = 'Webinar' AND member_status = 'Attended'",
        "event_attendances": "campaign_type = 'Event' AND member_status = 'Attended'",
        "content_responses": "campaign_type = 'Content Syndication' AND real",
    }
    per_rare_type = rows.groupBy(*ENTITY, "rare_type").agg(
        *[F.expr(f"count_if({test}) AS {name}") for name, test in counters.items()],
        F.expr("min(IF(real, age, NULL)) AS youngest"),
        F.expr("bit_or(type_bit) AS type_bits"),
    )
    per_entity = per_rare_type.groupBy(*ENTITY).agg(
        *[F.expr(f"sum({name}) AS {name}") for name in counters],
        F.expr("min(youngest) AS youngest"),
        F.expr("bit_count(bit_or(type_bits)) + count(rare_type) AS campaign_type_diversity"),
    )
    growth = (
        "CASE WHEN real_engagements < 2 THEN 0D "
        "WHEN before_30d = 0 THEN IF(last_30d > 0, 1D, 0D) "
        "ELSE greatest(least((last_30d - before_30d) / before_30d, 2D), 0D) END"
    )
    return per_entity.selectExpr("*", "last_60d - last_30d AS before_30d").selectExpr(
        *ENTITY,
        "total_engagements",
        "real_engagements",
        "last_30d AS engagement_last_30d",
        "last_90d AS engagement_last_90d",
        "last_180d AS engagement_last_180d",
        f"CAST(coalesce(youngest, {NO_ENGAGEMENT_DAYS}) AS bigint) AS days_since_last_engagement",
        "automated / total_engagements AS automation_ratio",
        "campaign_type_diversity",
        "webinar_attendances",
        "event_attendances",
        "content_responses",
        f"{growth} AS momentum_score",
        "real_engagements >= 2 AND last_30d > before_30d AS is_accelerating",
    )


def with_engagement(people: DataFrame, engagement: DataFrame) -> DataFrame:
    """Add engagement to each record; those without memberships get the defaults."""
    return people.join(engagement, ENTITY, "left").fillna(ENGAGEMENT_DEFAULTS)


def profile_columns() -> dict[str, str]:
    known_persona = true_flag(f"job_persona <> {quoted(NON_PROSPECT)}")
    return {
        "level_score": lookup("job_level", LEVEL_SCORES, UNKNOWN_SCORE),
        "persona_score": lookup("job_persona", PERSONA_SCORES, UNKNOWN_SCORE),
        "has_title": "CAST(title IS NOT NULL AS int)",
        "has_persona": f"CAST({known_persona} AS int)",
    }


def account_columns(missing_intent: str = "null") -> dict[str, str]:
    """Account features from the attached account columns; all 0 without an account.

    An account with an unknown number keeps it unknown under ``missing_intent="null"``.
    """
    unknown = "0D" if missing_intent == "zero" else "NULL"

    def number(column: str, scale: str) -> str:
        return f"coalesce(CAST({column} AS double), {unknown}) / {scale}"

    def when_known(value: str) -> str:
        return f"CASE WHEN account_found IS NOT NULL THEN {value} ELSE 0D END"

    return {
        "account_is_icp": f"CAST(account_found IS NOT NULL AND {true_flag('is_icp_qualified')} AS int)",
        "account_is_named": f"CAST(account_found IS NOT NULL AND {true_flag('is_named_account')} AS int)",
        "account_intent": when_known(number("intent_score", "100D")),
        "account_employee_score": when_known(cap(number("employee_count", "10000D"), 1.0)),
        "account_revenue_score": when_known(cap(number("annual_revenue", "1e9D"), 1.0)),
        "has_account": "CAST(account_found IS NOT NULL AS int)",
    }


# Columns an input table may lack, with what stands in: unlike a missing value, a missing number
# column counts as 0.
STAND_INS = {
    "title": "CAST(NULL AS string)",
    "job_persona": "CAST(NULL AS string)",
    "job_level": "CAST(NULL AS string)",
    "is_icp_qualified": "false",
    "is_named_account": "false",
    "intent_score": "0D",
    "employee_count": "0L",
    "annual_revenue": "0D",
}


# What stays beside the features; every other detail travels packed in ``record``.
OPEN_DETAILS = ["is_excluded", "dq_broken_conversion", "other_issues"]
PACKED_DETAILS = [
    c
    for c in LEAD_DETAILS + CONTACT_DETAILS + SHARED_DETAILS + ACCOUNT_DETAILS + EXCLUSIONS + LEAD_DQ
    if c not in ("dq_broken_conversion", "dq_duplicate_email")
]


def engineer_features(cleaned: CleaningResult, config: JobConfig = JobConfig()) -> DataFrame:
    """Features of every record, one row each, with the record's details in the struct ``record``.

    Features of the row itself come before the join, and the details cross the join, the sort and the
    intermediate table as one column. With each of them a column of its own, the code Spark generates for
    that stage outgrows what the JVM compiles. Columns of the input that added scorers read stay beside the features.
    """
    engagement = engagement_features(cleaned.campaign_members, config.reference_date)
    records = cleaned.records
    missing = {c: sql for c, sql in STAND_INS.items() if c not in records.columns}
    missing |= {c: f"CAST(NULL AS {kind})" for c, kind in config.own_columns if c not in records.columns}
    own = profile_columns() | account_columns(config.missing_intent)
    packed = add_columns(records, missing) if missing else records
    packed = packed.selectExpr(
        *ENTITY,
        *[f"{sql} AS {name}" for name, sql in own.items()],
        *OPEN_DETAILS,
        *[c for c, _ in config.own_columns],
        f"struct({', '.join(present(records, PACKED_DETAILS))}) AS record",
    )
    return with_engagement(mark_shared(packed, cleaned.shared), engagement)
