"""The ten archetypes a ranking is checked against, and rules to derive such expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callrank.functions.exprs import true_flag
from callrank.operators.clean import ENTITY

# Persona, what it stands for, record, allowed tiers, excluded?
PERSONAS = [
    ("P1", "Hot Prospect", "lead", "LEAD-0001", ["Hot"], False),
    ("P2", "Stale VP", "lead", "LEAD-0002", ["Nurture", "Cold"], False),
    ("P3", "Junior Hyperactive", "lead", "LEAD-0003", ["Warm"], False),
    ("P4", "Ghost CISO", "lead", "LEAD-0004", ["Cold"], False),
    ("P5", "Competitor Spy", "lead", "LEAD-0005", [], True),
    ("P6", "Bounced & Opted Out", "lead", "LEAD-0006", [], True),
    ("P7", "Broken Conversion", "lead", "LEAD-0007", [], False),
    ("P8", "The Bot", "lead", "LEAD-0008", ["Nurture", "Cold"], False),
    ("P9", "Re-MQL Carousel", "lead", "LEAD-0009", ["Warm", "Nurture"], False),
    ("P10", "Contact Champion", "contact", "CON-0002", ["Hot", "Warm"], False),
]

EXPECTATION_SCHEMA = (
    "persona string, persona_name string, entity_type string, entity_id string, "
    "allowed_tiers array<string>, expects_excluded boolean"
)


def expected_personas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PERSONAS, EXPECTATION_SCHEMA)


def archetypes(people: DataFrame) -> DataFrame:
    """Give every record of a population the archetype it falls under, if any.

    Only raw attributes decide, so the result is an independent expectation for ``persona_audit``.
    """
    blocked = " OR ".join(
        true_flag(c)
        for c in ("has_opted_out", "email_bounced", "is_disqualified", "no_longer_with_company")
    )
    kind = (
        f"CASE WHEN job_persona = 'Non-Prospect' THEN 'outsider' WHEN {blocked} THEN 'blocked' "
        "WHEN job_persona = 'CISO' AND job_level IN ('C-Level', 'VP') THEN 'chief' "
        "WHEN job_persona IS NULL AND title IS NULL THEN 'unknown' END"
    )
    tiers = (
        "CASE persona WHEN 'chief' THEN array('Hot', 'Warm', 'Nurture') "
        "WHEN 'unknown' THEN array('Warm', 'Nurture', 'Cold') "
        "ELSE CAST(array() AS array<string>) END"
    )
    return (
        people.selectExpr(*ENTITY, f"{kind} AS persona")
        .filter("persona IS NOT NULL")
        .selectExpr(
            "*",
            "persona IN ('outsider', 'blocked') AS expects_excluded",
            f"{tiers} AS allowed_tiers",
        )
    )
