"""Profiling of the raw tables and the data-quality findings report."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callrank.functions.exprs import days_ago, percent, quoted, share, true_flag
from callrank.operators.clean import (
    CONTACT_DQ,
    CONTACT_EXCLUSIONS,
    ENTITY,
    LEAD_DQ,
    LEAD_EXCLUSIONS,
    CleaningResult,
    email_groups,
    email_sightings,
)
from callrank.plans.summaries import numeric_summary, rows_from, wide_summary
from callrank.sources.crm import CrmTables, present

# ---- populations ----


def _status_profile(df: DataFrame, kind: str, status: str, flags: Sequence[str]) -> DataFrame:
    flags = present(df, flags)
    # One row per status; the flag totals come from those few rows.
    per_status = df.groupBy(F.col(status).alias("status")).agg(
        F.expr("count(1) AS n"), *[F.expr(f"count_if({f}) AS {f}") for f in flags]
    )
    total = df.selectExpr("count(1)").scalar()
    rows = [{"measure": f"'{status}'", "value": "status", "records": "n"}]
    rows += [{"measure": f"'{f}'", "value": "'true'", "records": f} for f in flags]
    return (
        rows_from(per_status, rows)
        .groupBy("measure", "value")
        .agg(F.expr("sum(records) AS records"))
        .withColumn("total", total)
        .selectExpr(
            f"'{kind}' AS entity_type",
            "measure",
            "value",
            "records",
            f"{share('records', 'total')} AS pct",
        )
    )


def status_distribution(leads: DataFrame, contacts: DataFrame) -> DataFrame:
    """Records per status and per true flag, each with its share of the table. One pass per table."""
    lead_flags = ["is_converted", "is_disqualified", "has_opted_out", "email_bounced"]
    contact_flags = ["has_lead_origin", "no_longer_with_company", "has_opted_out"]
    return _status_profile(leads, "lead", "lead_status", lead_flags).union(
        _status_profile(contacts, "contact", "contact_status", contact_flags)
    )


def memberships_per_entity(members: DataFrame) -> DataFrame:
    return members.groupBy(*ENTITY).agg(
        F.expr("count(cm_id) AS total"), F.expr("count_if(is_responded) AS real")
    )


def engagement_summary(members: DataFrame) -> DataFrame:
    """Counts per entity: k distinct ones need k(k+1)/2 memberships, so they are few."""
    return numeric_summary(memberships_per_entity(members), ["total", "real"])


def recency_summary(members: DataFrame, reference: date) -> DataFrame:
    """Days since real engagements and the share within 30 and 90 days."""
    age = days_ago("response_date", members.schema["response_date"].dataType, reference)
    real = members.filter("is_responded").selectExpr(f"{age} AS days")
    return real.selectExpr(
        "count(days) AS n",
        "avg(days) AS mean",
        "stddev_samp(days) AS std",
        "min(days) AS min",
        "percentile(days, array(0.25D, 0.5D, 0.75D)) AS q",
        "max(days) AS max",
        f"{percent('days <= 30')} AS pct_30d",
        f"{percent('days <= 90')} AS pct_90d",
    ).selectExpr(
        "n", "mean", "std", "min", "q[0] AS q25", "q[1] AS q50", "q[2] AS q75", "max",
        "pct_30d", "pct_90d",
    )


def account_profile(accounts: DataFrame) -> DataFrame:
    aggregates = ["count(1) AS accounts"]
    for flag in ("is_named_account", "is_icp_qualified", "do_not_contact"):
        aggregates += [f"count_if({flag}) AS n_{flag}", f"{percent(flag)} AS pct_{flag}"]
    return accounts.selectExpr(*aggregates)


def intent_summary(accounts: DataFrame) -> DataFrame:
    return wide_summary(accounts, ["intent_score"])


def null_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of missing values per column, all columns in one pass."""
    columns = present(df, columns)
    one = df.selectExpr(
        "count(1) AS n", *[f"count_if({c} IS NULL) AS {c}_nulls" for c in columns]
    )
    return rows_from(
        one,
        [
            {
                "column_name": f"'{c}'",
                "missing": f"{c}_nulls",
                "null_pct": share(f"{c}_nulls", "n"),
            }
            for c in columns
        ],
    )


def score_summary(scored: DataFrame) -> DataFrame:
    columns = ["score_engagement", "score_profile", "score_account", "score_momentum"]
    return wide_summary(scored, [*columns, "readiness_score"])


# ---- single checks ----


def flag_prevalence(cleaned: CleaningResult) -> DataFrame:
    """Records per flag and per number of issues, one pass over the people."""
    tests = []
    for kind, flags in (
        ("lead", [*LEAD_EXCLUSIONS, "is_excluded", *LEAD_DQ]),
        ("contact", [*CONTACT_EXCLUSIONS, "is_excluded", *CONTACT_DQ]),
    ):
        tests += [(kind, flag, flag) for flag in flags]
        tests += [
            (kind, "issues_0", "dq_issue_count = 0"),
            (kind, "issues_1_or_more", "dq_issue_count >= 1"),
            (kind, "issues_3_or_more", "dq_issue_count >= 3"),
        ]
    one = cleaned.people.selectExpr(
        *[
            f"count_if(entity_type = '{kind}' AND {test}) AS {kind}_{name}"
            for kind, name, test in tests
        ]
    )
    return rows_from(
        one,
        [
            {"entity_type": f"'{kind}'", "flag": f"'{name}'", "records": f"{kind}_{name}"}
            for kind, name, _ in tests
        ],
    )


def duplicate_email_audit(leads: DataFrame, contacts: DataFrame) -> DataFrame:
    return email_groups(email_sightings(leads, contacts)).selectExpr(
        "coalesce(sum(n_records), 0) AS email_records",
        "coalesce(sum(IF(n_records > 1, n_records, 0)), 0) AS records_in_duplicates",
        "count_if(n_records > 1 AND email IS NOT NULL) AS duplicate_emails",
    )


def etl_date_audit(df: DataFrame, threshold: int, column: str = "created_date") -> DataFrame:
    """Bulk-load dates with the share of all records on them and on any of them."""
    # One row per calendar day at most, so the totals over all days are small.
    days = df.selectExpr(f"CAST({column} AS date) AS {column}")
    per_day = days.groupBy(column).agg(F.expr("count(1) AS n_records"))
    return (
        per_day.selectExpr("*", f"{column} IS NOT NULL AND n_records > {threshold} AS bulk")
        .selectExpr(
            "*",
            "sum(n_records) OVER (PARTITION BY 1) AS total",
            "sum(IF(bulk, n_records, 0)) OVER (PARTITION BY 1) AS total_bulk",
        )
        .filter("bulk")
        .selectExpr(
            column,
            "n_records",
            f"{share('n_records', 'total')} AS pct_of_records",
            f"{share('total_bulk', 'total')} AS pct_on_bulk_dates",
        )
    )


AUTO_SEND = "campaign_type = 'Email' AND member_status = 'Sent'"


def automation_audit(members: DataFrame) -> DataFrame:
    email = "campaign_type = 'Email'"
    return members.selectExpr(
        "count(1) AS memberships",
        f"count_if({email}) AS email_memberships",
        f"{percent(email)} AS email_pct",
        f"count_if({AUTO_SEND}) AS auto_sends",
        f"{percent(AUTO_SEND)} AS auto_pct",
        "count_if(is_responded) AS responded",
    )


# ---- the findings report ----

# Fixed texts of the report: id, name, severity, recommended handling, effect on the score,
# effect on the sales team, how sure the detection is, what is counted.
FINDINGS = [
    ("DQ-1", "Broken entity links", "High", "Resolve", "Distorts", "Misses prospects",
     "High", "converted leads without a contact"),
    ("DQ-2", "Email duplication", "Medium", "Flag", "Distorts", "Wastes calls",
     "High", "records that share an e-mail"),
    ("DQ-3", "Temporal field overwrites", "Low", "Flag", "Neutral", "None",
     "Medium", "leads with an MQL date in an undone status"),
    ("DQ-4", "ETL-dominated timestamps", "Medium", "Flag", "Neutral", "None",
     "Medium", "records created on a bulk-load date"),
    ("DQ-5", "Score field asymmetry", "Medium", "Filter", "Distorts", "None",
     "Medium", "median and upper quartile of imported scores"),
    ("DQ-6", "Non-prospect contamination", "High", "Exclude", "Inflates", "Wastes calls",
     "High", "non-prospects and competitors"),
    ("DQ-7", "Data completeness gaps", "Medium", "Flag", "Deflates", "Misses prospects",
     "High", "records without title, persona or phone"),
    ("DQ-8", "Automation-inflated engagement", "High", "Filter", "Inflates", "Wastes calls",
     "High", "automatic e-mail sends"),
    ("DQ-9", "Structural contact blocks", "Critical", "Exclude", "Neutral", "Legal risk",
     "High", "records that opted out, bounced or belong to a blocked account"),
    ("DQ-10", "Qualification cycling", "Low", "Flag", "Inflates", "Wastes calls",
     "Medium", "leads qualified again after disqualification"),
]

# Imported scores of leads and contacts have one scale if medians and upper quartiles differ by less than this factor.
SCALE_RATIO = 1.5


def _quartiles(df: DataFrame, column: str) -> DataFrame:
    """Summary of an imported score. Whole numbers are points of a scale: one pass, a counter for each that occurs."""
    whole = isinstance(df.schema[column].dataType, T.IntegralType)
    return (numeric_summary if whole else wide_summary)(df, [column])


def score_field_quartiles(tables: CrmTables) -> DataFrame:
    """Evidence for DQ-5: the two imported score fields have different scales."""
    return _quartiles(tables.leads, "mkto_lead_score").union(_quartiles(tables.contacts, "mkto_contact_score"))


def imported_scales(records: DataFrame) -> DataFrame:
    """One row: median and upper quartile of the imported scores of leads and of contacts, null where there are none."""
    names = {"lead": "mkto_lead_score", "contact": "mkto_contact_score"}
    columns = present(records, list(names.values()))
    if all(isinstance(records.schema[c].dataType, T.IntegralType) for c in columns):
        each = [
            f"percentile({name}, {p}D) AS {kind}_{q}" if name in columns else f"CAST(NULL AS double) AS {kind}_{q}"
            for kind, name in names.items()
            for q, p in (("q50", 0.5), ("q75", 0.75))
        ]
        return records.selectExpr("count(1) AS n", *each).drop("n")
    found = {f"{kind}_{q}": "CAST(NULL AS double)" for kind in names for q in ("q50", "q75")}
    for kind, name in names.items():
        if name in columns:
            found |= {f"{kind}_{q}": f"max(IF(metric = '{name}', {q}, NULL))" for q in ("q50", "q75")}
    return wide_summary(records, columns).selectExpr(*[f"{sql} AS {c}" for c, sql in found.items()])


def dq_findings(cleaned: CleaningResult) -> DataFrame:
    """One row per finding: population, affected records, prevalence, how to handle it and the evidence.

    Every finding is a counter of one aggregate over people or memberships. DQ-5 also compares the imported scores of
    leads and contacts: if their scales agree, none is affected, else all records that have one.
    """
    people = cleaned.people

    def flag(column: str) -> str:
        return true_flag(column) if column in people.columns else "false"

    def has(column: str) -> str:
        return f"{column} IS NOT NULL" if column in people.columns else "false"

    cycling = "false"
    if "mql_date" in people.columns and "dq_date" in people.columns:
        cycling = "mql_date > dq_date"
    lead = "entity_type = 'lead'"
    incomplete = "dq_incomplete OR phone IS NULL" if "phone" in people.columns else "dq_incomplete"
    tests = {
        "DQ-1": (f"{lead} AND {flag('is_converted')}", "dq_broken_conversion"),
        "DQ-2": ("true", "dq_duplicate_email"),
        "DQ-3": (lead, "dq_mql_overwritten"),
        "DQ-4": ("true", "dq_etl_timestamp"),
        "DQ-5": ("true", f"{has('mkto_lead_score')} OR {has('mkto_contact_score')}"),
        "DQ-6": ("true", f"{flag('exclude_non_prospect')} OR {flag('exclude_competitor')}"),
        "DQ-7": ("true", incomplete),
        "DQ-9": (
            "true",
            f"{flag('exclude_opted_out')} OR {flag('exclude_bounced')} "
            f"OR {flag('exclude_dnc_account')}",
        ),
        "DQ-10": (lead, f"{lead} AND {cycling}"),
    }

    def report(df: DataFrame, counted: dict[str, tuple[str, str]]) -> DataFrame:
        totals = df.selectExpr(
            *[f"count_if({everyone}) AS `{key} all`" for key, (everyone, _) in counted.items()],
            *[f"count_if({hit}) AS `{key} hit`" for key, (_, hit) in counted.items()],
        )
        proof = {key: f"concat({quoted(rule + ': ')}, `{key} hit`, ' of ', `{key} all`)" for key, *_, rule in FINDINGS}
        if "DQ-5" in counted:
            both = "struct(lead_q50, lead_q75, contact_q50, contact_q75)"
            scales = imported_scales(cleaned.records).selectExpr(both)
            totals = totals.withColumn("scales", scales.scalar())
            apart = " OR ".join(
                f"abs(scales.lead_{q} - scales.contact_{q}) > "
                f"{SCALE_RATIO - 1}D * least(abs(scales.lead_{q}), abs(scales.contact_{q}))"
                for q in ("q50", "q75")
            )
            totals = totals.withColumn("DQ-5 hit", F.expr(f"IF({true_flag(apart)}, `DQ-5 hit`, 0L)"))
            shown = {
                kind: ", ', ', ".join(
                    f"coalesce(CAST(CAST(scales.{kind}_{q} AS decimal(18,2)) AS string), 'none')" for q in ("q50", "q75")
                )
                for kind in ("lead", "contact")
            }
            rule = next(rule for key, *_, rule in FINDINGS if key == "DQ-5")
            proof["DQ-5"] = f"concat({quoted(rule + ': leads ')}, {shown['lead']}, '; contacts ', {shown['contact']})"
        return rows_from(
            totals,
            [
                {
                    "finding": f"'{key}'",
                    "issue": f"'{issue}'",
                    "population": f"`{key} all`",
                    "affected": f"`{key} hit`",
                    "prevalence_pct": share(f"`{key} hit`", f"`{key} all`"),
                    "severity": f"'{severity}'",
                    "handling": f"'{handling}'",
                    "scoring_impact": f"'{scoring}'",
                    "operational_impact": f"'{operational}'",
                    "confidence": f"'{confidence}'",
                    "evidence": proof[key],
                }
                for key, issue, severity, handling, scoring, operational, confidence, _ in FINDINGS
                if key in counted
            ],
        )

    sends = {"DQ-8": ("true", AUTO_SEND)}
    return report(people, tests).union(report(cleaned.campaign_members, sends))
