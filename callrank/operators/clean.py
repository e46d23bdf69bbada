"""Cleaning: exclusion flags, data-quality flags and repair of broken conversions.

Flags never remove a record and never change a score.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from callrank.config import JobConfig
from callrank.functions.exprs import add_columns, quoted, true_flag
from callrank.operators.lookups import lookup_join
from callrank.sources.crm import CrmTables, present
from callrank.sources.schemas import COMPETITORS, NON_PROSPECT, OVERWRITTEN_STATUSES

ENTITY = ["entity_type", "entity_id"]

LEAD_EXCLUSIONS = [
    "exclude_competitor",
    "exclude_opted_out",
    "exclude_bounced",
    "exclude_non_prospect",
    "exclude_disqualified",
]
CONTACT_EXCLUSIONS = [
    "exclude_opted_out",
    "exclude_no_longer",
    "exclude_non_prospect",
    "exclude_dnc_account",
]
EXCLUSIONS = LEAD_EXCLUSIONS + ["exclude_no_longer", "exclude_dnc_account"]
LEAD_DQ = [
    "dq_broken_conversion",
    "dq_duplicate_email",
    "dq_mql_overwritten",
    "dq_etl_timestamp",
    "dq_incomplete",
]
CONTACT_DQ = LEAD_DQ[1:]

LEAD_DETAILS = [
    "lead_id",
    "company",
    "lead_status",
    "lead_source",
    "is_converted",
    "converted_contact_id",
    "mkto_lead_score",
    "is_disqualified",
    "dq_reason",
    "dq_date",
    "email_bounced",
]
CONTACT_DETAILS = [
    "contact_id",
    "account_id",
    "contact_status",
    "mkto_contact_score",
    "is_mql",
    "has_lead_origin",
    "primary_lead_id",
    "no_longer_with_company",
]
SHARED_DETAILS = [
    "email",
    "first_name",
    "last_name",
    "title",
    "job_persona",
    "job_level",
    "created_date",
    "mql_date",
    "has_opted_out",
    "phone",
]
ACCOUNT_DETAILS = ["account_name", "industry", "is_named_account", "intent_score"]
ACCOUNT_INPUTS = ["is_icp_qualified", "employee_count", "annual_revenue"]


def _any(columns: Sequence[str]) -> str:
    return " OR ".join(columns)


def _flag(df: DataFrame, column: str) -> str:
    return true_flag(column) if column in df.columns else "false"


def _non_prospect(df: DataFrame) -> str:
    if "job_persona" not in df.columns:
        return "false"
    return true_flag(f"job_persona = {quoted(NON_PROSPECT)}")


# ---- accounts ----


def dnc_accounts(accounts: DataFrame) -> DataFrame:
    """Ids of the accounts nobody may contact."""
    return accounts.filter("do_not_contact").select("account_id").distinct()


def one_row_per_account(accounts: DataFrame) -> DataFrame:
    """Repeated account ids give one row: the smallest details, blocked if any row is."""
    details = [c for c in accounts.columns if c not in ("account_id", "do_not_contact")]
    blocked = F.expr(f"bool_or({_flag(accounts, 'do_not_contact')}) AS do_not_contact")
    grouped = accounts.filter("account_id IS NOT NULL").groupBy("account_id")
    if not details:
        return grouped.agg(blocked)
    chosen = grouped.agg(F.expr(f"min(struct({', '.join(details)})) AS _details"), blocked)
    return chosen.select("account_id", "_details.*", "do_not_contact")


def attach_accounts(contacts: DataFrame, accounts: DataFrame, **join_options) -> DataFrame:
    """One lookup brings every account column that flags, features and details need."""
    wanted = ["account_id", "do_not_contact"] + ACCOUNT_DETAILS + ACCOUNT_INPUTS
    table = one_row_per_account(accounts.select(present(accounts, wanted)))
    table = table.selectExpr("*", "1 AS account_found")
    if "account_id" not in contacts.columns:
        empty = {
            f.name: f"CAST(NULL AS {f.dataType.simpleString()})"
            for f in table.schema
            if f.name != "account_id"
        }
        return add_columns(contacts, empty)
    return lookup_join(contacts, table, "account_id", "contact_id", **join_options)


# ---- exclusions ----


def flag_lead_exclusions(
    leads: DataFrame, competitors: Sequence[str] = COMPETITORS
) -> DataFrame:
    rival = "false"
    if "company" in leads.columns and competitors:
        rival = true_flag(f"company IN ({', '.join(quoted(c) for c in competitors)})")
    flagged = add_columns(
        leads,
        {
            "exclude_competitor": rival,
            "exclude_opted_out": _flag(leads, "has_opted_out"),
            "exclude_bounced": _flag(leads, "email_bounced"),
            "exclude_non_prospect": _non_prospect(leads),
            "exclude_disqualified": _flag(leads, "is_disqualified"),
        },
    )
    return add_columns(flagged, {"is_excluded": _any(LEAD_EXCLUSIONS)})


def flag_contact_exclusions(
    contacts: DataFrame, dnc: DataFrame | None = None, **join_options
) -> DataFrame:
    """``dnc`` holds blocked account ids; without it the attached ``do_not_contact`` is used."""
    flags = {
        "exclude_opted_out": _flag(contacts, "has_opted_out"),
        "exclude_no_longer": _flag(contacts, "no_longer_with_company"),
        "exclude_non_prospect": _non_prospect(contacts),
        "exclude_dnc_account": _flag(contacts, "do_not_contact"),
    }
    columns = contacts.columns
    if dnc is not None and "account_id" in columns:
        marks = dnc.selectExpr("account_id", "true AS _blocked")
        contacts = lookup_join(contacts, marks, "account_id", "contact_id", **join_options)
        flags["exclude_dnc_account"] = true_flag("_blocked")
    flagged = contacts.selectExpr(*columns, *[f"{sql} AS {name}" for name, sql in flags.items()])
    return add_columns(flagged, {"is_excluded": _any(CONTACT_EXCLUSIONS)})


# ---- shared e-mails and bulk-load dates ----


def email_sightings(leads: DataFrame, contacts: DataFrame) -> DataFrame:
    """Every record with its e-mail, three narrow columns."""

    def narrow(df: DataFrame, kind: str) -> DataFrame:
        return df.selectExpr(f"'{kind}' AS entity_type", f"{kind}_id AS entity_id", "email")

    return narrow(leads, "lead").union(narrow(contacts, "contact"))


def email_groups(sightings: DataFrame) -> DataFrame:
    """Records per e-mail (missing ones form a group too) and the first contact that has it.

    Partial aggregation leaves one row per e-mail and task, so a hot e-mail costs nothing.
    """
    return sightings.groupBy("email").agg(
        F.expr("count(1) AS n_records"),
        F.expr("min(IF(entity_type = 'contact', entity_id, NULL)) AS first_contact_id"),
    )


def find_duplicate_emails(leads: DataFrame, contacts: DataFrame) -> DataFrame:
    """E-mails on two or more records, within or across the tables."""
    return email_groups(email_sightings(leads, contacts)).filter("n_records > 1")


def shared_email_records(
    sightings: DataFrame, watch: Observation | None = None, **join_options
) -> DataFrame:
    """The records whose e-mail another record has, one row each.

    Only three narrow columns are shuffled by e-mail; the wide records never are. ``watch`` counts the shared e-mails.
    """
    shared = email_groups(sightings).filter("n_records > 1").selectExpr("*", "true AS _shared")
    if watch is not None:
        shared = shared.observe(watch, F.expr("count(1) AS duplicate_emails"))
    found = lookup_join(
        sightings,
        shared,
        "email",
        "struct(entity_type, entity_id)",
        match_nulls=True,
        counted="n_records",
        **join_options,
    )
    # Two unknown e-mails are counted as equal but never link two records.
    return (
        found.filter("_shared")
        .groupBy(*ENTITY)
        .agg(
            F.expr("any_value(_shared) AS _shared"),
            F.expr("min(IF(email IS NOT NULL, first_contact_id, NULL)) AS _email_contact_id"),
        )
    )


def detect_etl_dates(df: DataFrame, threshold: int = 20, column: str = "created_date") -> DataFrame:
    """Days on more than ``threshold`` records; none where the table has no such column."""
    if column not in df.columns:
        return df.sparkSession.createDataFrame([], f"{column} date, n_records bigint")
    days = df.selectExpr(f"CAST({column} AS date) AS {column}").filter(f"{column} IS NOT NULL")
    counts = days.groupBy(column).agg(F.expr("count(1) AS n_records"))
    return counts.filter(f"n_records > {threshold}")


def flag_etl_dates(df: DataFrame, dates: DataFrame, column: str = "created_date") -> DataFrame:
    """Bulk dates are by nature hot keys; a calendar has under 4 million days, so broadcast."""
    if column not in df.columns:
        return df.withColumn("dq_etl_timestamp", F.lit(False))
    marks = dates.selectExpr(f"CAST({column} AS date) AS _day", "true AS _bulk")
    joined = df.join(F.broadcast(marks), F.expr(f"CAST({column} AS date) = _day"), "left")
    return joined.selectExpr(*df.columns, f"{true_flag('_bulk')} AS dq_etl_timestamp")


# ---- data-quality flags that need only the row ----


def _absent(df: DataFrame, column: str) -> str:
    return f"{column} IS NULL" if column in df.columns else "true"


def _incomplete(df: DataFrame) -> str:
    return f"{_absent(df, 'title')} OR {_absent(df, 'job_persona')}"


def flag_lead_rows(leads: DataFrame) -> DataFrame:
    """Lead flags that need no other row. A null conversion mark counts as not converted."""
    overwritten = "false"
    if "mql_date" in leads.columns and "lead_status" in leads.columns:
        undone = f"lead_status IN ({', '.join(quoted(x) for x in OVERWRITTEN_STATUSES)})"
        overwritten = f"mql_date IS NOT NULL AND {true_flag(undone)}"
    broken = f"{_flag(leads, 'is_converted')} AND {_absent(leads, 'converted_contact_id')}"
    return add_columns(
        leads,
        {
            "dq_broken_conversion": broken,
            "dq_mql_overwritten": overwritten,
            "dq_incomplete": _incomplete(leads),
        },
    )


def flag_contact_rows(contacts: DataFrame) -> DataFrame:
    return add_columns(
        contacts, {"dq_mql_overwritten": "false", "dq_incomplete": _incomplete(contacts)}
    )


def _known_contacts(leads: DataFrame, contacts: DataFrame, **join_options) -> DataFrame:
    """Leads with ``_known``: set when the contact they point to exists."""
    known = contacts.groupBy(F.col("contact_id").alias("converted_contact_id")).agg(
        F.expr("true AS _known")
    )
    return lookup_join(leads, known, "converted_contact_id", "lead_id", **join_options)


def dangling_conversions(leads: DataFrame, contacts: DataFrame, **join_options) -> DataFrame:
    """Leads that point to a contact that does not exist."""
    linked = leads.filter("converted_contact_id IS NOT NULL")
    marked = _known_contacts(linked, contacts, **join_options)
    return marked.filter("_known IS NULL").select(leads.columns)


# ---- the whole layer ----


def mark_shared(records: DataFrame, shared: DataFrame) -> DataFrame:
    """Add what depends on other records: the shared e-mail, the repaired link, the issue count."""
    columns = [c for c in records.columns if c != "other_issues"]
    marked = records.join(shared, ENTITY, "left").selectExpr(
        "*", f"{true_flag('_shared')} AS dq_duplicate_email"
    )
    return marked.selectExpr(
        *columns,
        "dq_duplicate_email",
        "IF(dq_broken_conversion, _email_contact_id, NULL) AS resolved_contact_id",
        "other_issues + CAST(dq_duplicate_email AS int) AS dq_issue_count",
    )


class CleaningResult(NamedTuple):
    """Leads and contacts with their flags, as lazy frames.

    ``records`` holds both with all flags that need no other record, ``shared`` the few records that
    share an e-mail. ``people`` is the two together, ``leads`` and ``contacts`` are views of it.
    """

    accounts: DataFrame
    records: DataFrame
    shared: DataFrame
    campaign_members: DataFrame
    sightings: DataFrame

    @property
    def people(self) -> DataFrame:
        return mark_shared(self.records, self.shared)

    @property
    def leads(self) -> DataFrame:
        wanted = LEAD_DETAILS + SHARED_DETAILS + LEAD_EXCLUSIONS + ["is_excluded"] + LEAD_DQ
        wanted += ["dq_issue_count", "resolved_contact_id"]
        people = self.people
        return people.filter("entity_type = 'lead'").select(present(people, wanted))

    @property
    def contacts(self) -> DataFrame:
        wanted = CONTACT_DETAILS + SHARED_DETAILS + CONTACT_EXCLUSIONS + ["is_excluded"]
        wanted += CONTACT_DQ + ["dq_issue_count"]
        people = self.people
        return people.filter("entity_type = 'contact'").select(present(people, wanted))

    def stats(self) -> DataFrame:
        """One row of totals."""
        shared = email_groups(self.sightings).agg(F.expr("count_if(n_records > 1)"))
        counters = {
            "total_leads": "count_if(entity_type = 'lead')",
            "total_contacts": "count_if(entity_type = 'contact')",
            "excluded_leads": "count_if(entity_type = 'lead' AND is_excluded)",
            "excluded_contacts": "count_if(entity_type = 'contact' AND is_excluded)",
            "broken_conversions": "count_if(dq_broken_conversion)",
            "resolved_conversions": "count(resolved_contact_id)",
        }
        totals = self.people.selectExpr(*[f"{sql} AS {name}" for name, sql in counters.items()])
        return totals.withColumn("duplicate_emails", shared.scalar())


def clean(
    tables: CrmTables, config: JobConfig = JobConfig(), watch: Observation | None = None, **join_options
) -> CleaningResult:
    """Flag every lead and contact and repair what an e-mail can link.

    The records meet the shared-e-mail marks by (entity_type, entity_id), the key by which the
    features join later, so they are shuffled once before they are ranked.
    """
    leads = flag_lead_rows(flag_lead_exclusions(tables.leads, config.competitors))
    leads = flag_etl_dates(leads, detect_etl_dates(tables.leads, config.lead_etl_threshold))
    if config.check_dangling:
        marked = _known_contacts(leads, tables.contacts, **join_options)
        dangling = "converted_contact_id IS NOT NULL AND _known IS NULL"
        leads = marked.selectExpr(
            *[c for c in leads.columns if c != "dq_broken_conversion"],
            f"dq_broken_conversion OR ({dangling}) AS dq_broken_conversion",
        )
    contacts = attach_accounts(tables.contacts, tables.accounts, **join_options)
    contacts = flag_contact_rows(flag_contact_exclusions(contacts))
    contacts = flag_etl_dates(
        contacts, detect_etl_dates(tables.contacts, config.contact_etl_threshold)
    )

    records = leads.selectExpr("'lead' AS entity_type", "lead_id AS entity_id", "*").unionByName(
        contacts.selectExpr("'contact' AS entity_type", "contact_id AS entity_id", "*"),
        allowMissingColumns=True,
    )
    issues = " + ".join(
        f"CAST({true_flag(c)} AS int)" for c in LEAD_DQ if c != "dq_duplicate_email"
    )
    if config.legacy_dq_count:
        issues += " + IF(entity_type = 'lead', 2, 0)"
    sightings = email_sightings(tables.leads, tables.contacts)
    return CleaningResult(
        tables.accounts,
        add_columns(records, {"other_issues": issues}),
        shared_email_records(sightings, watch, **join_options),
        tables.campaign_members,
        sightings,
    )
