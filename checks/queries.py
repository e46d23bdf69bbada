"""Every registered query: an operator of the library over the whole given tables.

Doubles are rounded to six decimals, and dates and nullable ids are written as text, only here, so that two
engines can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from callrank.config import JobConfig, TierThresholds, Weights
from callrank.operators import clean as C
from callrank.operators import features as E
from callrank.operators import scorers as M
from callrank.operators.rank import merge_record_details, rank_and_tier
from callrank.plans import analytics as A
from callrank.plans import audit as Q
from callrank.plans import layouts as L
from callrank.plans import personas as P
from callrank.plans.job import ReadinessJob
from callrank.sources.crm import CrmTables
from callrank.sources.staging import discard, new_folder, stage
from callrank.sources.warehouse import REFERENCE_DATE, crm_tables

CONFIG = JobConfig(reference_date=REFERENCE_DATE)
WHAT_IF = Weights(0.6, 0.15, 0.15, 0.1)
STRICT = TierThresholds(80.0, 55.0, 25.0)
WEIGHT_SETS = {
    "default": Weights(),
    "engagement_heavy": Weights(0.6, 0.15, 0.15, 0.1),
    "profile_heavy": Weights(0.25, 0.45, 0.2, 0.1),
}
TIER_SETS = {"default": TierThresholds(), "strict": STRICT}

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.selectExpr(*[f"round({c}, 6) AS {c}" if c in columns else c for c in df.columns])


def text(df: DataFrame, *columns: str) -> DataFrame:
    return df.selectExpr(*[f"string({c}) AS {c}" if c in columns else c for c in df.columns])


# ---- shared inputs ----

_ranked: dict[tuple[str, str, str], DataFrame] = {}


def tables(spark: SparkSession, sf_dir: str) -> CrmTables:
    return crm_tables(spark, sf_dir)


def cleaned(spark: SparkSession, sf_dir: str) -> C.CleaningResult:
    return C.clean(tables(spark, sf_dir), CONFIG)


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.engineer_features(cleaned(spark, sf_dir), CONFIG)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ReadinessJob(CONFIG).scored(tables(spark, sf_dir))


def _once(
    spark: SparkSession, sf_dir: str, what: str, make: Callable[[str], DataFrame]
) -> DataFrame:
    """The ranked table is a product: the job writes it once and every report reads it."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _ranked:
        folder = new_folder(spark)
        _ranked[key] = stage(make(folder), what)
        discard(spark, folder)
    return _ranked[key]


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = ReadinessJob(CONFIG)
    return _once(
        spark, sf_dir, "ranked", lambda folder: job.ranked(tables(spark, sf_dir), folder)
    )


def moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(
        spark,
        sf_dir,
        "moved",
        lambda folder: A.what_if_ranks(ranked(spark, sf_dir), WHAT_IF, STRICT, folder),
    )


# ---- queries ----


def dnc_accounts(spark, sf_dir):
    return C.dnc_accounts(tables(spark, sf_dir).accounts)


def lead_exclusions(spark, sf_dir):
    leads = C.flag_lead_exclusions(tables(spark, sf_dir).leads)
    return leads.select("lead_id", *C.LEAD_EXCLUSIONS, "is_excluded")


def contact_exclusions(spark, sf_dir):
    t = tables(spark, sf_dir)
    flagged = C.flag_contact_exclusions(t.contacts, C.dnc_accounts(t.accounts))
    return flagged.select("contact_id", *C.CONTACT_EXCLUSIONS, "is_excluded")


def lead_dq_flags(spark, sf_dir):
    return cleaned(spark, sf_dir).leads.select("lead_id", *C.LEAD_DQ, "dq_issue_count")


def contact_dq_flags(spark, sf_dir):
    return cleaned(spark, sf_dir).contacts.select("contact_id", *C.CONTACT_DQ, "dq_issue_count")


def duplicate_emails(spark, sf_dir):
    t = tables(spark, sf_dir)
    return C.find_duplicate_emails(t.leads, t.contacts).select("email", "n_records")


def duplicate_email_audit(spark, sf_dir):
    t = tables(spark, sf_dir)
    return Q.duplicate_email_audit(t.leads, t.contacts)


def etl_dates(spark, sf_dir):
    t = tables(spark, sf_dir)
    leads = Q.etl_date_audit(t.leads, CONFIG.lead_etl_threshold)
    contacts = Q.etl_date_audit(t.contacts, CONFIG.contact_etl_threshold)
    both = leads.selectExpr("'lead' AS entity_type", "*").union(
        contacts.selectExpr("'contact' AS entity_type", "*")
    )
    return rounded(text(both, "created_date"), "pct_of_records", "pct_on_bulk_dates")


def resolve_conversions(spark, sf_dir):
    leads = cleaned(spark, sf_dir).leads
    return text(
        leads.select("lead_id", "dq_broken_conversion", "resolved_contact_id"),
        "resolved_contact_id",
    )


def dangling_conversions(spark, sf_dir):
    t = tables(spark, sf_dir)
    return C.dangling_conversions(t.leads, t.contacts).select("lead_id", "converted_contact_id")


def cleaning_stats(spark, sf_dir):
    return cleaned(spark, sf_dir).stats()


def engagement_features(spark, sf_dir):
    return rounded(featured(spark, sf_dir).select(*C.ENTITY, *E.ENGAGEMENT), "automation_ratio")


def momentum_features(spark, sf_dir):
    return rounded(featured(spark, sf_dir).select(*C.ENTITY, *E.MOMENTUM), "momentum_score")


def profile_features(spark, sf_dir):
    return featured(spark, sf_dir).select(*C.ENTITY, *E.PROFILE)


def account_features(spark, sf_dir):
    return rounded(
        featured(spark, sf_dir).select(*C.ENTITY, *E.ACCOUNT),
        "account_intent",
        "account_employee_score",
        "account_revenue_score",
    )


def entity_features(spark, sf_dir):
    return rounded(
        featured(spark, sf_dir).select(*C.ENTITY, *E.FEATURES),
        "automation_ratio",
        "momentum_score",
        "account_intent",
        "account_employee_score",
        "account_revenue_score",
    )


def _score(name: str) -> Query:
    def query(spark, sf_dir):
        return rounded(scored(spark, sf_dir).select(*C.ENTITY, name), name)

    return query


def readiness(spark, sf_dir):
    out = scored(spark, sf_dir).select(*C.ENTITY, *M.COMPONENTS, "readiness_score")
    return rounded(out, *M.COMPONENTS)


def with_depth(spark, sf_dir):
    """Scored records with a dimension in Python beside the four built ones, with a weight of its own."""
    depth = M.pandas_scorer(
        "score_depth",
        ["real_engagements", "total_engagements"],
        lambda batch: (batch["real_engagements"] * 100.0 / batch["total_engagements"].clip(lower=1)),
    )
    weights = Weights(0.35, 0.25, 0.20, 0.10, extra=(("score_depth", 0.10),))
    job = ReadinessJob(JobConfig(reference_date=REFERENCE_DATE, weights=weights)).with_scorer(depth)
    return job.scored(tables(spark, sf_dir))


def what_if_custom(spark, sf_dir):
    """Five dimensions re-weighted; the weights sum to 4."""
    weights = Weights(1.0, 1.0, 0.5, 0.5, extra=(("score_depth", 1.0),))
    return A.what_if(with_depth(spark, sf_dir), weights).select(*C.ENTITY, "new_score", "new_tier")


def custom_scorer(spark, sf_dir):
    out = with_depth(spark, sf_dir)
    return rounded(out.select(*C.ENTITY, "score_depth", "readiness_score"), "score_depth")


def score_metrics(spark, sf_dir):
    out = A.score_metrics(ranked(spark, sf_dir))
    return rounded(out, "mean_score", "median_score", "std_score")


def tier_distribution(spark, sf_dir):
    return A.tier_distribution(ranked(spark, sf_dir))


def ranked_records(spark, sf_dir):
    """The whole job, computed here and not taken from the written table."""
    out = rank_and_tier(scored(spark, sf_dir), CONFIG.tiers)
    out = out.select(
        "rank",
        *C.ENTITY,
        "tier",
        "readiness_score",
        *M.COMPONENTS,
        "email",
        "first_name",
        "last_name",
        "title",
        "company",
        "lead_status",
        "contact_status",
        "job_persona",
        "job_level",
        "created_date",
        "mql_date",
        "account_name",
        "industry",
        "intent_score",
        "is_excluded",
        "dq_issue_count",
    )
    return rounded(text(out, "created_date", "mql_date"), *M.COMPONENTS)


def top_callable(spark, sf_dir):
    return rounded(A.top_callable(ranked(spark, sf_dir), 500), *M.COMPONENTS)


def ranked_list(spark, sf_dir):
    everyone = A.ranked_list(ranked(spark, sf_dir), ["Hot", "Warm", "Nurture"], include_excluded=True)
    return rounded(everyone, *M.COMPONENTS)


def ranked_page(spark, sf_dir):
    return rounded(A.ranked_page(ranked(spark, sf_dir), max_rows=100), *M.COMPONENTS)


def cohort_leaders(spark, sf_dir):
    return A.cohort_leaders(ranked(spark, sf_dir))


def population(spark, sf_dir):
    return A.population(ranked(spark, sf_dir))


def cohorts(spark, sf_dir):
    return rounded(A.cohorts(ranked(spark, sf_dir)), "score_engagement", "score_profile")


def record_lookup(spark, sf_dir):
    cards = A.record_cards(ranked(spark, sf_dir))
    return cards.selectExpr(
        *C.ENTITY,
        "rank",
        "array_join(active_exclusions, ', ') AS active_exclusions",
        "array_join(active_issues, ', ') AS active_issues",
    )


def record_labels(spark, sf_dir):
    return A.record_labels(ranked(spark, sf_dir), 200)


def engagement_history(spark, sf_dir):
    return text(A.engagement_history(tables(spark, sf_dir).campaign_members, 20), "response_date")


def by_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked table laid out by record, written once like the table itself."""
    key = (spark.sparkContext.applicationId, sf_dir, "by_record")
    if key not in _ranked:
        _ranked[key] = L.write_by_record(ranked(spark, sf_dir), f"{new_folder(spark)}/by_record")
    return _ranked[key]


def find_record(spark, sf_dir):
    """The card of record 42, a lead or a contact."""
    cards = A.find_record(by_record(spark, sf_dir), 42)
    return cards.selectExpr(
        *C.ENTITY, "rank", "tier", "readiness_score", "array_join(active_exclusions, ', ') AS active_exclusions",
        "array_join(active_issues, ', ') AS active_issues",
    )


def merged_records(spark, sf_dir):
    """Scores alone, joined with the details of their records."""
    t, c = tables(spark, sf_dir), cleaned(spark, sf_dir)
    scores = ranked(spark, sf_dir).select(*C.ENTITY, "readiness_score", "tier")
    merged = merge_record_details(scores, c.leads, c.contacts, t.accounts).select(
        *C.ENTITY, "tier", "readiness_score", "email", "title", "company", "lead_status", "contact_status", "job_level",
        "account_name", "industry", "intent_score", "is_excluded", "dq_issue_count",
    )
    return merged


_members: dict[tuple[str, str], L.StoredMembers] = {}


def stored_members(spark: SparkSession, sf_dir: str) -> L.StoredMembers:
    """Memberships stored by entity, written once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _members:
        folder = new_folder(spark)
        table = f"members_{folder.rsplit('/', 1)[-1]}"
        _members[key] = L.store_members(tables(spark, sf_dir).campaign_members, table, f"{folder}/members")
    return _members[key]


def stored_history(spark, sf_dir):
    return text(stored_members(spark, sf_dir).history(20), "response_date")


def stored_engagement(spark, sf_dir):
    found = stored_members(spark, sf_dir).engagement(REFERENCE_DATE)
    return rounded(found.select(*C.ENTITY, *E.ENGAGEMENT), "automation_ratio")


def tier_stats(spark, sf_dir):
    return A.tier_stats(ranked(spark, sf_dir))


def fairness(spark, sf_dir):
    return A.fairness(ranked(spark, sf_dir))


def score_histogram(spark, sf_dir):
    return rounded(A.score_histogram(ranked(spark, sf_dir)), "bin_start")


def score_scatter(spark, sf_dir):
    return rounded(A.score_scatter(ranked(spark, sf_dir)), "score_engagement", "score_profile")


def score_sample(spark, sf_dir):
    sample = A.score_scatter(ranked(spark, sf_dir), per_cell=2, grid=10)
    return rounded(sample, "score_engagement", "score_profile")


def what_if_ranks(spark, sf_dir):
    out = A.what_if_ranks(ranked(spark, sf_dir), WHAT_IF, STRICT)
    return out.select(*C.ENTITY, "rank", "new_rank", "rank_change", "new_score", "new_tier")


def what_if_impact(spark, sf_dir):
    out = A.what_if_impact(moved(spark, sf_dir))
    return rounded(out, "old_mean", "new_mean", "mean_rank_shift")


def what_if_tiers(spark, sf_dir):
    return A.what_if_tiers(A.what_if(ranked(spark, sf_dir), WHAT_IF, STRICT))


def what_if_top(spark, sf_dir):
    out = A.new_top(moved(spark, sf_dir), 10)
    return out.select("new_rank", *C.ENTITY, "new_score", "new_tier")


def rank_movers(spark, sf_dir):
    out = A.rank_movers(moved(spark, sf_dir), 10)
    return out.select(*C.ENTITY, "rank", "new_rank", "rank_change")


def weight_sensitivity(spark, sf_dir):
    return rounded(A.weight_sensitivity(ranked(spark, sf_dir), WEIGHT_SETS), "mean_readiness")


def tier_sensitivity(spark, sf_dir):
    return A.tier_sensitivity(ranked(spark, sf_dir), TIER_SETS)


def persona_audit(spark, sf_dir):
    people = ranked(spark, sf_dir)
    return A.persona_audit(people, P.archetypes(people))


def status_distribution(spark, sf_dir):
    t = tables(spark, sf_dir)
    return rounded(Q.status_distribution(t.leads, t.contacts), "pct")


SUMMARY = ("mean", "std", "min", "q25", "q50", "q75", "max")


def engagement_summary(spark, sf_dir):
    return rounded(Q.engagement_summary(tables(spark, sf_dir).campaign_members), *SUMMARY)


def recency_summary(spark, sf_dir):
    out = Q.recency_summary(tables(spark, sf_dir).campaign_members, REFERENCE_DATE)
    return rounded(out, "mean", "std", "q25", "q50", "q75", "pct_30d", "pct_90d")


def account_profile(spark, sf_dir):
    out = Q.account_profile(tables(spark, sf_dir).accounts)
    return rounded(out, *[c for c in out.columns if c.startswith("pct_")])


def intent_summary(spark, sf_dir):
    return rounded(Q.intent_summary(tables(spark, sf_dir).accounts), *SUMMARY)


def null_rates(spark, sf_dir):
    t = tables(spark, sf_dir)
    columns = ["email", "title", "job_persona", "job_level", "mql_date"]
    leads = Q.null_rates(t.leads, columns).selectExpr("'lead' AS entity_type", "*")
    contacts = Q.null_rates(t.contacts, columns).selectExpr("'contact' AS entity_type", "*")
    return rounded(leads.union(contacts), "null_pct")


def flag_prevalence(spark, sf_dir):
    return Q.flag_prevalence(cleaned(spark, sf_dir))


def score_summary(spark, sf_dir):
    return rounded(Q.score_summary(ranked(spark, sf_dir)), *SUMMARY)


def score_field_quartiles(spark, sf_dir):
    return rounded(Q.score_field_quartiles(tables(spark, sf_dir)), *SUMMARY)


def automation_audit(spark, sf_dir):
    out = Q.automation_audit(tables(spark, sf_dir).campaign_members)
    return rounded(out, "email_pct", "auto_pct")


def dq_findings(spark, sf_dir):
    return rounded(Q.dq_findings(cleaned(spark, sf_dir)), "prevalence_pct")


ALL: dict[str, Query] = {
    f.__name__: f
    for f in (
        dnc_accounts,
        lead_exclusions,
        contact_exclusions,
        lead_dq_flags,
        contact_dq_flags,
        duplicate_emails,
        duplicate_email_audit,
        etl_dates,
        resolve_conversions,
        dangling_conversions,
        cleaning_stats,
        engagement_features,
        momentum_features,
        profile_features,
        account_features,
        entity_features,
        readiness,
        custom_scorer,
        what_if_custom,
        score_metrics,
        tier_distribution,
        ranked_records,
        top_callable,
        ranked_list,
        ranked_page,
        population,
        cohorts,
        cohort_leaders,
        record_lookup,
        record_labels,
        engagement_history,
        stored_history,
        stored_engagement,
        find_record,
        merged_records,
        tier_stats,
        fairness,
        score_histogram,
        score_scatter,
        score_sample,
        what_if_ranks,
        what_if_impact,
        what_if_tiers,
        what_if_top,
        rank_movers,
        weight_sensitivity,
        tier_sensitivity,
        persona_audit,
        status_distribution,
        engagement_summary,
        recency_summary,
        account_profile,
        intent_summary,
        null_rates,
        flag_prevalence,
        score_summary,
        score_field_quartiles,
        automation_audit,
        dq_findings,
    )
} | {name: _score(name) for name in M.COMPONENTS}
