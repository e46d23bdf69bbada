import pytest

from callrank.operators.clean import clean
from callrank.plans import audit as Q
from crm_world import REFERENCE, by_key


@pytest.fixture(scope="module")
def cleaned(tables, config):
    return clean(tables, config)


def test_statuses(tables):
    rows = {
        (r.entity_type, r.measure, r.value): (r.records, r.pct)
        for r in Q.status_distribution(tables.leads, tables.contacts).collect()
    }
    assert rows["lead", "lead_status", "Working"] == (1, pytest.approx(100 / 3))
    assert rows["lead", "is_converted", "true"] == (1, pytest.approx(100 / 3))
    assert rows["contact", "has_lead_origin", "true"] == (1, pytest.approx(100 / 3))
    assert rows["lead", "has_opted_out", "true"] == (0, 0.0)


def test_memberships(tables):
    rows = by_key(Q.engagement_summary(tables.campaign_members), "metric")
    assert (rows["total"].n, rows["total"]["max"], rows["real"].q50) == (4, 4.0, 1.5)
    recency = Q.recency_summary(tables.campaign_members, REFERENCE).first()
    assert (recency.n, recency["min"], recency["max"], recency.pct_30d) == (7, 3, 90, pytest.approx(500 / 7))
    audit = Q.automation_audit(tables.campaign_members).first()
    assert (audit.email_memberships, audit.auto_sends, audit.responded) == (4, 3, 7)


def test_accounts(tables):
    profile = Q.account_profile(tables.accounts).first()
    assert (profile.accounts, profile.n_is_icp_qualified, profile.n_do_not_contact) == (4, 2, 1)
    assert Q.intent_summary(tables.accounts).first().q50 == 47.5


def test_null_rates(tables):
    rows = by_key(Q.null_rates(tables.leads, ["title", "email", "phone"]), "column_name")
    assert set(rows) == {"title", "email"}
    assert rows["title"].null_pct == pytest.approx(100 / 3) and rows["email"].missing == 0


def test_prevalence(cleaned):
    rows = {(r.entity_type, r.flag): r.records for r in Q.flag_prevalence(cleaned).collect()}
    assert rows["lead", "exclude_disqualified"] == 1 and rows["lead", "is_excluded"] == 1
    assert rows["contact", "exclude_dnc_account"] == 1
    assert rows["lead", "issues_0"] == 1 and rows["lead", "issues_1_or_more"] == 2
    assert ("contact", "dq_broken_conversion") not in rows


def test_emails_and_dates(spark, tables):
    audit = Q.duplicate_email_audit(tables.leads.union(tables.leads), tables.contacts).first()
    assert tuple(audit) == (9, 7, 3)
    dates = Q.etl_date_audit(tables.leads.union(tables.leads).union(tables.leads.limit(1)), 2)
    rows = {str(r.created_date): r for r in dates.collect()}
    assert {k: r.n_records for k, r in rows.items()} == {"2024-11-02": 3, "2025-02-20": 4}
    assert rows["2024-11-02"].pct_of_records == pytest.approx(300 / 7)
    assert rows["2024-11-02"].pct_on_bulk_dates == 100.0


def test_score_summaries(tables, ranked):
    rows = by_key(Q.score_summary(ranked), "metric")
    assert rows["readiness_score"].q50 == 41.5 and rows["score_account"]["max"] == 82.12
    fields = by_key(Q.score_field_quartiles(tables), "metric")
    assert fields["mkto_lead_score"].q50 == 38.0 and fields["mkto_contact_score"].q50 == 41.0


def test_findings(cleaned):
    rows = by_key(Q.dq_findings(cleaned), "finding")
    assert set(rows) == {f"DQ-{i}" for i in range(1, 11)}
    got = {k: (r.population, r.affected) for k, r in rows.items()}
    assert got == {
        "DQ-1": (1, 1),
        "DQ-2": (6, 2),
        "DQ-3": (3, 0),
        "DQ-4": (6, 0),
        "DQ-5": (6, 0),  # the two imported scores have one scale here
        "DQ-6": (6, 0),
        "DQ-7": (6, 2),
        "DQ-8": (10, 3),
        "DQ-9": (6, 1),
        "DQ-10": (3, 0),
    }
    assert rows["DQ-9"].severity == "Critical" and rows["DQ-1"].prevalence_pct == 100.0


def test_imported_scores_of_one_scale_are_no_finding(cleaned):
    def scored(lead, contact):
        records = cleaned.records.selectExpr(
            *[c for c in cleaned.records.columns if not c.startswith("mkto_")],
            f"IF(entity_type = 'lead', {lead}, NULL) AS mkto_lead_score",
            f"IF(entity_type = 'contact', {contact}, NULL) AS mkto_contact_score",
        )
        return by_key(Q.dq_findings(cleaned._replace(records=records)), "finding")["DQ-5"]

    one = scored(40, 50)
    assert (one.affected, one.prevalence_pct) == (0, 0.0)
    assert one.evidence.endswith("leads 40.00, 40.00; contacts 50.00, 50.00")
    two = scored(40, 90)
    assert (two.affected, two.confidence) == (6, "Medium")
    none = scored("CAST(NULL AS int)", 90)
    assert none.affected == 0 and "leads none, none" in none.evidence


def test_missing_phone_is_a_gap(cleaned):
    records = cleaned.records.selectExpr("*", "CAST(NULL AS string) AS phone")
    row = by_key(Q.dq_findings(cleaned._replace(records=records)), "finding")["DQ-7"]
    assert row.affected == 6 and row.evidence == "records without title, persona or phone: 6 of 6"
