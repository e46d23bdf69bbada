from datetime import date, datetime

import pytest

from callrank.config import JobConfig
from callrank.operators import features as E
from callrank.operators.clean import clean
from callrank.sources.crm import CrmTables
from crm_world import REFERENCE, by_key

MEMBERS = (
    "entity_id string, entity_type string, campaign_type string, member_status string, "
    "is_responded boolean, response_date date"
)


def engaged(spark, rows, schema=MEMBERS):
    return by_key(E.engagement_features(spark.createDataFrame(rows, schema), REFERENCE))


def test_counts_per_entity(spark):
    found = engaged(
        spark,
        [
            ("pia", "contact", "Event", "Attended", True, date(2025, 3, 30)),
            ("pia", "contact", "Event", "Attended", True, date(2025, 5, 3)),
            ("pia", "contact", "Content Syndication", "Downloaded", True, date(2025, 5, 7)),
            ("pia", "contact", "Email", "Sent", False, date(2025, 5, 13)),
            ("quo", "lead", "Email", "Sent", False, date(2025, 5, 2)),
            ("quo", "lead", "Email", "Sent", False, date(2025, 5, 3)),
            ("rex", "lead", "Webinar", "Attended", True, date(2025, 1, 5)),
        ],
    )
    one, two, three = found["pia"], found["quo"], found["rex"]
    assert (one.total_engagements, one.real_engagements, one.engagement_last_30d) == (4, 3, 2)
    assert (one.webinar_attendances, one.event_attendances, one.content_responses) == (0, 2, 1)
    assert one.days_since_last_engagement == 8 and one.campaign_type_diversity == 3
    assert one.automation_ratio == 1 / 4
    # two in the last month against one in the month before
    assert (one.momentum_score, one.is_accelerating) == (1.0, True)
    assert (two.real_engagements, two.days_since_last_engagement) == (0, 999)
    assert (two.automation_ratio, two.momentum_score, two.is_accelerating) == (1.0, 0.0, False)
    assert (three.webinar_attendances, three.engagement_last_90d, three.engagement_last_180d) == (1, 0, 1)
    assert three.momentum_score == 0.0


def test_same_id_in_both_tables_is_two_entities(spark):
    rows = [
        ("X", "lead", "Event", "Attended", True, date(2025, 5, 10)),
        ("X", "contact", "Email", "Sent", False, date(2025, 5, 10)),
    ]
    found = E.engagement_features(spark.createDataFrame(rows, MEMBERS), REFERENCE).collect()
    assert {(r.entity_type, r.event_attendances) for r in found} == {("lead", 1), ("contact", 0)}


@pytest.mark.parametrize("days,in30,in90,in180", [
    (30, 1, 1, 1), (31, 0, 1, 1), (90, 0, 1, 1), (91, 0, 0, 1), (180, 0, 0, 1), (181, 0, 0, 0),
    (-4, 1, 1, 1),
])
def test_window_edges_and_future_dates(spark, days, in30, in90, in180):
    when = date.fromordinal(REFERENCE.toordinal() - days)
    row = engaged(spark, [("L", "lead", "Event", "Attended", True, when)])["L"]
    got = (row.engagement_last_30d, row.engagement_last_90d, row.engagement_last_180d)
    assert got == (in30, in90, in180) and row.days_since_last_engagement == days


def test_unknown_types_and_missing_values(spark):
    row = engaged(
        spark,
        [
            ("L", "lead", "Podcast", "Attended", True, date(2025, 5, 1)),
            ("L", "lead", "Podcast", "Attended", True, None),
            ("L", "lead", "Billboard", None, None, date(2025, 5, 14)),
            ("L", "lead", None, "Sent", False, date(2025, 5, 14)),
            ("L", "lead", "Email", "Sent", True, date(2025, 5, 2)),
            ("L", "lead", "Email", "Opened", True, date(2025, 5, 3)),
        ],
    )["L"]
    # Two unknown types and Email; a null type is none.
    assert row.campaign_type_diversity == 3
    assert row.total_engagements == 6 and row.real_engagements == 4
    assert row.engagement_last_30d == 3 and row.days_since_last_engagement == 12
    assert row.automation_ratio == 1 / 6


def test_times_of_day_are_floored(spark):
    schema = MEMBERS.replace("response_date date", "response_date timestamp")
    rows = [("L", "lead", "Event", "Attended", True, datetime(2025, 5, 10, 12))]
    assert engaged(spark, rows, schema)["L"].days_since_last_engagement == 4


@pytest.mark.parametrize("last,before,momentum,accelerating", [
    (3, 0, 1.0, True), (5, 2, 1.5, True), (2, 2, 0.0, False), (1, 3, 0.0, False),
    (4, 1, 2.0, True), (9, 1, 2.0, True), (0, 2, 0.0, False), (1, 0, 0.0, False),
])
def test_momentum_table(spark, last, before, momentum, accelerating):
    rows = [("L", "lead", "Event", "Attended", True, date(2025, 5, 1))] * last
    rows += [("L", "lead", "Event", "Attended", True, date(2025, 4, 1))] * before
    row = engaged(spark, rows)["L"]
    assert (row.momentum_score, row.is_accelerating) == (momentum, accelerating)


def test_old_engagement_has_no_momentum(spark):
    rows = [("L", "lead", "Event", "Attended", True, date(2024, 5, 1))] * 3
    row = engaged(spark, rows)["L"]
    assert (row.momentum_score, row.is_accelerating) == (0.0, False)


def test_profile(spark):
    df = spark.createDataFrame(
        [
            ("a", "VP", "CISO", "VP of Security"),
            ("b", None, None, None),
            ("c", "Individual Contributor", "Non-Prospect", "Sales"),
            ("d", "Non-Prospect", "Student", "x"),
        ],
        "entity_id string, job_level string, job_persona string, title string",
    )
    rows = by_key(df.selectExpr("*", *[f"{s} AS {c}" for c, s in E.profile_columns().items()]))
    got = {k: tuple(r[c] for c in E.PROFILE) for k, r in rows.items()}
    assert got == {
        "a": (0.85, 1.0, 1, 1),
        "b": (0.2, 0.2, 0, 0),
        "c": (0.3, 0.0, 1, 0),
        "d": (0.2, 0.2, 1, 1),
    }


def test_features_of_the_small_world(tables, config):
    rows = by_key(E.engineer_features(clean(tables, config), config))
    assert len(rows) == 6
    golden = {
        "ada": (2, 2, 1, 2, 10, 0.0, 2, 0, 1, 0),
        "bo": (3, 1, 1, 1, 6, 2 / 3, 1, 0, 0, 0),
        "dee": (4, 4, 3, 4, 3, 0.0, 3, 1, 2, 1),
        "fay": (1, 0, 0, 0, 999, 1.0, 1, 0, 0, 0),
        "cy": (0, 0, 0, 0, 999, 0.0, 0, 0, 0, 0),
        "eli": (0, 0, 0, 0, 999, 0.0, 0, 0, 0, 0),
    }
    columns = [
        "total_engagements", "real_engagements", "engagement_last_30d", "engagement_last_90d",
        "days_since_last_engagement", "automation_ratio", "campaign_type_diversity",
        "webinar_attendances", "event_attendances", "content_responses",
    ]
    assert {k: tuple(r[c] for c in columns) for k, r in rows.items()} == golden
    account = {k: tuple(r[c] for c in E.ACCOUNT) for k, r in rows.items()}
    assert account["dee"] == (1, 0, 0.6, 0.2, 0.3, 1)
    assert account["fay"] == (0, 1, 0.35, 0.9, 0.8, 1)
    assert account["ada"] == (0, 0, 0.0, 0.0, 0.0, 0)


def contact_world(spark, tables, rows):
    accounts = spark.createDataFrame(
        [("A", None, None, None, None), ("B", True, False, 20.0, 100)],
        "account_id string, is_icp_qualified boolean, is_named_account boolean, "
        "intent_score double, employee_count bigint",
    ).selectExpr("*", "5e6D AS annual_revenue", "false AS do_not_contact")
    contacts = spark.createDataFrame(rows, "contact_id string, account_id string").selectExpr(
        "*", "contact_id AS email", "DATE '2025-01-01' AS created_date"
    )
    return CrmTables(accounts, tables.leads.limit(0), contacts, tables.campaign_members.limit(0))


def test_account_edges(spark, tables):
    world = contact_world(spark, tables, [("known", "B"), ("none", None), ("lost", "FAKE"), ("gap", "A")])
    rows = by_key(E.engineer_features(clean(world)))
    got = {k: tuple(r[c] for c in E.ACCOUNT) for k, r in rows.items()}
    assert got["known"] == (1, 0, 0.2, 0.01, 0.005, 1)
    assert got["none"] == got["lost"] == (0, 0, 0.0, 0.0, 0.0, 0)
    # Unknown numbers stay unknown, unknown flags are no.
    assert got["gap"] == (0, 0, None, None, 0.005, 1)
    zero = by_key(E.engineer_features(clean(world), JobConfig(missing_intent="zero")))
    assert tuple(zero["gap"][c] for c in E.ACCOUNT) == (0, 0, 0.0, 0.0, 0.005, 1)
