import pytest

from callrank.config import TierThresholds, Weights
from callrank.plans import analytics as A
from callrank.plans import personas as P
from crm_world import by_key


@pytest.fixture(scope="module")
def moved(ranked):
    return A.what_if_ranks(ranked, Weights(1, 0, 1, 0), TierThresholds(60, 50, 5)).cache()


def test_ranked_list_filters_and_flags(ranked):
    shown = A.ranked_list(ranked)
    assert [r.entity_id for r in shown.orderBy("rank").collect()] == ["dee", "ada"]
    assert shown.columns == A.LIST_COLUMNS
    everyone = by_key(A.ranked_list(ranked, ["Nurture", "Cold"], include_excluded=True))
    # Converted without a link, and an e-mail that a contact has.
    assert everyone["bo"]["flags"] == "⚠️ 2 DQ"
    assert everyone["cy"]["flags"] == "🚫 Disqualified | ⚠️ 1 DQ"
    assert everyone["eli"]["flags"] == "🚫 Opted Out | 🚫 Dnc Account"
    only = A.ranked_list(ranked, entity_types=["contact"])
    assert [r.entity_id for r in only.collect()] == ["dee"]
    assert A.ranked_list(ranked, tiers=[]).count() == 0


def test_top_and_labels(ranked):
    assert [r.entity_id for r in A.top_callable(ranked, 1).collect()] == ["dee"]
    labels = [r.label for r in A.record_labels(ranked).orderBy("rank").collect()]
    assert labels == [
        "#1 | dee | Dee Okafor | Score: 81.5",
        "#2 | ada | Ada Moreau | Score: 62.8",
        "#3 | bo | Bo Lindqvist | Score: 41.6",
        "#5 | fay | Fay Stein | Score: 25.6",
    ]


def test_population_and_tiers(ranked):
    assert A.population(ranked).first().asDict() == {"total": 6, "excluded": 2, "scorable": 4}
    assert by_key(A.tier_distribution(ranked), "tier")["Nurture"].records == 3
    stats = by_key(A.tier_stats(ranked), "tier")
    assert stats["Warm"].avg_engagement == 83.3 and stats["Hot"].records == 1


def test_fairness(ranked):
    rows = by_key(A.fairness(ranked), "entity_type")
    assert (rows["lead"].pct_hot, rows["contact"].pct_hot) == (0.0, 50.0)
    assert rows["lead"].median_score == 52.2


def test_cohorts(ranked):
    found = {(r.cohort, r.entity_id) for r in A.cohorts(ranked).collect()}
    assert found == {("active_vp", "dee"), ("ghost", "eli"), ("bot", "fay")}


def test_histogram_and_scatter(ranked, spark):
    bins = {(r.dimension, r.value, r.bin) for r in A.score_histogram(ranked).collect()}
    assert {("tier", "Hot", 24), ("tier", "Nurture", 7), ("entity_type", "lead", 18)} <= bins
    full = spark.sql(
        "SELECT 100D AS readiness_score, 'Hot' AS tier, 'lead' AS entity_type, false AS is_excluded"
    )
    assert {r.bin for r in A.score_histogram(full).collect()} == {29}
    assert A.score_scatter(ranked).count() == 4
    assert A.score_scatter(ranked, fraction=0.0).count() == 0


def test_cards(ranked):
    card = A.find_record(ranked, "bo").first()
    assert card.active_exclusions == [] and card.active_issues == ["Broken Conversion", "Duplicate Email"]
    assert A.find_record(ranked, "eli").first().active_exclusions == ["Opted Out", "Dnc Account"]
    assert A.find_record(ranked, "bo", "contact").count() == 0


def test_history(tables, ranked):
    history = A.engagement_history(tables.campaign_members, 2)
    rows = history.orderBy("entity_id", "position").collect()
    assert [(r.entity_id, r.cm_id) for r in rows] == [
        ("ada", "m2"), ("ada", "m1"), ("bo", "m5"), ("bo", "m4"), ("dee", "m9"), ("dee", "m8"), ("fay", "m10"),
    ]
    assert (rows[2].total_memberships, rows[2].real_responses, rows[2].automated) == (3, 1, 2)
    one = ranked.filter("entity_id = 'dee'")
    assert A.engagement_history(tables.campaign_members, 20, one).count() == 4


def test_history_cuts_groups_before_the_shuffle(tables):
    plan = A.engagement_history(tables.campaign_members, 2)._jdf.queryExecution().executedPlan()
    assert plan.toString().count("WindowGroupLimit") == 2


@pytest.mark.parametrize("latest", [20, 1500])
def test_history_of_a_hot_record_is_cut_before_it_meets(spark, latest):
    """One record has most memberships; dates tie. Beyond Spark's own cut its rows are cut in parts."""
    members = spark.range(6000).selectExpr(
        "'lead' AS entity_type", "IF(id % 6 < 4, 'hot', concat('e', id % 50)) AS entity_id", "id AS cm_id",
        "'Email' AS campaign_type", "'c' AS campaign_name", "'Sent' AS member_status", "id % 2 = 0 AS is_responded",
        "date_sub(DATE '2025-05-15', int(id % 97)) AS response_date",
    )
    groups = {}
    for r in members.collect():
        groups.setdefault(r.entity_id, []).append(r)
    expected = set()
    for name, rows in groups.items():
        rows.sort(key=lambda r: r.cm_id)
        rows.sort(key=lambda r: r.response_date, reverse=True)
        expected |= {(name, i + 1, r.cm_id, len(rows)) for i, r in enumerate(rows[:latest])}
    history = A.engagement_history(members, latest)
    found = {(r.entity_id, r.position, r.cm_id, r.total_memberships) for r in history.collect()}
    assert found == expected
    plan = history._jdf.queryExecution().executedPlan().toString()
    assert ("WindowGroupLimit" in plan) == (latest < 1000)
    assert all(f"{parts}" in plan for parts in A.HISTORY_PARTS) or latest < 1000


def test_ranked_page_and_cohort_leaders(ranked):
    page = A.ranked_page(ranked, ["Hot", "Warm", "Nurture"], max_rows=2).collect()
    assert [(r.entity_id, r["rank"], r.matching) for r in page] == [("dee", 1, 4), ("ada", 2, 4)]
    none = A.ranked_page(ranked, [], max_rows=2)
    assert none.count() == 0 and "matching" in none.columns
    leaders = A.cohort_leaders(ranked, {"all": "true", "low": "rank > 3", "none": "rank < 0"}).collect()
    assert {(r.cohort, r.members, r.entity_id, r["rank"]) for r in leaders} == {("all", 6, "dee", 1), ("low", 3, "eli", 4)}


def test_what_if(moved):
    rows = by_key(moved)
    # Weights are halved each: engagement and account only.
    assert rows["dee"].new_score == 73.38 and rows["fay"].new_score == 26.62
    assert (rows["fay"].new_rank, rows["fay"].rank_change) == (3, 2)
    assert (rows["ada"].new_tier, rows["dee"].new_tier) == ("Nurture", "Hot")
    impact = A.what_if_impact(moved).first()
    assert (impact.old_hot, impact.new_hot, impact.old_warm, impact.new_warm) == (1, 1, 1, 0)
    assert impact.mean_rank_shift == 0.75
    tiers = {r.tier: (r.before, r.after) for r in A.what_if_tiers(moved).collect()}
    assert tiers == {"Hot": (1, 1), "Warm": (1, 0), "Nurture": (2, 3), "Cold": (0, 0)}
    assert [r.entity_id for r in A.rank_movers(moved, 1).collect()] == ["fay"]
    assert [r.entity_id for r in A.new_top(moved, 1).collect()] == ["dee"]


def test_what_if_with_default_weights_keeps_the_order(ranked):
    same = A.what_if_ranks(ranked, Weights())
    assert [r.entity_id for r in same.orderBy("new_rank").collect()] == ["dee", "ada", "bo", "fay"]
    with pytest.raises(ValueError):
        A.what_if(ranked, Weights(0, 0, 0, 0))


def test_sensitivity(ranked):
    sets = {"it's plain": Weights(), "profile-heavy": Weights(0.25, 0.45, 0.2, 0.1)}
    rows = by_key(A.weight_sensitivity(ranked, sets), "weight_set")
    assert rows["it's plain"].mean_readiness == pytest.approx(260.9 / 6) and rows["it's plain"].hot_records == 1
    assert rows["profile-heavy"].mean_readiness == pytest.approx(51.8)
    tiers = {
        (r.tier_set, r.tier): r.records
        for r in A.tier_sensitivity(ranked, {"more strict": TierThresholds(80, 55, 25)}).collect()
    }
    assert tiers == {
        ("more strict", "Hot"): 1, ("more strict", "Warm"): 1,
        ("more strict", "Nurture"): 3, ("more strict", "Cold"): 1,
    }


def test_persona_audit(spark, ranked):
    expectations = spark.createDataFrame(
        [
            ("K1", "planner", "lead", "ada", ["Warm"], False),
            ("K2", "student", "lead", "cy", [], True),
            ("K3", "editor", "contact", "eli", ["Nurture"], False),
            ("K4", "digger", "contact", "fay", ["Hot"], False),
            ("K5", "nobody", "lead", "zed", ["Hot"], False),
        ],
        P.EXPECTATION_SCHEMA,
    )
    rows = by_key(A.persona_audit(ranked, expectations), "persona")
    assert {k: (r.outcome, r.as_expected) for k, r in rows.items()} == {
        "K1": ("Warm", True),
        "K2": ("EXCLUDED", True),
        "K3": ("EXCLUDED", False),
        "K4": ("Nurture", False),
        "K5": ("MISSING", False),
    }
    assert P.expected_personas(spark).count() == 10


def test_archetypes(ranked):
    found = {r.entity_id: r.persona for r in P.archetypes(ranked).collect()}
    assert found == {"eli": "blocked", "cy": "blocked"}


def test_what_if_counts_added_dimensions(ranked):
    weights = Weights(0.3, 0.2, 0.2, 0.1, extra=(("score_tech", 0.2),))
    with pytest.raises(ValueError, match="score_tech"):
        A.what_if(ranked, weights)
    tech = ranked.selectExpr("*", "CAST(50 AS double) AS score_tech")
    rows = by_key(A.what_if_ranks(tech, weights))
    # 30 + 18.5 + 9.35 + 6 + 10
    assert rows["dee"].new_score == 73.85 and rows["dee"].score_tech == 50.0
    doubled = Weights(0.6, 0.4, 0.4, 0.2, extra=(("score_tech", 0.4),))
    assert by_key(A.what_if(tech, doubled))["dee"].new_score == 73.85
    assert by_key(A.weight_sensitivity(tech, {"all": weights}), "weight_set")["all"].hot_records == 1
