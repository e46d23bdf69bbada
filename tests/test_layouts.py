"""Layouts: what a question reads, and that it answers the same."""

import random
from datetime import timedelta

import pytest

from callrank.operators.features import engagement_features
from callrank.plans.analytics import engagement_history, find_record, score_scatter
from callrank.plans.layouts import store_members, write_by_record
from crm_world import MEMBERS, REFERENCE


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture(scope="module")
def members(spark):
    rng = random.Random(4)
    kinds = ["Email", "Event", "Webinar", "Podcast", None]
    rows = []
    for i in range(1500):
        entity = rng.choice(["hot", "hot", f"e{rng.randrange(90)}", f"e{rng.randrange(90)}", None])
        day = REFERENCE - timedelta(days=rng.randrange(400))
        rows.append((f"m{i}", entity, rng.choice(["lead", "contact"]), "c", rng.choice(kinds), "Sent", rng.random() < 0.6, day, True))
    return spark.createDataFrame(rows, MEMBERS)


@pytest.fixture(scope="module")
def stored(spark, members, tmp_path_factory):
    found = store_members(members, "stored_members_test", f"{tmp_path_factory.mktemp('store')}/members", 5, hot_share=0.1)
    yield found
    spark.sql("DROP TABLE stored_members_test")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stored_members_are_all_of_them(members, stored):
    assert sorted(map(str, stored.everything().select(members.columns).collect())) == sorted(map(str, members.collect()))
    assert {r.entity_id for r in stored.hot.collect()} == {"hot", None}
    assert not stored.bucketed.filter("entity_id IS NULL OR entity_id = 'hot'").count()


@pytest.mark.parametrize("latest", [1, 3, 2000])
def test_history_is_the_same(members, stored, latest):
    plain = engagement_history(members, latest)
    assert sorted(map(str, stored.history(latest).select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_engagement_is_the_same(members, stored):
    plain = engagement_features(members, REFERENCE)
    assert sorted(map(str, stored.engagement(REFERENCE).collect())) == sorted(map(str, plain.collect()))


def test_memberships_of_ordinary_entities_are_not_shuffled(members, stored, no_broadcast):
    assert exchanges(engagement_history(members)) >= 2
    assert exchanges(engagement_history(stored.bucketed)) == 0
    assert exchanges(engagement_features(stored.bucketed, REFERENCE)) == 0


def test_no_members(spark, members, tmp_path):
    none = store_members(members.limit(0), "no_members_test", str(tmp_path / "none"), 3)
    try:
        assert none.history().count() == 0 and none.everything().count() == 0
    finally:
        spark.sql("DROP TABLE no_members_test")


def rows_read(df):
    """Rows that the scans of a finished query gave."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_a_look_at_one_record_skips_the_others(spark, tmp_path):
    """Nine rows in ten are skipped at least, by file ranges and row groups; a repeated id is found whole."""
    wide = spark.range(60_000).selectExpr(
        "id + 1 AS rank", "IF(id % 2 = 0, 'lead', 'contact') AS entity_type", "pmod(xxhash64(id), 1000000000L) AS entity_id",
        "repeat(uuid(), 4) AS title", "true AS exclude_competitor", "false AS dq_incomplete",
    )
    wide = wide.unionAll(wide.limit(5).selectExpr("rank", "entity_type", "-7L AS entity_id", "title", "exclude_competitor", "dq_incomplete"))
    wide.write.parquet(f"{tmp_path}/plain")
    plain = spark.read.parquet(f"{tmp_path}/plain")
    laid = write_by_record(plain, f"{tmp_path}/laid", group_bytes=256 << 10)
    assert laid.count() == 60_005
    wanted = plain.filter("entity_id > 0").orderBy("rank").first().entity_id
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert rows_read(find_record(plain, wanted)) > 6_000
        assert 1 <= rows_read(find_record(laid, wanted)) < 6_000
        assert rows_read(find_record(laid, 1_000_000_001)) < 6_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert find_record(laid, -7).count() == 5
    card = find_record(laid, wanted).first()
    assert card.active_exclusions and not card.active_issues


def test_bounded_scatter(ranked, spark):
    points = spark.range(5000).selectExpr(
        "'lead' AS entity_type", "id AS entity_id", "IF(id % 3 = 0, 'Hot', 'Warm') AS tier", "id % 101 * 1D AS score_engagement",
        "id % 7 * 16D + 1 AS score_profile", "50D AS readiness_score", "id % 50 = 0 AS is_excluded",
    )
    for per_cell in (1, 3):
        sample = score_scatter(points, per_cell=per_cell, grid=5)
        cells = {}
        for r in sample.collect():
            key = r.tier, min(int(r.score_engagement // 20), 4), min(int(r.score_profile // 20), 4)
            cells[key] = cells.get(key, 0) + 1
        assert set(cells.values()) == {per_cell} and len(cells) == 2 * 5 * 5
        again = score_scatter(points.repartition(7), per_cell=per_cell, grid=5)
        assert sorted(map(str, again.collect())) == sorted(map(str, sample.collect()))
    assert score_scatter(ranked, per_cell=10).count() == score_scatter(ranked).count()
