import math

import pytest

from callrank.config import TierThresholds
from callrank.operators import rank as R
from callrank.operators import scorers as M
from callrank.operators.clean import clean
from callrank.operators.features import engineer_features
from callrank.plans.analytics import top_scored
from callrank.sources.staging import discard, new_folder, scratch, stage
from crm_world import by_key

KEYED = "readiness_score double, entity_type string, entity_id string"

GOLDEN = {
    "dee": (1, 100.0, 92.5, 46.75, 60.0, 81.5, "Hot"),
    # 40 % of the decay over ten days, 30 % of 30 for volume, two types, one event.
    "ada": (2, 40 * math.exp(-M.DECAY_RATE * 10 / 45) + 9 + 20 + 20, 70.0, 15.0, 60.0, 62.8, "Warm"),
    "bo": (3, 40 * math.exp(-M.DECAY_RATE * 6 / 45) + 7.5 + 10 - 20, 100.0, 15.0, 0.0, 41.6, "Nurture"),
    "eli": (4, 0.0, 100.0, 82.12, 0.0, 41.4, "Nurture"),
    # A rounding tie: 25.65 goes down.
    "fay": (5, 0.0, 60.0, 53.25, 0.0, 25.6, "Nurture"),
    "cy": (6, 0.0, 20.0, 15.0, 0.0, 8.0, "Cold"),
}


def test_golden_ranking(ranked):
    rows = by_key(ranked)
    for key, (rank, engagement, profile, account, momentum, readiness, tier) in GOLDEN.items():
        r = rows[key]
        assert (r["rank"], r.readiness_score, r.tier) == (rank, readiness, tier)
        assert r.score_engagement == pytest.approx(engagement, abs=1e-8)
        assert (r.score_profile, r.score_account, r.score_momentum) == (profile, account, momentum)
    excluded = {k: {c for c in r.asDict() if c.startswith("exclude_") and r[c]} for k, r in rows.items()}
    assert excluded == {
        "dee": set(),
        "ada": set(),
        "bo": set(),
        "fay": set(),
        "eli": {"exclude_opted_out", "exclude_dnc_account"},
        "cy": {"exclude_disqualified"},
    }


def test_details_travel_with_the_record(ranked):
    rows = by_key(ranked)
    assert (rows["fay"].account_name, rows["fay"].industry, rows["fay"].intent_score) == (
        "Quarry Stone", "Mining", 35.0,
    )
    assert rows["ada"].company == "Dock Nine" and rows["ada"].account_name is None
    assert rows["dee"].exclude_competitor is None


@pytest.mark.parametrize("limits", [{}, {"group_rows": 100}, {"group_rows": 0}, {"most_groups": 5}])
@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_rank_equals_a_plain_window(spark, partitions, limits):
    """A third of the rows share one score, some have none, and the order is total."""
    df = spark.range(0, 3000, numPartitions=partitions).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 20.0D WHEN id % 11 = 0 THEN NULL ELSE (id * 37 % 1000) / 10D END "
        "AS readiness_score",
        "IF(id % 2 = 0, 'lead', 'contact') AS entity_type",
        "concat('E', id) AS entity_id",
    )
    expected = df.selectExpr(
        "entity_id",
        "row_number() OVER (ORDER BY readiness_score DESC NULLS LAST, entity_type, entity_id) AS r",
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.entity_id: r["rank"] for r in R.add_rank(df, **limits).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == {r.entity_id: r.r for r in expected.collect()}


def test_hot_score_is_split_over_tasks(spark):
    df = spark.range(20000).selectExpr(
        "IF(id >= 0, 20.0D, 1.0D) AS readiness_score",
        "'lead' AS entity_type",
        "concat('E', id) AS entity_id",
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        placed = df.orderBy(*R.total_order("readiness_score")).selectExpr("spark_partition_id() AS p")
        sizes = stage(placed, "sizes").groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 20000 / 4


def test_only_large_groups_are_sorted_by_range(spark, tmp_path):
    df = spark.range(4000).selectExpr(
        "IF(id % 2 = 0, 20.0D, id % 100 / 10D) AS readiness_score", "'lead' AS entity_type", "id AS entity_id"
    )
    df.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    counted = R.add_rank(df, folder=str(tmp_path / "a"))
    assert "rangepartitioning" not in counted._jdf.queryExecution().executedPlan().toString()
    split = R.add_rank(df, folder=str(tmp_path / "b"), group_rows=1000)
    assert spark.read.parquet(str(tmp_path / "b" / "rank")).count() == 2000
    key = ["rank", "entity_id"]
    assert sorted(counted.select(key).collect()) == sorted(split.select(key).collect())


def test_rank_of_nothing(spark):
    df = spark.createDataFrame([], KEYED)
    assert R.add_rank(df).count() == 0


def test_repeated_keys_still_get_ranks_of_their_own(spark):
    df = spark.createDataFrame([(1.0, "lead", "A")] * 3, KEYED)
    for limits in ({}, {"group_rows": 2}, {"most_groups": 0}):
        assert sorted(r["rank"] for r in R.add_rank(df, **limits).collect()) == [1, 2, 3]
    told = spark.createDataFrame([(1.0, "lead", "A", i) for i in range(50)], f"{KEYED}, mark int")
    once, again = (sorted(R.add_rank(t).select("rank", "mark").collect()) for t in (told, told.repartition(9)))
    assert once == again


def test_layer_by_layer_with_separate_details(tables, config, ranked):
    """Scores alone, details merged afterwards: the same table as the pipeline's."""
    cleaned = clean(tables, config)
    scored = M.compute_scores(engineer_features(cleaned, config))
    bare = M.assign_tiers(scored).select("entity_type", "entity_id", "readiness_score", "tier")
    merged = R.merge_record_details(bare, cleaned.leads, cleaned.contacts, tables.accounts)
    ours, pipeline = by_key(merged), by_key(ranked)
    assert set(ours) == set(pipeline)
    for key, row in ours.items():
        for column, found in row.asDict().items():
            if column in ranked.columns:
                assert found == pipeline[key][column], (key, column)


def test_strict_tiers(tables, config):
    scored = M.compute_scores(engineer_features(clean(tables, config), config))
    tiers = {r.entity_id: r.tier for r in R.rank_and_tier(scored, TierThresholds(90, 60, 30)).collect()}
    assert tiers == {"dee": "Warm", "ada": "Warm", "bo": "Nurture", "eli": "Nurture", "fay": "Cold", "cy": "Cold"}


def test_top_without_ranking(tables, config):
    scored = M.compute_scores(engineer_features(clean(tables, config), config))
    assert [r.entity_id for r in top_scored(scored, 2).collect()] == ["dee", "ada"]


def test_staging_lands_in_the_shared_folder(spark):
    folder = new_folder(spark)
    assert folder.startswith(spark.conf.get("spark.checkpoint.dir"))
    df = spark.createDataFrame([(1.0, "lead", "A")], KEYED)
    assert R.add_rank(df, folder=folder).count() == 1
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.exists(path)
    discard(spark, folder)
    assert not fs.exists(path)


def test_scratch_tables_go_and_others_stay(spark):
    def exists(folder):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    df, outer = spark.createDataFrame([(1.0, "lead", "A")], KEYED), new_folder(spark)
    with scratch(spark) as folder:
        ranked = R.add_rank(df)
        assert new_folder(spark).startswith(folder) and exists(folder)
        with scratch(spark) as inner:
            assert inner.startswith(folder)
        kept = stage(ranked, "kept", outer)
    assert not exists(folder) and kept.count() == 1 and not new_folder(spark).startswith(folder)
    with pytest.raises(ZeroDivisionError), scratch(spark) as folder:
        stage(df, "t")
        raise ZeroDivisionError
    assert not exists(folder)
    discard(spark, outer)
