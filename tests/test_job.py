import csv
import os
import warnings
from dataclasses import replace

import pytest

from callrank.config import JobConfig, TierThresholds, Weights
from callrank.operators.scorers import EngagementParams, Scorer, engagement_scorer, pandas_scorer
from callrank.plans.job import ReadinessJob
from callrank.sources.crm import CrmTables, ingest, read_ranked, read_tables, require_columns
from crm_world import REFERENCE, by_key

ORDER = ["dee", "ada", "bo", "eli", "fay", "cy"]


@pytest.fixture(scope="module")
def csv_dir(tables, tmp_path_factory):
    """Plain CSV files as another tool writes them: other column order, gaps, 85.0 for 85."""
    folder = tmp_path_factory.mktemp("crm")
    for name, df in tables._asdict().items():
        columns = list(reversed(df.columns))
        with open(folder / f"{name}.csv", "w", newline="") as out:
            writer = csv.writer(out)
            writer.writerow(columns + ["unused"])
            for row in df.collect():
                cells = [row[c] for c in columns]
                cells = [f"{c}.0" if type(c) is int else c for c in cells]
                writer.writerow(["" if c is None else c for c in cells] + ["x"])
    return str(folder)


def test_csv_types_do_not_depend_on_order_or_content(spark, csv_dir, tables):
    read = read_tables(spark, csv_dir)
    for ours, original in zip(read, tables):
        assert {f.name: f.dataType for f in ours.schema} == {
            f.name: f.dataType for f in original.schema
        }
        assert sorted(map(str, ours.select(original.columns).collect())) == sorted(
            map(str, original.collect())
        )


def test_parquet_in_csv_out(spark, tables, config, tmp_path):
    for name, df in tables._asdict().items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    job = ReadinessJob(
        replace(config, input_dir=str(tmp_path), input_format="parquet",
                output_dir=str(tmp_path / "out"), output_format="csv")
    )
    out = job.run(spark)
    assert os.path.isdir(tmp_path / "out" / "scored_records.csv")
    rows = by_key(out)
    assert [r.entity_id for r in sorted(rows.values(), key=lambda r: r["rank"])] == ORDER
    assert rows["fay"].readiness_score == 25.6 and rows["dee"].mql_date.isoformat() == "2025-04-04"
    assert rows["ada"].exclude_no_longer is None and rows["cy"].is_excluded is True


def test_each_record_is_scored_once(spark, tables, config, tmp_path):
    scored = spark.sparkContext.accumulator(0)

    def depth(batch):
        scored.add(len(batch))
        return batch["real_engagements"] * 10.0

    job = ReadinessJob(config).with_scorer(pandas_scorer("score_depth", ["real_engagements"], depth))
    assert job.ranked(tables, str(tmp_path / "work")).count() == 6
    assert scored.value == 6


def test_csv_in_parquet_out(spark, csv_dir, config, tmp_path):
    job = ReadinessJob(replace(config, input_dir=csv_dir, output_dir=str(tmp_path)))
    out = job.run(spark)
    assert out.count() == 6
    again = read_ranked(spark, str(tmp_path))
    scores = [r.readiness_score for r in again.orderBy("rank").collect()]
    assert scores == sorted(scores, reverse=True) and all(0 <= s <= 100 for s in scores)
    assert {r.tier for r in again.collect()} <= {"Hot", "Warm", "Nurture", "Cold"}
    assert again.filter("is_excluded").count() == 2
    # Running again replaces the table.
    assert job.run(spark).count() == 6


def test_without_output_nothing_is_written(spark, csv_dir, config):
    assert ReadinessJob(replace(config, input_dir=csv_dir)).run(spark).count() == 6


def test_custom_weights_and_tiers(spark, csv_dir):
    config = JobConfig(
        input_dir=csv_dir,
        reference_date=REFERENCE,
        weights=Weights(0.6, 0.15, 0.15, 0.1),
        tiers=TierThresholds(90, 60, 30),
    )
    rows = by_key(ReadinessJob(config).run(spark))
    assert len(rows) == 6 and all(r.readiness_score is not None for r in rows.values())
    assert rows["dee"].tier == "Warm"


def test_input_checks(spark, tmp_path, tables, config):
    with pytest.raises(ValueError):
        ReadinessJob(JobConfig()).run(spark)
    with pytest.raises(ValueError):
        ReadinessJob(JobConfig(input_dir=str(tmp_path / "nowhere"))).run(spark)
    with pytest.raises(ValueError):
        read_tables(spark, str(tmp_path), "orc")
    job = ReadinessJob(config)
    with pytest.raises(ValueError):
        job.clean(list(tables))
    with pytest.raises(ValueError):
        job.features(tables)
    with pytest.raises(ValueError):
        job.score(tables.accounts)
    with pytest.raises(ValueError):
        job.rank(tables.leads)
    with pytest.raises(ValueError):
        require_columns(tables.leads, ["lead_id", "shoe_size"], "leads")
    with pytest.raises(ValueError):
        require_columns("leads", [], "leads")


def test_stages_report_metrics(tables, config):
    job = ReadinessJob(config)
    cleaned = job.clean(tables)
    assert cleaned.metrics().first().total_leads == 3
    features = job.features(cleaned.data)
    assert features.metrics().first().records == 6
    scored = job.score(features.data)
    metrics = scored.metrics().first()
    assert metrics.median_score == 41.5 and metrics.mean_score == pytest.approx(260.9 / 6)
    ranked = job.rank(scored.data)
    tiers = {r.tier: r.records for r in ranked.metrics().collect()}
    assert tiers == {"Hot": 1, "Warm": 1, "Nurture": 3, "Cold": 1}
    assert [s.name for s in (cleaned, features, scored, ranked)] == [
        "clean", "features", "score", "rank",
    ]


def test_half_life_reaches_the_scorer(tables, config):
    fast = replace(config, engagement=EngagementParams(half_life_days=5))
    slow, quick = (by_key(ReadinessJob(c).scored(tables)) for c in (config, fast))
    assert quick["ada"].score_engagement < slow["ada"].score_engagement
    assert quick["bo"].score_engagement < slow["bo"].score_engagement


def test_scorers_swap_without_touching_the_original(tables, config):
    job = ReadinessJob(config)
    fast = engagement_scorer(EngagementParams(half_life_days=1))
    swapped = by_key(job.replacing_scorer("score_engagement", fast).scored(tables))
    plain = by_key(job.scored(tables))
    assert swapped["bo"].score_engagement < plain["bo"].score_engagement
    extra = Scorer("score_tech", lambda: engagement_scorer().expr() * 0)
    with_extra = job.with_scorer(extra).ranked(tables)
    assert "score_tech" in with_extra.columns and "score_tech" not in job.scored(tables).columns


def test_reference_date_moves_the_window(tables, config):
    from datetime import date

    later = by_key(ReadinessJob(replace(config, reference_date=date(2026, 5, 15))).scored(tables))
    assert later["ada"].engagement_last_90d == 0 and later["ada"].days_since_last_engagement == 375


def test_exclusion_never_changes_a_score(tables, config):
    blocked = tables.leads.selectExpr(
        *[c for c in tables.leads.columns if c != "has_opted_out"], "true AS has_opted_out"
    )
    before = by_key(ReadinessJob(config).scored(tables))
    after = by_key(ReadinessJob(config).scored(tables._replace(leads=blocked)))
    assert after["ada"].is_excluded and not before["ada"].is_excluded
    assert {k: r.readiness_score for k, r in after.items()} == {
        k: r.readiness_score for k, r in before.items()
    }


def test_tables_with_only_the_needed_columns(spark, config):
    bare = CrmTables(
        spark.createDataFrame([("A", False)], "account_id string, do_not_contact boolean"),
        spark.createDataFrame(
            [("L", "a@x")], "lead_id string, email string"
        ),
        spark.createDataFrame(
            [("C", "b@x", "A")], "contact_id string, email string, account_id string"
        ),
        spark.createDataFrame(
            [],
            "entity_id string, entity_type string, campaign_type string, member_status string, "
            "is_responded boolean, response_date date",
        ),
    )
    rows = by_key(ReadinessJob(config).ranked(bare))
    assert rows["L"].readiness_score == 8.0
    assert rows["C"].score_account == 0.0 and rows["C"].readiness_score == 5.0


def test_times_of_day_survive_parquet(spark, tables, tmp_path):
    timed = tables.campaign_members.selectExpr(
        "* EXCEPT (response_date)", "TIMESTAMP_NTZ '2025-05-10 12:00:00' AS response_date"
    )
    for name, df in tables._replace(campaign_members=timed)._asdict().items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    job = ReadinessJob(
        JobConfig(input_dir=str(tmp_path), input_format="parquet", reference_date=REFERENCE)
    )
    rows = by_key(job.scored(job.read(spark)))
    assert rows["ada"].days_since_last_engagement == 4


def test_csv_with_line_breaks_and_words_for_missing(spark, tables, tmp_path):
    for name, df in tables._asdict().items():
        with open(tmp_path / f"{name}.csv", "w", newline="") as out:
            writer = csv.writer(out)
            writer.writerow(df.columns)
            for row in df.collect():
                writer.writerow(["N/A" if c is None else f"{c}\nmore" if n == "title" else c for n, c in row.asDict().items()])
    read = read_tables(spark, str(tmp_path))
    leads = by_key(read.leads, "lead_id")
    assert set(leads) == {"ada", "bo", "cy"} and leads["ada"].title == "Yard Planner\nmore"
    assert leads["cy"].job_persona is None and leads["cy"].title is None


def test_malformed_values_can_fail(spark, tables, tmp_path):
    for name, df in tables._asdict().items():
        df.write.option("header", True).csv(f"{tmp_path}/{name}.csv")
    assert read_tables(spark, str(tmp_path), on_malformed="fail").leads.count() == 3
    bad = tables.leads.selectExpr("* EXCEPT (is_converted)", "'perhaps' AS is_converted")
    bad.write.mode("overwrite").option("header", True).csv(f"{tmp_path}/leads.csv")
    assert read_tables(spark, str(tmp_path)).leads.count() == 3
    with pytest.raises(ValueError, match="is_converted"):
        read_tables(spark, str(tmp_path), on_malformed="fail")


def test_a_failing_write_leaves_no_work_folder(spark, tables, config, tmp_path, monkeypatch):
    from callrank.plans import job as J

    for name, df in tables._asdict().items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    folder = f"{tmp_path}/work"
    monkeypatch.setattr(J, "new_folder", lambda spark: folder)
    monkeypatch.setattr(J, "write_ranked", lambda *a: 1 / 0)
    settings = replace(config, input_dir=str(tmp_path), input_format="parquet", output_dir=str(tmp_path / "out"))
    with pytest.raises(ZeroDivisionError):
        ReadinessJob(settings).run(spark)
    assert not os.path.exists(folder)


@pytest.mark.parametrize("bad", [{"engagement": EngagementParams(half_life_days=0)}, {"tiers": TierThresholds(40, 50, 10)}])
def test_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        JobConfig(**bad)


def test_report_of_a_run(spark, csv_dir, config, tables, tmp_path):
    job = ReadinessJob(replace(config, input_dir=csv_dir, output_dir=str(tmp_path)))
    result = job.run_and_report(spark)
    cleaned, scored = job.clean(tables).data, job.scored(tables)
    for name, value in cleaned.stats().first().asDict().items():
        assert result.report[name] == value, name
    metrics = scored.selectExpr("avg(readiness_score) AS mean_score", "stddev_samp(readiness_score) AS std_score").first()
    assert result.report["mean_score"] == pytest.approx(metrics.mean_score)
    assert result.report["std_score"] == pytest.approx(metrics.std_score)
    tiers = {r.tier: r["count"] for r in result.ranked.groupBy("tier").count().collect()}
    assert {f"tier_{t.lower()}": n for t, n in tiers.items()}.items() <= result.report.items()
    assert result.report["malformed"] == {} and result.report["unscored"] == 0
    written = spark.read.json(f"{tmp_path}/run_report.json").first()
    assert (written.total_leads, written.tier_hot, written.duplicate_emails) == (3, 1, result.report["duplicate_emails"])
    with pytest.raises(ValueError):
        ReadinessJob(replace(config, input_dir=csv_dir)).run_and_report(spark)
    with pytest.raises(ValueError):
        ReadinessJob(replace(config, output_dir=csv_dir)).run_and_report(spark)


def test_report_without_adaptive_execution(spark, csv_dir, config, tmp_path):
    job = ReadinessJob(replace(config, input_dir=csv_dir, output_dir=str(tmp_path)))
    with_it = job.run_and_report(spark).report
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert job.run_and_report(spark).report == with_it
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_csv_is_parsed_once_and_misfits_are_counted(spark, tables, config, tmp_path):
    """The plan of the ranked table reads typed parquet; what didn't fit is in the report."""
    for name, df in tables._asdict().items():
        df.write.option("header", True).csv(f"{tmp_path}/{name}.csv")
    bad = tables.leads.selectExpr("* EXCEPT (is_converted)", "IF(lead_id = 'ada', 'perhaps', 'false') AS is_converted")
    bad.write.mode("overwrite").option("header", True).csv(f"{tmp_path}/leads.csv")
    read, misfits = ingest(spark, str(tmp_path), str(tmp_path / "work"))
    assert misfits == {"accounts": {}, "leads": {"is_converted": 1}, "contacts": {}, "campaign_members": {}}
    plan = ReadinessJob(config).scored(read)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan csv" not in plan and plan.count("FileScan parquet") >= 4
    settings = replace(config, input_dir=str(tmp_path), output_dir=str(tmp_path / "out"))
    assert ReadinessJob(settings).run_and_report(spark).report["malformed"] == {"leads.is_converted": 1}
    with pytest.raises(ValueError, match="is_converted"):
        ReadinessJob(replace(settings, on_malformed="fail")).run(spark)
    with pytest.raises(ValueError, match="is_converted"):
        ReadinessJob(replace(settings, on_malformed="fail")).read(spark)


def test_reading_csv_in_one_task_is_said(spark, csv_dir, config):
    with pytest.warns(UserWarning, match="one task"):
        read_tables(spark, csv_dir)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert ReadinessJob(replace(config, input_dir=csv_dir, multi_line=False)).read(spark).leads.count() == 3


def test_own_columns_reach_own_scorers(spark, csv_dir, config, tmp_path):
    """The column ``unused`` of the files, text there, as a whole number for a scorer."""
    for name in CrmTables._fields:
        with open(f"{csv_dir}/{name}.csv", newline="") as given, open(tmp_path / f"{name}.csv", "w") as out:
            out.write(given.read().replace("unused", "tech_match").replace(",x", ",7"))
    tech = pandas_scorer("score_tech", ["tech_match"], lambda batch: batch["tech_match"] * 10)
    own = replace(
        config, input_dir=str(tmp_path), own_columns=(("tech_match", "double"), ("absent", "string")),
        weights=Weights(0.3, 0.25, 0.2, 0.15, extra=(("score_tech", 0.1),)),
    )
    job = ReadinessJob(own).with_scorer(tech)
    scored = by_key(job.scored(job.read(spark)))
    assert {r.score_tech for r in scored.values()} == {70.0} and scored["dee"].absent is None
    ranked = job.run(spark)
    assert {r.score_tech for r in ranked.collect()} == {70.0}
    with pytest.raises(ValueError, match="own columns"):
        replace(config, own_columns=(("title", "string"),))
    with pytest.raises(ValueError):
        replace(config, on_malformed="guess")
