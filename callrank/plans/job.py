"""The batch job: read, clean, engineer features, score, rank, write."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from callrank.config import JobConfig
from callrank.operators.clean import CleaningResult, clean
from callrank.operators.features import engineer_features
from callrank.operators.lookups import splits_hot_keys
from callrank.operators.rank import rank_and_tier
from callrank.operators.scorers import (
    Scorer,
    add_scorer,
    compute_scores,
    default_scorers,
    replace_scorer,
    tier_of,
)
from callrank.plans.analytics import score_metrics, tier_distribution
from callrank.sources.crm import (
    CrmTables,
    ingest,
    read_ranked,
    read_tables,
    require_columns,
    write_ranked,
    write_report,
)
from callrank.sources.schemas import TIERS
from callrank.sources.staging import discard, new_folder


class RunResult(NamedTuple):
    """The ranked table as written, and the report of the run: one value by name."""

    ranked: DataFrame
    report: dict


class StageResult(NamedTuple):
    """What a stage made and a lazy frame of its metrics (computed only when asked for)."""

    name: str
    data: DataFrame | CleaningResult
    metrics: Callable[[], DataFrame]


@dataclass(frozen=True)
class ReadinessJob:
    """One configuration run end to end. Each stage is also callable alone."""

    config: JobConfig = JobConfig()
    scorers: tuple[Scorer, ...] | None = None

    def _scorers(self) -> tuple[Scorer, ...]:
        return self.scorers if self.scorers is not None else default_scorers(self.config)

    def with_scorer(self, scorer: Scorer) -> ReadinessJob:
        return replace(self, scorers=add_scorer(self._scorers(), scorer))

    def replacing_scorer(self, name: str, scorer: Scorer) -> ReadinessJob:
        return replace(self, scorers=replace_scorer(self._scorers(), name, scorer))

    def read(self, spark: SparkSession) -> CrmTables:
        if not self.config.input_dir:
            raise ValueError("input_dir is not set")
        return read_tables(spark, *self._input())

    def _input(self) -> tuple:
        c = self.config
        return c.input_dir, c.input_format, c.multi_line, c.on_malformed, c.own_columns

    def clean(self, tables: CrmTables, watch: Observation | None = None) -> StageResult:
        if not isinstance(tables, CrmTables):
            raise ValueError("cleaning needs the four CRM tables")
        cleaned = clean(tables, self.config, watch)
        return StageResult("clean", cleaned, cleaned.stats)

    def features(self, cleaned: CleaningResult) -> StageResult:
        if not isinstance(cleaned, CleaningResult):
            raise ValueError("feature engineering needs a CleaningResult")
        data = engineer_features(cleaned, self.config)
        width = len(data.columns)
        return StageResult(
            "features",
            data,
            lambda: data.selectExpr("count(1) AS records", f"{width} AS features"),
        )

    def score(self, features: DataFrame) -> StageResult:
        require_columns(features, ["entity_id", "entity_type"], "scoring")
        data = compute_scores(features, self.config.weights, self._scorers())
        return StageResult("score", data, lambda: score_metrics(data))

    def rank(self, scored: DataFrame, folder: str | None = None) -> StageResult:
        require_columns(scored, ["entity_id", "entity_type", "readiness_score"], "ranking")
        names = [s.name for s in self._scorers()]
        data = rank_and_tier(scored, self.config.tiers, names, folder)
        return StageResult("rank", data, lambda: tier_distribution(data))

    def scored(self, tables: CrmTables) -> DataFrame:
        """The lazy plan up to the scores: nothing runs."""
        return self.score(self.features(self.clean(tables).data).data).data

    def ranked(self, tables: CrmTables, folder: str | None = None) -> DataFrame:
        return self.rank(self.scored(tables), folder).data

    def run(self, spark: SparkSession) -> DataFrame:
        """Read, rank and, when an output folder is set, write the ranked table and re-read it."""
        if not self.config.output_dir:
            return self.ranked(self.read(spark))
        return self.run_and_report(spark).ranked

    def run_and_report(self, spark: SparkSession) -> RunResult:
        """Read, rank, write, and report what the run saw: counts, scores and tiers.

        Metrics are observed on rows that pass anyway, so they cost no pass over the data (a task that Spark repeats after
        a loss may count twice in them; the tables never do). The report is written beside the ranked table.
        """
        config = self.config
        if not config.output_dir:
            raise ValueError("output_dir is not set")
        if not config.input_dir:
            raise ValueError("input_dir is not set")
        folder = new_folder(spark)
        emails, records = Observation("shared_emails"), Observation("records")
        try:
            misfits = {}
            if config.input_format == "csv":
                c = config
                tables, misfits = ingest(spark, c.input_dir, folder, "csv", c.multi_line, c.on_malformed, c.own_columns)
            else:
                tables = self.read(spark)
            # a lookup that counts hot keys reads the shared e-mails more than once
            once = splits_hot_keys(tables.leads)
            cleaned = self.clean(tables, emails if once else None).data
            scored = self.score(self.features(cleaned).data).data
            watched = scored.observe(records, *[F.expr(f"{sql} AS {name}") for name, sql in self._metrics().items()])
            ranked = self.rank(watched, folder).data
            write_ranked(ranked, config.output_dir, config.output_format)
            report = records.get
            report["duplicate_emails"] = emails.get["duplicate_emails"] if once else cleaned.stats().first().duplicate_emails
            report["malformed"] = {f"{t}.{c}": n for t, counts in misfits.items() for c, n in counts.items()}
        finally:
            discard(spark, folder)
        write_report(spark, report, config.output_dir)
        again = read_ranked(spark, config.output_dir, config.output_format, ranked.schema)
        return RunResult(again, report)

    def _metrics(self) -> dict[str, str]:
        """What the report says of the scored records."""
        tier = tier_of("readiness_score", self.config.tiers)
        return {
            "total_leads": "count_if(entity_type = 'lead')",
            "total_contacts": "count_if(entity_type = 'contact')",
            "excluded_leads": "count_if(entity_type = 'lead' AND is_excluded)",
            "excluded_contacts": "count_if(entity_type = 'contact' AND is_excluded)",
            "broken_conversions": "count_if(dq_broken_conversion)",
            "resolved_conversions": "count(resolved_contact_id)",
            "mean_score": "avg(readiness_score)",
            "std_score": "stddev_samp(readiness_score)",
            "unscored": "count_if(readiness_score IS NULL)",
            **{f"tier_{t.lower()}": f"count_if({tier} = '{t}')" for t in TIERS},
        }
