"""``spark-submit`` entry: ``python -m callrank score --data-dir ... --output-dir ...``."""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence
from dataclasses import fields, replace
from datetime import date

from pyspark.sql import SparkSession

from callrank.config import EngagementParams, JobConfig, TierThresholds, Weights
from callrank.plans.job import ReadinessJob


def _weights(text: str) -> Weights:
    try:
        return Weights.parse(text)
    except ValueError as error:
        raise argparse.ArgumentTypeError(str(error)) from error


def _own_column(text: str) -> tuple[str, str]:
    name, _, kind = text.partition(":")
    if not name or not kind:
        raise argparse.ArgumentTypeError("a column is given as NAME:TYPE")
    return name, kind


# The parameters of the engagement score beside the half-life, each an option of its name.
ENGAGEMENT = [f.name for f in fields(EngagementParams) if f.name != "half_life_days"]


def parse(argv: Sequence[str] | None = None, env=os.environ) -> JobConfig:
    base = JobConfig.from_env(env)
    parser = argparse.ArgumentParser(prog="callrank")
    score = parser.add_subparsers(dest="command", required=True).add_parser(
        "score", help="clean, score and rank the CRM tables"
    )
    score.add_argument("--data-dir", default=base.input_dir, required=not base.input_dir)
    score.add_argument("--output-dir", required=True)
    score.add_argument("--input-format", choices=["csv", "parquet"], default="csv")
    score.add_argument("--output-format", choices=["csv", "parquet"], default="parquet")
    score.add_argument("--weights", type=_weights, default=base.weights)
    score.add_argument("--half-life", type=float, default=base.engagement.half_life_days)
    score.add_argument("--hot", type=float, default=base.tiers.hot)
    score.add_argument("--warm", type=float, default=base.tiers.warm)
    score.add_argument("--nurture", type=float, default=base.tiers.nurture)
    score.add_argument("--reference-date", type=date.fromisoformat, default=base.reference_date)
    score.add_argument("--missing-intent", choices=["null", "zero"], default=base.missing_intent)
    score.add_argument("--competitors", nargs="+", default=list(base.competitors))
    score.add_argument("--lead-etl-threshold", type=int, default=base.lead_etl_threshold)
    score.add_argument("--contact-etl-threshold", type=int, default=base.contact_etl_threshold)
    score.add_argument("--lead-baseline", type=float, default=base.lead_baseline)
    score.add_argument("--legacy-dq-count", action="store_true", default=base.legacy_dq_count)
    score.add_argument("--check-dangling", action="store_true", default=base.check_dangling)
    score.add_argument("--single-line", action="store_true", help="no CSV record has a line break: split files over tasks")
    score.add_argument("--on-malformed", choices=["null", "fail"], default=base.on_malformed)
    score.add_argument("--own-column", type=_own_column, action="append", default=[], metavar="NAME:TYPE")
    for name in ENGAGEMENT:
        score.add_argument(f"--{name.replace('_', '-')}", type=float, default=getattr(base.engagement, name))
    args = parser.parse_args(argv)
    return replace(
        base,
        input_dir=args.data_dir,
        output_dir=args.output_dir,
        input_format=args.input_format,
        output_format=args.output_format,
        weights=args.weights,
        engagement=replace(
            base.engagement, half_life_days=args.half_life, **{name: getattr(args, name) for name in ENGAGEMENT}
        ),
        tiers=TierThresholds(args.hot, args.warm, args.nurture),
        reference_date=args.reference_date,
        missing_intent=args.missing_intent,
        competitors=tuple(args.competitors),
        lead_etl_threshold=args.lead_etl_threshold,
        contact_etl_threshold=args.contact_etl_threshold,
        lead_baseline=args.lead_baseline,
        legacy_dq_count=args.legacy_dq_count,
        check_dangling=args.check_dangling,
        multi_line=not args.single_line,
        on_malformed=args.on_malformed,
        own_columns=tuple(args.own_column),
    )


def main(argv: Sequence[str] | None = None) -> None:
    config = parse(argv)
    spark = SparkSession.builder.appName("callrank").getOrCreate()
    result = ReadinessJob(config).run_and_report(spark)
    for name, value in result.report.items():
        print(f"{name}: {value}")


if __name__ == "__main__":
    main()
