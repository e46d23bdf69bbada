"""Questions asked of the ranked table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callrank.config import TierThresholds, Weights
from callrank.functions.exprs import (
    active_flags,
    add_columns,
    badges,
    percent,
    quoted,
    record_label,
    round_half_even,
    true_flag,
)
from callrank.operators.clean import ENTITY, EXCLUSIONS, LEAD_DQ
from callrank.operators.rank import add_rank, total_order
from callrank.operators.scorers import COMPONENTS, tier_of, weighted_sum
from callrank.plans.summaries import rows_from
from callrank.sources.crm import present
from callrank.sources.schemas import TIERS

LIST_COLUMNS = [
    "rank",
    *ENTITY,
    "tier",
    "readiness_score",
    "first_name",
    "last_name",
    "title",
    "flags",
    *COMPONENTS,
]


def _one_of(column: str, values: Sequence[str]) -> str:
    return f"{column} IN ({', '.join(quoted(v) for v in values)})"


# ---- lists, cohorts, records ----


def callable_pool(df: DataFrame) -> DataFrame:
    return df.filter("NOT is_excluded")


def with_flags(ranked: DataFrame) -> DataFrame:
    """The columns of the ranked list, with the flag badges of each record."""
    columns = present(ranked, LIST_COLUMNS)
    columns.insert(columns.index("score_engagement"), f"{badges(present(ranked, EXCLUSIONS))} AS flags")
    return ranked.selectExpr(*columns)


def ranked_list(
    ranked: DataFrame,
    tiers: Sequence[str] = ("Hot", "Warm"),
    entity_types: Sequence[str] = ("lead", "contact"),
    include_excluded: bool = False,
) -> DataFrame:
    """Filtered list with its flag badges. The filters reach the parquet scan."""
    if not tiers or not entity_types:
        return with_flags(ranked.limit(0))
    kept = ranked.filter(f"{_one_of('tier', tiers)} AND {_one_of('entity_type', entity_types)}")
    return with_flags(kept if include_excluded else callable_pool(kept))


def ranked_page(
    ranked: DataFrame,
    tiers: Sequence[str] = ("Hot", "Warm"),
    entity_types: Sequence[str] = ("lead", "contact"),
    include_excluded: bool = False,
    max_rows: int = 100,
) -> DataFrame:
    """The first ``max_rows`` of the filtered list in rank order, with how many rows the filters match."""
    listed = ranked_list(ranked, tiers, entity_types, include_excluded)
    total = listed.selectExpr("count(1)").scalar()
    return listed.orderBy("rank").limit(max_rows).withColumn("matching", total)


def top_callable(ranked: DataFrame, k: int = 500) -> DataFrame:
    """The first ``k`` records to call: each task keeps its ``k`` best, one merges them."""
    return with_flags(callable_pool(ranked)).orderBy("rank").limit(k)


def top_scored(scored: DataFrame, k: int = 500, score: str = "readiness_score") -> DataFrame:
    """The same choice straight from scores, for when nobody needs the global rank."""
    return callable_pool(scored).orderBy(*total_order(score)).limit(k)


def record_labels(ranked: DataFrame, k: int = 200) -> DataFrame:
    best = callable_pool(ranked).orderBy("rank").limit(k)
    return best.selectExpr("rank", *ENTITY, f"{record_label()} AS label")


COHORTS = {
    "active_vp": "job_level = 'VP' AND score_engagement > 60",
    "ghost": "score_engagement < 10 AND score_profile > 60",
    "bot": "automation_ratio > 0.7D",
    "excluded_competitor": "is_excluded AND exclude_competitor",
}


def cohorts(ranked: DataFrame, tests: Mapping[str, str] = COHORTS) -> DataFrame:
    """Members of the named groups, in one pass; a record may be in several."""
    names = ", ".join(f"IF({test}, {quoted(name)}, NULL)" for name, test in tests.items())
    return ranked.selectExpr(
        f"explode(array_compact(array({names}))) AS cohort",
        "rank",
        *ENTITY,
        "readiness_score",
        "score_engagement",
        "score_profile",
        "tier",
    )


def cohort_leaders(ranked: DataFrame, tests: Mapping[str, str] = COHORTS) -> DataFrame:
    """Size and best record of each named group, without a sort: one row per group and task is shuffled."""
    best = f"min(struct(rank, {', '.join(ENTITY)}, readiness_score, tier))"
    grouped = cohorts(ranked, tests).groupBy("cohort")
    leaders = grouped.agg(F.expr("count(1) AS members"), F.expr(f"{best} AS _best"))
    return leaders.select("cohort", "members", "_best.*")


def record_cards(ranked: DataFrame) -> DataFrame:
    """Each record with the titles of its active exclusions and data-quality flags."""
    return add_columns(
        ranked,
        {
            "active_exclusions": active_flags(present(ranked, EXCLUSIONS)),
            "active_issues": active_flags(present(ranked, LEAD_DQ)),
        },
    )


def find_record(ranked: DataFrame, entity_id, entity_type: str | None = None) -> DataFrame:
    found = record_cards(ranked.filter(F.col("entity_id") == entity_id))
    return found if entity_type is None else found.filter(F.col("entity_type") == entity_type)


def membership_split(members: DataFrame) -> DataFrame:
    """Per record: all memberships, real responses, the rest."""
    return members.groupBy(*ENTITY).agg(
        F.expr("count(1) AS total_memberships"),
        F.expr(f"count_if({true_flag('is_responded')}) AS real_responses"),
        F.expr(f"count_if(NOT {true_flag('is_responded')}) AS automated"),
    )


# Into how many parts a record's memberships are dealt, in turn, before they meet in one task.
HISTORY_PARTS = (4096, 64)


def engagement_history(
    members: DataFrame, latest: int = 20, records: DataFrame | None = None
) -> DataFrame:
    """Newest memberships of each record (or of ``records``), with the record's totals.

    Up to its group-limit threshold Spark cuts every group to ``latest`` rows before the shuffle as well, so
    a record with a third of all memberships sends few of them. Beyond it the rows of a record are dealt
    into parts, each cut to ``latest`` rows, before they meet: no task holds more of one record than that.
    """
    if records is not None:
        members = members.join(records.select(*ENTITY).distinct(), ENTITY, "left_semi")
    entity, order = ", ".join(ENTITY), "ORDER BY response_date DESC NULLS LAST, cm_id"
    newest = f"PARTITION BY {entity} {order}"
    kept = members
    threshold = members.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")
    if int(latest) >= int(threshold):
        for parts in HISTORY_PARTS:
            part = f"pmod(xxhash64(cm_id, response_date), {parts}L)"
            place = f"row_number() OVER (PARTITION BY {entity}, {part} {order}) AS _place"
            kept = kept.selectExpr("*", place).filter(f"_place <= {int(latest)}").drop("_place")
    shown = kept.selectExpr(
        *ENTITY,
        "cm_id",
        "campaign_type",
        "campaign_name",
        "member_status",
        "is_responded",
        "response_date",
        f"row_number() OVER ({newest}) AS position",
    ).filter(f"position <= {int(latest)}")
    return shown.join(membership_split(members), ENTITY)


# ---- population reports ----


def score_metrics(scored: DataFrame) -> DataFrame:
    """Mean, median and deviation of the readiness score (about 1000 distinct values)."""
    return scored.selectExpr(
        "avg(readiness_score) AS mean_score",
        "median(readiness_score) AS median_score",
        "stddev_samp(readiness_score) AS std_score",
    )


def tier_distribution(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("tier").agg(F.expr("count(1) AS records"))


def population(ranked: DataFrame) -> DataFrame:
    return ranked.selectExpr(
        "count(1) AS total",
        "count_if(is_excluded) AS excluded",
        "count_if(NOT is_excluded) AS scorable",
    )


def _mean(column: str) -> str:
    return round_half_even(f"avg({column})", 1)


def tier_stats(ranked: DataFrame) -> DataFrame:
    return callable_pool(ranked).groupBy("tier").agg(
        F.expr("count(readiness_score) AS records"),
        F.expr(f"{_mean('readiness_score')} AS avg_score"),
        F.expr(f"{_mean('score_engagement')} AS avg_engagement"),
        F.expr(f"{_mean('score_profile')} AS avg_profile"),
    )


def fairness(ranked: DataFrame) -> DataFrame:
    """Do leads and contacts fare alike? The median needs one counter per distinct score."""
    hot = percent("tier = 'Hot'")
    return callable_pool(ranked).groupBy("entity_type").agg(
        F.expr("count(readiness_score) AS records"),
        F.expr(f"{_mean('readiness_score')} AS mean_score"),
        F.expr(f"{round_half_even('median(readiness_score)', 1)} AS median_score"),
        F.expr(f"{round_half_even(hot, 1)} AS pct_hot"),
    )


def score_histogram(ranked: DataFrame, bins: int = 30) -> DataFrame:
    """Records per score bin, by tier and by entity type, from one pass."""
    # The top score belongs to the last bin, not to one of its own.
    bin_of = f"least(floor(readiness_score * {bins} / 100D), {bins - 1}L)"
    counts = (
        callable_pool(ranked)
        .filter("readiness_score IS NOT NULL")
        .selectExpr("tier", "entity_type", f"{bin_of} AS bin")
        .groupBy("tier", "entity_type", "bin")
        .agg(F.expr("count(1) AS n"))
    )
    sides = [{"dimension": f"'{c}'", "value": c} for c in ("tier", "entity_type")]
    return (
        rows_from(counts, sides, keep=["bin", "n"])
        .groupBy("dimension", "value", "bin")
        .agg(F.expr("sum(n) AS records"))
        .selectExpr("*", f"bin * 100D / {bins} AS bin_start")
    )


def score_scatter(
    ranked: DataFrame, fraction: float | None = None, seed: int = 0, per_cell: int | None = None, grid: int = 50
) -> DataFrame:
    """Points of the scatter plot: all of them, a random ``fraction``, or at most ``per_cell`` of each tier and grid cell.

    The last choice bounds the answer, however many records there are, keeps thin regions whole and is the same on every
    run: of each cell the records with the least hashes. Each task cuts its cells before anything is shuffled.
    """
    points = (
        callable_pool(ranked)
        .select(*ENTITY, "tier", "score_engagement", "score_profile", "readiness_score")
        .dropna(subset=["score_engagement", "score_profile", "readiness_score"])
    )
    if per_cell is not None:
        cell = ", ".join(
            f"least(greatest(floor({c} * {grid} / 100D), 0L), {grid - 1}L)" for c in ("score_engagement", "score_profile")
        )
        drawn = "md5(concat_ws(' ', entity_type, entity_id)), entity_type, entity_id"
        place = f"row_number() OVER (PARTITION BY tier, {cell} ORDER BY {drawn}) AS _place"
        points = points.selectExpr("*", place).filter(f"_place <= {int(per_cell)}").drop("_place")
    return points if fraction is None else points.sample(fraction=fraction, seed=seed)


# ---- what if ----


def weighted_columns(df: DataFrame, weights: Weights) -> list[str]:
    """Every component that has a weight, the four given ones first."""
    names = [*COMPONENTS, *[name for name, weight in weights.extra if weight and name not in COMPONENTS]]
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"weighted components that the table lacks: {missing}")
    return names


def what_if(
    ranked: DataFrame, weights: Weights, tiers: TierThresholds = TierThresholds()
) -> DataFrame:
    """Score the callable pool again from its stored components; weights are normalised.

    Added dimensions count like the four given ones; a weighted one that the table lacks is an error.
    """
    score = round_half_even(weighted_sum(weighted_columns(ranked, weights), weights.normalised()), 2)
    rescored = add_columns(callable_pool(ranked), {"new_score": score})
    return add_columns(rescored, {"new_tier": tier_of("new_score", tiers)})


def what_if_ranks(
    ranked: DataFrame,
    weights: Weights,
    tiers: TierThresholds = TierThresholds(),
    folder: str | None = None,
) -> DataFrame:
    """New rank in the callable pool against the old rank over all records."""
    kept = ["rank", *ENTITY, "first_name", "last_name", "title", "tier", "readiness_score"]
    kept += [*weighted_columns(ranked, weights), "new_score", "new_tier"]
    rescored = what_if(ranked, weights, tiers)
    kept = present(rescored, kept)
    moved = add_rank(rescored.select(kept), "new_score", "new_rank", folder)
    return add_columns(moved, {"rank_change": "rank - new_rank"})


def what_if_impact(moved: DataFrame) -> DataFrame:
    return moved.selectExpr(
        "count_if(tier = 'Hot') AS old_hot",
        "count_if(new_tier = 'Hot') AS new_hot",
        "count_if(tier = 'Warm') AS old_warm",
        "count_if(new_tier = 'Warm') AS new_warm",
        "avg(readiness_score) AS old_mean",
        "avg(new_score) AS new_mean",
        "avg(abs(rank_change)) AS mean_rank_shift",
    )


def what_if_tiers(rescored: DataFrame) -> DataFrame:
    """Tier sizes before and after; every tier has a row."""
    counts = rescored.selectExpr(
        *[f"count_if(tier = '{t}') AS old_{t}" for t in TIERS],
        *[f"count_if(new_tier = '{t}') AS new_{t}" for t in TIERS],
    )
    return rows_from(
        counts, [{"tier": f"'{t}'", "before": f"old_{t}", "after": f"new_{t}"} for t in TIERS]
    )


def new_top(moved: DataFrame, k: int = 10) -> DataFrame:
    return moved.orderBy("new_rank").limit(k)


def rank_movers(moved: DataFrame, k: int = 10) -> DataFrame:
    return moved.orderBy(F.col("rank_change").desc(), *ENTITY).limit(k)


def weight_sensitivity(scored: DataFrame, weight_sets: Mapping[str, Weights]) -> DataFrame:
    """Mean readiness and hot records per weight set, all sets in one aggregate. Names may be any text."""
    aggregates, rows = [], []
    for i, (name, weights) in enumerate(weight_sets.items()):
        columns = weighted_columns(scored, weights)
        score = round_half_even(weighted_sum(columns, weights.validate()), 1)
        aggregates += [f"avg({score}) AS mean_{i}", f"count_if({score} >= 70) AS hot_{i}"]
        rows.append(
            {"weight_set": quoted(name), "mean_readiness": f"mean_{i}", "hot_records": f"hot_{i}"}
        )
    return rows_from(scored.selectExpr(*aggregates), rows)


def tier_sensitivity(scored: DataFrame, tier_sets: Mapping[str, TierThresholds]) -> DataFrame:
    """Tier sizes per threshold set, all sets in one aggregate. Names may be any text."""
    counts, rows = [], []
    for i, (name, thresholds) in enumerate(tier_sets.items()):
        for tier in TIERS:
            counts.append(
                f"count_if({tier_of('readiness_score', thresholds)} = '{tier}') AS set_{i}_{tier}"
            )
            rows.append(
                {"tier_set": quoted(name), "tier": f"'{tier}'", "records": f"set_{i}_{tier}"}
            )
    return rows_from(scored.selectExpr(*counts), rows)


# ---- expectations ----


def persona_audit(ranked: DataFrame, expectations: DataFrame) -> DataFrame:
    """Does each expected record land where it should?

    ``expectations``: entity_type, entity_id, persona, allowed_tiers (array), expects_excluded.
    A record that isn't there has the outcome MISSING and is not as expected.
    """
    outcomes = ranked.select(*ENTITY, "readiness_score", "tier", "is_excluded", F.lit(True).alias("_there"))
    return expectations.join(outcomes, ENTITY, "left").selectExpr(
        *ENTITY,
        "persona",
        "readiness_score",
        "CASE WHEN _there IS NULL THEN 'MISSING' WHEN is_excluded THEN 'EXCLUDED' ELSE tier END AS outcome",
        "CASE WHEN _there IS NULL THEN false WHEN is_excluded THEN expects_excluded "
        "ELSE array_contains(allowed_tiers, tier) END AS as_expected",
    )
