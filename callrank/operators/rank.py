"""Exact global ranking and the final record layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callrank.config import TierThresholds
from callrank.operators.clean import (
    ACCOUNT_DETAILS,
    CONTACT_DETAILS,
    ENTITY,
    EXCLUSIONS,
    LEAD_DETAILS,
    LEAD_DQ,
    SHARED_DETAILS,
)
from callrank.operators.features import FEATURES
from callrank.operators.lookups import lookup_join
from callrank.operators.scorers import COMPONENTS, assign_tiers
from callrank.sources.crm import present
from callrank.sources.staging import new_folder, stage

DETAILS = (
    LEAD_DETAILS
    + CONTACT_DETAILS
    + SHARED_DETAILS
    + ACCOUNT_DETAILS
    + ["is_excluded", "dq_issue_count", "resolved_contact_id"]
    + EXCLUSIONS
    + LEAD_DQ
)

# monotonically_increasing_id() holds the partition above this bit and the row within it below.
ROW_BITS = 33

# Rows of one score and type of record that a task puts in order, and how many such groups are counted at most.
GROUP_ROWS, MOST_GROUPS = 200_000, 50_000


def total_order(score: str) -> list[Column]:
    """Best score first, unknown scores last, ties by record key: no two rows compare equal."""
    return [F.col(score).desc_nulls_last(), F.col("entity_type").asc(), F.col("entity_id").asc()]


def _in_order(df: DataFrame, score: str, name: str, folder: str) -> DataFrame:
    """``df`` with ``_row``, its place from 0 in the whole order, without bringing the rows into one task.

    The rows are range-partitioned and sorted on score *and* record key, so a score shared by a third
    of all rows is split over many tasks like any other range. Each row's place within its partition is
    written with it; its place in all is that plus the size of the partitions before it. The offsets table
    has one row per partition, which bounds both the broadcast and the window.
    """
    ordered = df.orderBy(*total_order(score)).withColumn("_place", F.monotonically_increasing_id())
    placed = stage(ordered, name, folder).selectExpr("*", f"shiftright(_place, {ROW_BITS}) AS _part")
    sizes = placed.groupBy("_part").agg(F.expr("count(1) AS _rows"))
    earlier = "ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    offsets = sizes.selectExpr("_part", f"coalesce(sum(_rows) OVER ({earlier}), 0) AS _offset")
    row = f"_place & {(1 << ROW_BITS) - 1}L"
    return placed.join(F.broadcast(offsets), "_part").selectExpr(*df.columns, f"_offset + ({row}) AS _row")


def add_rank(
    df: DataFrame,
    score: str = "readiness_score",
    name: str = "rank",
    folder: str | None = None,
    group_rows: int = GROUP_ROWS,
    most_groups: int = MOST_GROUPS,
) -> DataFrame:
    """Rank 1..n over all rows. ``df`` is read twice or thrice: give one that is written.

    Scores are rounded, so there are few: a histogram by score and type of record tells the rank at which each group begins,
    and only the rows within a group are put in order, by id. Groups of more than ``group_rows`` rows are ordered by a
    range sort instead, which splits them over tasks. So is everything if there are more than ``most_groups``
    groups, scores that aren't rounded.
    """
    folder = folder or new_folder(df.sparkSession)
    counted = df.groupBy(F.col(score).alias("_part"), F.col("entity_type").alias("_type"))
    groups = stage(counted.agg(F.expr("count(1) AS _size")), f"{name}_groups", folder)
    many, largest = groups.selectExpr("count(1)", "coalesce(max(_size), 0)").first()
    if many > most_groups:
        return _in_order(df, score, name, folder).selectExpr(*df.columns, f"_row + 1 AS {name}")

    earlier = "ORDER BY _part DESC NULLS LAST, _type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    large = f"IF(_size > {group_rows}, _size, 0L)"
    offsets = groups.selectExpr(
        "*", f"coalesce(sum(_size) OVER ({earlier}), 0L) AS _before", f"coalesce(sum({large}) OVER ({earlier}), 0L) AS _large_before"
    )
    grouped = df.join(F.broadcast(offsets), F.expr(f"{score} <=> _part AND entity_type <=> _type"))
    # rows of one key are told apart by their contents, so that every reader sees the same ranks
    whole = ", ".join(f"`{c}`" for c in df.columns)
    place = f"row_number() OVER (PARTITION BY _part, _type ORDER BY entity_id, xxhash64({whole}))"
    small = grouped.filter(f"_size <= {group_rows}").selectExpr(*df.columns, f"_before + {place} AS {name}")
    if largest <= group_rows:
        return small
    kept = grouped.filter(f"_size > {group_rows}").selectExpr(*df.columns, "_before - _large_before AS _shift")
    split = _in_order(kept, score, name, folder).selectExpr(*df.columns, f"_shift + _row + 1 AS {name}")
    return small.unionAll(split)


def merge_record_details(
    scored: DataFrame, leads: DataFrame, contacts: DataFrame, accounts: DataFrame
) -> DataFrame:
    """Attach record details to a scored frame that carries only keys and scores.

    The pipeline itself never needs this: its rows carry their details from the start.
    """
    lead_columns = [c for c in DETAILS if c in leads.columns]
    contact_columns = [c for c in DETAILS if c in contacts.columns]
    lead_rows = leads.selectExpr(
        "'lead' AS entity_type", "lead_id AS entity_id", *lead_columns
    )
    contact_rows = contacts.selectExpr(
        "'contact' AS entity_type", "contact_id AS entity_id", *contact_columns
    )
    if "account_id" in contact_columns:
        known = [c for c in present(accounts, ACCOUNT_DETAILS) if c not in contact_columns]
        if known:
            details = (
                accounts.filter("account_id IS NOT NULL")
                .groupBy("account_id")
                .agg(F.expr(f"min(struct({', '.join(known)})) AS _details"))
                .select("account_id", "_details.*")
            )
            contact_rows = lookup_join(contact_rows, details, "account_id", "entity_id")
    records = lead_rows.unionByName(contact_rows, allowMissingColumns=True)
    overlap = [c for c in records.columns if c in scored.columns and c not in ENTITY]
    return scored.join(records.drop(*overlap), ENTITY, "left")


def final_columns(df: DataFrame, scores: Sequence[str] = COMPONENTS) -> dict[str, str]:
    """Output columns in order, each with the SQL that reads it, packed or not."""
    packed = df.schema["record"].dataType.names if "record" in df.columns else []
    where = {c: f"record.{c}" for c in packed} | {c: c for c in df.columns}
    wanted = [*ENTITY, "readiness_score", "tier", *scores, *FEATURES, *DETAILS]
    return {c: where[c] for c in dict.fromkeys(wanted) if c in where}


def rank_and_tier(
    scored: DataFrame,
    tiers: TierThresholds = TierThresholds(),
    scores: Sequence[str] = COMPONENTS,
    folder: str | None = None,
) -> DataFrame:
    """Tier, order and number the scored records; the result is the flat output table.

    They are written before they are ordered: ranking reads its input more than once and would score every record anew.
    """
    folder = folder or new_folder(scored.sparkSession)
    tiered = stage(assign_tiers(scored, tiers), "scored", folder)
    columns = final_columns(tiered, scores)
    ranked = add_rank(tiered, folder=folder)
    return ranked.selectExpr("rank", *[f"{sql} AS {name}" for name, sql in columns.items()])
