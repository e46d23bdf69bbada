"""Spark SQL expressions shared by the operators, as text.

Text goes to Catalyst in one call per column, where a tree of Column objects costs the driver several calls
per node; the plan is the same. Number literals carry the ``D`` suffix, without which Spark SQL reads
them as decimals.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def number(x: float) -> str:
    return f"{float(x)!r}D"


def quoted(x: str) -> str:
    escaped = x.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def day(x: date) -> str:
    return f"DATE '{x.isoformat()}'"


def add_columns(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Append new columns given as SQL text."""
    return df.selectExpr("*", *[f"{sql} AS {name}" for name, sql in columns.items()])


def clip(x: str, low: float, high: float) -> str:
    """Bound ``x``; a null stays null (``least`` and ``greatest`` alone would skip it)."""
    return (
        f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {number(low)}), {number(high)}) END"
    )


def cap(x: str, high: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least({x}, {number(high)}) END"


def round_half_even(x: str, digits: int) -> str:
    """Round the scaled double half to even. ``round`` and ``bround`` go through decimals and give
    other results on ties such as 27.05."""
    scale = number(10**digits)
    return f"rint(({x}) * {scale}) / {scale}"


def true_flag(x: str) -> str:
    """A condition whose unknown counts as false."""
    return f"coalesce({x}, false)"


def lookup(x: str, table: Mapping[str, float], default: float) -> str:
    """Value of ``x`` in a small fixed table; null and unknown keys give ``default``."""
    hits = " ".join(f"WHEN {quoted(k)} THEN {number(v)}" for k, v in table.items())
    return f"CASE {x} {hits} ELSE {number(default)} END"


def days_ago(x: str, kind: T.DataType, reference: date) -> str:
    """Whole days from ``x`` to the start of the reference day, rounded down.

    For a time of day this is one less than the calendar difference.
    """
    if isinstance(kind, T.DateType):
        return f"datediff({day(reference)}, {x})"
    if isinstance(kind, T.StringType):
        return f"datediff({day(reference)}, try_cast({x} AS date))"
    later = f"{x} > CAST(CAST({x} AS date) AS {kind.simpleString()})"
    return f"datediff({day(reference)}, CAST({x} AS date)) - CAST({later} AS int)"


def flag_title(column: str) -> str:
    """``exclude_opted_out`` → ``Opted Out``."""
    return column.split("_", 1)[1].replace("_", " ").title()


def active_flags(columns: Iterable[str]) -> str:
    """Array with the titles of the flags that are set."""
    titles = [f"CASE WHEN {c} THEN {quoted(flag_title(c))} END" for c in columns]
    return f"array_compact(array({', '.join(titles)}))"


def badges(
    exclusions: Iterable[str], exclusion_mark: str = "🚫 ", issue_mark: str = "⚠️ "
) -> str:
    """Text such as ``🚫 Opted Out | ⚠️ 2 DQ``, empty when nothing is wrong."""
    parts = [
        f"CASE WHEN is_excluded AND {c} THEN {quoted(exclusion_mark + flag_title(c))} END"
        for c in exclusions
    ]
    issues = f"concat({quoted(issue_mark)}, dq_issue_count, ' DQ')"
    parts.append(f"CASE WHEN dq_issue_count > 0 THEN {issues} END")
    return f"concat_ws(' | ', {', '.join(parts)})"


def record_label() -> str:
    """One line that names a record in a selector."""
    return (
        "concat('#', rank, ' | ', entity_id, ' | ', coalesce(first_name, ''), ' ', "
        "coalesce(last_name, ''), ' | Score: ', "
        "IF(readiness_score IS NULL, '', format_string('%.1f', readiness_score)))"
    )


def percent(condition: str) -> str:
    """Share of rows that meet the condition, 0 to 100; unknown counts as no."""
    return f"avg(CASE WHEN {condition} THEN 1D ELSE 0D END) * 100D"


def share(part: str, whole: str) -> str:
    """Percentage, 0 when there is nothing to share."""
    return f"CASE WHEN {whole} > 0 THEN {part} * 100D / {whole} ELSE 0D END"
