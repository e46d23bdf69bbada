"""Numeric summaries: count, mean, std, min, quartiles, max per column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
# Size of a quantile sketch, how many of its errors (at 99 %) a bracket is wide to each side, buckets a bracket is cut into.
SKETCH, MARGIN, BUCKETS = 2048, 2, 4096


def rows_from(df: DataFrame, rows: Sequence[Mapping[str, str]], keep: Sequence[str] = ()) -> DataFrame:
    """Turn each input row, usually a one-row aggregate, into several rows of a report.

    Each row maps column names to SQL text.
    """
    structs = [
        "named_struct(" + ", ".join(f"'{name}', {sql}" for name, sql in row.items()) + ")"
        for row in rows
    ]
    return df.selectExpr(*keep, f"inline(array({', '.join(structs)}))")


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact summary of columns with few distinct values (counts, days, rounded scores).

    ``percentile`` keeps one counter per distinct value, so its state is bounded by their number, not by
    the rows. For continuous columns use ``wide_summary``.
    """
    ps = ", ".join(f"{p}D" for p in QUARTILES.values())
    one = df.selectExpr(
        *[
            f"named_struct('metric', '{c}', 'n', count({c}), 'mean', avg({c}), "
            f"'std', stddev_samp({c}), 'min', CAST(min({c}) AS double), "
            f"'q', percentile({c}, array({ps})), 'max', CAST(max({c}) AS double)) AS _{c}"
            for c in columns
        ]
    )
    rows = one.selectExpr(f"inline(array({', '.join(f'_{c}' for c in columns)}))")
    quartiles = [f"q[{i}] AS {q}" for i, q in enumerate(QUARTILES)]
    return rows.selectExpr("metric", "n", "mean", "std", "min", *quartiles, "max")


def profiled(df: DataFrame, columns: Sequence[str], probabilities: Mapping[str, float], k: int = SKETCH) -> Column:
    """Per column its moments and a bracket of each wanted quantile, by a sketch, from one pass: a scalar struct."""
    margin = MARGIN * 2.296 / k**0.9021
    sides = ", ".join(f"{max(0.0, p - margin)!r}D, {min(1.0, p + margin)!r}D" for p in sorted(probabilities.values()))
    each = [
        f"struct(count(`{c}`) AS n, avg(`{c}`) AS mean, stddev_samp(`{c}`) AS std, CAST(min(`{c}`) AS double) AS min, "
        f"CAST(max(`{c}`) AS double) AS max, IF(count(`{c}`) = 0, NULL, "
        f"kll_sketch_get_quantile_double(kll_sketch_agg_double(CAST(`{c}` AS double), {k}), array({sides}))) AS ends) AS `{c}`"
        for c in columns
    ]
    return df.selectExpr(*each).selectExpr(f"struct({', '.join(f'`{c}`' for c in columns)}) AS profile").scalar()


def near_quantiles(df: DataFrame, columns: Sequence[str], profile: Column, quantiles: int, buckets: int) -> DataFrame:
    """Rows per metric and stretch of values, in whose order (``zone``, ``part``, ``value``) the values are in order.

    A value's zone is the number of brackets that begin at or below it. A value in a bracket counts under itself and the
    part of the bracket it is in, any other only under its zone, as the last part of it.
    """
    values = df.selectExpr(*[f"CAST(`{c}` AS double) AS `{c}`" for c in columns]).withColumn("_profile", profile)
    rows = []
    for c in columns:
        ends = f"_profile.`{c}`.ends"
        zone = " + ".join(f"CAST(`{c}` >= {ends}[{2 * i}] AS int)" for i in range(quantiles))
        rows.append({
            "metric": f"'{c}'", "total": f"_profile.`{c}`.n", "zone": f"IF(`{c}` IS NULL, NULL, {zone})",
            "low": f"get({ends}, 2 * ({zone}) - 2)", "high": f"get({ends}, 2 * ({zone}) - 1)", "value": f"`{c}`",
        })
    found = rows_from(values, rows).filter("zone IS NOT NULL")
    part = f"CASE WHEN coalesce(value > high, true) THEN {buckets}L WHEN high > low THEN least(floor((value - low) / (high - low) * {buckets}), {buckets - 1}L) ELSE 0L END"
    return (
        found.selectExpr("metric", "total", "zone", f"{part} AS part", "IF(value <= high, value, NULL) AS value")
        .groupBy("metric", "total", "zone", "part", "value")
        .agg(F.expr("count(1) AS n"))
    )


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Mapping[str, float],
    profile: Column,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The values at the places next to the quantiles of numeric columns: ``metric``, ``name``, ``side`` and ``value``.

    ``profile`` brackets them (one pass over ``df``), this takes one more pass. Bracketed values are a small share of
    all rows, ``2 * MARGIN * 2.3 / k ** 0.9`` for each quantile. The totals of the brackets' parts, a bounded table, tell which
    of them hold the wanted places. Only the distinct values in those are put in order: no group grows with the rows
    unless its values fall into one part. A bracket that misses its quantile (some five standard errors off) is an error, not a
    wrong value.
    """
    counts = near_quantiles(df, columns, profile, len(probabilities), buckets)
    places = {
        (name, side): f"{side}({p!r}D * (total - 1))"
        for name, p in probabilities.items()
        for side in ("floor", "ceil")
    }

    def holds(first: str, size: str) -> str:
        """Whether one of the wanted places is among ``size`` rows after the ``first`` ones."""
        return " OR ".join(f"({p} >= {first} AND {p} < {first} + {size})" for p in places.values())

    earlier = "PARTITION BY metric ORDER BY zone, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    boxes = (
        counts.groupBy("metric", "total", "zone", "part")
        .agg(F.expr("sum(n) AS size"))
        .selectExpr("*", f"coalesce(sum(size) OVER ({earlier}), 0L) AS start")
        .filter(holds("start", "size"))
        .selectExpr("metric AS _metric", "zone AS _zone", "part AS _part", "start")
    )
    chosen = counts.join(F.broadcast(boxes), F.expr("metric = _metric AND zone = _zone AND part = _part"))
    placed = chosen.selectExpr("*", "start + sum(n) OVER (PARTITION BY metric, zone, part ORDER BY value) - n AS skip")
    known = placed.filter(holds("skip", "n")).selectExpr(
        "metric", "n", "skip", "total", "coalesce(value, raise_error('a quantile is outside its bracket')) AS value"
    )
    wanted = [{"name": f"'{name}'", "side": f"'{side}'", "place": place} for (name, side), place in places.items()]
    found = rows_from(known, wanted, keep=["metric", "value", "n", "skip"])
    return found.filter("place >= skip AND place < skip + n").select("metric", "name", "side", "value")


def wide_summary(df: DataFrame, columns: Sequence[str], k: int = SKETCH, buckets: int = BUCKETS) -> DataFrame:
    """Exact summary of numeric columns of any range, NaN taken as missing."""
    clean = df.selectExpr(*[f"nanvl(CAST({c} AS double), CAST(NULL AS double)) AS `{c}`" for c in columns])
    profile = profiled(clean, columns, QUARTILES, k)
    found = exact_quantiles(clean, columns, QUARTILES, profile, buckets)
    # two values for each name and column: a bounded map
    found = found.selectExpr("map_from_entries(collect_list(struct(concat_ws(' ', name, side, metric), value)))").scalar()
    one = df.sparkSession.range(1).select(profile.alias("profile"), found.alias("found"))

    def interpolated(name: str, p: float, c: str) -> str:
        low, high = f"found['{name} floor {c}']", f"found['{name} ceil {c}']"
        return f"{low} + ({high} - {low}) * ({p!r}D * (profile.`{c}`.n - 1) % 1D)"

    rows = [
        {"metric": f"'{c}'"}
        | {name: f"profile.`{c}`.{name}" for name in ("n", "mean", "std", "min")}
        | {q: interpolated(q, p, c) for q, p in QUARTILES.items()}
        | {"max": f"profile.`{c}`.max"}
        for c in columns
    ]
    return rows_from(one, rows)
