"""Mixing sources to target weights by iterative proportional fitting (raking).

Token counts are summed into cells of source, language and topic. Raking scales the cells, one margin after the other,
until every margin has its target share: six sweeps, and more while a share is off by more than the tolerance and gets
nearer. Targets that the cells can't meet together are warned of. A cell's weight is its ratio of raked to given tokens;
over all tokens it is one on average. Divided by a level it is the expected number of copies of the cell's documents, so
the sample's expected margins are the targets. The level is the largest weight, but two at most: documents of heavier
cells are repeated, so a rare cell doesn't decide what is kept of the rest, half of all tokens at least. A document's
draw is a hash of its id: the same on every run and in SQL (whose six sweeps and level hold for tables without such cells).

The cells are as many as the data's combinations, so raking runs on Spark: each step sums one margin and joins it back.
Null source, language or topic is a value of its own; null and empty texts have no tokens and are kept with their cell's
probability. Rows that repeat an id share its draw; a null id draws as the text ``null``. Input columns named like
an output are replaced.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callrank.sources.staging import new_folder, stage

MARGINS, SWEEPS, POWER = ("source", "lang", "topic"), 6, 0.9
#: Largest relative error of a share at which raking ends, sweeps at most, and level at most.
TOLERANCE, MOST_SWEEPS, LEVEL = 0.005, 200, 2.0
WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    """Words of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def topic(text: Column) -> Column:
    """A plain topic by the text's form: licensed, table, marked, shouting or prose."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(text, F.lit("License")), "licensed")
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("***")), "marked")
        .when(F.contains(text, F.lit("!! ")), "shouting")
        .otherwise("prose")
    )


def draw(doc_id: Column) -> Column:
    """A number from 0 to 1 that depends on the id alone."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def targets(cells: DataFrame, margin: str, given: dict[str, float] | None = None, power: float = POWER) -> DataFrame:
    """``value`` and ``share``: the given weights, or the tokens' shares flattened by ``power``; shares sum to 1."""
    sums = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").cast("double").alias("n"))
    if given is None:
        weight = F.pow("n", F.lit(power))
    else:
        known = [F.when(F.col("value") == k, F.lit(float(v))) for k, v in given.items()]
        weight = F.coalesce(*known, F.lit(0.0))
    sums = sums.where("n > 0").select("value", weight.alias("w"))
    total = sums.agg(F.sum("w").alias("total"))
    return sums.crossJoin(F.broadcast(total)).select("value", (F.col("w") / F.col("total")).alias("share"))  # one row


def rake(
    cells: DataFrame, margins: Sequence[str] = MARGINS, sweeps: int = SWEEPS,
    given: dict[str, dict[str, float]] | None = None, power: float = POWER,
) -> DataFrame:
    """``cells`` (the margins and ``tokens``) with ``raked``: weights that sum to 1 and have the margins' targets.

    ``sweeps`` are made at least.
    """
    folder = new_folder(cells.sparkSession)
    goals = {m: stage(targets(cells, m, (given or {}).get(m), power), f"goal_{m}", folder) for m in margins}
    now = cells.withColumn("raked", F.col("tokens").cast("double"))
    last = float("inf")
    for sweep in range(max(sweeps, MOST_SWEEPS)):
        for m in margins:
            sums = now.groupBy(F.col(m).alias("value")).agg(F.sum("raked").alias("now"))
            factor = sums.join(goals[m], sums.value.eqNullSafe(goals[m].value)).where("now > 0")
            factor = factor.select(sums.value.alias("value"), (F.col("share") / F.col("now")).alias("factor"))
            now = now.join(factor, now[m].eqNullSafe(factor.value), "left").select(
                *margins, "tokens", (F.col("raked") * F.coalesce("factor", F.lit(0.0))).alias("raked")
            )
            now = stage(now, f"sweep{sweep}_{m}", folder)
        if sweep + 1 >= sweeps:
            worst = largest_error(now, goals)
            if worst <= TOLERANCE:
                return now
            if worst > 0.9999 * last:
                break
            last = worst
    warnings.warn(f"raking ended with a share {last:.1%} off its target", stacklevel=2)
    return now


def largest_error(raked: DataFrame, goals: dict[str, DataFrame]) -> float:
    """The largest relative error of a margin's share."""
    errors = []
    for m, goal in goals.items():
        sums = raked.groupBy(F.col(m).alias("value")).agg(F.sum("raked").alias("now"))
        met = goal.where("share > 0").join(sums, goal.value.eqNullSafe(sums.value), "left")
        errors.append(met.select(F.abs(F.coalesce("now", F.lit(0.0)) / F.col("share") - 1).alias("error")))
    return reduce(DataFrame.unionAll, errors).agg(F.max("error")).first()[0] or 0.0


def mixed(
    df: DataFrame, given: dict[str, dict[str, float]] | None = None, power: float = POWER, sweeps: int = SWEEPS,
    id_col: str = "doc_id", text_col: str = "text", topic_of: Column | None = None,
) -> DataFrame:
    """``df`` with ``n_words``, ``topic``, ``weight`` (raked to given tokens), ``probability``, ``sampled`` and ``copies``.

    ``copies`` is how often the sample holds the document, ``probability`` that it does at all.
    """
    outputs = ("n_words", "topic", "weight", "probability", "sampled", "copies")
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in outputs]
    about = df.select(
        *kept, tokens(F.col(text_col)).alias("n_words"), (topic(F.col(text_col)) if topic_of is None else topic_of).alias("topic")
    )
    folder = new_folder(df.sparkSession)
    cells = stage(about.groupBy(*MARGINS).agg(F.sum("n_words").alias("tokens")), "cells", folder)
    raked = rake(cells, MARGINS, sweeps, given, power)
    total = raked.agg(F.sum("tokens").cast("double").alias("total"))
    ratio = raked.crossJoin(F.broadcast(total)).select(  # one row
        *[F.col(m).alias(f"{m}__") for m in MARGINS],
        F.when(F.col("tokens") > 0, F.col("raked") * F.col("total") / F.col("tokens")).alias("weight"),
    )
    ratio = stage(ratio, "ratio", folder)
    most = ratio.agg(F.max("weight")).first()[0]
    level = min(most, LEVEL) if most else None
    on = None
    for m in MARGINS:
        same = about[m].eqNullSafe(ratio[f"{m}__"])
        on = same if on is None else on & same
    times = F.coalesce(F.col("weight") / F.lit(level), F.lit(1.0)) if level else F.lit(1.0)
    copies = F.floor(times) + (draw(F.col(id_col)) < times - F.floor(times)).cast("long")
    # Spark broadcasts the cells while they are small and splits hot cells of a shuffled join otherwise
    return about.join(ratio, on, "left").select(
        *about.columns,
        F.coalesce("weight", F.lit(1.0)).alias("weight"),
        F.least(times, F.lit(1.0)).alias("probability"),
        (copies > 0).alias("sampled"),
        copies.alias("copies"),
    )


def ipf_sql(sweeps: int = SWEEPS, power: float = POWER) -> str:
    """DuckDB's version of :func:`mixed` over ``documents``: common table expressions ending in ``mixed``."""
    steps = [
        "about AS MATERIALIZED (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_words, "
        "CASE WHEN contains(coalesce(text, ''), 'License') THEN 'licensed' WHEN contains(coalesce(text, ''), ' | ') THEN 'table' "
        "WHEN contains(coalesce(text, ''), '***') THEN 'marked' WHEN contains(coalesce(text, ''), '!! ') THEN 'shouting' "
        "ELSE 'prose' END AS topic FROM documents)",
        "cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_words)::DOUBLE AS tokens FROM about GROUP BY ALL)",
    ]
    for m in MARGINS:
        steps.append(
            f"goal_{m} AS MATERIALIZED (SELECT value, w / sum(w) OVER () AS share FROM (SELECT {m} AS value, "
            f"pow(sum(tokens), {power}) AS w FROM cells GROUP BY {m} HAVING sum(tokens) > 0))"
        )
    now = "(SELECT source, lang, topic, tokens, tokens AS raked FROM cells)"
    for k in range(sweeps * len(MARGINS)):
        m = MARGINS[k % len(MARGINS)]
        steps.append(
            f"rake_{k} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, "
            f"c.raked * coalesce(g.share / nullif(s.now, 0), 0) AS raked FROM {now} c "
            f"JOIN (SELECT {m} AS value, sum(raked) AS now FROM {now} GROUP BY {m}) s ON s.value IS NOT DISTINCT FROM c.{m} "
            f"LEFT JOIN goal_{m} g ON g.value IS NOT DISTINCT FROM c.{m})"
        )
        now = f"rake_{k}"
    steps.append(
        f"ratio AS MATERIALIZED (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN raked * sum(tokens) OVER () / tokens END "
        f"AS weight FROM {now})"
    )
    steps.append(
        "mixed AS (SELECT a.*, coalesce(r.weight, 1) AS weight, coalesce(r.weight, m.most) / m.most AS probability, "
        "('0x' || substr(md5('mix:' || coalesce(a.doc_id::VARCHAR, 'null')), 1, 12))::BIGINT / 281474976710656.0 "
        "< coalesce(r.weight, m.most) / m.most AS sampled FROM about a JOIN ratio r ON r.source IS NOT DISTINCT FROM a.source "
        "AND r.lang IS NOT DISTINCT FROM a.lang AND r.topic IS NOT DISTINCT FROM a.topic, (SELECT max(weight) AS most FROM ratio) m)"
    )
    return "WITH " + ",\n".join(steps)
