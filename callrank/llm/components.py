"""Connected components of a graph given as links, on Spark.

Large-star and small-star steps (Kiveris et al. 2014) by groupings and joins. Each round is written to the shared folder
and read again. Nothing is collected but a count and a check sum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callrank.sources.staging import new_folder, stage

MOST_ROUNDS = 60


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.expr("pmod(xxhash64(child, parent), 1000000007L)"))).first())


def _round(edges: DataFrame) -> DataFrame:
    both = edges.selectExpr("child AS u", "parent AS v").unionAll(edges.selectExpr("parent AS u", "child AS v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(least, "u").where("v > u AND v > m").selectExpr("v AS child", "m AS parent").distinct()
    lowest = large.groupBy("child").agg(F.min("parent").alias("m"))
    joined = large.join(lowest, "child")
    small = joined.selectExpr(
        "inline(IF(parent = m, array(struct(child AS child, m AS parent)), array(struct(parent AS child, m AS parent))))"
    )
    return small.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for each node of ``edges`` (``a``, ``b``: long)."""
    folder = new_folder(edges.sparkSession)
    now = edges.where("a <> b").selectExpr("greatest(a, b) AS child", "least(a, b) AS parent").distinct()
    now = stage(now, "round0", folder)
    mark = _sum(now)
    for k in range(1, MOST_ROUNDS + 1):
        if not mark[0]:
            break
        now = stage(_round(now), f"round{k}", folder)
        mark, old = _sum(now), mark
        if mark == old:
            break
    else:
        raise RuntimeError(f"no end of merging after {MOST_ROUNDS} rounds")
    roots = now.selectExpr("parent AS node", "parent AS component").distinct()
    return now.selectExpr("child AS node", "parent AS component").unionAll(roots)
