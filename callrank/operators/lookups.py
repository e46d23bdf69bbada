"""Left joins to a table with one row per key, safe against hot keys on the left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key on more than this share of the left rows is hot. At most 1 / HOT_KEY_SHARE keys can be, however
# many rows there are, which bounds what is broadcast for them.
HOT_KEY_SHARE = 1e-4


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate: file sizes carried upward, an upper bound through filters."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcast_limit(df: DataFrame) -> int:
    return df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


# A table whose files have this part of the broadcast limit is expected to be broadcast when its size is known.
FILES_TO_ROWS = 8


def file_bytes(df: DataFrame) -> int:
    """Bytes of what ``df`` reads; joins on the way are not multiplied, as Catalyst's estimate does."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def splits_hot_keys(df: DataFrame) -> bool:
    """Whether Spark itself splits partitions that a hot key made large, by their sizes as shuffled."""
    conf = df.sparkSession.conf
    names = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")
    return all(conf.get(name, "true") == "true" for name in names)


def lookup_join(
    left: DataFrame,
    table: DataFrame,
    key: str,
    spread: str,
    match_nulls: bool = False,
    counted: str | None = None,
    hot_share: float | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Add the other columns of ``table`` (unique on ``key``) to every row of ``left``.

    A table within the session's broadcast limit by Catalyst's estimate is broadcast. Beyond it the join is a plain left
    join, which Catalyst drops when nobody asks for the looked-up columns (if ``table`` is grouped by ``key``).
    Adaptive execution sizes it as it runs: a side that turns out small is broadcast, a partition that a hot key made large
    is split over tasks. Spark splits only what was shuffled for the join itself, not what is left from the grouping
    of ``table``; where its files aren't so small that the join becomes a broadcast one, a second key, always 0, makes the two
    partitionings differ. Rows whose null key matches nothing are spread by ``spread`` under other numbers of that second key.

    With ``hot_share``, or where adaptive execution doesn't split, hot keys are found first: those on more
    than this share of the left rows are counted and only their table rows are broadcast, while the rows
    that carry them (and rows whose null key matches nothing) are spread by the expression ``spread`` in
    the shuffled join that serves all other keys. Each left row is kept once; the counts read its key once
    more. ``counted`` names the column of ``table`` that holds the number of left rows per key, when it is
    known; then only the total is counted.
    """
    values = ", ".join(c for c in table.columns if c != key)
    # A null key of the table would otherwise match null keys on the left.
    usable = table if match_nulls else table.filter(f"{key} IS NOT NULL")
    packed = usable.selectExpr(f"{key} AS _key", f"struct({values}) AS _value")
    limit = broadcast_limit(left) if limit is None else limit

    same = f"{key} <=> _key" if match_nulls else f"{key} = _key"
    if estimated_bytes(packed) <= limit:
        return left.join(F.broadcast(packed), F.expr(same), "left").select(*left.columns, "_value.*")
    if hot_share is None and splits_hot_keys(left):
        if file_bytes(packed) <= limit // FILES_TO_ROWS:
            return left.join(packed, F.expr(same), "left").select(*left.columns, "_value.*")
        zero = "pmod(xxhash64({}), 1L)"  # which Catalyst doesn't see through
        apart = "false" if match_nulls else f"{key} IS NULL"
        slot = f"IF({apart}, 1 + pmod(xxhash64({spread}), 1073741824L), {zero.format(key)})"
        slotted = left.withColumn("_slot", F.expr(slot))
        zeroed = packed.withColumn("_zero", F.expr(zero.format("_key")))
        joined = slotted.join(zeroed, F.expr(f"{same} AND _slot = _zero"), "left")
        return joined.select(*left.columns, "_value.*")

    hot_share = HOT_KEY_SHARE if hot_share is None else hot_share
    least = F.lit(float(hot_share)) * left.selectExpr("count(1)").scalar()
    if counted:
        hot = packed.filter(F.col(f"_value.{counted}") > least).selectExpr(
            "_key AS _hot_key", "_value AS _hot_value", "true AS _is_hot"
        )
    else:
        hot_keys = (
            left.groupBy(F.col(key).alias("_hot_key"))
            .agg(F.expr("count(1) AS _rows"))
            .filter(F.col("_rows") > least)
            .select("_hot_key")
        )
        hot_values = packed.join(
            F.broadcast(hot_keys.withColumnRenamed("_hot_key", "_wanted")),
            F.expr("_key <=> _wanted"),
            "left_semi",
        )
        hot = hot_keys.join(hot_values, F.expr("_hot_key <=> _key"), "left").selectExpr(
            "_hot_key", "_value AS _hot_value", "true AS _is_hot"
        )

    # Slot 0 holds the ordinary keys. Comparing key and slot as one struct keeps the two together
    # as the partitioning key, and treats a null key inside it as a value.
    apart = "_is_hot IS NOT NULL" if match_nulls else f"_is_hot IS NOT NULL OR {key} IS NULL"
    slot = f"CASE WHEN {apart} THEN 1 + pmod(xxhash64({spread}), 1073741824L) ELSE 0L END"
    slotted = left.join(F.broadcast(hot), F.expr(f"{key} <=> _hot_key"), "left").selectExpr(
        *left.columns, "_hot_value", f"named_struct('k', {key}, 's', {slot}) AS _slot"
    )
    cold = packed.selectExpr("named_struct('k', _key, 's', 0L) AS _cold_slot", "_value AS _cold")
    joined = slotted.join(cold, F.expr("_slot = _cold_slot"), "left")
    return joined.selectExpr(
        *left.columns, "coalesce(_hot_value, _cold) AS _value"
    ).select(*left.columns, "_value.*")
