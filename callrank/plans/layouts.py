"""Written layouts that make later questions cheap: the ranked table by record, memberships by entity."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callrank.operators.clean import ENTITY
from callrank.operators.features import engagement_features
from callrank.operators.lookups import HOT_KEY_SHARE
from callrank.plans.analytics import engagement_history
from callrank.sources.staging import new_folder, stage

#: Bytes of a row group of the table by record: what a look at one record reads at least.
GROUP_BYTES = 4 << 20


def write_by_record(ranked: DataFrame, path: str, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The ranked table in the order of its record ids, for ``find_record``.

    A filter on ``entity_id`` opens only files whose range holds the id, and of these only the row groups whose
    range and Bloom filter do. The order is (id, type, rank), so an id that many rows repeat is split over files.
    """
    order = ["entity_id", "entity_type", "rank"]
    (
        ranked.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .option("parquet.bloom.filter.enabled#entity_id", "true")
        .option("parquet.block.size", str(group_bytes))
        .parquet(path)
    )
    return ranked.sparkSession.read.schema(ranked.schema).parquet(path)


class StoredMembers(NamedTuple):
    """Memberships stored by entity: ``bucketed`` holds those of ordinary entities, ``hot`` those of the few large ones."""

    bucketed: DataFrame
    hot: DataFrame

    def history(self, latest: int = 20) -> DataFrame:
        """``engagement_history`` of every record: no membership of an ordinary entity is shuffled."""
        return engagement_history(self.bucketed, latest).unionByName(engagement_history(self.hot, latest))

    def engagement(self, reference) -> DataFrame:
        """``engagement_features`` of every entity, likewise."""
        return engagement_features(self.bucketed, reference).unionByName(engagement_features(self.hot, reference))

    def everything(self) -> DataFrame:
        return self.bucketed.unionByName(self.hot)


def store_members(
    members: DataFrame, table: str, path: str | None = None, buckets: int | None = None, hot_share: float = HOT_KEY_SHARE
) -> StoredMembers:
    """Write memberships once, bucketed by entity, so that what is asked per entity needs no shuffle of them.

    ``table`` names the bucketed table in the session's catalog (with ``path`` it is an external one). A bucket is one task's,
    so entities on more than ``hot_share`` of the rows, and rows without an id, are kept apart in a plain table. There are at
    most ``1 / hot_share`` such entities, which bounds the broadcast.
    """
    spark: SparkSession = members.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = f"{path}_hot" if path else new_folder(spark)
    least = F.lit(float(hot_share)) * members.selectExpr("count(1)").scalar()
    counts = members.groupBy(*ENTITY).agg(F.expr("count(1) AS _rows"))
    hot = counts.filter((F.col("_rows") > least) | F.col("entity_id").isNull()).selectExpr(*[f"{c} AS _{c}" for c in ENTITY])
    hot = stage(hot, "hot_entities", folder)
    same = F.expr(" AND ".join(f"{c} <=> _{c}" for c in ENTITY))
    apart = stage(members.join(F.broadcast(hot), same, "left_semi"), "hot_members", folder)
    ordinary = members.join(F.broadcast(hot), same, "left_anti")
    # one file a bucket: rows are dealt by the hash that buckets are made of
    writer = ordinary.repartition(buckets, *ENTITY).write.mode("overwrite").bucketBy(buckets, *ENTITY).sortBy(*ENTITY)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return StoredMembers(spark.table(table), apart)
