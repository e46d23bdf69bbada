"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly, by a seeded hash, into buckets small enough for memory. Pass two shuffles each
bucket by Fisher-Yates (Spark's ``shuffle``) and writes it. The place of a record in the whole order, its bucket's
offset plus its place there, gives shard ``place mod shards`` and slot ``place div shards``: the law is ``rows``, counts
are at most one apart and slots have no gaps. Equal texts have no bearing on this law: copies are spread like any rows.
``write_shards`` then moves the texts, which are too wide for the buckets, once: straight to the files of their shards.

Repeated rows each get a slot of their own, also if a third of all rows are the same; null texts count as empty;
a null id is a value like any other. The order is written once, so a lost executor doesn't change it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callrank.llm.common import whole_text
from callrank.sources.staging import new_folder, scratch, stage

SHARDS, SEED, BUCKET_ROWS = 40, 42, 20_000

#: Rows of a partition that ``write_shards`` keeps together and gives their places at once: a power of two up to 2^33.
RUN_ROWS = 2**14


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column | str) -> DataFrame:
    """``doc_id``, ``size`` (UTF-8 bytes plus 16) and ``text_crc32`` of each row, then the columns ``more``."""
    text = whole_text(text_col)
    return df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *more,
    )


def shuffled(
    df: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every row of ``measured``, then its other columns.

    ``bucket_rows`` narrow records (some 40 bytes each) are the most that a bucket holds on average. Other columns should
    be as narrow and are of types that sort.
    """
    folder = new_folder(df.sparkSession)
    key = ["doc_id", "size", "text_crc32"]
    others = [c for c in df.columns if c not in key]
    rest = F.struct(*others) if others else F.lit(True)
    # Rows that are the same are numbered apart, within the partition they come from, so that they scatter too.
    counted = df.groupBy(*key, F.spark_partition_id().alias("part_id")).agg(F.collect_list(rest).alias("copies"))
    counted = stage(counted, "counted", folder)
    rows = counted.agg(F.sum(F.size("copies").cast("long"))).first()[0] or 0
    buckets = max(1, -(-rows // bucket_rows))
    scattered = counted.select(*key, F.posexplode("copies").alias("copy", "rest")).withColumn(
        "bucket", F.expr(f"pmod(xxhash64(doc_id, size, text_crc32, bigint(copy + 1), {seed}L), {buckets}L)")
    )
    filled = scattered.groupBy("bucket").agg(
        F.shuffle(F.sort_array(F.collect_list(F.struct(*key, "rest"))), F.lit(seed)).alias("records")
    )
    filled = stage(filled, "filled", folder)
    sizes = filled.select("bucket", F.size("records").cast("long").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    offsets = sizes.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = filled.join(offsets, "bucket").selectExpr("offset", "posexplode(records) AS (pos, record)")
    return placed.selectExpr(
        "record.doc_id", "record.size", "record.text_crc32",
        f"int((offset + pos) % {shards}) AS shard", f"(offset + pos) div {shards} AS slot",
        *(f"record.rest.`{c}`" for c in others),
    )


def write_shards(
    df: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write ``doc_id``, ``text`` and ``slot`` as one folder a shard, in slot order within each file; a scan of them.

    A shard is written by as many tasks as its rows need: rows are dealt by shard and range of slots. Rows are read once
    and known by their run and number in it from then on, so that rows of one id and check sum keep their own texts.
    """
    spark = df.sparkSession
    number = F.monotonically_increasing_id()  # counts from a multiple of 2^33 in each partition
    texts = df.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"), number.alias("number")).select(
        "doc_id", "text", F.expr(f"number div {RUN_ROWS} AS run"), F.expr(f"int(number % {RUN_ROWS}) AS at")
    )
    table = f"texts_{uuid.uuid4().hex}"
    with scratch(spark) as folder:
        # By runs of rows as they come: the places of a run's rows come to it without moving its texts.
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        kept = texts.write.option("compression", "zstd").option("path", f"{folder}/texts").bucketBy(buckets, "run")
        try:
            kept.saveAsTable(table)
            texts = spark.table(table)
            order = shuffled(measured(texts, "doc_id", "text", "run", "at"), shards, seed)
            found = order.select("run", F.struct("at", (F.col("slot") * shards + F.col("shard")).alias("place")).alias("found"))
            # "at" counts from 0 without gaps in a run, so it is the place's index too.
            places = found.groupBy("run").agg(F.sort_array(F.collect_list("found"))["place"].alias("places"))
            placed = texts.join(places.hint("shuffle_hash"), "run").withColumn("place", F.expr("places[at]"))
            placed = placed.selectExpr("doc_id", "text", f"place div {shards} AS slot", f"int(place % {shards}) AS shard")
            dealt = placed.withColumn("range", F.expr("slot div 100000")).repartition("shard", "range")
            dealt = dealt.sortWithinPartitions("shard", "slot").drop("range")
            dealt.write.partitionBy("shard").parquet(path)
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
    return spark.read.schema(placed.schema).parquet(path)
