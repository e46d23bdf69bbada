"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again as the next one's input.

All stages but the last return the columns of their input; the last adds the token ids.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from callrank.llm import bpe, mixing, pii, simhash, toxicity  # noqa: E402
from callrank.llm.common import ship_code, unused  # noqa: E402
from callrank.llm.queries import RANKS  # noqa: E402
from callrank.sources.staging import discard, new_folder, scratch, stage  # noqa: E402


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. The lexicon is learned from the labels of all rows but the held-out ones."""
    ship_code(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.learn(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    return docs.where(toxicity.score(lexicon, F.col("text")) < toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays."""
    ship_code(spark)
    return simhash.deduplicated(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to marks; ``n_chars`` follows the text."""
    redacted = pii.redacted(docs)
    kept = [F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return redacted.select(*kept)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose source, language and topic shares are the flattened ones; documents of rare cells are repeated."""
    mixed = mixing.mixed(docs).where("sampled")
    again = unused(mixed, "again__")
    return mixed.withColumn(again, F.explode(F.expr("array_repeat(0, int(copies))"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian 32-bit integers) with the offsets that decoding needs."""
    ship_code(spark)
    coded = bpe.encoded(spark, F.coalesce(F.col("text"), F.lit("")), RANKS)
    return docs.withColumn("coded", coded).select(
        "doc_id", "lang", "source", F.expr("octet_length(coded.ids) div 4").alias("n_tokens"), "coded.ids", "coded.offsets"
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", redact_pii),
    ("mixing", mix),
    ("bpe", encode),
]

#: A learned lexicon and hashed shingles are not SQL's; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each read from what the one before it wrote, which is deleted then.

    Rows without an id go through all stages like others; see the operators for what each makes of them.
    """
    folder = new_folder(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, function in STAGES:
        with scratch(spark):
            docs = stage(function(spark, docs, sf_dir), name, folder)
        if before:
            discard(spark, f"{folder}/{before}")
        before = name
    return docs
