"""The registered queries of this package: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callrank.llm import bitslices, bpe, edits, itq, langid, merkle, mixing, periodic, pii, sharding, simhash, toxicity, wrappers
from callrank.llm.common import ship_code, whole_text
from callrank.sources.staging import new_folder, scratch, stage

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

Query = Callable[[SparkSession, str], DataFrame]


def tidy(query: Query) -> Query:
    """The query with its result written and its intermediate tables deleted."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = new_folder(spark)
        with scratch(spark):
            return stage(query(spark, sf_dir), query.__name__, folder)

    return run


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.with_next(documents(spark, sf_dir))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", whole_text().alias("text"))
    return bpe.encode_documents(docs, RANKS).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@tidy
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six decimals of the weights are compared; the draw decides on all of them."""
    return mixing.mixed(documents(spark, sf_dir)).select(
        "doc_id", "source", "lang", "topic", "n_words", F.round("weight", 6).alias("weight"),
        F.round("probability", 6).alias("probability"), "sampled",
    )


@tidy
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@tidy
def op5_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(documents(spark, sf_dir, "embeddings"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_spans(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [F.expr(f"size(filter(spans, x -> x.kind = {i}))").cast("long").alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(F.expr(pii.joined("base")), 256).alias("base_sha256"), F.expr(pii.joined("spans")).alias("spans")
    )


@tidy
def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extracted(documents(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), documents(spark, sf_dir, "labels")
    lexicon = toxicity.learn(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    scored = docs.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), toxicity.score(lexicon, F.col("text")).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


@tidy
def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document and page. Documents have no markup or address; their source stands for the host."""
    docs, pages = documents(spark, sf_dir), documents(spark, sf_dir, "pages")
    langs, logs = langid.learn(docs.select("lang", "text", F.col("doc_id").alias("id")))
    none = F.lit(None).cast("string")
    texts = docs.select(
        "doc_id", F.lit(None).cast("long").alias("page_id"), F.nullif("text", F.lit("")).alias("text"),
        none.alias("markup"), none.alias("suffix"), F.col("source").alias("host"),
    )
    visible = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " "), r"\s+", " ")
    addressed = pages.select(
        F.lit(None).cast("long").alias("doc_id"), "page_id", F.nullif(F.trim(visible), F.lit("")).alias("text"),
        langid.declared(F.col("html")).alias("markup"), langid.suffix(F.col("url")).alias("suffix"),
        F.nullif(wrappers.host(F.col("url")), F.lit("")).alias("host"),
    )
    found = langid.identified(texts.unionByName(addressed), langs, logs)
    return found.select("doc_id", "page_id", "language", F.round("confidence", 6).alias("confidence"))


@tidy
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards are written, texts and all; the columns are those of the texts found in them."""
    written = sharding.write_shards(documents(spark, sf_dir), f"{new_folder(spark)}/shards")
    return sharding.measured(written, "doc_id", "text", "shard", "slot").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_bitslice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors whose id is divisible by 50 against all others: the five of the greatest inner product."""
    vectors = documents(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return bitslices.top(vectors, F.col("vec_id") % 50 == 0)


@tidy
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof; a fifth of the documents are held against the manifest with lower-cased texts."""
    docs = documents(spark, sf_dir)
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    drawn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.when(drawn, F.translate("text", capitals, capitals.lower()))
    now = [tampered if c == "text" else F.col(c) for c in fields]
    leaves = docs.select(
        "source", "doc_id", merkle.leaf(*map(F.col, fields)).alias("leaf"), F.when(drawn, merkle.leaf(*now)).alias("now")
    )
    return merkle.proven(leaves, group="source", key="doc_id").drop("source")


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words; by its id's check sum a tenth of the documents end in a periodic stretch."""
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    changed = F.when(number % 10 == 0, periodic.with_tail(F.col("text"), F.floor(number / 10))).otherwise(F.col("text"))
    found = periodic.with_runs(documents(spark, sf_dir).select("doc_id", changed.alias("text")))
    longest = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("top", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.expr("-top.start").alias("start"), "top.length", F.expr("-top.period").alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


ALL: dict[str, Query] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_bpe": op2_bpe,
    "op3_mixing": op3_mixing,
    "op4_simhash": op4_simhash,
    "op5_itq": op5_itq,
    "op6_pii": op6_pii,
    "op7_html": op7_html,
    "op8_toxicity": op8_toxicity,
    "op9_langid": op9_langid,
    "op10_sharding": op10_sharding,
    "op11_bitslice": op11_bitslice,
    "op12_merkle": op12_merkle,
    "op13_periodic": op13_periodic,
}
