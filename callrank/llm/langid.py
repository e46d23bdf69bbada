"""Language identification by Bayesian evidence fusion.

Four sources of evidence give a posterior over languages: how likely each language's model makes the text, the language
that the markup declares, the suffix of the address (top-level domain, or a language as the first step of the path), and
a prior of the host. The host prior is smoothed hierarchically: counts of a host, by grouped aggregation over all rows, are
shrunk to those of its parent domain, and these to all rows. Text models are hashed character trigrams, learned from a
bounded expected number of labelled rows a language; the trust in a declared language and in a suffix is how often each agrees with
the text, counted over all rows.

Evidence that is missing (null text, no markup, no address) leaves the posterior as it is; a row without any gets the
prior. Declared languages and suffixes that no text was seen with count as missing. Repeated rows get the same answer; of equally
likely languages the first by name is taken. Without any labelled text no language is known: rows get a null language and
confidence 0. An empty table gives none. Extra columns are carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callrank.llm.common import by_size, strings
from callrank.operators.lookups import lookup_join
from callrank.sources.staging import new_folder, stage

#: Languages told apart: the commonest labels, in the order of their names. Labelled rows a language to learn from, as expected; trigram hashes; weight of a parent against a child's counts; and the most that
#: a text's log likelihoods may differ, as trigrams overlap and aren't independent.
LANGUAGES, LABELLED, HASHES, SHRINK, TEMPER = 256, 1_000, 1 << 13, 5.0, 0.2


def _hashes(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.uint64)
    mixed = x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:] * np.uint64(0x165667B19E3779F9)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(51)).astype(np.intp)


def _trigrams(text: str) -> np.ndarray:
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le"), np.uint32)
    letters = np.where(codes < 0x41, np.uint32(32), codes)
    return _hashes(letters)


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and the log probabilities of hashes for each, from ``lang`` and ``text`` (and ``id`` to choose rows by)."""
    usable = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    # rows are chosen by a hash of their id, each language at its own rate, so no task gathers a language
    common = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    rates = F.broadcast(common.select("lang", (F.lit(1e9 * LABELLED) / F.col("n")).alias("rate")))  # LANGUAGES rows at most
    few = usable.join(rates, "lang").where(F.expr("pmod(xxhash64(id), 1000000000L) < rate")).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang").text:
                sums = np.zeros(HASHES, np.int64)
                for text in texts:
                    sums += np.bincount(_trigrams(text), minlength=HASHES)
                at = np.flatnonzero(sums)
                yield pd.DataFrame({"lang": lang, "hash": at, "n": sums[at]})

    rows = few.mapInPandas(count, "lang string, hash int, n long").groupBy("lang", "hash").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r.lang for r in rows})  # languages x HASHES numbers at most
    counts = np.full((len(langs), HASHES), 0.5)
    for r in rows:
        counts[langs.index(r.lang), r.hash] += r.n
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True))


def likelihoods(spark, langs: list[str], logs: np.ndarray, text: Column) -> Column:
    """Tempered log likelihood of the text for each language; null for a null or empty text."""
    model = spark.sparkContext.broadcast(logs)

    def score(column: pa.Array) -> pa.Array:
        texts, table, out = strings(column), model.value, []
        for a, b in by_size(texts):
            for t in texts[a:b]:
                out.append((table[:, _trigrams(t)].sum(axis=1) * TEMPER).tolist() if t else None)
        return pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(score, "array<double>")(text)


def declared(html: Column) -> Column:
    """The language that the first ``<html lang=...>`` names, two letters, however much comes before it."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([a-z]{2})\b", 1)), F.lit(""))


def suffix(url: Column) -> Column:
    """The first step of the path if it looks like a language, else the top-level domain."""
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+/([a-z]{2})(?:[/?#]|$)", 1)
    top = F.regexp_extract(url, r"^[a-zA-Z]+://(?:[^/?#@]*@)?[^/?#:]*\.([A-Za-z]+)(?:[:/?#]|$)", 1)
    return F.lower(F.coalesce(F.nullif(path, F.lit("")), F.nullif(top, F.lit(""))))


def _softmax(values: str) -> str:
    return f"transform({values}, x -> exp(x - array_max({values})))"


def identified(rows: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """``rows`` (``text``, ``markup``, ``suffix``, ``host``, and more) with ``language`` and ``confidence``, less the evidence.

    ``host`` may be null. The parent of a host is the host less its first label.
    """
    spark, k = rows.sparkSession, len(langs)
    evidence = ("text", "markup", "suffix", "host")
    carried = [F.col(f"`{c}`").alias(f"carried__{i}") for i, c in enumerate(c for c in rows.columns if c not in evidence)]
    names = [c for c in rows.columns if c not in evidence]
    if not langs:
        none = F.lit(None).cast("string")
        return rows.select(*[F.col(f"`{c}`") for c in names], none.alias("language"), F.lit(0.0).alias("confidence"))
    folder = new_folder(spark)
    known = F.array(*[F.lit(x) for x in langs])
    zeros = F.array_repeat(F.lit(0.0), F.lit(k))
    best = F.expr("array_position(likely, array_max(likely))").cast("int")
    seen = rows.select(*carried, "markup", "suffix", "host", likelihoods(spark, langs, logs, F.col("text")).alias("likely"))
    seen = stage(seen, "seen", folder)
    guess = seen.where("likely IS NOT NULL").select("markup", "suffix", "host", F.element_at(known, best).alias("guess"))

    def counted(column: str) -> DataFrame:
        """Rows of each language, by their texts, for each value of an evidence column."""
        sums = [F.count_if(F.col("guess") == x).alias(f"n{i}") for i, x in enumerate(langs)]
        return guess.where(F.col(column).isNotNull()).groupBy(column).agg(*sums)

    def table(column: str) -> DataFrame:
        """Smoothed log P(value | language), as an array by language, for each value of an evidence column."""
        counts = stage(counted(column), f"{column}_counts", folder)
        totals = [max(1, v or 0) for v in counts.agg(*[F.sum(f"n{i}") for i in range(k)]).first()]
        logs_ = [F.log((F.col(f"n{i}") + 0.5) / F.lit(t + 1.0)) for i, t in enumerate(totals)]
        return counts.select(column, F.array(*logs_).alias(f"{column}_log"))

    hosts = stage(counted("host"), "hosts", folder)
    parent = F.regexp_replace("host", r"^[^.]*\.", "")
    domains = hosts.groupBy(parent.alias("domain")).agg(*[F.sum(f"n{i}").alias(f"d{i}") for i in range(k)])
    whole = [v + 1.0 for v in guess.agg(*[F.count_if(F.col("guess") == x) for x in langs]).first()]
    whole = [v / sum(whole) for v in whole]
    d_sum, n_sum = (" + ".join(f"{p}{i}" for i in range(k)) for p in "dn")
    shared = hosts.join(domains, parent == F.col("domain")).select(
        "host",
        F.array(*[
            F.expr(f"ln((n{i} + {SHRINK}D * (d{i} + {SHRINK}D * {whole[i]!r}D) / ({d_sum} + {SHRINK}D)) / ({n_sum} + {SHRINK}D))")
            for i in range(k)
        ]).alias("host_log"),
    )
    shared = stage(shared, "host_logs", folder)  # written, so that their size is known
    ids = [f"carried__{i}" for i in range(len(names))]
    spread = f"xxhash64({', '.join([*ids, 'host'])})"
    fused = seen
    for column, found in (("markup", table("markup")), ("suffix", table("suffix")), ("host", shared)):
        fused = lookup_join(fused, found, column, spread)
    prior = F.array(*[F.log(F.lit(v)) for v in whole])
    total = F.coalesce("likely", zeros)
    for part in (F.coalesce("markup_log", zeros), F.coalesce("suffix_log", zeros), F.coalesce("host_log", prior)):
        total = F.zip_with(total, part, lambda a, b: a + b)
    fused = fused.select(*ids, total.alias("total__")).withColumn("odds__", F.expr(_softmax("total__")))
    top = F.expr("array_position(total__, array_max(total__))").cast("int")
    return fused.select(
        *[F.col(i).alias(c) for i, c in zip(ids, names, strict=True)],
        F.element_at(known, top).alias("language"), F.expr("1 / aggregate(odds__, 0D, (a, x) -> a + x)").alias("confidence"),
    )
