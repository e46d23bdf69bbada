"""Language ID: the posterior against a plain computation, and inputs that lack things."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from callrank.llm import langid, queries

KIND = "id long, text string, markup string, suffix string, host string"


def plain_posterior(rows, langs, logs):
    """``rows`` of (id, text, markup, suffix, host)."""
    k = len(langs)
    likely = [[float(x) for x in logs[:, langid._trigrams(t)].sum(axis=1) * langid.TEMPER] if t else None for _, t, *_ in rows]
    guess = [None if x is None else int(np.argmax(x)) for x in likely]

    def table(column):
        counts = defaultdict(Counter)
        for row, g in zip(rows, guess, strict=True):
            if row[column] is not None and g is not None:
                counts[row[column]][g] += 1
        totals = [max(1, sum(c[i] for c in counts.values())) for i in range(k)]
        return {v: [math.log((c[i] + 0.5) / (totals[i] + 1)) for i in range(k)] for v, c in counts.items()}, counts

    (markup, _), (suffix, _), (_, hosts) = table(2), table(3), table(4)
    seen = Counter(g for g in guess if g is not None)
    whole = [seen[i] + 1.0 for i in range(k)]
    whole = [v / sum(whole) for v in whole]
    domains = defaultdict(Counter)
    for host, c in hosts.items():
        domains[host.split(".", 1)[1] if "." in host else host] += c
    s, out = langid.SHRINK, {}
    for (i, _, m, x, h), own in zip(rows, likely, strict=True):
        total = own or [0.0] * k
        for found in (markup.get(m), suffix.get(x)):
            total = [a + b for a, b in zip(total, found or [0.0] * k, strict=True)]
        if h in hosts:
            d, n = domains[h.split(".", 1)[1] if "." in h else h], hosts[h]
            prior = [
                math.log((n[j] + s * (d[j] + s * whole[j]) / (sum(d.values()) + s)) / (sum(n.values()) + s)) for j in range(k)
            ]
        else:
            prior = [math.log(v) for v in whole]
        total = [a + b for a, b in zip(total, prior, strict=True)]
        odds = [math.exp(v - max(total)) for v in total]
        out[i] = langs[total.index(max(total))], 1 / sum(odds)
    return out


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return langid.learn(docs.select("lang", "text", F.col("doc_id").alias("id")))


def probes(spark, sf_dir):
    rnd = random.Random(2)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    rows = []
    for i, text in enumerate(texts + [None, ""] * 20):
        cut = text and " ".join(text.split()[: rnd.choice([1, 3, 400])])
        host = rnd.choice(["hot.example", "hot.example", "a.one.example", "b.one.example", "lone", f"h{i}.two", None])
        rows.append((i, cut, rnd.choice(["de", "en", "xx", None]), rnd.choice(["de", "com", None]), host))
    return rows


@pytest.mark.parametrize("limit", [None, "-1"])
def test_posterior_is_that_of_a_plain_computation(spark, sf_dir, model, limit):
    """A third of the rows share a host; with and without broadcasts."""
    langs, logs = model
    rows = probes(spark, sf_dir)
    if limit:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        got = langid.identified(spark.createDataFrame(rows, KIND).repartition(5), langs, logs).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = plain_posterior(rows, langs, logs)
    assert len(got) == len(rows)
    for r in got:
        language, confidence = want[r.id]
        assert r.confidence == pytest.approx(confidence, rel=1e-6)
        assert r.language == language or confidence < 0.5 + 1e-9


def test_rows_not_learned_from(spark, sf_dir):
    """Learned from documents of even id, read for the others."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs, logs = langid.learn(docs.where("doc_id % 2 = 0").select("lang", "text", F.col("doc_id").alias("id")))
    none = F.lit(None).cast("string")
    others = docs.where("doc_id % 2 = 1").select("lang", "text", none.alias("markup"), none.alias("suffix"), none.alias("host"))
    got = langid.identified(others, langs, logs).collect()
    assert len(got) > 50 and sum(r.lang == r.language for r in got) >= 0.97 * len(got)


def test_no_rows_no_labels_no_texts(spark):
    kind = "id long, lang string, text string"
    for rows in ([], [(1, None, "some text")], [(1, "en", None)]):
        langs, logs = langid.learn(spark.createDataFrame(rows, kind))
        assert langs == [] and logs.shape == (0, langid.HASHES)
        got = langid.identified(spark.createDataFrame([(7, "some text", "en", "com", "a.b")], KIND), langs, logs).collect()
        assert [(r.id, r.language, r.confidence) for r in got] == [(7, None, 0.0)]
    langs, logs = langid.learn(spark.createDataFrame([(1, "en", "the text"), (2, "de", "der Text")], kind))
    assert langid.identified(spark.createDataFrame([], KIND), langs, logs).collect() == []
    (row,) = langid.identified(spark.createDataFrame([(1, None, None, None, None)], KIND), langs, logs).collect()
    assert row.language in langs and row.confidence == pytest.approx(0.5)


def test_query_on_empty_tables(spark, tmp_path, sf_dir):
    for name in ("documents", "pages"):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        (df.limit(0) if name == "documents" else df.limit(3)).write.parquet(f"{tmp_path}/{name}.parquet")
    got = queries.op9_langid(spark, str(tmp_path)).collect()
    assert len(got) == 3 and all(r.language is None and r.confidence == 0 for r in got)


def test_clashing_columns_are_carried(spark, model):
    langs, logs = model
    clash = ["likely", "guess", "host_log", "markup_log", "_slot", "total__", "odds__", "carried__0", "_key", "n0"]
    rows = spark.range(1).select(
        F.lit("a text of words").alias("text"), F.lit("en").alias("markup"), F.lit(None).cast("string").alias("suffix"),
        F.lit("h.x").alias("host"), *[F.lit(c).alias(c) for c in clash],
    )
    (row,) = langid.identified(rows, langs, logs).collect()
    assert [row[c] for c in clash] == clash and row.language in langs


def test_commonest_languages_only(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    rows = [(i, "abcde"[i % 5] if i < 10 else "ab"[i % 2], f"text {i}") for i in range(30)]
    assert langid.learn(spark.createDataFrame(rows, "id long, lang string, text string"))[0] == ["a", "b"]
