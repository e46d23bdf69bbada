"""Periodic runs against a plain search of all periods."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from callrank.llm import periodic, queries


def plain_runs(words, exponent=4, shortest=6):
    """Every maximal stretch of each period; of equal stretches the least period."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        start = 0
        while start + q < len(words):
            if words[start] != words[start + q]:
                start += 1
                continue
            stop = start
            while stop + q < len(words) and words[stop] == words[stop + q]:
                stop += 1
            if stop + q - start >= max(shortest, exponent * q):
                found.setdefault((start, stop + q - start), q)
            start = stop + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def numbered_runs(texts, **limits):
    counts = np.array([len(t) for t in texts], np.int64)
    words = np.array([w for t in texts for w in t], np.int64)
    got = [[] for _ in texts]
    for text, *run in zip(*(a.tolist() for a in periodic.runs(words, counts, **limits)), strict=True):
        got[text].append(tuple(run))
    return got


def random_texts(seed, many=300):
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(many):
        kind, n = rng.integers(5), int(rng.integers(0, 130))
        if kind == 0:  # few different words
            text = rng.integers(0, 2, n)
        elif kind == 1:
            text = np.resize(rng.integers(0, 3, max(1, int(rng.integers(1, 30)))), n)
        elif kind == 2:  # runs in runs
            inner = np.resize(rng.integers(0, 4, int(rng.integers(1, 4))), int(rng.integers(1, 20)))
            text = np.resize(np.append(inner, rng.integers(0, 9, 2)), n)
        elif kind == 3:
            text = np.concatenate([np.resize(rng.integers(0, 50, int(rng.integers(1, 9))), int(rng.integers(1, 40))) for _ in range(4)])
        else:
            text = rng.integers(0, 1000, n)
        texts.append(text.tolist())
    return texts


@pytest.mark.parametrize("seed", range(8))
def test_runs_are_those_of_a_plain_search(seed):
    texts = random_texts(seed)
    assert numbered_runs(texts) == [plain_runs(t) for t in texts]


@pytest.mark.parametrize(("exponent", "shortest"), [(2, 2), (2, 6), (3, 4), (5, 12)])
def test_other_limits(exponent, shortest):
    texts = random_texts(99, 150)
    assert numbered_runs(texts, exponent=exponent, shortest=shortest) == [plain_runs(t, exponent, shortest) for t in texts]


def test_false_matches_of_hashes_change_nothing(monkeypatch):
    monkeypatch.setattr(periodic, "_mixed", lambda x, y: (x ^ y) & np.uint64(1))
    texts = random_texts(5, 100)
    assert numbered_runs(texts) == [plain_runs(t) for t in texts]


def test_a_long_text_of_one_word_is_quick():
    assert numbered_runs([[7] * 400_000]) == [[(0, 400_000, 1)]]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    words = re.findall(periodic.WORDS, text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return {
        "doc_id": doc_id,
        "n_runs": len(found),
        "start": best[0],
        "length": best[1],
        "period": best[2],
        "exponent_milli": best[1] and 1000 * best[1] // best[2],
        "runs_sha256": digest("".join(f"{s},{length},{q}\n" for s, length, q in found)),
        "collapsed_sha256": digest(" ".join(w for i, w in enumerate(words) if i not in gone)),
    }


def order(row):
    return str(row)


ODD = [
    None, "", " \t\n ", "a", "a a a a a a", " a  a\ta\na\x0ba\x0ca\ra ", "a b a b a b a b", "x\xa0y x\xa0y x\xa0y x\xa0y x\xa0y x\xa0y",
    "a\x1ca a\x1ca a\x1ca a\x1ca a\x1ca a\x1ca", "A a A a A a", "ß ß ß ß ß ß 😀 😀 😀 😀 😀 😀", "a\x85a " * 7, "a b c " * 9 + "a b",
]


def test_query_against_plain_search(spark, tmp_path):
    texts = ODD + ["the end " * k + "of it all" for k in range(1, 30)] + [" ".join(map(str, range(k))) for k in range(60)]
    rows = [(i, t) for i, t in enumerate(texts * 2)] + [(None, ODD[4]), (None, ODD[4]), (3, "a a a a a a a"), (-5, "b " * 50)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.asDict() for r in queries.op13_periodic(spark, str(tmp_path)).collect()]
    assert sorted(got, key=order) == sorted((expected(*r) for r in rows), key=order)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and t for i, t in rows if i is not None)


def test_query_on_given_documents(spark, sf_dir):
    got = [r.asDict() for r in queries.op13_periodic(spark, sf_dir).collect()]
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(got, key=order) == sorted((expected(*r) for r in rows), key=order)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, runs string, N_Words int")
    assert periodic.with_runs(df).columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    assert periodic.with_runs(df).count() == 0
    one = spark.createDataFrame([("x", "a a a a a a a", 3)], "periodic__ string, text string, runs int")
    row = periodic.with_runs(one).first()
    assert (row.periodic__, row.n_words, row.collapsed) == ("x", 7, "a")
    assert [tuple(r) for r in row.runs] == [(0, 7, 1)]


def test_tail_of_a_text(spark):
    got = spark.range(3, 40).select("id", periodic.with_tail(F.lit("a b  c d\ne f g h i j k"), F.col("id")).alias("t"))
    for g, t in got.collect():
        words = list("abcdefghijk")
        a = g % 11
        p = 1 + (11 - a) // (3 + g % 8)
        assert t == " ".join(words[i if i < a else a + (i - a) % p] for i in range(11))
