"""SimHash and embedding near-duplicates against all pairs, and components against union-find."""

import random

import numpy as np
import pytest
import xxhash

from callrank.llm import itq, queries, simhash
from callrank.llm.components import components


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def plain_simhash(text):
    words = text.translate({c: c + 32 for c in range(65, 91)}).encode().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_components(spark):
    rnd = random.Random(4)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(300, 360)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots(361, pairs)
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: want[x] for x in touched}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 8)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 16)


def test_fingerprints_against_counting_bits():
    for text in ["", "One", "one TWO", "a b c d a b c d", "É à\x0bz  w", "x " * 9000]:
        assert simhash.simhash(text.encode()) & (2**64 - 1) == plain_simhash(text)


def test_links_against_all_pairs(spark, small_blocks):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(60)] + [0, 2**64 - 1]
    prints = set(base)
    for x in base[:30]:
        for _ in range(rnd.randint(1, 12)):
            for bit in rnd.sample(range(64), rnd.randint(1, 4)):
                x ^= 1 << bit
            prints.add(x)
    prints = sorted(prints)
    rows = [(p - 2**64 if p >= 2**63 else p, i) for i, p in enumerate(prints)]
    found = simhash.links(spark.createDataFrame(rows, "fp long, id long")).collect()
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3]
    assert roots(len(prints), [(r.a, r.b) for r in found]) == roots(len(prints), pairs)


def test_documents(spark, documents):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), None, " ".join(words).upper(), "", " ".join([*words[:200], "zz", *words[200:]]), "quite another text", " \n"]
    rows = {r.doc_id: r for r in simhash.near_duplicates(documents(texts)).collect()}
    prints = [plain_simhash(t or "") for t in texts]
    pairs = [(i, j) for i in range(7) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3]
    want = roots(7, pairs)
    assert [rows[i].component_id for i in range(7)] == want
    kept = {r.doc_id for r in simhash.deduplicated(documents(texts)).collect()}
    assert kept == set(want)


def test_repeated_rows_null_ids_and_extra_columns(spark, documents):
    df = documents(["a b c d", "a b c d", "other words are here"])
    null = df.limit(1).selectExpr("CAST(NULL AS LONG) doc_id", "'unlike all the others in here' text", "lang", "source", "n_chars")
    df = df.unionAll(df).unionAll(null).unionAll(null).selectExpr("*", "7 AS fp", "8 AS component_id", "9 AS fate_n__")
    got = simhash.deduplicated(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == [(False, 0), (False, 2), (True, 0)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_missing_and_repeated_ids_count_by_their_text(spark):
    rnd = random.Random(7)
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(40)) for _ in range(8)]
    near = texts[0].upper()  # the same fingerprint
    rows = [(0, texts[0]), (1, texts[1]), (None, near), (None, texts[2]), (None, texts[2]), (None, texts[3]), (None, texts[4]), (None, None)]
    rows += [(5, texts[5]), (5, texts[6]), (5, texts[5]), (6, texts[6]), (7, texts[1]), (7, texts[7])]
    want = [(0, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[4]), (None, None), (5, texts[5]), (5, texts[6]), (7, texts[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in simhash.deduplicated(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    one = spark.createDataFrame([(3, texts[0]), (None, near)], "doc_id long, text string")
    assert [r.doc_id for r in simhash.deduplicated(one).collect()] == [3]


def test_query_against_all_pairs(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in queries.op4_simhash(spark, sf_dir).collect()}
    ids = sorted(texts)
    prints = [plain_simhash(texts[i]) for i in ids]
    assert [rows[i].fingerprint for i in ids] == [f"{p:016x}" for p in prints]
    pairs = [(i, j) for i in range(len(ids)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3]
    assert [rows[i].component_id for i in ids] == [ids[r] for r in roots(len(ids), pairs)]


def plain_links(x):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.9
    return [(i, j) for i in range(len(x)) for j in range(i) if close[i, j]]


def test_embeddings_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(itq, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((25, 16))
    near = np.repeat(centres, 6, axis=0) + 0.12 * rng.standard_normal((150, 16))
    x = np.vstack([near, near[:5], 3 * near[5:8]]).astype(np.float32)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    odd = [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [None] + [1.0] * 15), (504, [float("inf")] + [0.0] * 15)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 AS n_links")
    got = {r.vec_id: r for r in itq.near_duplicates(df).collect()}
    pairs = plain_links(x.astype(float))
    found = sum(got[i].n_links for i in range(len(x))) / 2
    assert 0.9 * len(pairs) <= found <= len(pairs)
    want = roots(len(x), pairs)
    assert sum(got[i].component_id == want[i] for i in range(len(x))) >= 0.9 * len(x)
    for i in range(500, 505):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert itq.near_duplicates(df.limit(0)).count() == 0


def test_recall_on_vectors_with_a_common_direction(spark):
    rng = np.random.default_rng(8)
    width, offset = 128, np.eye(128)[0] * 2.5
    base = rng.standard_normal((300, width)) / np.sqrt(width)
    # pairs just above the threshold
    x = offset + np.vstack([base, base + 1.1 * rng.standard_normal((300, width)) / np.sqrt(width)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert np.linalg.norm(unit.mean(axis=0)) > 0.75
    pairs = plain_links(x)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    found = sum(r.n_links for r in itq.near_duplicates(df).collect()) / 2
    assert len(pairs) > 100 and 0.95 * len(pairs) <= found <= len(pairs)


def test_embedding_query_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    pairs = plain_links(np.array([r.embedding for r in rows], float))
    got = queries.op5_itq(spark, sf_dir).collect()
    assert len(got) == len(rows)
    assert 0.9 * 2 * len(pairs) <= sum(r.n_links for r in got) <= 2 * len(pairs)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
