"""The bit-sliced index against plain inner products."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from callrank.llm import bitslices, queries, sql


def plain_top(rows, k=5, query=lambda i: i is not None and i % 50 == 0):
    def numbers(v):
        return [math.floor(Fraction(x) * 256) for x in v]

    sound = [(i, numbers(v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(sound):
        if query(i):
            scores = [(sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(sound) if a != b]
            scores.sort(key=lambda s: (-s[0], s[1] is None, s[1]))
            out += [(i, r, j, max(-(2**63), min(2**63 - 1, s))) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def found(spark, rows, kind="double", **limits):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = bitslices.top(df, F.col("vec_id") % 50 == 0, **limits)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize(("block_rows", "part_queries"), [(8192, 256), (7, 2), (64, 1)])
def test_equal_to_plain_products(spark, block_rows, part_queries):
    rng = random.Random(block_rows)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(9)]) for i in range(0, 400, 2)]
    rows += [(i, [rng.choice([-0.5, 0.0, 0.25]) for _ in range(3)]) for i in range(1, 200, 2)]  # shorter, and many ties
    assert found(spark, rows, block_rows=block_rows, part_queries=part_queries) == plain_top(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, -0.5]), (50, []), (100, None), (150, [nan, 1.0]), (200, [None, 1.0]), (250, [inf, 1.0]), (300, [0.0, -0.0]),
        (None, [0.5, 0.5]), (None, [0.5, 0.5]), (1, [0.5, -0.5]), (0, [0.5, -0.5]), (0, [0.25, 0.0]), (2, []), (-50, [1.0, 2.0, 3.0]),
    ]
    for block_rows in (8192, 3):
        assert found(spark, rows, block_rows=block_rows) == plain_top(rows)


def test_copies_of_one_row(spark):
    rows = [(50, [1.0, 0.5])] * 9 + [(7, [1.0, 0.5])] * 8 + [(8, [2.0, 0.0])] * 2 + [(100, [-1.0, 0.0])]
    assert found(spark, rows, block_rows=4, part_queries=1) == plain_top(rows)


def test_components_of_any_size(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.choice([-3, 0, 8, 15, 300]) for _ in range(3)]) for i in range(0, 300, 10)]
    rows += [(i, [2.0**49 * rng.choice([-1, 1]), 0.3]) for i in range(5, 200, 15)]
    assert found(spark, rows, block_rows=16) == plain_top(rows)


def test_few_and_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(50, [1.0])]) == []
    assert found(spark, [(50, [1.0]), (1, [1.0])]) == [(50, 1, 1, 65536)]
    assert found(spark, [(1, [1.0])]) == []
    assert found(spark, [(50, []), (100, [])]) == [(100, 1, 50, 0), (50, 1, 100, 0)]


def test_other_columns_may_have_any_names(spark):
    df = spark.createDataFrame([(50, [1.0], 1), (3, [2.0], 2)], "id long, v array<float>, part int").withColumnRenamed("part", "copies")
    assert [tuple(r) for r in bitslices.top(df, F.col("id") == 50, id_col="id", vector_col="v").collect()] == [(50, 1, 3, 131072)]


def test_scores_from_slices():
    rng = np.random.default_rng(1)
    numbers = rng.integers(-300, 300, (150, 12))
    block = bitslices.Block(150, *bitslices.slices_of(numbers))
    for query in rng.integers(-300, 300, (5, 12)):
        slices, offset = block.scores(query)
        bits = [np.unpackbits(s.view(np.uint8), bitorder="little")[:150].astype(np.int64) for s in slices]
        assert (sum(b << w for w, b in enumerate(bits)) + offset == numbers @ query).all()


def test_query_on_given_vectors(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = queries.op11_bitslice(spark, sf_dir)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_top(rows)
    assert "op11_bitslice" in sql.ALL
