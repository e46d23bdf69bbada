"""Embedding near-duplicates by iterative quantisation (ITQ) and multi-index Hamming tables.

Rotations that make binary codes are learned on a bounded sample: principal axes, then the alternation of codes and
orthogonal Procrustes. Vectors aren't centred: tables and cut follow from the angle at the threshold, and centring would
widen it where vectors share a direction. There codes are less balanced and buckets fuller, which costs time, not pairs. Every vector is indexed: its code is cut into substrings, each the key of a hash table. The
length of a substring follows the number of vectors, so tables' buckets stay small; the number of tables follows from the
chance that a pair at the threshold agrees on a substring and the recall wanted, so found pairs are a known part of all.
Within a bucket pairs are kept by the Hamming distance of whole codes, then reranked by the cosine of the original
vectors in double precision. Vectors that are equal are one class from the start; crowded buckets are cut into a grid of
blocks, so no bucket is capped.

Vectors that are null, zero, or hold null or non-finite components link with nothing and are kept. Vectors of several
lengths are compared as if the shorter ones ended in zeros. Rows with a null id take part, but are counted only as
links; their component is null if no other id is reachable. Repeated rows get the same answer, each on its own row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callrank.llm.components import components
from callrank.sources.staging import new_folder, stage

#: Threshold, recall wanted at the threshold, vectors to fit on at most, rows a bucket holds on average, rows of a block.
COSINE, RECALL, SAMPLE, BUCKET_ROWS, BLOCK_ROWS, ITERATIONS, SEED = 0.9, 0.97, 20_000, 32, 1024, 30, 42
JOINT = 4  # buckets whose numbers differ in that many low bits are worked on together, as a group


def rotations(sample: np.ndarray, bits: int, seed: int = SEED) -> np.ndarray:
    """A projection to at least ``bits`` columns whose signs are the code."""
    _, axes = np.linalg.eigh(sample.T @ sample)
    projected = sample @ axes
    rng, width = np.random.default_rng(seed), sample.shape[1]
    parts = []
    for _ in range(-(-bits // width)):
        turn = np.linalg.qr(rng.standard_normal((width, width)))[0]
        for _ in range(ITERATIONS):
            code = np.sign(projected @ turn)
            u, _, v = np.linalg.svd(projected.T @ code)
            turn = u @ v
        parts.append(axes @ turn)
    return np.hstack(parts)


def plan(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a substring and number of tables for ``n`` vectors."""
    length = min(24, max(8, math.ceil(math.log2(max(2, n / BUCKET_ROWS)))))
    agree = (1 - math.acos(cosine) / math.pi) ** length
    return length, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def most_bits_apart(bits: int, cosine: float = COSINE) -> int:
    """Bits in which a pair at the threshold differs at most, but for one such pair in ten thousand."""
    p = math.acos(cosine) / math.pi
    return math.ceil(bits * p + 3.8 * math.sqrt(bits * p * (1 - p)))


def _matrix(column, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first, so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def candidates(classes: DataFrame, width: int, cosine: float = COSINE) -> DataFrame:
    """Pairs (``a`` < ``b``) of classes whose codes are near; ``classes`` has ``id`` and ``embedding``."""
    spark = classes.sparkSession
    n = classes.count()
    length, tables = plan(n, cosine)
    rows = classes.orderBy(F.xxhash64("embedding"), "id").limit(SAMPLE).select("embedding").collect()  # bounded
    if not rows:
        return spark.createDataFrame([], "a long, b long")
    turn = rotations(_unit(_matrix([r.embedding for r in rows], width)), length * tables)
    model = spark.sparkContext.broadcast(turn[:, : max(length * tables, min(64, turn.shape[1]))])
    whole = model.value.shape[1]
    limit = most_bits_apart(whole, cosine)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = (_unit(_matrix(batch.embedding, width)) @ model.value) > 0
            packed = [row.tobytes() for row in np.packbits(bits, axis=1)]
            yield pd.DataFrame({"id": batch.id, "code": packed})

    codes = stage(classes.select("id", "embedding").mapInPandas(code, "id long, code binary"), "codes", new_folder(spark))

    def keys(batch: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        bits = np.unpackbits(np.frombuffer(b"".join(batch.code), np.uint8).reshape(len(batch), -1), axis=1)
        powers = 1 << np.arange(length, dtype=np.int64)
        for t in range(tables):
            yield t, bits[:, t * length : (t + 1) * length].astype(np.int64) @ powers

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t, key in keys(batch):
                value, number = np.unique(key >> JOINT, return_counts=True)
                yield pd.DataFrame({"t": t, "g": value, "n": number})

    sizes = codes.mapInPandas(count, "t int, g long, n long").groupBy("t", "g").agg(F.sum("n").alias("n"))
    # crowded groups: fewer than tables * n / BLOCK_ROWS, a table joined by group
    crowded = sizes.where(F.col("n") > BLOCK_ROWS).selectExpr("t", "g", f"int(ceil(n / {BLOCK_ROWS})) AS blocks")

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t, key in keys(batch):
                yield pd.DataFrame({"t": t, "g": key >> JOINT, "key": key, "id": batch.id, "code": batch.code})

    dealt = codes.mapInPandas(deal, "t int, g long, key long, id long, code binary")
    blocks = "coalesce(blocks, 1)"
    own = f"int(pmod(xxhash64(id), {blocks}))"
    # block i meets block j >= i: a row goes to the grid cells of its own row and column
    cells = dealt.join(crowded, ["t", "g"], "left").selectExpr(
        "t", "g", "key", "id", "code", f"{own} AS own", f"explode(sequence(0, {blocks} - 1)) AS other"
    )
    cells = cells.selectExpr("t", "g", "key", "least(own, other) AS i", "greatest(own, other) AS j", "own", "id", "code")

    def match(cell: pd.DataFrame) -> pd.DataFrame:
        if len(cell) < 2:
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        cell = cell.sort_values("id")
        keys = cell.key.to_numpy()
        ids, side = cell.id.to_numpy(), (cell.own == cell.i).to_numpy()
        code = np.frombuffer(b"".join(cell.code), np.uint8).reshape(len(cell), -1)
        code = np.pad(code, ((0, 0), (0, -code.shape[1] % 8))).view(np.uint64)
        left, right = (np.arange(len(cell)),) * 2 if cell.i.iat[0] == cell.j.iat[0] else (np.flatnonzero(side), np.flatnonzero(~side))
        found = []
        for at in range(0, len(left), 256):
            some = left[at : at + 256]
            apart = np.zeros((len(some), len(right)), np.uint16)
            for word in range(code.shape[1]):
                apart += np.bitwise_count(code[some, word][:, None] ^ code[right, word][None, :])
            x, y = np.nonzero((apart <= limit) & (keys[some][:, None] == keys[right][None, :]))
            x, y = ids[some[x]], ids[right[y]]
            found.append((np.minimum(x, y), np.maximum(x, y)))
        a, b = (np.concatenate(v) for v in zip(*found, strict=True)) if found else (ids[:0], ids[:0])
        pairs = pd.DataFrame({"a": a, "b": b})
        return pairs[pairs.a < pairs.b].drop_duplicates()

    return cells.groupBy("t", "g", "i", "j").applyInPandas(match, "a long, b long").distinct()


def cosines(left: pa.Array, right: pa.Array) -> pa.Array:
    a, b = left.to_pylist(), right.to_pylist()
    width = max((len(v) for v in a + b), default=0)
    x, y = _unit(_matrix(a, width)), _unit(_matrix(b, width))
    return pa.array(np.einsum("ij,ij->i", x, y), pa.float64())


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row."""
    folder = new_folder(df.sparkSession)
    vector = F.col(vector_col)
    sound = F.coalesce(
        ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0),
        F.lit(False),
    )
    # a class is the equal vectors, by 128 bits of two hashes
    rows = df.select(
        F.col(id_col).cast("long").alias("vec_id"), sound.alias("sound"), vector.cast("array<double>").alias("embedding")
    ).withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), F.reverse("embedding"))})
    classes = rows.where("sound").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding")
    )
    # a class without an id takes part under a number below every id
    number = "coalesce(least, -9223372036854775807L + monotonically_increasing_id())"
    classes = stage(classes.withColumn("id", F.expr(number)), "classes", folder)
    width = classes.agg(F.max(F.size("embedding"))).first()[0] or 0
    near = candidates(classes.select("id", "embedding"), width, cosine)
    vectors = classes.select("id", "embedding")
    pairs = near.join(vectors.toDF("a", "va"), "a").join(vectors.toDF("b", "vb"), "b")
    links = pairs.where(F.arrow_udf(cosines, "double")("va", "vb") >= cosine).select("a", "b")
    links = stage(links, "links", folder)
    both = links.unionAll(links.selectExpr("b AS a", "a AS b"))
    linked = both.join(classes.selectExpr("id AS b", "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    found = components(links)
    named = (
        classes.join(linked, classes.id == linked.a, "left").join(found, classes.id == found.node, "left")
        .selectExpr("h1", "h2", "least", "copies - 1 + coalesce(others, 0) AS n_links", "coalesce(component, id) AS component")
    )
    if classes.where("least IS NULL").limit(1).count():
        real = named.groupBy("component").agg(F.min("least").alias("component_id"))
        named = named.join(real, "component")
    else:
        named = named.withColumnRenamed("component", "component_id")
    narrow = rows.select("vec_id", "sound", "h1", "h2")
    joined = narrow.join(named.select("h1", "h2", "n_links", "component_id"), ["h1", "h2"], "left")
    return joined.select(
        "vec_id",
        F.expr("IF(sound, n_links, 0L)").alias("n_links"),
        F.expr("IF(sound, component_id, vec_id)").alias("component_id"),
        F.expr("vec_id <=> IF(sound, component_id, vec_id)").alias("kept"),
    )
