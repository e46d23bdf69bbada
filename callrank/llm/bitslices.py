"""Exact top-k inner products by a bit-sliced index.

A component x of a vector is the whole number ``floor(256 * x)``. The index is a table of blocks. A block keeps each
attribute (component) less the block's least value as bit slices: bitmap j of an attribute holds bit j of all the block's
rows. A query is answered from the bitmaps alone. Its products with the attributes are shifted slices; where the
query's number is negative, the slices' complements are taken. Slices of the same weight are added three to two (carry-save),
weight by weight from the least significant up, until each weight has one slice: the slices of the rows' scores. From the most
significant of them downward the rows in the lead are chosen; the rows left over at the boundary have the same score and
are taken by their place, as a block is ordered by id. The scores are read from the slices, and the best of all blocks are
ordered exactly.

Vectors that are null or hold null or non-finite components take no part. An empty vector takes part; vectors of several
lengths are compared as if the shorter ones ended in zeros. A row is no candidate of itself, but a row with the same id is; rows
that are repeated are one row of the index with its number, and each gets its answer as a query. Ties go to the smaller
id, a null id last. Components may be of any size: beyond 64 bits the numbers are Python's; scores beyond what a long
holds are given as the nearest long, and are ordered by their true values.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callrank.sources.staging import discard, new_folder, stage

#: Rows of a block and queries that are answered together, on average: cost only. Neighbours wanted.
BLOCK_ROWS, PART_QUERIES, K = 8192, 256, 5
SCALE = 256
LONG = (-(1 << 63), (1 << 63) - 1)
#: Order of scores that no long holds: their difference from this, as hexadecimal digits of one length.
FAR, DIGITS = 1 << 2200, 552

INDEX = "block long, rows int, ids binary, named binary, copies binary, low binary, bits binary, slices binary"
FOUND = "part long, no int, query_id long, query_copies long, own boolean, vec_id long, score long, beyond string, copies int"


def whole_numbers(vectors: list, width: int) -> np.ndarray:
    """``floor(256 * x)`` of each component, as 64-bit or Python integers; shorter vectors end in zeros."""
    x = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    if np.abs(x).max(initial=0) < 2.0**50:
        return np.floor(x * SCALE).astype(np.int64)
    exact = [[math.floor(v * SCALE) if abs(v) < 2.0**60 else int(v) * SCALE for v in row] for row in x.tolist()]
    out = np.empty(x.shape, object)
    out[:] = exact
    return out


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers as bytes: eight each, or as text where they are larger."""
    if numbers.dtype != object:
        return b"q" + numbers.tobytes()
    return b"t" + ",".join(map(str, numbers.tolist())).encode()


def _unpacked(data: bytes) -> np.ndarray:
    if data[:1] == b"q":
        return np.frombuffer(data, np.int64, offset=1)
    return np.array([int(n) for n in data[1:].decode().split(",")] if len(data) > 1 else [], object)


def slices_of(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least value and number of bits of each column, and its slices, column by column from the lowest bit, as 64-bit words."""
    rows, width = numbers.shape
    low = numbers.min(axis=0) if rows else np.zeros(width, np.int64)
    above = numbers - low
    bits = np.array([int(v).bit_length() for v in above.max(axis=0)] if rows else [0] * width, np.int64)
    words = -(-rows // 64)
    slices = np.zeros((int(bits.sum()), words), np.uint64)
    first = np.cumsum(bits) - bits
    for j in range(int(bits.max(initial=0))):
        columns = np.flatnonzero(bits > j)
        plane = ((above[:, columns] >> j) & 1).astype(np.uint8)
        packed = np.packbits(plane, axis=0, bitorder="little").T
        slices[first[columns] + j] = np.pad(packed, ((0, 0), (0, words * 8 - packed.shape[1]))).copy().view(np.uint64)
    return low, bits, slices


def _summed(stack: list[np.ndarray], carries: list[np.ndarray]) -> np.ndarray:
    """One slice, the sum's, of slices of one weight; what is carried to the next weight is added to ``carries``."""
    now = stack[0] if len(stack) == 1 else np.concatenate(stack)
    while len(now) > 2:
        third = len(now) // 3
        a, b, c = now[:third], now[third : 2 * third], now[2 * third : 3 * third]
        odd = a ^ b
        carries.append((a & b) | (odd & c))
        now = np.concatenate((odd ^ c, now[3 * third :]))
    if len(now) == 2:
        carries.append(now[:1] & now[1:])
        return now[0] ^ now[1]
    return now[0]


class Block:
    """One block of the index, ready for queries."""

    def __init__(self, rows: int, low: np.ndarray, bits: np.ndarray, slices: np.ndarray):
        self.rows, self.low, self.bits = rows, low, bits
        self.both = np.concatenate((slices, ~slices))  # the slices and their complements
        self.column = np.repeat(np.arange(len(bits)), bits)
        self.weight = np.arange(len(self.column)) - np.repeat(np.cumsum(bits) - bits, bits)
        self.everyone = np.packbits(np.ones(rows, np.uint8), bitorder="little")
        self.everyone = np.pad(self.everyone, (0, slices.shape[1] * 8 - len(self.everyone))).view(np.uint64)

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of all rows' scores from weight 0 up, and what they are less than the scores."""
        factor = np.zeros(len(self.bits), query.dtype)
        shared = min(len(query), len(factor))
        factor[:shared] = query[:shared]
        # x * -f is f * (2^bits - 1 - x) less a constant: the complement
        offset = sum(
            int(f) * (int(low) + (0 if f > 0 else (1 << int(bits)) - 1))
            for f, low, bits in zip(factor, self.low, self.bits, strict=True)
            if f
        )
        size = np.abs(factor)[self.column]
        place = np.arange(len(self.column)) + len(self.column) * (factor < 0)[self.column].astype(np.int64)
        places, weights = [], []
        for i in range(int(np.abs(factor).max(initial=0)).bit_length()):
            chosen = np.flatnonzero((size >> i) & 1)
            places.append(place[chosen])
            weights.append(self.weight[chosen] + i)
        places = np.concatenate(places) if places else np.zeros(0, np.int64)
        weights = np.concatenate(weights) if weights else np.zeros(0, np.int64)
        order = np.argsort(weights, kind="stable")
        places, edges = places[order], np.searchsorted(weights[order], np.arange(int(weights.max(initial=-1)) + 2))
        result, carried, weight = [], [], 0
        while weight < len(edges) - 1 or carried:
            stack, carries = carried, []
            if weight < len(edges) - 1 and edges[weight] < edges[weight + 1]:
                stack = [*carried, self.both[places[edges[weight] : edges[weight + 1]]]]
            result.append(_summed(stack, carries) if stack else np.zeros(self.both.shape[1], np.uint64))
            carried, weight = carries, weight + 1
        return result, offset

    def top(self, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """Row and score of the ``k`` rows with the highest scores, of equal ones those that come first."""
        slices, offset = self.scores(query)
        sure, level = np.zeros_like(self.everyone), self.everyone
        wanted = min(k, self.rows)
        n_sure = 0
        for s in reversed(slices):
            ahead = level & s
            n = n_sure + int(np.bitwise_count(ahead).sum())
            if n > wanted:
                level = ahead
                continue
            sure, n_sure, level = sure | ahead, n, level & ~s
            if n == wanted:
                break
        places = _places(sure)
        if n_sure < wanted:
            places = np.concatenate((places, _places(level)[: wanted - n_sure]))
        found = []
        for row in places.tolist():
            word, bit = divmod(row, 64)
            found.append((row, offset + sum(((int(s[word]) >> bit) & 1) << w for w, s in enumerate(slices))))
        return found


def _places(bitmap: np.ndarray) -> np.ndarray:
    word = np.flatnonzero(bitmap)
    bits = np.unpackbits(bitmap[word].view(np.uint8).reshape(len(word), 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    return word[row] * 64 + bit


def _long(score: int) -> tuple[int, str]:
    """The score as a long, and the order among those that it stands for if it isn't exact."""
    if LONG[0] < score < LONG[1]:
        return score, ""
    return max(LONG[0], min(LONG[1], score)), f"{score + FAR:0{DIGITS}x}"


def classes(df: DataFrame, id_col: str, vector_col: str, query: Column | None = None) -> DataFrame:
    """``vec_id``, ``embedding``, ``copies`` and ``is_query`` of the different rows that take part."""
    vector = F.col(f"`{vector_col}`")
    sound = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("embedding"),
        F.coalesce(F.lit(False) if query is None else query, F.lit(False)).alias("is_query"),
    ).where(F.col("embedding").isNotNull() & sound)
    return rows.groupBy("vec_id", "embedding").agg(F.count("*").alias("copies"), F.max("is_query").alias("is_query"))


def index(rows: DataFrame, blocks: int, most_copies: int = K + 1) -> DataFrame:
    """The bit-sliced index of ``classes``: one row a block, the rows dealt to ``blocks`` blocks by their hash."""

    def build(table: pa.Table) -> pa.Table:
        ids, vectors = table["vec_id"].to_pylist(), table["embedding"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        vectors = [vectors[i] for i in order]
        low, bits, slices = slices_of(whole_numbers(vectors, max(map(len, vectors))))
        copies = np.array(table["copies"].to_pylist(), np.int64)[order]
        return pa.table({
            "block": pa.array(table["block"].to_pylist()[:1], pa.int64()),
            "rows": pa.array([len(ids)], pa.int32()),
            "ids": [np.array([ids[i] or 0 for i in order], np.int64).tobytes()],
            "named": [np.array([ids[i] is not None for i in order], bool).tobytes()],
            "copies": [copies.clip(max=most_copies).astype(np.int32).tobytes()],
            "low": [_packed(low)],
            "bits": [bits.astype(np.int64).tobytes()],
            "slices": [slices.tobytes()],
        })

    dealt = rows.select(F.expr(f"pmod(xxhash64(vec_id, embedding), {blocks}L)").alias("block"), "vec_id", "embedding", "copies")
    return dealt.groupBy("block").applyInArrow(build, INDEX)


def _read(row: dict) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray]:
    """A row of the index: the block, and its rows' ids, whether they have one, and their copies."""
    bits = np.frombuffer(row["bits"], np.int64)
    slices = np.frombuffer(row["slices"], np.uint64).reshape(int(bits.sum()), -(-row["rows"] // 64))
    block = Block(row["rows"], _unpacked(row["low"]), bits, slices)
    return block, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["named"], bool), np.frombuffer(row["copies"], np.int32)


def search(sliced: DataFrame, queries: DataFrame, k: int, blocks: int, parts: int) -> DataFrame:
    """The best ``k`` rows of each block for each query; ``queries`` has ``part``, ``no``, ``vec_id``, ``embedding``, ``copies``."""
    fields = [field.split() for field in FOUND.split(", ")]
    schema = pa.schema([(name, {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}[kind]) for name, kind in fields])

    def answer(side: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        asked = [(q, whole_numbers([q["embedding"]], len(q["embedding"]))[0]) for q in asked.to_pylist()]
        for row in side.to_pylist():
            block, ids, named, copies = _read(row)
            for query, vector in asked:
                itself = sum(int(v) ** 2 for v in vector)
                for place, score in block.top(vector, k):
                    vec_id = int(ids[place]) if named[place] else None
                    given, beyond = _long(score)
                    found.append((
                        query["part"], query["no"], query["vec_id"], query["copies"],
                        vec_id == query["vec_id"] and score == itself, vec_id, given, beyond, int(copies[place]),
                    ))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True) if found else [[]] * len(schema), schema, strict=True)], schema)

    def to_all(df: DataFrame, name: str, many: int) -> DataFrame:
        return df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))))

    # a block meets a part of the queries in one group: so many rows of the index and so many queries, whatever the table
    side = to_all(sliced, "part", parts).groupBy("block", "part")
    return side.cogroup(to_all(queries, "block", blocks).groupBy("block", "part")).applyInArrow(answer, FOUND)


def top(
    df: DataFrame,
    query: Column,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    part_queries: int = PART_QUERIES,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` best rows for each row of ``df`` where ``query`` holds."""
    spark = df.sparkSession
    folder = new_folder(spark)
    rows = stage(classes(df, id_col, vector_col, query), "classes", folder)
    n, asked = rows.agg(F.count("*"), F.count_if("is_query")).first()
    blocks, parts = max(1, -(-n // block_rows)), max(1, -(-asked // part_queries))
    sliced = stage(index(rows, blocks, k + 1), "index", folder)
    numbered = rows.where("is_query").withColumn("part", F.expr(f"pmod(xxhash64(embedding, vec_id), {parts}L)"))
    within = Window.partitionBy("part").orderBy("vec_id", "embedding")
    queries = numbered.select("part", F.row_number().over(within).alias("no"), "vec_id", "embedding", "copies")
    found = search(sliced, queries, k + 1, blocks, parts)
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    by_score = Window.partitionBy("part", "no").orderBy(F.desc("score"), F.desc("beyond"), F.asc_nulls_last("vec_id"))
    best = each.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= k + 1)
    # one of the rows with the query's own id and score is the query itself
    own = best.withColumn("own_place", F.expr("min(IF(own, place, NULL)) OVER (PARTITION BY part, no)"))
    others = own.where("own_place IS NULL OR place <> own_place").selectExpr(
        "query_id", "query_copies", "place - int(coalesce(place > own_place, false)) AS rank", "vec_id", "score"
    )
    answers = others.where(F.col("rank") <= k).withColumn("again", F.expr("explode(sequence(1L, query_copies))"))
    kept = stage(answers.select("query_id", "rank", "vec_id", "score"), "top", folder)
    for name in ("classes", "index"):
        discard(spark, f"{folder}/{name}")
    return kept
