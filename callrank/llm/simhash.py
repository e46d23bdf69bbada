"""SimHash near-duplicates by vantage-point trees.

Fingerprints: 64 bits, each the majority of that bit over the XXH64 values (seed 42) of the text's three-word shingles.
Two fingerprints link if they differ in at most three bits.

Search: of two fingerprints that differ in three bits at most, the upper or the lower halves differ in one bit at most.
For either half a vantage-point tree is fitted on a bounded sample. A node holds a vantage point and a radius; Hamming
distance is a metric, so by the triangle inequality a search of radius one enters only the sides that the distance to
the vantage point, give or take one, can reach. Every fingerprint has one home shard in each tree, and is sent as a
query to its home and to the shards across the boundaries it is near. Within a shard all queries meet all homes in
blocks, on whole fingerprints, so the links are exact. Equal fingerprints are one node, so copies cost nothing; a shard
crowded by near copies is cut into a grid of blocks. A block returns links that span its components, never all pairs.

Null texts count as empty; empty texts have fingerprint zero and link like any others. Rows with a null id get a
component of null only if no other id is reachable. Repeated rows get the same answer, each on its own row.
:func:`deduplicated` decides by row, so neither a missing nor a repeated id costs a text that has no near-duplicate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callrank.llm.common import strings, unused
from callrank.llm.components import components
from callrank.sources.staging import new_folder, stage

SHINGLE, SEED, LINK_BITS = 3, 42, 3
#: Fingerprints a shard holds on average, fingerprints the trees are fitted on at most, rows of a block.
SHARD_ROWS, SAMPLE, MOST_DEPTH, BLOCK_ROWS = 2048, 65_536, 14, 1024
_CHUNK = 4096  # shingles whose bits are counted at a time


def simhash(text: bytes) -> int:
    """The fingerprint as a signed 64-bit number. A-Z are lowered; words end at ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    last = max(1, len(words) - SHINGLE + 1)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(last)]
    ones = np.zeros(64, np.int64)
    for a in range(0, last, _CHUNK):
        part = np.array(hashes[a : a + _CHUNK], ">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > last).tobytes(), "big", signed=True)


def fingerprint(text: Column) -> Column:
    """The fingerprint (long) of a text column."""

    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array([simhash(t) for t in strings(texts)], pa.int64())

    return F.arrow_udf(hashed, "long")(F.coalesce(text, F.lit("")).cast("binary"))


class VantageTree:
    """A vantage-point tree over 32-bit values with Hamming distance, as arrays in heap order."""

    def __init__(self, values: np.ndarray, depth: int, seed: int = SEED):
        rng, nodes = np.random.default_rng(seed), 2**depth - 1
        self.depth, self.point, self.radius = depth, np.zeros(nodes, np.uint32), np.zeros(nodes, np.int16)
        members = {0: values}
        for node in range(nodes):
            here = members.pop(node, values[:0])
            if len(here):
                # of a few candidates, the one whose best radius leaves the fewest values near the boundary
                best = None
                for point in here[rng.integers(len(here), size=min(6, len(here)))]:
                    distance = np.bitwise_count(here ^ point).astype(np.int16)
                    radius = int(np.median(distance)) - 1
                    low = np.count_nonzero(distance <= radius)
                    if abs(2 * (low + np.count_nonzero(distance == radius + 1)) - len(here)) < abs(2 * low - len(here)):
                        radius += 1
                        low = np.count_nonzero(distance <= radius)
                    near = np.count_nonzero((distance == radius) | (distance == radius + 1))
                    cost = near + abs(2 * low - len(here))
                    if best is None or cost < best[0]:
                        best = (cost, point, radius, distance <= radius)
                _, self.point[node], self.radius[node], inner = best
                members[2 * node + 1], members[2 * node + 2] = here[inner], here[~inner]

    def route(self, values: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, shard and "is its home" for every shard that a search of radius ``reach`` around a value must enter."""
        row, node, home = np.arange(len(values)), np.zeros(len(values), np.int64), np.ones(len(values), bool)
        for _ in range(self.depth):
            distance = np.bitwise_count(values[row] ^ self.point[node]).astype(np.int16)
            inner = distance <= self.radius[node]
            left, right = distance - reach <= self.radius[node], distance + reach > self.radius[node]
            row, node, home = (
                np.concatenate([row[left], row[right]]),
                np.concatenate([2 * node[left] + 1, 2 * node[right] + 2]),
                np.concatenate([(home & inner)[left], (home & ~inner)[right]]),
            )
        return row, node - (2**self.depth - 1), home


def _halves(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    prints = prints.view(np.uint64)
    return (prints >> np.uint64(32)).astype(np.uint32), (prints & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _routes(trees: list[VantageTree], fp: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for k, (tree, values) in enumerate(zip(trees, _halves(fp), strict=True)):
        yield k, *tree.route(values, LINK_BITS // 2)


def spanning_links(home_fp, home_id, query_fp, query_id, bits: int = LINK_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids that span the components which links between queries and homes make."""
    fps, back = np.unique(np.concatenate([home_fp, query_fp]), return_inverse=True)
    ids = np.zeros(len(fps), np.int64)
    ids[back] = np.concatenate([home_id, query_id])
    homes, queries = np.unique(back[: len(home_fp)]), np.unique(back[len(home_fp) :])
    parent = np.arange(len(fps))
    values = fps.view(np.uint64)
    for a in range(0, len(queries), 256):
        some = queries[a : a + 256]
        i, j = np.nonzero(np.bitwise_count(values[some][:, None] ^ values[homes][None, :]) <= bits)
        i, j = some[i], homes[j]
        while True:
            x, y = parent[i], parent[j]
            apart = x != y
            if not apart.any():
                break
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := parent[parent], parent):
                parent = up
    linked = np.flatnonzero(parent != np.arange(len(fps)))
    return ids[linked], ids[parent[linked]]


def links(prints: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) between the ids of ``prints`` (``fp``, ``id``: long, fingerprints distinct).

    They span the graph of all links: no two fingerprints that link are left apart.
    """
    spark = prints.sparkSession
    n = prints.count()
    depth = min(MOST_DEPTH, max(0, math.ceil(math.log2(max(1, n / SHARD_ROWS)))))
    rows = prints.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE if depth else 0).collect()  # bounded
    sample = np.array([r.fp for r in rows], np.int64)
    trees = spark.sparkContext.broadcast([VantageTree(v, depth) for v in _halves(sample)])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, _, shard, home in _routes(trees.value, batch.fp.to_numpy()):
                found = pd.DataFrame({"shard": shard, "homes": home.astype(np.int64), "queries": 1})
                yield found.groupby("shard", as_index=False).sum().assign(tree=k)[["tree", "shard", "homes", "queries"]]

    sizes = prints.select("fp").mapInPandas(count, "tree int, shard long, homes long, queries long")
    sizes = sizes.groupBy("tree", "shard").agg(F.sum("homes").alias("homes"), F.sum("queries").alias("queries"))
    crowded = sizes.where((F.col("homes") > BLOCK_ROWS) | (F.col("queries") > BLOCK_ROWS)).collect()  # 2 ** 15 rows at most
    grid = {(r.tree, r.shard): (-(-r.homes // BLOCK_ROWS), -(-r.queries // BLOCK_ROWS)) for r in crowded}
    spread = spark.sparkContext.broadcast(grid)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp, ids = batch.fp.to_numpy(), batch.id.to_numpy()
            salt = (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for k, row, shard, home in _routes(trees.value, fp):
                cuts = np.ones((2**trees.value[k].depth, 2), np.int64)
                for (tree, s), cut in spread.value.items():
                    if tree == k:
                        cuts[s] = np.maximum(cut, 1)
                for is_home in (True, False):
                    r, s = (row[home], shard[home]) if is_home else (row, shard)
                    own, other = cuts[s, 0 if is_home else 1], cuts[s, 1 if is_home else 0]
                    mine = (salt[r] % own.astype(np.uint64)).astype(np.int64)
                    times = np.repeat(np.arange(len(r)), other)  # to each block of the other side
                    theirs = np.arange(len(times)) - np.repeat(np.cumsum(other) - other, other)
                    mine, r, s = mine[times], r[times], s[times]
                    h, q = (mine, theirs) if is_home else (theirs, mine)
                    yield pd.DataFrame({"tree": k, "shard": s, "h": h, "q": q, "home": is_home, "fp": fp[r], "id": ids[r]})

    def match(block: pd.DataFrame) -> pd.DataFrame:
        home, query = block[block.home], block[~block.home]
        a, b = spanning_links(home.fp.to_numpy(), home.id.to_numpy(), query.fp.to_numpy(), query.id.to_numpy())
        return pd.DataFrame({"a": a, "b": b})

    dealt = prints.select("fp", "id").mapInPandas(
        deal, "tree int, shard long, h long, q long, home boolean, fp long, id long"
    )
    return dealt.groupBy("tree", "shard", "h", "q").applyInPandas(match, "a long, b long").distinct()


def _grouped(df: DataFrame, id_col: str, text_col: str, by_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows (``doc_id``, ``fp``) and, for each ``fp``, its ``component`` (a number) and the smallest ``id``.

    ``by_text``: rows have the text's ``hash`` as well, and fingerprints that share an id aren't linked by it.
    """
    folder = new_folder(df.sparkSession)
    of_text = [F.xxhash64(F.col(text_col)).alias("hash")] if by_text else []
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(F.col(text_col)).alias("fp"), *of_text)
    rows = stage(rows, "fingerprints", folder)
    # a fingerprint that only rows without an id have takes part under a number of its own, below every id
    number = "fp" if by_text else "coalesce(id, -9223372036854775807L + monotonically_increasing_id())"
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("id")).withColumn("node", F.expr(number))
    first = stage(first, "distinct", folder)  # written, so the numbers stay
    found = components(links(first.selectExpr("fp", "node AS id")))
    of_print = first.join(found, "node", "left")
    return rows, of_print.select("fp", "id", F.coalesce("component", "node").alias("component"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (long) and ``component_id`` (smallest id reachable, itself included) of every row."""
    rows, of_print = _grouped(df, id_col, text_col)
    if rows.where("doc_id IS NULL").limit(1).count():
        # the smallest real id of the component
        named = of_print.groupBy("component").agg(F.min("id").alias("least"))
        of_print = of_print.join(named, "component")
    else:
        of_print = of_print.withColumn("least", F.col("component"))
    return rows.join(of_print.selectExpr("fp", "least AS component_id"), "fp")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group of near-duplicates; columns as they are.

    The row that stays is the first by id (missing ones last), fingerprint and hash of the text; of exact copies of it
    one stays. So rows without an id, and texts that share an id, each count by their own text. What joins the texts is
    the narrow list of ids that are dropped or repeated, which Spark broadcasts while it is small. Only rows of repeated
    ids, and without an id, are told apart by fingerprint and text.
    """
    rows, of_print = _grouped(df, id_col, text_col, by_text=True)
    folder = new_folder(df.sparkSession)
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fp", "hash")
    least = rows.groupBy("fp").agg(F.min(order).alias("least")).join(of_print, "fp")
    kept = stage(least.groupBy("component").agg(F.min("least").alias("least")).select("least.*"), "kept", folder)
    both = rows.selectExpr("doc_id", "1L AS n", "0L AS k").unionAll(kept.selectExpr("doc_id", "0L AS n", "1L AS k"))
    fate = both.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    # dropped, or repeated; the others have one row, which stays
    fate = stage(fate.where("k = 0 OR n > 1").selectExpr("doc_id", "k > 0 AS some"), "fate", folder)
    mark, some, fp, text = (unused(df, f"fate_{c}__") for c in ("id", "some", "fp", "hash"))
    as_long = df[id_col].cast("long")
    known = df.where(as_long.isNotNull()).join(fate.select(F.col("doc_id").alias(mark), F.col("some").alias(some)), as_long == F.col(mark), "left")
    single = known.where(F.col(some).isNull()).select(*df.columns)
    unsure = []
    if fate.where("some").limit(1).count():
        unsure.append(known.where(F.col(some)).select(*df.columns, mark))
    if kept.where("doc_id IS NULL").limit(1).count():
        unsure.append(df.where(as_long.isNull()).select("*", F.lit(None).cast("long").alias(mark)))
    for part in unsure:
        part = part.withColumns({fp: fingerprint(F.col(text_col)), text: F.xxhash64(F.col(text_col))}).dropDuplicates([mark, fp, text])
        chosen = kept.select(F.col("doc_id").alias("k_id"), F.col("fp").alias("k_fp"), F.col("hash").alias("k_hash"))
        same = part[mark].eqNullSafe(chosen.k_id) & (part[fp] == chosen.k_fp) & (part[text] == chosen.k_hash)
        single = single.unionByName(part.join(chosen, same, "left_semi").select(*df.columns))
    return single
