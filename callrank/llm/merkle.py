"""A Merkle manifest of a dataset, and proofs of its rows by Octopus multiproofs.

Every row is a leaf. The leaves of a group (a source) are put in order by key; runs of 16 neighbours become their hash,
level by level, until one node is left, the group's subroot. The subroots, in order of the groups, become the root in the same way.

Leaves are numbered by a range sort on (group, key, leaf, copy), so neither a large group nor a row repeated
without end is one task's. They are dealt to parts of whole subtrees: 16^3 neighbouring leaves of a large group, or the
small groups that begin within as many leaves. A part first says which nodes it can't derive from its own
leaves: the least set of coordinates that completes the paths of all of them to the root. These are looked up once for the part,
the nodes that its paths share are derived once, and each leaf's own proof is put together from them.
A part thus fetches 15 nodes a level at most for a large group, and those beside its run of subroots for the small ones.

A hash is the SHA-256 of its inputs' hexadecimal text, run together. Null groups are a group, the first; null keys come
first in their group. Rows with the same key are ordered by their leaves, equal rows are leaves of their own with equal
proofs' contents but for their places. A group of one row has its leaf as subroot; a table of one row has it as root and an empty proof.
No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callrank.sources.staging import discard, new_folder, stage

#: Children of a node; levels of a part's own subtree.
FANOUT, PART_LEVELS = 16, 3
PART = FANOUT**PART_LEVELS
#: The number of the tree over the subroots.
TOP = -1
ROW_BITS = 33  # monotonically_increasing_id() holds the partition above this bit and the row within it below

NODES = "part_a long, part_b long, tree long, level int, idx long, digest string"
PROOFS = "leaf string, subroot string, proof_sha256 string, folded_root string"


def leaf(*values: Column) -> Column:
    """Hash of a row's values: of each its UTF-8 length and text, or a dash for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def hashed(digests: Iterable[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def numbered(df: DataFrame, order: list[Column], name: str, folder: str, column: str = "place") -> DataFrame:
    """``df`` written in order with each row's place from 0, by a range sort and the sizes of its partitions.

    The table of sizes has one row a partition, which bounds the window and the broadcast.
    """
    written = stage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), name, folder)
    parted = written.withColumn("_part", F.shiftright("_at", ROW_BITS))
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_size"))
    before = "sum(_size) OVER (ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    offsets = sizes.selectExpr("_part", f"coalesce({before}, 0L) AS _before")
    return parted.join(F.broadcast(offsets), "_part").selectExpr(
        *[f"`{c}`" for c in df.columns], f"_before + (_at & {(1 << ROW_BITS) - 1}L) AS {column}"
    )


def missing(known: set[int], size: int) -> list[tuple[int, int]]:
    """Level and place of the nodes that the paths of ``known`` leaves need beside them, in a tree of ``size`` leaves."""
    wanted, level = [], 0
    while size > 1:
        parents = {i // FANOUT for i in known}
        wanted += [
            (level, i) for p in sorted(parents) for i in range(p * FANOUT, min((p + 1) * FANOUT, size)) if i not in known
        ]
        known, size, level = parents, -(-size // FANOUT), level + 1
    return wanted


class Paths:
    """What a part knows of one tree of ``size`` leaves: nodes given, and those derived from them."""

    def __init__(self, size: int, nodes: dict[tuple[int, int], str], leaves: set[int]):
        self.runs: list[dict[int, str]] = []  # by level and parent: the digests of the parent's children, run together
        while size > 1:
            level, parents = len(self.runs), {i // FANOUT for i in leaves}
            runs = {p: "".join(nodes[level, i] for i in range(p * FANOUT, min((p + 1) * FANOUT, size))) for p in parents}
            for p, run in runs.items():
                nodes[level + 1, p] = hashlib.sha256(run.encode()).hexdigest()
            self.runs.append(runs)
            leaves, size = parents, -(-size // FANOUT)
        self.root = nodes[len(self.runs), 0]
        self.shared: list[dict[int, str]] = [{} for _ in range(len(self.runs) + 1)]

    def proof(self, i: int, level: int = 0) -> str:
        """The siblings from a node up to the root; what lies above a run is put together once."""
        if level == len(self.runs):
            return ""
        at, parent = i % FANOUT * 64, i // FANOUT
        above = self.shared[level + 1].get(parent)
        if above is None:
            above = self.shared[level + 1][parent] = self.proof(parent, level + 1)
        run = self.runs[level][parent]
        return run[:at] + run[at + 64 :] + above

    def fold(self, i: int, digest: str) -> str:
        """The root that follows from a leaf's digest and its proof."""
        for runs in self.runs:
            at, i = i % FANOUT * 64, i // FANOUT
            digest = hashlib.sha256(f"{runs[i][:at]}{digest}{runs[i][at + 64 :]}".encode()).hexdigest()
        return digest


def _by_tree(table: pa.Table) -> tuple[dict[int, list[dict]], pa.Table]:
    """The rows of a part by their group's number, in order, and the table in that order."""
    table = table.sort_by([("group_no", "ascending"), ("idx", "ascending")])
    trees: dict[int, list[dict]] = {}
    for row in table.select(["group_no", "idx", "size", "leaf", "now"]).to_pylist():
        row["leaf"], row["now"] = row["leaf"].hex(), (row["now"] or row["leaf"]).hex()
        trees.setdefault(row["group_no"], []).append(row)
    return trees, table


def _explored(groups: int) -> Callable[[pa.Table], pa.Table]:
    """Of a part: its highest own nodes, with digests, and the coordinates it lacks, without."""

    def explore(table: pa.Table) -> pa.Table:
        trees, rows = _by_tree(table)[0], []
        for tree, leaves in trees.items():
            size, first = leaves[0]["size"], leaves[0]["idx"]
            nodes, level = [r["leaf"] for r in leaves], 0
            while level < PART_LEVELS and (size > PART or len(nodes) > 1):
                nodes = [hashed(nodes[i : i + FANOUT]) for i in range(0, len(nodes), FANOUT)]
                level += 1
            rows.append((TOP, 0, tree, nodes[0]) if size <= PART else (tree, level, first // PART, nodes[0]))
            rows += [(tree, lv, i, None) for lv, i in missing({r["idx"] for r in leaves}, size)]
        rows += [(TOP, lv, i, None) for lv, i in missing(set(trees), groups)]
        part = [table["part_a"][0].as_py()] * len(rows), [table["part_b"][0].as_py()] * len(rows)
        tree, level, idx, digest = zip(*rows, strict=True)
        return pa.table({
            "part_a": part[0], "part_b": part[1], "tree": tree, "level": pa.array(level, pa.int32()), "idx": idx,
            "digest": pa.array(digest, pa.string()),
        })

    return explore


def _expanded(groups: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a part and the nodes fetched for it: each leaf's proof and the root that follows from it."""

    def expand(table: pa.Table, fetched: pa.Table) -> pa.Table:
        given: dict[int, dict[tuple[int, int], str]] = {}
        for row in fetched.to_pylist():
            given.setdefault(row["tree"], {})[row["level"], row["idx"]] = row["digest"]
        (trees, table), paths = _by_tree(table), {}
        for tree, leaves in trees.items():
            nodes = given.get(tree, {}) | {(0, r["idx"]): r["leaf"] for r in leaves}
            paths[tree] = Paths(leaves[0]["size"], nodes, {r["idx"] for r in leaves})
        top = Paths(groups, given.get(TOP, {}) | {(0, tree): p.root for tree, p in paths.items()}, set(trees))
        columns: list[list] = [[] for _ in range(4)]
        for tree, leaves in trees.items():
            above = top.proof(tree)
            for row in leaves:
                proof = paths[tree].proof(row["idx"]) + above
                folded = top.fold(tree, paths[tree].fold(row["idx"], row["now"]))
                values = row["leaf"], paths[tree].root, hashlib.sha256(proof.encode()).hexdigest(), folded
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
        names = [field.split()[0] for field in PROOFS.split(", ")]
        return pa.table({"g": table["g"], "k": table["k"]} | dict(zip(names, columns, strict=True)))

    return expand


def _climbed(nodes: DataFrame, size: int, level: int, name: str, folder: str) -> list[DataFrame]:
    """The levels above ``nodes`` (``tree``, ``idx``, ``digest``, ``size``: the nodes of that tree on this level), each a written table.

    ``size`` is the greatest of the sizes; a tree of one node is done and climbs no further.
    """
    levels = [nodes.withColumn("level", F.lit(level))]
    while size > 1:
        level, size = level + 1, -(-size // FANOUT)
        above = (
            levels[-1].where("size > 1")
            .groupBy("tree", F.expr(f"idx div {FANOUT}L").alias("idx"), F.expr(f"(size + {FANOUT - 1}L) div {FANOUT}L").alias("size"))
            .agg(F.expr("sha2(array_join(transform(array_sort(collect_list(struct(idx, digest))), x -> x.digest), ''), 256) AS digest"))
        )
        above = above.select("tree", "idx", "digest", "size")
        levels.append(stage(above, f"{name}{level}", folder).withColumn("level", F.lit(level)))
    return levels


def proven(leaves: DataFrame, group: str = "group", key: str = "key") -> DataFrame:
    """The manifest's proofs, one row a leaf.

    ``leaves`` has ``group``, ``key``, ``leaf`` and ``now``, the leaf as it is held against the manifest (null: unchanged). The
    result has ``group``, ``key``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` (from ``now`` and the
    manifest's siblings) and ``verified``.
    """
    spark: SparkSession = leaves.sparkSession
    folder = new_folder(spark)
    digests = [F.unhex(c).alias(c) for c in ("leaf", "now")]  # half as long as their text
    rows = leaves.select(F.col(f"`{group}`").alias("g"), F.col(f"`{key}`").alias("k"), *digests)
    # equal rows are counted, then numbered: a range sort can't split what is equal
    counted = stage(rows.groupBy("g", "k", "leaf", "now").agg(F.count("*").alias("copies")), "counted", folder)
    copies = counted.selectExpr("g", "k", "leaf", "now", "explode(sequence(1L, copies)) AS copy")
    by = [F.asc_nulls_first("g"), F.asc_nulls_first("k"), F.asc("leaf"), F.asc("now"), F.asc("copy")]
    placed = numbered(copies, by, "leaves", folder).drop("copy")
    # the groups, by their first leaf; a row a group and stretch of leaves, so that a large group is many rows
    spans = placed.groupBy("g", F.expr(f"place div {PART}L").alias("span")).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    spans = stage(spans, "spans", folder)
    found = spans.groupBy("g").agg(F.min("first").alias("first"), F.sum("n").alias("size"))
    groups = numbered(found, [F.asc("first")], "groups", folder, "group_no")
    many, largest = groups.agg(F.count("*"), F.max("size")).first()
    named = spans.select("g", "span").join(groups.withColumnRenamed("g", "_g"), F.expr("g <=> _g")).drop("_g")
    named = named.withColumnsRenamed({"g": "_g", "span": "_span"})
    trees = placed.join(named, F.expr(f"g <=> _g AND place div {PART}L = _span")).selectExpr(
        "g", "k", "leaf", "now", "group_no", "size", "place - first AS idx",
        f"IF(size > {PART}, group_no, -1L) AS part_a",
        f"IF(size > {PART}, place - first, first) div {PART}L AS part_b",
    )
    trees = stage(trees, "trees", folder)
    explored = stage(trees.drop("g", "k").groupBy("part_a", "part_b").applyInArrow(_explored(many), NODES), "explored", folder)

    own = explored.where("digest IS NOT NULL")
    sizes = groups.selectExpr("group_no AS tree", f"(size + {PART - 1}L) div {PART}L AS size")
    high = own.where(f"tree <> {TOP}").select("tree", "idx", "digest").join(sizes, "tree").select("tree", "idx", "digest", "size")
    levels = _climbed(high, -(-(largest or 0) // PART), PART_LEVELS, "group_level", folder)
    subroots = own.where(f"tree = {TOP}").select("idx", "digest")
    for level in levels[1:]:  # a large group has more than one node on the first level
        subroots = subroots.unionAll(level.where("size = 1").select(F.col("tree").alias("idx"), "digest"))
    base = subroots.select(F.lit(TOP).cast("long").alias("tree"), "idx", "digest", F.lit(many).cast("long").alias("size"))
    tops = _climbed(stage(base, "subroots", folder), many, 0, "top_level", folder)
    nodes = [t.select("tree", "level", "idx", "digest") for t in levels + tops]
    everything = nodes[0]
    for table in nodes[1:]:
        everything = everything.unionAll(table)

    wanted = explored.where("digest IS NULL").drop("digest")
    fetched = stage(wanted.join(everything, ["tree", "level", "idx"]), "fetched", folder)
    kinds = {f.name: f.dataType.simpleString() for f in trees.schema}
    proofs = trees.groupBy("part_a", "part_b").cogroup(fetched.groupBy("part_a", "part_b"))
    proofs = proofs.applyInArrow(_expanded(many), f"g {kinds['g']}, k {kinds['k']}, {PROOFS}")
    top = tops[-1].where("size = 1").select("digest").first()
    for name in ("counted", "leaves", "spans", "explored"):
        discard(spark, f"{folder}/{name}")
    root = F.lit(top.digest if top else None).cast("string")
    return proofs.select(
        F.col("g").alias(group), F.col("k").alias(key), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )
