"""Merkle manifest and proofs against a plain tree in memory."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from callrank.llm import merkle, queries, sql


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(digests):
    """The root of a tree, and of each leaf the runs on its way up as (siblings before, siblings after)."""
    paths, now, at = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(now) > 1:
        runs = [now[i : i + 16] for i in range(0, len(now), 16)]
        for path, i in zip(paths, at, strict=True):
            run = runs[i // 16]
            path.append((run[: i % 16], run[i % 16 + 1 :]))
        now, at = [digest("".join(r)) for r in runs], [i // 16 for i in at]
    return now[0], paths


def plain_leaf(*values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def expected(rows):
    """Rows of (doc_id, text, lang, source, n_chars)."""
    lower = {c: c + 32 for c in range(65, 91)}
    leaves = []
    for doc_id, text, lang, source, n_chars in rows:
        drawn = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        whole = plain_leaf(doc_id, source, lang, n_chars, text)
        changed = plain_leaf(doc_id, source, lang, n_chars, text and text.translate(lower)) if drawn else None
        key = (source is not None, (source or "").encode(), doc_id is not None, doc_id or 0, whole, changed or "")
        leaves.append((key, source, doc_id, whole, changed or whole))
    leaves.sort(key=lambda x: x[0])
    sources = sorted({x[1] for x in leaves}, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([x[3] for x in leaves if x[1] == s]) for s in sources]
    if not trees:
        return []
    root, above = plain_tree([t[0] for t in trees])
    out = []
    for source, (subroot, paths), rest in zip(sources, trees, above, strict=True):
        for (_, _, doc_id, whole, now), path in zip([x for x in leaves if x[1] == source], paths, strict=True):
            proof, folded = "", now
            for before, after in path + rest:
                proof += "".join(before + after)
                folded = digest("".join([*before, folded, *after]))
            out.append((doc_id, whole, subroot, root, digest(proof), folded, folded == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def found(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_merkle(spark, str(tmp_path))
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=str)


def odd_rows():
    rows = [(i, f"Text {i} ÄÖ", "en", "big", 9) for i in range(-300, 300)]
    rows += [(i, "Same Text", None, f"s{i % 37}", None) for i in range(500, 700)]
    rows += [(7, "Twice", "de", "big", 1), (7, "Twice", "de", "big", 1), (7, "other", "de", "big", 1), (None, None, None, None, None)]
    rows += [(None, "", "", "", 0), (1, None, "en", None, 3), (2, "x" * 100_000, "😀", "￿", 3), (3, "Y", "y", "\U0001f600", 1)]
    return rows + [(77, "Copy Of It", "en", "copies", 1)] * 90


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_query_against_a_plain_tree(spark, tmp_path, monkeypatch, levels):
    """Parts of 16 and 256 leaves make several parts of the larger groups."""
    monkeypatch.setattr(merkle, "PART_LEVELS", levels)
    monkeypatch.setattr(merkle, "PART", 16**levels)
    rows = odd_rows()
    got = found(spark, tmp_path, rows)
    assert got == expected(rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 16, 17])
def test_few_rows(spark, tmp_path, n):
    rows = [(i, f"T{i}", "en", "one", 2) for i in range(n)]
    assert found(spark, tmp_path, rows) == expected(rows)
    rows = [(i, f"T{i}", "en", f"s{i}", 2) for i in range(n)]
    assert found(spark, tmp_path, rows) == expected(rows)


def test_twin_on_odd_rows_and_given_documents(spark, sf_dir, tmp_path):
    def twin(path):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
        return sorted(con.execute(sql.ALL["op12_merkle"]).fetchall(), key=str)

    assert found(spark, tmp_path, odd_rows()) == twin(f"{tmp_path}/documents.parquet/*.parquet")
    got = queries.op12_merkle(spark, sf_dir).collect()
    assert sorted((tuple(r) for r in got), key=str) == twin(f"{sf_dir}/documents.parquet")


def test_missing_coordinates_are_the_least_that_do():
    """Of a tree of 1000 leaves, two neighbours and a far one: with what is missing the root follows, with less it doesn't."""
    digests = [digest(str(i)) for i in range(1000)]
    root, _ = plain_tree(digests)
    nodes, level = {(0, i): d for i, d in enumerate(digests)}, 0
    while len([1 for lv, _ in nodes if lv == level]) > 1:
        here = [nodes[level, i] for i in range(len([1 for lv, _ in nodes if lv == level]))]
        nodes |= {(level + 1, i // 16): digest("".join(here[i : i + 16])) for i in range(0, len(here), 16)}
        level += 1
    known = {3, 4, 999}
    wanted = merkle.missing(known, 1000)
    assert len(wanted) == len(set(wanted)) == (14 + 7) + (15 + 14) + 2
    own = {(0, i): digests[i] for i in known}
    paths = merkle.Paths(1000, own | {c: nodes[c] for c in wanted}, known)
    assert paths.root == root
    assert all(paths.fold(i, digests[i]) == root for i in known) and paths.fold(3, digests[4]) != root
    for left_out in wanted:
        with pytest.raises(KeyError):
            merkle.Paths(1000, own | {c: nodes[c] for c in wanted if c != left_out}, known)


def test_other_columns_may_have_any_names(spark):
    data = [(1, digest("a"), None), (2, digest("b"), digest("c")), (3, digest("d"), None)]
    rows = spark.createDataFrame(data, "place int, leaf string, now string")
    got = merkle.proven(rows.withColumn("idx", F.lit("g")), group="idx", key="place")
    assert got.columns == ["idx", "place", *COLUMNS[1:]]
    assert [(r.idx, r.place, r.verified) for r in got.orderBy("place").collect()] == [("g", 1, True), ("g", 2, False), ("g", 3, True)]
