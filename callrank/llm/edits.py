"""Document fingerprints by randomised edit embedding.

A text is embedded by random walks that all texts share (Chakraborty, Goldenberg and Koucky 2016): at step j the walk shows
the character it stands on and moves on if a random bit of (j, character) is set. Texts at a small edit distance are soon
back in step after each edit, so edit distance becomes Hamming distance between the shown sequences. A walk stays on a
character until the next set bit, which a table gives, so a step costs one look-up for each character.

The embedding is as long as the text needs, and is sampled at fixed steps, as many in each octave of steps, so texts of
any lengths share their samples and the whole text counts. A sample keeps four bits of the character's hash: one hex
digit. Likeness is the share of equal samples, each standing for its part of the octave, corrected for chance; of several
walks the one in best step counts.

Near pairs are found by banding: bits sampled from the digits are bucket keys, and pairs are verified by their edit
distance. Equal texts have equal fingerprints; null texts count as empty, and an empty text has an empty fingerprint that is
like another empty one (1) and unlike all else (0). Rows that repeat an id follow each other in order of their texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callrank.llm.common import by_size
from callrank.sources.staging import new_folder, stage

WALKS, SAMPLES, SEED = 3, 32, 42
_CLASSES, _PERIOD = 256, 4096  # characters fold into classes; random bits repeat after that many steps
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)
#: Texts' characters that a task works on at a time.
TASK_CHARS, FEW = 4_000_000, 30
#: Near pairs: digits between bounds of bands, least bits of a band, members of a bucket in one side of a cell.
HALF_OCTAVE, FEWEST_BITS, CELL_ROWS = SAMPLES // 2, 16, 512
#: Share of equal bits, in the walk in best step, down to which pairs are found with this probability.
AGREE, RECALL = 0.85, 0.95
_MIX = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)


@lru_cache(1)
def _stays() -> np.ndarray:
    """Steps until the walk moves on, by walk, class and step: one more than the distance to the next set bit."""
    bits = np.random.default_rng(SEED).integers(0, 2, (WALKS, _CLASSES, _PERIOD), dtype=np.uint8)
    bits[:, :, -1] = 1
    out = np.empty(bits.shape, np.int32)
    stay = np.ones(bits.shape[:2], np.int32)
    for j in range(_PERIOD - 1, -1, -1):
        stay = np.where(bits[:, :, j] == 1, 1, stay + 1)
        out[:, :, j] = stay
    return out.reshape(WALKS, -1)


@lru_cache(1)
def steps() -> tuple[np.ndarray, np.ndarray]:
    """The sampled steps, rising, and how many steps each stands for."""
    rng, at, weight = np.random.default_rng(SEED + 1), [np.arange(SAMPLES)], [np.ones(SAMPLES)]
    low = SAMPLES
    while low < 1 << 40:
        # one step from each of SAMPLES equal parts of the octave
        part = low / SAMPLES
        at.append((low + np.floor(part * (np.arange(SAMPLES) + rng.random(SAMPLES)))).astype(np.int64))
        weight.append(np.full(SAMPLES, part))
        low *= 2
    return np.concatenate(at), np.concatenate(weight)


def _classes(codes: np.ndarray) -> np.ndarray:
    return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int64)


def _digits(codes: np.ndarray) -> np.ndarray:
    return ((codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(60)).astype(np.intp)


def walk(codes: list[np.ndarray], start: np.ndarray) -> list[np.ndarray]:
    """For each text the steps at which each walk leaves each character (characters x walks); ``start``: texts x walks."""
    order = np.argsort([-len(c) for c in codes], kind="stable")
    lengths = np.array([len(codes[i]) for i in order])
    flat = _classes(np.concatenate([codes[i] for i in order])) * _PERIOD if len(codes) else np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    out = np.empty((len(flat), WALKS), np.int32)
    now, stays = start[order].astype(np.int64), _stays()
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # texts longer than t
    for t in range(longest):
        k = active[t]
        if k <= FEW:  # few are left: one at a time is quicker
            for row in range(k):
                a, b = begin[row] + t, begin[row + 1]
                for w in range(WALKS):
                    j, table, stops = int(now[row, w]), memoryview(stays[w]), []
                    for c in flat[a:b].tolist():
                        j += table[c + (j & (_PERIOD - 1))]
                        stops.append(j)
                    out[a:b, w] = stops
            break
        at = begin[:k] + t
        step = now[:k]
        index = flat[at][:, None] + (step & (_PERIOD - 1))
        for w in range(WALKS):
            step[:, w] += stays[w][index[:, w]]
        out[at] = step
    done = [None] * len(codes)
    for row, i in enumerate(order):
        done[i] = out[begin[row] : begin[row + 1]]
    return done


def _shown(codes: np.ndarray, leaves: np.ndarray, first: int, w: int) -> bytes:
    """Digits of the samples in the steps from ``first`` up to where the walk ends."""
    if not len(codes):
        return b""
    at, _ = steps()
    a, b = np.searchsorted(at, [first, leaves[-1, w]])
    on = np.searchsorted(leaves[:, w], at[a:b], side="right")
    return _HEX[_digits(codes[on])].tobytes()


def fingerprints(texts: list[np.ndarray], patches: list[np.ndarray] | None = None) -> tuple[list[str], list[str]]:
    """Fingerprints of texts (code points), and of the texts with their last ``len(patch)`` code points replaced."""
    start = np.zeros((len(texts), WALKS), np.int64)
    leaves = walk(texts, start)
    own = [":".join(_shown(c, x, 0, w).decode() for w in range(WALKS)) for c, x in zip(texts, leaves, strict=True)]
    if patches is None:
        return own, []
    heads = [len(t) - len(t) // 2 for t in texts]
    middle = np.array([x[h - 1] if h else np.zeros(WALKS) for x, h in zip(leaves, heads, strict=True)], np.int64)
    middle = middle.reshape(len(texts), WALKS)
    after = walk(patches, middle)
    edited = []
    for i, h in enumerate(heads):
        parts = []
        for w in range(WALKS):
            kept = _shown(texts[i][:h], leaves[i][:h], 0, w)
            parts.append((kept + _shown(patches[i], after[i], int(middle[i, w]), w)).decode())
        edited.append(":".join(parts))
    return own, edited


def likeness(a: str, b: str) -> float:
    """How alike two fingerprints are, from 0 to 1."""
    if a == b:
        return 1.0
    best, weight = 0.0, steps()[1]
    for x, y in zip(a.split(":"), b.split(":"), strict=True):
        if not x or not y:
            continue
        n, m = min(len(x), len(y)), max(len(x), len(y))
        same = np.frombuffer(x[:n].encode(), np.uint8) == np.frombuffer(y[:n].encode(), np.uint8)
        best = max(best, float(weight[:n][same].sum() / weight[:m].sum()))
    return min(1.0, max(0.0, (best - 1 / 16) / (15 / 16)))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _follow(rows: list[list]) -> pa.RecordBatch:
    """Results for rows [doc_id, text, is followed]; a followed row's next one is the one after it."""
    texts = [_codes(r[1]) for r in rows]
    after = [texts[i + 1][: len(t) // 2] if rows[i][2] else t[:0] for i, t in enumerate(texts)]
    own, edited = fingerprints(texts, after)
    out: dict[str, list] = {c: [] for c in _OUT}
    for i, (doc_id, text, followed) in enumerate(rows):
        if followed:
            half = len(text) // 2
            digest = hashlib.sha256((text[: len(text) - half] + rows[i + 1][1][:half]).encode()).hexdigest()
            near = likeness(own[i], edited[i]), likeness(own[i], own[i + 1])
            for name, value in zip(_OUT, (doc_id, len(text), digest, own[i], edited[i], *near), strict=True):
                out[name].append(value)
    return pa.RecordBatch.from_pydict(out, _ARROW)


_OUT = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
_ARROW = pa.schema(list(zip(_OUT, _TYPES, strict=True)))
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every row and of its edited text, compared with it and with the next row's, in order of ids.

    Rows are dealt to ranges of ids whose bounds are ids themselves. The row at a bound goes to the range before, too, as
    that range's end, so each range is worked on alone: one shuffle of the texts. The last range ends in the first row.
    """
    spark = df.sparkSession
    ranges = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = df.select(F.col(id_col).cast("long").alias("doc_id"))
    shares = [k / ranges for k in range(1, ranges)]
    found = ids.agg(F.percentile_approx("doc_id", shares, 10_000).alias("cuts"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).first()
    nulls = ids.where("doc_id IS NULL").limit(1).count() > 0  # nulls come first
    cuts = sorted(set(found.cuts or []) - {found.least})  # at most 8 a partition
    if nulls and found.least is not None:
        cuts = [found.least, *cuts]
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<long>")
    place = F.coalesce(F.size(F.filter(bounds, lambda c: c <= F.col("doc_id"))), F.lit(0)) if cuts else F.lit(0)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    here = rows.select(place.cast("int").alias("range"), F.lit(0).alias("end"), "doc_id", "text")
    # ends: one row of each id at a bound, and of the first id, whoever else has them
    first = None if nulls else found.least
    marks = [*cuts, *([] if nulls or first is None else [first])]
    wanted = F.col("doc_id").isin(marks) if marks else F.lit(False)
    edge = rows.where(F.coalesce(wanted, F.lit(False)) | (F.col("doc_id").isNull() if nulls else F.lit(False)))
    edge = edge.groupBy("doc_id").agg(F.min("text").alias("text"))
    is_first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(first)
    bound = edge.where(F.col("doc_id").isin(cuts)).select((place - 1).cast("int").alias("range"), F.lit(1).alias("end"), "doc_id", "text") if cuts else None
    last = edge.where(is_first).select(F.lit(len(cuts)).alias("range"), F.lit(2).alias("end"), "doc_id", "text")
    dealt = here.unionAll(last) if bound is None else here.unionAll(bound).unionAll(last)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        size, at, ended = 0, None, False
        for batch in batches:
            for place, end, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != at:
                    at, ended = place, False
                elif ended:  # of the rows that mark a range's end the first is enough
                    continue
                else:
                    rows[-1][2] = True
                ended = end > 0
                rows.append([doc_id, text, False])
                size += len(text)
                if size > TASK_CHARS and len(rows) > 1:
                    yield _follow(rows)
                    rows = [[doc_id, text, False]]  # followed, if at all, by a row to come
                    size = len(text)
        yield _follow(rows)

    ordered = dealt.repartition("range").sortWithinPartitions("range", "end", F.col("doc_id").asc_nulls_first(), "text")
    return ordered.select("range", "end", "doc_id", "text").mapInArrow(follow, _SCHEMA)


def plan(texts: int, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a band and bands of each walk: unrelated texts seldom meet in a bucket, near ones do in one band at least.

    A bucket is a few texts large if bands have as many bits as the number of texts; the bands then follow from the recall
    wanted for pairs whose bits agree to ``AGREE`` in the walk that is best in step.
    """
    bits = max(FEWEST_BITS, math.ceil(math.log2(max(2, texts))))
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - AGREE**bits))


@lru_cache(256)
def _places(bound: int, bits: int, bands: int) -> np.ndarray:
    """Bits of a print's first ``bound`` digits that the bands take (walks x bands x bits), by the steps they stand for."""
    rng, weight = np.random.default_rng((SEED, bound)), steps()[1][:bound]
    digit = rng.choice(bound, (WALKS, bands, bits), p=weight / weight.sum())
    return 4 * digit + rng.integers(0, 4, digit.shape)


def band_keys(mark: str, bits: int, bands: int) -> np.ndarray:
    """Bucket keys of a fingerprint. Texts of nearly the same length share one of two bounds, half an octave apart."""
    if not mark.strip(":"):
        return np.zeros(0, np.int64)
    walks = [np.array([int(c, 16) for c in w], np.uint8) for w in mark.split(":")]
    last = max(HALF_OCTAVE, min(map(len, walks)) // HALF_OCTAVE * HALF_OCTAVE)
    power, keys = np.uint64(1) << np.arange(bits, dtype=np.uint64), []
    for bound in {last, max(HALF_OCTAVE, last - HALF_OCTAVE)}:
        places = _places(bound, bits, bands)
        for k, digits in enumerate(walks):
            digits = np.pad(digits[:bound], (0, max(0, bound - len(digits))))
            flat = ((digits[:, None] >> np.arange(4, dtype=np.uint8)) & 1).astype(np.uint64).ravel()
            value = (flat[places[k]] * power).sum(axis=1, dtype=np.uint64)
            number = (np.uint64(bound * WALKS + k) << np.uint64(32)) + np.arange(bands, dtype=np.uint64)
            mixed = (number * _MIX[0]) ^ (value * _MIX[1])
            keys.append((mixed ^ (mixed >> np.uint64(29))) * _MIX[0])
    return np.concatenate(keys).view(np.int64)


def near_pairs(
    df: DataFrame, most_edits: float = 0.2, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL
) -> DataFrame:
    """Pairs (``a``, ``b``) of texts within ``most_edits`` of the longer one's length, with their edit distance ``edits``.

    Pairs are those of classes of equal texts, each under its smallest id; a text that only rows without an id have is in
    none, nor is the empty text. Keys are bands of bits sampled over the whole print (see :func:`plan`). All members of a
    bucket meet; a crowded one is dealt to a grid of cells, so no task holds it. Candidates whose lengths rule a pair out
    go before they are made distinct, all others are verified by their edit distance, in steps of length times limit.
    """
    folder = new_folder(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    classes = df.select(F.col(id_col).alias("id"), text.alias("text")).where("id IS NOT NULL AND text <> ''")
    classes = stage(classes.groupBy("text").agg(F.min("id").alias("id")), "classes", folder)
    bits, bands = plan(classes.count(), recall)

    def keys(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        marks = (x for a, b in by_size(texts) for x in fingerprints([_codes(t) for t in texts[a:b]])[0])
        return pa.array([band_keys(x, bits, bands) for x in marks], pa.list_(pa.int64()))

    marked = classes.select("id", F.length("text").alias("n"), F.array_distinct(F.arrow_udf(keys, "array<bigint>")("text")).alias("keys"))
    keyed = stage(marked.select("id", "n", F.explode("keys").alias("key")), "keys", folder)
    cuts = keyed.groupBy("key").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("cuts"), F.count("*").alias("members"))
    met = keyed.join(cuts.where("members > 1"), "key").withColumn("own", F.expr("int(pmod(xxhash64(id, key), cuts))"))
    met = met.withColumn("other", F.explode(F.expr("sequence(0, cuts - 1)")))
    met = met.selectExpr("key", "least(own, other) AS i", "greatest(own, other) AS j", "own", "id", "n")
    x, y = (met.select("key", "i", "j", *[F.col(c).alias(f"{c}_{side}") for c in ("own", "id", "n")]) for side in "ab")
    apart = f"abs(n_a - n_b) <= floor(greatest(n_a, n_b) * {float(most_edits)!r}D)"
    pairs = x.join(y, ["key", "i", "j"]).where(f"id_a < id_b AND (i = j OR own_a <> own_b) AND {apart}")
    pairs = stage(stage(pairs.selectExpr("id_a AS a", "id_b AS b"), "met", folder).distinct(), "pairs", folder)
    # pairs are small rows that each cost a table of distances: a fixed number of tasks, which Spark doesn't merge by bytes
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of_a, of_b = classes.selectExpr("text AS ta", "id AS a"), classes.selectExpr("text AS tb", "id AS b")
    limit = f"int(floor(greatest(length(ta), length(tb)) * {float(most_edits)!r}D))"
    texts = pairs.join(of_a, "a").join(of_b, "b").repartition(tasks, "a", "b")
    # -1 beyond the limit, found without the rest of the table; as a generator, as a filter on the column would compute it twice
    return texts.selectExpr("a", "b", f"posexplode(filter(array(levenshtein(ta, tb, {limit})), e -> e >= 0)) AS (one, edits)").drop("one")
