"""Runs of repeated words, found by catching squares over dyadic blocks.

As words are appended, each power of two ``m`` completes blocks of ``m`` words at the multiples of ``m``. A completed
block is a catcher: it waits for its own words to come again ``q`` words later, with ``2m - 1 <= q <= 4m - 2``. These
ranges of ``q`` follow one another, and the first ``2m - 1`` words of a square of period ``q`` hold a whole block, so a
square is caught by one catcher at least and only by those of one ``m``. Each appended word completes one suffix of ``m`` words, which
is compared by its hash with the two blocks that are that far behind it: two comparisons a word and power of two. Here the words of
a group of texts are appended together, power by power, as array operations: the hash of ``2m`` words is made of
those of its halves.

Catches of one ``q`` in neighbouring blocks are one chain. A chain long enough to belong to a wanted run is compared
word by word, up to ``m - 1`` words beyond its ends, which gives the run's exact borders and takes out false hash matches. A
catch that lies in a known run whose period divides ``q`` is a repetition of the same run and is skipped. Of
stretches with the same borders the least period counts.

A text that is null or has no words has no runs. Equal texts have equal runs, each on its own row. Texts are worked on
whole, however long; the group of a long text is that text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callrank.llm.common import by_size, unused

#: Words are what lies between these: fixed values, ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"
#: A run has at least so many periods and words.
EXPONENT, SHORTEST = 4, 6
SCHEMA = "struct<n_words:long,runs:array<struct<start:long,length:long,period:long>>,collapsed:string>"


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One hash of two neighbours' hashes, in 64 bits that wrap around."""
    z = x * np.uint64(0x9E3779B97F4A7C15) + (y ^ (y >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(32))


def _caught(hashes: np.ndarray, base: np.ndarray, end: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of block and suffix of each catch among blocks of ``m`` words."""
    place = np.arange(len(hashes))
    ahead = place - base - (2 * m - 1)
    complete = (ahead >= 0) & (place + m <= end)
    blocks, suffixes = [], []
    for back in (0, m):  # the nearest block that is far enough behind the suffix, and the one before it
        block = base + (ahead & -m) - back
        waits = complete & (ahead >= back)
        at = np.flatnonzero(waits)
        at = at[hashes[at] == hashes[block[at]]]
        blocks.append(block[at])
        suffixes.append(at)
    return np.concatenate(blocks), np.concatenate(suffixes)


def _chains(block: np.ndarray, q: np.ndarray, base: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``q``, first block and last block of each chain of neighbouring catches, by ``q``."""
    order = np.lexsort((block, q))
    block, q = block[order], q[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (block[1:] != block[:-1] + m) | (base[block[1:]] != base[block[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first, len(q))[1:] - 1
    return q[first], block[first], block[last]


def runs(
    words: np.ndarray, counts: np.ndarray, exponent: int = EXPONENT, shortest: int = SHORTEST
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, length and period of the runs of texts, by text, start and period.

    ``words`` are numbers, equal for equal words; ``counts`` of them belong to each text in turn. ``exponent`` is 2 or more.
    """
    # Longer texts first: those that blocks of a size can matter to are then the beginning of the arrays.
    order = np.argsort(-counts, kind="stable")
    starts = np.cumsum(counts) - counts
    lengths = counts[order]
    ends = np.cumsum(lengths)
    base, end = np.repeat(ends - lengths, lengths), np.repeat(ends, lengths)
    words = words[np.arange(len(words)) - base + np.repeat(starts[order], lengths)]
    hashes = _mixed(words.astype(np.uint64), np.uint64(0xD1B54A32D192ED03) + words.astype(np.uint64))
    known_end, known_period = np.zeros(len(words), np.int64), np.ones(len(words), np.int64)
    found: dict[tuple[int, int], int] = {}
    m = 1
    while True:
        texts = np.searchsorted(-lengths, -max(shortest, exponent * (2 * m - 1)), side="right")
        size = int(ends[texts - 1]) if texts else 0
        if not size:
            break
        hashes = hashes[:size] if m == 1 else _mixed(hashes[:size], np.append(hashes, np.zeros(m, np.uint64))[m // 2 :][:size])
        block, suffix = _caught(hashes, base[:size], end[:size], m)
        q = suffix - block
        fresh = (known_end[block] < suffix + m) | (q % known_period[block] != 0)
        for q, first, last in zip(*(a.tolist() for a in _chains(block[fresh], q[fresh], base, m)), strict=True):
            least = max(shortest, exponent * q) - q  # words that must equal the word q later
            if last - first + m + 2 * (m - 1) < least:
                continue
            if known_end[first] >= last + m + q and q % known_period[first] == 0:
                continue
            low, high = max(int(base[first]), first - m + 1), min(int(end[first]) - q, last + 2 * m - 1)
            same = np.concatenate(([False], words[low:high] == words[low + q : high + q], [False]))
            borders = np.flatnonzero(same[1:] != same[:-1])
            for a, b in zip(borders[::2].tolist(), borders[1::2].tolist(), strict=True):
                if b - a >= least:
                    a, b = low + a, low + b + q
                    found.setdefault((a, b), q)
                    known_end[a:b], known_period[a:b] = b, q
        m *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 4
    a, b = np.array(list(found), np.int64).T
    period = np.array(list(found.values()), np.int64)
    text = order[np.searchsorted(ends, a, side="right")]
    start = a - base[a]
    by = np.lexsort((period, start, text))
    return text[by], start[by], (b - a)[by], period[by]


def _kept(n: int, at: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of ``n`` words no run holds after its first period; ``at`` is where each run begins."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, at + period, 1)
    np.add.at(steps, at + length, -1)
    return np.cumsum(steps[:-1]) == 0


def _detected(texts: pa.Array, exponent: int, shortest: int) -> Iterator[pa.StructArray]:
    plain = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = pc.binary_length(plain).to_numpy(zero_copy_only=False)
    for start, stop in by_size(_Sizes(sizes)):
        # Arrow splits at runs of ASCII white space; what is trimmed first would leave an empty word
        split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(plain[start:stop]))
        flat, counts = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        real = pc.not_equal(flat, "")
        if not pc.all(real).as_py():  # the one empty word of an empty text
            owner = np.repeat(np.arange(len(counts)), counts)[real.to_numpy(zero_copy_only=False)]
            flat, counts = flat.filter(real), np.bincount(owner, minlength=len(counts)).astype(np.int64)
        numbers = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        text, begin, length, period = runs(numbers, counts, exponent, shortest)
        offsets = np.cumsum(counts) - counts
        keep = _kept(len(numbers), offsets[text] + begin, length, period)
        left = np.add.reduceat(np.append(keep, False), np.minimum(offsets, len(keep)), dtype=np.int64) * (counts > 0)
        kept = pa.LargeListArray.from_arrays(np.append(0, np.cumsum(left)), flat.filter(pa.array(keep)))
        each = np.append(0, np.cumsum(np.bincount(text, minlength=len(counts))))
        triples = pa.StructArray.from_arrays([pa.array(v) for v in (begin, length, period)], ["start", "length", "period"])
        yield pa.StructArray.from_arrays(
            [
                pa.array(counts),
                pa.ListArray.from_arrays(pa.array(each, pa.int32()), triples),
                pc.binary_join(kept, pa.scalar(" ", pa.large_string())).cast(pa.string()),
            ],
            ["n_words", "runs", "collapsed"],
        )


class _Sizes:
    """Texts of which only the sizes are looked at."""

    def __init__(self, sizes: np.ndarray):
        self.sizes = sizes

    def __len__(self) -> int:
        return len(self.sizes)

    def __iter__(self) -> Iterator[range]:
        return (range(int(n)) for n in self.sizes)


def detected(text: Column, exponent: int = EXPONENT, shortest: int = SHORTEST) -> Column:
    """``n_words``, ``runs`` (by start, then period) and ``collapsed``, the words left when each run gives up all but its
    first period, joined by one space."""

    def detect(texts: pa.Array) -> pa.Array:
        parts = list(_detected(texts, exponent, shortest))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([
            ("n_words", pa.int64()),
            ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
            ("collapsed", pa.string()),
        ]))

    return F.arrow_udf(detect, SCHEMA)(text)


def with_runs(df: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """``df`` with ``n_words``, ``runs`` and ``collapsed``; input columns of these names are replaced."""
    column = unused(df, "periodic__")
    found = df.withColumn(column, detected(F.col(f"`{text_col}`"), **limits))
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("n_words", "runs", "collapsed")]
    return found.select(*kept, f"{column}.*")


def with_tail(text: Column, g: Column) -> Column:
    """The text's words joined by spaces and made periodic from word ``a = g % n`` on: word ``i >= a`` of ``n`` becomes word
    ``a + (i - a) % p`` with ``p = 1 + floor((n - a) / (3 + g % 8))``."""

    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORDS})"))
    n = F.size(words)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = F.floor((n - a) / (g % 8 + 3)).cast("int") + 1
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    return F.concat_ws(" ", F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a))
