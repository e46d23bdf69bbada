"""Toxicity by a weighted lexicon.

Texts are folded first: compatibility forms and case, look-alike letters of other scripts, digits and signs that stand
for letters inside words. The lexicon is learned from labelled rows: words, and beginnings of words, that are commoner
in toxic documents than in others, weighted by log odds. It is matched by Aho-Corasick at word boundaries; at each word
the heaviest entry counts. Exception phrases, pairs of words in which an entry is harmless by the labels, are entries of
the same automaton and cancel the hits inside them. The score is a logistic function of the weight found and of that
weight in proportion to the text's length.

Texts are scored whole. Null texts count as empty; an empty text gets the score of no hits. Labels that are null are not
used; of several labels of a document the larger counts, of several labelled texts of one id the least is learned from. A table with more labels than can be learned from is drawn by
class, so rare toxic rows are all there, and the intercept is corrected for it. Where labels tell nothing (none, one class
only, or no entry found) the lexicon is empty and all scores are the base rate, or one under the threshold if that is
unknown or higher, so nothing is called toxic without evidence.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callrank.llm.common import strings
from callrank.sources.staging import new_folder, stage

#: Labelled rows to learn from, entries of the lexicon, exception phrases: at most. If there are more labels, those of the
#: smallest hashes of their ids are taken in each class: half of LABELLED, and what the other class leaves of its half.
LABELLED, ENTRIES, PHRASES = 40_000, 5_000, 1_000
#: What is learned: words of at most so many letters, phrases of so many. Texts are matched whole, whatever is in them.
LONGEST_WORD, LONGEST_PHRASE = 40, 80
#: An entry needs that many toxic documents and, two standard errors below its log odds, that much; a phrase that many
#: harmless documents.
FEWEST, LEAST_ODDS, FEWEST_HARMLESS = 5, 2.0, 3
SHORTEST, LONGEST = 3, 9  # beginnings of words, in letters
THRESHOLD = 0.3
NO_EVIDENCE = -5.0  # log odds without evidence, at most; far under the threshold's

#: Letters that look like Latin ones, and what stands for letters inside words. L and I fold together, as 1
#: stands for either.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ı": "i", "ɑ": "a", "α": "a",
    "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
_LETTERS = str.maketrans(LOOKALIKES | {"l": "i"} | dict.fromkeys("​‌‍⁠﻿­"))
_DIGIT = str.maketrans(DIGITS)
_SIGN = re.compile(r"(?<=[^\W\d_])[@$!|](?=[^\W\d_])|(?<!\w)[@$](?=[^\W\d_])")
_MIXED = re.compile(r"\w*[^\W\d_]\w*\d\w*|\w*\d\w*[^\W\d_]\w*")
_DIGIT_IN = re.compile(r"\d")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    text = unicodedata.normalize("NFKC", text).lower().translate(_LETTERS)
    if "@" in text or "$" in text or "!" in text or "|" in text:
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    if _DIGIT_IN.search(text):
        text = _WORD.sub(lambda m: m[0].translate(_DIGIT) if _DIGIT_IN.search(m[0]) and not m[0].isdigit() else m[0], text)
    return text


@dataclass(frozen=True)
class Lexicon:
    """Weights of words and of beginnings of words, exception phrases, and the logistic function."""

    words: tuple[tuple[str, float], ...] = ()
    beginnings: tuple[tuple[str, float], ...] = ()
    phrases: tuple[str, ...] = ()
    logistic: tuple[float, float, float] = (NO_EVIDENCE, 0.0, 0.0)


@lru_cache(4)
def _automaton(lexicon: Lexicon) -> ahocorasick.Automaton:
    entries: dict[str, list] = {}  # text -> weight as a word, weight as a beginning, is a phrase
    for text, weight in lexicon.words:
        entries.setdefault(text, [0.0, 0.0, False])[0] = weight
    for text, weight in lexicon.beginnings:
        entries.setdefault(text, [0.0, 0.0, False])[1] = weight
    for text in lexicon.phrases:
        entries.setdefault(text, [0.0, 0.0, False])[2] = True
    automaton = ahocorasick.Automaton()
    for text, entry in entries.items():
        automaton.add_word(text, (len(text), *entry))
    if entries:
        automaton.make_automaton()
    return automaton


def hits(lexicon: Lexicon, text: str) -> dict[int, float]:
    """Weight of the heaviest entry at each word of the folded ``text`` that has one, by the word's place."""
    automaton = _automaton(lexicon)
    if not len(automaton):
        return {}
    found: dict[int, float] = {}
    excepted: list[tuple[int, int]] = []
    end = len(text)
    for last, (length, as_word, as_beginning, phrase) in automaton.iter(text):
        start = last - length + 1
        if start and text[start - 1].isalnum():
            continue
        whole = last + 1 == end or not text[last + 1].isalnum()
        if phrase and whole:
            excepted.append((start, last))
        weight = max(as_word if whole else 0.0, as_beginning)
        if weight > found.get(start, 0.0):
            found[start] = weight
    if excepted:
        excepted.sort()
        starts, reach = [a for a, _ in excepted], list(accumulate((b for _, b in excepted), max))
        # the exceptions that begin at or before a hit hold it if one of them reaches as far
        held = ((at, bisect.bisect_right(starts, at)) for at in found)
        found = {at: found[at] for at, k in held if not k or reach[k - 1] < at}
    return found


def features(lexicon: Lexicon, text: str) -> tuple[float, float]:
    """Weight found, and weight for each hundred words, both as logarithms."""
    folded = fold(text)
    weight = sum(hits(lexicon, folded).values())
    words = folded.count(" ") + folded.count("\n") + 1
    return math.log1p(weight), math.log1p(100 * weight / words)


def _logistic(coefficients: tuple, x: np.ndarray) -> np.ndarray:
    a, b, c = coefficients
    return 1 / (1 + np.exp(-np.clip(a + b * x[:, 0] + c * x[:, 1], -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Newton's method with a small ridge."""
    if not len(y):
        return (0.0, 0.0, 0.0)
    data, w = np.column_stack([np.ones(len(y)), x]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(data @ w, -30, 30)))
        step = np.linalg.solve(
            (data * (p * (1 - p))[:, None]).T @ data + ridge * np.eye(3), data.T @ (y - p) - ridge * w
        )
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _terms(text: str) -> set[str]:
    """Words (marked by a blank at the end) and beginnings of words of a folded text."""
    words = {w for w in _WORD.findall(text) if SHORTEST <= len(w) <= LONGEST_WORD}
    return {w + " " for w in words} | {w[:k] for w in words for k in range(SHORTEST, min(len(w), LONGEST + 1))}


def _counted(rows: DataFrame, found) -> DataFrame:
    """Documents with each of the ``found(text)`` strings: ``term``, ``toxic``, ``other``; summed within tasks first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch.text, batch.toxic, strict=True):
                sums[int(toxic)].update(found(fold(text)))
            terms = list(sums[0] | sums[1])
            yield pd.DataFrame(
                {"term": terms, "toxic": [sums[1][t] for t in terms], "other": [sums[0][t] for t in terms]}
            ).astype({"term": str, "toxic": "int64", "other": "int64"})

    counts = rows.mapInPandas(count, "term string, toxic long, other long")
    return counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _pruned(rows: list, toxic: int, other: int) -> list[tuple[str, float]]:
    """Entries with weights, less those that a shorter beginning of about their weight stands for."""
    odds = {
        r.term: math.log((r.toxic + 0.5) / (toxic + 1)) - math.log((r.other + 0.5) / (other + 1)) for r in rows
    }
    number = {r.term: r.toxic for r in rows}
    # a beginning that is nearly always that of one longer entry is left to the longer one
    for term in sorted(odds, key=lambda t: (-len(t.rstrip()), t)):
        text = term.rstrip()
        for k in range(SHORTEST, len(text) + (term != text)):
            beginning = text[:k]
            if term in number and beginning in number and number[term] >= 0.8 * number[beginning]:
                del odds[beginning], number[beginning]
    kept: dict[str, float] = {}
    for term in sorted(odds, key=lambda t: (len(t), t)):
        text = term.rstrip()
        shorter = [kept[text[:k]] for k in range(SHORTEST, len(text) + 1) if text[:k] in kept and text[:k] != term]
        if not shorter or odds[term] > max(shorter) + 0.5:
            kept[term] = round(odds[term], 6)
    return sorted(kept.items())


def shares(other: int, toxic: int, most: int | None = None) -> tuple[int, int]:
    """Labels to draw of the others and of the toxic ones: ``most`` in all, half of them or what the other class leaves."""
    most = LABELLED if most is None else most
    return min(other, max(most - most // 2, most - toxic)), min(toxic, max(most // 2, most - other))


def base_rate(toxic: int, other: int, favour: float = 0.0) -> Lexicon:
    """The empty lexicon, by which every text scores the base rate, NO_EVIDENCE at most."""
    odds = math.log((toxic + 0.5) / (other + 0.5)) - favour if toxic or other else NO_EVIDENCE
    return Lexicon(logistic=(min(odds, NO_EVIDENCE), 0.0, 0.0))


def learn(documents: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """The lexicon from labelled documents whose label row is ``usable`` (a condition on ``labels``)."""
    known = labels.where(usable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = stage(known, "labels", new_folder(documents.sparkSession))  # two numbers a label
    there = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    drawn = shares(there.get(0, 0), there.get(1, 0))
    parts = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(drawn[k]) for k in (0, 1)]
    chosen = parts[0].unionAll(parts[1])
    texts = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # broadcast: LABELLED rows of two numbers, under 1 MB
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    # written once: counting terms and phrases and measuring read LABELLED texts, not the corpus
    rows = stage(rows.select("text", "toxic"), "labelled", new_folder(documents.sparkSession))
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        return base_rate(toxic, other)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("other") + 0.5) / (other + 1))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + 0.5))
    terms = _counted(rows, _terms).where((F.col("toxic") >= FEWEST) & (odds - 2 * error >= LEAST_ODDS))
    entries = _pruned(terms.orderBy((-odds * F.col("toxic")), "term").limit(ENTRIES).collect(), toxic, other)
    # how many times likelier a toxic label was drawn than another, as log odds
    favour = math.log(drawn[1] * there[0] / (drawn[0] * there[1]))
    if not entries:
        return base_rate(toxic, other, favour)
    words = tuple((t[:-1], w) for t, w in entries if t.endswith(" "))
    lexicon = Lexicon(words, tuple((t, w) for t, w in entries if not t.endswith(" ")))

    def pairs(text: str) -> set[str]:
        """Neighbouring words, as they stand, of which one has a hit."""
        at, places = hits(lexicon, text), [m.span() for m in _WORD.finditer(text)] if hits(lexicon, text) else []
        near = {i for i, (a, _) in enumerate(places) if a in at}
        starts = {max(i - 1, 0) for i in near} | near
        return {text[places[i][0] : places[i + 1][1]] for i in starts if i + 1 < len(places)}

    odd = (F.col("other") >= FEWEST_HARMLESS) & (odds <= 0) & (F.length("term") <= LONGEST_PHRASE)
    phrases = _counted(rows, pairs).where(odd).orderBy(F.desc("other"), "term").limit(PHRASES).collect()
    lexicon = Lexicon(lexicon.words, lexicon.beginnings, tuple(r.term for r in phrases))
    measured = rows.select("toxic", _measure(lexicon)("text").alias("x")).select("toxic", "x.*").toPandas()  # LABELLED rows
    measured = measured.sort_values(list(measured.columns))  # one order, so one sum
    a, b, c = fit_logistic(measured[["weight", "density"]].to_numpy(), measured.toxic.to_numpy(float))
    logistic = (a - favour, b, c)
    return Lexicon(lexicon.words, lexicon.beginnings, lexicon.phrases, tuple(round(v, 9) for v in logistic))


def _measure(lexicon: Lexicon):
    def measure(column: pa.Array) -> pa.Array:
        x = np.array([features(lexicon, t) for t in strings(column)]).reshape(-1, 2)
        return pa.StructArray.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["weight", "density"])

    return F.arrow_udf(measure, "struct<weight:double,density:double>")


def score(lexicon: Lexicon, text: Column) -> Column:
    """Score from 0 to 1 of a text column."""

    def scored(column: pa.Array) -> pa.Array:
        x = np.array([features(lexicon, t) for t in strings(column)]).reshape(-1, 2)
        return pa.array(_logistic(lexicon.logistic, x), pa.float64())

    return F.arrow_udf(scored, "double")(F.coalesce(text, F.lit("")))


def held_out(doc_id: Column) -> Column:
    """Whether the rows of this id are kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
