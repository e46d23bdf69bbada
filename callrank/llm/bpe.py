"""Byte-level BPE: text to token ids and back.

Pre-tokenisation uses no regular expression. Each code point becomes a symbol (letter, number, other, blank that
ends a run, ...) by table lookups on arrays. A finite automaton over those symbols marks where pieces begin. It is
run as a scan over transition functions: chunks of symbols are composed side by side, the chunks' functions are
composed by an associative prefix scan, and a last pass replays each chunk from its known start state. The pieces
are slices of the UTF-8 buffer and go through cached pair merging. Byte offsets of the tokens are kept, and
decoding places tokens by them.

Null texts are empty; an empty text has no ids. Input columns named like an output are replaced.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callrank.llm.common import by_size, strings

# Symbols of the automaton. A blank is "last" if something else follows it; blanks before it, and blanks at the end of
# a text, are "mid". Apostrophes that begin 's 't 'm 'd are ONE, those that begin 're 've 'll are TWO.
LETTER, NUMBER, OTHER, ONE, TWO, SPACE_LAST, BLANK_LAST, BLANK_MID, END = range(9)
# States: what the piece at hand is. JOIN: a space that the next piece takes in. C1, C2: letters of a contraction to come.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, JOIN, C1, C2 = range(8)
STATES, SYMBOLS, CHUNK = 8, 9, 64
CACHED_PIECES, LONG_PIECE, NEVER = 60_000, 128, 1 << 40
GROUP_CHARS = 500_000  # code points of texts that are encoded together; each takes some hundred bytes of arrays

#: Blocks with letters or numbers that came with Unicode 16, the version tiktoken knows and this Python
#: may not yet know.
UNICODE_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x16139),
    (0x16D40, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5FA),
]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a piece begins here", by symbol * STATES + state."""
    to = np.zeros((SYMBOLS, STATES), np.uint8)
    begins = np.ones((SYMBOLS, STATES), bool)
    for symbol, state, keeps in (
        (LETTER, IN_LETTERS, (IN_LETTERS, JOIN)),
        (NUMBER, IN_NUMBERS, (IN_NUMBERS, JOIN)),
        (OTHER, IN_OTHERS, (IN_OTHERS, JOIN)),
        (BLANK_MID, IN_BLANKS, (IN_BLANKS,)),
        (SPACE_LAST, JOIN, ()),
        (BLANK_LAST, START, ()),
        (END, START, ()),
        (ONE, C1, (IN_OTHERS, JOIN)),
        (TWO, C2, (IN_OTHERS, JOIN)),
    ):
        to[symbol] = state
        begins[symbol, list(keeps)] = False
    to[ONE, [IN_OTHERS, JOIN]] = to[TWO, [IN_OTHERS, JOIN]] = IN_OTHERS
    to[LETTER, C1], to[LETTER, C2] = START, C1
    begins[LETTER, [C1, C2]] = False
    return to.ravel(), begins.ravel()


TO, BEGINS = _tables()


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or BLANK_MID for every code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for code in range(sys.maxunicode + 1):
        kind = kinds.get(unicodedata.category(chr(code))[0])
        if kind is not None:
            out[code] = kind
    for first, last in UNICODE_16:
        for code in range(first, last + 1):
            kind = kinds.get(next((k for k in "LN" if regex.match(rf"\p{{{k}}}", chr(code))), ""))
            out[code] = OTHER if kind is None else kind
    out[[0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK_MID
    out[0x2000:0x200B] = BLANK_MID
    return out


def symbols(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols of concatenated texts; ``ends`` are the places of the marks after each text."""
    out = code_point_classes()[codes]
    out[ends] = END
    after = np.append(out[1:], np.uint8(END))
    last = (out == BLANK_MID) & (after != BLANK_MID) & (after != END)
    out[last] = np.where(codes[last] == 0x20, SPACE_LAST, BLANK_LAST)
    quotes = np.flatnonzero((codes == 0x27) & (out == OTHER))
    if len(quotes):
        padded = np.append(codes, [0, 0]).astype(np.uint32)
        first, second = padded[quotes + 1], padded[quotes + 2]
        one = np.isin(first, [ord(c) for c in "stmd"])
        two = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e"))
        two |= (first == ord("l")) & (second == ord("l"))
        out[quotes[two]] = TWO
        out[quotes[one]] = ONE
    return out


def piece_starts(symbol: np.ndarray) -> np.ndarray:
    """Places where a piece begins, by a scan over transition functions."""
    n = len(symbol)
    chunks = -(-n // CHUNK)
    grid = np.full(chunks * CHUNK, END, np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T).astype(np.intp) * STATES
    # each chunk's symbols composed into one function, all chunks side by side
    function = np.tile(np.arange(STATES, dtype=np.uint8), (chunks, 1))
    for column in grid:
        function = TO[column[:, None] + function]
    # prefix compositions of the chunks' functions
    step = 1
    while step < chunks:
        function[step:] = np.take_along_axis(function[step:], function[:-step].astype(np.intp), axis=1)
        step *= 2
    state = np.zeros(chunks, np.uint8)
    state[1:] = function[:-1, START]
    begins = np.empty((CHUNK, chunks), bool)
    for j, column in enumerate(grid):
        at = column + state
        begins[j] = BEGINS[at]
        state = TO[at]
    return np.flatnonzero(begins.T.ravel()[:n])


class Vocabulary(dict):
    """Ranks of a byte-level BPE; as a mapping, a cache from a piece to its packed ids."""

    def __init__(self, file: bytes):
        lines = (line.split() for line in file.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        size = max(self.ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def __missing__(self, piece: bytes) -> bytes:
        rank = self.ranks.get(piece)
        ids = [rank] if rank is not None else self.merged(piece)
        packed = np.array(ids, "<u4").tobytes()
        if len(self) >= CACHED_PIECES:
            self.clear()
        self[piece] = packed
        return packed

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a piece: the pair of lowest rank, leftmost first, is merged until none is left."""
        if len(piece) > LONG_PIECE:
            return self.merged_long(piece)
        ranks, cuts = self.ranks, list(range(len(piece) + 1))
        pairs = [ranks.get(piece[i : i + 2], NEVER) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) != NEVER:
            i = pairs.index(least)
            del cuts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(piece[cuts[i] : cuts[i + 2]], NEVER)
            if i:
                pairs[i - 1] = ranks.get(piece[cuts[i - 1] : cuts[i + 1]], NEVER)
        return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]

    def merged_long(self, piece: bytes) -> list[int]:
        """As :meth:`merged` with a heap, for pieces of any length."""
        ranks, n = self.ranks, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        stop = list(range(1, n + 1))  # where the part that begins here ends; 0 once it is merged away
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i]
            if not stop[i] or j >= n or stop[j] != end:
                continue
            stop[i], stop[j], after[i] = end, 0, after[j]
            if end < n:
                before[end] = i
                if (r := ranks.get(piece[i : stop[end]])) is not None:
                    heapq.heappush(heap, (r, i, stop[end]))
            h = before[i]
            if h >= 0 and (r := ranks.get(piece[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : stop[i]]])
            i = stop[i]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids (little-endian, 32 bits) of each text."""
        joined = "\0".join(texts) + "\0"
        buffer = joined.encode()
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = piece_starts(symbols(codes, ends))
        width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        place = np.cumsum(width) - width
        cuts = place[starts].tolist()
        of_end = np.searchsorted(starts, ends).tolist()
        out, first = [], 0
        for last in of_end:
            here = cuts[first : last + 1]
            pieces = [buffer[a:b] for a, b in zip(here, here[1:], strict=False)]
            out.append(b"".join(map(self.__getitem__, pieces)))
            first = last + 1
        return out

    def offsets(self, packed: bytes) -> bytes:
        """Where each token's bytes begin, packed like the ids."""
        lengths = self.lengths[np.frombuffer(packed, "<u4")]
        return (np.cumsum(lengths) - lengths).astype("<u4").tobytes()

    def decode(self, packed: bytes, offsets: bytes) -> bytes:
        """The bytes of the ids, each token put at its offset."""
        ids, at = np.frombuffer(packed, "<u4"), np.frombuffer(offsets, "<u4").astype(np.int64)
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        total = int(at[-1] + lengths[-1])
        source = np.repeat(self.begins[ids] - at, lengths) + np.arange(total)
        return self.bytes[source].tobytes()


@lru_cache(2)
def _vocabulary(file: bytes) -> Vocabulary:
    return Vocabulary(file)


def load_ranks(path: str) -> bytes:
    """The rank file, read where the driver runs; executors get its content."""
    with open(path, "rb") as file:
        return file.read()


def _coder(spark: SparkSession, ranks_path: str, decode: bool):
    content = spark.sparkContext.broadcast(load_ranks(ranks_path))  # under 1 MB, whatever the data
    kind = "ids binary, offsets binary" + ", decoded binary" * decode

    def code(column: pa.Array) -> pa.Array:
        vocabulary, texts = _vocabulary(content.value), strings(column)
        ids = [x for a, b in by_size(texts, GROUP_CHARS) for x in vocabulary.encode(texts[a:b])]
        offsets = [vocabulary.offsets(x) for x in ids]
        columns = [ids, offsets]
        if decode:
            columns.append([vocabulary.decode(x, o) for x, o in zip(ids, offsets, strict=True)])
        names = ["ids", "offsets", "decoded"][: len(columns)]
        return pa.StructArray.from_arrays([pa.array(c, pa.binary()) for c in columns], names)

    return F.arrow_udf(code, f"struct<{kind.replace(' ', ':').replace(',:', ',')}>")


def encoded(spark: SparkSession, text: Column, ranks_path: str) -> Column:
    """A struct of ``ids`` and ``offsets`` (little-endian 32-bit integers in binary)."""
    return _coder(spark, ranks_path, decode=False)(text)


def round_trip(spark: SparkSession, text: Column, ranks_path: str) -> Column:
    """As :func:`encoded`, with the ids decoded again in ``decoded``; one pass of Python for both."""
    return _coder(spark, ranks_path, decode=True)(text)


def decoded(spark: SparkSession, ids: Column, offsets: Column, ranks_path: str) -> Column:
    """The bytes that the ids stand for."""
    content = spark.sparkContext.broadcast(load_ranks(ranks_path))

    def code(ids: pa.Array, offsets: pa.Array) -> pa.Array:
        vocabulary = _vocabulary(content.value)
        pairs = zip(strings(ids), strings(offsets), strict=True)
        return pa.array([vocabulary.decode(i, o) for i, o in pairs], pa.binary())

    return F.arrow_udf(code, "binary")(ids, offsets)


def encode_documents(df: DataFrame, ranks_path: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``n_tokens``, ``ids``, ``offsets`` and ``decoded``; columns of those names are replaced."""
    outputs = ("n_tokens", "ids", "offsets", "decoded")
    kept = [c for c in df.columns if c.lower() not in outputs]
    coded = round_trip(df.sparkSession, F.coalesce(F.col(text_col), F.lit("")), ranks_path)
    return df.select(*[F.col(f"`{c}`") for c in kept], coded.alias("coded__")).select(
        *[F.col(f"`{c}`") for c in kept],
        F.expr("octet_length(coded__.ids) div 4").alias("n_tokens"),
        *[F.col(f"coded__.{c}").alias(c) for c in outputs[1:]],
    )
