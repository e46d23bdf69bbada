"""Personal data: fixed base spans, and spans that candidate gradient boosting adds.

Everything on the data's path is Spark SQL: no Python on executors. Spans are code point offsets, end exclusive, found
inside a row with array functions, so no text is shuffled.

* Base: emails, IP addresses, card numbers and phone numbers by fixed patterns and checks. Base spans always stay.
* Candidates: looser generators for each kind propose overlapping spans (written-out ``(at)``, IPv6, numbers without a
  country code, cards with other separators, ...). They take runs whole, however long; a run of a length that the kind can't have
  is rejected, never cut.
* Labels: a candidate is confirmed if a base span overlaps it, or if its format is valid once it is written plainly:
  ``(at)`` and ``(dot)`` as signs, IPv6 with its eight groups, card digits by their checksum. Phone numbers have no such check, so
  unconfirmed ones are unlabelled rather than wrong.
* Boosting: trees of depth two on yes/no features of format and context learn which candidates are confirmed. The plus sign
  that the base asks of phones is not a feature, so what looks and is placed like
  confirmed numbers scores high without it. Features are yes/no, so all candidates of all rows fold into a table of counts
  with a fixed bound (2 ** 10 cells a kind and fold), on which the trees are fitted exactly.
* Thresholds: rows of one fold in five are held out; a kind's threshold is the lowest score whose calibrated share of true
  candidates, by pooling adjacent violators, reaches the wanted precision; where none does, no span of that kind is added. The share of
  true ones is that of confirmed ones over the share of true ones that get confirmed (Elkan and Noto), which is estimated
  from the held-out confirmed ones and taken to be CONFIRMED at least.

Of overlapping candidates with equal scores the earlier one counts, then the kind listed first. Null texts count as empty: no spans. Repeated rows get the same spans.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callrank.llm.common import unused

KINDS = ("email", "ip", "card", "phone")
PRECISION, CONFIRMED, ROUNDS, RATE, FEWEST = 0.9, 0.8, 25, 0.4, 20

#: The base patterns. A run of local characters, and of digits, is taken whole, which finds the same
#: matches without going back over a long run. \G: a match may also begin where the last one ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9\x20-]*[0-9]",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match. Asked first: byte searches, and patterns only where there are digits at all.
GATE = {
    "email": "contains({t}, '@')",
    "ip": r"{digits} AND {t} RLIKE R'[0-9]\.[0-9]+\.[0-9]'",
    "card": r"{digits} AND {t} RLIKE R'[0-9](?:[\x20-]?[0-9]){{11}}'",
    "phone": r"{digits} AND contains({t}, '+')",
}
LOOSE = {
    "email": r"[\p{L}0-9._%+-]++\x20?(?:@|[(\[{]at[)\]}])\x20?[\p{L}0-9-]++(?:\x20?(?:\.|[(\[{]dot[)\]}])\x20?[\p{L}0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]*+:)++[0-9A-Fa-f]++(?![:.])|(?<![0-9.])[0-9]++(?:\x20?\.\x20?[0-9]++)++",
    "card": r"(?<![0-9])[0-9]{13,19}+(?![0-9])|(?<![0-9])[0-9](?:[\x20./-]{0,2}+[0-9])++",
    "phone": r"[(+]{0,2}+[0-9](?:[\x20()./-]{0,3}+[0-9])++",
}
LOOSE_GATE = {
    "email": "(contains({t}, '@') OR contains({t}, '(at)') OR contains({t}, '[at]') OR contains({t}, '{{at}}'))",
    "ip": r"(contains({t}, ':') AND {t} RLIKE R'[0-9A-Fa-f]:[0-9A-Fa-f]{{0,4}}:' OR "
    r"{digits} AND {t} RLIKE R'[0-9]\x20?\.\x20?[0-9]{{1,3}}\x20?\.')",
    "card": r"{digits} AND {t} RLIKE R'[0-9](?:[\x20./-]{{0,2}}[0-9]){{11}}'",
    "phone": r"{digits} AND {t} RLIKE R'[0-9](?:[\x20()./-]{{0,3}}[0-9]){{6}}'",
}
_DIGITS = "regexp_replace({v}, '[^0-9]', '')"
_LUHN = (
    "aggregate(sequence(1, length({d})), 0, (n, i) -> n + CASE WHEN i % 2 = 1 THEN int(substr(reverse({d}), i, 1)) "
    "WHEN substr(reverse({d}), i, 1) < '5' THEN 2 * int(substr(reverse({d}), i, 1)) "
    "ELSE 2 * int(substr(reverse({d}), i, 1)) - 9 END) % 10 = 0"
).format(d=_DIGITS.format(v="x.v"))
CHECK = {
    "email": "true",
    "ip": "forall(split(x.v, '[.]'), p -> coalesce(try_cast(p AS bigint) <= 255, false))",
    "card": f"CASE WHEN length({_DIGITS.format(v='x.v')}) BETWEEN 12 AND 19 THEN {_LUHN} ELSE false END",
    "phone": f"length({_DIGITS.format(v='x.v')}) BETWEEN 9 AND 15",
}
#: What a candidate x (v: its text) must be, by its kind, to be looked at; and plainly written valid data of its kind.
_PLAIN_EMAIL = r"regexp_replace(regexp_replace(regexp_replace(x.v, R'\x20', ''), R'[(\[{]at[)\]}]', '@'), R'[(\[{]dot[)\]}]', '.')"
_IP4 = r"regexp_replace(x.v, R'\x20', '') RLIKE R'^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$'"
_PARTS = r"forall(split(regexp_replace(x.v, R'\x20', ''), '[.]'), p -> coalesce(try_cast(p AS bigint) <= 255, false))"
_IP6 = (
    r"(x.v RLIKE R'^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$' OR x.v RLIKE R'^(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}$' "
    "AND size(split(x.v, '::')) = 2 AND NOT x.v LIKE '%:::%')"
)
ALLOWED = {
    "email": "true",
    "ip": f"{_IP4} OR x.v LIKE '%:%' AND length(x.v) <= 39",
    "card": f"length({_DIGITS.format(v='x.v')}) BETWEEN 12 AND 19",
    "phone": f"length({_DIGITS.format(v='x.v')}) BETWEEN 7 AND 15",
}
VALID = {
    "email": rf"{_PLAIN_EMAIL} RLIKE R'^[\p{{L}}0-9._%+-]+@[\p{{L}}0-9-]+(?:\.[\p{{L}}0-9-]+)*\.\p{{L}}{{2,}}$' AND x.v NOT LIKE '% %'",
    "ip": f"({_IP4} AND {_PARTS} AND x.v NOT LIKE '% %') OR {_IP6}",
    "card": f"CASE WHEN length({_DIGITS.format(v='x.v')}) BETWEEN 13 AND 19 THEN {_LUHN} ELSE false END",
    "phone": "false",
}
#: Yes/no features of a candidate x (v: its text, b and a: what is before and after it).
FEATURES = {
    "glued_before": r"x.b RLIKE R'[\p{L}0-9_=#/\"\x27]$'",
    "glued_after": r"x.a RLIKE R'^[\p{L}0-9_=#/\"\x27]'",
    "named": r"lower(x.b) RLIKE R'(?:mail|phone|tel|fon|mobile|fax|call|card|karte|carte|tarjeta|visa|host|server|address|contact)'",
    "spaced": r"x.v LIKE '% %'",
    "brackets": "x.v RLIKE R'[()]'",
    "hyphens": "x.v LIKE '%-%'",
    "ten_or_eleven": f"length({_DIGITS.format(v='x.v')}) BETWEEN 10 AND 11",
    "sixteen": f"length({_DIGITS.format(v='x.v')}) = 16",
    "letters": r"x.v RLIKE R'\p{L}'",
    "valid": "x.valid",
}
_EMPTY = "CAST(array() AS array<struct<s:int,e:int,v:string>>)"


def _located(matches: str, pieces: str) -> str:
    """Spans of matches, from the lengths of the pieces between them."""
    return (
        f"IF(size({matches}) = 0, {_EMPTY}, aggregate(sequence(1, size({matches})), named_struct('at', 0, 'out', {_EMPTY}), "
        f"(acc, i) -> named_struct('at', acc.at + length({pieces}[i - 1]) + length({matches}[i - 1]), 'out', concat(acc.out, "
        f"array(named_struct('s', acc.at + length({pieces}[i - 1]), 'e', acc.at + length({pieces}[i - 1]) + "
        f"length({matches}[i - 1]), 'v', {matches}[i - 1])))), acc -> acc.out))"
    )


def _matched(df: DataFrame, text: str, patterns: dict, gates: dict, stem: str, subject: dict) -> DataFrame:
    """``df`` with a column of located matches for each kind."""
    asked = {f"{stem}g_{k}": gates[k].format(t=text, digits="digits__") for k in patterns}
    found = {}
    for kind, pattern in patterns.items():
        t, gate = subject.get(kind, text), f"{stem}g_{kind}"
        found[f"{stem}m_{kind}"] = f"CASE WHEN {gate} THEN regexp_extract_all({t}, R'{pattern}', 0) ELSE array() END"
        found[f"{stem}p_{kind}"] = f"CASE WHEN {gate} THEN split({t}, R'{pattern}', -1) ELSE array() END"
    df = df.withColumns({k: F.expr(v) for k, v in asked.items()})
    df = df.withColumns({k: F.expr(v) for k, v in found.items()})
    spans = {f"{stem}{kind}": F.expr(_located(f"{stem}m_{kind}", f"{stem}p_{kind}")) for kind in patterns}
    return df.withColumns(spans).drop(*found, *asked)


def _text(df: DataFrame, text_col: str, name: str) -> DataFrame:
    df = df.withColumn(name, F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    return df.withColumn("digits__", F.col(name).rlike("[0-9]"))


def _base(df: DataFrame, text: str, stem: str) -> DataFrame:
    """Columns ``{stem}{kind}``: base spans. Blanks that follow each other are masked, as a card has them singly."""
    singly = f"regexp_replace({text}, R'[\\x20-](?=[\\x20-])', '_')"
    df = _matched(df, text, BASE, GATE, stem, {"card": singly})
    return df.withColumns({f"{stem}{k}": F.expr(f"filter({stem}{k}, x -> {CHECK[k]})") for k in KINDS})


def _candidates(df: DataFrame, text: str, stem: str, base: str) -> DataFrame:
    """Columns ``{stem}{kind}``: candidates with features; ``ok``: a base span of the kind overlaps, or the format is valid."""
    df = _matched(df, text, LOOSE, LOOSE_GATE, stem, {})
    whole = {
        k: f"transform(filter({stem}{k}, x -> {ALLOWED[k]}), x -> named_struct('s', x.s, 'e', x.e, 'v', x.v, 'b', substring({text}, "
        f"greatest(x.s - 23, 1), least(24, x.s)), 'a', substring({text}, x.e + 1, 1), "
        f"'valid', {VALID[k]}, 'ok', exists({base}{k}, y -> y.s < x.e AND y.e > x.s)))"
        for k in KINDS
    }
    df = df.withColumns({f"{stem}{k}": F.expr(v) for k, v in whole.items()})
    struct = ", ".join(f"'{n}', {sql}" for n, sql in FEATURES.items())
    return df.withColumns(
        {f"{stem}{k}": F.expr(f"transform({stem}{k}, x -> named_struct('s', x.s, 'e', x.e, 'ok', x.ok OR x.valid, {struct}))") for k in KINDS}
    )


@dataclass
class Booster:
    """Boosted trees of depth two on yes/no features, and the score from which a candidate counts."""

    start: float = 0.0
    trees: list[tuple] = field(default_factory=list)
    threshold: float = math.inf

    def score(self, x: tuple) -> float:
        return self.start + sum(leaves[2 * x[i] + x[j]] for i, j, leaves in self.trees)

    def sql(self) -> str:
        """The log odds of candidate ``x`` in SQL."""
        names = list(FEATURES)
        parts = [f"{self.start!r}D"]
        for i, j, leaves in self.trees:
            no, yes = (f"IF(x.{names[j]}, {leaves[2 * k + 1]!r}D, {leaves[2 * k]!r}D)" for k in (0, 1))
            parts.append(f"IF(x.{names[i]}, {yes}, {no})")
        return " + ".join(parts)


def fit(cells: dict[tuple, tuple[float, float]], held: dict[tuple, tuple[float, float]]) -> Booster:
    """Fit on cells (features -> number, confirmed); the threshold comes from the cells held out."""
    total, yes = sum(n for n, _ in cells.values()), sum(k for _, k in cells.values())
    model = Booster(math.log((yes + 1) / (total - yes + 1)))
    if total < FEWEST:
        return model
    width = len(FEATURES)
    for _ in range(ROUNDS):
        sums = []
        for x, (n, k) in cells.items():
            p = 1 / (1 + math.exp(-model.score(x)))
            sums.append((x, k - n * p, n * p * (1 - p)))
        best = None
        for i in range(width):
            for j in range(i + 1, width):
                g, h = [0.0] * 4, [1.0] * 4
                for x, gradient, weight in sums:
                    g[2 * x[i] + x[j]] += gradient
                    h[2 * x[i] + x[j]] += weight
                gain = sum(a * a / b for a, b in zip(g, h, strict=True))
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, i, j, [RATE * a / b for a, b in zip(g, h, strict=True)])
        if best is None or best[0] < 1e-3:
            break
        model.trees.append((best[1], best[2], [round(v, 6) for v in best[3]]))
    # calibration: confirmed shares of the held-out candidates, made to rise with the score by pooling neighbours
    pools: list[list[float]] = []  # lowest score, number, confirmed
    for score, (n, k) in sorted((model.score(x), nk) for x, nk in held.items()):
        pools.append([score, n, k])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            _, n, k = pools.pop()
            pools[-1][1] += n
            pools[-1][2] += k
    # of the true ones so many are confirmed: the mean confirmed share where confirmed ones are
    seen = sum(k for _, _, k in pools)
    confirmed = max(CONFIRMED, sum(k * k / n for _, n, k in pools) / seen) if seen else 1.0
    fit_enough = [score for score, n, k in pools if min(1.0, (k + 1) / (n + 2) / confirmed) >= PRECISION]
    if fit_enough:
        model.threshold = min(fit_enough) - 1e-9
    return model


def train(df: DataFrame, text_col: str = "text") -> dict[str, Booster]:
    """One booster a kind, from the counts of all candidates of all rows."""
    text = "text__"
    one = _text(df.select(F.col(f"`{text_col}`").alias("given__")), "given__", text)
    found = _candidates(_base(one, text, "base__"), text, "loose__", "base__")
    fold = F.expr(f"pmod(xxhash64({text}), 5L) = 0").alias("held")
    every = ", ".join(
        f"transform(loose__{k}, x -> named_struct('kind', '{k}', 'ok', x.ok, {', '.join(f"'{n}', x.{n}" for n in FEATURES)}))"
        for k in KINDS
    )
    rows = found.select(fold, F.explode(F.expr(f"concat({every})")).alias("x")).select("held", "x.kind", "x")
    names = list(FEATURES)
    counts = rows.groupBy("kind", "held", *[F.col(f"x.{n}").alias(n) for n in names]).agg(
        F.count("*").alias("n"), F.sum(F.col("x.ok").cast("long")).alias("k")
    )
    cells: dict[tuple, dict[tuple, tuple[float, float]]] = {}
    for row in sorted(counts.collect(), key=str):  # 2 ** 13 rows at most
        x = tuple(int(row[n]) for n in names)
        cells.setdefault((row.kind, row.held), {})[x] = (float(row.n), float(row.k))
    return {k: fit(cells.get((k, False), {}), cells.get((k, True), {})) for k in KINDS}


def with_spans(
    df: DataFrame, models: dict[str, Booster] | None = None, text_col: str = "text", out: str = "spans", base: str = "base"
) -> DataFrame:
    """``df`` with ``base`` and ``out``: arrays of (s, kind, e) in order of start, then kind. ``kind`` counts from 0.

    A candidate is added if its score reaches its kind's threshold and it overlaps no base span and no added span of a
    higher score. Columns of those two names are replaced.
    """
    df = df.drop(out, base)
    models = train(df, text_col) if models is None else models
    text = "text__"  # the row is packed, so no name of its columns is in the way
    df = df.select(F.struct("*").alias("row__"), F.col(f"`{text_col}`").alias("given__"))
    df = _base(_text(df, "given__", text), text, "base__")
    used = [k for k in KINDS if models[k].threshold < math.inf]
    parts = ", ".join(
        f"transform(base__{k}, x -> named_struct('s', x.s, 'kind', {i}, 'e', x.e))" for i, k in enumerate(KINDS)
    )
    df = df.withColumn("found__", F.expr(f"array_sort(concat({parts}))"))
    if not used:
        return df.select("row__.*", F.col("found__").alias(base), F.col("found__").alias(out))
    df = _candidates(df, text, "loose__", "base__")
    scored = ", ".join(
        f"filter(transform(loose__{k}, x -> named_struct('score', -({models[k].sql()}), 's', x.s, 'kind', {KINDS.index(k)}, "
        f"'e', x.e)), x -> -x.score >= {models[k].threshold!r}D AND NOT exists(found__, y -> y.s < x.e AND y.e > x.s))"
        for k in used
    )
    df = df.withColumn("added__", F.expr(f"array_sort(concat({scored}))"))
    none = "CAST(array() AS array<struct<s:int,kind:int,e:int>>)"
    chosen = (
        f"aggregate(added__, {none}, (acc, x) -> IF(exists(acc, y -> y.s < x.e AND y.e > x.s), acc, "
        "concat(acc, array(named_struct('s', x.s, 'kind', x.kind, 'e', x.e)))))"
    )
    return df.select("row__.*", F.col("found__").alias(base), F.expr(f"array_sort(concat(found__, {chosen}))").alias(out))


def joined(spans: str) -> str:
    """SQL: the spans as kind:start:end, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat(array({names})[x.kind], ':', x.s, ':', x.e)), ',')"


def redacted(df: DataFrame, models: dict[str, Booster] | None = None, text_col: str = "text") -> DataFrame:
    """``df`` with each span of the text replaced by its kind in brackets; overlapping spans give one mark."""
    spans, base = unused(df, "spans__"), unused(df, "base_spans__")
    found = with_spans(df, models, text_col, spans, base)
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    t = f"`{text_col}`"
    sql = (
        f"CASE WHEN size({spans}) = 0 THEN {t} ELSE aggregate({spans}, named_struct('at', 0, 'out', CAST(array() AS array<string>)), "
        f"(acc, x) -> IF(x.s < acc.at, named_struct('at', greatest(acc.at, x.e), 'out', acc.out), named_struct('at', x.e, 'out', "
        f"concat(acc.out, array(substring({t}, acc.at + 1, x.s - acc.at), array({names})[x.kind])))), "
        f"acc -> concat(array_join(acc.out, ''), substring({t}, acc.at + 1))) END"
    )
    return found.select(*[F.expr(sql).alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])
