"""Base spans against plain regular expressions, added spans and redaction."""

import random
import re

import pytest

from callrank.llm import pii

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    doubled = [c if i % 2 == 0 else 2 * c - 9 * (c > 4) for i, c in enumerate(map(int, reversed(digits)))]
    return sum(doubled) % 10 == 0


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


NO_MODELS = {k: pii.Booster() for k in pii.KINDS}


def test_base_against_plain_patterns(spark, documents):
    rnd = random.Random(8)
    parts = ["q@r.st", "@", ".", "com", "9.8.7.6", "256.1.1.1", "4012 8888 8888 1881", "4012-8888--8888 1881", "+44 (20) 7946-0018",
             "é😀", " ", "-", "7", "42", "q@r.st_y@c.de", "5105105105105100", "\n", "123456789", "+", "1 2 3 4 5 6 7 8 9 0 1 2"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(800)]
    texts += [None, "", "9" * 20000, "1 2" * 9000, "a" * 30000, "a." * 9000 + "@", "0" * 40 + "1.2.3.4"]
    got = {r.doc_id: r.s for r in pii.with_spans(documents(texts), NO_MODELS).selectExpr("doc_id", pii.joined("base") + " s").collect()}
    for i, text in enumerate(texts):
        assert got[i] == plain(text or ""), repr(text)[:200]


def test_added_spans_keep_the_base_and_are_learned(spark, documents):
    rnd = random.Random(9)
    texts = []
    for _ in range(600):
        number = f"({rnd.randint(100, 999)}) {rnd.randint(200, 999)}-{rnd.randint(1000, 9999)}"
        texts.append(f"please call +1 {number} today" if rnd.random() < 0.97 else f"please call {number} today")
        texts.append(f"order {rnd.randint(10**7, 10**8)} came")
    df = documents(texts)
    models = pii.train(df)
    rows = pii.with_spans(df, models).selectExpr("text", pii.joined("base") + " b", pii.joined("spans") + " s").collect()
    assert all(set(r.b.split(",")) <= set(r.s.split(",")) for r in rows if r.b)
    without_plus = [r for r in rows if r.text.startswith("please call (")]
    assert without_plus and all(r.s.startswith("phone:12:") for r in without_plus)
    assert not any(r.s for r in rows if r.text.startswith("order"))


def test_redaction(spark, documents):
    df = documents(["mail q@r.st or +44 20 7946 0018!", None, "", "plain"]).selectExpr("*", "1 AS spans", "2 AS digits__")
    got = {r.doc_id: r.text for r in pii.redacted(df, NO_MODELS).collect()}
    assert got == {0: "mail [EMAIL] or [PHONE]!", 1: None, 2: "", 3: "plain"}
    assert pii.redacted(df, NO_MODELS).columns == df.columns
    assert pii.redacted(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, documents):
    plan = pii.redacted(documents(["q@r.st"]), NO_MODELS)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("rows", [0, 30])
def test_booster_without_data_adds_nothing(rows):
    x = tuple([0] * len(pii.FEATURES))
    assert pii.fit({x: (rows, 0)} if rows else {}, {}).threshold == float("inf")


def planted(seed, many=1200):
    """Texts with one planted span each (kind, value) or none: half of emails, addresses and cards are in forms that the base can't see."""
    rnd = random.Random(seed)

    def card(separator):
        digits = [rnd.randint(0, 9) for _ in range(15)]
        digits.append(next(d for d in range(10) if luhn("".join(map(str, [*digits, d])))))
        return separator.join("".join(map(str, digits[i : i + 4])) for i in range(0, 16, 4))

    out = []
    for i in range(many):
        word = "".join(rnd.choices("abcdefghij", k=7))
        number = f"{rnd.randint(200, 999)} {rnd.randint(1000, 9999)} {rnd.randint(100, 999)}"
        kind, value = rnd.choice([
            ("email", f"{word}@mail.example.org"), ("email", f"{word}(at)mail(dot)example(dot)org"),
            ("ip", ".".join(str(rnd.randint(0, 255)) for _ in range(4))), ("ip", ":".join(f"{rnd.randint(0, 65535):x}" for _ in range(8))),
            ("card", card(" ")), ("card", card("/")),
            ("phone", f"+49 {number}"), ("phone", f"+44 {number}"), ("phone", f"+1 {number}"), ("phone", f"0{rnd.randint(10, 99)} {number}" if i % 2 else f"+7 {number}"),
            (None, f"{rnd.randint(0, 23)}:{rnd.randint(10, 59)}:{rnd.randint(10, 59)}"), (None, f"{rnd.randint(1990, 2030)}-0{rnd.randint(1, 9)}-{rnd.randint(10, 28)}"),
            (None, f"{rnd.randint(0, 10**19):020d}{rnd.randint(0, 10**19):020d}"), (None, f"v{i}.{rnd.randint(256, 999)}.1.2"), (None, f"#{rnd.randint(10**7, 10**8 - 1)}"),
        ])
        lead = {"phone": "please call", None: "lot no"}.get(kind, "reach us at")
        out.append((f"{lead} {value} or so, {word} {i}", kind, value))
    return out


def test_common_forms_that_the_base_cannot_see(spark, documents):
    rows = planted(3)
    df = documents([text for text, _, _ in rows])
    found = pii.with_spans(df, pii.train(df)).selectExpr("doc_id", "text", "spans").collect()
    hit = wrong = wanted = 0
    for r in found:
        text, kind, value = rows[r.doc_id]
        spans = {(pii.KINDS[x.kind], text[x.s : x.e]) for x in r.spans}
        wanted += kind is not None
        hit += (kind, value) in spans
        wrong += len(spans - {(kind, value)})
    assert hit >= 0.95 * wanted and wrong <= 0.05 * hit


def test_no_digit_of_a_long_number_stays_half_redacted(spark, documents):
    rows = planted(4, 600)
    texts = [text for text, _, _ in rows]
    texts += ["pay 4465758382889437 4465758382889437 now", "4012/8888/8888/1881 " * 3, "7" * 500, "1 " * 300, "12-" * 400]
    df = documents(texts)
    got = {r.doc_id: r.text for r in pii.redacted(df, pii.train(df)).collect()}
    for i, text in enumerate(texts):
        assert not re.search(r"[0-9]\[(CARD|PHONE)\]|\[(CARD|PHONE)\][0-9]", got[i]), got[i]
        for run in re.findall("[0-9]+", got[i]):
            assert run in re.findall("[0-9]+", text)


def test_added_spans_against_a_plain_version(spark, documents):
    """Generators, features, trees and choice in plain Python, on the trained models."""
    import regex

    def plain_added(text, models):
        base = [(int(s), int(e)) for s, e in (x.split(":")[1:] for x in plain(text).split(",") if x)]
        scored = []
        for k, kind in enumerate(pii.KINDS):
            for m in regex.finditer(pii.LOOSE[kind], text):
                v, digits = m[0], re.sub("[^0-9]", "", m[0])
                four = re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", v.replace(" ", ""))
                allowed = {"email": True, "ip": bool(four) or ":" in v and len(v) <= 39, "card": 12 <= len(digits) <= 19, "phone": 7 <= len(digits) <= 15}
                if not allowed[kind]:
                    continue
                email = re.sub(r"[(\[{]dot[)\]}]", ".", re.sub(r"[(\[{]at[)\]}]", "@", v))
                six = re.fullmatch("([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}", v) or (
                    re.fullmatch("([0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}", v) and v.count("::") == 1 and ":::" not in v
                )
                valid = {
                    "email": bool(regex.fullmatch(r"[\p{L}0-9._%+-]+@[\p{L}0-9-]+(\.[\p{L}0-9-]+)*\.\p{L}{2,}", email)),
                    "ip": bool(four and " " not in v and all(int(p) <= 255 for p in v.split("."))) or bool(six),
                    "card": 13 <= len(digits) <= 19 and luhn(digits),
                    "phone": False,
                }[kind]
                before, after = text[max(0, m.start() - 24) : m.start()], text[m.end() : m.end() + 1]
                near = regex.compile(r"""[\p{L}0-9_=#/"']""")
                x = (
                    bool(before and near.match(before[-1])), bool(after and near.match(after)),
                    bool(re.search("mail|phone|tel|fon|mobile|fax|call|card|karte|carte|tarjeta|visa|host|server|address|contact", before.lower())),
                    " " in v, bool(re.search("[()]", v)), "-" in v, 10 <= len(digits) <= 11, len(digits) == 16, bool(regex.search(r"\p{L}", v)), valid,
                )
                score = models[kind].score(tuple(map(int, x)))
                if score >= models[kind].threshold and not any(s < m.end() and e > m.start() for s, e in base):
                    scored.append((-score, m.start(), k, m.end()))
        chosen = []
        for _, s, k, e in sorted(scored):
            if not any(a < e and b > s for a, _, b in chosen):
                chosen.append((s, k, e))
        return {f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in chosen}

    texts = [text for text, _, _ in planted(5, 700)] + ["a(at)b(dot)de", "::1 fe80::1 1::2::3 12:30:00", "4465758382889437 4465758382889437"]
    df = documents(texts)
    models = pii.train(df)
    rows = pii.with_spans(df, models).selectExpr("doc_id", pii.joined("spans") + " AS s", pii.joined("base") + " AS b").collect()
    added = 0
    for r in rows:
        got = {x for x in r.s.split(",") if x} - {x for x in r.b.split(",") if x}
        assert got == plain_added(texts[r.doc_id], models), texts[r.doc_id]
        added += len(got)
    assert added > 50


def test_query(spark, sf_dir):
    """The registered query: base spans as plain patterns give them, all of them kept."""
    import hashlib

    from callrank.llm import queries

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op6_pii(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        want = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        spans = [x for x in r.spans.split(",") if x]
        assert set(x for x in want.split(",") if x) <= set(spans)
        assert [sum(x.startswith(f"{k}:") for x in spans) for k in pii.KINDS] == [r.n_email, r.n_ip, r.n_card, r.n_phone]
