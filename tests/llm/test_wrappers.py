"""Wrappers: what they decide, that they see all pages, and pages of awkward shapes."""

import random
import time

import pytest

from callrank.llm import wrappers

#: A site whose template names nothing: no article, no known class, and a menu that isn't one by its tags.
SITE = (
    "<html><body><div class=q1><span>Northern Harbour Gazette</span><span>since long ago</span></div>"
    "<div class=q2><div class=zz><p>Board of editors: M. Quill</p></div><div class=yy><h3>{head}</h3>{paragraphs}</div>"
    "<div class=xx><p>Printed on paper, all rights kept.</p></div></div></body></html>"
)


def site(n, rnd):
    paragraphs = [" ".join(rnd.choice("tide salt crane rope quay gull".split()) for _ in range(12)) for _ in range(1 + n % 4)]
    html = SITE.format(head=f"Story {n}", paragraphs="".join(f"<p>{p}</p>" for p in paragraphs))
    return html, "\n".join([f"Story {n}", *paragraphs])


def test_only_the_wrapper_tells_text_from_template():
    rnd = random.Random(1)
    pages = [site(n, rnd) for n in range(30)]
    wrapper = wrappers.infer([html for html, _ in pages])
    place, texts = wrappers.article_place(wrapper), wrappers.template_texts(wrapper)
    assert place.endswith("/div.yy")
    for html, want in pages:
        assert wrappers.main_text(html, place, texts) == want
        assert wrappers.main_text(html) != want


def test_all_pages_of_a_hot_host_are_seen(spark, monkeypatch):
    """Two layouts; the second is on one page in twenty, and most rows are copies of one page of the first."""
    monkeypatch.setattr(wrappers, "CHUNK", 8)
    monkeypatch.setattr(wrappers, "MERGED", 3)
    rnd = random.Random(2)
    rare = "<html><body><div class=other><p>Imprint of the yard</p></div><div class=tt><h4>{}</h4><p>{}</p></div></body></html>"
    pages, want = [], []
    for n in range(200):
        if n % 20 == 0:
            words = " ".join(rnd.choice("oak elm fir ash".split()) for _ in range(9))
            pages.append(rare.format(f"Tree {n}", words))
            want.append(f"Tree {n}\n{words}")
        else:
            html, text = site(n, rnd)
            pages.append(html)
            want.append(text)
    rows = [(i, "https://hot.example/x", html) for i, html in enumerate(pages)]
    rows += [(1000 + i, "https://hot.example/copy", pages[1]) for i in range(300)]
    rows += [(2000 + i, f"https://h{i}.example/", pages[1]) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    got = {r.page_id: r.text for r in wrappers.extracted(df).collect()}
    assert len(got) == len(rows)
    assert sum(got[i] == want[i] for i in range(200) if i % 20) == 190
    assert all(want[i] in got[i] and "Board" not in got[i] for i in range(0, 200, 20))
    assert {got[1000 + i] for i in range(300)} == {want[1]}


@pytest.mark.parametrize("chunks", [1, 2, 5])
def test_merged_wrappers_read_like_one(chunks):
    rnd = random.Random(3)
    pages = [site(n, rnd) for n in range(40)]
    parts = [wrappers.infer([html for html, _ in pages[k::chunks]]) for k in range(chunks)]
    whole = wrappers.loaded(wrappers.dumped(parts[0]))
    for part in parts[1:]:
        wrappers.merge(whole, wrappers.loaded(wrappers.dumped(part)))
    place, texts = wrappers.article_place(whole), wrappers.template_texts(whole)
    assert whole.pages == 40
    assert all(wrappers.main_text(html, place, texts) == want for html, want in pages)
    again = wrappers.loaded(wrappers.dumped(whole))
    assert again.regex() == whole.regex() and "(p{#text})+" in whole.regex()


def test_any_depth_and_many_names():
    start = time.time()
    for n in (700, 5_000, 20_000):
        deep = "<div>" * n + "core" + "</div>" * n
        wrapper = wrappers.infer([deep, deep.replace("core", "other"), "<div>" * (n // 2) + "x"])
        assert wrappers.loaded(wrappers.dumped(wrapper)).pages == 3
        assert wrappers.main_text(deep, wrappers.article_place(wrapper), wrappers.template_texts(wrapper)) == "core"
        assert len(wrapper.regex()) > 5 * n
    words = ["".join(random.Random(k).choices("abcdefghijklmnop", k=9)) for k in range(20_000)]
    first, second = ("".join(f"<p id={w}>t {w}</p>" for w in order) for order in (words, words[7_000:] + words[:7_000]))
    numbered = "".join(f"<p id=p{k}>t</p>" for k in range(20_000))
    wrapper = wrappers.infer([first, second, numbered, numbered])
    assert len(wrapper.children) >= 20_000
    assert time.time() - start < 60


def test_matched_is_a_common_subsequence(monkeypatch):
    rnd = random.Random(4)
    for cells in (20_000, 0):
        monkeypatch.setattr(wrappers, "CELLS", cells)
        for _ in range(200):
            a, b = ([rnd.choice("abcdefghij") for _ in range(rnd.randrange(12))] for _ in range(2))
            pairs = wrappers.matched(a, b)
            assert all(a[i] == b[j] for i, j in pairs)
            assert all(x < y and u < v for (x, u), (y, v) in zip(pairs, pairs[1:]))
            if cells:
                best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
                for i in range(len(a)):
                    for j in range(len(b)):
                        best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (a[i] == b[j]))
                assert len(pairs) == best[-1][-1]


def test_counters_keep_what_most_pages_share():
    group = wrappers.Group("p", pages=1000)
    for k in range(1000):
        group.count({"shared" if k % 2 else f"other {k}": 1})
    assert len(group.texts) <= wrappers.COUNTERS and max(group.texts, key=group.texts.get) == "shared"
