"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

Pages of a host are aligned one after the other with the host's wrapper. Both are nested token streams: an element's
children, with runs and adjacent repeats of the same tags folded into repeated groups. Where a page and the wrapper
disagree, children that only one of them has become optional groups, and text that differs becomes a text slot; text that
all aligned pages share stays as the template's own. Only ``div?``, ``(p)+`` and slots arise, never a union.

Every page is first a wrapper of its own, made where the page is read: signs, hashes and lengths of texts, so the texts themselves
aren't shuffled. Equal pages count once. The others of a host are dealt to chunks by their hash, however many they are; a chunk's
wrappers are aligned into one, and these again, some at a time, until the host has one. A wrapper says where the
article is (the article or main group, else the innermost group that holds most of the slots' text) and, by how many pages
share it, which texts outside of articles are the template's own. What is there is the main text, without menus, headers, footers,
sidebars, forms, scripts, notices, adverts and comments, which are known by tag, role, class or id, and lists of links.

Signs of elements are their tags and names; names with digits are left out, as they number things. Children are aligned by a
longest common subsequence, in long lists between the signs that are unique in both. All walks are loops, so pages may be
nested to any depth. How often a text stands in a group is counted by its hash, in a bounded number of counters: what half of the pages share
is never lost.

Character references are decoded, white space in a block becomes one space, blocks are joined by line breaks. A line break
element is white space. Null pages and pages without text give the empty text. Nothing is cut off. Pages whose URL has no
host share one wrapper. Repeated pages get the same text. Of groups with the same weight the first is the article's place. An
empty table gives no rows; other columns of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callrank.llm.common import strings
from callrank.operators.lookups import lookup_join
from callrank.sources.staging import new_folder, stage

#: Pages of a chunk and wrappers merged at a time, on average; pages that make a text the template's; signs a repeat spans at most.
#: Counters of a group's texts; cells up to which children are aligned by the whole table.
CHUNK, MERGED, FEWEST_PAGES, WIDEST_REPEAT, COUNTERS, CELLS = 64, 16, 4, 4, 8, 20_000

#: Fixed values of HTML and of common naming.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("head script style noscript template svg iframe object canvas audio video select button textarea nav form aside footer menu dialog".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY = {
    "p": BLOCKS - frozenset("td th tr li dd dt caption figcaption legend summary option optgroup tbody thead tfoot body html".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody"]), "th": frozenset(["td", "th", "tr", "tbody"]),
}
#: A closing rule reaches no further up than these.
FENCES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb "
    "breadcrumbs footer header masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup share sharing "
    "social comment comments commentlist disqus respond replies reply related recommended widget pagination pager toolbar login search skip".split()
)


@dataclass
class Element:
    tag: str
    names: frozenset = frozenset()
    role: str = ""
    children: list = field(default_factory=list)  # elements and texts
    sign: str = ""

    def __post_init__(self):
        self.sign = ".".join([self.tag, *sorted(n for n in self.names if n.isalpha())]) if self.names else self.tag


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        for kind, closers in CLOSED_BY.items():
            if tag in closers:
                for k in range(len(self.open) - 1, 0, -1):
                    above = self.open[k].tag
                    if above == kind:
                        del self.open[k:]
                        break
                    if above in FENCES.get(kind, ()) or kind == "p" and above in ("td", "th", "li", "div", "section", "article", "button"):
                        break
        named = dict(attrs)
        words = f"{named.get('class') or ''} {named.get('id') or ''}".lower().replace("_", " ").replace("-", " ").split()
        element = Element(tag, frozenset(words), (named.get("role") or "").lower())
        self.open[-1].children.append(element)
        if tag not in VOID:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and tag not in BLOCKS:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def boilerplate(e: Element) -> bool:
    return e.tag in SKIPPED or e.role in ROLES or bool(e.names & NAMES)


# ---- wrappers ----


@dataclass
class Group:
    """An element of the wrapper: how often it came, optional or repeated, the texts that stood in it, its children."""

    sign: str
    pages: int = 0
    optional: bool = False
    repeated: bool = False
    texts: dict[str, int] = field(default_factory=dict)  # hashes of its own texts: pages that had them, at least
    chars: int = 0  # characters that have stood in it
    children: list[Group] = field(default_factory=list)

    def template(self) -> str | None:
        """The hash of the template's own text: that of most pages, at least of FEWEST_PAGES. None: a slot."""
        text, n = max(self.texts.items(), key=lambda x: (x[1], x[0]), default=("", 0))
        return text if self.pages >= FEWEST_PAGES and 2 * n >= self.pages else None

    def count(self, texts: dict[str, int]) -> None:
        """Add counts of texts; with too many, all lose what the first one too many has (Misra and Gries)."""
        for text, n in texts.items():
            self.texts[text] = self.texts.get(text, 0) + n
        if len(self.texts) > COUNTERS:
            less = sorted(self.texts.values(), reverse=True)[COUNTERS]
            self.texts = {t: n - less for t, n in self.texts.items() if n > less}

    def regex(self) -> str:
        """The wrapper as a union-free expression, to read."""
        out: list[str] = []
        todo: list = [self]
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                out.append(item)
                continue
            mark = "*" if item.optional and item.repeated else "?" if item.optional else "+" if item.repeated else ""
            text = "" if not item.chars else "#text" if item.template() is None else "own"
            out.append(f"{'(' if mark else ''}{item.sign}{{{text}")
            todo.append("}" + (f"){mark}" if mark else ""))
            for k, child in enumerate(reversed(item.children)):
                todo += [child] if k == len(item.children) - 1 else [child, " "]
        return "".join(out)


def _own_text(e: Element) -> str:
    return " ".join(" ".join(c for c in e.children if isinstance(c, str)).split())


def _hash(text: str) -> str:
    """What stands for a text; nothing for the empty one."""
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest() if text else ""


def _runs(e: Element) -> list[tuple[str, list[Element], bool]]:
    """Child elements as (sign, elements, repeated): adjacent repeats of up to WIDEST_REPEAT signs are folded."""
    runs: list[tuple[str, list[Element], bool]] = []
    for child in e.children:
        if isinstance(child, str):
            continue
        sign = child.sign
        for back in range(1, min(WIDEST_REPEAT, len(runs)) + 1):
            if runs[-back][0] == sign:
                runs[-back][1].append(child)
                # the run folds back onto an earlier group: all from there on is a repeated group
                for k in range(len(runs) - back, len(runs)):
                    runs[k] = (runs[k][0], runs[k][1], True)
                break
        else:
            runs.append((sign, [child], False))
    return runs


def _whole_table(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, as pairs of places."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    pairs, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return pairs


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The most of ``pairs`` (by their first place) whose second places rise."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        place = bisect.bisect_left(tails, j)
        back.append(at[place - 1] if place else -1)
        tails[place : place + 1], at[place : place + 1] = [j], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def matched(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of a common subsequence: a longest one, in long lists one through signs that are unique in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i == n or j == m:
            continue
        if (n - i) * (m - j) <= CELLS:
            out += [(i + x, j + y) for x, y in _whole_table(a[i:n], b[j:m])]
            continue
        ours, theirs = Counter(a[i:n]), Counter(b[j:m])
        place = {b[y]: y for y in range(j, m) if theirs[b[y]] == 1}
        anchors = _increasing([(x, place[a[x]]) for x in range(i, n) if ours[a[x]] == 1 and a[x] in place])
        if anchors:
            ends = [*anchors, (n, m)]
            out += anchors
            todo += [(i, anchors[0][0], j, anchors[0][1])]
            todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(ends, ends[1:], strict=False)]
            continue
        # no anchors: each sign takes the next of its kind that is left
        places: dict[str, list[int]] = {}
        for y in range(j, m):
            places.setdefault(b[y], []).append(y)
        for x in range(i, n):
            found = places.get(a[x], [])
            k = bisect.bisect_left(found, j)
            if k < len(found):
                out.append((x, found[k]))
                j = found[k] + 1
    return sorted(out)


def _interleaved(old: list[Group], signs: list[str]) -> list[tuple[Group | None, int | None]]:
    """The wrapper's children and the page's, in one order: what matches together, the wrapper's own before the page's."""
    out: list[tuple[Group | None, int | None]] = []
    i = j = 0
    for x, y in [*matched([g.sign for g in old], signs), (len(old), len(signs))]:
        out += [(g, None) for g in old[i:x]] + [(None, k) for k in range(j, y)]
        if x < len(old):
            out.append((old[x], y))
        i, j = x + 1, y + 1
    return out


def align(wrapper: Group, elements: list[Element]) -> None:
    """Take elements of one page into the group that matches them."""
    todo = [(wrapper, elements)]
    while todo:
        group, elements = todo.pop()
        new = group.pages == 0
        group.pages += 1
        texts = [_own_text(e) for e in elements]
        if texts.count(texts[0]) == len(texts):
            group.count({_hash(texts[0]): 1})
        group.chars += sum(map(len, texts))
        members: dict[int, tuple[Group, list[Element]]] = {}
        for e in elements:
            runs = _runs(e)
            if new:
                group.children = [Group(sign) for sign, _, _ in runs]
                members |= {id(c): (c, list(found)) for c, (_, found, _) in zip(group.children, runs, strict=True)}
                for child, (_, _, repeated) in zip(group.children, runs, strict=True):
                    child.repeated = repeated
                new = False
                continue
            children = []
            for child, k in _interleaved(group.children, [r[0] for r in runs]):
                if child is None:
                    child = Group(runs[k][0], optional=True)  # the wrapper lacks it
                elif k is None:
                    child.optional = True  # the page lacks it
                children.append(child)
                if k is not None:
                    child.repeated |= runs[k][2]
                    members.setdefault(id(child), (child, []))[1].extend(runs[k][1])
            group.children = children
        todo += members.values()


def merge(wrapper: Group, other: Group) -> None:
    """Take another wrapper, which may be used up by it, into ``wrapper``."""
    todo = [(wrapper, other)]
    while todo:
        group, more = todo.pop()
        group.pages += more.pages
        group.chars += more.chars
        group.optional |= more.optional
        group.repeated |= more.repeated
        group.count(more.texts)
        children = []
        for child, k in _interleaved(group.children, [g.sign for g in more.children]):
            if k is None:
                child.optional = True
            elif child is None:
                child = more.children[k]
                child.optional = True
            else:
                todo.append((child, more.children[k]))
            children.append(child)
        group.children = children


def infer(pages: list[str]) -> Group:
    wrapper = Group("#root")
    for html in pages:
        align(wrapper, [parse(html)])
    return wrapper


def _in(place: str, sign: str) -> str:
    """The place of an element in another one: a hash of the signs from the root on, of one length at any depth."""
    return hashlib.blake2b(f"{place}/{sign}".encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _walk(wrapper: Group) -> list[tuple[int, Group]]:
    """All groups with their depth, a group before what is in it."""
    out, todo = [], [(0, wrapper)]
    while todo:
        depth, group = todo.pop()
        out.append((depth, group))
        todo += [(depth + 1, c) for c in reversed(group.children)]
    return out


def dumped(wrapper: Group) -> str:
    rows = [[d, g.sign, g.pages, g.optional, g.repeated, g.texts, g.chars] for d, g in _walk(wrapper)]
    return json.dumps(rows)


def loaded(text: str) -> Group:
    path: list[Group] = []
    for depth, *values in json.loads(text):
        group = Group(*values)
        del path[depth:]
        if path:
            path[-1].children.append(group)
        path.append(group)
    return path[0]


def template_texts(wrapper: Group) -> dict[str, list[str]]:
    """Hashes of the template's own texts, by place."""
    out: dict[str, list[str]] = {}
    above: list[str] = []
    for depth, group in _walk(wrapper):
        del above[depth:]
        above.append(_in(above[-1] if above else "", group.sign))
        if not group.repeated and (text := group.template()):
            out.setdefault(above[-1], []).append(text)
    return out


def _marked(sign: str) -> bool:
    """Whether a sign is boilerplate's."""
    tag, *names = sign.split(".")
    return tag in SKIPPED or bool(NAMES.intersection(names))


def article_place(wrapper: Group) -> str:
    """Where the article is: the outermost article or main group with text, else the innermost group with most slot text."""
    groups = _walk(wrapper)
    weight: dict[int, int] = {}  # characters of slots in a group, boilerplate left out
    for _, g in reversed(groups):
        own = 0 if g.template() is not None else g.chars
        weight[id(g)] = 0 if _marked(g.sign) else own + sum(weight[id(c)] for c in g.children)

    best, place, skipped, path = 0, "", None, []
    for depth, g in groups:
        del path[depth:]
        path.append(g.sign)
        if skipped is not None and depth > skipped:
            continue
        tag, *names = g.sign.split(".")
        skipped = None
        if tag in ("article", "main"):
            skipped = depth  # what is inside is part of it
            size = 0 if _marked(g.sign) else g.chars + sum(weight[id(c)] for c in g.children) + 1
            if size > best:
                best, place = size, "".join(f"/{sign}" for sign in path)
        elif g.sign != "#root" and (tag in ("aside", "form", "template") or NAMES.intersection(names)):
            skipped = depth
    if best:
        return place
    group, place = wrapper, "/#root"
    while group.children:
        heaviest = max(group.children, key=lambda c: weight[id(c)])
        if heaviest.sign.split(".")[0] not in ("html", "body", "div", "section", "center", "table", "tbody", "tr", "td"):
            break
        if not weight[id(heaviest)] or weight[id(heaviest)] < 0.8 * weight[id(group)]:
            break
        group, place = heaviest, f"{place}/{heaviest.sign}"
    return place


# ---- extraction ----


def _roots(e: Element) -> list[Element]:
    """Outermost article and main elements that aren't part of comments, sidebars and the like."""
    found, todo = [], [e]
    while todo:
        here = todo.pop()
        for c in reversed(here.children):
            if isinstance(c, Element):
                if c.tag in ("article", "main") or c.role in ("main", "article"):
                    if not c.names & NAMES:
                        found.append((c, here))
                elif c.tag not in ("aside", "form", "template") and not c.names & NAMES:
                    todo.append(c)
    found = [c for c, _ in found]
    mains = [c for c in found if c.tag == "main" or c.role == "main"]
    inner = [x for m in mains for x in _roots(m)]
    return inner or found


def _length(e: Element, links: bool) -> int:
    total, todo = 0, [(e, False)]
    while todo:
        here, linked = todo.pop()
        for c in here.children:
            if isinstance(c, str):
                total += len(c.strip()) * (linked or not links)
            elif c.tag not in SKIPPED:
                todo.append((c, linked or c.tag == "a"))
    return total


def blocks(root: Element, place: str, template: dict[str, list[str]], whole: bool) -> list[str]:
    """Blocks of text under ``root``, an element at ``place``; ``whole``: it is the article, so only marked boilerplate goes."""
    out: list[str] = []
    pieces: list[str] = []

    def cut() -> None:
        text = " ".join("".join(pieces).split())
        if text:
            out.append(text)
        pieces.clear()

    start = ""
    for sign in place.split("/")[1:]:
        start = _in(start, sign)
    todo: list = [(root, start, False)]
    while todo:
        item, at, closing = todo.pop()
        if isinstance(item, str):
            pieces.append(item)
            continue
        if closing:
            cut()
            continue
        here = _in(at, item.sign) if template else ""
        block = item.tag in BLOCKS
        if item is not root:
            if item.tag == "br":
                pieces.append(" ")
                continue
            if boilerplate(item) or item.tag == "header" and not whole:
                cut()
                continue
            if not whole and item.tag in ("ul", "ol", "div", "p", "td") and sum(1 for _ in _links(item)) >= 3:
                if _length(item, True) > 0.6 * _length(item, False):
                    continue
        if here in template and _hash(_own_text(item)) in template[here]:
            inner = [c for c in item.children if not isinstance(c, str)]
        else:
            inner = item.children
        if block:
            cut()
            todo.append((item, at, True))
        todo.extend((c, here, False) for c in reversed(inner))
    cut()
    return out


def _links(e: Element):
    todo = [e]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, Element):
                if c.tag == "a":
                    yield c
                todo.append(c)


def _at(tree: Element, place: str) -> list[Element]:
    """Elements at a place, in page order."""
    found = [tree] if place.startswith("/#root") else []
    for sign in place.split("/")[2:]:
        found = [c for e in found for c in e.children if isinstance(c, Element) and c.sign == sign]
    return found


def main_text(html: str, place: str = "", template: dict[str, list[str]] | None = None) -> str:
    """The main text by the wrapper's article place and own texts, or by the page's structure where it has no such place.

    Inside an article or main element all unmarked text is the article's, also if pages share it.
    """
    tree, template = parse(html), template or {}
    parent = place.rpartition("/")[0]
    for roots in (_at(tree, place), _roots(tree)):
        found: list[str] = []
        for root in roots:
            if root.tag in ("article", "main"):
                found += blocks(root, parent, {}, whole=True)
            elif root is not tree:
                found += blocks(root, parent, template, whole=False) or blocks(root, parent, {}, whole=False)
        if found:
            return "\n".join(found)
    return "\n".join(blocks(tree, "", template, whole=False) or blocks(tree, "", {}, whole=False))


# ---- Spark ----


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def wrappers(pages: DataFrame) -> DataFrame:
    """``host`` and ``template`` (JSON) for ``pages`` (``host``, ``html``), from all different pages of each host.

    A host's pages are dealt to as many chunks as they need, and its chunks' wrappers merged MERGED at a time, round by
    round: no task holds more of a host than that, on average.
    """
    folder = new_folder(pages.sparkSession)

    def alone(html: pa.Array) -> pa.Array:
        return pa.array([zlib.compress(dumped(infer([page])).encode(), 1) for page in strings(html)], pa.binary())

    hashes = F.xxhash64("html").alias("h1"), F.xxhash64(F.reverse("html"), F.lit(1)).alias("h2")
    each = pages.select("host", *hashes, F.arrow_udf(alone, "binary")("html").alias("page"))
    # copies tell nothing about the template, however many there are
    once = stage(each.groupBy("host", "h1", "h2").agg(F.any_value("page").alias("page")), "pages", folder)
    counts = once.groupBy("host").agg(F.count("*").alias("n"))
    counts = stage(counts.selectExpr("host", f"(n + {CHUNK - 1}L) div {CHUNK}L AS chunks"), "chunks", folder)
    dealt = lookup_join(once, counts, "host", "h1").selectExpr("host", "page", "pmod(h1, chunks) AS chunk", "h1", "h2", "chunks")

    def together(wrappers: list[Group]) -> str:
        for other in wrappers[1:]:
            merge(wrappers[0], other)
        return dumped(wrappers[0])

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        pages = [loaded(zlib.decompress(page)) for page in group.sort_values(["h1", "h2"]).page]
        return group[["host", "chunk", "chunks"]].head(1).assign(wrapper=together(pages))

    def join(group: pd.DataFrame) -> pd.DataFrame:
        wrapper = together(list(map(loaded, group.sort_values("chunk").wrapper)))
        return group[["host", "part", "parts"]].head(1).assign(wrapper=wrapper)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = []
            for wrapper in map(loaded, batch.wrapper):
                read.append(json.dumps({"place": article_place(wrapper), "texts": template_texts(wrapper)}, sort_keys=True))
            yield pd.DataFrame({"host": batch.host, "template": read})

    kind = "host string, chunk long, chunks long, wrapper string"
    now = stage(dealt.groupBy("host", "chunk").applyInPandas(learn, kind), "wrappers0", folder)
    done, level = [now.where("chunks = 1").select("host", "wrapper")], 0
    most = counts.agg(F.max("chunks")).first()[0] or 0  # one number
    while most > 1:
        level, most = level + 1, -(-most // MERGED)
        parts = now.where("chunks > 1").selectExpr(
            "host", "chunk", "wrapper", f"chunk div {MERGED}L AS part", f"(chunks + {MERGED - 1}L) div {MERGED}L AS parts"
        )
        merged = parts.groupBy("host", "part").applyInPandas(join, kind.replace("chunk", "part"))
        now = stage(merged.withColumnsRenamed({"part": "chunk", "parts": "chunks"}), f"wrappers{level}", folder)
        done.append(now.where("chunks = 1").select("host", "wrapper"))
    everything = done[0]
    for table in done[1:]:
        everything = everything.unionAll(table)
    return everything.mapInPandas(finish, "host string, template string")


def extracted(df: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""
    pages = df.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host(F.col(url_col)).alias("host"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    )
    learned = stage(wrappers(pages.select("host", "html")), "wrappers", new_folder(df.sparkSession))

    def read(html: pa.Array, template: pa.Array) -> pa.Array:
        known: dict[str, dict] = {}
        out = []
        for page, text in zip(strings(html), strings(template), strict=True):
            if text not in known:
                known[text] = json.loads(text or "{}")
            out.append(main_text(page, known[text].get("place", ""), known[text].get("texts")))
        return pa.array(out, pa.string())

    # the wrappers are written, so their size is known: broadcast while they are small, else hot hosts are split
    text = F.arrow_udf(read, "string")("html", "template")
    found = lookup_join(pages, learned, "host", "page_id").select("page_id", "url", text.alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
