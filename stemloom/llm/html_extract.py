"""Main text of web pages: the maximum-scoring subsequence of a page's words and tags.

A page is read as a sequence of words and tags. Words score positive and tags negative, and one
linear scan finds the contiguous region of the largest sum; its blocks are the text. All weights are
learned from labelled pages: how much a tag costs from how seldom it stands inside content, and how
much a word counts from its block elements, by a logistic regression on their tags, the words of their
class, id and role, and how much and what text they hold. Words of an element that is more likely
furniture (a menu, an advert, comments) count as little as the page's markup does, and it is left out
of the region where it lies inside it. No rule names what is furniture; the only fixed lists are of
elements that hold no text, need no end or stand inside a line.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemloom.llm import labelled_pages

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"""[^>"']*""")
_HINTS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_MARKS = re.compile(r"[.,;:!?]")
# Fixed values of the markup language: elements whose content is no text, elements without content, elements inside a line.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg canvas object audio video select".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: What follows them in a name ("has-sidebar", "no-ads") tells of the layout around an element's content.
_MODIFIERS = frozenset("has have with without no".split())
#: Words of furniture cost at most so much, whatever its length: content on both sides of it can be one region.
CROSSING = 20.0
#: Below this chance of content an element is left out at the first look.
SURE = 0.02
#: Fewer words than that are no content of a page.
FEW_WORDS = 2
#: Pages of each family that weights are learned from, and the penalty on squared log-odds.
PAGES, PENALTY = 60, 0.1
TEXT, TAG, MARK = 0, 1, 2


@dataclass
class Element:
    name: str
    words: frozenset[str]
    hidden: bool
    begin: int
    end: int = -1
    n: int = 0
    linked: int = 0
    marks: int = 0
    titles: int = 0
    paragraphs: int = 0
    page: int = 0
    alike: int = 0
    main: str = "none"


@dataclass
class Page:
    """Tokens (kind, value, element of the tag or None) in page order, and the block elements."""

    tokens: list[tuple[int, str]] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)


def _name_words(attributes: str) -> frozenset[str]:
    """The words of class, id and role, without those that only tell of the layout."""
    words: set[str] = set()
    for found in _HINTS.findall(attributes):
        for name in "".join(found).split():
            parts = [x for x in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if x]
            words.update(parts[: next((i for i, x in enumerate(parts) if x in _MODIFIERS), len(parts))])
    return frozenset(words)


class _Ends:
    """Where tags end, in time linear in the page: ">" outside of quotes, or the first ">" where quotes are not closed."""

    def __init__(self, html: str):
        self.html = html
        self.last = {c: html.rfind(c) for c in "\"'>"}
        self.failed: set[int] = set()  # places outside of quotes from which no ">" follows

    def of(self, at: int) -> int:
        if self.last[">"] < at:
            return -1
        start, seen = at, []
        while at not in self.failed:
            seen.append(at)
            stop = _PLAIN.match(self.html, at).end()
            if stop >= len(self.html):
                break
            c = self.html[stop]
            if c == ">":
                return stop + 1
            if self.last[c] <= stop:
                break
            at = self.html.index(c, stop + 1) + 1
        self.failed.update(seen)
        return self.html.index(">", start) + 1


def parse(html: str) -> Page:
    """Text (raw) and tags of a page; a "<" that begins no markup is text."""
    page, size, at, begin = Page(), len(html), 0, 0
    ends, stack, links = _Ends(html), [], 0
    n = linked = marks = titles = paragraphs = 0

    def text(upto: int) -> None:
        nonlocal n, linked, marks
        if upto > begin:
            raw = html[begin:upto]
            k = len(raw.split())
            n, linked, marks = n + k, linked + (k if links else 0), marks + (len(_MARKS.findall(raw)) if k else 0)
            page.tokens.append((TEXT, raw, k))

    def close(item) -> None:
        e, before = item
        if e is not None:
            e.end = len(page.tokens)
            e.n, e.linked, e.marks, e.titles, e.paragraphs = (x - y for x, y in zip((n, linked, marks, titles, paragraphs), before))

    while True:
        lt = html.find("<", at)
        if lt < 0:
            text(size)
            break
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            text(lt)
            if html.startswith((labelled_pages.OPEN, labelled_pages.CLOSE), lt):
                page.tokens.append((MARK, html[lt : lt + 8], 0))
            at = begin = size if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            end = html.find(">", lt) + 1 if ends.last[">"] > lt else -1
            if end < 0:
                at = lt + 1
                continue
            text(lt)
            at = begin = end
            continue
        m = _NAME.match(html, lt)
        end = ends.of(m.end()) if m else -1
        if end < 0:
            at = lt + 1
            continue
        text(lt)
        at = begin = end
        name, attributes = m[2].lower(), html[m.end() : end - 1]
        if m[1]:
            if any(x == name for x, _ in stack):
                while True:
                    x, item = stack.pop()
                    links -= x == "a"
                    close(item)
                    if x == name:
                        break
        elif name in _RAW:
            found = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, end)
            at = begin = found.end() if found else size
            continue
        elif name not in _VOID and not attributes.endswith("/"):
            e = None
            if name not in _INLINE:
                e = Element(name, _name_words(attributes) if attributes.strip() else frozenset(), bool(attributes and _HIDDEN.search(attributes)), len(page.tokens))
                page.elements.append(e)
            stack.append((name, (e, (n, linked, marks, titles, paragraphs))))
            titles += name == "h1"
            paragraphs += name == "p"
            links += name == "a"
        page.tokens.append((TAG, name, 0))
    while stack:
        close(stack.pop()[1])
    named = max((e for e in page.elements if e.name in ("main", "article")), key=lambda e: e.n, default=None)
    for e in page.elements:
        e.page = n
        if named is not None:
            where = "holds" if e.begin < named.begin and e.end >= named.end else "in" if named.begin <= e.begin < named.end else "out"
            e.main = f"{where}-{_bin(named.n / max(1, n), 0.1, 0.4)}"
    _count_alike(page.elements)
    return page


def _count_alike(elements: list[Element]) -> None:
    """``alike``: the words of all elements of an element's tag and name; of itself if it has no name."""
    total: Counter = Counter()
    for e in elements:
        total[e.name, e.words] += e.n
    for e in elements:
        e.alike = min(e.page, total[e.name, e.words]) if e.words else e.n


def _bin(value: float, *edges: float) -> int:
    return sum(value >= x for x in edges)


def features(e: Element) -> Iterator[str]:
    """What an element is judged by: tag, name words, share of the page's words, links, sentences, size, and
    how it lies to the largest main or article element."""
    share = _bin(e.n / max(1, e.page), 0.02, 0.1, 0.3, 0.5, 0.75)
    wide = "wide-" * (e.alike >= 0.6 * e.page)  # a name tells other things of elements that hold the page
    yield f"share:{share}"
    yield f"alike:{_bin(e.alike / max(1, e.page), 0.3, 0.6, 0.85) if e.words else 'no'}"
    yield f"{wide}tag:{e.name}"
    for w in e.words:
        yield f"{wide}word:{w}"
    yield f"links:{(linked := _bin(e.linked / max(1, e.n), 0.01, 0.2, 0.5, 0.8))}"
    yield f"marks:{_bin(e.marks / max(1, e.n), 0.01, 0.05, 0.1)}"
    yield f"size:{_bin(e.n, 5, 15, 50, 200)}"
    yield f"main:{e.main}"
    yield f"titles:{min(e.titles, 2)}"
    yield f"paragraphs:{_bin(e.paragraphs, 1, 3, 8)}"
    yield f"share-links:{share}-{linked}"
    yield f"named:{len(e.words) > 0}-{wide}{share}"


@dataclass
class Weights:
    """Log-odds of content by feature, for two looks at a page, and cost of each tag.

    The second look leaves out of all counts what the first took for furniture beyond doubt, so that a
    long discussion makes no article look small."""

    odds: list[dict[str, float]]
    cost: dict[str, float]
    other: float
    least: float = 0.5

    def content(self, e: Element, look: int = 1) -> float:
        """How likely an element holds content."""
        if e.hidden:
            return 0.0
        odds = self.odds[look]
        z = odds[""] + sum(odds.get(f, 0.0) for f in features(e))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def furniture(self, page: Page) -> list[Element]:
        """The outermost elements that hold no content. Where they would leave next to nothing, the likeliest of them is content after all."""
        sure = _outermost(page.elements, lambda e: self.content(e, 0) < SURE)
        left = _without(page, sure)
        more = _outermost(left, lambda e: self.content(e) < self.least)
        rest = (page.elements[0].page if page.elements else 0) - sum(e.n for e in sure)
        while more and rest - sum(e.n for e in more) < FEW_WORDS:
            more.remove(max(more, key=lambda e: (self.content(e), e.n)))
        return sure + more


def _outermost(elements: list[Element], wanted: Callable[[Element], bool]) -> list[Element]:
    """Of the wanted elements those inside no other; elements come in the order in which they begin."""
    out, upto = [], 0
    for e in elements:
        if e.n and e.begin >= upto and wanted(e):
            out.append(e)
            upto = e.end
    return out


def _without(page: Page, gone: list[Element], itself: bool = False) -> list[Element]:
    """The elements that lie in none of ``gone``, with counts of what lies in none; with ``itself`` those of ``gone`` as well, with their own counts."""
    if not gone:
        return page.elements
    first, last = [e.begin for e in gone], [e.end for e in gone]
    counts = lambda e: (e.n, e.linked, e.marks, e.titles, e.paragraphs)
    sums = [(0,) * 5]
    for e in gone:
        sums.append(tuple(x + y for x, y in zip(sums[-1], counts(e))))
    out, n = [], sums[-1][0]
    for e in page.elements:
        i, j = bisect_right(first, e.begin), bisect_left(first, e.end)
        if i and last[i - 1] > e.begin:  # one of them, or inside one
            if itself and e is gone[i - 1]:
                out.append(replace(e, page=e.page - n + e.n))
            continue
        left = (x - (z - y) for x, y, z in zip(counts(e), sums[i], sums[j]))
        out.append(replace(e, page=e.page - n, **dict(zip(("n", "linked", "marks", "titles", "paragraphs"), left))))
    _count_alike(out)
    return out


def _labels(page: Page) -> list[int]:
    """For each token 1 inside the marked content, else 0."""
    out, inside = [], 0
    for kind, value, _ in page.tokens:
        if kind == MARK:
            inside = int(value == labelled_pages.OPEN)
        out.append(inside)
    return out


def _fitted(rows: list[list[str]], target: list[float]) -> dict[str, float]:
    """Logistic regression on features that occur three times or more."""
    seen = Counter(f for r in rows for f in r)
    place = {f: i + 1 for i, f in enumerate(sorted(f for f, k in seen.items() if k >= 3))}
    x = np.zeros((len(rows), len(place) + 1))
    x[:, 0] = 1
    for i, r in enumerate(rows):
        x[i, [place[f] for f in r if f in place]] = 1
    y, w = np.array(target), np.zeros(x.shape[1])
    for _ in range(12):  # Newton's steps, with a penalty that keeps rare features small
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + PENALTY * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (y - p) - PENALTY * w)
    return {"": float(w[0])} | {f: float(w[i]) for f, i in place.items()}


@lru_cache(2)
def weights(families: tuple[int, ...] = labelled_pages.FITTED) -> Weights:
    """Learned from the labelled pages of the families.

    An element is furniture if none of its words are content. A tag's cost is its share outside content, times a factor;
    the factor and the chance of content below which an element is left out are those under which the
    extracted words are best (the first on ties)."""
    data = [parse(h) for h in labelled_pages.pages(families, PAGES)]
    labels = [_labels(p) for p in data]
    inside, outside = Counter(), Counter()
    found = Weights([], {}, 0.5)
    for look in (0, 1):
        rows, target = [], []
        for page, label in zip(data, labels):
            words = np.cumsum([0] + [k * y for (_, _, k), y in zip(page.tokens, label)])
            elements = page.elements if look == 0 else _without(page, _outermost(page.elements, lambda e: found.content(e, 0) < SURE), True)
            upto = 0
            for e in elements:
                if e.n and e.begin >= upto:
                    rows.append(list(features(e)))
                    target.append(float(words[e.end] > words[e.begin]))
                    upto = upto if target[-1] else e.end  # what lies in furniture shows nothing of its own
        found.odds.append(_fitted(rows, target))
    for page, label in zip(data, labels):
        _, apart = token_scores(page, found)
        for (kind, name, _), y, off in zip(page.tokens, label, apart):
            if kind == TAG and not off:  # the scan has to tell apart what is left
                (inside if y else outside)[name] += 1
    share = {t: (outside[t] + 0.5) / (inside[t] + outside[t] + 1) for t in inside | outside}
    best = (-1.0, found)
    for factor in (0.25, 1, 4):
        for least in (0.5, 0.3, 0.15):
            tried = Weights(found.odds, {t: factor * s for t, s in share.items()}, factor * 0.5, least)
            if (f1 := score(data, tried)) > best[0] + 1e-9:
                best = (f1, tried)
    return best[1]


def score(data: list[Page], by: Weights | None) -> float:
    """Mean over the pages of F1 of extracted against labelled words."""
    out = []
    for page in data:
        a = Counter(w for (kind, value, _), y in zip(page.tokens, _labels(page)) if kind == TEXT and y for w in unescape(value).split())
        b = Counter(" ".join(region(page, by)).split())
        out.append(2 * (a & b).total() / max(1, a.total() + b.total()))
    return sum(out) / max(1, len(out))


def best_region(scores: list[float]) -> tuple[int, int]:
    """[from, to) of the contiguous stretch of the largest sum, the first of equal ones; empty if no sum is positive."""
    total = best = 0.0
    begin, span = 0, (0, 0)
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, span = total, (begin, i + 1)
    return span


def token_scores(page: Page, by: Weights) -> tuple[list[float], list[bool]]:
    """Each token's score, and whether it lies in furniture."""
    furniture = [0] * (len(page.tokens) + 1)
    for e in by.furniture(page):
        furniture[e.begin] += 1
        furniture[e.end] -= 1
    scores, apart, depth, crossed = [], [], 0, 0.0
    for i, (kind, value, k) in enumerate(page.tokens):
        depth += furniture[i]
        apart.append(depth > 0)
        if depth <= 0:
            crossed = 0.0
            scores.append(float(k) if kind == TEXT else -by.cost.get(value, by.other) if kind == TAG else 0.0)
        else:  # words and tags of furniture cost alike, up to a bound
            cost = min(float(k) if kind == TEXT else by.cost.get(value, by.other), CROSSING - crossed)
            crossed += cost
            scores.append(-cost)
    return scores, apart


def region(page: Page, by: Weights | None, scan: bool = True, drop: bool = True) -> list[str]:
    """The text of each block of the best region, decoded, in page order. Without ``by``, of the whole page.

    scan, drop: for measurements, whether to look for the region, and to leave furniture out of it."""
    scores, apart = token_scores(page, by) if by else ([], [False] * len(page.tokens))
    first, last = best_region(scores) if by and scan else (0, len(page.tokens))
    out, held, within = [], [], False

    def close() -> None:
        nonlocal within
        if held and within:
            text = " ".join(unescape("".join(held)).split())
            if text:
                out.append(text)
        held.clear()
        within = False

    for i, (kind, value, k) in enumerate(page.tokens):
        if drop and apart[i]:
            close()
        elif kind == TEXT:
            held.append(value)
            within = within or (k > 0 and first <= i < last)  # a block that reaches into the region is part of it
        elif kind == TAG and value == "br":
            held.append(" ")
        elif kind == TAG and value not in _INLINE:
            close()
    close()
    return out


def main_text(html: str | None, by: Weights | None = None) -> str:
    return "\n\n".join(region(parse(html or ""), by or weights()))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every page, from its whole html.

    Null, empty and word-less html give an empty text. Null ids and urls, repeated rows and other
    columns change nothing, as each row is taken alone; of two regions with equal sums the first
    counts. Very long pages are read in one pass. An empty table gives no rows."""
    learned = weights()  # some hundred numbers, fitted once

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                texts = [main_text(h, learned) for h in some.column("html").to_pylist()]
                yield pa.record_batch([some.column("page_id"), some.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    rows = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(each, f"page_id {kind}, url string, text string, n_chars long")


def extract_query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
