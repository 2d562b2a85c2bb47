"""HTML extraction: the maximum-scoring subsequence of a page's words and tags.

A page is a sequence of tags and words.  Words score positive and tags negative, with
weights learned from labelled pages: pages that mark their article with an ``article`` or
``main`` element serve as labels, and a weight is the log odds of the token's class inside
against outside that element (whichever holds most of the text), drawn towards a default where there are few.  One linear scan
finds the contiguous region of the highest total; its blocks are the text.  Where a page marks
its article, words inside weigh positive and tags nothing, so the region spans all of it.

Parts that are no text of the article by their element (menus, headers of the page, footers,
sidebars, forms), and elements that names (class, id, role) set apart, weigh nothing and are left
out.  Names are features: each part of a name weighs by how often it was seen in and outside
marked articles, with a prior for the listed ones, and an element goes only if the weights of its
names say so and enough of the page's text is left without it; prose stays under names that parts of
an article have too.  A form that wraps the page is no reason to drop it.

Defined cases: null, empty and tag-only html gives an empty text; unclosed, stray and cut
tags are read much as a browser would, in one linear pass (a tag cut off at the end of the page
is dropped, a menu or sidebar that is never closed is not heeded); where everything would go,
names are not heeded, then elements neither; of regions with equal scores the first is taken;
repeated rows give equal texts; pages with a null id count as one in the fitting sample; a very
long page is read whole; an empty table gives no rows; without labelled pages the default
weights hold.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: HTML element classes.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "select", "desc", "metadata", "annotation", "annotation-xml")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
BLOCKS = (
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul"
).split()
CELLS = ("br", "td", "th")
NEVER = ("head", "nav", "menu", "footer", "aside", "form", "button", "dialog", "fieldset", "datalist", "label", "audio", "video", "canvas")
CONTAINERS = ("article", "main")
#: Of these, elements that may hold a page's article too, where hardly any text is outside of them.
WRAPPERS = frozenset(("form", "fieldset", "label", "dialog"))
#: An end tag doesn't reach beyond these, and a start tag of the first ends an open one of the others up to its walls.
SCOPES = ("table", "td", "th", "caption")
ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "tbody": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead")}
PASSED = frozenset(("li", "div", "p", "address", "dd", "dt", "option", "td", "th", "tr", "tbody", "thead", "tfoot"))
#: Parts of class, id, role and aria-label values that name what is not the article, what is, and what only describes a layout.
NEVER_NAMED = (
    "ad ads adbox adsense advert advertisement advertising advertorial banner sponsor sponsored promo promotion promotional "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar topbar masthead sidebar aside rail widget complementary contentinfo "
    "footer header cookie cookies consent gdpr notice alert modal popup overlay disclaimer newsletter subscribe subscription signup login search form "
    "comment comments disqus respond reply replies discussion reactions share sharing social related recommended recommendations teaser teasers outbrain taboola skip"
).split()
CONTENT_NAMED = "article content main post entry story body text page prose wrapper container layout".split()
#: Of the first, names that parts of an article have too: prose under them stays.
EITHER_NAMED = frozenset(("discussion", "search"))
LAYOUT_NAMED = "with without has no long short free two left right column col cols".split()

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)",
    re.S,
)
NAMES = re.compile(r"\b(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")

_NEVER, _BLOCKS, _RAW, _VOID, _LAYOUT, _SCOPES = map(frozenset, (NEVER, BLOCKS, RAW, VOID, LAYOUT_NAMED, SCOPES))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Prior weights of names, and the weight from which an element is set apart.
PRIOR = {**dict.fromkeys(NEVER_NAMED, -2.0), **dict.fromkeys(CONTENT_NAMED, 2.0)}
APART = -1.0


def hidden(attributes: str) -> bool:
    """An element that isn't shown, by the names of its attributes, its aria-hidden or its style."""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value.strip() == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def name_tokens(attributes: str) -> list[list[str]]:
    """The names of an element, each in its parts."""
    out = []
    for m in NAMES.finditer(attributes):
        split = re.sub(r"([a-z])([A-Z])", r"\1-\2", m[2] or m[3] or m[4] or "").lower()
        out += [parts for x in split.split() if (parts := [p for p in re.split(r"[^a-z]+", x) if p])]
    return out


def names_weight(attributes: str, weights: dict[str, float], inside: bool) -> float:
    """What the names of an element say: the worst part of each name counts, names that describe a layout don't (``inside`` an article, a header is its own)."""
    total = 0.0
    for parts in name_tokens(attributes):
        if len(parts) > 1 and not _LAYOUT.isdisjoint(parts[:-1]):
            continue
        at = [weights.get(p, PRIOR.get(p, 0.0)) for p in parts if not (inside and p == "header")]
        total += min(at, default=0.0) if min(at, default=0.0) < 0 else max(at, default=0.0)
    return total


class Token(NamedTuple):
    """A tag (``text`` is None) or a run of text, with where it stands."""

    name: str
    text: str | None
    block: str
    link: bool
    never: int  # number of the innermost element that its kind rules out, 0 outside of such
    named: int  # number of the outermost element that names set apart, 0 outside of such
    held: int  # inside an article element (1), a main one (2), or both


class Stack:
    """Open elements, with the places of each name, of blocks and of walls, so that no tag has to look through them."""

    def __init__(self):
        self.open: list[tuple[str, int, int]] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.walls: list[int] = []
        self.scopes: list[int] = []
        self.never, self.named = [], []

    def push(self, name: str, never: int, named: int) -> None:
        i = len(self.open)
        self.open.append((name, never, named))
        self.at[name].append(i)
        if never:
            self.never.append(never)
        if named:
            self.named.append(named)
        if name in _BLOCKS:
            self.blocks.append(i)
            if name not in PASSED:
                self.walls.append(i)
        if name in _SCOPES:
            self.scopes.append(i)

    def _leave(self, i: int) -> None:
        name, never, named = self.open[i]
        if name:
            self.at[name].pop()
            for places, number in ((self.never, never), (self.named, named)):
                if number:
                    places.remove(number) if places[-1] != number else places.pop()

    def close(self, to: int) -> None:
        """Close all elements from place ``to`` on."""
        while len(self.open) > to:
            self._leave(len(self.open) - 1)
            self.open.pop()
        for places in (self.blocks, self.walls, self.scopes):
            while places and places[-1] >= to:
                places.pop()

    def last(self, *names: str) -> int:
        return max((self.at[n][-1] for n in names if self.at[n]), default=-1)

    def end(self, name: str) -> None:
        """An end tag: closes the last open element of the name; an inline one leaves blocks inside it open."""
        i = self.last(name)
        if i < 0 or name not in _SCOPES and self.scopes and self.scopes[-1] > i and name not in ("tr", "tbody", "thead", "tfoot"):
            return
        if name not in _BLOCKS and self.blocks and self.blocks[-1] > i:
            self._leave(i)
            self.open[i] = ("", 0, 0)
        else:
            self.close(i)

    def start(self, name: str) -> None:
        """What a start tag ends by itself: paragraphs, list items, cells and their like, headings, links."""
        if self.at["head"]:
            self.close(self.last("head"))
        if name in _BLOCKS:
            p = self.last("p")
            if p >= 0 and self.blocks[-1] == p:
                self.close(p)
            if name in ENDS:
                i = self.last(*ENDS[name])
                if i >= 0 and (not self.walls or self.walls[-1] < i):
                    self.close(i)
            elif name in _HEADINGS and self.blocks and self.open[self.blocks[-1]][0] in _HEADINGS:
                self.close(self.blocks[-1])
        elif name == "a":
            self.end("a")

    def block(self) -> str:
        return self.open[self.blocks[-1]][0] if self.blocks else ""


@dataclass
class Parts:
    """The numbered elements that may be left out: what each is inside of (kind), and whether it may wrap an article (kind) or its names may be an article's (names)."""

    inside: list[int] = field(default_factory=lambda: [0])
    wraps: list[bool] = field(default_factory=lambda: [False])
    either: dict[int, bool] = field(default_factory=dict)


def tokens(page: str | None, names: dict[str, float] | None = None, elements: bool = True, parts: Parts | None = None) -> Iterator[Token]:
    """Tags and texts in page order, one linear pass; ``names`` are the weights of names (None: not heeded)."""
    if not page:
        return
    low, parts = page.lower(), parts or Parts()
    closes: dict[str, int] = {}
    stack, at, n, apart = Stack(), 0, len(page), 0
    held = lambda: bool(stack.at["article"]) + 2 * bool(stack.at["main"])
    never_in = lambda: stack.never[-1] if stack.never else 0
    while at < n:
        m = TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at:
            yield Token("", page[at:end], stack.block(), bool(stack.at["a"]), never_in(), stack.named[0] if stack.named else 0, held())
        if not m:
            return
        at = m.end()
        name = m[2] or m[6]
        if not name:
            continue
        name, closing, attributes = name.lower(), bool(m[1] or m[5]), m[3] or m[7] or ""
        if not (m[4] or m[8]):
            return  # a tag that the page's end cuts off
        if name in _RAW and not closing:
            if not attributes.endswith("/"):
                over = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = over.end() if over else n
            continue
        if closing:
            stack.end(name)
        elif name not in _VOID:
            stack.start(name)
            inside = held() > 0
            ruled = elements and (name in _NEVER or name == "header" and not inside)
            if ruled and name != "head":
                if name not in closes:
                    closes[name] = low.rfind(f"</{name}")
                ruled = closes[name] >= at  # one that is never closed can't tell where it ends
            unseen = elements and bool(attributes) and hidden(attributes)
            never = named = 0
            if ruled or unseen:
                never = len(parts.inside)
                parts.inside.append(never_in())
                parts.wraps.append(name in WRAPPERS and not unseen)
            if names is not None and attributes and not stack.named and name not in ("html", "body", *CONTAINERS[:1]) and names_weight(attributes, names, inside) <= APART:
                apart += 1
                named = apart
                worst = {p for x in name_tokens(attributes) for p in x if names.get(p, PRIOR.get(p, 0.0)) < 0}
                parts.either[named] = worst <= EITHER_NAMED
            stack.push(name, never, named)
        yield Token(f"/{name}" if closing else name, None, "", False, never_in(), stack.named[0] if stack.named else 0, held())


def _counts(t: Token) -> int:
    """The words of a text outside of links."""
    return 0 if t.text is None or t.link else len(t.text.split())


def seen_tokens(page: str | None, names: dict[str, float] | None = None, elements: bool = True) -> tuple[list[Token], Parts]:
    """All tokens of a page, with ``never`` 0 in a wrapper that hardly any text is outside of, and ``held`` for the element that marks the article."""
    parts = Parts()
    seen = list(tokens(page, names, elements, parts))
    if any(parts.wraps):
        in_wrap = let_in(seen, parts)
        seen = [t._replace(never=0) if t.never in in_wrap else t for t in seen] if in_wrap else seen
    bit = container_of(seen)
    return [t._replace(held=int(t.held & bit > 0)) if t.held else t for t in seen], parts


def let_in(seen: list[Token], parts: Parts) -> set[int]:
    """Wrappers that are not left out: fewer words are outside than fifty and a fifth of their own; then what is ruled out in them by itself still is."""
    own = [0] * len(parts.inside)
    for t in seen:
        own[t.never] += _counts(t)
    total = own[:]
    for k in range(len(own) - 1, 0, -1):
        total[parts.inside[k]] += total[k]
    rest, kept = own[0], {0}
    for k in range(1, len(own)):
        if parts.wraps[k] and parts.inside[k] in kept and total[k] and rest < max(1, min(50, 0.2 * total[k])):
            kept.add(k)
            rest += own[k]
    return kept - {0}


def container_of(seen: list[Token]) -> int:
    """Which element marks the article of a page: 1 for article ones, 2 for main, where they hold half as much as those or more; 0 where none holds enough to be it."""
    words: Counter = Counter()
    for t in seen:
        if not t.never and not t.named:
            words[t.held] += _counts(t)
    by = {1: words[1] + words[3], 2: words[2] + words[3]}
    every = sum(words.values())
    bit = 1 if by[1] and by[1] >= 0.5 * by[2] else 2 if by[2] else 0
    if not bit:  # nothing but links, or names that are not to be heeded: any that has text
        return next((b for b in (1, 2) if any(t.held & b and t.text is not None and not t.text.isspace() for t in seen)), 0)
    return bit if by[bit] >= min(50, 0.2 * (every - by[bit])) else 0


def kind(t: Token) -> str:
    """The class of a token that carries its weight."""
    if t.text is None:
        return f"<{t.name}>"
    return "link" if t.link else f"word:{t.block if t.block in _WORD_BLOCKS else 'other'}"


_WORD_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre div article section dd dt tr td figcaption".split())


@dataclass
class Weights:
    """A positive score for each class of words and a negative one for each tag; weights of names."""

    by: dict[str, float] = field(default_factory=dict)
    names: dict[str, float] = field(default_factory=dict)

    def of(self, name: str) -> float:
        return self.by.get(name, default_weight(name))


def default_weight(name: str) -> float:
    return -0.5 if name[0] == "<" else {"link": 0.1, "word:h1": 3.0}.get(name, 1.0)  # a title of one word outweighs the tags up to the text


def extract(page: str | None, weights: Weights) -> str:
    """The text of the best region of one page; where that is empty, names are not heeded, then elements neither."""
    for names, elements in ((weights.names, True), (None, True), (None, False)):
        if text := text_of(best_region(*seen_tokens(page, names, elements), weights)):
            return text
    return ""


def left_out(seen: list[Token], parts: Parts) -> set[int]:
    """Numbers of the elements that names set apart and that are left out.

    Enough other text must remain.  Prose (forty words a block) stays under names that parts of an article have
    too, and so does the only main heading, in an element that has no other text.
    """
    words, blocks, heads, other = Counter(), defaultdict(set), Counter(), Counter()
    block = 0
    text = []
    for t in seen:
        if t.text is None:
            block += t.name.lstrip("/") in _BLOCKS
        elif not t.never and not t.text.isspace():
            (heads if t.block == "h1" else other)[t.named] += 1
            if not t.link:
                text.append(t)
                if t.block not in _HEADINGS:
                    blocks[t.named].add(block)
    marked = any(t.held and not t.named for t in text)
    prose: Counter = Counter()
    for t in text:
        if t.held or not marked:
            words[t.named] += len(t.text.split())
        if t.block not in _HEADINGS:
            prose[t.named] += len(t.text.split())
    out = {k for k in {t.named for t in seen} - {0} if words[0] >= max(1, min(50, 0.2 * words[k]))}
    out -= {k for k in out if parts.either.get(k) and blocks[k] and prose[k] >= 40 * len(blocks[k])}
    title = [k for k in heads if k in out and not other[k]]
    return out - set(title) if len(title) == 1 and not any(heads[k] for k in heads if k not in title) else out


def best_region(seen: list[Token], parts: Parts, weights: Weights) -> list[Token]:
    """The tokens of the contiguous region with the highest total score, without the parts left out."""
    out = left_out(seen, parts)
    held = any(t.held and t.text is not None and not t.never and t.named not in out and not t.text.isspace() for t in seen)
    best, start, total = (0.0, 0, 0), 0, 0.0
    for at, t in enumerate(seen):
        if t.never or t.named in out:
            continue  # no text of the page, and nothing that parts it
        w = weights.of(kind(t))
        if t.text is not None:
            w *= len(t.text.split())
        if held:
            w = (max(w, 0.0) if t.text is not None else 0.0) if t.held else -abs(w)  # the page says where its article is
        total += w
        if total <= 0:
            total, start = 0.0, at + 1
        elif total > best[0]:
            best = (total, start, at + 1)
    return [t for t in seen[best[1] : best[2]] if not t.never and t.named not in out and (t.held or not held)]


def text_of(region: list[Token]) -> str:
    """The blocks of a region: references decoded, white space collapsed, one line each."""
    out, block = [], []

    def flush() -> None:
        text = " ".join(_html.unescape("".join(block)).split())
        if text:
            out.append(text)
        block.clear()

    for t in region:
        if t.text is not None:
            block.append(t.text)
        elif (name := t.name.lstrip("/")) in CELLS:
            block.append(" ")
        elif name in _BLOCKS:
            flush()
    flush()
    return "\n".join(out)


def named_words(page: str | None, bit: int) -> Iterator[tuple[str, bool, int]]:
    """(part of a name, inside the marked article, words) of the innermost and the outermost named element of each text of a page."""
    container = {1: "article", 2: "main"}.get(bit, "")
    stack, names, at = Stack(), {}, 0
    for m in TOKEN.finditer(page or ""):
        words, at = len(page[at : m.start()].split()), m.end()
        inside = bool(container) and bool(stack.at[container])
        for part in {p for k in stack.named[:1] + stack.named[-1:] for p in names[k]}:
            if words:
                yield part, inside, words
        name, attributes = (m[2] or m[6] or "").lower(), m[3] or m[7] or ""
        if not name or name in _VOID:
            continue
        if m[1] or m[5]:
            stack.end(name)
            continue
        stack.start(name)
        parts = {p for x in name_tokens(attributes) for p in x} if name not in ("html", "body", *CONTAINERS) else set()
        number = len(names) + 1 if parts else 0
        if parts:
            names[number] = parts
        stack.push(name, 0, number)


def fit(pages: DataFrame, sample: int = 2000) -> Weights:
    """Weights from at most ``sample`` pages (in md5 order of the id; of an id's rows the first by html) that mark their article."""
    marked = pages.select("page_id", "html").where(F.col("html").rlike("(?i)<(article|main)[ >]"))
    ids = marked.select("page_id").distinct().orderBy(common.stable_order("page_id"), "page_id").limit(sample)
    some = marked.join(F.broadcast(ids), marked["page_id"].eqNullSafe(ids["page_id"]), "left_semi").groupBy("page_id").agg(F.min("html").alias("html"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both: tuple[Counter, Counter] = (Counter(), Counter())
            for page in batch["html"]:
                seen = seen_tokens(page, {})[0]
                bit = container_of(list(tokens(page, {})))
                for t in seen:
                    if not t.never and not t.named:
                        both[not t.held][kind(t)] += 1 if t.text is None else len(t.text.split())
                for part, inside, words in named_words(page, bit):
                    both[not inside][f"name:{part}"] += words
            rows = [(k, both[0][k], both[1][k]) for k in {*both[0], *both[1]}]
            yield pd.DataFrame(rows, columns=["kind", "inside", "outside"])

    counts = some.select("html").mapInPandas(count, "kind string, inside long, outside long")
    got = counts.groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).orderBy(F.desc(F.col("inside") + F.col("outside")), "kind").limit(2000).collect()
    return weigh({r["kind"]: r["inside"] for r in got}, {r["kind"]: r["outside"] for r in got})


#: Words or tags that must have been seen before counts outweigh a default.
PSEUDO = 200


def weigh(inside: dict[str, int], outside: dict[str, int]) -> Weights:
    """Log odds of each class inside the marked article against outside, drawn to its default by pseudo-counts; words stay positive and tags negative."""
    every = {*inside, *outside}
    sums = lambda x, name: sum(v for k, v in x.items() if k.startswith("name:") == name)
    out = Weights()
    for name in (False, True):
        a, b = sums(inside, name), sums(outside, name)
        if not a or not b:
            continue
        for k in every:
            if k.startswith("name:") != name:
                continue
            i, o = inside.get(k, 0), outside.get(k, 0)
            odds = float(np.log((i + 0.5) / (a + 1) * (b + 1) / (o + 0.5)))
            sure = (i + o) / (i + o + PSEUDO)
            if name:
                out.names[k[5:]] = PRIOR.get(k[5:], 0.0) * (1 - sure) + min(max(odds, -4.0), 4.0) * sure
            elif k[0] == "<":
                out.by[k] = min(-0.05, max(default_weight(k) * (1 - sure) + (odds - 1) * sure, -2.0))
            else:
                out.by[k] = min(max(default_weight(k) * (1 - sure) + odds * sure, 0.05), 3.0)
    return out


def with_text(pages: DataFrame, weights: Weights, html_col: str = "html"):
    """A column with the main text of each page."""

    @F.pandas_udf("string")
    def main_text(column: pd.Series) -> pd.Series:
        return pd.Series([extract(x, weights) for x in column], dtype=object)

    return main_text.asNondeterministic()(pages[html_col])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = common.table(spark, sf_dir, "pages")
    out = pages.select("page_id", "url", with_text(pages, fit(pages)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
