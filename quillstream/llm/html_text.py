"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing and threshold clustering."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Closed by the start of any block, as their end tags may be left out.
OPEN_ENDED = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: What is inside these isn't text of the page, and they don't part blocks.
SKIPPED = frozenset("audio button canvas embed iframe map noscript object script select style svg template textarea title video".split())
#: Elements and roles that mark what isn't the article; so does a header that isn't in an article or main.
OUTSIDE = frozenset("aside dialog fieldset footer menu nav".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
#: Words of a class or id that mark what isn't the article: alone, or joined only with each other and with PLAIN words.
NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus discussion feedback footer gdpr login menu modal nav navbar navigation newsletter notice notices notification outbrain pager pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe taboola toolbar widget widgets".split()
)
PLAIN = frozenset("area articles bar block bottom box button buttons center col column container content form global group header icons inner item items left link links list main media news outer page panel post posts primary right row section secondary site slot stories top unit wrap wrapper".split())
#: Elements of running text, which only these words in a class mark.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption".split())
MARKED = frozenset("ad ads advert adverts advertisement breadcrumb breadcrumbs comment comments cookie cookies footer menu nav newsletter sidebar sponsored".split())
WHOLE = frozenset("html body main article".split())
#: What may stand in head; anything else closes it, as its end tag may be left out.
HEAD = frozenset("base link meta noscript script style template title head html".split())
#: Names of comments, which are outside though they hold articles or most of the text.
REMARKS = frozenset("comment comments discussion disqus replies reply respond".split())
HEADINGS = frozenset("h1 h2 h3".split())
SIGMA, SHARE = 1.5, 0.9


def _marks(tag: str, attrs: dict) -> set[str]:
    """The words of class and id that mark an element."""
    if tag in WHOLE:
        return set()
    if tag in RUNNING:
        return MARKED.intersection((attrs.get("class") or "").lower().split())
    out: set[str] = set()
    for token in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split():
        parts = [x for x in re.split(r"[^a-z]+", token) if x]
        if all(x in NAMES or x in PLAIN for x in parts):
            out |= NAMES.intersection(parts)
    return out


class _Events(HTMLParser):
    """Turns parser events into blocks (text, tags, characters in links, element, tag of its block element) and a tree of elements.

    Elements are numbered as they open, so a parent's number is smaller than its children's and an element's
    descendants are the numbers up to ``last``. All work is linear in the events, however deep elements are nested.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = [("", 0)]
        self.inner: list[int] = []  # places in the stack of its block elements
        self.open: dict[str, int] = {}
        # of each element: parent, whether it's outside for certain, marked by its name, a remark, an article or main, and the last descendant
        self.parent, self.out, self.named, self.remark, self.holds, self.last = [0], [False], [False], [False], [False], [0]
        self.blocks: list[tuple[str, int, int, int, str]] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.skipping = 0

    def parse_html_declaration(self, i: int) -> int:
        # a marked section of any kind is markup that ends at the next ">"
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def flush(self) -> None:
        if text := " ".join("".join(self.parts).split()):
            self.blocks.append((text, self.tags, self.linked, self.stack[-1][1], self.stack[self.inner[-1]][0] if self.inner else ""))
            self.tags = 0
        self.parts.clear()
        self.linked = 0

    def push(self, tag: str, out: bool, named: bool, remark: bool) -> None:
        up = self.stack[-1][1]
        self.parent.append(up)
        self.out.append(out or self.out[up])
        self.named.append(named)
        self.remark.append(remark or self.remark[up])
        self.holds.append(tag in ("article", "main"))
        self.last.append(0)
        if tag in BLOCKS:
            self.inner.append(len(self.stack))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.skipping += tag in SKIPPED
        self.stack.append((tag, len(self.parent) - 1))

    def close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag, own = self.stack[-1]
            if tag in BLOCKS or self.named[own] or self.out[own] != self.out[self.parent[own]]:
                self.flush()
            if tag in BLOCKS:
                self.inner.pop()
            self.open[tag] -= 1
            self.skipping -= tag in SKIPPED
            self.last[own] = len(self.parent) - 1
            self.stack.pop()

    def close(self) -> None:
        super().close()
        self.close_to(1)
        self.flush()
        self.last[0] = len(self.parent) - 1

    def close_head(self) -> None:
        while self.open.get("head"):
            self.close_to(len(self.stack) - 1)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.open.get("head") and (self.stack[-1][0] == "head" and tag not in HEAD or tag == "body"):
            self.close_head()
        self.tags += 1
        if self.skipping:
            if tag not in VOID:
                self.push(tag, False, False, False)
            return
        if tag in BLOCKS:
            if self.inner:
                near = self.stack[self.inner[-1]][0]
                if near in OPEN_ENDED or near == tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    self.close_to(self.inner[-1])
            self.flush()
        if tag in VOID:
            if tag in ("br", "hr"):
                self.parts.append(" ")
            return
        own = dict(attrs)
        hidden = tag not in WHOLE and ("hidden" in own or own.get("aria-hidden") == "true" or "display:none" in (own.get("style") or "").replace(" ", "").lower())
        out = tag in OUTSIDE or tag == "header" and not (self.open.get("article") or self.open.get("main")) or hidden or tag not in WHOLE and (own.get("role") or "").lower() in ROLES
        marks = _marks(tag, own)
        named = bool(marks) or tag == "form"
        if out or named:
            self.flush()
        self.push(tag, out, named, bool(marks & REMARKS))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # HTML knows no empty elements but the void ones

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if self.open.get(tag):
            depth = len(self.stack) - 1
            while self.stack[depth][0] != tag:
                depth -= 1
            self.close_to(depth)

    def handle_data(self, data: str) -> None:
        if self.skipping:
            return
        if self.stack[-1][0] == "head" and data.strip():
            self.close_head()
        if self.open.get("head"):
            return
        self.parts.append(data)
        if self.open.get("a"):
            self.linked += len(data.strip())


def _smooth(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratio, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def _threshold(smooth: np.ndarray) -> float:
    """The border between a low and a high cluster of ratios (two means in one dimension), at most the mean."""
    low, high = smooth.min(), smooth.max()
    for _ in range(30):
        cut = (low + high) / 2
        a, b = smooth[smooth < cut], smooth[smooth >= cut]
        was = low, high
        low, high = (a.mean() if len(a) else low), (b.mean() if len(b) else high)
        if was == (low, high):
            break
    return min((low + high) / 2, smooth.mean())


def _high(blocks: list[tuple], outside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of each block, without links, and whether it is in the high cluster; if that has none, all blocks inside are."""
    own = np.array([0 if out else max(len(b[0]) - b[2], 0) for b, out in zip(blocks, outside, strict=True)], dtype=float)
    smooth = _smooth(own / np.array([max(b[1], 1) for b in blocks]))
    high = (smooth >= _threshold(smooth)) & ~outside
    return own, high if (own * high).sum() else ~outside


def _held(p: _Events, weight: np.ndarray) -> list[float]:
    """The weight of the blocks in each element, from the last element to the first."""
    held = [0.0] * len(p.parent)
    for b, w in zip(p.blocks, weight.tolist(), strict=True):
        held[b[3]] += w
    for e in range(len(held) - 1, 0, -1):
        held[p.parent[e]] += held[e]
    return held


def _freed(p: _Events, weight: np.ndarray) -> set[int]:
    """Elements that their names mark but that hold the article: an article or main, or most of the high cluster's characters, where no article or main stands elsewhere."""
    under, holding = [False] * len(p.parent), [False] * len(p.parent)
    for e in range(1, len(p.parent)):
        under[e] = p.named[e] or under[p.parent[e]]
    for e in range(len(p.parent) - 1, 0, -1):
        if p.holds[e] and not p.out[e] and not p.remark[e]:
            if not under[e]:
                return set()
            holding[e] = True
        holding[p.parent[e]] |= holding[e]
    held, most = _held(p, weight), weight.sum() / 2
    return {e for e in range(1, len(p.parent)) if p.named[e] and not p.remark[e] and (holding[e] or held[e] > most)}


def _region(p: _Events, weight: np.ndarray, bad: list[bool]) -> np.ndarray:
    """The blocks of the article: those of the content region, its heading, and without an article or main the running text around it."""
    held, least = _held(p, weight), SHARE * weight.sum()
    whole = [e for e in range(1, len(held)) if held[e] >= least]
    own = [e for e in whole if p.holds[e] and not bad[e]]
    # elements with nine tenths of the weight are nested, so the innermost has the largest number
    at = max(own or whole, default=0)
    inside = np.array([at <= b[3] <= p.last[at] for b in p.blocks])
    first = int(np.argmax(inside)) if inside.any() else 0
    heading = any(b[4] == "h1" for b, x in zip(p.blocks, inside, strict=True) if x)
    for k, b in enumerate(p.blocks):
        if not inside[k] and b[2] * 2 < len(b[0]):
            inside[k] = b[4] in HEADINGS and k < first and not heading if own else b[4] in RUNNING
    return inside


def extract(html: str) -> str:
    """The article's blocks joined by newlines; empty if there are none.

    A line of the method is a rendered line: a block. Blocks inside menus, headers, footers, sidebars, notices, adverts,
    forms and comments have ratio 0; an element that only its class or id marks (or a form) isn't one of these if it holds the
    article or most of the text and no article or main stands elsewhere. The smoothed ratios are clustered; the content region is the
    smallest article or main (else the smallest element) that holds nine tenths of the high cluster's characters, and all its blocks
    that aren't outside belong to the text, short ones included. Malformed declarations count as comments.
    """
    p = _Events()
    p.feed(html)
    p.close()
    if not p.blocks:
        return ""
    outside = np.array([p.out[b[3]] for b in p.blocks])
    freed: set[int] = set()
    if any(p.named):
        own, high = _high(p.blocks, outside)
        freed = _freed(p, own * high)
    bad = list(p.out)
    for e in range(1, len(bad)):
        bad[e] |= bad[p.parent[e]] or p.named[e] and e not in freed
    outside = np.array([bad[b[3]] for b in p.blocks])
    if outside.all():
        return ""
    own, high = _high(p.blocks, outside)
    inside = _region(p, own * high if (own * high).sum() else high.astype(float), bad)
    return "\n".join(b[0] for b, out, x in zip(p.blocks, outside, inside, strict=True) if x and not out)


def with_main_text(pages: DataFrame, column: str = "html", name: str = "_main") -> DataFrame:
    """Append the main text of each page; null html gives an empty one. ``name`` must be a new column; others pass through.

    Each row is judged on its own, so repeated rows have equal texts and ties can't arise; an empty table gives an empty one.
    Time and memory are linear in a page's length, however deep its elements are nested.
    """
    return common.map_texts(pages, column, lambda xs: [pa.array([extract(x) for x in xs], pa.string())], [T.StructField(name, T.StringType())])
