"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text; the path of a block is that of its tags and
classes from the root. For each path the characters, the punctuation and the
characters in links of its blocks are added up; the mean length of a block, its
mean number of signs and the share of links are fused into one score of the path.
Scores are smoothed over the blocks in page order, and a threshold from their
spread selects the blocks that make up the content.

What the names of elements say is a weight of the score, no verdict: text in an
article or main element counts more, and less where a class or id has one of
NOISE_WORDS, unless that element holds most of the page's text. Only elements that
HTML itself gives another purpose (menus, forms, asides, page headers and footers)
are left out beforehand, and read after all where nothing else is there.

The content is the smallest element that holds the selected blocks and the heading
over them; an element that is a part of a text (a paragraph, item, cell, quotation
or section) stands for what holds it. Short blocks inside it belong to it. Of its
branches without a selected block those go that are mostly links, those with a
noise word (but for a strong one between selected blocks) and, where nothing
smaller than the page's body holds the selection, weak ones before or after it.

Elements are numbered, and know their parent and the number of their path, so time
and memory grow in proportion to the page, however deeply it is nested.

Defined cases: null and pages without text give the empty string; a page without
tags is one block; pages that end early, also inside a tag or a comment, are read
up to there; repeated rows give repeated results; other columns pass through unless
the output has a column of that name.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import trim, tune, unused

#: The threshold lies below the mean by so many deviations, or this share of the mean if that is more.
DEVIATIONS, SLACK = 0.5, 0.25
#: Weights: of text in an article or main element; of a noise word that is a whole class or id, or a part of one.
ARTICLE, WHOLE, PART = 1.5, 0.4, 0.6
#: Weights of a block and its neighbours in page order.
KERNEL = np.array([0.04, 0.16, 0.60, 0.16, 0.04])

# Names from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Their content is no markup. The first two run to the end of the page where they aren't closed.
RAW = ("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes")
#: Elements that end when one of the named begins, up to the nearest of the last set.
ENDS = {
    "p": (BLOCK - {"body", "html"}, frozenset(("td", "th", "li", "dd", "div", "article", "section", "blockquote", "body"))),
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "td": (frozenset(("td", "th", "tr", "tbody")), frozenset(("table",))),
    "th": (frozenset(("td", "th", "tr", "tbody")), frozenset(("table",))),
    "tr": (frozenset(("tr", "tbody")), frozenset(("table",))),
    "option": (frozenset(("option", "optgroup")), frozenset(("select",))),
}
OPEN_ENDED = frozenset("p dt dd li td th tr tbody".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold a whole text; others are parts of one.
HOLDERS = frozenset("html body main article div center".split())
#: Elements that stand in the flow of a text; other blocks are branches of their own.
FLOW = HEADINGS | frozenset("p pre blockquote li dt dd td th tr tbody caption figcaption address summary hgroup".split())
APART_TAGS = frozenset("head nav header footer aside form button menu dialog search fieldset label input output datalist select object audio video canvas svg math noscript template script style textarea title iframe xmp noembed noframes".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices notification alert popup modal overlay"
    " nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidenav aside footer header masthead topbar toolbar comment comments reply replies respond discussion disqus"
    " share sharing social related recommended newsletter subscribe subscription signup login search widget skip copyright disclaimer".split()
)
SIGNS = re.compile(r"<!--.*?(?:--!?>|\Z)|<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ENDINGS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|style|hidden|aria-hidden)(?![^\s=/>])\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、]")
WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    """A run of text inside one block element."""

    element: int
    path: int
    parts: list[tuple[str, int]] = field(default_factory=list)  # text and the innermost element that holds it
    text: str = ""
    linked: int = 0
    weight: float = 1.0
    noisy: bool = False


class Page:
    """The elements of a page, numbered from the root (0) in page order, and its blocks of text."""

    def __init__(self, page: str):
        self.parent, self.tag, self.path = [-1], [""], [0]
        self.apart, self.hidden, self.link, self.article = [False], [False], [False], [False]
        self.noise: dict[int, float] = {}
        self.paths: dict[tuple[int, str], int] = {}
        self.blocks: list[Block] = []
        self.stack = [0]  # numbers of open elements
        self.outer = [0]  # for each of them the place in the stack of the nearest block element, itself included
        self.places: dict[str, list[int]] = {}  # of each open tag, its places in the stack
        self.current: Block | None = None
        self._parse(page)
        self._weigh()

    # -- parsing ----------------------------------------------------------

    def _open(self, tag: str, rest: str) -> None:
        above = self.stack[-1]
        apart, hidden, noise, shown = tag in APART_TAGS, False, None, tag
        if tag == "header" and self.article[above]:
            apart = False
        for name, value in ATTRIBUTE.findall(rest) if rest else ():
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                if name == "class":
                    shown += "." + ".".join(value.split())
                for word in value.split() if tag not in ("html", "body", "article", "main") else ():
                    if not NOISE_WORDS.isdisjoint(WORD.findall(word)):
                        noise = WHOLE if word in NOISE_WORDS else noise or PART
            elif name == "role":
                apart |= value in APART_ROLES
            else:
                hidden |= name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value) is not None)
        number = len(self.tag)
        if noise is not None:
            self.noise[number] = noise
        self.parent.append(above)
        self.tag.append(tag)
        self.path.append(self.paths.setdefault((self.path[above], shown), len(self.paths) + 1) if tag in BLOCK else self.path[above])
        self.apart.append(self.apart[above] or apart or hidden)
        self.hidden.append(self.hidden[above] or hidden)
        self.link.append(self.link[above] or tag == "a")
        self.article.append(self.article[above] or tag in ("article", "main"))
        self.places.setdefault(tag, []).append(len(self.stack))
        self.outer.append(len(self.stack) if tag in BLOCK else self.outer[-1])
        self.stack.append(number)

    def _cut(self, place: int) -> None:
        """Close the elements from a place of the stack on."""
        for number in self.stack[place:]:
            self.places[self.tag[number]].pop()
        del self.stack[place:], self.outer[place:]

    def _close(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        if self.places.get(tag):
            place = self.places[tag][-1]
            if tag in BLOCK or self.outer[-1] < place:  # an inline element's end tag doesn't end blocks inside it
                self._cut(place)

    def _make_way(self, tag: str) -> None:
        """A block element that begins ends some that are open."""
        place = self.outer[-1]
        while place > 0:
            own = self.tag[self.stack[place]]
            ends = ENDS.get(own)
            if ends and tag in ends[0]:
                self._cut(place)
                return
            if own not in OPEN_ENDED:
                return
            place = self.outer[place - 1]

    def _flush(self) -> None:
        if self.current is not None:
            self.blocks.append(self.current)
            self.current = None

    def _add(self, text: str) -> None:
        if not text:
            return
        number = self.stack[-1]
        if self.current is None:
            if text.isspace():
                return
            self.current = Block(self.stack[self.outer[-1]], self.path[number])
            self.current.parts.append((text, number))
        elif self.apart[self.current.parts[0][1]] or not self.apart[number]:  # or a hidden inline element, a button and the like inside a block of content
            self.current.parts.append((text, number))

    def _parse(self, page: str) -> None:
        at, unclosed = 0, set()
        while m := SIGNS.search(page, at):
            self._add(page[at : m.start()])
            at = m.end()
            if m["tag"] is None:
                continue
            tag, rest = m["tag"].lower(), m["rest"]
            if m["close"]:
                self._close(tag)
                continue
            if tag in ENDINGS:
                end = None if tag in unclosed else ENDINGS[tag].search(page, at)
                if end:
                    at = end.end()
                elif tag in RAW[:2]:
                    at = len(page)
                else:
                    unclosed.add(tag)
                continue
            if tag == "br":
                self._add(" ")
                continue
            if tag in BLOCK:
                self._flush()
                self._make_way(tag)
            if tag not in VOID and not rest.endswith("/"):
                self._open(tag, rest)
        self._add(page[at:])
        self._flush()

    # -- texts and weights --------------------------------------------------

    def _weigh(self) -> None:
        """Texts of the blocks, and the weights that names give them."""
        size, articles = [0] * len(self.tag), [0] * len(self.tag)
        for b in self.blocks:
            for text, number in b.parts:
                if not self.apart[number]:
                    size[number] += len(text.strip())
                    articles[number] += len(text.strip()) * self.article[number]
        for k in range(len(self.tag) - 1, 0, -1):
            size[self.parent[k]] += size[k]
            articles[self.parent[k]] += articles[k]
        # An element that holds most of the page's text, or of its articles, isn't noise.
        mostly = [2 * n > size[0] and (not articles[0] or 2 * n > articles[0] > 0 and articles[k] > 0) for k, n in enumerate(size)]
        weight = [1.0] * len(self.tag)
        for k in range(1, len(self.tag)):
            weight[k] = min(weight[self.parent[k]], 1.0 if mostly[k] or 2 * articles[k] > articles[0] > 0 else self.noise.get(k, 1.0))
        for b in self.blocks:
            if len(b.parts) > 1:  # marked inline elements without punctuation: buttons and labels inside a block
                b.parts = [(t, k) for t, k in b.parts if weight[k] >= weight[b.element] or PUNCTUATION.search(t)] or b.parts
            b.weight = weight[b.element] * (ARTICLE if self.article[b.element] else 1.0)
            b.linked = sum(len(t) for t, k in b.parts if self.link[k])
            b.text = " ".join(html.unescape("".join(t for t, _ in b.parts)).split())
            b.noisy = weight[b.element] < (PART if self.tag[b.element] in FLOW and weight[self.parent[b.element]] == 1.0 else 1.0)
        self.blocks = [b for b in self.blocks if b.text]


def path_scores(blocks: list[Block]) -> np.ndarray:
    """For each block the fused ratio of its path, smoothed in page order, times the weight of its names."""
    paths, of = np.unique([b.path for b in blocks], return_inverse=True)
    chars = np.array([len(b.text) for b in blocks], float)
    signs = np.array([len(PUNCTUATION.findall(b.text)) for b in blocks], float)
    linked = np.minimum([b.linked for b in blocks], chars)
    number, chars, signs, linked = (np.bincount(of, x, len(paths)) for x in (np.ones(len(blocks)), chars, signs, linked))
    fused = np.log1p(chars / number) * (1 + np.log1p(signs / number) / 2) * (1 - linked / chars)
    weight = np.convolve(np.ones(len(blocks)), KERNEL)[2 : 2 + len(blocks)]
    return np.convolve(fused[of], KERNEL)[2 : 2 + len(blocks)] / weight * [b.weight for b in blocks]


def main_text(text: str | None) -> str:
    page = Page(text or "")
    found = page.blocks
    blocks = next(filter(None, ([b for b in found if not page.apart[b.element]], [b for b in found if not page.hidden[b.element]], found)), [])
    if not blocks:
        return ""
    size = np.array([len(b.text) for b in blocks])
    scores = path_scores(blocks)
    mean = np.average(scores, weights=size * [b.weight for b in blocks])
    least = mean - max(DEVIATIONS * scores.std(), SLACK * mean)
    chosen = scores >= least
    if not chosen.any():
        chosen[:] = True
    noisy = np.array([b.noisy for b in blocks])
    if (chosen & ~noisy).any():  # of selected blocks, those with a noise word must score as well as the others do
        chosen &= ~noisy | (scores >= scores[chosen & ~noisy].mean())
    first, last = int(chosen.argmax()), len(blocks) - 1 - int(chosen[::-1].argmax())
    for k in range(first - 1, -1, -1):  # the heading over the first selected block is of the content
        if blocks[k].linked >= size[k] or blocks[k].noisy > blocks[first].noisy:
            break
        if page.tag[blocks[k].element] in HEADINGS:
            first = k
            break

    # Selected blocks in each element; the last element that holds all of them is the smallest.
    inside = [0] * len(page.tag)
    for k in {first, *np.flatnonzero(chosen).tolist()}:
        inside[blocks[k].element] += 1
    for k in range(len(inside) - 1, 0, -1):
        inside[page.parent[k]] += inside[k]
    top = max(k for k, n in enumerate(inside) if n == inside[0])
    while top > 0 and page.tag[top] not in HOLDERS:
        top = page.parent[top]
    whole = page.tag[top] in ("", "html", "body")
    held, branch = [top == 0] * len(inside), [0] * len(inside)  # branch: the highest element around without a selected block
    for k in range(1, len(inside)):
        held[k] = k == top or held[page.parent[k]]
        branch[k] = branch[page.parent[k]] or (k if not inside[k] else 0)

    out = []
    for k, b in enumerate(blocks):
        if not held[b.element]:
            continue
        around = branch[b.element]
        between = first <= k <= last
        if k != first and not chosen[k] and around:
            if page.tag[around] in FLOW and not b.noisy:
                keep = between or b.linked < size[k]
            elif 2 * b.linked >= size[k]:
                keep = False
            elif b.noisy:
                keep = between and scores[k] >= least * WHOLE
            else:
                keep = between or not whole
            if not keep:
                continue
        out.append(b.text)
    return "\n".join(out)


def extract_pages(pages: DataFrame, page: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """pages without their html, with the main text and its code points."""
    tune(pages.sparkSession)

    @F.pandas_udf("struct<text:string,n:long>")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [main_text(p) for p in batch.tolist()]
            yield pd.DataFrame({"text": pd.Series(found, dtype=object), "n": pd.Series([len(t) for t in found], dtype="int64")})
            trim()

    name = unused(pages, "main")
    out = pages.withColumn(name, extracted(F.col(page)))
    return out.select(*[c for c in pages.columns if c not in (page, text, n_chars)], F.col(f"{name}.text").alias(text), F.col(f"{name}.n").alias(n_chars))
