"""Main text of web pages by minimum-cut labelling.

A page is read into text blocks, each with the open elements around it. A classifier of fixed weights gives each block the cost of
calling it content and of calling it boilerplate: the capacities to the two terminals. Neighbours in page
order and blocks of one container are tied by edges that weaken with their distance in the tree. The cut
of least total capacity parts content from boilerplate.
"""

from __future__ import annotations

import html as html_text
import math
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckloom.llm.common import packed, unpacked

#: Elements whose text is never shown as text.
HIDDEN = frozenset("script style noscript template head title iframe object svg math canvas audio video".split())
#: Elements read as plain text up to their end tag.
RAW = frozenset("script style title textarea noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr img".split())
#: Elements and words of class, id and role that speak for boilerplate or for content.
BOILER_TAGS = frozenset("nav footer aside form menu dialog button select option textarea fieldset label".split())
CONTENT_TAGS = frozenset(("article", "main"))
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay newsletter subscribe signup login nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar side widget footer masthead comment comments disqus reply replies respond discussion share sharing social "
    "related recommended search pagination pager toolbar skip copyright legal contentinfo complementary dialog".split())
#: Marks that hold for all within, also for articles: comments are written as articles, too.
STICKY_WORDS = frozenset("comment comments disqus reply replies respond discussion related recommended".split())
CONTENT_WORDS = frozenset("article content main post entry story body text".split())
#: Weights of the classifier: marks around a block, part of its text inside links, length, headings, notices of rights.
BOILER_WEIGHT, CONTENT_WEIGHT, LINK_WEIGHT, HEADING_WEIGHT, RIGHTS_WEIGHT = -6.0, 4.0, -4.0, 1.5, -2.0
LENGTH_WEIGHT, LENGTH_BASE, LENGTH_MOST = 1.5, 1.5, 3.0
#: Capacity of an edge between neighbours in page order, and in one container.
NEIGHBOUR, CONTAINER = 1.0, 0.5
#: Capacities are whole thousandths, so that cuts are exact.
UNIT = 1000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)((?>\"[^\"]*\"|'[^']*'|[^>])*+)>", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_GONE = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


class Element:
    """An open element: its name, its place among all of the page, and what it says of the text within."""

    __slots__ = ("tag", "no", "mark", "hidden")

    def __init__(self, tag: str, no: int, mark: int, hidden: bool) -> None:
        self.tag, self.no, self.mark, self.hidden = tag, no, mark, hidden


def _mark(tag: str, attributes: str, around: int) -> int:
    """1 for content, -1 for boilerplate (-2 for all within), 0 where an element says nothing; ``around``: the mark outside."""
    if tag in ("html", "body"):
        return 0
    words: set[str] = set()
    if attributes:
        for found in _NAMES.findall(attributes):
            words.update(w.lower() for w in _WORD.findall(" ".join(found)))
    if words & STICKY_WORDS:
        return -2
    if tag in BOILER_TAGS or words & BOILER_WORDS:
        return -1
    if tag == "header" or "header" in words:
        return 0 if around > 0 else -1
    if tag in CONTENT_TAGS:
        return 0 if around == -2 else 1
    return 1 if words & CONTENT_WORDS and around >= 0 else 0


class Block:
    """A run of text without a block element's border inside."""

    __slots__ = ("text", "chain", "mark", "heading", "linked")

    def __init__(self, text: str, chain: tuple[int, ...], mark: int, heading: bool, linked: float) -> None:
        self.text, self.chain, self.mark, self.heading, self.linked = text, chain, mark, heading, linked


def blocks_of(html: str) -> list[Block]:
    """The blocks of a page, in its order."""
    out: list[Block] = []
    stack: list[Element] = []
    parts: list[str] = []
    links, linked, at, count = 0, 0, 0, 0

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            mark = next((e.mark for e in reversed(stack) if e.mark), 0)
            heading = any(len(e.tag) == 2 and e.tag[0] == "h" and e.tag[1] in "123456" for e in stack[-2:])
            out.append(Block(text, tuple(e.no for e in stack), mark, heading, min(linked / len(text), 1.0)))
        parts.clear()
        linked = 0

    def text_until(end: int) -> None:
        nonlocal linked
        if at < end and not any(e.hidden for e in stack):
            piece = html[at:end]
            piece = html_text.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if links:
                linked += len(piece.strip())

    position = 0
    while found := _TOKEN.search(html, position):
        text_until(found.start())
        at = position = found.end()
        if not found[2]:
            continue
        tag, ending = found[2].lower(), found[1] == "/"
        if tag == "br" or tag == "hr":
            parts.append(" ")
            continue
        if tag in RAW and not ending:
            close_tag = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, position)
            at = position = close_tag.end() if close_tag else len(html)
            continue
        if tag in INLINE and not (tag == "label" or tag in HIDDEN):
            if tag == "a":
                links = max(links + (-1 if ending else 1), 0)
            continue
        if tag in VOID:
            continue
        close()
        links = 0
        if ending:
            if any(e.tag == tag for e in stack):
                while stack.pop().tag != tag:
                    pass
            continue
        if tag == "body":  # an open head ends here
            stack = [e for e in stack if e.tag == "html"]
        while stack and (stack[-1].tag == "p" or stack[-1].tag == tag and tag in ("li", "option", "dt", "dd", "tr", "td", "th")):
            stack.pop()
        if found[3].endswith("/") and tag in HIDDEN:
            continue
        count += 1
        around = next((e.mark for e in reversed(stack) if e.mark), 0)
        stack.append(Element(tag, count, _mark(tag, found[3], around), tag in HIDDEN or bool(found[3] and _GONE.search(found[3]))))
    text_until(len(html))
    close()
    return out


def score(block: Block) -> float:
    """Log odds that a block is content."""
    odds = CONTENT_WEIGHT if block.mark > 0 else BOILER_WEIGHT if block.mark < 0 else 0.0
    odds += LINK_WEIGHT * block.linked
    odds += LENGTH_WEIGHT * (min(math.log(len(block.text)), 2 * LENGTH_MOST) - LENGTH_BASE) / LENGTH_MOST
    if block.heading:
        odds += HEADING_WEIGHT
    if block.text[0] == "©":
        odds += RIGHTS_WEIGHT
    return odds


def edges_of(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """Ties between blocks: pairs of places and capacities."""
    out = []
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if i:
            before, own = blocks[i - 1].chain, block.chain
            shared = 0
            for a, b in zip(before, own, strict=False):
                if a != b:
                    break
                shared += 1
            out.append((i - 1, i, round(UNIT * NEIGHBOUR / (1 + len(before) + len(own) - 2 * shared))))
        container = block.chain[-2] if len(block.chain) > 1 else 0
        if container in last and last[container] < i - 1:
            out.append((last[container], i, round(UNIT * CONTAINER)))
        last[container] = i
    return out


def minimum_cut(gains: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """For each node, if it stays with the source in a cut of least capacity.

    A node's ``gain`` is its capacity from the source less that to the sink; edges hold both ways. Flow is
    pushed along shortest paths, level by level, until none is left; the nodes that the
    source still reaches are the smallest of all least cuts.
    """
    n = len(gains)
    ties: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[int] = []
    for a, b, capacity in edges:
        if capacity > 0:
            ties[a].append(len(to)), to.append(b), room.append(capacity)
            ties[b].append(len(to)), to.append(a), room.append(capacity)
    left = gains[:]  # what a source node can still send (above zero), or a sink node still take (below)
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if left[i] > 0)
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            i = queue.popleft()
            if left[i] < 0:
                reached = True
                continue
            for e in ties[i]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        place = [0] * n
        for start in range(n):
            while left[start] > 0 and level[start] == 0:
                path: list[int] = []
                i = start
                while left[i] >= 0:
                    while place[i] < len(ties[i]):
                        e = ties[i][place[i]]
                        if room[e] and level[to[e]] == level[i] + 1:
                            break
                        place[i] += 1
                    else:
                        if not path:
                            break
                        level[i] = -2  # a dead end in this round
                        i = to[path.pop() ^ 1]
                        continue
                    path.append(e)
                    i = to[e]
                if not path or left[i] >= 0:
                    break
                flow = min(left[start], -left[i], *(room[e] for e in path))
                left[start] -= flow
                left[i] += flow
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow


def article_text(html: str | None) -> str:
    """The main text of one page."""
    blocks = blocks_of(html or "")
    if not blocks:
        return ""
    # The cost of calling a block content, or not, is the logarithm of the odds against it: only their difference counts.
    gains = [round(UNIT * score(b)) for b in blocks]
    kept = minimum_cut(gains, edges_of(blocks))
    return " ".join(b.text for b, content in zip(blocks, kept, strict=True) if content)


def extract_articles(pages: DataFrame) -> DataFrame:
    """``pages`` with all their columns and ``main_text``, the main text of ``html``.

    General: the project keeps no web pages. Every block is labelled; menus, headers, footers, sidebars, notices, adverts,
    forms, scripts, styles and comments are left out, character references decoded, white space inside a block
    made one space, and blocks joined by one. A null page is an empty one; a page without content gives an empty
    text; broken markup is read as far as it goes; pages of any length are read whole. Repeated rows are treated alike, an empty table stays
    empty; a column ``main_text`` that was there before is replaced.
    """
    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([article_text(h) for h in batch], dtype="object")

    return unpacked(packed(pages, "html").withColumn("main_text", extract(F.col("html"))), pages.columns, "main_text")
