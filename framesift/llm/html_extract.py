"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks. A classifier gives each block the cost of either label; these costs
are the capacities to the two terminals. Blocks next to each other, and blocks of one parent with others
between them, are tied by smoothness edges that weigh more the closer they are in the DOM. The minimum
cut, found by maximum flow, is the cheapest labelling of the whole page.

The classifier is a logistic regression that is fitted on pages which a seeded generator writes, so the
corpus has no part in it. Every page is read whole; nothing is cut off or collected.
"""

from __future__ import annotations

import random
import re
from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# element kinds of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
#: elements that end an open one of their kind
ENDS = frozenset("p li tr td th dt dd option".split())
CLOSE = {tag: re.compile(f"</{tag}\\b", re.I) for tag in RAW}
START = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
ATTRIBUTES = re.compile(r"""[^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+""")
NAME = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden|aria-label)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

AREAS = {
    "nav": 1, "menu": 1, "header": 2, "footer": 3, "aside": 4, "form": 5, "button": 5, "select": 5, "fieldset": 5, "label": 5,
    "dialog": 5, "article": 6, "main": 7, "head": 8,
}
WORDS = (
    ("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner", 9),
    ("notice cookie cookies consent gdpr alert newsletter subscribe popup modal overlay paywall message warning", 10),
    ("sidebar side rail widget", 11),
    ("menu nav navbar navigation breadcrumb breadcrumbs pagination pager tabs toolbar skip toc", 12),
    ("header masthead topbar logo branding", 13),
    ("footer foot bottom copyright legal disclaimer colophon contentinfo", 14),
    ("comment comments commentlist disqus reply replies respond discussion reader", 15),
    ("share sharing social related recommended recommendations more trending popular tags meta byline", 16),
    ("login signin signup register search form complementary", 17),
    ("article content post entry main story body text hentry", 18),
    ("hidden none", 19),
)
KEYWORDS = {w: k for ws, k in WORDS for w in ws.split()}
# numbers of the features that a block's own tag and text give
PART = re.compile(r"[a-z]+")
SOME_LINKS, MOST_LINKS, TINY, SHORT, LONG, HUGE, STOPPED, HEADING, PARAGRAPH, ITEM, CELL, OUTSIDE, BIAS = range(20, 33)
FEATURES = 33
SCALE = 100
#: share of the generated pages whose tags and names tell the areas
TOLD = 0.6
#: smoothness of neighbours of one parent, of other neighbours, and of blocks of one parent with others between
NEAR, FAR, SAME_PARENT = 0.6, 0.15, 0.3


class Block:
    """A run of text that no block element interrupts."""

    __slots__ = ("parts", "linked", "size", "areas", "tag", "parent")

    def __init__(self, areas: frozenset, tag: str, parent: int):
        self.parts, self.linked, self.size = [], 0, 0
        self.areas, self.tag, self.parent = areas, tag, parent


def attribute_areas(attributes: str) -> set[int]:
    found = set()
    for name, value in NAME.findall(attributes):
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and "true" in value.lower():
            found.add(19)
        elif name == "style":
            if re.search(r"display\s*:\s*none", value, re.I):
                found.add(19)
        else:
            spaced = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()
            found |= {KEYWORDS[w] for w in PART.findall(spaced) if w in KEYWORDS}
    return found


def tags(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Start, end, whether it closes, name and attributes of each tag; comments and the like have no name.

    Contents of raw elements are skipped. A `>` in quotes doesn't end a tag. From a quote on that nothing ends, quotes
    count as other characters do, and nothing after the last `>` is a tag, so no stretch of a page is read again and again.
    """
    at, last, quotes = 0, html.rfind(">"), True
    while match := START.search(html, at):
        start, at = match.span()
        if match[1]:
            close = html.find("-->", at)
            at = close + 3 if close >= 0 else len(html)
            yield start, at, False, "", ""
            continue
        if at > last:
            return
        end = -1
        if quotes and match[4]:
            end = ATTRIBUTES.match(html, at).end()
            quotes = html[end : end + 1] == ">"
        if end < 0 or not quotes:
            end = html.index(">", at)
        if not match[4]:
            at = end + 1
            yield start, at, False, "", ""
            continue
        name, attributes, at = match[4].lower(), html[match.end() : end], end + 1
        if name in RAW and not match[3] and (not attributes.endswith("/") or name in ("script", "style", "textarea")):
            close = CLOSE[name].search(html, at)
            end = html.find(">", close.end()) if close else -1
            at = end + 1 if end >= 0 else len(html)
        yield start, at, bool(match[3]), name, attributes


def blocks(html: str) -> list[tuple[Block, str]]:
    """The blocks of a page with text, in page order, and their text: white space is one space, trimmed."""
    found: list[Block] = []
    nothing: frozenset = frozenset()
    # open elements: tag, areas, number, place of the nearest block element
    stack: list[tuple[str, frozenset, int, int]] = [("", nothing, 0, 0)]
    opened: Counter = Counter()
    parents, links = 1, 0
    block: Block | None = None
    at = 0

    def close(place: int) -> int:
        gone = 0
        for name, *_ in stack[place:]:
            opened[name] -= 1
            gone += name == "a"
        del stack[place:]
        return gone

    for start, end, closes, tag, attributes in chain(tags(html), [(len(html), len(html), False, "", "")]):
        text = html[at:start]
        if text:
            if block is None:
                _, areas, parent, nearest = stack[-1]
                if nearest:
                    parent = stack[nearest][2]
                block = Block(areas, stack[nearest or -1][0], parent)
                found.append(block)
            block.parts.append(text)
            block.size += len(text)
            if links:
                block.linked += len(text)
        at = end
        if not tag:
            continue
        if tag in BLOCKS:
            block = None
        elif tag == "br" and block is not None:
            block.parts.append(" ")
        if closes:
            if opened[tag]:
                place = len(stack) - 1
                while stack[place][0] != tag:
                    place -= 1
                links -= close(place)
            continue
        if tag in RAW or tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            continue
        nearest = stack[-1][3]
        if nearest and tag in ENDS and stack[nearest][0] == tag or stack[-1][0] == "p" and tag in BLOCKS and tag not in ENDS:
            links -= close(nearest)
        areas = stack[-1][1]
        own = {AREAS[tag]} if tag in AREAS else set()
        if attributes and not attributes.isspace() and tag not in ("html", "body"):
            own |= attribute_areas(attributes)
        if own - areas:
            areas = areas | own
        links += tag == "a"
        opened[tag] += 1
        stack.append((tag, areas, parents, len(stack) if tag in BLOCKS else stack[-1][3]))
        parents += 1
    out = []
    for b in found:
        raw = "".join(b.parts)
        text = " ".join((unescape(raw) if "&" in raw else raw).split())
        if text:
            out.append((b, text))
    return out


def block_features(block: Block, text: str, has_article: bool) -> list[int]:
    found = list(block.areas)
    share = block.linked / max(1, block.size)
    n = text.count(" ") + 1
    if share > 0.3:
        found.append(MOST_LINKS if share > 0.7 else SOME_LINKS)
    found.append(TINY if n <= 3 else SHORT if n <= 10 else LONG if n <= 40 else HUGE)
    if text[-1] in ".!?:;\"”»…":
        found.append(STOPPED)
    tag = block.tag
    if tag[:1] == "h" and tag[1:].isdigit():
        found.append(HEADING)
    elif tag in ("p", "blockquote", "pre"):
        found.append(PARAGRAPH)
    elif tag in ("li", "dt", "dd"):
        found.append(ITEM)
    elif tag in ("td", "th"):
        found.append(CELL)
    if has_article and 6 not in block.areas and 7 not in block.areas:
        found.append(OUTSIDE)
    found.append(BIAS)
    return found


def maximum_flow(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut; edges (i, j, capacity) hold both ways.

    Blocking flows over level graphs (Dinic), after each node has passed what it can straight through.
    """
    n = len(source)
    left, need = source[:], sink[:]
    for i in range(n):
        straight = min(left[i], need[i])
        left[i] -= straight
        need[i] -= straight
    near: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for i, j, capacity in edges:
        near[i].append(len(to))
        to.append(j)
        room.append(capacity)
        near[j].append(len(to))
        to.append(i)
        room.append(capacity)
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if left[i])
        starts = list(queue)
        for i in starts:
            level[i] = 0
        ends = False
        while queue:
            i = queue.popleft()
            ends |= need[i] > 0
            for e in near[i]:
                j = to[e]
                if room[e] and level[j] < 0:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not ends:
            return [x >= 0 for x in level]
        turn = [0] * n
        for s in starts:
            while left[s]:
                path, i = [], s
                while need[i] == 0 or not level[i] >= 0:
                    while turn[i] < len(near[i]):
                        e = near[i][turn[i]]
                        if room[e] and level[to[e]] == level[i] + 1:
                            break
                        turn[i] += 1
                    else:
                        if not path:
                            i = -1
                            break
                        e = path.pop()
                        i = to[e ^ 1]
                        turn[i] += 1
                        continue
                    path.append(e)
                    i = to[e]
                if i < 0:
                    break
                amount = min(left[s], need[i], *(room[e] for e in path)) if path else min(left[s], need[i])
                left[s] -= amount
                need[i] -= amount
                for e in path:
                    room[e] -= amount
                    room[e ^ 1] += amount


def label(found: list[tuple[Block, str]], weights: np.ndarray) -> list[bool]:
    """True for the blocks of the main text."""
    has_article = any(6 in b.areas or 7 in b.areas for b, _ in found)
    source, sink, edges = [], [], []
    last: dict[int, int] = {}
    for i, (b, text) in enumerate(found):
        odds = float(sum(weights[f] for f in block_features(b, text, has_article)))
        # the cost of a label is the negative logarithm of its probability
        source.append(round(SCALE * float(np.logaddexp(0, odds))))
        sink.append(round(SCALE * float(np.logaddexp(0, -odds))))
        if i:
            near = found[i - 1][0].parent == b.parent
            edges.append((i - 1, i, round(SCALE * (NEAR if near else FAR))))
            if not near and b.parent in last:
                edges.append((last[b.parent], i, round(SCALE * SAME_PARENT)))
        last[b.parent] = i
    return maximum_flow(source, sink, edges)


def main_text(html: str, weights: np.ndarray) -> tuple[str, int, int]:
    """The text, the number of blocks and of those kept."""
    found = blocks(html)
    if not found:
        return "", 0, 0
    kept = [text for (_, text), good in zip(found, label(found, weights), strict=True) if good]
    return "\n\n".join(kept), len(found), len(kept)


def _made_page(rng: random.Random, told: bool = True) -> tuple[str, list[bool]]:
    """A page of the generator; blocks of its main text hold the word MAIN. If not `told`, no tag or name tells the areas."""
    syllables = "an the on re er st ing ti en le que ou ai de la ver ge ein".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    prose = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    named = lambda k: rng.choice(rng.choice([w for w, i in WORDS if i == k]).split())
    links = lambda n: "".join(f'<li><a href="/x">{prose(1, 3)}</a></li>' for _ in range(n))

    def clutter() -> str:
        if not told:
            inner = rng.choice(
                [lambda: f"<ul>{links(rng.randint(3, 9))}</ul>", lambda: f"<div>{prose(1, 5)}</div><div>{prose(1, 6)}</div><div>{prose(2, 9)}</div>",
                 lambda: f"<div>{prose(2, 7)}</div><p>{prose(3, 16)}</p><div>{prose(1, 4)}</div>", lambda: "".join(f'<div><a href="/z">{prose(1, 6)}</a></div>' for _ in range(rng.randint(2, 6)))]
            )()
            return f"<div>{inner}</div>"
        kind = rng.randrange(14)
        if kind == 0:
            return f"<nav><ul>{links(rng.randint(2, 8))}</ul></nav>"
        if kind == 1:
            return f"<header><h2>{prose(1, 4)}</h2><p>{prose(2, 12)}</p></header>"
        if kind == 2:
            return f"<footer>{prose(2, 12)}.<p>{prose(2, 9)}</p></footer>"
        if kind == 3:
            return f"<aside><h3>{prose(1, 4)}</h3><p>{prose(4, 40)}.</p></aside>"
        if kind == 4:
            return f"<form><label>{prose(1, 3)}</label><p>{prose(2, 9)}</p><button>{prose(1, 2)}</button></form>"
        if kind == 5:
            return f'<section class="{named(15)}"><p>{prose(2, 40)}.</p><p>{prose(3, 30)}.</p></section>'
        tag = rng.choice(["div", "div", "section", "p", "ul"])
        inner = links(rng.randint(2, 6)) if tag == "ul" else rng.choice([prose(2, 25) + ".", f"<p>{prose(2, 30)}.</p>" if tag != "p" else prose(2, 9)])
        return f'<{tag} {rng.choice(["class", "id"])}="{named(rng.choice([9, 10, 11, 12, 13, 14, 15, 16, 17, 19]))}">{inner}</{tag}>'

    body = [f"<h1>MAIN {prose(2, 12)}</h1>"]
    for _ in range(rng.randint(1, 14)):
        body.append(
            rng.choice(
                [lambda: f"<p>MAIN {prose(4, 80)}.</p>"] * 8
                + [lambda: f"<p>MAIN {prose(0, 4)}.</p>"] * 3
                + [
                    lambda: f"<h2>MAIN {prose(1, 6)}</h2>", lambda: f"<ul><li>MAIN {prose(1, 12)}</li><li>MAIN {prose(1, 20)}.</li></ul>",
                    lambda: f"<blockquote>MAIN {prose(5, 30)}.</blockquote>", lambda: f"<pre>MAIN {prose(5, 30)}</pre>",
                    lambda: f"<table><tr><td>MAIN {prose(1, 4)}</td><td>MAIN {prose(1, 4)}</td></tr></table>",
                    lambda: f'<p>MAIN {prose(5, 30)} <a href="/y">{prose(1, 4)}</a> {prose(3, 9)}.</p>', clutter,
                ]
            )()
        )
    whole = "".join(body)
    wrap = rng.choice(["<article>{}</article>"] * 4 + ["<main>{}</main>", '<div class="content">{}</div>', '<div id="post">{}</div>', "<main><article>{}</article></main>", "<div>{}</div>"])
    if not told:
        wrap = "<div>{}</div>"
    before, after = "".join(clutter() for _ in range(rng.randint(0, 4))), "".join(clutter() for _ in range(rng.randint(0, 4)))
    plain = f"<div>{prose(2, 12)}</div>" if "<div>{}" not in wrap and rng.random() < 0.3 else ""
    page = f"<html><head><title>{prose(2, 9)}</title></head><body>{before}{plain}{wrap.format(whole)}{after}</body></html>"
    return page, [text.startswith("MAIN") for _, text in blocks(page)]


@lru_cache(maxsize=2)
def fitted(pages: int = 700, seed: int = 5, rounds: int = 400) -> np.ndarray:
    """Weights of the classifier: log-odds of main text, fitted on generated pages."""
    rng = random.Random(seed)
    rows, marks = [], []
    for _ in range(pages):
        page, good = _made_page(rng, rng.random() < TOLD)
        found = blocks(page)
        article = any(6 in b.areas or 7 in b.areas for b, _ in found)
        for (b, text), mark in zip(found, good, strict=True):
            row = np.zeros(FEATURES)
            row[block_features(b, text.removeprefix("MAIN ") or text, article)] = 1
            rows.append(row)
            marks.append(mark)
    x, y = np.array(rows), np.array(marks, float)
    weights, seen = np.zeros(FEATURES), np.full(FEATURES, 1e-6)
    for _ in range(rounds):
        grad = x.T @ (y - 1 / (1 + np.exp(-x @ weights))) - 0.5 * weights
        seen += grad**2
        weights += 0.5 * grad / np.sqrt(seen)
    return weights


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars, n_blocks, n_kept.

    Null and empty html, and pages without main text, give an empty text. Repeated and missing ids keep a
    row each; extra columns are ignored. A page of any length is read whole, in time that grows with its length.
    """
    weights = fitted()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [main_text(html or "", weights) for html in part.column(2).to_pylist()]
                yield pa.record_batch(
                    {
                        "page_id": part.column(0),
                        "url": part.column(1),
                        "text": pa.array([x[0] for x in out], pa.string()),
                        "n_chars": pa.array([len(x[0]) for x in out], pa.int64()),
                        "n_blocks": pa.array([x[1] for x in out], pa.int64()),
                        "n_kept": pa.array([x[2] for x in out], pa.int64()),
                    }
                )

    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")
