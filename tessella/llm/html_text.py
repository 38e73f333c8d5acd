"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks, each with its path of open elements. A linear classifier over a block's own features
gives log-odds that it is content, which become its terminal capacity: to the source where positive, to the sink where
negative. Edges between neighbouring blocks and between blocks of one parent carry smoothness capacities that fall with
their distance in the tree. The minimum cut, found by maximum flow, labels all blocks of the page together.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import text_of

_START = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
#: What decides where a tag ends: its ">", and the values that may hold one. A quote opens a value only after "=".
_EVENT = re.compile(r">|=\s*+(?:[\"']|[^\s>]*+)")
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_READ = frozenset("class id role style hidden aria-hidden".split())
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: An open paragraph ends where one of these begins.
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER = frozenset("head svg math object select option button audio video canvas".split())

#: Log-odds that an open element adds to the blocks inside it, by its tag and by the parts of its class, id and role.
TAG_ODDS = {"article": 6.0, "main": 3.0, "nav": -12.0, "footer": -12.0, "aside": -12.0, "form": -12.0, "menu": -12.0, "dialog": -12.0, "header": -5.0}
NAME_ODDS = (
    dict.fromkeys(
        """ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comentarios kommentare
        commentaires commentary discussion disqus replies reply respond cookie cookies consent gdpr notice notices alert popup modal overlay paywall
        promo promoted promotion sponsor sponsored menu nav navbar navigation pagination pager sidebar rail widget related recommended
        recommendations trending popular footer foot masthead topbar toolbar social share sharing subscribe subscription newsletter signup
        login search tags tagcloud copyright legal disclaimer dialog contentinfo complementary toc skip""".split(),
        -12.0,
    )
    | {"header": -5.0, "head": -3.0, "article": 3.0, "content": 2.0, "main": 3.0, "post": 2.0, "entry": 2.0, "story": 2.0, "body": 1.0, "text": 1.0, "prose": 2.0}
)

#: What an edge between blocks of one element weighs.
WEIGHT = 2.5

LAYOUT = frozenset("with has no without".split())


@dataclass
class Block:
    """Text between two borders of block elements, the innermost block element around it and what speaks for it."""

    text: str
    node: Node
    tag: str
    odds: float
    linked: int


@dataclass
class Node:
    """A block element; the root, which is the page, has no parent."""

    parent: Node | None
    depth: int


class _Tags:
    """Finds where tags end, in time linear in the page however broken its quotes are."""

    def __init__(self, html: str):
        self.html = html
        self.dead: set[int] = set()  # events after which no tag ends outside of quotes
        self.closed = {"'": True, '"': True}  # whether a further quote is to come
        self.gap = (0, -1, None)  # from one place to another the next event is this

    def _event(self, at: int) -> re.Match | None:
        begin, end, event = self.gap
        if not begin <= at <= end:
            event = _EVENT.search(self.html, at)
            self.gap = (at, event.start() if event else len(self.html), event)
        return event

    def end(self, at: int) -> int:
        """Behind the ">" of the tag that goes on at ``at``; -1 if there is none. A value ends at its closing quote however
        far that is; a quote that is never closed is a character as any other. If no ">" is left outside of quotes the
        tag ends at the first one."""
        html, begin, walked = self.html, at, []
        while (event := self._event(at)) and event.start() not in self.dead:
            if event[0] == ">":
                return event.end()
            walked.append(event.start())
            at, quote = event.end(), event[0][1:].lstrip()
            if self.closed.get(quote):
                close = html.find(quote, at)
                self.closed[quote] = close >= 0
                at = close + 1 if close >= 0 else at
        self.dead.update(walked)
        return html.find(">", begin) + 1 or -1


def _element_odds(tag: str, attributes: str) -> float:
    odds = TAG_ODDS.get(tag, 0.0)
    if tag in ("html", "body") or not attributes.strip("/> \n\t"):
        return odds
    worst, best = 0.0, 0.0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name not in _READ:
            continue
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            worst = -12.0
        elif name in ("class", "id", "role"):
            for token in value.split():
                parts = [x.lower() for x in _NAME_PART.findall(token)]
                odds_of = [NAME_ODDS.get(x, 0.0) for x in parts]
                if not LAYOUT.intersection(parts):  # "with-sidebar" says how the page is laid out, not what this is
                    worst = min([worst, *odds_of])
                best = max([best, *odds_of])
    return odds + worst + (best if worst == 0.0 else 0.0)


def blocks_of(html: str) -> list[Block]:
    """The text blocks of a page in page order. Broken markup is read as browsers do: stray ends are ignored, a new
    block ends an open paragraph, what is never closed lasts to the end of its parent. The time is linear in the page:
    what is open is counted by tag, and a block knows its parent element only."""
    out: list[Block] = []
    root = Node(None, 0)
    stack: list[tuple[str, float, Node]] = []  # tag, log-odds with all that is around it, innermost block element
    places: dict[str, list[int]] = {}  # where each tag is open in the stack
    outer: list[int] = []  # where block elements are
    parts: list[str] = []
    linked, never, at = 0, 0, 0
    tags = _Tags(html)

    def flush() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            tag, odds = (stack[outer[-1]][0] if outer else ""), (stack[-1][1] if stack else 0.0)
            out.append(Block(text, stack[-1][2] if stack else root, tag, odds, min(linked, len(text))))
        linked = 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not never:
            parts.append(raw)
            if places.get("a"):
                linked += len(raw.strip())

    def pop_to(depth: int) -> None:
        nonlocal never
        while len(stack) > depth:
            tag = stack.pop()[0]
            places[tag].pop()
            never -= tag in NEVER
            if outer and outer[-1] == len(stack):
                outer.pop()

    end = len(html)
    while m := _START.search(html, at):
        begin = m.start()
        tag = (m[2] or "").lower()
        if m[0] == "<!--":
            close = html.find("-->", m.end())
            after = close + 3 if close >= 0 else end
        else:
            after = tags.end(m.end()) if tag else html.find(">", m.end()) + 1
            if after <= 0:  # no tag ends from here on, and no comment
                begin = html.find("<!--", m.end())
                end = begin if begin >= 0 else end
                break
        text(html[at:begin])
        at = after
        if not tag:
            continue
        block = tag not in INLINE
        if block:
            flush()
        elif tag == "br":
            parts.append(" ")
        if m[1]:
            if places.get(tag) and (block or not outer or outer[-1] < places[tag][-1]):  # an inline end does not close the block around it
                pop_to(places[tag][-1])
            continue
        attributes = html[m.end() : at - 1]
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b", re.IGNORECASE).search(html, at)
            at = (html.find(">", close.end()) + 1 or end) if close else end
            continue
        if tag in VOID or attributes.endswith("/") and not block:
            continue
        if tag in ENDS_P or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            ends = ("p",) if tag in ENDS_P else ("p", tag)
            nearest = max((places[t][-1] for t in ends if places.get(t)), default=-1)
            if outer and outer[-1] == nearest:
                pop_to(nearest)
        node = stack[-1][2] if stack else root
        if block:
            node = Node(node, node.depth + 1)
            outer.append(len(stack))
        places.setdefault(tag, []).append(len(stack))
        never += tag in NEVER
        stack.append((tag, (stack[-1][1] if stack else 0.0) + _element_odds(tag, attributes), node))
    text(html[at:end])
    flush()
    return out


def log_odds(b: Block) -> float:
    """How much a block by itself looks like content."""
    n = len(b.text)
    share = b.linked / n
    odds = b.odds + (1.2 if b.tag in ("p", "") else 0.8 if b.tag in HEADINGS or b.tag in ("blockquote", "pre") else -0.4)
    odds += 2.0 if n >= 160 else 1.0 if n >= 60 else -0.6
    odds -= 5.0 * share * (1.0 if n < 400 else 0.5)
    if b.tag in ("li", "td", "th", "dt", "dd") and share > 0.5:
        odds -= 2.0
    if re.match(r"(?:©|\(c\)\s|copyright\b)", b.text, re.IGNORECASE):
        odds -= 4.0
    return odds


def steps(a: Node, b: Node) -> int:
    """The steps from one element to another through the tree."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def smoothness(blocks: list[Block], weight: float = WEIGHT) -> list[tuple[int, int, float]]:
    """Edges between neighbours and between blocks under one parent, weaker with each step through the tree."""
    edges = []
    latest: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, weight / (1 + steps(blocks[i - 1].node, b.node))))
        parent = id(b.node.parent or b.node)
        if parent in latest and latest[parent] != i - 1:
            edges.append((latest[parent], i, weight / 3))
        latest[parent] = i
    return edges


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node, whether it stays with the source: the labelling with the least sum of what it costs to go against
    nodes' odds and of the edges that it cuts. Maximum flow by shortest augmenting layers."""
    n = len(odds)
    s, t = n, n + 1
    to: list[int] = []
    room: list[float] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: float, back: float) -> None:
        at[a].append(len(to))
        to.append(b)
        room.append(there)
        at[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, o in enumerate(odds):
        if o > 0:
            join(s, i, o, 0.0)
        elif o < 0:
            join(i, t, -o, 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    small = 1e-9
    while True:
        depth = [-1] * (n + 2)
        depth[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in at[a]:
                if room[e] > small and depth[to[e]] < 0:
                    depth[to[e]] = depth[a] + 1
                    queue.append(to[e])
        if depth[t] < 0:
            return [depth[i] >= 0 for i in range(n)]
        begun = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if room[e] <= small)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while begun[a] < len(at[a]):
                e = at[a][begun[a]]
                if room[e] > small and depth[to[e]] == depth[a] + 1:
                    break
                begun[a] += 1
            if begun[a] < len(at[a]):
                path.append(at[a][begun[a]])
                a = to[path[-1]]
            elif path:
                e = path.pop()
                a = to[e ^ 1]
                begun[a] += 1
            else:
                break


def main_text(html: str) -> str:
    """The content blocks of a page, joined by line feeds; empty if there are none."""
    blocks = blocks_of(html)
    if not blocks:
        return ""
    kept = min_cut([log_odds(b) for b in blocks], smoothness(blocks))
    return "\n".join(b.text for b, k in zip(blocks, kept, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col`` and text, one row a page. Null html is empty and gives an empty text; pages without
    markup are one block; ids may be null or come twice; other columns are not read."""
    schema = T.StructType([pages.schema[id_col], pages.schema[url_col], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = pa.array([main_text(h) for h in batch.column(2).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=schema.names)

    return pages.select(F.col(id_col), F.col(url_col), text_of(html_col).alias("html")).mapInArrow(run, schema)
