"""Main text of web pages by minimum-cut labelling.

A page is read into text blocks below a tree of elements. The blocks, and the elements
whose name or marks say something, are the nodes of a graph. A classifier gives each the
cost of either label: a block by its length, its share of link text, its punctuation and
whether it is a heading; an element by its tag and by the words of its class, id and role, which weigh
less where they only qualify another word, and nothing in names of states. An element
counts once for each block below it. These costs are the capacities from the content
terminal and to the boilerplate terminal.

Arcs carry the smoothness. Blocks that follow each other, and neighbours in one
container, are tied the more the nearer they are in the element tree. Each node is tied
to the nearest element of the graph above it, more strongly against content within
boilerplate than against boilerplate within content. Maximum flow over the whole graph
gives the cheapest labelling, and its content blocks are the text.

No element decides by itself: one that frames the page, as it holds nearly all of the
text with the heading, article or main element in it, or is a form around all of a
page without these, loses its weight.

Defined results: null or empty html, and a page without content, give the empty text;
unclosed or stray tags, unfinished comments, quotes and character references are read
as browsers do; elements may be nested to any depth; repeated rows give equal results;
url is passed through; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewforge.llm.batches import small
from viewforge.sources.tables import table

QUERY = "op2_html_text"

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|</([a-zA-Z][^\s/>]*+)[^>]*+>?|<([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+'|["'])*+)>?""", re.S
)
_MARK = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")

#: Elements by their role in a page (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NO_TEXT = frozenset("head script style noscript template svg canvas object audio video map select button textarea input option datalist dialog iframe math title".split())
OUTER = frozenset("nav footer aside menu".split())
INNER = frozenset("article main".split())
FORMS = frozenset("form fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id or role: those of boilerplate, those that may be, those of a page's head, and those of content.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo nav navbar navigation menu menubar sidebar aside footer breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus respond replies pagination pager".split()
)
MAYBE = frozenset("banner widget widgets toolbar copyright legal disclaimer contentinfo complementary search skip notification promotion".split())
HEADS = frozenset("header masthead topbar".split())
CONTENT = frozenset("article content post entry story main".split())
#: Words beside a mark that make it a state of the page.
BEFORE, AFTER = frozenset("has with without no not hide".split()), frozenset("open closed enabled disabled on off".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_LISTS = frozenset("ul ol dl table select body article section div".split())

#: Costs of blocks; of elements, a block; of arcs. All are of one size, so that none decides alone.
BIAS, SHORT, LINKED, TEXT, STOPS, HEADING = 0.4, 1.0, 3.0, 0.02, 0.3, 0.5
MARKED, PERHAPS, QUALIFIER, ARTICLE, NAMED = 12.0, 6.0, 0.6, 6.0, 2.0
NEAR, INTRODUCED, SAME_CONTAINER, ABOVE, BELOW, OWNED = 3.0, 1.5, 0.5, 12.0, 1.5, 12.0
#: Shares of a page's text from which an element frames it, and at which it does so wholly.
FRAMES, WHOLLY = 0.6, 0.9
#: Steps in the tree beyond which blocks count as this far apart.
FARTHEST = 64


class Element:
    """An element with the elements above it as a linked list."""

    __slots__ = ("name", "up", "depth", "inner", "silent", "linked", "mark", "good", "chars", "frame", "blocks", "node")

    def __init__(self, name: str, up: Element | None):
        self.name, self.up = name, up
        self.depth = up.depth + 1 if up else 0
        self.inner, self.silent, self.linked = (up.inner, up.silent, up.linked) if up else (False, False, False)
        self.mark = self.good = 0.0  # costs of content and of boilerplate
        self.chars = self.blocks = 0  # below it, outside of navigation and the like; all below it
        self.frame = False  # whether an h1, article or main element is below it, outside of marked elements
        self.node = -1


class Block:
    """A run of text and the element that holds it."""

    __slots__ = ("holder", "text", "links")

    def __init__(self, holder: Element, text: str, links: int):
        self.holder, self.text, self.links = holder, text, links


def mark_of(value: str, inner: bool) -> tuple[float, float]:
    """Costs that the words of a class, id or role put on content and on boilerplate."""
    mark = good = 0.0
    for token in value.split():
        words = [w.lower() for w in _WORD.findall(token)]
        for k, word in enumerate(words):
            weight = MARKED if word in MARKS or word in HEADS and not inner else PERHAPS if word in MAYBE else 0.0
            last = k == len(words) - 1
            if weight and not BEFORE.isdisjoint(words[:k]) or not last and words[k + 1] in AFTER:
                continue
            mark = max(mark, weight if last else QUALIFIER * weight)
            if last and word in CONTENT:
                good = NAMED
    return mark, good


def weigh(element: Element, attributes: str) -> None:
    """Sets an element's own costs."""
    name = element.name
    if attributes:
        for key, *values in _MARK.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                element.mark = MARKED
            elif key in ("class", "id", "role"):
                mark, good = mark_of(value, element.inner)
                if key == "role" and value.lower() == "banner" and not element.inner:
                    mark = MARKED
                element.mark, element.good = max(element.mark, mark), max(element.good, ARTICLE if key == "role" and value.lower() in INNER else good)
    if name in OUTER or name in FORMS or name == "header" and not element.inner:
        element.mark = MARKED
    elif name in INNER:
        element.good = ARTICLE
    if element.mark >= MARKED:
        element.good = 0.0
    element.frame = name == "h1" or element.good >= ARTICLE > element.mark
    element.inner |= name in INNER


def blocks_of(page: str) -> tuple[list[Block], list[Element]]:
    """The page's text blocks and its elements, in order; elements that never hold text are left out."""
    blocks: list[Block] = []
    root = Element("", None)
    elements, stack = [root], [root]
    open_names: dict[str, int] = {}
    text: list[str] = []
    links = 0

    def end_block() -> None:
        nonlocal links
        if text:
            words = "".join(text)
            if "&" in words:
                words = html.unescape(words)
            words = " ".join(words.split())
            if words:
                holder = stack[-1]
                while holder.name in INLINE:
                    holder = holder.up
                holder.chars += len(words)
                holder.blocks += 1
                blocks.append(Block(holder, words, links))
            text.clear()
        links = 0

    def close(to: int) -> None:
        if any(e.name not in INLINE for e in stack[to:]):
            end_block()
        while len(stack) > to:
            done = stack.pop()
            open_names[done.name] -= 1
            up = done.up
            up.blocks += done.blocks
            up.frame |= done.frame and done.mark < MARKED
            if done.name not in OUTER:
                up.chars += done.chars

    def last(names, until=frozenset()) -> int:
        if any(open_names.get(name) for name in names):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in names:
                    return k
                if stack[k].name in until:
                    break
        return 0

    at, size = 0, len(page)
    while at < size:
        found = _TAG.search(page, at)
        start = found.start() if found else size
        if start > at and not stack[-1].silent:
            text.append(page[at:start])
            if stack[-1].linked:
                links += start - at
        if not found:
            break
        at = found.end()
        closing, opening, attributes = found.groups()
        if closing:
            name = closing.lower()
            if k := last((name,)):
                close(k)
            elif name == "br":
                text.append(" ")
        elif opening:
            name = opening.lower()
            if name not in INLINE:
                if name == "br":
                    if not stack[-1].silent:
                        text.append(" ")
                    continue
                end_block()
            if name in _CLOSES_P and (k := last(("p",))):
                close(k)
            elif name in _SAME_CLOSES and (k := last(_SAME_CLOSES[name], _LISTS)):
                close(k)
            if name in VOID or attributes.endswith("/") and stack[-1].name in ("svg", "math"):
                continue
            element = Element(name, stack[-1])
            weigh(element, attributes)
            element.silent |= name in NO_TEXT
            element.linked |= name == "a"
            open_names[name] = open_names.get(name, 0) + 1
            stack.append(element)
            elements.append(element)
            if name in RAW:
                end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
                at = end.start() if end else size
        # comments, doctypes and instructions are passed over
    close(1)
    end_block()
    return blocks, elements


def costs(block: Block) -> tuple[float, float]:
    """Cost of calling a block boilerplate, and of calling it content."""
    n = len(block.text)
    linked = min(1.0, block.links / n)
    heading = block.holder.name in HEADINGS
    content = TEXT * min(n, 150) * (1 - linked) + STOPS * min(4, block.text.count(".") + block.text.count(",")) + HEADING * heading
    return content, BIAS + LINKED * linked + (SHORT if n < 25 and not heading else 0.0)


def element_costs(element: Element, page: Element) -> tuple[float, float]:
    """The same for an element, a block below it."""
    share = element.chars / page.chars if page.chars else 0.0
    framing = element.frame or element.name in ("html", "body") or element.name in FORMS and not page.frame
    if element.mark and framing and element.name not in OUTER and share > FRAMES:
        return element.good, element.mark * max(0.0, (WHOLLY - share) / (WHOLLY - FRAMES))
    return element.good, element.mark


def _nearness(a: Element, b: Element) -> float:
    steps = 0
    while a is not b and steps < FARTHEST:
        if a.depth >= b.depth:
            a, b = a.up, b
        else:
            b = b.up
        steps += 1
    return min(NEAR, (NEAR / (1 + steps)) ** 2)


def graph_of(blocks: list[Block], elements: list[Element]) -> tuple[list[float], list[float], list[tuple[int, int, float, float]]]:
    """Costs of boilerplate and of content of each node, blocks first, and the arcs: ends, and cost of either alone as content."""
    content, boiler, arcs = [], [], []
    for block in blocks:
        a, b = costs(block)
        content.append(a)
        boiler.append(b)
    for element in elements:
        above = element.up.node if element.up else -1
        element.node = above
        if element.blocks and (element.mark or element.good):
            good, mark = element_costs(element, elements[0])
            if good or mark:
                element.node = len(content)
                content.append(good * element.blocks)
                boiler.append(mark * element.blocks)
                if above >= 0:
                    arcs.append((element.node, above, ABOVE * element.blocks, BELOW * element.blocks))
    latest: dict[Element | None, int] = {}
    for k, block in enumerate(blocks):
        if block.holder.node >= 0:
            arcs.append((k, block.holder.node, OWNED, OWNED))
        if k:
            w = _nearness(blocks[k - 1].holder, block.holder) * (INTRODUCED if blocks[k - 1].holder.name in HEADINGS else 1)
            arcs.append((k - 1, k, w, w))
        container = block.holder.up
        if latest.get(container, k - 1) < k - 1:
            w = SAME_CONTAINER * _nearness(blocks[latest[container]].holder, block.holder)
            arcs.append((latest[container], k, w, w))
        latest[container] = k
    return content, boiler, arcs


def minimum_cut(content: list[float], boiler: list[float], arcs: list[tuple[int, int, float, float]]) -> list[bool]:
    """For each node whether it is on the content side of a minimum cut: Dinic's maximum flow, then what the source still reaches."""
    n = len(content)
    source, sink = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def arc(a: int, b: int, forth: float, back: float) -> None:
        heads[a].append(len(to))
        to.append(b)
        room.append(round(forth * 1_000_000))
        heads[b].append(len(to))
        to.append(a)
        room.append(round(back * 1_000_000))

    for k, (c, b) in enumerate(zip(content, boiler, strict=True)):
        arc(source, k, c - b, 0.0) if c > b else arc(k, sink, b - c, 0.0)
    for a, b, forth, back in arcs:
        arc(a, b, forth, back)
    while True:
        depth = [-1] * (n + 2)
        depth[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in heads[a]:
                if room[e] and depth[to[e]] < 0:
                    depth[to[e]] = depth[a] + 1
                    queue.append(to[e])
        if depth[sink] < 0:
            return [depth[k] >= 0 for k in range(n)]
        tried = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                full = next(i for i, e in enumerate(path) if not room[e])
                a = to[path[full] ^ 1]
                del path[full:]
                continue
            while tried[a] < len(heads[a]):
                e = heads[a][tried[a]]
                if room[e] and depth[to[e]] == depth[a] + 1:
                    path.append(e)
                    a = to[e]
                    break
                tried[a] += 1
            else:
                if not path:
                    break
                e = path.pop()
                a = to[e ^ 1]
                tried[a] += 1


def labelled(page: str | None) -> list[tuple[str, bool, bool]]:
    """Text of each block, whether it is content, and whether its own costs alone would say so."""
    blocks, elements = blocks_of(page or "")
    if not blocks:
        return []
    content, boiler, arcs = graph_of(blocks, elements)
    side = minimum_cut(content, boiler, arcs)
    return [(block.text, side[k], content[k] > boiler[k]) for k, block in enumerate(blocks)]


def main_text(page: str | None) -> str:
    """The text of the blocks on the content side, joined by one space."""
    return " ".join(text for text, inside, _ in labelled(page) if inside)


def _mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        texts = [main_text(page) for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return chosen.mapInArrow(_mapper, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))
