"""Main text of web pages by a minimum cut between content and boilerplate.

A page is cut into blocks of text. A linear classifier on a block's own signs (where it stands, what its ancestors are called, share of
link text, length, punctuation) gives a cost, which becomes a capacity to the source (content) or the sink (boilerplate). Neighbours in the
page and siblings in the tree are tied by smoothness edges, weaker the less of the tree they share. The blocks on the
source's side of the minimum cut are the text. One page is one small graph, so pages need no shuffle. Work is about linear in the
page: what a block needs to know of its ancestors is counted while they open and end, and flow is pushed in phases.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements of raw text: without an end tag they take the rest of the page. noscript is one only up to an end tag of its own.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for tag in RAW} | {"noscript": re.compile(r"<(?P<end>/?)noscript(?=[\s/>])[^>]*+(?:>|\Z)", re.I)}
#: Elements whose text is not shown up to their end tag; one that is never closed hides nothing.
CONCEALED = frozenset("svg math object canvas audio video template".split())
FOREIGN = frozenset(("svg", "math"))
#: Elements of foreign content that hold HTML, HTML tags that end it elsewhere, and elements that no end tag from inside reaches across.
POINTS = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small "
    "span strong strike sub sup table tt u ul var".split()
)
BARRIER = POINTS | {"object", "template"}
SELF_CLOSED = re.compile(r"""(?:^|[\s"']|\s[^\s=]+)/\Z""")
#: Tags whose start ends an open element of the same kind of item.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
#: Elements that an item's implied end does not reach across.
SCOPE = frozenset("table ul ol dl select article section div body html main aside nav form td th blockquote".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+[^>]*+)(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s=/"']++)(?:\s*+=\s*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^\s"'>][^\s>]*+)))?""")
HINTS = ("class", "id", "role", "itemprop", "aria-label")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)", re.I)
NAME = re.compile(r"[a-z]+")

# Signs of the classifier: names of ancestors, and weights.
BAD_TAGS = frozenset("nav footer aside form button select dialog menu fieldset search".split())
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments "
    "disqus reply replies respond share sharing social related recommend recommended widget pagination pager copyright legal tags "
    "complementary contentinfo search teaser outbrain taboola skip".split()
)
GOOD_NAMES = frozenset("article articlebody content entry post story body main maincontent postbody text prose".split())
COMMENT_NAMES = frozenset("comment comments disqus reply replies respond".split())
#: Words that leave the meaning of a bad name beside them in one class ("site-footer", but not "has-sidebar" or "social-history").
NEUTRAL = GOOD_NAMES | frozenset(
    "site page global top bottom left right primary secondary box block section list container wrapper wrap inner outer area bar link links header "
    "item items row column col form button buttons icon icons slot unit posts articles stories meta author wp js id".split()
)
#: Bad names that are topics as well: no sign where a section inside the article has one as its anchor.
TOPICS = frozenset("social legal search share sharing notice alert copyright tags related reply respond promotion banner consent subscribe login signup menu".split())
#: Running text, short or not; list items and cells are as much, unless their list is made of links.
PROSE = frozenset("p blockquote pre figcaption caption dt dd li td th".split())
LISTS = frozenset("ul ol dl table".split())
#: What ends a sentence, also where it is not followed by a space, and characters of which a few make a sentence.
ENDS = frozenset(".!?…:;\"”»'。！？」』）．।॥؟۔።၊။។")
DENSE = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff]")
#: Tags whose text is no article, whatever its share of the page.
FIXED = BAD_TAGS - {"form", "fieldset"}
HARD, SOFT, LINKED, WITHIN, SHORT, LONG, PLAIN = -9.0, -4.0, -5.0, 0.4, -1.0, 1.5, 0.25
ADJACENT, SIBLING = 1.0, 0.75


@dataclass(slots=True)
class Element:
    tag: str
    bias: float
    main: bool
    number: int
    link: bool = False
    hidden: bool = False
    holds: bool = False


@dataclass(slots=True)
class Block:
    """A text and its place: ``depth`` block elements around it, ``common`` of them shared with the block before, the innermost but one, and the list around it (0: none)."""

    text: str
    link_chars: int
    depth: int
    common: int
    parent: int
    items: int
    bias: float
    main: bool
    tag: str = ""

    @property
    def heading(self) -> bool:
        return self.tag in HEADINGS


def _attributes(rest: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name; the first of one name counts."""
    out: dict[str, str] = {}
    if rest and not rest.isspace():
        for name, *values in ATTRIBUTE.findall(rest):
            out.setdefault(name.lower(), "".join(values))
    return out


def _hidden(attributes: dict[str, str]) -> bool:
    """Whether an element says that it is not shown: by hidden, by aria-hidden, or by the last display of its style."""
    if "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true":
        return True
    shown = DISPLAY.findall(attributes.get("style", ""))
    return bool(shown) and shown[-1].lower() == "none"


def _names(tag: str, attributes: dict[str, str], inside_main: bool) -> tuple[set[str], set[str]]:
    """Bad and good names of an element.

    A class or a label is bad as a whole: all its words are bad names or leave their meaning. The id of a heading is a slug of its text.
    """
    bad: set[str] = set()
    good: set[str] = set()
    for hint in HINTS:
        value = attributes.get(hint)
        if not value or hint == "id" and tag in HEADINGS:
            continue
        value = value.lower()
        for token in [value] if hint == "aria-label" else value.split():
            words = set(NAME.findall(token))
            good |= words & GOOD_NAMES
            found = words & BAD_NAMES
            if found and words <= BAD_NAMES | NEUTRAL:
                anchor = hint == "id" and inside_main and (tag == "section" or "section" in attributes.get("class", "").lower().split())
                if not (anchor and found <= TOPICS):
                    bad |= found
    return bad, good


def _bias(tag: str, attributes: dict[str, str], inside_main: bool) -> float:
    """What an element's tag and names say about the text in it."""
    if tag in BAD_TAGS or (tag == "header" and not inside_main):
        return HARD
    if not attributes:
        return 0.0
    bad, good = _names(tag, attributes, inside_main)
    if tag == "article":
        bad &= COMMENT_NAMES
    if bad and tag not in ("body", "html", "main"):
        return HARD if tag not in ("p", "span", "h1") else SOFT
    return 1.0 if good else 0.0


def _settle(out: list[Block], signs: list[tuple[Element, ...]]) -> None:
    """Sum the signs of each block, less those of elements that turn out to hold the article.

    An element that holds a main element has lost its penalty. One that holds an article keeps it only while at least half of the text in
    articles is outside such elements; without any article, one loses it that holds most of the page's text. Links are not counted.
    """
    has_main = any(b.main for b in out)
    size = [len(b.text) - min(len(b.text), b.link_chars) for b in out]
    against = [[e for e in some if e.bias < 0] for some in signs]
    if has_main:
        core = [i for i, some in enumerate(against) if out[i].main and all(e.holds and e.tag not in FIXED for e in some)]
        free = sum(size[i] for i in core if not against[i])
        if 2 * free < sum(size[i] for i in core):
            for i in core:
                for e in against[i]:
                    e.bias = 0.0
    else:
        held: dict[int, int] = {}
        for i, some in enumerate(against):
            for e in some:
                # Comments are the content of a page that has no other article.
                if e.tag == "article":
                    e.bias = 0.0
                held[e.number] = held.get(e.number, 0) + size[i]
        total = sum(size)
        for some in against:
            for e in some:
                if e.tag not in FIXED and 2 * held[e.number] > total:
                    e.bias = 0.0
    for b, some in zip(out, signs):
        b.bias = sum(e.bias for e in some)


def _tokens(page: str) -> list[tuple[int, int, str | None, bool, str]]:
    """Tags in page order as (begin, end, name, is end tag, attributes); what shows no text is one token without a name."""
    out: list[tuple[int, int, str | None, bool, str]] = []
    #: Open elements from the first concealed one on, with their place in ``out``.
    opened: list[tuple[str, int]] = []
    at = 0
    while token := TOKEN.search(page, at):
        begin, at = token.span()
        tag = token["tag"]
        if tag is None:
            out.append((begin, at, None, False, ""))
            continue
        tag, rest = tag.lower(), token["rest"]
        out.append((begin, at, tag, bool(token["end"]), rest))
        if token["end"]:
            if not opened:
                continue
            for depth in range(len(opened) - 1, -1, -1):
                name, place = opened[depth]
                if name == tag:
                    if tag in CONCEALED:
                        out[place:] = [(out[place][0], at, None, False, "")]
                    del opened[depth:]
                    break
                if name in BARRIER:
                    break
            else:
                # An element around the concealed one ends, and so does that one.
                if tag in BLOCK or tag in BREAKOUT or tag == "a":
                    opened.clear()
            continue
        foreign = bool(opened) and next((name for name, _ in reversed(opened) if name in FOREIGN or name in POINTS), "") in FOREIGN
        if foreign and tag in BREAKOUT:
            while opened.pop()[0] not in FOREIGN:
                pass
            foreign = False
        if not foreign and tag in RAW_END:
            found = RAW_END[tag].search(page, at)
            if tag in RAW or found and found["end"]:
                at = found.end() if found else len(page)
                out[-1] = (begin, at, None, False, "")
            continue
        if tag in VOID or (foreign or tag in FOREIGN) and SELF_CLOSED.search(rest):
            if tag in FOREIGN:
                out[-1] = (begin, at, None, False, "")
            continue
        if opened or tag in CONCEALED:
            opened.append((tag, len(out) - 1))
    return out


class Place:
    """The open elements around the current point, with what blocks ask of them counted as they open and end."""

    def __init__(self) -> None:
        self.stack: list[Element] = []
        self.open: dict[str, int] = {}
        self.blocks: list[Element] = []
        self.lists: list[int] = []
        self.biased: list[Element] = []
        self.signs: tuple[Element, ...] = ()
        self.links = self.hidden = self.mains = 0
        #: Fewest block elements open since the last block.
        self.low = 0

    def push(self, e: Element) -> None:
        self.stack.append(e)
        self.open[e.tag] = self.open.get(e.tag, 0) + 1
        if e.tag in BLOCK:
            self.blocks.append(e)
        if e.tag in LISTS:
            self.lists.append(e.number)
        if e.bias:
            self.biased.append(e)
            self.signs = ()
        self.links += e.link
        self.hidden += e.hidden
        self.mains += e.main

    def pop(self, count: int) -> None:
        for _ in range(count):
            e = self.stack.pop()
            self.open[e.tag] -= 1
            if e.tag in BLOCK:
                self.blocks.pop()
            if e.tag in LISTS:
                self.lists.pop()
            if self.biased and self.biased[-1] is e:
                self.biased.pop()
                self.signs = ()
            self.links -= e.link
            self.hidden -= e.hidden
            self.mains -= e.main
        self.low = min(self.low, len(self.blocks))

    def end(self, tag: str) -> None:
        """Close the innermost element of a tag; an inline one only inside its block."""
        if not self.open.get(tag):
            return
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth].tag == tag:
                self.pop(len(self.stack) - depth)
                return
            if tag not in BLOCK and self.stack[depth].tag in BLOCK:
                return

    def imply(self, ends: set[str] | tuple) -> None:
        """Close the item that the start of another one ends."""
        if not any(self.open.get(t) for t in ends):
            return
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth].tag in ends:
                self.pop(len(self.stack) - depth)
                return
            if self.stack[depth].tag in SCOPE:
                return

    def block(self, text: str, link_chars: int) -> Block:
        if self.biased and not self.signs:
            self.signs = tuple(self.biased)
        around = self.blocks
        made = Block(text, link_chars, len(around), self.low, around[-2].number if len(around) > 1 else 0, self.lists[-1] if self.lists else 0, 0.0, self.mains > 0, around[-1].tag if around else "")
        self.low = len(around)
        return made


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order, with what is known of their place."""
    place = Place()
    out: list[Block] = []
    signs: list[tuple[Element, ...]] = []
    parts: list[str] = []
    link_chars = 0
    serial = 0

    def flush() -> None:
        nonlocal link_chars
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(place.block(text, link_chars))
                signs.append(place.signs)
            parts.clear()
        link_chars = 0

    at = 0
    for begin, end, tag, closing, rest in _tokens(page):
        if begin > at and not place.hidden:
            piece = page[at:begin]
            if "&" in piece:
                piece = entities.unescape(piece)
            parts.append(piece)
            if place.links:
                link_chars += len(piece)
        at = end
        if tag is None:
            continue
        if closing:
            if tag in BLOCK:
                flush()
            place.end(tag)
            continue
        if tag == "br" or tag == "wbr":
            parts.append(" " if tag == "br" else "")
            continue
        if tag in BLOCK:
            flush()
            place.imply(CLOSES.get(tag) or (CLOSES["p"] if tag not in ("button", "option") else ()))
        if tag in VOID or rest.endswith("/") and tag not in BLOCK:
            continue
        serial += 1
        attributes = _attributes(rest)
        bias = _bias(tag, attributes, place.mains > 0)
        main = tag == "main" or 'role="main"' in rest
        for e in place.stack if main or tag == "article" and bias >= 0 else ():
            if main:
                e.bias = max(e.bias, 0.0)
            e.holds = True
        place.push(Element(tag, bias, main or tag == "article" and bias >= 0, serial, tag == "a", _hidden(attributes)))
    if at < len(page) and not place.hidden:
        parts.append(entities.unescape(page[at:]))
    flush()
    _settle(out, signs)
    return out


def costs(blocks: list[Block]) -> list[float]:
    """Log-odds of each block to be content: positive goes to the source, negative to the sink.

    A short block is a sign of boilerplate where nothing says that it is running text. Paragraphs, list items and cells say so, the latter unless most of their list is links.
    """
    has_main = any(b.main for b in blocks)
    listed: dict[int, list[int]] = {}
    for b in blocks:
        if b.items:
            sums = listed.setdefault(b.items, [0, 0])
            sums[0] += len(b.text)
            sums[1] += min(len(b.text), b.link_chars)
    out = []
    for b in blocks:
        size = len(b.text)
        linked = min(1.0, b.link_chars / size)
        ends = b.text[-1] in ENDS
        prose = b.tag in PROSE and (not b.items or 2 * listed[b.items][1] <= listed[b.items][0])
        # Links inside a paragraph are part of it, unless it is nothing else.
        cost = b.bias + LINKED * max(0.0, linked - 0.3) * (WITHIN if prose and linked < 0.9 else 1.0)
        if has_main:
            cost += 5.0 if b.main else -5.0
        if size <= 120 and not ends:
            size += 2 * len(DENSE.findall(b.text))
        if b.heading:
            cost += PLAIN
        elif size > 120 or ends:
            cost += LONG
        elif size < 40 and not prose:
            cost += SHORT
        else:
            cost += PLAIN
        if not b.main and ("©" in b.text or "all rights reserved" in b.text.lower()):
            cost += SOFT
        out.append(cost)
    return out


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours by the share of the tree they have in common, and next siblings under one parent."""
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i and b.common:
            out.append((i - 1, i, ADJACENT * b.common / max(1, blocks[i - 1].depth, b.depth)))
        if b.parent in last and last[b.parent] != i - 1:
            out.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    return out


def minimum_cut(terminal: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Nodes on the source's side of the minimum cut.

    ``terminal``: capacity from the source (positive) or to the sink (negative); edges go both ways. Flow is pushed in phases: all that fits along shortest paths of
    one length, then those of the next. What the source can still reach at the end is its side.
    """
    excess = list(terminal)
    next_to: list[list[int]] = [[] for _ in excess]
    to: list[int] = []
    room: list[float] = []
    for a, b, capacity in edges:
        next_to[a].append(len(to))
        to.append(b)
        room.append(capacity)
        next_to[b].append(len(to))
        to.append(a)
        room.append(capacity)
    tiny = 1e-9
    while True:
        level = [0 if e > tiny else -1 for e in excess]
        queue = deque(i for i, x in enumerate(level) if x == 0)
        nearest = -1
        while queue:
            u = queue.popleft()
            if excess[u] < -tiny:
                nearest = level[u] if nearest < 0 else nearest
            for k in next_to[u]:
                v = to[k]
                if room[k] > tiny and level[v] < 0:
                    level[v] = level[u] + 1
                    queue.append(v)
        if nearest < 0:
            return [x >= 0 for x in level]
        at = [0] * len(excess)
        for source in [i for i, e in enumerate(excess) if e > tiny]:
            path: list[int] = []
            u = source
            while excess[source] > tiny:
                if excess[u] < -tiny:
                    flow = min([excess[source], -excess[u], *[room[k] for k in path]])
                    excess[source] -= flow
                    excess[u] += flow
                    for n, k in enumerate(path):
                        room[k] -= flow
                        room[k ^ 1] += flow
                    # Go on from the first edge that is full.
                    cut = next((n for n, k in enumerate(path) if room[k] <= tiny), len(path))
                    u = to[path[cut] ^ 1] if cut < len(path) else u
                    del path[cut:]
                    continue
                while at[u] < len(next_to[u]):
                    k = next_to[u][at[u]]
                    if room[k] > tiny and level[to[k]] == level[u] + 1 and level[to[k]] <= nearest:
                        path.append(k)
                        u = to[k]
                        break
                    at[u] += 1
                else:
                    if not path:
                        break
                    u = to[path.pop() ^ 1]
                    at[u] += 1


def densest(blocks: list[Block]) -> list[bool]:
    """The run of blocks with the most text outside links, among those that nothing speaks against. None, if all their text is links."""
    has_main = any(b.main for b in blocks)
    best, most, start, total = (0, 0), 0, 0, 0
    for i, b in enumerate(blocks):
        if b.bias < 0 or (has_main and not b.main):
            start, total = i + 1, 0
            continue
        total += len(b.text) - min(len(b.text), b.link_chars)
        if total > most:
            best, most = (start, i + 1), total
    return [best[0] <= i < best[1] for i in range(len(blocks))]


def main_text(page: str | None) -> str:
    """Text of the content blocks, joined by an empty line; empty for null, empty or textless pages."""
    blocks = blocks_of(page) if page else []
    if not blocks:
        return ""
    side = minimum_cut(costs(blocks), edges_of(blocks))
    if not any(side):
        side = densest(blocks)
    return "\n\n".join(b.text for b, content in zip(blocks, side) if content)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of each row of ``pages``; repeated rows stay.

    Null, empty and textless pages have an empty text; null ids and urls stay null; a page of any length is worked on whole, in about linear time. Other columns take no part.
    If no block passes, the densest run of blocks that nothing speaks against is the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                some = batch.slice(begin, 256)
                texts = [main_text(h.as_py()) for h in some.column(2)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    narrow = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long")
