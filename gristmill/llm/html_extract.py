"""Main text of web pages from flat text blocks, classified by a decision tree.

A page is cut into blocks at the tags that break a line.  A block has its words, its link density (the share of its
words that stand in links) and those of the blocks before and after it.  Besides these figures the tree sees

- inside: whether the block stands in the page's main container, which is found by words: the article or main element
  with most words outside links, if it holds a fair share of the page's, else the innermost element that holds most of
  them.  So marks that are absent or misleading do no harm.  An article within an article is a comment or a teaser;
- furniture: whether it stands in an element for menus, footers, sidebars, forms and the like;
- named: whether class, id or role of an element around it name such a thing; if that element holds the page's title,
  its name is taken for misleading;
- heading, and early: before the first heading of a page that has one.

The tree decides for each block.  It is fitted here, on a small labelled table of kinds of blocks and
their neighbours, by choosing splits of least Gini impurity.  The reader of tags is linear in the page's length.

Within a block white space becomes one space; character references are decoded; blocks are joined by two line feeds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gristmill.session import ship

# Element names of HTML by what they mean here.
BREAKING = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol option optgroup p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
SILENT = frozenset("script style template noscript svg math iframe object canvas audio video head title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav footer aside form menu dialog button select fieldset".split())
CONTENT = frozenset("article main".split())
CONTAINERS = frozenset("html body div section article main form center table tbody tr td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What can stand in a head; other elements and text close it, as ``</head>`` may be left out.
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
#: Of these only the tag is passed over where the end tag is missing.
SKIPPED_IF_OPEN = frozenset("noscript svg iframe template".split())
#: Elements that a new one of the same name closes.
ONE_OPEN = frozenset("li dt dd tr td th option".split())
#: Words of class, id and role that tell furniture.
FURNITURE_WORDS = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disqus footer login masthead menu modal nav navbar navigation newsletter notice pagination popup promo recommended related replies rss share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar widget".split())
#: Least share of the page's words of a marked container, and of a container's words for going down to a part of it.
MARKED_SHARE, INNER_SHARE = 0.2, 0.6
#: The latter where the title stays outside of the part.
UNTITLED_SHARE = 0.85

_OPENS = re.compile(r"<(?:!--|!|\?|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_VALUE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
_CLOSES = re.compile(r"[\s/=]*>")
_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")}
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPLIT = re.compile(r"[^a-z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    """A text block, its figures, and what the elements around it say."""

    text: str
    words: int
    link_words: int
    node: int
    heading: bool
    inside: bool = False
    furniture: bool = False
    named: bool = False
    early: bool = False

    @property
    def density(self) -> float:
        return self.link_words / self.words if self.words else 0.0


@dataclass
class _Node:
    """An element: its parent's number, and what its own tag says."""

    name: str
    parent: int
    silent: bool = False
    link: bool = False
    furniture: bool = False
    named: bool = False
    mass: int = 0  # words outside links, furniture and named parts, of all that it holds
    titled: bool = False  # holds an h1 or a main element


def _signs(attributes: Sequence[tuple[str, str]]) -> tuple[bool, bool]:
    """Whether a tag's attributes name furniture, or hide what it holds."""
    named = hidden = False
    for key, value in attributes:
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN_STYLE.search(value):
            hidden = True
        elif key in ("class", "id", "role"):
            named |= not FURNITURE_WORDS.isdisjoint(_SPLIT.split(_CAMEL.sub("-", value).lower()))
    return named, hidden


def _attributes(html: str, at: int) -> tuple[list[tuple[str, str]], bool, int]:
    """Attributes of the tag whose name ends at ``at``, whether it closes itself, and where it ends (-1: it doesn't)."""
    found = []
    while True:
        end = _CLOSES.match(html, at)
        if end:
            return found, "/" in end.group(), end.end()
        one = _VALUE.match(html, at)
        if not one:
            return found, False, -1
        found.append((one.group(1), one.group(2) or ""))
        at = one.end()


def blocks_of(html: str) -> list[Block]:
    """Flat text blocks in page order.  One pass over the tags; unclosed and stray tags are no error."""
    found: list[Block] = []
    nodes = [_Node("", -1)]
    stack = [0]
    opened: Counter[str] = Counter()
    pieces: list[tuple[str, bool]] = []
    unclosed: set[str] = set()  # without an end tag in what is left

    def pop() -> str:
        name = nodes[stack.pop()].name
        opened[name] -= 1
        return name

    def flush() -> None:
        if not pieces:
            return
        text = _SPACE.sub(" ", "".join(p for p, _ in pieces)).strip()
        if text:
            links = sum(len(p.split()) for p, link in pieces if link)
            words = len(text.split())
            heading = any(nodes[n].name in HEADINGS for n in stack[-3:])
            found.append(Block(text, words, min(words, links), stack[-1], heading))
        pieces.clear()

    def close_head() -> None:
        if nodes[stack[-1]].name == "head":
            pop()

    def close_paragraph() -> None:
        # also with inline elements left open in it
        depth = len(stack) - 1
        while depth and nodes[stack[depth]].name not in BREAKING:
            depth -= 1
        if nodes[stack[depth]].name == "p":
            while pop() != "p":
                pass

    def add(text: str) -> None:
        if text.strip():
            close_head()
        top = nodes[stack[-1]]
        if text and not top.silent:
            pieces.append((unescape(text), top.link))

    at, n = 0, len(html)
    while at < n:
        tag = _OPENS.search(html, at)
        if not tag:
            break
        if tag.group(2) is None:
            end = html.find("-->" if tag.group() == "<!--" else ">", tag.end())
            if end < 0 and tag.group() != "<!--":
                break
            add(html[at : tag.start()])
            at = n if end < 0 else end + (3 if tag.group() == "<!--" else 1)
            continue
        attributes, alone, end = _attributes(html, tag.end())
        if end < 0:
            break
        add(html[at : tag.start()])
        at = end
        name, closing = tag.group(2).lower(), bool(tag.group(1))
        if not closing and name not in IN_HEAD:
            close_head()
        if name == "br":
            add(" ")
            continue
        if name in BREAKING:
            flush()
        if closing:
            if opened[name]:
                while pop() != name:
                    pass
            continue
        if name in VOID:
            continue
        if name in BREAKING and opened["p"]:
            close_paragraph()
        if name in ONE_OPEN and nodes[stack[-1]].name == name:
            pop()
        if name in _RAW and not alone:
            raw = None if name in unclosed else _RAW[name].search(html, at)
            if not raw:
                unclosed.add(name)
            at = raw.end() if raw else (at if name in SKIPPED_IF_OPEN else n)
            continue
        if alone:
            continue
        named, hidden = _signs(attributes)
        above = nodes[stack[-1]]
        in_content = any(opened[c] for c in CONTENT)
        furniture = name in FURNITURE or name == "header" and not in_content or name == "article" and opened["article"] > 0
        nodes.append(_Node(name, stack[-1], above.silent or hidden or name in SILENT, above.link or name == "a", furniture, named and name not in ("html", "body", *CONTENT)))
        nodes[-1].titled = name in ("h1", "main")
        stack.append(len(nodes) - 1)
        opened[name] += 1
    add(html[at:])
    flush()
    _mark(nodes, found)
    return found


def _mark(nodes: list[_Node], blocks: Sequence[Block]) -> None:
    """Set what blocks take from the elements around them.  A node's number is above its parent's."""
    for node in reversed(nodes[1:]):
        nodes[node.parent].titled |= node.titled
    for node in nodes[1:]:
        above = nodes[node.parent]
        # forms and names that are around the whole page mean nothing
        node.furniture = above.furniture or node.furniture and not (node.name == "form" and node.titled)
        node.named = above.named or node.named and not node.titled
    for block in blocks:
        node = nodes[block.node]
        block.furniture, block.named = node.furniture, node.named
        if not (block.furniture or block.named):
            node.mass += block.words - block.link_words
    for node in reversed(nodes[1:]):
        nodes[node.parent].mass += node.mass
    children: dict[int, list[int]] = {}
    for i, node in enumerate(nodes[1:], 1):
        if node.name in CONTAINERS:
            children.setdefault(node.parent, []).append(i)
    marked = [i for i, node in enumerate(nodes) if node.name in CONTENT and not node.furniture and not node.named]
    # among equal ones the outer, first one
    main = max(marked, key=lambda i: (nodes[i].mass, -i), default=0)
    if nodes[main].mass < max(1, MARKED_SHARE * nodes[0].mass):
        main = 0
    while True:
        inner = max(children.get(main, ()), key=lambda i: nodes[i].mass, default=0)
        # a marked container is left for a marked one only
        share = UNTITLED_SHARE if nodes[main].titled and not nodes[inner].titled else INNER_SHARE
        if not inner or nodes[inner].mass < share * nodes[main].mass or nodes[main].name in CONTENT and nodes[inner].name not in CONTENT:
            break
        main = inner
    inside = [False] * len(nodes)
    for i, node in enumerate(nodes):
        inside[i] = i == main or i > 0 and inside[node.parent]
    first = next((k for k, b in enumerate(blocks) if b.heading and not b.furniture and not b.named), 0)
    for k, block in enumerate(blocks):
        block.inside, block.early = inside[block.node], k < first


# decision tree

FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "inside", "furniture", "named", "heading", "early")

#: Neighbours as (words, link density): text, links, and both with none at all.
_TEXT = ((2, 0.0), (9, 0.0), (40, 0.0), (90, 0.1))
_LINKS = ((1, 1.0), (3, 1.0), (8, 0.9))
_NONE = ((0, 0.0),)
#: Blocks of text and of links.
_LINES, _PARAGRAPHS, _ANCHORS = ((1, 0.0), (3, 0.0), (7, 0.0)), ((15, 0.0), (45, 0.2), (120, 0.1)), ((1, 1.0), (4, 1.0), (9, 0.8))
#: What stands around a block: inside, furniture, named, heading, early.
_INSIDE, _HEADING, _EARLY = (1, 0, 0, 0, 0), (1, 0, 0, 1, 0), (1, 0, 0, 0, 1)

#: Labelled kinds of blocks: the block's own figures, those before and after, what stands around; 1 for main text.
KINDS: tuple[tuple, ...] = (
    (_LINES + _PARAGRAPHS, _TEXT + _NONE, _TEXT + _NONE, _INSIDE, 1),
    (_LINES + _PARAGRAPHS, _TEXT + _NONE + _LINKS, _TEXT, _HEADING, 1),
    (_LINES, _TEXT + _LINKS, _LINKS, _HEADING, 0),  # the heading of a list of links
    (_LINES + _PARAGRAPHS, _TEXT, _LINKS, _INSIDE, 1),
    (_LINES + _PARAGRAPHS, _LINKS, _TEXT, _INSIDE, 1),
    (_PARAGRAPHS, _LINKS, _LINKS + _NONE, _INSIDE, 1),
    (_LINES, _LINKS, _LINKS, _INSIDE, 0),  # what stands between links
    (_ANCHORS, _TEXT, _TEXT, _INSIDE, 1),  # a link in a line of its own
    (_ANCHORS, _LINKS + _NONE, _LINKS + _TEXT + _NONE, _INSIDE, 0),
    (_ANCHORS, _TEXT, _LINKS + _NONE, _INSIDE, 0),
    (_LINES + ((15, 0.0), (22, 0.0)), _LINKS + _NONE, _TEXT, _EARLY, 0),  # before the title
    (((45, 0.0), (80, 0.1)), _LINKS + _NONE, _TEXT, _EARLY, 1),
    (_ANCHORS, _LINKS + _NONE, _LINKS + _TEXT, _EARLY, 0),
    *((_LINES + _PARAGRAPHS + _ANCHORS, _TEXT + _LINKS, _TEXT + _LINKS + _NONE, signs, 0) for signs in ((0, 0, 0, 0, 0), (0, 0, 0, 1, 0), (0, 0, 0, 0, 1), (1, 1, 0, 0, 0), (0, 1, 0, 0, 1), (1, 1, 0, 1, 0), (1, 0, 1, 0, 0), (1, 0, 1, 1, 0), (0, 0, 1, 0, 0))),
)


def labelled(kinds: Sequence[tuple] = KINDS, every: int = 2) -> list[tuple[float, ...]]:
    """The labelled table: every second one of each kind's blocks with each of its neighbours, and at least one."""
    out = []
    for own, before, after, signs, label in kinds:
        rows = [(*o, *b, *a, *signs, label) for o in own for b in before for a in after]
        out += rows[::every]
    return out


@dataclass(frozen=True)
class Leaf:
    label: int


@dataclass(frozen=True)
class Split:
    feature: int
    limit: float
    low: Leaf | Split
    high: Leaf | Split


def grow(rows: Sequence[Sequence[float]], depth: int = 12) -> Leaf | Split:
    """A tree over rows whose last value is the label; the first best split wins, so it's the same every time."""
    ones = sum(r[-1] for r in rows)
    if not depth or ones in (0, len(rows)):
        return Leaf(int(2 * ones >= len(rows)))

    def impurity(part: list[Sequence[float]]) -> float:
        share = sum(r[-1] for r in part) / len(part)
        return len(part) * share * (1 - share)

    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            limit = (a + b) / 2
            low, high = [r for r in rows if r[f] <= limit], [r for r in rows if r[f] > limit]
            cost = impurity(low) + impurity(high)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, limit, low, high)
    if best is None:
        return Leaf(int(2 * ones >= len(rows)))
    _, f, limit, low, high = best
    return Split(f, limit, grow(low, depth - 1), grow(high, depth - 1))


def decide(tree: Leaf | Split, row: Sequence[float]) -> int:
    while isinstance(tree, Split):
        tree = tree.low if row[tree.feature] <= tree.limit else tree.high
    return tree.label


def rows_of(blocks: Sequence[Block]) -> list[tuple[float, ...]]:
    """Features of each block, its neighbours' figures included."""
    figures = [(0, 0.0), *((b.words, b.density) for b in blocks), (0, 0.0)]
    return [(*figures[i + 1], *figures[i], *figures[i + 2], b.inside, b.furniture, b.named, b.heading, b.early) for i, b in enumerate(blocks)]


def main_text(html: str, tree: Leaf | Split) -> str:
    """The main text of a page: its blocks that the tree takes, joined by two line feeds."""
    blocks = blocks_of(html)
    return "\n\n".join(b.text for b, row in zip(blocks, rows_of(blocks), strict=True) if decide(tree, row))


def extract(pages: DataFrame, table: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """page_id, url, text, n_chars: the main text of each page.

    Null html counts as empty and gives an empty text, as does a page without main text.  Rows of equal id are rows of
    their own; extra columns are ignored.  Whole pages are read, in time linear in their length.
    """
    ship(pages.sparkSession)
    tree = grow(table or labelled())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                texts = [main_text(h or "", tree) for h in rows.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = T.StructType([pages.schema["page_id"], pages.schema["url"]]).add("text", "string").add("n_chars", "long")
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
