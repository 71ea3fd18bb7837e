"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to all of their ancestors,
discounted by link density; each level passes on half. The best container is
kept, with those of its siblings, and of its ancestors' siblings, that carry
text of the same kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements whose text is never shown, or never part of an article.
DROPPED = frozenset("script style noscript template iframe object embed svg math canvas audio video head title nav aside footer form button select option textarea input label fieldset dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table caption thead tbody tfoot tr td th "
    "figure figcaption address header footer nav aside form fieldset hr details summary center hgroup head title dialog menu".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Paragraph-like elements hand their points to the element around them.
PARAGRAPHS = frozenset("p pre blockquote li dd dt td th figcaption caption address".split()) | HEADINGS
#: Words of class, id and role that name what isn't the article. They cost an element its place unless the page has next to nothing else.
BOILERPLATE = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies disqus footer "
    "gdpr header login masthead menu menubar modal nav navbar navigation navigator newsletter notice notices notification overlay pager pagination popup promo "
    "promoted promotion related recommended reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar "
    "widget widgets alert complementary contentinfo dialog discussion responses".split()
)
#: They close an open element of the same kind where they begin.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOUNDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
#: An open paragraph is not closed from within these.
SCOPE = frozenset(("table", "td", "th", "caption", "button", "object", "html", "template"))
WEIGHTS = {"article": 15.0, "main": 10.0, "div": 5.0, "section": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "li": -3.0, "address": -3.0}
#: What an element passes on of its children's points.
SHARE = 0.5
#: A container beside the best one, or beside one of its ancestors, is kept from this share of the best one's value.
NEAR, FAR = 0.2, 0.4
#: A paragraph of a listed word needs so many points to stay; a container stays if the rest of the page has less than this share of all.
PLENTY, REST = 2.0, 0.05
#: Containers beside the best one need so many points in any case.
LITTLE = 3.0


class _Node:
    __slots__ = ("parent", "index", "tag", "dropped", "listed", "points", "score", "chars", "links", "anchors", "prose")

    def __init__(self, parent: _Node | None, index: int, tag: str, dropped: bool, listed: bool = False) -> None:
        self.parent, self.index, self.tag, self.dropped, self.listed = parent, index, tag, dropped, listed
        self.points = self.score = 0.0  # of all text within; with each level's share
        self.chars = self.links = self.anchors = self.prose = 0

    def density(self) -> float:
        return self.links / self.chars if self.chars else 0.0


class _Page(HTMLParser):
    """Reads a page to nodes in page order and to blocks of text: (node, text)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [_Node(None, 0, "", False)]
        self.stack = [self.nodes[0]]
        self.blocks: list[tuple[_Node, str]] = []
        self.run: list[str] = []
        self.anchor = 0
        self.in_link = 0
        self.linked = 0

    def flush(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            self.run = []
            if text:
                # Dropped elements add no text, so what waits belongs to the block around them.
                owner = self.stack[-1]
                while owner.parent is not None and (owner.dropped or owner.tag not in BLOCKS):
                    owner = owner.parent
                owner.chars += len(text)
                owner.links += min(self.linked, len(text))
                self.blocks.append((owner, text))
        self.linked = 0

    def pop_to(self, at: int) -> None:
        for node in self.stack[at:]:
            if node.tag == "a":
                self.in_link -= 1
        del self.stack[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br" or tag == "wbr":
            if tag == "br":
                self.run.append(" ")
            return
        top = self.stack[-1]
        dropped, listed = top.dropped or tag in DROPPED, False
        if not dropped and attrs and tag not in ("html", "body", "main"):
            for name, value in attrs:
                if value and name in ("class", "id", "role") and not BOILERPLATE.isdisjoint(re.split(r"[^a-z0-9]+", value.lower())):
                    listed = True
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    dropped = True
        if not dropped and tag == "header" and not any(n.tag == "article" for n in self.stack):
            dropped = True
        if listed and tag not in BLOCKS:  # a part of a line has no score of its own
            dropped = True
        if tag in BLOCKS:
            self.flush()
            if tag not in ("td", "th", "tr", "thead", "tbody", "tfoot", "html", "body"):
                self.close_open(("p",), SCOPE)
        if tag in CLOSES:
            self.close_open(CLOSES[tag], BOUNDS[tag])
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.pop_to(len(self.stack) - 1)
        if tag in VOID:
            return
        parent = self.stack[-1]
        node = _Node(parent, len(self.nodes), tag, dropped or parent.dropped, listed)
        self.nodes.append(node)
        self.stack.append(node)
        if tag == "a":
            self.in_link += 1
            parent.anchors += 1

    def close_open(self, tags: tuple[str, ...], bounds) -> None:
        for at in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[at].tag
            if tag in tags:
                self.flush()
                self.pop_to(at)
                return
            if tag in bounds:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack[-1].tag == tag and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.stack) - 1, 0, -1):
            open_tag = self.stack[at].tag
            if open_tag == tag:
                if tag in BLOCKS:
                    self.flush()
                self.pop_to(at)
                return
            # An inline end tag doesn't close the blocks around it.
            if tag not in BLOCKS and open_tag in BLOCKS and tag not in DROPPED:
                return

    def handle_data(self, data: str) -> None:
        if not self.stack[-1].dropped:
            self.run.append(data)
            if self.in_link:
                self.linked += len(" ".join(data.split()))


def _points(text: str, tag: str) -> float:
    return 0.2 if tag in HEADINGS else 1.0 + text.count(",") + text.count("，") + min(len(text) / 100, 3.0)


def _left_out(nodes: list[_Node], listed: bool) -> list[bool]:
    """Elements that carry no article: dropped ones, and listed ones that others can do without, with all within them."""
    every = nodes[0].points
    out = [False] * len(nodes)
    for n in nodes:
        out[n.index] = n.dropped or n.parent is not None and out[n.parent.index]
        if listed and n.listed and not out[n.index]:
            rest = every - n.points
            out[n.index] = n.points < PLENTY if n.tag in PARAGRAPHS else rest >= REST * every
    return out


def main_text(page: str | None) -> str:
    """The article's blocks, each with single spaces, joined by a line feed; empty if there is none."""
    if not page:
        return ""
    parser = _Page()
    parser.feed(page)
    parser.close()
    parser.flush()
    nodes, blocks = parser.nodes, parser.blocks
    for owner, text in blocks:
        owner.points += _points(text, owner.tag) * (1 - owner.density())
        owner.prose += owner.tag not in HEADINGS
    direct = [n.points for n in nodes]
    for n in reversed(nodes):
        if n.parent is not None:
            n.parent.points += n.points
    out = _left_out(nodes, True)
    for n in nodes:  # a paragraph's points are its parent's
        if direct[n.index] and not out[n.index]:
            home = n.parent if n.tag in PARAGRAPHS and n.parent else n
            home.score += direct[n.index]
    for n in reversed(nodes):  # text and links count for all elements around them
        if n.parent is not None and not out[n.index]:
            n.parent.score += SHARE * n.score
            n.parent.chars += n.chars
            n.parent.links += n.links
            n.parent.anchors += n.anchors
            n.parent.prose += n.prose
    value = lambda n: (n.score + WEIGHTS.get(n.tag, 0.0)) * (1 - n.density()) if n.score else float("-inf")
    best = max((n for n in nodes if n.score and n.parent is not None and not out[n.index]), key=value, default=nodes[0])
    if not best.chars:
        return ""
    children: dict[int, list[_Node]] = {}
    for n in nodes:
        if n.parent is not None and n.chars and not out[n.index]:
            children.setdefault(n.parent.index, []).append(n)
    accepted, at, share = {best.index}, best, NEAR
    while at.parent is not None:
        for n in children[at.parent.index]:
            if n.tag in PARAGRAPHS or not n.prose:
                if share == NEAR and (n.tag in HEADINGS or n.density() < 0.25):
                    accepted.add(n.index)
            elif n is not at and n.score and value(n) >= max(LITTLE, share * value(best)):
                accepted.add(n.index)
        at, share = at.parent, FAR
    inside, menu = [False] * len(nodes), [False] * len(nodes)
    for n in nodes:
        up = n.parent.index if n.parent else None
        inside[n.index] = not out[n.index] and (n.index in accepted or up is not None and inside[up])
        # A list or box of links alone is a menu.
        menu[n.index] = up is not None and menu[up] or n.tag in ("ul", "ol", "div", "section", "table") and n.index not in accepted and n.anchors >= 3 and n.density() >= 0.8
    return "\n".join(text for owner, text in blocks if inside[owner.index] and not menu[owner.index])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages`` (page_id, url, html).

    A null or empty page, one without markup's text, and one that is all
    boilerplate have an empty text; text without any element is one block.
    Elements that stay open, stray end tags and cut pages are read as browsers
    do, near enough. Of containers with one value the first counts. Pages of any
    length are read whole. Repeated rows are extracted each; nulls in other
    columns stay; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html")
    kind = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
