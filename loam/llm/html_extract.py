"""Main text of HTML pages by tree scoring.

A page becomes a tree. What is named or marked up as a menu, header, footer, sidebar, notice, advert, form,
script, style or comment section is left out. Each paragraph gives points for being one, for its length and
for its commas to its container, and a share to the containers above; a container's points are discounted by
its link density. The best container is the article, with those siblings that score well beside it.

Null, empty and text-free pages give an empty text; markup that isn't closed is closed where HTML would close
it; equal pages give equal texts; an empty table gives no rows; input columns named like a result are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

from pyspark.sql import DataFrame

from .common import ddl, text_column, with_computed

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<svg\b(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*/>"
    r"|<(script|style|noscript|template|textarea|svg|iframe|object|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|</?([a-zA-Z][^\s/>]*+)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>"
    r"|</?([a-zA-Z][^\s/>]*+)([^>]*)>"
    r"|<[!?/][^>]*>|[^<]+|<",
    re.S | re.I,
)
# One attribute after the other, each consumed whole: what a value holds is never taken for a name.
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head nav header footer aside form button select option label fieldset dialog menu canvas audio video annotation annotation-xml".split())
BLOCKS = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body center div html main section td".split())
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "tbody": "tr td th thead tbody", "thead": "tbody", "tfoot": "tr td th tbody"}
CLOSES = {tag: frozenset(those.split()) for tag, those in CLOSES.items()}
CLOSED = frozenset(("p", *(tag for those in CLOSES.values() for tag in those)))
HOLDERS = frozenset("ul ol blockquote table tbody tr".split())
SCOPES = frozenset("article section main aside nav header footer body html div ul ol dl table blockquote form".split())
# Words in class, id and role that mark what is not the article.
MARKS = frozenset(
    "ad ads adsense alert alerts advert advertisement adverts advertising aside banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent copyright discussion disqus "
    "footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended recommendations related remark replies "
    "reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
NEVER_MARKED = frozenset(("html", "body", "article", "main"))
WORDS = re.compile(r"[a-z]+")


class Node:
    """An element. above: the nearest element that takes points, itself included; block: the nearest block; nearest: of each tag that a start tag
    may close, the innermost open one in the scope."""

    __slots__ = ("tag", "parent", "parts", "score", "dropped", "depth", "above", "block", "nearest", "inline", "chars", "linked", "chosen")

    def __init__(self, tag, parent, dropped=False):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.parts: list = []  # texts and nodes
        self.score, self.chars, self.linked, self.chosen = 0.0, 0, 0, False
        self.depth = parent.depth + 1 if parent else 0
        self.above = self if tag in CONTAINERS or tag in HOLDERS else parent.above
        self.block = self if tag in BLOCKS or parent is None else parent.block
        self.nearest = {} if tag in SCOPES else {**parent.nearest, tag: self} if tag in CLOSED else parent.nearest
        self.inline: dict[str, int] = {}  # of a block: how many inline elements of each tag are open in it


def is_marked(tag: str, attributes: str) -> bool:
    if not attributes or tag in NEVER_MARKED:
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "hidden" or name.lower() == "aria-hidden" and value == "true":
            return True
        if name.lower() in ("class", "id", "role") and not MARKS.isdisjoint(WORDS.findall(value)):
            return True
    return False


def parse(page: str) -> list[Node]:
    """The page's elements in page order, the top one first; dropped parts keep a place but no content. No token looks further up than it closes."""
    top = here = block = Node("html", None)
    nodes, open_blocks = [top], Counter()

    def close(node):
        """Closes everything up to and with node."""
        nonlocal here, block
        while True:
            gone, here = here, here.parent
            if gone is block:
                open_blocks[gone.tag] -= 1
                block = here.block
            else:
                block.inline[gone.tag] -= 1
            if gone is node:
                return

    tokens = [m for m in TOKEN.finditer(page + ">")]  # what is cut off in a tag is closed
    for i, m in enumerate(tokens):
        token = m[0]
        if token[0] != "<" or token == "<":
            if not here.dropped:
                here.parts.append(token if i + 1 < len(tokens) else token[:-1])
            continue
        tag = m[2] or m[4]
        if not tag:
            continue
        tag = tag.lower()
        if token[1] == "/":
            if open_blocks[tag] > 0 if tag in BLOCKS else block.inline.get(tag, 0) > 0:  # an inline end tag closes no block
                node = here
                while node.tag != tag:
                    node = node.parent
                close(node)
            continue
        if tag in ("html", "body"):
            if tag == "body":
                here = block = top
                open_blocks.clear()
                top.inline.clear()
            continue
        if tag in VOID:
            if not here.dropped:
                here.parts.append("\n" if tag in BLOCKS or tag == "br" else " " if tag in ("input", "img") else "")
            if tag == "hr":
                nodes.append(Node("hr", here))
                here.parts.append(nodes[-1])
            continue
        if tag in BLOCKS:
            if "p" in here.nearest:
                close(here.nearest["p"])
            if tag in CLOSES and (open_ := [here.nearest[t] for t in CLOSES[tag] if t in here.nearest]):
                close(max(open_, key=lambda node: node.depth))
        child = Node(tag, here, here.dropped or tag in DROPPED or is_marked(tag, m[3] or m[5] or ""))
        nodes.append(child)
        here.parts.append(child)
        if not token.endswith("/>") or tag in BLOCKS:
            here = child
            if tag in BLOCKS:
                block = child
                open_blocks[tag] += 1
            else:
                block.inline[tag] = block.inline.get(tag, 0) + 1
    return nodes


def clean(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


def blocks(top: Node) -> list[tuple[Node, str, int]]:
    """(container, text, characters in links) of each block in page order; the container is the block element that holds the text."""
    found: list[tuple[Node, str, int]] = []
    text: list[str] = []
    links: list[str] = []

    def flush(node):
        if said := clean(text):
            found.append((node, said, len(clean(links))))
        text.clear()
        links.clear()

    # A stack instead of recursion: pages may nest deeply.
    stack = [(top, iter(top.parts), top, False)]
    while stack:
        node, parts, block, in_link = stack[-1]
        for part in parts:
            if isinstance(part, str):
                text.append(part)
                if in_link:
                    links.append(part)
                continue
            if part.dropped:
                if part.tag in BLOCKS:
                    flush(block)
                continue
            if part.tag in BLOCKS:
                flush(block)
                stack.append((part, iter(part.parts), part, in_link))
            else:
                stack.append((part, iter(part.parts), block, in_link or part.tag == "a"))
            break
        else:
            stack.pop()
            if node is block:
                flush(block)
    return found


def main_text(page: str) -> str:
    nodes = parse(page)
    found = blocks(nodes[0])
    if not found:
        return ""
    scored = []
    for block, text, in_links in found:
        block.chars += len(text)
        block.linked += in_links
        points = 1 + text.count(",") + min(len(text) / 100, 3.0)
        place = block if block.tag in CONTAINERS else block.parent
        if len(text) >= 25 or block.tag == "p":
            share, above = 1.0, place.above if place else None
            while above is not None and share >= 0.25:
                above.score += points * share * (1 - in_links / max(1, len(text)))
                scored.append(above)
                share /= 2
                above = above.parent.above if above.parent else None
    for node in reversed(nodes[1:]):  # from the leaves up
        node.parent.chars += node.chars
        node.parent.linked += node.linked
    density = lambda node: node.linked / max(1, node.chars)
    ranked = lambda node: node.score * (1 - density(node))
    candidates = [n for n in dict.fromkeys(scored) if n.tag in CONTAINERS]
    if not candidates:
        return "\n".join(text for _, text, _ in found)
    best = max(candidates, key=ranked)  # the first of equals, in page order
    # An element that says it is the article wins over a part of itself.
    above = best.parent
    while above is not None:
        if above.tag in ("article", "main") and density(above) < 0.5:
            best = above
            if above.tag == "article":
                break
        above = above.parent
    best.chosen = True
    if best.parent is not None and best.tag not in ("article", "main"):
        for sibling in best.parent.parts:
            if isinstance(sibling, Node) and not sibling.dropped and sibling.chars:
                well = ranked(sibling) >= max(5.0, 0.2 * ranked(best)) and density(sibling) < 0.5
                prose = sibling.tag in ("p", "h1", "h2", "blockquote", "pre") and density(sibling) < 0.25
                sibling.chosen |= well or prose
    elif best.tag == "article" and best.parent is not None:
        for sibling in best.parent.parts:
            if isinstance(sibling, Node) and sibling.tag == "article" and ranked(sibling) >= 0.2 * ranked(best):
                sibling.chosen = True
    for node in nodes[1:]:  # what is in a chosen element is chosen
        node.chosen |= node.parent.chosen
    return "\n".join(text for block, text, _ in found if block.chosen)


def extract(pages: DataFrame) -> DataFrame:
    """pages with text and n_chars (code points) of each page's article."""

    def compute(part):
        texts = [main_text(page) for page in text_column(part, "html")]
        return [texts, [len(t) for t in texts]]

    return with_computed(pages, ddl("text string, n_chars bigint"), compute, text="html")
