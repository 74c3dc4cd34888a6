"""Main text of web pages by composite text density.

Every DOM node gets its characters per tag, adjusted for the links among them; a node's density sum adds up its children's densities.
The smallest density on the path from the node of the largest sum up to the body is the threshold: under every node that reaches it,
the node of the largest sum is content, and the subtree that holds all content is the article, whatever its tag; headings directly
before it come with it. Blocks that the page itself marks as something else (menus, forms, adverts, comments ...) are no part of the
tree, unless they wrap most of its characters.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript textarea title iframe template xmp noembed noframes".split())
_NOT_TEXT = _RAW | frozenset("head nav aside footer form button select option optgroup datalist fieldset dialog menu menuitem svg math canvas object audio video map label input".split())
_BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr li main nav ol p pre section summary table caption thead tbody tfoot tr td th ul br".split()
)
#: Start tags that end an open element of the second set, unless one of the third stands between.
_ENDS_P = _BLOCKS - frozenset("html body br caption thead tbody tfoot tr td th".split())
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
}
#: A container is marked as no part of the article if a whole name in its class, id or role has one of these words and no words
#: besides these and neutral ones.
_MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner comment comments disqus replies respond sidebar "
    "widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices alert newsletter subscribe "
    "signup popup modal overlay share sharing social related recommended search complementary contentinfo dialog".split()
)
#: Words that say where or how something stands, not what it is.
_NEUTRAL = frozenset(
    "list lists section sections container wrapper wrap box boxes block blocks inner outer left right top bottom main primary secondary post posts "
    "item items area areas user users reader readers site page global button buttons bar slot unit panel row col column link links icons thread "
    "first last mobile desktop sticky fixed".split()
)
_ONLY_OUTSIDE = frozenset({"header", "masthead"})
_COMMENT = frozenset({"comment", "comments", "disqus", "replies", "respond"})
_CONTAINERS = frozenset("div section ul ol dl table tbody tr td center".split())
#: What can be a whole article: no paragraph, list, table or inline element is, however dense its parts are.
_WHOLE = frozenset("html body main article section div td center".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 article main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())
#: Containers with so many links are link lists if links hold so much of their text.
_LISTS, _LINKS, _LINKED = frozenset("ul ol dl div section table".split()), 3, 0.66


class _Node:
    __slots__ = ("chars", "density", "items", "linked", "links", "marked", "name", "parent", "sum", "tags")

    def __init__(self, name: str, parent: _Node | None, marked: bool = False):
        self.name, self.parent, self.items, self.marked = name, parent, [], marked
        self.chars = self.tags = self.linked = self.links = 0
        self.density = self.sum = 0.0


def _dropped(name: str, attributes: str, inside: bool) -> bool:
    """Whether the element holds no article text by its tag or is not shown."""
    if name in _NOT_TEXT or name == "header" and not inside:
        return True
    if not attributes or name in ("html", "body"):
        return False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def _is_marked(name: str, attributes: str, inside: bool) -> bool:
    """Whether a whole name in class, id or role marks the container as something other than article text."""
    if not attributes or name not in _CONTAINERS and name not in ("main", "article"):
        return False
    words = _COMMENT if name in ("main", "article") else _MARKED if inside else _MARKED | _ONLY_OUTSIDE
    for key, *values in _ATTRIBUTE.findall(attributes):
        if key.lower() in ("class", "id", "role"):
            for whole in next((v for v in values if v), "").split():
                pieces = {x.lower() for x in _TOKEN.findall(whole)}
                if pieces & words and pieces <= words | _NEUTRAL:
                    return True
    return False


def _tree(page: str) -> list[_Node]:
    """Nodes in document order, the root first. Texts are decoded; dropped and marked elements are left out with all they hold."""
    root = _Node("html", None)
    nodes, stack = [root], [root]
    skipping: list[str] = []
    at, size = 0, len(page)
    while at < size:
        begin = page.find("<", at)
        begin = size if begin < 0 else begin
        if begin > at and not skipping:
            stack[-1].items.append(entities.unescape(page[at:begin]))
        if begin == size:
            break
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = size if end < 0 else end + 3
            continue
        if page[begin + 1 : begin + 2] in ("!", "?"):
            end = page.find(">", begin)
            at = size if end < 0 else end + 1
            continue
        tag = _TAG.match(page, begin) or _LOOSE_TAG.match(page, begin)
        if not tag:
            if not skipping:
                stack[-1].items.append("<")
            at = begin + 1
            continue
        at = tag.end()
        closing, name, attributes = tag[1], tag[2].lower(), tag[3]
        if name in _RAW and not closing:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if skipping:
            if name not in _VOID and not attributes.endswith("/"):
                if not closing:
                    skipping.append(name)
                elif name in skipping:
                    while skipping.pop() != name:
                        pass
            if closing and name in ("body", "html"):
                skipping.clear()
            continue
        if closing:
            if name == "br":
                stack[-1].items.append(None)
            elif name not in ("html", "body") and any(n.name == name for n in reversed(stack[1:])):
                while stack.pop().name != name:
                    pass
            continue
        if name == "html":
            continue
        if name in _ENDS_P:
            _close(stack, {"p"}, {"table", "td", "th", "li", "blockquote", "div", "section", "article"})
        if name in _CLOSES:
            _close(stack, *_CLOSES[name])
        inside = any(n.name in ("article", "main") for n in stack)
        if _dropped(name, attributes, inside):
            if name not in _VOID and not attributes.endswith("/"):
                skipping.append(name)
            continue
        node = _Node(name, stack[-1], _is_marked(name, attributes, inside))
        nodes.append(node)
        stack[-1].items.append(node)
        if name not in _VOID and not attributes.endswith("/"):
            stack.append(node)
    return _unmarked(nodes) if any(n.marked for n in nodes) else nodes


def _characters(node: _Node) -> int:
    return sum(len("".join(x.split())) for x in node.items if isinstance(x, str))


def _unmarked(nodes: list[_Node]) -> list[_Node]:
    """The nodes without marked ones and all they hold; a marked node around paragraphs or headings with over half of the page's characters stays."""
    held = {id(n): _characters(n) for n in nodes}
    wraps: set[int] = set()
    for node in reversed(nodes[1:]):
        held[id(node.parent)] += held[id(node)]
        if node.name in _PROSE or id(node) in wraps:
            wraps.add(id(node.parent))
    gone: set[int] = set()
    for node in nodes[1:]:
        if id(node.parent) in gone:
            gone.add(id(node))
        elif node.marked and (2 * held[id(node)] <= held[id(nodes[0])] or id(node) not in wraps):
            gone.add(id(node))
            node.parent.items = [None if x is node else x for x in node.parent.items]
    return [n for n in nodes if id(n) not in gone]


def _close(stack: list[_Node], names: set[str], limits: set[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name in names:
            del stack[i:]
            return
        if stack[i].name in limits:
            return


def _measure(nodes: list[_Node]) -> None:
    """Characters, tags, linked characters and links of every subtree, then densities and their sums."""
    for node in reversed(nodes):
        node.chars += _characters(node)
        if node.name == "a":
            node.linked, node.links = node.chars, node.links + 1
        if node.parent is not None:
            up = node.parent
            up.chars, up.tags, up.linked, up.links = up.chars + node.chars, up.tags + node.tags + 1, up.linked + node.linked, up.links + node.links
    body = next((n for n in nodes if n.name == "body"), nodes[0])
    ratio = body.linked / max(1, body.chars)
    for node in nodes:
        chars, tags, linked, links = node.chars, max(1, node.tags), max(1, node.linked), max(1, node.links)
        if not node.chars:
            continue
        base = math.log(chars / max(1, chars - node.linked) * linked + ratio * chars + math.e)
        node.density = chars / tags * math.log(max(chars / linked * tags / links, 1.0)) / math.log(base)
        if node.parent is not None:
            node.parent.sum += node.density


def _article(nodes: list[_Node]) -> tuple[list[_Node], set[int]]:
    """The subtree that holds all content nodes, after the headings that stand directly before it; and what is no part of it.

    That is nothing in a content node. A parent that only joins several of them also holds menus: its link lists outside all content.
    """
    body = next((n for n in nodes if n.name == "body"), nodes[0])
    for node in nodes:
        if node.name not in _WHOLE and "-" not in node.name:
            node.sum = 0.0
    best = max(nodes, key=lambda n: n.sum)
    path = [best]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    place = {id(n): i for i, n in enumerate(nodes)}
    last, largest = list(range(len(nodes))), list(range(len(nodes)))
    for i in range(len(nodes) - 1, 0, -1):
        up = place[id(nodes[i].parent)]
        last[up] = max(last[up], last[i])
        if nodes[largest[i]].sum >= nodes[largest[up]].sum and nodes[largest[i]].sum > nodes[up].sum:
            largest[up] = largest[i]
    content = sorted({largest[i] for i, n in enumerate(nodes) if n.chars and n.density >= threshold} or {place[id(best)]})
    first, end = content[0], max(last[i] for i in content)
    while last[first] < end:
        first = place[id(nodes[first].parent)]
    outside: set[int] = set()
    i = first
    while i <= last[first]:
        node, at = nodes[i], bisect_left(content, i)
        if at < len(content) and content[at] == i:
            i = last[i] + 1
        elif node.name in _LISTS and node.links >= _LINKS and node.linked > _LINKED * node.chars and (at == len(content) or content[at] > last[i]):
            outside.add(id(node))
            i = last[i] + 1
        else:
            i += 1
    return [*_headings(nodes[first], body), nodes[first]], outside


def _headings(chosen: _Node, body: _Node) -> list[_Node]:
    """Headings between the subtree and any text before it."""
    found: list[_Node] = []
    node = chosen
    while node is not body and node.parent is not None:
        items = node.parent.items
        for item in reversed(items[: next(i for i, x in enumerate(items) if x is node)]):
            if isinstance(item, _Node) and item.name in _HEADINGS:
                found.insert(0, item)
            elif item.chars if isinstance(item, _Node) else item and item.strip():
                return found
        node = node.parent
    return found


def main_text(page: str | None) -> str:
    """Blocks of the article in page order, one per line; empty for null, empty and textless pages."""
    if not page:
        return ""
    nodes = _tree(page)
    _measure(nodes)
    blocks: list[str] = []
    words: list[str] = []

    def flush() -> None:
        if block := " ".join("".join(words).split()):
            blocks.append(block)
        words.clear()

    tops, outside = _article(nodes)
    todo: list = tops[::-1]
    while todo:
        item = todo.pop()
        if item is None or item == "":
            flush()
        elif isinstance(item, str):
            words.append(item)
        elif id(item) not in outside:
            if item.name in _BLOCKS:
                flush()
                todo.append(None)
            todo += reversed([x for x in item.items if x != ""])
    flush()
    return "\n".join(blocks)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds ``text`` and ``n_chars`` (code points) to every row.

    Null, empty and textless pages give an empty text; any malformed mark-up gives some tree, never an error. Repeated rows stay, an
    empty table stays empty; other columns pass through, but existing ``text`` and ``n_chars`` are replaced.
    """
    text = F.udf(main_text, "string", useArrow=True)
    return pages.withColumn("text", text(F.col(html_col))).withColumn("n_chars", F.length("text").cast("long"))
