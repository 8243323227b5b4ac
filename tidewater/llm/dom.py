"""A small DOM for raw pages: elements with their text runs, as features and extraction need them.

Tags are found with one pattern; void and raw-text elements, implied end tags and unclosed formatting
are handled as browsers roughly do, and nothing in a page can make the parse fail.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
#: Raw elements that may be written closed in themselves; of the others browsers ignore the slash.
EMPTY_RAW = frozenset("noscript template iframe noframes".split())
#: Formulas and drawings inside a line of text.
FORMULA = frozenset("math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mtable mtr mtd mspace "
                    "mfenced mpadded mphantom menclose semantics annotation svg g path text tspan rect circle ellipse line polyline polygon use "
                    "defs symbol".split())
INLINE = FORMULA | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
                             "span strike strong sub sup time tt u var wbr img br nobr".split())
#: An open element that a start tag closes, within the nearest of the stops.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
           "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
           "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
           "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
           "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())    # any one's end tag ends another
_SCOPE = frozenset("td th table caption button article section div body main aside nav header footer li".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)"
                  r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
                  r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)", re.S)   # stray quotes
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")


class Node:
    """An element; ``items`` are its children in page order, text runs as plain strings."""

    __slots__ = ("tag", "attrs", "parent", "items", "index")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.items, self.index = tag, attrs, parent, [], -1


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)} if text.strip() else {}


@lru_cache(maxsize=64)
def _end_tag(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?![^\s/>])[^>]*>", re.I)


def parse(page: str | None) -> Node:
    """The tree under an artificial ``#root``; null and empty pages have no children."""
    root = Node("#root", {}, None)
    here = root
    page = page or ""
    at = 0
    while True:
        m = _TAG.search(page, at)
        text = page[at:m.start() if m else len(page)]
        if text:
            here.items.append(html.unescape(text) if "&" in text else text)
        if not m:
            return root
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        tag, attrs = name.lower(), m["attrs"] or m["attrs2"] or ""
        if m["end"] or m["end2"]:
            node = here
            while node is not root and node.tag != tag and not (tag in _HEADINGS and node.tag in _HEADINGS):
                if tag in INLINE and node.tag not in INLINE:
                    node = root                      # a formatting end tag does not close blocks
                else:
                    node = node.parent
            if node is not root:
                here = node.parent
            elif tag == "br":
                here.items.append(Node("br", {}, here))
            continue
        if tag not in INLINE:                        # a block ends an open paragraph
            node = here
            while node is not root and node.tag not in _SCOPE:
                if node.tag == "p":
                    here = node.parent
                    break
                node = node.parent
        if tag in _CLOSES:
            closes, stops = _CLOSES[tag]
            node = here
            while node is not root and node.tag not in stops:
                if node.tag in closes:
                    here = node.parent
                node = node.parent
        child = Node(tag, _attributes(attrs), here)
        here.items.append(child)
        if tag in VOID or attrs.rstrip().endswith("/") and (tag not in RAW or tag in EMPTY_RAW) and tag not in ("p", "div"):
            continue
        if tag in RAW:
            end = _end_tag(tag).search(page, at)
            if end:
                at = end.end()
            else:                                    # never closed: it ends with what it lies in
                end = _end_tag(here.tag).search(page, at)
                at = end.start() if end else len(page)
            continue
        here = child


def elements(root: Node) -> list[Node]:
    """All elements in page order; sets each one's ``index``."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        node.index = len(out)
        out.append(node)
        todo.extend(x for x in reversed(node.items) if isinstance(x, Node))
    return out


def is_block(node: Node) -> bool:
    return node.tag not in INLINE
