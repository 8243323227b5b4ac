"""Main-text extraction: boosted trees over DOM-node features and hierarchical decoding.

Every block element gets features of its subtree (text and link density, counts of paragraphs, lists,
controls), its attribute tokens and its ancestors', its depth, its siblings and its tag.  Boosted
trees give the odds that its text is article text.  Decoding then labels the tree as a whole: an element
is *article* (with all that lies below), *other* (with all below) or *mixed* (its children decide), so no
descendant can contradict an ancestor; a dynamic program finds the labelling of highest total log
likelihood.  Article text runs are joined into blocks in page order.

The model is trained here, on generated layouts whose texts come from a bounded sample of the table
(``max_sample`` pages); extraction is one narrow pass.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import boosted_trees
from tidewater.llm.boosted_trees import Forest
from tidewater.llm.common import bounded_sample
from tidewater.llm.dom import INLINE, Node, elements, parse
from tidewater.llm.page_layouts import CONTENT, MARK, OTHER, training_pages

MAX_SAMPLE = 300
#: ... of at most so many characters each.
LONGEST_SAMPLE = 100_000
TRAINING_PAGES = 700
MIXED_COST = 0.6

#: Words in class, id and role that tell parts of pages apart, by kind.
TOKENS = (
    "nav navigation navbar menu topmenu submenu breadcrumb breadcrumbs toc tabs pager pagination",
    "header masthead banner topbar logo brand branding hero",
    "footer copyright legal colophon bottom contentinfo",
    "sidebar aside side rail widget widgets secondary complementary column",
    "notice cookie cookies consent gdpr alert warning popup modal overlay paywall announcement message dialog privacy",
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted partner dfp",
    "comment comments disqus reply replies respond response responses discussion reader readers review reviews",
    "related recommended recommendations popular trending share sharing social newsletter subscribe tags more follow",
    "form login signin signup search contact register input",
    "content main article post entry story body text prose page blog single",
    "container wrapper wrap layout row col inner outer grid site",
)
_KIND = {w: k for k, group in enumerate(TOKENS) for w in group.split()}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "nav", "header", "footer", "aside", "form", "table",
        "tr", "td", "blockquote", "pre", "figure", "figcaption", "button", "label", "body", "dl", "address", "select", "option")
_TAG_AT = {t: k for k, t in enumerate(TAGS)}
_CONTROLS = frozenset("input button select textarea option".split())
_ANCESTOR_TAGS = ("article", "main", "nav", "header", "footer", "aside", "form", "td")
_N = 22
FEATURES = _N + 2 * len(TOKENS) + len(TAGS) + len(_ANCESTOR_TAGS)


def _kinds(node: Node) -> list[int]:
    text = " ".join(v for k, v in node.attrs.items() if k in ("class", "id", "role", "itemprop", "aria-label"))
    return [_KIND[w] for w in (x.lower() for x in _WORD.findall(text)) if w in _KIND] if text else []


class Page:
    """A parsed page: block elements in page order with their features, and its tree for decoding."""

    def __init__(self, page: str | None):
        self.root = parse(page)
        self.all = elements(self.root)
        self.blocks = [n for n in self.all if n.tag not in INLINE]
        self._measure()

    def _measure(self) -> None:
        n = len(self.all)
        # subtree sums: text, link text, elements, paragraphs, controls, list items, headings, images, marks
        sums = [[0.0] * 9 for _ in range(n)]
        own = [0.0] * n
        depth = [0] * n
        for node in self.all:
            i, s, tag = node.index, sums[node.index], node.tag
            if node.parent is not None:
                depth[i] = depth[node.parent.index] + 1
            for x in node.items:
                if x.__class__ is str:
                    size = len(x.strip())
                    own[i] += size
                    s[0] += size
                    s[8] += x.count(".") + x.count(",")
            s[2] = 1
            s[3] = tag == "p"
            s[4] = tag in _CONTROLS
            s[5] = tag == "li"
            s[6] = tag in ("h1", "h2", "h3", "h4")
            s[7] = tag == "img"
        for node in reversed(self.all):
            i, s = node.index, sums[node.index]
            if node.tag == "a":
                s[1] = s[0]
            if node.parent is not None:
                up = sums[node.parent.index]
                for k in range(9):
                    up[k] += s[k]
                if node.tag in INLINE:
                    own[node.parent.index] += own[i]
        self.own, self.sums = own, sums
        total = max(sums[0][0], 1.0)
        kinds = [_kinds(node) for node in self.all]
        above: list[frozenset[int]] = [frozenset()] * n
        tags_above: list[frozenset[str]] = [frozenset()] * n
        rows = np.zeros((len(self.blocks), FEATURES), np.float32)
        siblings: dict[int, list[Node]] = {}
        for node in self.blocks:
            if node.parent is not None:
                siblings.setdefault(node.parent.index, []).append(node)
        place = {node.index: k for group in siblings.values() for k, node in enumerate(group)}
        for node in self.all:
            if node.parent is not None:
                j = node.parent.index
                above[node.index] = above[j] | frozenset(kinds[j]) if kinds[j] else above[j]
                tags_above[node.index] = tags_above[j] | {node.parent.tag} if node.parent.tag in _ANCESTOR_TAGS else tags_above[j]
        log = math.log1p
        for r, node in enumerate(self.blocks):
            i = node.index
            s = sums[i]
            text = max(s[0], 1.0)
            group = siblings.get(node.parent.index, [node]) if node.parent is not None else [node]
            k = place.get(i, 0)
            before = sums[group[k - 1].index] if k else None
            after = sums[group[k + 1].index] if k + 1 < len(group) else None
            up = sums[node.parent.index] if node.parent is not None else s
            row = rows[r]
            row[:_N] = (depth[i], log(s[0]), s[1] / text, log(s[0] / s[2]), s[0] / total, log(s[2]), len(group), k / len(group),
                        s[8] / text, own[i] / text, log(s[3]), s[4], log(s[5]), s[6], s[7],
                        -1 if before is None else before[1] / max(before[0], 1), -1 if after is None else after[1] / max(after[0], 1),
                        -1 if before is None else log(before[0]), -1 if after is None else log(after[0]),
                        log(up[0]), up[1] / max(up[0], 1), s[0] / max(up[0], 1))
            at = _N
            for x in kinds[i]:
                row[at + x] += 1
            at += len(TOKENS)
            for x in above[i]:
                row[at + x] = 1
            at += len(TOKENS)
            if node.tag in _TAG_AT:
                row[at + _TAG_AT[node.tag]] = 1
            at += len(TAGS)
            for x, tag in enumerate(_ANCESTOR_TAGS):
                if tag in tags_above[i]:
                    row[at + x] = 1
        self.features = rows

    def gold(self) -> np.ndarray:
        """1 article, 0 other, -1 mixed or without text, of each block of a generated page."""
        n = len(self.all)
        side = [None] * n
        counts = np.zeros((n, 2))
        for node in self.all:
            mark = node.attrs.get(MARK)
            side[node.index] = mark if mark else side[node.parent.index] if node.parent is not None else OTHER
            size = sum(len(x.strip()) for x in node.items if isinstance(x, str))
            counts[node.index, int(side[node.index] == CONTENT)] += size
        for node in reversed(self.all):
            if node.parent is not None:
                counts[node.parent.index] += counts[node.index]
        at = [b.index for b in self.blocks]
        other, article = counts[at, 0], counts[at, 1]
        return np.where((article > 0) & (other == 0), 1, np.where((other > 0) & (article == 0), 0, -1))

    def decode(self, log_odds: np.ndarray, mixed_cost: float = MIXED_COST) -> str:
        """The text of the best consistent labelling."""
        odds = np.clip(log_odds, -12, 12)
        yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        n = len(self.all)
        article, other, mixed = [0.0] * n, [0.0] * n, [0.0] * n
        best = [0.0] * n
        score = {b.index: (float(yes[r]), float(no[r])) for r, b in enumerate(self.blocks)}
        for node in reversed(self.all):              # children before parents
            i = node.index
            if i in score and self.sums[i][0]:
                y, x = score[i]
                article[i] += y
                other[i] += x
                mixed[i] += (max(y, x) if self.own[i] else 0.0) - mixed_cost
            best[i] = max(article[i], other[i], mixed[i])
            if node.parent is not None:
                j = node.parent.index
                article[j] += article[i]
                other[j] += other[i]
                mixed[j] += best[i]
        state = [""] * n
        for node in self.all:
            i = node.index
            up = state[node.parent.index] if node.parent is not None else "mixed"
            if up != "mixed":
                state[i] = up
            elif node.tag in INLINE:
                state[i] = up
            else:
                state[i] = max((article[i], "article"), (mixed[i], "mixed"), (other[i], "other"))[1]
        keep = [s == "article" for s in state]
        for node in self.all:                        # own text of a mixed element goes by its own odds
            if state[node.index] == "mixed":
                if node.tag in INLINE:
                    keep[node.index] = keep[node.parent.index]
                else:
                    y, x = score[node.index]
                    keep[node.index] = y > x
        return self._text(keep)

    def _text(self, keep: list[bool]) -> str:
        blocks, run = [], []

        def close() -> None:
            text = " ".join("".join(run).split())
            if text:
                blocks.append(text)
            run.clear()

        todo: list = [self.root]
        while todo:
            x = todo.pop()
            if x is None:
                close()
            elif x.__class__ is tuple:
                if x[1]:
                    run.append(x[0])
            elif x.tag == "br":
                run.append(" ")
            else:
                block = x.tag not in INLINE
                if block:
                    close()
                    todo.append(None)
                todo.extend((y, keep[x.index]) if y.__class__ is str else y for y in reversed(x.items))
        close()
        return "\n\n".join(blocks)


def mark_semantic(page: Page) -> bool:
    """Weak labels for a real page with one ``<article>``: it is the article, without the navigation,
    footers, asides and forms inside it.  False (and no marks) for any other page."""
    found = [n for n in page.all if n.tag == "article"]
    if len(found) != 1:
        return False
    for node in page.all:
        node.attrs.pop(MARK, None)
        if node is found[0]:
            node.attrs[MARK] = CONTENT
        elif node.tag in ("nav", "footer", "aside", "form"):
            node.attrs[MARK] = OTHER
    return True


def train(sample: list[str], pages: int = TRAINING_PAGES, seed: int = 11) -> Forest:
    """Boosted trees from ``pages`` generated layouts over the sample's texts and from those pages of
    the sample itself whose tags name the article."""
    real = [Page(h) for h in sample]
    runs = sorted({x.strip() for p in real for n in p.all for x in n.items if isinstance(x, str) and x.strip()})
    made = [Page(p) for p in training_pages(runs, pages, seed)] + [p for p in real if mark_semantic(p)]
    x = np.concatenate([p.features for p in made])
    y = np.concatenate([p.gold() for p in made])
    return boosted_trees.fit(x[y >= 0], y[y >= 0].astype(float))


def sample_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_sample: int = MAX_SAMPLE,
                 longest: int = LONGEST_SAMPLE) -> list[str]:
    """At most ``max_sample`` whole pages of at most ``longest`` characters, drawn by a hash of their ids, to train on: what
    the driver holds is bounded by the two.  Extraction takes pages of any length."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("i"), F.col(html_col).cast("string").alias("h"))
    return [r.h for r in bounded_sample(rows.where(F.length("h") <= longest), "i", max_sample).collect()]


def extract_text(pages: DataFrame, forest: Forest | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 max_sample: int = MAX_SAMPLE) -> DataFrame:
    """``page_id, url, text`` for every row, from the whole html; trains a model where none is given.

    Null and empty pages have an empty text, so have pages without article text; null ids and urls pass
    through; repeated rows give a row each; an empty table gives none; other columns are not looked at."""
    if forest is None:
        forest = train(sample_pages(pages, id_col, html_col, max_sample))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("_html"))

    def run(batches):
        for b in batches:
            texts: list[str] = []
            source = b["_html"].tolist()
            for at in range(0, len(source), 200):
                parsed = [Page(h) for h in source[at:at + 200]]
                odds = forest.log_odds(np.concatenate([p.features for p in parsed]))
                cut = np.cumsum([len(p.blocks) for p in parsed])[:-1]
                texts += [p.decode(o) for p, o in zip(parsed, np.split(odds, cut))]
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": texts})

    return rows.mapInPandas(run, "page_id bigint, url string, text string")
