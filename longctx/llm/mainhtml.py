"""Operator 5: main text of HTML pages from flat text blocks and a decision tree.

One pass over the tags cuts a page into flat text blocks (runs of text between block-level tags).
A block is described by its word count and link density, the same of its two neighbours, and the
zone its nearest telling container puts it in (``ZONES`` and class or id words).  A decision tree,
grown once per task from the small labelled table ``LABELLED`` by Gini impurity, says which blocks
are main text.

Nulls and edge cases: null, empty and tagless pages are handled (text without tags is one block);
unclosed and misnested tags close with their container; a page of any length is read whole;
character references without a semicolon are decoded as browsers do; other columns are ignored.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longctx.llm.words import pieces

# Tag names of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby "
                   "s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title textarea svg math iframe select button object noframes".split())
#: Zone by tag: -1 page furniture, 1 article; others inherit.
ZONES = {"nav": -1, "footer": -1, "aside": -1, "form": -1, "dialog": -1, "menu": -1, "fieldset": -1,
         "article": 1, "main": 1}
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies copyright disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation "
    "newsletter notice notices pagination pager popup promo promotion promoted recommended related replies reply "
    "respond search share sharing sidebar signup skip social sponsor sponsored subscribe tagcloud tags teaser "
    "toolbar topbar trending widget widgets".split())
ARTICLE = frozenset("article articlebody body-text content entry entry-content main maincontent post post-body "
                    "post-content postbody story storybody text".split())

# Labelled blocks: words, link density, words before, density before, words after, density after, zone, main text?
# Words of a missing neighbour are 0.
LABELLED = [
    (1, 0.0, 0, 0.0, 40, 0.0, 1, 1), (1, 0.0, 50, 0.0, 45, 0.0, 1, 1), (2, 0.0, 60, 0.0, 0, 0.0, 1, 1),
    (8, 0.0, 0, 0.0, 60, 0.0, 1, 1), (8, 0.0, 6, 1.0, 60, 0.0, 1, 1), (25, 0.0, 8, 0.0, 70, 0.0, 1, 1),
    (120, 0.0, 90, 0.0, 80, 0.0, 1, 1), (60, 0.1, 40, 0.0, 30, 0.0, 1, 1), (40, 0.3, 40, 0.0, 30, 0.1, 1, 1),
    (12, 0.5, 50, 0.0, 45, 0.0, 1, 1), (3, 0.0, 2, 0.0, 2, 0.0, 1, 1), (5, 0.0, 3, 1.0, 3, 1.0, 1, 1),
    (30, 0.6, 20, 0.1, 40, 0.0, 1, 1), (4, 0.0, 0, 0.0, 0, 0.0, 1, 1), (300, 0.0, 0, 0.0, 0, 0.0, 1, 1),
    (10, 0.0, 21, 0.05, 1, 0.0, 1, 1), (10, 0.0, 20, 0.0, 2, 0.0, 1, 1), (6, 0.0, 5, 0.0, 3, 0.0, 1, 1),
    (4, 0.0, 6, 0.0, 0, 0.0, 1, 1), (3, 0.0, 15, 0.0, 1, 0.0, 1, 1), (1, 0.0, 10, 0.0, 14, 0.0, 1, 1),
    (15, 0.0, 3, 0.0, 2, 1.0, 1, 1), (20, 0.0, 10, 0.0, 3, 1.0, 1, 1), (8, 0.0, 2, 1.0, 2, 1.0, 1, 1),
    (2, 0.0, 12, 0.0, 4, 0.9, 1, 1), (1, 0.0, 1, 0.0, 1, 0.0, 1, 1), (2, 0.0, 4, 0.0, 5, 0.0, 1, 1),
    (50, 0.2, 1, 0.0, 1, 0.0, 1, 1), (7, 0.3, 8, 0.0, 2, 0.0, 1, 1), (1, 0.0, 30, 0.0, 3, 0.0, 1, 1),
    (2, 1.0, 40, 0.0, 2, 1.0, 1, 0), (3, 1.0, 2, 1.0, 2, 1.0, 1, 0), (6, 1.0, 3, 1.0, 0, 0.0, 1, 0),
    (4, 0.95, 30, 0.0, 5, 1.0, 1, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, -1, 0), (4, 0.0, 2, 1.0, 40, 0.0, -1, 0), (40, 0.0, 0, 0.0, 8, 0.0, -1, 0),
    (120, 0.0, 100, 0.0, 80, 0.0, -1, 0), (12, 0.0, 60, 0.0, 0, 0.0, -1, 0), (30, 0.2, 80, 0.0, 20, 0.0, -1, 0),
    (8, 0.0, 1, 1.0, 9, 0.0, -1, 0), (2, 0.0, 1, 0.0, 1, 0.0, -1, 0), (200, 0.0, 3, 1.0, 60, 0.0, -1, 0),
    (60, 0.0, 50, 0.0, 50, 0.0, 0, 1), (25, 0.05, 30, 0.0, 45, 0.0, 0, 1), (18, 0.0, 60, 0.0, 70, 0.1, 0, 1),
    (100, 0.2, 2, 1.0, 30, 0.0, 0, 1), (40, 0.0, 0, 0.0, 0, 0.0, 0, 1), (14, 0.0, 0, 0.0, 55, 0.0, 0, 1),
    (6, 0.0, 40, 0.0, 60, 0.0, 0, 1), (2, 0.0, 45, 0.0, 50, 0.0, 0, 1), (1, 0.0, 35, 0.0, 40, 0.1, 0, 1),
    (7, 0.0, 2, 1.0, 60, 0.0, 0, 1), (12, 0.0, 40, 0.0, 3, 0.5, 0, 1), (15, 0.0, 14, 0.0, 16, 0.0, 0, 1),
    (25, 0.0, 3, 1.0, 5, 0.0, 0, 1), (35, 0.3, 45, 0.0, 50, 0.0, 0, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0), (3, 1.0, 2, 1.0, 50, 0.0, 0, 0), (5, 0.8, 60, 0.0, 4, 1.0, 0, 0),
    (2, 0.0, 2, 1.0, 2, 1.0, 0, 0), (4, 0.0, 3, 1.0, 4, 1.0, 0, 0), (30, 0.9, 5, 1.0, 8, 1.0, 0, 0),
    (5, 0.0, 4, 0.0, 3, 0.0, 0, 0), (3, 0.0, 0, 0.0, 2, 1.0, 0, 0), (6, 0.0, 5, 1.0, 0, 0.0, 0, 0),
    (15, 0.7, 40, 0.0, 30, 0.0, 0, 0), (60, 0.8, 10, 0.9, 12, 0.9, 0, 0), (2, 0.5, 30, 0.0, 3, 0.8, 0, 0),
    (4, 0.0, 6, 0.0, 0, 0.0, 0, 0), (20, 0.6, 3, 1.0, 3, 1.0, 0, 0),
]

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
                  r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_END_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header "
                   "hr main menu nav ol p pre section table ul".split())


class Tree:
    """Binary decision tree grown to purity by Gini impurity; ties take the first feature and cut."""

    def __init__(self, rows: list[tuple], depth: int = 6):
        table = np.array(rows, float)
        self.root = self._grow(table[:, :-1], table[:, -1], depth)

    def _grow(self, x, y, depth):
        if depth == 0 or y.min() == y.max():
            return bool(y.mean() >= 0.5)
        best = (np.inf, 0, 0.0)
        for k in range(x.shape[1]):
            v = np.unique(x[:, k])
            for cut in (v[:-1] + v[1:]) / 2:
                left = x[:, k] <= cut
                gini = sum(m.sum() * y[m].mean() * (1 - y[m].mean()) for m in (left, ~left))
                if gini < best[0] - 1e-12:
                    best = (gini, k, float(cut))
        if best[0] == np.inf:
            return bool(y.mean() >= 0.5)
        left = x[:, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1))

    def __call__(self, features) -> bool:
        node = self.root
        while node is not True and node is not False:
            node = node[2] if features[node[0]] <= node[1] else node[3]
        return node


def _zone(tag: str, attrs: str, above: int) -> int:
    """Zone of a container: its tag or the first telling word of class, id or role, else the one above."""
    if attrs:
        if _HIDDEN.search(attrs):
            return -1
        for m in _NAMED.finditer(attrs):
            names = (m[1] or m[2] or m[3] or "").lower().split()
            parts = {p for n in names for p in (n, *re.split(r"[-_]+", n))}
            if any(n in ARTICLE for n in names):
                return 1
            if parts & FURNITURE:
                return -1
            if parts & ARTICLE and above >= 0:
                return 1
    if tag == "header":
        return above if above else -1
    return ZONES.get(tag, above)


def blocks(page: str) -> list[tuple[str, int, int, int]]:
    """(text, words, linked words, zone) of every flat text block, in page order."""
    out: list[tuple[str, int, int, int]] = []
    stack: list[tuple[str, int]] = []  # open containers with their zone
    text: list[str] = []
    linked: list[str] = []
    in_link, zone, at, end = False, 0, 0, len(page)

    def close():
        if text:
            words = html.unescape("".join(text)).split()
            if words:
                out.append((" ".join(words), len(words), len(html.unescape(" ".join(linked)).split()), zone))
            text.clear()
            linked.clear()

    while at < end:
        m = _TAG.search(page, at)
        upto = m.start() if m else end
        if upto > at:
            text.append(page[at:upto])
            if in_link:
                linked.append(page[at:upto])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, opening = m[2].lower(), not m[1]
        if tag in RAW:
            if opening and not m[3].endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else end
            if tag not in ("button", "select", "svg", "math"):
                close()
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = opening
            elif tag == "br":
                text.append(" ")
            if tag != "a" and tag != "br" or not opening:
                continue
            continue
        close()
        in_link = False
        if opening:
            if tag in _END_P and stack and stack[-1][0] == "p":
                stack.pop()
            if tag in ("body", "html", "head"):
                continue
            if tag not in VOID and not m[3].endswith("/"):
                if tag in ("li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == tag:
                    stack.pop()
                zone = _zone(tag, m[3], stack[-1][1] if stack else 0)
                stack.append((tag, zone))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        zone = stack[-1][1] if stack else 0
    close()
    return out


def main_text(page: str | None, tree: Tree) -> str:
    """Main blocks joined by two line feeds."""
    bs = blocks(page or "")
    dense = [(n, min(k, n) / n) for _, n, k, _ in bs]
    around = [(0, 0.0), *dense, (0, 0.0)]
    return "\n\n".join(b[0] for i, b in enumerate(bs)
                       if tree((*around[i + 1], *around[i], *around[i + 2], b[3])))


def _extract(batches):
    tree = Tree(LABELLED)
    for batch in pieces(batches):
        out = [main_text(p, tree) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string()), pa.array(
            [len(x) for x in out], pa.int64())], names=["row", "text", "n_chars"])


def extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``pages`` in struct ``row``, with the main ``text`` of ``html`` and its ``n_chars``."""
    rows = pages.select(F.struct(*keep).alias("row"), F.col("html").cast("string").alias("html"))
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(_extract, schema)
