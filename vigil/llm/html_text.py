"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page is cut into flat blocks of text at its block-level tags. A block is described
by its word count and link density, those of the blocks before and after it, and by
the containers around it, judged by element and by usual names in class, id and role; a decision tree (CART, trained here on the table of :func:`labelled`)
decides which blocks are article text. Scripts, styles and comments never make blocks.

Defined cases: null and empty pages give an empty text; broken tags end at the page's
end; character references are decoded after the tags are cut; a page without an
article element is judged by densities alone; repeated rows are judged one by one.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.frames import fresh, plus

# Element names of HTML and usual names of page parts.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style noscript template svg math iframe object textarea select canvas title audio video head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav aside footer form menu dialog button search".split())
INSIDE = frozenset("article main".split())
NEST = frozenset("li div section article main nav aside footer header form menu dialog search ul ol dl table figure blockquote button span details".split())
BAD_NAMES = frozenset(
    "ad ads adsbygoogle adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies "
    "copyright disqus footer gdpr login mainnav menu modal nav navbar navigation newsletter notice notices overlay pager pagination "
    "popup promo promotion recommended related replies reply respond search share sharing sidebar sidenav signup skip social sponsor "
    "sponsored subnav subscribe subscription toolbar topbar topnav widget widgets complementary contentinfo alert alertdialog".split()
)
HEAD_NAMES = frozenset("header masthead".split())
GOOD_NAMES = frozenset("article articlebody content entry main maintext post story".split())
#: First words of names that tell a state or a topic of an element, not its part of the page.
STATES = frozenset("has have no not with without is tag category".split())
HEADING = re.compile(r"h[1-6]$")

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PARTS = re.compile(r"[a-z]+")
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


@dataclass
class Block:
    text: str
    words: int
    links: int
    inside: bool
    bad: bool
    heading: bool


def _names(attributes: str, element: str) -> tuple[bool, bool, bool]:
    """Whether the attributes name a page part that is bad, a header, or good. Names are
    counted one by one: bad ones need a majority over good ones and an article element."""
    hidden = header = False
    bad, good, article = 0, 0, element in INSIDE
    for name, a, b, c in _NAMED.findall(attributes):
        value, name = (a or b or c).lower(), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
        elif name in ("class", "id", "role"):
            for one in value.split():
                parts = _PARTS.findall(one)
                if not parts or len(parts) > 1 and parts[0] in STATES:
                    continue
                header |= not HEAD_NAMES.isdisjoint(parts) or name == "role" and one == "banner"
                if not BAD_NAMES.isdisjoint(parts):
                    bad += 1
                elif not GOOD_NAMES.isdisjoint(parts) or name == "role" and one in ("main", "article"):
                    good += 1
    return hidden or bad > good + article, header, good > 0


def blocks(page: str) -> list[Block]:
    """Text blocks in page order."""
    out: list[Block] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool]] = []
    anchors = 0
    heading = False
    leaf_bad = False

    def close() -> None:
        words = html.unescape("".join(text)).split()
        if words:
            inside = any(s[1] for s in stack)
            out.append(Block(" ".join(words), len(words), min(len(words), len(html.unescape(" ".join(linked)).split())), inside, leaf_bad or any(s[2] for s in stack), heading))
        text.clear()
        linked.clear()

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start() if m else end]
        if piece:
            text.append(piece)
            if anchors:
                linked.append(piece)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name, closing, attributes = m[2].lower(), bool(m[1]), m[3]
        if name in RAW and not closing:
            if name == "head":
                body = re.compile(r"</head\s*>|<body[\s>]", re.I).search(page, at)
                at = body.start() if body else at
            elif not attributes.endswith("/"):
                stop = _CLOSE[name].search(page, at)
                at = stop.end() if stop else (end if name in ("script", "style") else at)
            text.append(" ")
            continue
        if name == "br":
            text.append("\n")
            continue
        if name == "a":
            anchors = 0 if closing else 1
        if name in BLOCK:
            close()
            if name != "a":
                anchors = 0
            heading = not closing and bool(HEADING.match(name))
            leaf_bad = not closing and bool(attributes) and name not in NEST and _names(attributes, name)[0]
        if name in NEST and name not in VOID:
            if closing:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                if depth is not None:
                    if name not in BLOCK and stack[depth][2]:
                        close()
                    del stack[depth:]
            elif not attributes.endswith("/"):
                if name == "li" and stack and stack[-1][0] == "li":
                    stack.pop()
                bad, header, good = _names(attributes, name) if attributes else (False, False, False)
                within = any(s[1] for s in stack)
                bad |= name in ASIDE or (header and not good or name == "header") and not within
                if name not in BLOCK and bad:
                    close()
                stack.append((name, name in INSIDE or good and not bad, bad))
    close()
    return out


FEATURES = ("words", "links", "words before", "links before", "words after", "links after", "inside", "outside", "bad", "heading")

#: Surroundings in which labelled blocks were met: words and link density before and after.
SURROUNDINGS = ((0, 0.0, 0, 0.0), (1, 1.0, 1, 1.0), (70, 0.0, 60, 0.0), (3, 0.0, 80, 0.1), (90, 0.1, 2, 0.0), (6, 1.0, 40, 0.0), (50, 0.0, 8, 0.9), (2, 0.0, 4, 0.0))

#: Blocks with a known container: words, link density, inside, outside, bad, heading, then
#: 1 for article text, or the numbers of the surroundings in which they are. "inside" is an
#: article container, "outside" a block beside one.
CONTAINED = (
    # menus, footers, adverts, notices, forms and comments
    (6, 1.0, 0, 1, 1, 0, 0), (12, 0.0, 0, 1, 1, 0, 0), (55, 0.0, 1, 0, 1, 0, 0), (3, 0.0, 1, 0, 1, 1, 0),
    (25, 0.0, 0, 0, 1, 0, 0), (90, 0.0, 0, 0, 1, 0, 0), (1, 1.0, 0, 0, 1, 0, 0), (1, 0.0, 0, 0, 1, 1, 0),
    # text beside an article container
    (15, 0.0, 0, 1, 0, 0, 0), (60, 0.0, 0, 1, 0, 0, 0), (3, 0.0, 0, 1, 0, 1, 0), (8, 0.9, 0, 1, 0, 0, 0),
    # article text: titles, short and long paragraphs, lists with some links
    (8, 0.0, 1, 0, 0, 1, 1), (1, 0.0, 1, 0, 0, 0, 1), (70, 0.0, 1, 0, 0, 0, 1), (400, 0.01, 1, 0, 0, 0, 1),
    (35, 0.2, 1, 0, 0, 0, 1), (6, 1.0, 1, 0, 0, 1, 1), (20, 0.4, 1, 0, 0, 0, 1), (3, 0.3, 1, 0, 0, 0, 1),
    # linked lines inside an article container: not among link scraps; whole ones between paragraphs
    (11, 0.6, 1, 0, 0, 0, (0, 2, 3, 4, 5, 6, 7)), (9, 0.9, 1, 0, 0, 0, (2,)),
    # link lists inside an article container
    (2, 1.0, 1, 0, 0, 0, 0), (4, 0.8, 1, 0, 0, 0, 0),
)

#: Blocks without one: words, link density, those before and after, heading, label.
OPEN = (
    # dense text and its short neighbours
    (80, 0.0, 12, 0.0, 60, 0.0, 0, 1), (45, 0.1, 5, 1.0, 40, 0.0, 0, 1), (22, 0.0, 50, 0.0, 30, 0.0, 0, 1),
    (7, 0.0, 60, 0.0, 55, 0.0, 0, 1), (5, 0.0, 3, 1.0, 50, 0.0, 1, 1), (2, 0.0, 40, 0.0, 45, 0.0, 0, 1),
    (300, 0.0, 0, 0.0, 0, 0.0, 0, 1), (18, 0.05, 30, 0.1, 0, 0.0, 0, 1), (25, 0.2, 2, 0.0, 3, 0.0, 0, 1),
    (60, 0.3, 1, 1.0, 1, 1.0, 0, 1), (4, 0.0, 90, 0.0, 70, 0.0, 1, 1), (3, 0.0, 35, 0.0, 20, 0.0, 0, 1),
    (35, 0.0, 2, 1.0, 4, 1.0, 0, 1), (16, 0.0, 0, 0.0, 0, 0.0, 0, 1), (4, 0.0, 0, 0.0, 0, 0.0, 0, 1),
    # link lists, crumbs, short scraps
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0), (5, 0.8, 40, 0.0, 4, 1.0, 0, 0), (12, 0.6, 4, 1.0, 15, 0.7, 0, 0),
    (3, 0.0, 2, 1.0, 2, 1.0, 0, 0), (4, 0.0, 3, 0.0, 2, 0.0, 0, 0), (6, 0.0, 2, 1.0, 3, 0.0, 0, 0),
    (30, 0.9, 60, 0.0, 20, 0.8, 0, 0), (2, 0.5, 0, 0.0, 3, 1.0, 0, 0), (2, 1.0, 0, 0.0, 60, 0.0, 0, 0),
    (3, 0.0, 60, 0.0, 0, 0.0, 0, 0), (4, 0.0, 45, 0.0, 2, 1.0, 0, 0), (1, 1.0, 80, 0.0, 90, 0.0, 0, 0),
    (3, 0.0, 1, 1.0, 40, 0.0, 0, 0), (7, 0.7, 0, 0.0, 0, 0.0, 0, 0),
)


def labelled() -> np.ndarray:
    """The labelled table: rows of ``FEATURES`` and the label."""
    rows = [
        (words, links, *around, inside, outside, bad, heading, int(i in label) if isinstance(label, tuple) else label)
        for words, links, inside, outside, bad, heading, label in CONTAINED
        for i, around in enumerate(SURROUNDINGS)
    ]
    return np.array(rows + [(*r[:6], 0, 0, 0, r[6], r[7]) for r in OPEN], dtype=np.float64)


class Tree:
    """CART with the Gini index; leaves hold the share of article blocks."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8):
        self.share = float(y.mean())
        self.feature = -1
        best = (1e-9, -1, 0.0)
        if depth and 0 < self.share < 1:
            gini = lambda v: 2 * v.mean() * (1 - v.mean())
            for f in range(x.shape[1]):
                values = np.unique(x[:, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    low = x[:, f] < cut
                    gain = gini(y) - low.mean() * gini(y[low]) - (~low).mean() * gini(y[~low])
                    if gain > best[0] + 1e-12:
                        best = (gain, f, float(cut))
        if best[1] >= 0:
            _, self.feature, self.cut = best
            low = x[:, self.feature] < self.cut
            self.low, self.high = Tree(x[low], y[low], depth - 1), Tree(x[~low], y[~low], depth - 1)

    def says(self, row: tuple) -> bool:
        node = self
        while node.feature >= 0:
            node = node.low if row[node.feature] < node.cut else node.high
        return node.share >= 0.5


def train() -> Tree:
    data = labelled()
    return Tree(data[:, :-1], data[:, -1])


def rows(found: list[Block]) -> list[tuple]:
    """Feature rows of a page's blocks."""
    contained = any(b.inside and not b.bad for b in found)
    dense = [(b.words, b.links / b.words) for b in found]
    around = [(0, 0.0), *dense, (0, 0.0)]
    return [(*around[i + 1], *around[i], *around[i + 2], int(b.inside), int(contained and not b.inside), int(b.bad), int(b.heading)) for i, b in enumerate(found)]


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page) if page else []
    return "\n\n".join(b.text for b, row in zip(found, rows(found)) if tree.says(row))


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with a column of their main text."""
    tree = pages.sparkSession.sparkContext.broadcast(train())
    name = fresh("main_text", pages.columns)

    def run(batches):
        for batch in batches:
            texts = [main_text(p, tree.value) for p in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return pages.mapInArrow(run, plus(pages.schema, **{name: "string"}))


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page row."""
    found = extract(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
