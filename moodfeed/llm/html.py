"""Main text of web pages from flat text blocks.

A page is cut into blocks at its block-level tags. A block is described by its words and link density,
by those of the blocks before and after it, and by the elements it stands in, and a decision tree, which
is trained on the small labelled table below, decides whether it is content.

Character references are decoded, white space inside a block becomes one space, and content blocks are
joined by an empty line. Null and empty pages, and pages without content, give an empty text. Broken
markup does not stop the parse: an unclosed comment, script or style ends with the page, a closing tag
without an opening one is skipped.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from moodfeed.llm.arrow import annotate

# --- fixed values -----------------------------------------------------------

#: Elements that do not end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements without content, which are never closed.
EMPTY = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template svg math object iframe canvas title head".split())
#: Elements whose content is left as it is, up to the closing tag.
RAW = frozenset("script style noscript template iframe textarea title svg math".split())
#: Elements that hold boilerplate.
ASIDE = frozenset("nav footer aside form button select option textarea dialog menu fieldset".split())
#: Elements that hold the article.
MAIN = frozenset(["article", "main"])
#: Words of a class, id or role that mark boilerplate.
ASIDE_NAMES = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments "
    "contentinfo cookie cookies consent disqus dialog discussion disclaimer footer gdpr header login "
    "masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted "
    "related replies respond search share sharing sidebar signup social sponsor sponsored subscribe "
    "subscription tags toolbar widget alert reply complementary".split()
)
#: Words that say where or what an element is, and nothing of what it holds, besides one of those above.
PLACE_NAMES = frozenset(
    "area bar block body bottom box col column container form group item items left list main outer panel "
    "right section site slot thread top unit wrap wrapper".split()
)
#: Words of a class, id or role that mark the article.
MAIN_NAMES = frozenset("article main story post entry content body".split())

FEATURES = (
    "words", "links", "words before", "links before", "words after", "links after",
    "aside", "article", "article share",
)
#: Labelled blocks: the features in the order above, then 1 for content. Link densities are in percent;
#: ``aside``: stands in a boilerplate element; ``article``: in an article element; the last: the share of
#: the page's words in such elements, in percent. An article element may hold a teaser only.
LABELLED = """
6 100 0 0 12 0 1 0 90 0
1 100 0 0 1 100 1 0 90 0
1 100 1 100 1 100 1 0 90 0
1 100 1 100 11 0 1 0 90 0
11 0 1 100 9 0 1 0 90 0
40 0 1 100 9 0 1 0 90 0
9 0 11 0 12 0 0 1 90 1
12 0 9 0 60 0 0 1 90 1
60 0 12 0 85 0 0 1 90 1
1 0 60 0 1 0 0 1 90 1
1 0 1 0 70 0 0 1 90 1
120 5 80 0 45 10 0 1 90 1
4 0 150 0 90 0 0 1 90 1
30 60 40 0 50 0 0 1 90 1
3 100 90 0 70 0 0 1 90 1
80 0 90 0 8 0 0 1 90 1
8 0 80 0 0 0 1 0 90 0
20 10 80 0 0 0 1 0 90 0
6 0 8 0 13 0 0 1 90 1
5 0 2 100 3 0 0 1 90 1
10 0 1 100 2 0 0 1 90 1
3 0 6 100 40 0 0 1 90 1
14 0 12 0 4 100 0 1 90 1
2 0 30 0 8 25 0 1 90 1
1 0 1 0 1 0 0 1 90 1
22 0 5 0 3 100 0 1 90 1
45 0 4 0 6 90 0 1 90 1
16 0 0 0 0 0 0 1 90 1
33 9 20 0 9 60 0 1 90 1
5 100 35 0 28 0 0 1 90 1
2 100 9 0 65 0 0 1 90 1
7 0 7 0 7 0 0 1 90 1
24 0 2 0 2 0 0 1 90 1
40 0 1 100 1 100 0 1 90 1
18 30 18 30 18 30 0 1 90 1
250 0 4 0 3 0 0 1 90 1
11 0 200 0 6 17 0 1 90 1
8 0 3 100 220 0 0 1 90 1
62 0 80 0 2 100 0 0 90 1
30 0 12 0 45 0 0 0 90 0
12 0 60 0 3 100 0 0 90 0
90 0 50 5 10 0 0 0 90 1
5 0 2 100 8 0 0 0 90 0
55 0 30 0 12 0 1 1 90 0
6 0 90 0 50 0 1 1 90 0
2 100 80 0 2 100 1 1 90 0
35 0 6 100 25 0 1 1 90 0
14 0 4 100 9 0 0 0 90 0
3 0 0 0 2 100 0 0 90 0
45 0 80 0 6 100 0 0 90 1
70 20 8 0 60 0 0 0 90 0
2 100 2 100 3 100 0 0 0 0
3 100 0 0 2 100 0 0 0 0
5 80 2 100 60 0 0 0 0 0
60 0 5 80 70 5 0 0 0 1
70 5 60 0 55 0 0 0 0 1
9 0 4 100 60 0 0 0 0 1
8 0 60 0 75 0 0 0 0 1
25 0 60 0 40 0 0 0 0 1
20 4 30 0 3 100 0 0 0 1
18 0 45 0 50 10 0 0 0 1
90 3 2 100 2 100 0 0 0 1
7 0 2 100 3 100 0 0 0 0
4 0 3 100 2 100 0 0 0 0
6 0 40 90 2 100 0 0 0 0
12 90 60 0 10 90 0 0 0 0
30 85 20 90 15 95 0 0 0 0
80 0 70 0 60 0 1 0 0 0
15 0 20 0 70 0 1 0 0 0
50 10 70 0 40 10 1 0 0 0
80 0 60 0 70 0 0 0 90 1
60 5 45 0 0 0 0 0 90 1
45 0 3 100 2 100 0 0 60 1
120 3 8 0 90 0 0 0 70 1
18 0 3 100 2 100 0 0 90 0
25 0 4 100 12 0 0 0 80 0
22 40 60 0 2 100 0 0 90 0
60 70 50 0 40 0 0 0 90 0
80 60 70 0 60 0 0 0 20 0
80 0 60 0 70 0 0 0 15 1
60 0 3 100 85 0 0 0 8 1
30 5 70 0 45 0 0 0 20 1
18 0 45 0 60 0 0 0 10 1
25 0 60 0 2 100 0 0 5 1
9 0 4 100 70 0 0 0 10 1
8 0 60 0 75 0 0 0 25 1
3 100 12 0 2 100 0 0 12 0
4 0 3 100 2 100 0 0 20 0
6 100 40 0 3 100 0 0 15 0
5 0 2 100 3 100 0 0 10 0
2 100 14 0 3 100 0 1 15 0
2 100 14 0 80 0 0 1 10 0
6 100 2 100 14 0 0 1 10 0
5 100 8 0 12 0 0 1 20 0
14 0 6 100 2 100 0 1 15 0
12 0 4 0 70 0 0 1 10 0
4 0 3 100 12 0 0 1 10 0
20 100 2 100 3 100 0 1 12 0
3 100 20 100 2 100 0 1 30 0
60 0 6 0 45 0 0 1 20 1
70 3 60 0 2 100 0 1 15 1
90 80 80 0 60 0 0 1 90 0
40 100 60 0 50 0 0 1 95 0
25 95 30 100 28 100 0 1 80 0
7 28 2 0 2 0 0 1 90 1
8 25 30 0 6 0 0 1 95 1
12 35 40 0 30 0 0 1 90 1
6 33 5 0 9 0 0 1 95 1
9 45 20 0 14 0 0 1 90 1
16 40 8 0 3 0 0 1 90 1
8 0 14 0 60 0 1 0 15 0
70 0 60 0 30 0 1 0 15 0
"""

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_TARGET = re.compile(r"\bhref\s*=", re.I)
_ANCHOR = re.compile(r"<(/?)a(?=[\s/>])", re.I)
_SPACE = re.compile(r"\s+")


@dataclass
class Blocks:
    texts: list[str]
    words: list[int]
    links: list[float]
    aside: list[bool]
    article: list[bool]


def _role(tag: str, attributes: str, in_article: bool) -> int:
    """1 for an element of boilerplate, 2 for the article, 3 for one that is not shown, else 0."""
    if tag in SILENT:
        return 3
    if tag in ASIDE or (tag == "header" and not in_article):
        return 1
    if tag in MAIN:
        role = 2
    else:
        role = 0
    aside = False
    if "=" in attributes or "hidden" in attributes:
        for name, value in _NAMED.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return 3
            if name == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    return 3
                continue
            # a name is boilerplate as a whole: sidebar-right is, has-sidebar or comments-open are not
            for token in value.split():
                parts = {x for x in re.split(r"[^a-z]+", token) if x}
                if parts & ASIDE_NAMES and parts <= ASIDE_NAMES | PLACE_NAMES or parts == {"popular", "posts"}:
                    aside = True
                elif parts & MAIN_NAMES and not parts & ASIDE_NAMES and tag in ("div", "section"):
                    role = 2
    if aside and tag not in ("body", "html", "article", "main"):
        return 1
    return role


def cut(page: str) -> Blocks:
    """The text blocks of a page in order."""
    out = Blocks([], [], [], [], [])
    # elements of boilerplate: the one around it, whether only its names or a form say so
    around: list[int] = []
    weak: list[bool] = []
    inner: list[int] = []  # the innermost one of each block, or -1
    opened: list[int] = []
    pieces: list[str] = []
    linked = [0]
    stack: list[tuple[str, int]] = []
    open_tags: Counter[str] = Counter()
    depth = [0, 0, 0, 0]
    # a link lasts to its end tag, or to the end of the block if another link or none follows
    link = unclosed = False

    def flush() -> None:
        nonlocal pieces
        if pieces:
            text = _SPACE.sub(" ", entities.unescape("".join(pieces))).strip()
            if text:
                n = text.count(" ") + 1
                out.texts.append(text)
                out.words.append(n)
                out.links.append(min(1.0, linked[0] / n))
                inner.append(opened[-1] if opened else -1)
                out.article.append(depth[2] > 0)
        pieces = []
        linked[0] = 0

    def leave() -> str:
        tag, role = stack.pop()
        open_tags[tag] -= 1
        depth[role] -= role > 0
        if role == 1:
            opened.pop()
        return tag

    def say(text: str) -> None:
        if text and not depth[3]:
            pieces.append(text)
            if link:
                linked[0] += len(text.split())

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag not in INLINE:
                flush()
                link = link and not unclosed
            elif tag == "br":
                pieces.append(" ")
            if tag == "a":
                link = False
            elif open_tags[tag] > 0:
                while leave() != tag:
                    pass
            continue
        if tag in INLINE:
            if tag == "a":
                link = _TARGET.search(m[3]) is not None
                following = _ANCHOR.search(page, at) if link else None
                unclosed = following is None or not following[1]
            elif tag == "br" and not depth[3]:
                pieces.append(" ")
        else:
            flush()
            link = link and not unclosed
        if tag in EMPTY or tag == "a":
            continue
        if tag in RAW and not m[3].endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if m[3].endswith("/"):
            continue
        if tag not in INLINE:
            if tag in ("p", "li", "option") and stack and stack[-1][0] == tag:
                leave()
            if tag == "body" and depth[3]:  # a head that was never closed
                for gone, role in stack:
                    open_tags[gone] -= role == 3
                stack[:] = [s for s in stack if s[1] != 3]
                depth[3] = 0
        role = _role(tag, m[3], depth[2] > 0)
        depth[role] += role > 0
        if role == 1:
            around.append(opened[-1] if opened else -1)
            weak.append(tag not in ASIDE or tag in ("form", "fieldset"))
            opened.append(len(around) - 1)
        stack.append((tag, role))
        open_tags[tag] += 1
    flush()
    out.aside = _boilerplate(out, around, weak, inner)
    return out


def _boilerplate(blocks: Blocks, around: list[int], weak: list[bool], inner: list[int]) -> list[bool]:
    """Whether each block stands in boilerplate. An element that only its names or a form make so is
    none if it holds most words of the page, and most of those in article elements if there are any."""
    held = [[0, 0] for _ in around]
    total = [0, 0]
    for at, n, article in zip(inner, blocks.words, blocks.article):
        for sums in (total, held[at]) if at >= 0 else (total,):
            sums[0] += n
            sums[1] += n * article
    for at in range(len(around) - 1, -1, -1):
        if around[at] >= 0:
            held[around[at]][0] += held[at][0]
            held[around[at]][1] += held[at][1]
    state: list[bool] = []
    for at, (words, article) in enumerate(held):
        most = 2 * words > total[0] and 2 * article >= total[1]
        state.append(not (weak[at] and most) or (around[at] >= 0 and state[around[at]]))
    return [at >= 0 and state[at] for at in inner]


def features(blocks: Blocks) -> np.ndarray:
    n = len(blocks.texts)
    own = np.column_stack([blocks.words, np.array(blocks.links) * 100]).reshape(n, 2)
    none = np.zeros((1, 2))
    share = own[:, 0] @ np.array(blocks.article, float) / max(1, own[:, 0].sum())
    return np.column_stack(
        [
            own,
            np.vstack([none, own[:-1]]),
            np.vstack([own[1:], none]),
            blocks.aside,
            blocks.article,
            np.full(n, 100 * share),
        ]
    )


@dataclass
class Tree:
    feature: int = -1
    limit: float = 0.0
    content: bool = False
    below: "Tree | None" = None
    above: "Tree | None" = None

    def decide(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.content)
        low = x[:, self.feature] <= self.limit
        return np.where(low, self.below.decide(x), self.above.decide(x))


def _gini(y: np.ndarray) -> float:
    p = y.mean() if len(y) else 0.0
    return 2 * p * (1 - p)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> Tree:
    """A classification tree that lowers Gini impurity; ties go to the first feature and limit."""
    leaf = Tree(content=bool(y.mean() > 0.5))
    if depth == 0 or _gini(y) == 0:
        return leaf
    best = (1e-9, -1, 0.0)
    # context first, for ties
    for f in [6, 7, 8, 0, 1, 2, 3, 4, 5]:
        values = np.unique(x[:, f])
        for limit in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= limit
            gain = _gini(y) - low.mean() * _gini(y[low]) - (~low).mean() * _gini(y[~low])
            if gain > best[0] + 1e-12:
                best = (gain, f, float(limit))
    if best[1] < 0:
        return leaf
    low = x[:, best[1]] <= best[2]
    return Tree(
        best[1], best[2], leaf.content, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)
    )


def labelled() -> tuple[np.ndarray, np.ndarray]:
    table = np.array([[float(v) for v in row.split()] for row in LABELLED.split("\n") if row])
    return table[:, :-1], table[:, -1] > 0


def main_text(page: str | None, tree: Tree) -> str:
    if not page:
        return ""
    blocks = cut(page)
    if not blocks.texts:
        return ""
    content = tree.decide(features(blocks))
    return "\n\n".join(t for t, c in zip(blocks.texts, content) if c)


def extract(pages: DataFrame, name: str, column: str = "html") -> DataFrame:
    """All rows and columns of ``pages`` and the main text, a string called ``name``."""
    tree = grow(*labelled())

    def make():
        return lambda part: pa.array([main_text(p.as_py(), tree) for p in part], pa.string())

    return annotate(pages, column, make, T.StringType(), name)
