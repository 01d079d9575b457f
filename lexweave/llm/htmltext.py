"""Main text of web pages by shallow text features (Kohlschuetter, Fankhauser and Nejdl 2010).

A page is cut into flat text blocks at block-level tags; each block has its
word count and link density (share of words inside ``<a>``).  A decision tree
over these two figures of the previous, present and next block keeps or drops
it.  The tree (CART, Gini impurity) is grown from ``LABELLED``, a small table
of blocks of real pages.

Defined results: null or empty html gives empty text and no blocks; unclosed,
stray or nested tags are tolerated; comments, scripts, styles and other unseen
elements are removed whole, to the end of the page if they aren't closed; a
quote that doesn't close counts for nothing, nor do any from a tag on that
would else never end.  A page is read in one go, in time that grows with its
length.  Repeated rows are each answered; other columns are ignored; ids may be
of any type.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK_TAGS = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9]*")
STOP = re.compile("[>\"']")
UNSEEN = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "noscript", "template", "svg")}

#: words and link density of the previous, this and the next block, whether it is main text, and how often it was seen: all blocks of twelve pages,
#: labelled by what they are in the page (links, advertisements and footers, or heading and paragraphs of the article)
LABELLED = [
    (0, 0, 1, 1, 1, 1, 0, 12), (1, 0, 15, 0, 3, 0, 1, 1), (1, 0, 30, 0, 37, 0, 1, 1), (1, 0, 76, 0, 9, 0, 1, 1), (1, 0, 91, 0, 39, 0, 1, 1), (1, 1, 1, 1, 1, 1, 0, 45), (1, 1, 1, 1, 4, 0, 0, 1), (1, 1, 1, 1, 5, 0, 0, 1),
    (1, 1, 1, 1, 6, 0, 0, 1), (1, 1, 1, 1, 7, 0, 0, 1), (1, 1, 1, 1, 8, 0, 0, 4), (1, 1, 1, 1, 9, 0, 0, 1), (1, 1, 1, 1, 10, 0, 0, 1), (1, 1, 1, 1, 11, 0, 0, 1), (1, 1, 1, 1, 12, 0, 0, 1), (1, 1, 4, 0, 6, 0, 0, 1),
    (1, 1, 5, 0, 2, 0, 0, 1), (1, 1, 6, 0, 8, 0, 0, 1), (1, 1, 7, 0, 5, 0, 0, 1), (1, 1, 8, 0, 8, 0, 0, 1), (1, 1, 8, 0, 9, 0, 0, 1), (1, 1, 8, 0, 10, 0, 0, 1), (1, 1, 8, 0, 11, 0, 0, 1), (1, 1, 9, 0, 7, 0, 0, 1),
    (1, 1, 10, 0, 4, 0, 0, 1), (1, 1, 11, 0, 11, 0, 0, 1), (1, 1, 12, 0, 11, 0, 0, 1), (2, 0, 1, 0, 15, 0, 1, 1), (2, 0, 2, 0, 11, 0, 1, 1), (2, 0, 11, 0, 0, 0, 0, 1), (3, 0, 8, 0, 14, 0, 1, 1), (3, 0, 38, 0, 36, 0, 1, 1),
    (3, 0, 82, 0, 108, 0, 1, 1), (4, 0, 4, 0, 47, 0, 1, 1), (4, 0, 6, 0, 6, 0, 1, 1), (4, 0, 47, 0, 75, 0, 1, 1), (5, 0, 2, 0, 2, 0, 1, 1), (5, 0, 5, 0, 15, 0, 1, 1), (5, 0, 15, 0, 0, 0, 0, 1), (5, 0, 131, 0, 21, 0, 1, 1),
    (6, 0, 6, 0, 10, 0, 1, 1), (6, 0, 8, 0, 12, 0, 1, 1), (6, 0, 10, 0, 15, 0, 1, 1), (6, 0, 25, 0, 32, 0, 1, 1), (7, 0, 5, 0, 5, 0, 1, 1), (7, 0, 968, 0, 9, 0, 1, 1), (8, 0, 3, 0, 38, 0, 1, 1), (8, 0, 8, 0, 0, 0, 0, 1),
    (8, 0, 8, 0, 8, 0, 1, 1), (8, 0, 8, 0, 45, 0, 1, 1), (8, 0, 9, 0, 12, 0, 1, 1), (8, 0, 10, 0, 51, 0, 1, 1), (8, 0, 11, 0, 17, 0, 1, 1), (8, 0, 11, 0, 36, 0, 1, 1), (8, 0, 12, 0, 8, 0, 1, 1), (8, 0, 14, 0, 0, 0, 0, 1),
    (8, 0, 20, 0, 8, 0, 1, 1), (8, 0, 45, 0, 1, 0, 1, 1), (9, 0, 7, 0, 0, 0, 0, 1), (9, 0, 7, 0, 968, 0, 1, 1), (9, 0, 12, 0, 9, 0, 1, 1), (9, 0, 39, 0, 8, 0, 1, 1), (10, 0, 4, 0, 4, 0, 1, 1), (10, 0, 15, 0, 0, 0, 0, 1),
    (10, 0, 51, 0, 8, 0, 1, 1), (11, 0, 11, 0, 65, 0, 1, 1), (11, 0, 17, 0, 143, 0, 1, 1), (11, 0, 28, 0, 41, 0, 1, 1), (11, 0, 36, 0, 32, 0, 1, 1), (11, 0, 49, 0, 178, 0, 1, 1), (11, 0, 65, 0, 57, 0, 1, 1), (11, 0, 149, 0, 46, 0, 1, 1),
    (12, 0, 8, 0, 3, 0, 1, 1), (12, 0, 9, 0, 39, 0, 1, 1), (12, 0, 11, 0, 149, 0, 1, 1), (15, 0, 3, 0, 8, 0, 1, 1), (16, 0, 55, 0, 11, 0, 1, 1), (17, 0, 143, 0, 31, 0, 1, 1), (20, 0, 8, 0, 8, 0, 1, 1), (21, 0, 3, 0, 82, 0, 1, 1),
    (22, 0, 11, 0, 0, 0, 0, 1), (25, 0, 11, 0, 0, 0, 0, 1), (25, 0, 32, 0, 13, 0, 1, 1), (28, 0, 6, 0, 25, 0, 1, 1), (28, 0, 41, 0, 1, 0, 1, 1), (29, 0, 138, 0, 31, 0, 1, 1), (30, 0, 37, 0, 47, 0, 1, 1), (31, 0, 61, 0, 38, 0, 1, 1),
    (31, 0, 189, 0, 43, 0, 1, 1), (32, 0, 13, 0, 0, 0, 0, 1), (32, 0, 52, 0, 25, 0, 1, 1), (36, 0, 28, 0, 6, 0, 1, 1), (36, 0, 32, 0, 52, 0, 1, 1), (37, 0, 47, 0, 2, 0, 1, 1), (38, 0, 16, 0, 55, 0, 1, 1), (38, 0, 36, 0, 28, 0, 1, 1),
    (39, 0, 8, 0, 20, 0, 1, 1), (39, 0, 102, 0, 64, 0, 1, 1), (41, 0, 1, 0, 91, 0, 1, 1), (43, 0, 51, 0, 22, 0, 1, 1), (43, 0, 95, 0, 11, 0, 1, 1), (45, 0, 1, 0, 30, 0, 1, 1), (46, 0, 1, 0, 76, 0, 1, 1), (47, 0, 2, 0, 1, 0, 1, 1),
    (47, 0, 75, 0, 43, 0, 1, 1), (49, 0, 178, 0, 10, 0, 1, 1), (51, 0, 8, 0, 11, 0, 1, 1), (51, 0, 22, 0, 11, 0, 1, 1), (52, 0, 25, 0, 11, 0, 1, 1), (55, 0, 11, 0, 28, 0, 1, 1), (57, 0, 5, 0, 131, 0, 1, 1), (61, 0, 38, 0, 16, 0, 1, 1),
    (64, 0, 12, 0, 0, 0, 0, 1), (65, 0, 57, 0, 5, 0, 1, 1), (75, 0, 43, 0, 95, 0, 1, 1), (76, 0, 9, 0, 0, 0, 0, 1), (82, 0, 108, 0, 29, 0, 1, 1), (91, 0, 39, 0, 102, 0, 1, 1), (95, 0, 11, 0, 49, 0, 1, 1), (102, 0, 64, 0, 12, 0, 1, 1),
    (108, 0, 29, 0, 138, 0, 1, 1), (131, 0, 21, 0, 3, 0, 1, 1), (138, 0, 31, 0, 61, 0, 1, 1), (143, 0, 31, 0, 189, 0, 1, 1), (149, 0, 46, 0, 1, 0, 1, 1), (178, 0, 10, 0, 0, 0, 0, 1), (189, 0, 43, 0, 51, 0, 1, 1), (968, 0, 9, 0, 7, 0, 1, 1),
]


def grow(x: np.ndarray, y: np.ndarray, depth: int = 5, least: int = 2) -> tuple | float:
    """CART: nested ``(feature, threshold, low branch, high branch)``, or the share of positives at a leaf."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return share
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        p1, p2 = t[:-1] / n, (t[-1] - t[:-1]) / (len(y) - n)
        gini = n * p1 * (1 - p1) + (len(y) - n) * p2 * (1 - p2)
        gini[(v[1:] == v[:-1]) | (n < least) | (len(y) - n < least)] = np.inf
        i = int(np.argmin(gini))
        if gini[i] < np.inf and (best is None or gini[i] < best[0] - 1e-12):
            best = (gini[i], f, (v[i] + v[i + 1]) / 2)
    if best is None or best[0] >= len(y) * share * (1 - share) - 1e-12:
        return share
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def trained_tree(table: list[tuple] = LABELLED) -> tuple | float:
    a = np.array(table, float)
    a = np.repeat(a, a[:, 7].astype(int), axis=0)
    return grow(a[:, :6], a[:, 6])


def decide(tree: tuple | float, x: np.ndarray) -> np.ndarray:
    """Whether each row of features is main text."""
    if not isinstance(tree, tuple):
        return np.full(len(x), tree >= 0.5)
    f, t, low, high = tree
    at = x[:, f] <= t
    return np.where(at, decide(low, x), decide(high, x))


class Scanner:
    """Tags of a page, in time that grows with its length whatever stands in it: what was looked for in vain isn't looked for again."""

    def __init__(self, page: str):
        self.page = page
        self.gone: dict[str, bool] = {}  # signs that don't stand in the rest
        self.plain = False  # quotes count for nothing: with them a tag would never end

    def find(self, sign: str, at: int) -> int:
        if self.gone.get(sign):
            return -1
        i = self.page.find(sign, at)
        self.gone[sign] = i < 0
        return i

    def tag_end(self, at: int) -> int:
        """Behind the ``>`` of a tag whose name ends at ``at``; a ``>`` in quotes that close doesn't count."""
        first = self.find(">", at)
        if first < 0:
            return -1
        i = at
        while not self.plain:
            m = STOP.search(self.page, i)
            if m is None:
                self.plain = True
            elif m[0] == ">":
                return m.end()
            else:
                close = self.find(m[0], m.end())
                i = close + 1 if close >= 0 else m.end()
        return first + 1

    def tags(self) -> Iterator[tuple[int, int, str]]:
        """Where each tag or unseen piece begins and ends, and its name (with the slash; empty for what isn't seen)."""
        page, at, last = self.page, 0, self.page.rfind(">")
        while (i := self.find("<", at)) >= 0:
            if i > last:  # no tag ends any more; only a comment that isn't closed may follow
                i = page.find("<!--", i)
                if i >= 0:
                    yield i, len(page), ""
                return
            at = i + 1
            if page.startswith("<!--", i):
                end = self.find("-->", i + 4)
                at = len(page) if end < 0 else end + 3
                yield i, at, ""
            elif page.startswith(("<!", "<?"), i):
                end = self.find(">", i)
                if end >= 0:
                    at = end + 1
                    yield i, at, ""
            elif m := NAME.match(page, i + 1):
                if page[m.end() : m.end() + 1] not in (">", "/") and not page[m.end() : m.end() + 1].isspace():
                    continue
                end = self.tag_end(m.end())
                if end < 0:
                    continue
                name = m[0].lower()
                if name in UNSEEN:
                    if page[end - 2] != "/":
                        close = UNSEEN[name].search(page, end)
                        end = close.end() if close else len(page)
                    name = ""
                at = end
                yield i, at, name


def blocks(page: str) -> list[tuple[str, int, int]]:
    """Text, words and linked words of each block that has words."""
    out: list[tuple[str, int, int]] = []
    text: list[str] = []
    words = linked = at = 0
    anchor = in_title = False

    def close() -> None:
        nonlocal words, linked
        if words:
            out.append((" ".join(" ".join(text).split()), words, linked))
        text.clear()
        words = linked = 0

    def add(piece: str) -> None:
        nonlocal words, linked
        if in_title or not piece or piece.isspace():
            if piece:
                text.append(" ")
            return
        piece = html.unescape(piece)
        n = len(piece.split())
        words += n
        linked += n * anchor
        text.append(piece)

    for begin, end, tag in Scanner(page).tags():
        add(page[at:begin])
        at = end
        name = tag.lstrip("/")
        if name == "title":
            in_title = tag == name
        elif name == "a":
            anchor = tag == name
        if name in BLOCK_TAGS:
            close()
            if name in ("body", "html"):
                in_title = False
    add(page[at:])
    close()
    return out


def features(bs: list[tuple[str, int, int]]) -> np.ndarray:
    """Words and link density of the previous, this and the next block (0 beyond the ends)."""
    own = np.array([(0, 0.0), *[(w, l / w) for _, w, l in bs], (0, 0.0)], float).reshape(-1, 2)
    return np.hstack([own[:-2], own[1:-1], own[2:]])


def extract(page: str | None, tree: tuple | float) -> tuple[str, int, int]:
    """Main text (blocks joined by line feeds), number of blocks and of kept blocks."""
    bs = blocks(page) if page else []
    if not bs:
        return "", 0, 0
    keep = decide(tree, features(bs))
    return "\n".join(b[0] for b, k in zip(bs, keep, strict=True) if k), len(bs), int(keep.sum())


def extract_html(pages: DataFrame, key: str = "page_id", source: str = "html", table: list[tuple] = LABELLED) -> DataFrame:
    """``page_id, text, n_blocks, n_kept`` for each row of ``pages``."""
    tree = trained_tree(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [extract(p, tree) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())], [key, "text", "n_blocks", "n_kept"])

    ids = pages.schema[key].dataType.simpleString()
    return pages.select(key, source).mapInArrow(run, f"`{key}` {ids}, text string, n_blocks int, n_kept int")
