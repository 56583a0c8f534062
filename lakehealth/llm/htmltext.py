"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page is flattened to text blocks (the text between block-level tags). Each block has its word
count and link density, those of the block before and after it, whether it is a heading, and the
kind of container it stands in. A decision tree over these features, trained on the small
labelled table below, keeps or drops each block. The kept blocks, white space
turned into single spaces, are joined in page order by a line feed.

Script, style and other text that is not shown, comments and markup never make a block. Character
references are decoded. A tag that is never closed ends with the container around it, and a hidden element
other than a script and the like hides nothing then; a page
cut off inside a tag, comment or script loses that part only. ``<br>`` is white space.

Edge cases: a null or empty page and a page without a kept block give an empty text; repeated
rows give one row each; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakehealth.llm.common import rows_of

# Fixed values of HTML: elements whose text is not shown, void elements, block-level elements.
HIDDEN = {"script", "style", "noscript", "template", "textarea", "select", "option", "svg", "iframe", "object",
          "title", "annotation", "annotation-xml", "button", "canvas", "datalist"}
#: Hidden elements whose content is plain text up to their end tag; without one it is the rest of the page.
RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}
#: Hidden elements that hold none of their own kind.
NOT_NESTED = {"button", "select", "option", "canvas", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div",
         "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
         "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search",
         "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that hold no part of an article, wherever they stand; a header in an article is its own.
ASIDES = {"nav", "aside", "footer", "form", "menu", "dialog", "search", "fieldset"}
#: Words of class, id and role attributes that name something other than the article.
ASIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb",
    "breadcrumbs", "byline", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies",
    "copyright", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pagination", "popup", "promo",
    "promotion", "recommended", "related", "reply", "replies", "search", "share", "sharing", "sidebar", "signup",
    "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "widgets",
}

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: A tag whose quotes do not close.
BROKEN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[a-z]+")
ARTICLE = re.compile(r"<article\b", re.I)

#: Words of a name that turn it into a property of the element ("no-sidebar", "has-comments").
MODIFIERS = {"no", "not", "non", "has", "have", "with", "without", "is", "hide", "show", "enable", "enabled",
             "disable", "disabled", "under", "below", "above", "before", "after"}
#: Last words of a name that say no more than that it holds something ("comment-list", "ad-slot").
HOLDERS = {"area", "bar", "block", "body", "box", "button", "buttons", "container", "form", "group", "holder", "icons",
           "inner", "item", "items", "label", "link", "links", "list", "outer", "panel", "posts", "section", "slot",
           "unit", "wrap", "wrapper"}

#: Kinds of a block; NAMED is an ASIDE by its names, which a main element or the only article inside undoes.
PLAIN, INSIDE, ASIDE, NAMED = 0, 1, 2, 3


@dataclass
class Block:
    text: str
    words: int
    linked: int
    heading: bool
    kind: int


def hidden_end(page: str, name: str, at: int) -> int:
    """Where the content of a hidden element that starts at ``at`` ends. An element other than ``RAW`` ones
    may hold others of its name; one that is never closed hides nothing."""
    if name in RAW:
        over = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
        return over.end() if over else len(page)
    depth = 1
    for tag in re.compile(rf"<(/?){re.escape(name)}(?![\w-])[^>]*>", re.I).finditer(page, at):
        if tag[1]:
            depth -= 1
        elif name in NOT_NESTED:
            return at  # the next one starts before this one ended: it is not closed
        elif not tag[0].endswith("/>"):
            depth += 1
        if not depth:
            return tag.end()
    return at


def aside_name(token: str) -> str | None:
    """The word of ``ASIDE_WORDS`` that one whole name is about: its last word, holders left out."""
    parts = PARTS.findall(token)
    if MODIFIERS.intersection(parts):
        return None
    while len(parts) > 1 and (parts[-1] in HOLDERS or len(parts[-1]) == 1):
        parts.pop()
    if not parts or parts[-1] in ASIDE_WORDS:
        return parts[-1] if parts else None
    stems = (parts[-1].removesuffix(h) for h in HOLDERS if parts[-1].endswith(h))  # "commentlist"
    return next((stem for stem in stems if stem in ASIDE_WORDS), None)


def container_kind(name: str, attributes: str, around: int, only: bool = False) -> int:
    """Kind of the content of an element in a container of kind ``around``; ``only``: no other article is in the page.

    Names never make a main element an aside, and an article only if they name nothing else."""
    if around == ASIDE or name in ASIDES or (name == "header" and around != INSIDE):
        return ASIDE
    if name == "main":
        return INSIDE
    named = False
    if attributes and name not in ("html", "body"):
        for match in NAMES.finditer(attributes):
            tokens = (match[1] or match[2] or match[3] or "").lower().split()
            about = [aside_name(t) for t in tokens]
            some = {a for a in about if a}
            if some and not (around == INSIDE and some & {"header", "byline"}):
                named |= name != "article" or all(about)
    if named or (around == NAMED and not (name == "article" and only)):
        return NAMED
    return INSIDE if name == "article" else around


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order."""
    found: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # open containers: name, kind, heading
    pieces: list[str] = []
    linked: list[str] = []
    in_link = 0
    at, size = 0, len(page)
    only = len(ARTICLE.findall(page)) == 1

    def close() -> None:
        text = " ".join(html.unescape("".join(pieces)).split()) if pieces else ""
        if text:
            link_words = len(html.unescape(" ".join(linked)).split()) if linked else 0
            _, kind, heading = stack[-1] if stack else ("", PLAIN, False)
            found.append(Block(text, len(text.split()), link_words, heading, ASIDE if kind == NAMED else kind))
        pieces.clear()
        linked.clear()

    while at < size:
        start = page.find("<", at)
        if start < 0:
            start = size
        if start > at:
            pieces.append(page[at:start])
            if in_link:
                linked.append(page[at:start])
        if start == size:
            break
        mark = page[start + 1:start + 2]
        if mark in ("!", "?"):
            comment = page.startswith("<!--", start)
            end = page.find("-->" if comment else ">", start + (4 if comment else 2))
            at = size if end < 0 else end + (3 if comment else 1)
            continue
        tag = TAG.match(page, start) or BROKEN_TAG.match(page, start)
        if tag is None:
            if mark.isalpha() or mark == "/":  # cut off inside a tag, or an end tag without name
                end = page.find(">", start)
                at = size if end < 0 else end + 1
            else:  # a bare "<" is text
                pieces.append("<")
                at = start + 1
            continue
        at = tag.end()
        ending, name, attributes = tag[1], tag[2].lower(), tag[3]
        if name == "br":
            pieces.append(" ")
        elif name == "a":
            in_link = 0 if ending else 1
        elif name in HIDDEN and not ending:
            if attributes.endswith("/"):
                continue
            at = hidden_end(page, name, at)
        elif name in BLOCK:
            close()
            if name in VOID:
                continue
            if name == "p":
                in_link = 0
            if not ending:
                _, around, heading = stack[-1] if stack else ("", PLAIN, False)
                if name in ("p", "li", "td", "th", "dd", "dt", "tr") and stack and stack[-1][0] == name:
                    stack.pop()
                    _, around, heading = stack[-1] if stack else ("", PLAIN, False)
                stack.append((name, container_kind(name, attributes, around, only), heading or name in HEADINGS))
            elif any(name == x[0] for x in stack):
                while stack.pop()[0] != name:
                    pass
    close()
    return found


def features(page: list[Block]) -> np.ndarray:
    """[block, feature]: words and link density of the block, the one before and the one after;
    heading; container kind."""
    words = np.array([0, *(b.words for b in page), 0], dtype=float)
    dense = np.array([0, *(b.linked / max(b.words, 1) for b in page), 0], dtype=float)
    return np.stack([words[1:-1], dense[1:-1], words[:-2], dense[:-2], words[2:], dense[2:],
                     np.array([b.heading for b in page], dtype=float),
                     np.array([b.kind for b in page], dtype=float)], axis=1)


# Labelled table (fixed values): pages as rows of (words, words in links, heading, kind, label).
LABELLED: list[list[tuple[int, int, int, int, int]]] = [
    # article element, menu before, advert and footer around
    [(1, 1, 0, 2, 0), (1, 1, 0, 2, 0), (2, 2, 0, 2, 0), (9, 0, 0, 2, 0), (10, 0, 1, 1, 1), (44, 0, 0, 1, 1),
     (120, 2, 0, 1, 1), (3, 0, 0, 1, 1), (61, 0, 0, 1, 1), (14, 0, 0, 2, 0)],
    [(1, 1, 0, 2, 0), (3, 3, 0, 2, 0), (5, 0, 0, 2, 0), (3, 0, 1, 1, 1), (1, 0, 0, 1, 1), (34, 0, 0, 2, 0)],
    [(2, 2, 0, 2, 0), (25, 0, 0, 2, 0), (8, 0, 1, 1, 1), (2, 0, 0, 1, 1), (6, 0, 0, 1, 1), (240, 3, 0, 1, 1),
     (40, 0, 0, 2, 0), (33, 0, 0, 2, 0)],
    [(4, 0, 1, 1, 1), (15, 15, 0, 1, 1), (30, 12, 0, 1, 1), (1, 0, 0, 1, 1), (80, 60, 0, 2, 0)],
    [(3, 3, 0, 0, 0), (6, 0, 1, 1, 1), (80, 24, 0, 1, 1), (5, 2, 0, 1, 1), (200, 90, 0, 1, 1), (12, 4, 0, 1, 1),
     (4, 4, 0, 1, 1), (2, 2, 0, 1, 1), (60, 30, 0, 1, 1), (8, 8, 0, 1, 1), (2, 0, 0, 2, 0)],
    [(1, 1, 0, 2, 0), (2, 1, 0, 1, 1), (1, 1, 0, 1, 1), (3, 2, 0, 1, 1), (90, 50, 0, 1, 1), (9, 3, 0, 2, 0),
     (16, 3, 0, 2, 0), (30, 5, 0, 2, 0)],
    # no article element: running text between short, linked and framing blocks
    [(2, 2, 0, 0, 0), (3, 3, 0, 0, 0), (2, 2, 0, 0, 0), (6, 0, 1, 0, 1), (55, 1, 0, 0, 1), (70, 0, 0, 0, 1),
     (4, 0, 0, 0, 1), (48, 2, 0, 0, 1), (3, 3, 0, 0, 0), (4, 4, 0, 0, 0), (6, 1, 0, 0, 0)],
    [(1, 1, 0, 0, 0), (1, 1, 0, 0, 0), (7, 0, 1, 0, 1), (90, 3, 0, 0, 1), (5, 0, 1, 0, 1), (64, 0, 0, 0, 1),
     (12, 0, 0, 0, 1), (50, 0, 0, 0, 1), (4, 0, 0, 0, 0)],
    [(3, 3, 0, 0, 0), (20, 18, 0, 0, 0), (40, 36, 0, 0, 0), (5, 0, 1, 0, 1), (33, 0, 0, 0, 1), (28, 1, 0, 0, 1),
     (30, 27, 0, 0, 0), (2, 2, 0, 0, 0), (5, 2, 0, 0, 0)],
    [(8, 0, 1, 0, 1), (150, 4, 0, 0, 1), (9, 0, 0, 0, 1), (110, 0, 0, 0, 1), (200, 10, 0, 0, 1), (6, 5, 0, 0, 0)],
    [(2, 0, 0, 0, 0), (3, 2, 0, 0, 0), (6, 0, 1, 0, 1), (18, 0, 0, 0, 1), (24, 0, 0, 0, 1), (2, 1, 0, 0, 0),
     (3, 0, 0, 0, 0)],
    # nothing after the text
    [(1, 1, 0, 2, 0), (8, 0, 1, 1, 1), (60, 0, 0, 1, 1), (22, 0, 0, 1, 1)],
    [(5, 0, 1, 1, 1), (40, 3, 0, 1, 1), (2, 0, 0, 1, 1)],
    [(9, 0, 0, 1, 1), (3, 0, 0, 1, 1)],
    [(12, 5, 0, 1, 1), (4, 2, 0, 1, 1)],
    [(2, 2, 0, 0, 0), (6, 0, 1, 0, 1), (40, 0, 0, 0, 1), (35, 0, 0, 0, 1)],
    [(7, 0, 0, 0, 1), (52, 3, 0, 0, 1), (11, 0, 0, 0, 1)],
    [(3, 0, 1, 0, 1), (14, 0, 0, 0, 1), (9, 0, 0, 0, 1)],
    # framing only
    [(12, 12, 0, 0, 0), (3, 3, 0, 0, 0), (4, 4, 0, 0, 0), (5, 4, 0, 0, 0), (2, 0, 0, 0, 0)],
    [(60, 0, 0, 2, 0), (140, 2, 0, 2, 0), (7, 0, 1, 2, 0), (22, 0, 0, 2, 0)],
    # a page of one block
    [(30, 0, 0, 0, 1)], [(400, 0, 0, 0, 1)], [(12, 0, 0, 1, 1)], [(1, 0, 0, 1, 1)], [(2, 2, 0, 0, 0)],
]


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    x, y = [], []
    for page in LABELLED:
        x.append(features([Block("", w, linked, bool(h), kind) for w, linked, h, kind, _ in page]))
        y += [label for *_, label in page]
    return np.concatenate(x), np.array(y)


class Tree:
    """Binary decision tree by Gini impurity; ties go to the first feature and lowest cut."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 6):
        self.keep = bool(y.mean() >= 0.5)
        self.split = self._best(x, y) if depth and 0 < y.mean() < 1 else None
        if self.split:
            low = x[:, self.split[0]] <= self.split[1]
            self.low, self.high = Tree(x[low], y[low], depth - 1), Tree(x[~low], y[~low], depth - 1)

    @staticmethod
    def _best(x: np.ndarray, y: np.ndarray) -> tuple[int, float] | None:
        gini = lambda part: len(part) * part.mean() * (1 - part.mean())
        best, least = None, gini(y) - 1e-9
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[:, f] <= cut
                impurity = gini(y[low]) + gini(y[~low])
                if impurity < least - 1e-9:
                    best, least = (f, float(cut)), impurity
        return best

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.split:
            return np.full(len(x), self.keep)
        low = x[:, self.split[0]] <= self.split[1]
        out = np.empty(len(x), dtype=bool)
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out


def train() -> Tree:
    return Tree(*labelled_table())


def main_texts(pages: list[str | None], tree: Tree) -> list[str]:
    flat = [blocks(p) if p else [] for p in pages]
    x = [features(f) for f in flat if f]
    keep = iter(tree.predict(np.concatenate(x)).tolist() if x else ())
    return ["\n".join(b.text for b in f if next(keep)) for f in flat]


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    tree = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches, 64):
            texts = main_texts(part.column(2).to_pylist(), tree)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                          F.col("html").cast("string").alias("html"))
    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")
