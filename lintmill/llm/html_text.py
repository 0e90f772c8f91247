"""Main text of web pages by classifying flat text blocks.

A page is read once, left to right. Block-level tags end a block, inline tags do not; what scripts, styles and
the like enclose is no text. Each block has its word count and link density, those of the two blocks before and
after, how it ends, and a few marks of its place (below an article, a navigation or a form; names that mean adverts or comments).
A decision tree trained on a small table of labelled blocks decides which are main text. Names are inputs among others: only names that
mean one thing (``NAMES``) count, and in the training pages good paragraphs bear ambiguous ones and bad blocks bear none. Nothing is cut short.

Character references are decoded and white space inside a block becomes one space; blocks are joined
by one space in page order. Null and empty pages give the empty text; repeated rows give repeated results.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintmill.llm.common import pieces
from lintmill.llm.forest import Tree, grow_tree
from lintmill.llm.markup import RAW, walk

# Tag names by what they do to the text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSED_BY = {"p": {"p", "div", "ul", "ol", "li", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "aside", "nav", "footer", "header", "form", "blockquote", "pre", "hr", "figure", "main", "dl", "fieldset"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
AWAY_TAGS = {"nav", "menu", "header", "footer", "aside", "form", "select", "button", "fieldset", "dialog", "object", "svg", "canvas", "audio", "video", "head"}
MAIN_TAGS = {"article", "main"}
MAIN_NAMES = {"article", "content", "main", "post", "entry", "story", "article-body", "entry-content", "post-content"}
#: Names of boxes that are no article, by whole class, id or role, or the first or last part of one.
NAMES = {
    "box": "ad ads advert advertisement adverts adsense sponsor sponsored promo cookie cookies consent gdpr popup modal newsletter subscribe subscription paywall sidebar related recommended recommendations widget breadcrumb breadcrumbs pagination pager navbar navigation menu nav masthead footer colophon toc login signup complementary",
    "comments": "comment comments disqus commentlist replies respond",
    # said of boxes and of articles alike
    "maybe": "side aside tags share social banner notice alert warning header copyright bottom trending popular author-box search discussion reviews overlay disclaimer form register skip rail toast logo tabs promotion responses reply",
}
FIGURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "words_2_before", "words_2_after", "sentence", "away_tag", "box", "comments", "maybe", "main", "has_main", "hidden", "heading", "item")

_KIND = {n: k for k, names in NAMES.items() for n in names.split()}
_SPACE = re.compile(r"[\s​﻿]+")
_BLANK = re.compile(r"\s+")


def _marks(attributes: dict[str, str]) -> tuple[frozenset, bool]:
    """(kinds named by class, id or role with "main" among them, hidden)."""
    kinds = set()
    for key in ("class", "id", "role"):
        for word in attributes.get(key, "").lower().split():
            parts = re.split(r"[-_]+", word)
            if word in MAIN_NAMES:
                kinds.add("main")
            elif word in _KIND:
                kinds.add(_KIND[word])
            elif parts[0] not in ("has", "no", "with", "without", "is") and not MAIN_NAMES & set(parts):
                kinds |= {_KIND[p] for p in (parts[0], parts[-1]) if p in _KIND}
    style = attributes.get("style", "").replace(" ", "").lower()
    return frozenset(kinds), "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style


class _Block:
    __slots__ = ("away", "heading", "hidden", "item", "kinds", "link_words", "main", "text", "words")

    def __init__(self, text: str, linked: int, around: tuple, heading: bool, item: bool) -> None:
        self.text, self.heading, self.item = text, heading, item
        self.kinds, self.main, self.hidden, self.away = around
        self.words = text.count(" ") + 1
        self.link_words = min(linked, self.words)


def blocks(page: str) -> list[_Block]:
    """The text blocks of a page in order, empty ones left out."""
    out: list[_Block] = []
    nowhere: tuple = (frozenset(), False, False, False)
    stack: list[tuple[str, tuple]] = []  # tag; kinds around, inside main, hidden, below an away tag
    depth: dict[str, int] = {}
    parts: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = _BLANK.sub(" ", "".join(parts)).strip()
            if text:
                tags = [s[0] for s in stack[-4:]]
                out.append(_Block(text, linked, stack[-1][1] if stack else nowhere, any(len(t) == 2 and t[0] == "h" and t[1] in "123456" for t in tags), any(t in ("li", "td", "th", "dt", "dd") for t in tags)))
        parts, linked = [], 0

    def pop() -> str:
        tag = stack.pop()[0]
        depth[tag] -= 1
        return tag

    for kind, value, attributes, alone in walk(page):
        if kind == "text":
            piece = html.unescape(value)
            parts.append(piece)
            if depth.get("a"):
                linked += len(piece.split())
        elif kind == "close":
            if value in RAW:
                continue
            if value not in INLINE:
                close()
            if depth.get(value):
                while pop() != value:
                    pass
        elif value in RAW:
            close()
        else:
            if value not in INLINE:
                close()
            if value in VOID or alone:
                continue
            while stack and value in CLOSED_BY.get(stack[-1][0], ()):
                pop()
            if value not in INLINE:  # an inline tag left open inside a paragraph ends with it
                while stack and stack[-1][0] in INLINE:
                    pop()
                while stack and value in CLOSED_BY.get(stack[-1][0], ()):
                    pop()
            kinds, main, hidden, away = stack[-1][1] if stack else nowhere
            named, unseen = _marks(attributes) if attributes else (frozenset(), False)
            main |= value in MAIN_TAGS or named == {"main"}
            if value in ("html", "body"):
                named = frozenset()
            elif value in MAIN_TAGS:
                named &= {"comments", "box"}
            kinds |= named - {"main"}
            stack.append((value, (kinds, main, hidden or unseen, away or value in AWAY_TAGS)))
            depth[value] = depth.get(value, 0) + 1
    close()
    return out


def features(found: list[_Block]) -> np.ndarray:
    """``FIGURES`` of each block."""
    n = len(found)
    words = np.array([0, 0, *(b.words for b in found), 0, 0], dtype=np.float64)
    density = np.array([0, 0, *(b.link_words / b.words for b in found), 0, 0], dtype=np.float64)
    has_main = float(any(b.main for b in found))
    columns = [words[2:-2], density[2:-2], words[1:-3], density[1:-3], words[3:-1], density[3:-1], words[:-4], words[4:]]
    columns += [np.array([float(b.text[-1] in ".!?…:;,\"”»)") for b in found]), np.array([float(b.away) for b in found])]
    columns += [np.array([float(k in b.kinds) for b in found]) for k in NAMES]
    columns += [np.array([float(b.main) for b in found]), np.full(n, has_main), np.array([float(b.hidden) for b in found]), np.array([float(b.heading) for b in found]), np.array([float(b.item) for b in found])]
    return np.stack(columns, axis=1)


#: Labelled pages, a stand-in for hand-marked ones.
def labelled_pages(n: int = 1600, seed: int = 3) -> list[tuple[str, list[str]]]:
    """(page, its main blocks) of known layouts made by seeded rules."""
    import random

    rng = random.Random(seed)
    serial = 0

    def sentence(low: int, high: int, end: str = "") -> str:
        nonlocal serial
        serial += 1
        return " ".join([f"w{serial}", *(rng.choice("of the and to in reading about some longer words here".split()) for _ in range(rng.randint(low, high) - 1))]) + end

    def unknown() -> str:
        return rng.choice(("", f" class='c{rng.randrange(99)}'", f" id='k{rng.randrange(99)}'", f" title='{rng.choice(('a hidden valley', 'menu of the day', 'the ad'))}'", f" data-id='{rng.choice(('footer', 'nav', 'ad'))}'"))

    def ambiguous() -> str:
        return f" {rng.choice(('class', 'id'))}='{rng.choice(NAMES['maybe'].split() + ['alert-story', 'share-price', 'tags-note'])}'"

    out = []
    for i in range(n):
        main: list[str] = []

        def good(low: int = 1, high: int = 60, end: str = "") -> str:
            main.append(sentence(low, high, end))  # noqa: B023
            return main[-1]  # noqa: B023

        stop = lambda: rng.choice((".", ".", ".", "", "!", ":"))
        box = lambda: f" {rng.choice(('class', 'id'))}='{rng.choice(NAMES['box'].split())}{rng.choice(('', '', '-1', '-box'))}'"
        links = lambda k, a, b: "".join(f"<li><a href='/x'>{sentence(a, b)}</a></li>" for _ in range(k))
        away = [
            lambda: f"<nav{unknown()}><ul>{links(rng.randint(2, 7), 1, 3)}</ul></nav>",
            lambda: f"<header><h1>{sentence(1, 5)}</h1><p>{sentence(2, 9)}</p></header>",
            lambda: f"<div{box()}>{sentence(3, 30, stop())}</div>",  # noqa: B023
            lambda: f"<div{box()}><p>{sentence(4, 40, stop())}</p></div>",  # noqa: B023
            lambda: f"<aside{unknown()}><h3>{sentence(1, 3)}</h3><p>{sentence(5, 40, stop())}</p></aside>",  # noqa: B023
            lambda: f"<form><label>{sentence(1, 3)}</label><input><button>{sentence(1, 2)}</button></form>",
            lambda: f"<div{box()}>" + "".join(f"<p><a href='/r'>{sentence(3, 9)}</a></p>" for _ in range(3)) + "</div>",  # noqa: B023
            # nothing but its figures tells what it is
            lambda: f"<div{unknown()}><ul>{links(rng.randint(3, 8), 1, 5)}</ul></div>",
            lambda: f"<div{rng.choice((unknown, ambiguous))()}>" + "".join(f"<p><a href='/r'>{sentence(2, 9)}</a></p>" for _ in range(rng.randint(2, 5))) + "</div>",
        ]
        outside = [
            lambda: f"<div{ambiguous()}>{sentence(1, 14)}</div>",
            lambda: f"<div{unknown()}>{sentence(1, 3)}</div>",
        ]
        last = [
            lambda: "<section class='comments'>" + "".join(f"<div class='comment'><p>{sentence(3, 60, stop())}</p></div>" for _ in range(rng.randint(1, 4))) + "</section>",  # noqa: B023
            lambda: "<section id='comments'>" + "".join(f"<article class='comment'><p>{sentence(1, 60, stop())}</p></article>" for _ in range(rng.randint(1, 4))) + "</section>",  # noqa: B023
            lambda: f"<aside><article><h3><a href='/q'>{sentence(2, 6)}</a></h3><p>{sentence(5, 30, stop())}</p></article></aside>",  # noqa: B023
            lambda: f"<footer>{sentence(2, 20, stop())}</footer>",  # noqa: B023
            lambda: f"<div class='footer'><p>{sentence(2, 12, stop())}</p></div>",  # noqa: B023
            lambda: f"<div style='display:none'>{sentence(4, 30, stop())}</div>",  # noqa: B023
            lambda: f"<div{unknown()}><p>{sentence(1, 4)}</p><p><a href='/z'>{sentence(1, 6)}</a></p></div>",
        ]
        layout = i % 4
        before = away if layout == 3 else away + outside
        body = "".join(rng.choice(before)() for _ in range(rng.randint(0, 4)))
        inner = f"<h1>{good(1, 8)}</h1>" if rng.random() < 0.8 else ""
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if layout == 3:  # no container: only long runs of plain text can be told from the rest
                inner += f"<p{unknown()}>{good(12, 60, '.')}</p>"
            elif kind < 0.62:
                inner += f"<p{unknown()}>{good(1, 60, stop())}</p>"
            elif kind < 0.72:
                inner += "<{0}>{1}</{2}>".format(*(("p" + ambiguous(), good(6, 60, "."), "p") if rng.random() < 0.6 else ("div" + ambiguous(), f"<p>{good(6, 60, '.')}</p>", "div")))
            elif kind < 0.8:
                inner += f"<h2>{good(1, 6)}</h2>"
            elif kind < 0.89:
                inner += "<ul>" + "".join(f"<li>{good(1, 12)}</li>" for _ in range(2)) + "</ul>"
            elif kind < 0.92:
                inner += f"<p><a href='/y'>{good(1, 5)}</a></p>"
            elif kind < 0.96:
                inner += f"<blockquote>{good(1, 20)}</blockquote><table><tr><td>{good(1, 4)}</td></tr></table><figure><figcaption>{good(1, 8)}</figcaption></figure>"
            else:
                inner += rng.choice(away[2:7])()
        body += (f"<article{unknown()}>{inner}</article>", f"<main>{inner}</main>", f"<div class='{rng.choice(sorted(MAIN_NAMES))}'>{inner}</div>", f"<div{unknown()}>{inner}</div>")[layout]
        body += "".join(rng.choice(last)() for _ in range(rng.randint(0, 3)))
        if layout == 3:
            body += "".join(f"<p><a href='/z'>{sentence(1, 6)}</a></p><p>{sentence(1, 4)}</p>" for _ in range(rng.randint(0, 2)))
        out.append((f"<html><body>{body}</body></html>", main))
    return out


def train(pages: list[tuple[str, list[str]]] | None = None) -> Tree:
    x, y = [], []
    for page, main in labelled_pages() if pages is None else pages:
        wanted = set(main)
        found = blocks(page)
        if found:
            x.append(features(found))
            y += [float(b.text in wanted) for b in found]
    return grow_tree(np.vstack(x), np.array(y), depth=14, least=8)


def main_text(tree: Tree, page: str | None) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    keep = tree.predict(features(found)) >= 0.5
    return " ".join(b.text for b, k in zip(found, keep.tolist(), strict=True) if k)


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """Per row of ``pages(page_id, url, html)``: page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(tree or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "html"):
                texts = [main_text(shared.value, page) for page in piece.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
