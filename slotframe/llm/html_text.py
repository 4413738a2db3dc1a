"""HTML extraction: flat text blocks, judged by a decision tree on the words and links of a block and its neighbours."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotframe.llm.common import text_batches

#: Elements whose content is no text. What stands in a raw one is no markup, so without an end it takes the rest of the
#: page (a title within svg may be self-closed); of the others only the tag goes then.
RAW = "script|style|title(?![^<>]*/>)"
SILENT = frozenset("noscript template iframe object svg canvas audio video annotation annotation-xml".split())
#: Comments, silent elements, and tags; quoted values may hold a >. Possessive, and values end before a <, so that no
#: page is scanned over and over.
_PARTS = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>]).*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?/]?[a-zA-Z!?](?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+(?:>|\Z)|<[!?/]?[a-zA-Z!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_MARKS = re.compile(r"(?<![\w-])(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: Elements that don't end a block. Fixed values.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
                   "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd semantics".split())
#: Elements that hold others and so give their blocks a place. Fixed values.
CONTAINERS = frozenset("html body main article section div nav header footer aside form ul ol dl table menu dialog figure details fieldset button select textarea".split())
#: Containers of what isn't the article, and words in a class, id or role that say the same. Fixed values.
BOILER_TAGS = frozenset("nav footer aside form menu dialog button select textarea fieldset".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha comment comments commentlist consent cookie cookies copyright disclaimer "
    "disqus dialog donate footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notification notifications pager pagination paywall "
    "popup promo promoted promotion rail recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription tags teaser toc toolbar topbar warning widget widgets alert complementary contentinfo".split()
)
#: Of these, what a class says only as a whole name: site-header and alert-box do, article-header and social-history don't.
VAGUE_WORDS = frozenset("ad ads alert banner comment dialog header notice notification notifications promoted rail recommended related reply search share skip social tags warning".split())
#: Words beside those of BOILER_WORDS that a whole name may hold. Fixed values.
PLACE_WORDS = frozenset(
    "area bar block box bottom button buttons container form global group icons inner item items left link links list module my page panel posts articles stories primary right secondary section site the top wp wrap wrapper".split()
)
#: Words of a wrapper's name that don't count when it holds most of the page; talk and links may well be most of a page.
LAYOUT_WORDS = frozenset("header menu modal nav navbar rail sidebar toolbar topbar widget widgets".split())
ARTICLE_WORDS = frozenset("article articlebody content entry post story maincontent".split())

#: words, link density, words before, links before, words after, links after, in article, in boilerplate, heading; keep.
#: A small table labelled by hand.
LABELLED = (
    (80, 0.0, 60, 0.0, 70, 0.0, 1, 0, 0, 1),
    (45, 0.1, 12, 0.0, 90, 0.0, 1, 0, 0, 1),
    (1, 0.0, 60, 0.0, 50, 0.0, 1, 0, 0, 1),
    (2, 0.0, 1, 0.0, 1, 0.0, 1, 0, 0, 1),
    (6, 0.0, 0, 0.0, 40, 0.0, 1, 0, 1, 1),
    (1, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 1),
    (30, 0.4, 30, 0.3, 25, 0.5, 1, 0, 0, 1),
    (4, 1.0, 50, 0.0, 60, 0.0, 1, 0, 0, 1),
    (9, 0.0, 8, 1.0, 3, 0.0, 1, 0, 0, 1),
    (200, 0.0, 5, 0.0, 12, 0.0, 1, 0, 0, 1),
    (3, 0.0, 300, 0.0, 9, 0.2, 1, 0, 0, 1),
    (90, 0.0, 50, 0.0, 60, 0.0, 0, 0, 0, 1),
    (35, 0.05, 3, 1.0, 80, 0.0, 0, 0, 0, 1),
    (25, 0.0, 40, 0.0, 5, 0.9, 0, 0, 0, 1),
    (2, 0.0, 60, 0.0, 50, 0.0, 0, 0, 0, 1),
    (8, 0.0, 70, 0.0, 45, 0.0, 0, 0, 0, 1),
    (7, 0.0, 2, 1.0, 55, 0.0, 0, 0, 1, 1),
    (5, 0.0, 30, 0.0, 40, 0.0, 0, 0, 1, 1),
    (18, 0.1, 22, 0.0, 30, 0.0, 0, 0, 0, 1),
    (60, 0.2, 2, 1.0, 3, 1.0, 0, 0, 0, 1),
    (120, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1),
    (250, 0.0, 180, 0.0, 190, 0.0, 1, 1, 0, 1),
    (250, 0.0, 180, 0.0, 190, 0.0, 0, 1, 0, 1),
    (600, 0.0, 200, 0.0, 300, 0.0, 0, 1, 0, 1),
    (30, 0.0, 25, 0.0, 0, 0.0, 0, 1, 0, 0),
    (26, 0.0, 40, 0.0, 4, 0.5, 0, 1, 0, 0),
    (25, 0.0, 26, 0.0, 27, 0.0, 1, 1, 0, 0),
    (60, 0.0, 70, 0.0, 8, 0.0, 1, 1, 0, 0),
    (4, 0.0, 50, 0.0, 3, 0.0, 1, 1, 0, 0),
    (35, 0.0, 3, 0.0, 1, 1.0, 0, 1, 0, 0),
    (250, 0.9, 180, 0.0, 190, 0.0, 0, 1, 0, 0),
    (300, 0.8, 200, 0.0, 150, 0.0, 1, 1, 0, 0),
    (250, 0.0, 3, 1.0, 2, 1.0, 0, 1, 0, 0),
    (600, 0.0, 20, 0.0, 0, 0.0, 0, 1, 0, 0),
    (5, 0.0, 60, 0.0, 260, 0.0, 0, 1, 0, 0),
    (26, 0.0, 180, 0.0, 250, 0.0, 1, 1, 0, 0),
    (90, 0.0, 2, 1.0, 240, 0.0, 0, 1, 0, 0),
    (40, 0.0, 250, 0.0, 220, 0.0, 0, 1, 0, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 0),
    (2, 1.0, 0, 0.0, 2, 1.0, 0, 1, 0, 0),
    (40, 0.0, 2, 1.0, 60, 0.0, 0, 1, 0, 0),
    (90, 0.0, 80, 0.0, 70, 0.0, 0, 1, 0, 0),
    (60, 0.0, 50, 0.0, 40, 0.0, 1, 1, 0, 0),
    (5, 0.0, 60, 0.0, 60, 0.0, 1, 1, 0, 0),
    (12, 0.3, 90, 0.0, 0, 0.0, 0, 1, 0, 0),
    (3, 0.0, 40, 0.0, 2, 0.0, 1, 1, 1, 0),
    (8, 0.0, 2, 1.0, 30, 0.0, 0, 1, 1, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0),
    (2, 1.0, 2, 1.0, 8, 0.0, 0, 0, 0, 0),
    (3, 1.0, 60, 0.0, 3, 1.0, 0, 0, 0, 0),
    (6, 0.9, 5, 1.0, 40, 0.0, 0, 0, 0, 0),
    (4, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0),
    (9, 0.5, 3, 1.0, 4, 0.8, 0, 0, 0, 0),
    (7, 0.0, 5, 0.2, 3, 1.0, 0, 0, 0, 0),
    (6, 0.0, 40, 0.0, 0, 0.0, 0, 0, 0, 0),
    (3, 0.0, 2, 1.0, 0, 0.0, 0, 0, 0, 0),
    (5, 0.0, 4, 0.0, 6, 0.0, 0, 0, 0, 0),
    (20, 0.8, 4, 1.0, 5, 1.0, 0, 0, 0, 0),
    (2, 0.0, 1, 1.0, 1, 1.0, 0, 0, 1, 0),
)


@dataclass(frozen=True)
class Node:
    """A leaf has ``keep``; else rows with value <= at go to ``low``."""

    feature: int = -1
    at: float = 0.0
    low: Node | None = None
    high: Node | None = None
    keep: bool = False


def _impurity(rows: list[tuple]) -> float:
    good = sum(r[-1] for r in rows)
    return 2.0 * good * (len(rows) - good) / len(rows) if rows else 0.0


def grow(rows: list[tuple], depth: int = 8) -> Node:
    """A tree by the greatest fall of Gini impurity; ties go to the first feature and lowest value."""
    leaf = Node(keep=2 * sum(r[-1] for r in rows) >= len(rows))
    if depth == 0 or _impurity(rows) == 0:
        return leaf
    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:]):
            at = (a + b) / 2
            cost = _impurity([r for r in rows if r[f] <= at]) + _impurity([r for r in rows if r[f] > at])
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, at)
    if best is None:
        return leaf
    _, f, at = best
    return Node(f, at, grow([r for r in rows if r[f] <= at], depth - 1), grow([r for r in rows if r[f] > at], depth - 1))


@cache
def tree() -> Node:
    return grow(list(LABELLED))


def keeps(node: Node, row: tuple) -> bool:
    while node.feature >= 0:
        node = node.low if row[node.feature] <= node.at else node.high
    return node.keep


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    article: bool
    boiler: bool
    heading: bool
    hidden: bool
    wrappers: tuple[int, ...]  # marked elements around it that don't count when they hold most of the page


#: A class name with one of these tells of something beside, as has-sidebar and content-with-sidebar do. Fixed values.
_BESIDE = frozenset("has with without no is not".split())
_HIDDEN = re.compile(r"\shidden(?=[\s>])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


def _words_of(name: str) -> list[str]:
    """The words of a class, id, role or label; none where it tells of something beside."""
    parts = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
    return [] if not parts or parts[0] == "layout" or _BESIDE.intersection(parts) else parts


def _marks(tag: str, heading: bool = False) -> tuple[set[str], set[str]]:
    """The words in a tag's classes, id, role and label, and those of them that say boilerplate.

    Ids and labels, and vague words of classes, count as whole names only; a heading's id is an anchor and doesn't count.
    """
    out: set[str] = set()
    boiler: set[str] = set()
    for m in _MARKS.finditer(tag):
        kind, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        for name in [value] if kind == "aria-label" else value.split():
            parts = _words_of(name)
            found = BOILER_WORDS.intersection(parts)
            whole = all(w in BOILER_WORDS or w in PLACE_WORDS or w.isdigit() for w in parts)
            if kind in ("id", "aria-label"):
                found = found if whole and not heading else set()
            elif not whole:
                found = found - VAGUE_WORDS
            out.update(parts)
            boiler |= found
    return out, boiler


def _silences(tags: list[re.Match]) -> dict[int, int]:
    """Where each silent element that has an end tag begins and ends; an end tag belongs to the nearest open one."""
    opened: dict[str, list[int]] = {}
    out: dict[int, int] = {}
    for m in tags:
        tag = m.group()
        if m.group(1) or not (name := _NAME.match(tag)) or (n := name.group(1).lower()) not in SILENT:
            continue
        if tag[1] != "/":
            if n != "svg" or not tag.endswith("/>"):
                opened.setdefault(n, []).append(m.start())
        elif opened.get(n):
            out[opened[n].pop()] = m.end()
    return out


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, with where they stand."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, bool, tuple[int, ...]]] = [("", False, False, False, False, ())]  # name, in article, in boilerplate for good, by a mark, hidden, wrappers
    parts: list[str] = []
    links: list[str] = []
    anchor = head = 0
    heading = leaf = unseen = False  # of the block at hand: whether it is a heading, whether its own tag says boilerplate or hides it
    wrappers = 0

    def end() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            linked = len(html.unescape(" ".join(links)).split())
            _, article, fixed, marked, hidden, around = stack[-1]
            out.append(Block(text, text.count(" ") + 1, linked, article, fixed or marked or leaf, heading, hidden or unseen, around))
        parts.clear()
        links.clear()

    def say(text: str) -> None:
        if text and not head:
            parts.append(text)
            if anchor:
                links.append(text)

    at = 0
    tags = list(_PARTS.finditer(page))
    silences = _silences(tags)
    for m in tags:
        if m.start() < at:  # within a silent element
            continue
        say(page[at : m.start()])
        at = silences.get(m.start(), m.end())
        tag = m.group()
        if not (name := _NAME.match(tag)) or m.group(1):
            continue
        n, closing = name.group(1).lower(), tag[1] == "/"
        if n in SILENT:
            continue
        if n in INLINE:
            if n == "a":
                anchor = 0 if closing else 1
            elif n == "br":
                say(" ")
            continue
        end()
        anchor = 0
        if n == "head":
            head = 0 if closing else 1
        elif n == "body":
            head = 0
        heading = n in ("h1", "h2", "h3", "h4", "h5", "h6") and not closing
        leaf = unseen = False
        root = n in ("html", "body")
        if n not in CONTAINERS or tag.endswith("/>"):
            leaf = not closing and not root and "=" in tag and bool(_marks(tag, heading)[1])
            unseen = not closing and bool(_HIDDEN.search(tag))
            continue
        if closing:
            if any(x[0] == n for x in stack):
                while stack.pop()[0] != n:
                    pass
            continue
        _, article, fixed, marked, hidden, around = stack[-1]
        marks, says = _marks(tag) if "=" in tag and not root else (set(), set())
        if n in ("article", "main"):  # the outermost one clears what a name or form around it says; a main, all
            says = set()
            marked, around = marked and article, around if article else ()
            fixed = fixed and n != "main"
        hidden = hidden or not root and bool(_HIDDEN.search(tag))
        own = n in ("article", "main") or bool(marks & ARTICLE_WORDS)
        if n == "form" and not says or says and says <= LAYOUT_WORDS and n not in BOILER_TAGS and n != "header":
            wrappers += 1
            around = (*around, wrappers)
            bad = False
        else:
            bad = n == "header" and not article or bool(says)
            marked = marked or bad
        place = n in BOILER_TAGS and n != "form"
        stack.append((n, article or own and not (place or bad), fixed or place, marked, hidden, around))
    say(page[at:])
    end()
    held: dict[int, int] = {}
    for b in out:
        for w in b.wrappers:
            held[w] = held.get(w, 0) + b.words - b.link_words
    most = sum(b.words - b.link_words for b in out if not b.hidden) / 2
    for b in out:
        b.boiler = b.boiler or any(held[w] <= most for w in b.wrappers)
    return out


def main_text(page: str | None) -> str:
    """The article's blocks in page order, a line each; empty for null, empty and text-free pages."""
    found = blocks(page or "")
    density = [b.link_words / b.words for b in found]
    kept = []
    for i, b in enumerate(found):
        before = (found[i - 1].words, density[i - 1]) if i else (0, 0.0)
        after = (found[i + 1].words, density[i + 1]) if i + 1 < len(found) else (0, 0.0)
        if not b.hidden and keeps(tree(), (b.words, density[i], *before, *after, int(b.article), int(b.boiler), int(b.heading))):
            kept.append(b.text)
    return "\n".join(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            texts = pa.array([main_text(x.as_py()) for x in part.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), texts], ["page_id", "url", "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """One row for each row of ``pages`` (page_id, url, html): page_id, url, text, n_chars (code points).

    No shuffle: each page is read alone. A null or empty html, and a page without an article, give an empty text;
    a page cut short ends its last block there. Null ids and urls are passed on, repeated rows are each extracted,
    an empty table gives an empty result. Only the three columns named are read.
    """
    rows = text_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(_extract, "page_id long, url string, text string")
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))
