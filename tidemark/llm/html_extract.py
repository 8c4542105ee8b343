"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into flat text blocks at block-level tags. A block has its word count and link
density, the same two of its neighbours, and what its ancestors say: whether it is a heading, which
region of the page it is in, and how strongly tags and names mark it as boilerplate. Names are
graded (``warning`` says less than ``advert``). A decision tree weighs them all, trained on the labelled
blocks of :mod:`labelled_pages` with their names, without, and without names and sections: its root
is a block's link density. An inline element with a marked name is judged like a block of its own inside its paragraph.
Script and style content and markup never become text.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_texts
from tidemark.llm.labelled_pages import LABEL, PAGES
from tidemark.llm.tree import FlatTree, train_tree

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that don't end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is never text of the page.
HIDDEN = frozenset("script style noscript template svg math iframe object canvas audio video title head textarea select option button datalist".split())
#: Of these, the content isn't even markup.
RAW = frozenset("script style textarea title iframe noscript".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog fieldset header".split())
MAIN_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class, id or role that speak for boilerplate, and those that may as well name a part of an article.
STRONG_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense breadcrumb breadcrumbs comment comments commentlist disqus reply replies respond contentinfo consent cookie cookies
    copyright footer gdpr masthead menu menubar modal nav navbar navigation newsletter pager pagination popup promo promoted promotion recommended related share sharing sidebar sidebars
    signup login skip skyscraper social sponsor sponsored subscribe subscription toolbar widget widgets complementary outbrain taboola""".split()
)
WEAK_WORDS = frozenset("alert banner banners byline dialog disclaimer form header notice notices notification popover privacy search side tags teaser topbar warning".split())
#: Words at a name's end that say nothing of what the thing is.
PLACE_WORDS = frozenset(
    """area bar block bottom box btn button buttons card center col column container content count desktop fixed frame group heading holder horizontal icon icons info inner item items label large layout left
    link links list main middle mobile module outer panel placeholder primary right row secondary section side size slot small space sticky strip text title top unit vertical wrap wrapper zone""".split()
)
MAIN_WORDS = frozenset("article articlebody body content entry main maincontent post story text".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A start of one of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

# As HTML5 tokenizes: a name has any characters but white space, slash, > and (after its first) =; a
# stray quote is a name. Possessive groups keep the scan linear.
_ATTR = r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^\s>"'][^\s>]*+))?+)?+"""
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|" + re.sub(r"\((?!\?)", "(?:", _ATTR) + r")*+)(?:>|\Z)", re.S)
ATTR = re.compile(_ATTR)
SPLIT = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
BLANK = re.compile(r"\s+")
HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

FEATURES = ("words", "link_density", "prev_words", "prev_link_density", "next_words", "next_link_density", "tag_mark", "name_mark", "region", "heading", "inline")


class Marks(NamedTuple):
    """What an element and its ancestors say about the text inside."""

    hidden: bool = False
    tag: bool = False
    name: float = 0.0
    main: bool = False
    heading: bool = False
    label: float = -1.0
    source: int = -1  # the number of the outermost element with a mark
    inner: bool = False  # within a main element, whatever is marked around it


class Block(NamedTuple):
    """``parts`` are texts with the number of the marked inline element they stand in, or -1."""

    parts: list[tuple[str, int]]
    words: int
    linked: int
    marks: Marks
    inline: list[tuple[int, int, float, float]]  # words, words in links, mark, label of each inline element


def name_mark(names: str) -> float:
    """How far class, id or role names speak for boilerplate: 0, 0.5 or 1.

    Of the known words in a compound name the last one counts, as it says what the thing is; a
    strong word that isn't last makes it doubtful, and so does a last word that isn't known and
    is no word for a place or number: an ``ad-slot-2`` is an advert, what is ``ad-free`` may not be.
    """
    most = 0.0
    for name in CAMEL.sub("-", names).lower().split():
        parts = [w for w in SPLIT.split(name) if w]
        words = [w for w in parts if w in STRONG_WORDS or w in WEAK_WORDS or w in MAIN_WORDS]
        if words:
            last = 1.0 if words[-1] in STRONG_WORDS else 0.5 if words[-1] in WEAK_WORDS else 0.0
            mark = last if last or len(words) == 1 or words[0] not in STRONG_WORDS else 0.5
            after = parts[len(parts) - parts[::-1].index(words[-1]) :]
            known = all(w in PLACE_WORDS or w.isdigit() or len(w) == 1 or w[0].isdigit() for w in after)
            most = max(most, mark if known else min(mark, 0.5))
    return most


def attributes(tag: str, attrs: str) -> tuple[bool, float, bool, float]:
    """Whether the element hides its content, its name mark, whether it names the article, its label (-1: none)."""
    hidden, name, main, label = tag in HIDDEN, 0.0, False, -1.0
    for key, *values in ATTR.findall(attrs) if attrs else ():
        key, value = key.lower(), htmllib.unescape("".join(values))
        if key in ("class", "id", "role", "itemprop"):
            if tag not in ("body", "html"):
                name = max(name, name_mark(value))
                main |= any(w in MAIN_WORDS for n in value.split() for w in (SPLIT.split(CAMEL.sub("-", n).lower())[-1], n.lower()))
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and HIDES.search(value)):
            hidden = True
        elif key == LABEL:
            label = float(value)
    if tag in HEADINGS or tag == "p":
        name = min(name, 0.5)  # it names a line, not a part of the page
    return hidden, name, main, label


def inside(tag: str, attrs: str, outer: Marks, number: int = -1, wraps: bool = False) -> Marks:
    """The marks of the element of this number that starts within ``outer``; one that ``wraps`` the article has none of its own."""
    hidden, name, main, label = attributes(tag, attrs)
    name = 0.0 if wraps else name
    boiler = not wraps and tag in BOILER_TAGS and not (tag == "header" and outer.main and name < 1)  # an article's own header holds its title
    fresh = tag in MAIN_TAGS and outer.name < 1  # doubtful names around an article don't speak about it
    name = max(name, 0.0 if fresh else outer.name)
    tagged = outer.tag or boiler
    source = outer.source if outer.source >= 0 or not (tagged or name >= 1) else number
    is_main = tag in MAIN_TAGS or main
    return Marks(
        outer.hidden or hidden, tagged, name, (outer.main or is_main) and name < 1 and not tagged, outer.heading or tag in HEADINGS, label if label >= 0 else outer.label, source, outer.inner or is_main,
    )


#: More words than this in a block say no more.
MANY_WORDS = 30
#: An element that holds this share of a page's words, and the only main element, is around the article and not beside it.
WRAPS = 0.5


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order. Marked elements around the whole article, such as one form for the page, don't mark it."""
    wraps: set[int] = set()
    for _ in range(4):  # each turn may find one more layer
        found = _blocks(page, wraps)
        if any(b.marks.main for b in found):
            return found
        words: Counter = Counter()
        for b in found:
            words[b.marks.source] += b.words
        about = {b.marks.source for b in found if b.marks.inner}
        most = next(((s, n) for s, n in words.most_common() if s >= 0), None)
        share = most[1] / sum(words.values()) if most else 0.0
        if share < WRAPS or (most[0] not in about and share < 0.95):
            return found
        wraps.add(most[0])
    return found


def _blocks(page: str, wraps: set[int]) -> list[Block]:
    found: list[Block] = []
    stack: list[tuple[str, Marks]] = []
    is_open: Counter = Counter()
    parts: list[tuple[str, int]] = []
    linked: list[str] = []
    inline: list[tuple[str, float, float, list[str]]] = []  # tag, mark, label, texts in links
    links, marked, depth = 0, -1, 0
    number = 0  # of the elements that aren't inline
    hush: str | None = None  # tag of a hidden inline element
    state = Marks()

    def flush() -> None:
        nonlocal marked, depth, hush
        if parts:
            count = lambda texts: len(htmllib.unescape("".join(texts)).split())
            words = count(p for p, _ in parts)
            if words:
                subs = []
                for k, (_, mark, label, in_links) in enumerate(inline):
                    n = count(p for p, at in parts if at == k)
                    subs.append((n, min(n, count(in_links)), mark, label))
                found.append(Block(parts.copy(), words, min(words, count(linked)), state, subs))
            parts.clear()
        linked.clear()
        inline.clear()
        marked, depth, hush = -1, 0, None

    def close(tag: str) -> None:
        """Ends the innermost open ``tag`` and what is open inside it; a stray end tag does nothing."""
        nonlocal state
        while is_open[tag]:
            top = stack.pop()[0]
            is_open[top] -= 1
            if top == tag:
                break
        state = stack[-1][1] if stack else Marks()

    def put(piece: str) -> None:
        if piece and not state.hidden and hush is None:
            parts.append((piece, marked))
            if links:
                linked.append(piece)
                if marked >= 0:
                    inline[marked][3].append(piece)

    pos, end = 0, len(page)
    while pos < end:
        m = TOKEN.search(page, pos)
        put(page[pos : m.start()] if m else page[pos:])
        if not m:
            break
        pos = m.end()
        tag, attrs = (m[2] or "").lower(), m[3]
        if not tag:
            if m[0].startswith("<![CDATA["):
                put(htmllib.escape(m[0][9:].removesuffix("]]>")))
        elif tag == "br":
            put(" ")
        elif tag in INLINE:
            if tag == "a":
                links = 0 if m[1] else 1
                linked.append(" ")
            if m[1]:
                if depth and tag in (hush, inline[marked][0] if marked >= 0 else None):
                    depth -= 1
                    if not depth:
                        marked, hush = -1, None
            elif depth:
                depth += tag in (hush, inline[marked][0] if marked >= 0 else None) and not attrs.endswith("/")
            elif attrs and tag not in VOID and not attrs.endswith("/"):
                hidden, name, _, label = attributes(tag, attrs)
                if hidden:
                    hush, depth = tag, 1
                elif name > state.name:
                    inline.append((tag, name, label, []))
                    marked, depth = len(inline) - 1, 1
        elif m[1]:
            flush()
            if tag not in VOID:
                close(tag)
        else:
            flush()
            if tag in VOID:
                continue
            if tag in ENDS_P and is_open["p"]:
                close("p")
            if tag in CLOSED_BY and stack and stack[-1][0] in CLOSED_BY[tag]:
                close(stack[-1][0])
            if tag in RAW:
                after = re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
                pos = after.end() if after else (end if tag in ("script", "style") else pos)
                continue
            if attrs.endswith("/") and tag in ("svg", "math", "object"):
                continue
            links = 0 if tag in ENDS_P and tag != "div" else links
            number += 1
            state = inside(tag, attrs, state, number, number in wraps)
            stack.append((tag, state))
            is_open[tag] += 1
    flush()
    return found


def features(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block, then one for each marked inline element, whose neighbours are its own block."""
    has_main = any(b.marks.main for b in found)
    region = [1 if b.marks.main else -1 if has_main else 0 for b in found]
    own = np.array([(min(b.words, MANY_WORDS), b.linked / b.words) for b in found], float).reshape(-1, 2)
    x = np.zeros((len(found), len(FEATURES)))
    x[:, :2], x[1:, 2:4], x[:-1, 4:6] = own, own[:-1], own[1:]
    x[:, 6:10] = [(b.marks.tag, b.marks.name, r, b.marks.heading) for b, r in zip(found, region, strict=True)]
    inline = [
        (min(n, MANY_WORDS), k / n, *own[i], *own[i], b.marks.tag, mark, region[i], b.marks.heading, 1)
        for i, b in enumerate(found) for n, k, mark, _ in b.inline if n
    ]
    return np.vstack([x, inline]) if inline else x


_NAMES = re.compile(r"""\s(?:class|id|role)=("[^"]*"|[^\s>]+)""")
_SECTIONS = re.compile(r"(</?)(?:nav|footer|aside|form|header|main|article|section)\b")


def _table(pages: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    xs, ys = [], []
    for page in pages:
        found = blocks(page)
        xs.append(features(found))
        ys += [b.marks.label for b in found] + [label if label >= 0 else b.marks.label for b in found for n, _, _, label in b.inline if n]
    return np.vstack(xs), np.array(ys)


@lru_cache(1)
def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled pages' blocks."""
    return _table(PAGES)


@lru_cache(1)
def model() -> FlatTree:
    """The tree, trained on the labelled pages as they are, without names, and without names and sections: there words, links and neighbours must decide.

    What surrounds an article in plain sentences, with nothing but its name to tell it, is no example without its name.
    """
    unnamed = tuple(_NAMES.sub("", p) for p in PAGES)
    tables = [labelled()]
    for pages in (unnamed, tuple(_SECTIONS.sub(r"\1div", p) for p in unnamed)):
        x, y = _table(pages)
        told = (y == 1) | (x[:, FEATURES.index("link_density")] > 0.2) | (x[:, 0] <= 5) | (x[:, FEATURES.index("region")] < 0) | (x[:, FEATURES.index("tag_mark")] > 0)
        tables.append((x[told], y[told]))
    x, y = (np.concatenate(t) for t in zip(*tables, strict=True))
    return train_tree(x[y >= 0], y[y >= 0], max_depth=8, least=3)


def extract(pages: list[str | None]) -> list[str]:
    """Main texts of whole pages; the tree scores the blocks of all pages at once."""
    cut = [blocks(p) if p else [] for p in pages]
    parts = [features(b) for b in cut if b]
    keep = (model().predict(np.concatenate(parts)) >= 0.5).tolist() if parts else []
    texts, at = [], 0
    for found in cut:
        inline_at, kept = at + len(found), []
        for i, b in enumerate(found):
            stays = []
            for n, *_ in b.inline:
                stays.append(n == 0 or keep[inline_at])
                inline_at += n > 0
            if keep[at + i]:
                text = BLANK.sub(" ", htmllib.unescape("".join(p for p, k in b.parts if k < 0 or stays[k]))).strip()
                if text:
                    kept.append(text)
        at = inline_at
        texts.append("\n\n".join(kept))
    return texts


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page.

    Null or empty html, and pages without article text, give an empty text. Null ids and urls are
    kept, repeated rows stay rows of their own, other columns are left out, an empty table gives no
    rows. Blocks are joined by a blank line, in page order. Malformed pages are read as HTML5 reads
    them as far as blocks are concerned: a stray end tag does nothing, an open element ends with
    the page, a tag cut by the end of the page is dropped. A page is read once from its start to
    its end, in time and memory in proportion to its length.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = extract(batch.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return map_texts(chosen, run, "page_id long, url string, text string, n_chars long")
