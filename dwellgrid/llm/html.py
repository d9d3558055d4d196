"""The main text of web pages: flat blocks, judged by their links and the markup around them.

A page is read once from left to right into a flat row of text blocks. Each block knows its words, the
share of them inside links, the same of the block before and after it, and whether the markup around it
names a part of the page that is not the article. A decision tree, grown here from the small labelled
table below, keeps the blocks of the article. The table does not need the words or the neighbours, so the
tree does not split on them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.llm.common import quoted

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<[!?][^>]*+>""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
SPLIT = re.compile(r"[^a-z]+")

# Elements of HTML by what they do to text.
UNREAD = {"script", "style", "noscript", "template", "title", "textarea", "svg", "math", "iframe", "object", "canvas", "select", "audio", "video"}
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody"
    " td tfoot th thead tr ul".split()
)
HOLDERS = BLOCKS - {"hr", "html", "body", "p", "h1", "h2", "h3", "h4", "h5", "h6", "head", "option"} | {"span"}
ASIDE = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "search", "fieldset"}
ARTICLE = {"article", "main"}
# Words in class, id and role that name a part which is not the article.
PARTS = set(
    "ad ads adbox adsense advert advertisement advertising adverts alert aside banner breadcrumb breadcrumbs comment comments consent"
    " contentinfo complementary cookie cookies copyright discussion disqus feedback footer form gdpr login masthead menu menubar modal nav"
    " navbar navigation newsletter notice notices overlay pager pagination popup popups promo promotion recommended related replies reply"
    " respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget".split()
)
HEADERS = {"header", "masthead", "banner"}
# Parts that hold articles of their own, so that an article inside is not the page's; words that
# also name sections of an article; parts that are never the page's text, however long; what stands before a
# word to say that a page has or lacks such a part.
OF_OTHERS = set("comment comments discussion disqus recommended related replies reply respond responses sidebar widget".split())
ALSO_SECTIONS = {"discussion", "notice", "notices", "related", "search"}
NEVER = OF_OTHERS - ALSO_SECTIONS | {"consent", "cookie", "cookies", "gdpr", "hidden"}
MODIFIER = re.compile(r"(?<![a-z0-9_-])(?:has|no|with|without|is|not|hide|show)[-_][a-z0-9_-]+")
#: Elements that can stand around a whole page; share of link words up to which a section of an article is text.
AROUND, LINKED = {"form", "fieldset"}, 0.425

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "aside", "article", "has_article")
# words, share in links, the same of the block before, of the block after; inside a part that is named as
# not the article; inside an article element; whether the page has one; label.
LABELLED = [
    (40, 0.0, 35, 0.0, 50, 0.0, 0, 1, 1, 1), (120, 0.0, 8, 0.0, 90, 0.0, 0, 1, 1, 1), (3, 0.0, 60, 0.0, 45, 0.0, 0, 1, 1, 1),
    (1, 0.0, 1, 0.0, 1, 0.0, 0, 1, 1, 1), (7, 0.0, 1, 1.0, 55, 0.0, 0, 1, 1, 1), (12, 0.0, 30, 0.0, 20, 0.3, 0, 1, 1, 1),
    (60, 0.2, 40, 0.0, 30, 0.0, 0, 1, 1, 1), (25, 0.4, 40, 0.0, 30, 0.0, 0, 1, 1, 1), (2, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1, 1),
    (9, 0.5, 50, 0.0, 70, 0.0, 0, 1, 1, 1), (4, 0.0, 12, 0.0, 6, 0.1, 0, 1, 1, 1), (300, 0.05, 9, 0.0, 12, 0.0, 0, 1, 1, 1),
    (6, 1.0, 60, 0.0, 80, 0.0, 0, 1, 1, 1), (3, 1.0, 3, 1.0, 3, 1.0, 0, 1, 1, 1), (1, 1.0, 40, 0.0, 1, 1.0, 0, 1, 1, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 1, 0), (2, 1.0, 3, 1.0, 2, 1.0, 1, 0, 1, 0), (14, 0.0, 1, 1.0, 9, 0.0, 1, 0, 1, 0),
    (55, 0.0, 1, 1.0, 60, 0.0, 1, 0, 1, 0), (80, 0.1, 70, 0.0, 0, 0.0, 1, 0, 1, 0), (9, 0.1, 90, 0.0, 6, 0.0, 1, 0, 1, 0),
    (30, 0.0, 50, 0.0, 45, 0.0, 1, 1, 1, 0), (4, 1.0, 50, 0.0, 4, 1.0, 1, 1, 1, 0), (12, 0.0, 45, 0.0, 70, 0.0, 1, 1, 1, 0),
    (100, 0.0, 12, 0.0, 8, 0.0, 1, 1, 1, 0), (20, 0.0, 20, 0.0, 25, 0.0, 1, 1, 1, 0), (3, 0.0, 3, 0.0, 100, 0.0, 1, 1, 1, 0),
    (8, 0.0, 0, 0.0, 12, 0.0, 0, 0, 1, 0), (22, 0.0, 1, 1.0, 60, 0.0, 0, 0, 1, 0), (45, 0.0, 90, 0.0, 3, 0.0, 0, 0, 1, 0),
    (5, 1.0, 80, 0.0, 4, 1.0, 0, 0, 1, 0), (1, 0.0, 100, 0.0, 12, 0.2, 0, 0, 1, 0), (15, 0.2, 0, 0.0, 7, 0.0, 0, 0, 1, 0),
    (60, 0.0, 50, 0.0, 70, 0.0, 0, 0, 0, 1), (25, 0.0, 30, 0.1, 45, 0.0, 0, 0, 0, 1), (150, 0.1, 5, 0.0, 8, 0.0, 0, 0, 0, 1),
    (12, 0.0, 60, 0.0, 50, 0.0, 0, 0, 0, 1), (8, 0.0, 3, 0.0, 70, 0.0, 0, 0, 0, 1), (35, 0.25, 40, 0.0, 30, 0.1, 0, 0, 0, 1),
    (18, 0.0, 22, 0.0, 0, 0.0, 0, 0, 0, 1), (5, 0.0, 45, 0.0, 60, 0.0, 0, 0, 0, 1), (6, 0.0, 0, 0.0, 18, 0.0, 0, 0, 0, 1),
    (3, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (4, 0.0, 9, 0.0, 3, 0.0, 0, 0, 0, 1), (30, 0.0, 4, 1.0, 9, 0.0, 0, 0, 0, 1),
    (2, 1.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0), (9, 0.9, 40, 0.0, 12, 0.8, 0, 0, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0),
    (20, 0.7, 15, 0.8, 22, 0.9, 0, 0, 0, 0), (5, 0.6, 60, 0.0, 5, 0.6, 0, 0, 0, 0), (40, 0.8, 8, 0.0, 60, 0.0, 0, 0, 0, 0),
    (50, 0.0, 60, 0.0, 40, 0.0, 1, 0, 0, 0), (4, 1.0, 5, 1.0, 50, 0.0, 1, 0, 0, 0), (15, 0.0, 80, 0.0, 9, 0.0, 1, 0, 0, 0),
    (10, 0.0, 0, 0.0, 60, 0.0, 1, 0, 0, 0), (90, 0.1, 20, 0.0, 30, 0.0, 1, 0, 0, 0), (2, 0.0, 45, 0.0, 0, 0.0, 1, 0, 0, 0),
]


def grow(rows: list[tuple], least: int = 1):
    """A binary decision tree by Gini impurity: ("leaf", label) or (feature, cut, below, above)."""
    ones = sum(r[-1] for r in rows)
    if ones in (0, len(rows)):
        return ("leaf", int(ones > 0))
    best = None
    for f in range(len(FEATURES)):
        values = sorted({r[f] for r in rows})
        for low, high in zip(values, values[1:]):
            cut = (low + high) / 2
            sides = [[r for r in rows if r[f] <= cut], [r for r in rows if r[f] > cut]]
            if min(map(len, sides)) >= least:
                cost = sum(len(s) * (p := sum(r[-1] for r in s) / len(s)) * (1 - p) for s in sides)
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, f, cut, sides)
    if best is None:
        return ("leaf", int(2 * ones > len(rows)))
    _, f, cut, (below, above) = best
    return (f, cut, grow(below, least), grow(above, least))


def decide(tree, row: tuple) -> int:
    while tree[0] != "leaf":
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[1]


@dataclass
class Block:
    text: str
    words: int
    links: float
    aside: bool
    article: bool
    parts: tuple[int, ...] = ()


@dataclass
class Part:
    """An element that is named as something else than the article: by which words, and whether inside an article."""

    words: set[str]
    inside: bool


def _part(tag: str, attributes: str, in_article: bool) -> set[str]:
    """The words that name an element as something else than the article; empty if it is none, "" if its kind says so."""
    if attributes and HIDDEN.search(attributes):
        return {"", "hidden"}
    if tag in AROUND:
        return {"form"}
    if tag in ASIDE or (tag == "header" and not in_article):
        return {""}
    named: set[str] = set()
    for found in NAMES.finditer(attributes or ""):
        named |= set(SPLIT.split(MODIFIER.sub(" ", (found[1] or found[2] or found[3] or "").lower())))
    if tag in ARTICLE:
        return named & OF_OTHERS if tag == "article" else set()
    return named & (PARTS if in_article else PARTS | HEADERS)


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in order."""
    out: list[Block] = []
    parts: list[Part] = []
    open_: tuple[int, ...] = ()
    stack: list[tuple[str, bool, bool, tuple[int, ...]]] = []  # open elements: name; around them: aside, article, named parts
    text: list[str] = []
    linked: list[str] = []
    in_link = aside = article = False
    at, size = 0, len(page)

    def close() -> None:
        if text:
            words = html.unescape("".join(text)).split()
            if words:
                inside = len(html.unescape("".join(linked)).split())
                out.append(Block(" ".join(words), len(words), min(1.0, inside / len(words)), aside, article, open_))
            text.clear()
            linked.clear()

    while at < size:
        found = TOKEN.search(page, at)
        if found is None:
            text.append(page[at:])
            break
        if found.start() > at:
            text.append(page[at : found.start()])
            if in_link:
                linked.append(page[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        ending, attributes = found[1], found[3]
        if tag in UNREAD and not ending:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*+[^>]*+>", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if tag == "a":
            in_link = not ending
            linked.append(" ")
        elif tag == "br":
            text.append(" ")
        if tag in BLOCKS:
            close()
            in_link = in_link and tag == "a"
        if tag in HOLDERS:
            if not ending:
                stack.append((tag, aside, article, open_))
                if tag in ARTICLE and not article:
                    # The page's article or main part is no part of what stands around it.
                    others = {w for p in open_ for w in parts[p].words}
                    if not others & (NEVER if tag == "main" else NEVER | OF_OTHERS):
                        open_ = ()
                named = _part(tag, attributes, article)
                if named:
                    if tag == "span":
                        close()
                    if "" in named:
                        aside = True
                    else:
                        open_ = (*open_, len(parts))
                        parts.append(Part(named, article))
                article = article or tag in ARTICLE
            elif any(tag == entry[0] for entry in stack):
                if tag == "span" and stack[-1][0] != "span":
                    continue
                while stack:
                    name, was_aside, was_article, was_open = stack.pop()
                    if name == tag:
                        if was_aside != aside or was_open != open_:
                            close()
                        aside, article, open_ = was_aside, was_article, was_open
                        break
    close()
    _settle(out, parts)
    return out


def _settle(found: list[Block], parts: list[Part]) -> None:
    """Set the blocks of named parts aside, but for parts that hold most of the page's text or are sections of its article."""
    words, unlinked, total = [0] * len(parts), [0.0] * len(parts), 0.0
    for b in found:
        text = b.words * (1 - b.links) * (not b.aside)
        total += text
        for p in b.parts:
            words[p] += b.words
            unlinked[p] += text
    named = set()
    for p, part in enumerate(parts):
        most = 2 * unlinked[p] > total and not part.words & NEVER
        section = part.inside and part.words <= ALSO_SECTIONS and unlinked[p] >= (1 - LINKED) * words[p]
        if not (most or section):
            named.add(p)
    for b in found:
        b.aside = b.aside or not named.isdisjoint(b.parts)


def extract(page: str, tree) -> str:
    found = blocks(page)
    has_article = any(b.article and not b.aside for b in found)
    edge = Block("", 0, 0.0, False, False)
    kept = []
    for i, b in enumerate(found):
        before = found[i - 1] if i else edge
        after = found[i + 1] if i + 1 < len(found) else edge
        row = (b.words, b.links, before.words, before.links, after.words, after.links, b.aside, b.article, has_article)
        if decide(tree, row):
            kept.append(b.text)
    return "\n".join(kept)


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every whole page.

    Null or empty html and pages without an article give the empty text; equal or null keys give a row
    each; other columns are ignored; no rows give no rows. A page is read in one pass whose memory is
    the page and its blocks. Nothing is shuffled.
    """
    tree = grow(LABELLED)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [extract(t, tree) for t in part.column(2).to_pylist()]
            counts = pa.array([len(t) for t in texts], pa.int64())
            yield pa.record_batch(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), counts], ["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(
        quoted(key).cast("long").alias("page_id"),
        quoted(url).cast("string").alias("url"),
        F.coalesce(quoted(page).cast("string"), F.lit("")).alias("html"),
    )
    return rows.mapInArrow(batches, "page_id long, url string, text string, n_chars long")
