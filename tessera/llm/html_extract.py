"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags
negative; how much, weights from labelled pages say, as log-odds that what
stands so belongs to the main text: for words, whether they stand in or beside
an article or main element where the page has one, and the names (classes, ids,
roles) of the elements around them; for tags their own names. A page labels
itself where it marks its article with one <article> element. What the pages
at hand don't show starts from prior counts (PRIOR).

An element whose own name or names weigh against main text (menus, adverts,
forms, scripts, comments, whatever pages taught) is left out with all it holds,
unless an article or main element is in it; it scores nothing, so that an advert amid the
text cuts nothing off. One linear scan over the rest finds the contiguous
region of the highest sum; its words of positive score are the text.

Defined results: null or empty html gives the empty text; a page without words
that score gives the empty text; character references are decoded; white space
in a block is one space; blocks are joined by one space; repeated rows each
give a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch, table, tidied, work

#: Different labelled pages that weights are fitted on, at most.
FIT_PAGES = 400

# Elements that never show text, elements that hold no main text, and names that say so.
RAW = frozenset("script style textarea title noscript iframe template svg math canvas object select datalist audio video".split())
NEVER = frozenset("nav footer aside form menu dialog button head search fieldset header".split()) | RAW
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header comment comments reply replies respond "
    "disqus cookie cookies consent gdpr notice notices alert newsletter subscribe subscription share sharing social related recommended popup modal overlay login signup pager pagination widget widgets toolbar "
    "skip complementary contentinfo search searchbox masthead".split()
)
#: Names that tell already when they come first, words of place or shape after a name, words that turn a name round.
FIRST = frozenset("ad ads advert advertisement sponsored cookie cookies related recommended newsletter breadcrumb".split())
SHAPE = frozenset("left right top bottom box block container wrapper wrap area slot section list item items bar inner outer main primary secondary site page post".split())
TURNED = frozenset("no not non has with without free is".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKS = ("article", "main")
#: Elements that are followed; others may lack their end tags.
PLACES = frozenset("html body section div ul ol dl table figure blockquote details center".split()) | NEVER | frozenset(MARKS)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

#: Prior counts of words (inside, outside): of anything, of what NEVER and NAMES say, of a mark and of what stands beside it.
PRIOR, AGAINST, INSIDE, BESIDE = (5.0, 5.0), (1.0, 50.0), (50.0, 1.0), (1.0, 20.0)
#: A word's score without any evidence, and bounds of the scores of words and of tags.
BASE, WORD_BOUND, TAG_BOUND = 0.5, 3.0, 0.5
#: Log-odds below which an element is left out.
REFUSED = -1.0


def names_nothing(token: str) -> bool:
    """Whether a class, id or role names something that is no main text: 'ad-slot' and 'post-comments' do, 'share-price', 'has-sidebar' don't."""
    parts = [p for p in re.split(r"[^a-z]+", token.lower()) if p]
    if TURNED.intersection(parts):
        return False
    told = [p for p in parts if p not in SHAPE]
    return bool(told) and (told[-1] in NAMES or told[0] in FIRST)


class Element:
    """An open element: its own features, whether it is hidden, holds a mark, stands in one."""

    __slots__ = ("name", "parent", "features", "hidden", "holds", "mark")

    def __init__(self, name: str, attributes: str, parent: Element | None):
        self.name, self.parent, self.holds, self.hidden = name, parent, False, name in RAW or name == "head"
        self.mark = name if name in MARKS and not (parent and parent.mark == "article") else parent.mark if parent else ""
        features = [f"<{name}"] if name in NEVER and not (name == "header" and self.mark) else []
        for key, a, b, c in ATTRIBUTE.findall(attributes) if attributes else ():
            value, key = (a or b or c).lower(), key.lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true"):
                self.hidden = True
            elif key in ("class", "id", "role"):
                features += value.split()
        self.features = features


def units(html: str) -> list[tuple[str, str, Element | None]]:
    """(kind, text or name, element it stands in): kind is 'word' for a run of text, 'open' or 'close' for a tag."""
    out: list[tuple[str, str, Element | None]] = []
    top: Element | None = None
    at = pos = 0
    while True:
        m = TOKEN.search(html, pos)
        if m is None:
            break
        if m.start() > at:
            out.append(("word", html[at : m.start()], top))
        at = pos = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:  # a comment, a declaration or a tag that never ends
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        empty = name in VOID or attributes.rstrip().endswith("/")
        if top is not None and top.name == "p" and name not in INLINE and not (empty and name != "hr") and not (closing and name not in PLACES and name != "p"):
            top = top.parent
        if not closing and name in RAW and not empty:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
            at = pos = end.end() if end else len(html)
            out.append(("open", name, Element(name, attributes, top)))
            continue
        if closing:
            place = top
            while place is not None and place.name != name:
                place = place.parent
            out.append(("close", name, top))
            if name in PLACES and place is not None:
                top = place.parent
            continue
        if (name in PLACES or name == "p") and not empty:
            top = Element(name, attributes, top)
            if name in MARKS:
                over = top.parent
                while over is not None and not over.holds:
                    over.holds, over = True, over.parent
        out.append(("open", name, top))
    if at < len(html):
        out.append(("word", html[at:], top))
    return out


def state(element: Element | None, marks: set[str]) -> str:
    """Where a word stands by the page's marks: in one, beside the article or beside main, or there is none."""
    if element is not None and element.mark:
        return f"in {element.mark}"
    return "beside article" if "article" in marks else "beside main" if "main" in marks else ""


def counted(html: str) -> Counter:
    """Of a labelled page: (feature, inside) counts of words by state and names, of tags by name. What NEVER and NAMES leave out inside the
    article teaches nothing."""
    out: Counter = Counter()
    seq, prior = units(html), Weights({})
    marks = {u[1] for u in seq if u[0] == "open" and u[1] in MARKS}
    for kind, text, element in seq:
        if element is not None and element.hidden:
            continue
        inside = element is not None and element.mark == "article"
        if inside and prior.refused(element):
            continue
        if kind == "word":
            n = len(text.split())
            out[f"at {state(element, marks)}", inside] += n
            while element is not None:
                if not element.holds:
                    for f in element.features:
                        out[f"w {f}", inside] += n
                element = element.parent
        else:
            out[f"t {text}", inside] += 1
    return out


class Weights:
    """Log-odds of features, and by them the scores of words and tags."""

    def __init__(self, counts: dict[tuple[str, bool], int]):
        self.counts = counts
        self.seen: dict[str, float] = {}

    def odds(self, feature: str) -> float:
        got = self.seen.get(feature)
        if got is None:
            kind, name = feature.split(" ", 1)
            if kind == "w":
                prior = AGAINST if name.startswith("<") or names_nothing(name) else PRIOR
            else:
                prior = INSIDE if name.startswith("in ") else BESIDE if name.startswith("beside ") else PRIOR
            a, b = (self.counts.get((feature, x), 0) + p for x, p in zip((True, False), prior, strict=True))
            got = self.seen[feature] = 0.0 if feature == "at " else math.log(a / b)
        return got

    def refused(self, element: Element | None) -> bool:
        """Whether the element, or one around it that holds no mark, is left out."""
        while element is not None:
            if element.hidden or (not element.holds and element.name not in MARKS and any(self.odds(f"w {f}") < REFUSED for f in element.features)):
                return True
            element = element.parent
        return False

    def scores(self, seq) -> list[float]:
        marks = {u[1] for u in seq if u[0] == "open" and u[1] in MARKS}
        known: dict[int, tuple[bool, float]] = {}
        out = []
        for kind, text, element in seq:
            got = known.get(id(element))
            if got is None:
                refused, each = self.refused(element), BASE + self.odds(f"at {state(element, marks)}")
                over = element
                while over is not None and not refused:
                    each += 0.0 if over.holds else sum(self.odds(f"w {f}") for f in over.features)
                    over = over.parent
                got = known[id(element)] = refused, max(-WORD_BOUND, min(WORD_BOUND, each))
            if got[0]:
                out.append(0.0)
            elif kind == "word":
                out.append(len(text.split()) * got[1])
            else:
                out.append(max(-TAG_BOUND, min(-0.01, self.odds(f"t {text}"))))
        return out


def region(scores: list[float]) -> tuple[int, int]:
    """The contiguous range [a, z) of the highest positive sum; the first of several, (0, 0) if none is positive."""
    best, span, run, a = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if run <= 0:
            run, a = 0.0, k
        run += s
        if run > best + 1e-12:
            best, span = run, (a, k + 1)
    return span


def extract(html: str, weights: Weights) -> str:
    """The main text of one page."""
    seq = units(html)
    scores = weights.scores(seq)
    a, z = region(scores)
    blocks, block = [], []
    for (kind, text, _), score in zip(seq[a:z], scores[a:z], strict=True):
        if kind == "word":
            if score > 0:
                block.append(unescape(text))
            elif block and text and not text.strip():
                block.append(" ")
        elif text == "br":
            block.append(" ")
        elif text not in INLINE:
            blocks.append("".join(block))
            block = []
    blocks.append("".join(block))
    return " ".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def fit(pages: DataFrame, html_col: str = "html", limit: int = FIT_PAGES) -> Weights:
    """Weights from at most limit different pages that have just one <article> element, those of the smallest hashes of their html."""
    has = F.length(F.regexp_replace(F.col(html_col), r"(?i)<article\b", "")) == F.length(html_col) - F.length(F.lit("<article"))
    labelled = pages.where(has).select(F.xxhash64(html_col).alias("h"), F.col(html_col).alias("html"))
    last = labelled.select("h").distinct().orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    if last is None:
        return Weights({})
    schema = pa.schema([("what", pa.string()), ("inside", pa.bool_()), ("n", pa.int64())])

    def run(batches):
        for b in batches:
            total: Counter = Counter()
            for html in b.column(0).to_pylist():
                total.update(counted(html))
            yield batch(schema, [k for k, _ in total], [x for _, x in total], list(total.values()))

    sample = labelled.where(F.col("h") <= last).dropDuplicates(["h"]).select("html")
    rows = sample.mapInArrow(tidied(run), "what string, inside boolean, n long").groupBy("what", "inside").agg(F.sum("n").alias("n")).collect()  # bounded by limit
    return Weights({(r["what"], r["inside"]): r["n"] for r in rows})


def extract_pages(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for b in batches:
            found = [extract(h, weights) for h in b.column(2).to_pylist()]
            yield batch(schema, b.column(0), b.column(1), found, [len(x) for x in found])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(tidied(run), "page_id long, url string, text string, n_chars long")


def op2(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    with work(spark) as keep:
        return keep(extract_pages(pages, fit(pages)), "page-texts")
