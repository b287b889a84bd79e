"""Main-text extraction by line-block distribution.

A page is read once, from left to right, by the rules of HTML for tags, attributes, raw text and omitted end tags, into lines, one a block element. Menus, page headers, footers, sidebars, notices, adverts, forms and
reader comments are left out where an element, a role, or the head of a class or id name tells them ("site-footer" and "ad-slot" do, "ad-free" and "alert-history" don't, but weigh their lines down); in an article that the page
marks, only names that no article part has count.
A line weighs its length, a short one that ends no sentence a quarter of it, and nothing if it is mostly links outside a marked article. The weights are summed over a
sliding window of lines. A window of `DIVE` or less is a dive, a window over `SURGE` a surge; the weighted lines between two dives are kept if they hold a surge.
Windows end where a marked article begins or ends, so other lines need a surge of their own. A marked article's characters weigh `MARKED` times: its lines of six characters or more are surges, so inside it the page's own mark
decides, and the windows only tell apart marked articles, and everything on pages without a mark.

Edge cases: a null or empty page, or one without text, gives an empty string; unclosed tags close with what holds them, at the page's end, or at the article
that follows; a quote that is never closed is part of an unquoted value; a tag that is never closed ends the page; a page without any surge keeps all its weighted lines; repeated rows are each extracted.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: Weights in a window up to which it is a dive, and above which it is a surge, and the weight of a marked article's characters; others weigh one.
DIVE, SURGE, MARKED = 20, 80, 16
#: Characters from which a line needs no end of a sentence to weigh whole, and what a sentence weighs at least.
LONG, SENTENCE = 40, 24

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_BEFORE = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"[^\s/>][^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_VALUE = re.compile(r"[^\s>]*")
_ENDS = re.compile(r"[.!?…。！？:;][\"'”’»)\]]*$")
_WORDS = re.compile(r"[-_:]+")
_NUMBER = re.compile(r"\d+$")

# Names of HTML elements and of the parts of a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
#: Elements whose content is no text of the page, if they are closed.
OPAQUE = frozenset("noscript template svg iframe object select canvas math".split())
CLOSE_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
_SPECIAL = tuple("ul ol menu dir dl table td th tr article section main aside nav header footer form blockquote fieldset figure details body".split())
#: What a start tag closes where end tags are left out, and what keeps it from looking further up.
CLOSES = {
    "li": (("li",), _SPECIAL), "dt": (("dt", "dd"), _SPECIAL), "dd": (("dt", "dd"), _SPECIAL), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tr": (("td", "th", "tr"), ("table", "tbody", "thead", "tfoot")), "option": (("option",), ("select", "datalist", "optgroup")),
} | {t: (("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)) for t in ("tbody", "thead", "tfoot")}
CELLS = ("table", "td", "th", "caption")
DROPPED = frozenset("head nav footer aside form dialog menu button fieldset".split())
ARTICLE = frozenset(("article", "main"))
WHOLE = frozenset(("html", "body"))
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
PARTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert"
    " sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments respond disqus replies share sharing social related"
    " recommended newsletter subscribe signup login popup modal overlay widget pagination pager form search".split()
)
#: Those of them that may also name parts of an article, and so drop nothing inside one.
PARTS_OF_ARTICLES = frozenset("alert notice banner widget search form menu nav navigation masthead topbar promotion overlay modal pager pagination related sharing".split())
PARTS_AND_HEADER = PARTS | {"header"}
#: A name with one of these is a layout of several parts, such as "no-sidebar" or "content-with-menu".
LAYOUT = frozenset("has no with without".split())
#: Words behind a name's head that only say where or how: "ad-slot" is an ad, "sidebar-left" a sidebar.
TAILS = frozenset("slot box wrap wrapper container block area section list inner outer left right top bottom main unit bar link links button buttons icons item items row col panel zone holder group bottom primary secondary".split())


def name_of_part(name: str, parts: frozenset) -> bool | None:
    """Whether a class or id name is a page part's by its head, the last word that isn't a tail; None if a part's name only stands in another place."""
    words = [_NUMBER.sub("", w) for w in _WORDS.split(name) if w]
    if not parts.intersection(words) or LAYOUT.intersection(words):
        return False
    while len(words) > 1 and (words[-1] in TAILS or not words[-1]):
        words.pop()
    return words[-1] in parts or None


def _judged(tag: str, attrs: list[tuple[str, str]], inside: bool) -> tuple[bool, bool]:
    """Whether an element is left out, and else whether its name weighs it down."""
    if tag in WHOLE:
        return False, False
    if tag in DROPPED or tag == "header" and not inside:
        return True, False
    soft = False
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.lower().replace(" ", ""):
            return True, False
        if name in ("class", "id", "role", "aria-label"):
            for word in value.lower().split():
                if name == "role" and word in ROLES:
                    return True, False
                found = name_of_part(word, PARTS - PARTS_OF_ARTICLES if inside else PARTS_AND_HEADER)
                if found:
                    return True, False
                soft |= found is None
    return False, soft


class _Tokens:
    """Tags and texts of a page, each character looked at a bounded number of times: a search that fails once is not made again."""

    def __init__(self, page: str):
        self.page, self.none = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.none:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.none.add(what)
        return found

    def end_of(self, tag: str, at: int) -> int | None:
        """Behind the end tag of a raw element; None if there is none."""
        if tag in self.none:
            return None
        found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(self.page, at)
        if not found:
            self.none.add(tag)
            return None
        end = self.find(">", found.end())
        return end + 1 if end >= 0 else len(self.page)

    def attributes(self, at: int) -> tuple[list[tuple[str, str]], int]:
        """A tag's attributes from behind its name, and the place behind its end."""
        page, out = self.page, []
        while True:
            at = _BEFORE.match(page, at).end()
            if at >= len(page):
                return out, at
            if page[at] == ">":
                return out, at + 1
            name = _ATTRIBUTE.match(page, at)
            at, value = name.end(), ""
            if equals := _EQUALS.match(page, at):
                at = equals.end()
                quote = page[at : at + 1]
                end = self.find(quote, at + 1) if quote in ("'", '"') and quote else -1
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    bare = _VALUE.match(page, at)
                    value, at = bare[0], bare.end()
            out.append((name[0].lower(), value))

    def __iter__(self) -> Iterator[tuple[str, str, object]]:
        """("text", text, None), ("start", tag, attributes), ("end", tag, None), ("gap", tag, None) for an element whose content is left out."""
        page, at, begin = self.page, 0, 0
        while True:
            lt = page.find("<", at)
            if lt < 0 or lt + 1 >= len(page):
                break
            c = page[lt + 1]
            name = _NAME.match(page, lt + 2 if c == "/" else lt + 1) if c == "/" or c.isascii() and c.isalpha() else None
            if c not in "!?" and not name:
                at = lt + 1
                continue
            if lt > begin:
                yield "text", page[begin:lt], None
            if not name:
                end = self.find("-->", lt + 4) if page.startswith("<!--", lt) else self.find(">", lt)
                at = begin = len(page) if end < 0 else end + (3 if page.startswith("<!--", lt) else 1)
                continue
            tag = name[0].lower()
            attrs, at = self.attributes(name.end())
            begin = at
            if c == "/":
                yield "end", tag, None
            elif tag in RAW or tag in OPAQUE and not page.startswith("/>", at - 2):
                end = self.end_of(tag, at)
                if end is not None or tag in RAW:
                    at = begin = len(page) if end is None else end
                    yield "gap", tag, None
            elif tag not in OPAQUE:
                yield "start", tag, attrs
        if begin < len(page):
            yield "text", page[begin:], None


class _Open:
    """The block elements that are open, and how many of them are left out, marked articles, or weighed down."""

    def __init__(self) -> None:
        self.stack: list[tuple] = []
        self.at: dict[str, list[int]] = {}
        self.counts, self.gone = [0, 0, 0], []

    def push(self, tag: str, flags: tuple) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        if flags[0]:
            self.gone.append(len(self.stack))
        self.stack.append((tag, flags))
        for i, f in enumerate(flags):
            self.counts[i] += f

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag, flags = self.stack.pop()
            self.at[tag].pop()
            if flags[0]:
                self.gone.pop()
            for i, f in enumerate(flags):
                self.counts[i] -= f

    def last(self, tags) -> int:
        return max((p[-1] for t in tags if (p := self.at.get(t))), default=-1)

    def implied(self, tag: str) -> int | None:
        """The depth to which a start tag closes what is open."""
        found = []
        if tag in CLOSES:
            closing, stops = CLOSES[tag]
            bound = self.last(t for t in stops if t not in closing)
            for t in closing:
                places = self.at.get(t) or ()
                i = bisect_right(places, bound)
                if i < len(places):
                    found.append(places[i] if tag != "li" else places[-1])
        if tag in CLOSE_P and self.at.get("p") and self.at["p"][-1] > self.last(CELLS):
            found.append(self.at["p"][-1])
        return min(found, default=None)

    def ended(self, tag: str) -> int | None:
        """The depth to which an end tag closes; None if it has nothing to close."""
        places = self.at.get(tag)
        if not places or tag in WHOLE or tag not in CELLS and tag not in CLOSES and places[-1] < self.last(CELLS):
            return None
        return places[-1]


def lines_of(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters of it in links, inside a marked article, weighed down) of each block outside the parts left out."""
    lines: list[tuple[str, int, bool, bool]] = []
    held: list[str] = []
    open_ = _Open()
    linked, link = 0, -1  # link: the depth at which a link was opened

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                lines.append((text, min(linked, len(text)), open_.counts[1] > 0, open_.counts[2] > 0))
            held.clear()
        linked = 0

    for kind, tag, attrs in _Tokens(page):
        if kind == "text":
            if not open_.counts[0]:
                held.append(tag)
                if link >= 0:
                    linked += len(tag)
            continue
        if kind == "gap":
            held.append(" ")
            continue
        if kind == "end":
            if tag == "a":
                link = -1
            depth = open_.ended(tag)
            if tag not in INLINE:
                flush()
            if depth is not None:
                open_.cut(depth)
        elif tag in VOID:
            if tag not in INLINE:
                flush()
                if (depth := open_.implied(tag)) is not None:
                    open_.cut(depth)
        else:
            depth = open_.implied(tag)
            if depth is not None:
                flush()
                open_.cut(depth)
            gone, soft = _judged(tag, attrs, open_.counts[1] > 0)
            if open_.counts[0] and (tag == "body" or tag in ARTICLE and not _judged(tag, attrs, True)[0]):
                first = open_.gone[0]
                if tag == "body" or open_.stack[first][0] not in ARTICLE:  # what was never closed ends here
                    flush()
                    open_.cut(first)
                    gone, soft = _judged(tag, attrs, open_.counts[1] > 0)
            if tag == "a":
                link = len(open_.stack)
            if tag not in INLINE or gone:
                flush()
                open_.push(tag, (gone, not gone and tag in ARTICLE, soft))
        if link > len(open_.stack):
            link = -1
    flush()
    return lines


def regions(weights: list[int], surge: int, window: int = WINDOW, marks: list[bool] | None = None, dive: int = 0) -> list[tuple[int, int]]:
    """[start, end) line ranges between dives, which are window sums of `dive` or less, that hold a surge, a window sum over `surge`. No window spans both marked and other lines."""
    n, out, at = len(weights), [], 0
    while at < n:
        end = at + 1
        while end < n and (marks is None or marks[end] == marks[at]):
            end += 1
        start, top = -1, 0
        for i in range(at, end + 1):
            total = sum(weights[i : min(i + window, end)])
            if total <= dive and start >= 0:
                if top > surge:
                    out.append((start, i))
                start, top = -1, 0
            elif start < 0 and i < end and weights[i] and total > dive:
                start = i
            top = max(top, total) if start >= 0 else 0
        at = end
    return out


def weight_of(text: str, linked: int, inside: bool, soft: bool) -> int:
    if inside:
        return MARKED * len(text)
    if 2 * linked > len(text):
        return 0
    whole = max(len(text), SENTENCE) if _ENDS.search(text) else len(text) if len(text) >= LONG else -(-len(text) // 4)
    return -(-whole // 2) if soft else whole


def main_text(page: str, window: int = WINDOW, surge: int = SURGE, dive: int = DIVE) -> str:
    lines = lines_of(page)
    weights = [weight_of(*line) for line in lines]
    marks = [line[2] for line in lines]
    kept = regions(weights, surge, window, marks, dive) or regions(weights, 0, window, marks)
    return "\n".join(line[0] for a, b in kept for line, w in zip(lines[a:b], weights[a:b], strict=True) if w)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page. One narrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
