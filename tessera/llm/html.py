"""Operator 3, HTML extraction by the distribution of text over line blocks.

A page becomes lines, one for each block of its markup (paragraph, heading, list item, table cell, ...), in page
order; what is not shown (scripts, styles, controls, hidden elements) makes none. A line weighs its characters outside links,
times a factor for where it stands: ``WEIGHTS`` for an article, the main part or elsewhere, ``OTHER_WEIGHT`` in what is told
to be a menu, header, footer, sidebar, notice, advert or comment section by its element, or by a class or id that is
nothing but such words. Markup only weighs; the distribution decides which lines stay, on every page.

Weights are summed over sliding windows of lines, within what stands in one place (an article, a menu, the rest). Text
surges where a window reaches ``SURGE`` of the page's fullest one, and dives where a window has nothing: a list of links
that no article holds. What lies between dives and surges somewhere is kept. Of the articles that a page marks the fullest
one surges whatever its length, and it counts as a paragraph (``PARAGRAPH``) at least; so a page's article outweighs other
text up to some times its length. Of an article that surges all lines stay, however short, references and other lists of
links among them. Where no article is marked, a run is cut back to its heavy lines and then extended over adjoining
headings and short paragraphs beside them.

Edge cases: a null or empty page gives an empty text; markup is read as browsers do: a tag or quote that the page ends
in takes the rest with it, elements end with what holds them; repeated rows are each extracted; an empty table gives
an empty result; columns other than page_id, url and html are not carried. A page is handled whole within a task, never
a prefix, in time linear in its length.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame

#: Lines on each side of the one that a window is centred on; share of the page's fullest window at which text surges.
REACH, SURGE = 2, 0.2
#: What a character counts in an article, in the main part of the page, elsewhere, and elsewhere on a page that marks either; in
#: a menu, advert, comment section and the like; and in a form, times that.
WEIGHTS, BESIDE_ARTICLE, OTHER_WEIGHT, FORM_WEIGHT = {"article": 4.0, "main": 3.0, None: 1.0}, 0.25, 0.02, 0.02
#: Characters that a page's fullest article counts as at least.
PARAGRAPH = 300
#: Lines between an article and the heading before it at most, such as who wrote it.
BYLINES = 2

# Elements by their use in HTML.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = HEADINGS | set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td template tfoot th thead tr ul".split()
)
TEXTUAL = {"p", "blockquote", "pre", "figcaption", "caption", "dd", "dt", "li", "td", "th", "address"}
IN_LISTS = {"li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "ul", "ol", "dl", "table"}
IN_HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
UNSHOWN = {"head", "noscript", "template", "svg", "canvas", "audio", "video", "select", "button", "datalist"}
OTHER = {"nav", "aside", "footer", "menu", "dialog", "search"}
ARTICLE = {"article", "main"}
UNMARKED = {"html", "body", "main"} | HEADINGS
#: An element that starts ends those open ones (left) that no other (right) holds.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "a": ({"a"}, {"td", "th", "caption", "object"}),
}
SCOPE = {"button", "caption", "object", "table", "td", "th", "template"}
#: Words that mark what isn't the article, wherever they stand; those that do so outside of an article only; words
#: that may stand beside either in a class or id; and beside the former only.
OTHER_WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promoted promotion promotions sidebar sidebars "
    "menu menus nav navbar navigation breadcrumb breadcrumbs footer colophon cookie cookies consent gdpr notice notices popup newsletter subscribe subscription signup login "
    "comment comments commentlist replies reply respond disqus share sharing related recommended recommendations pagination pager".split()
)
OUTER_WORDS = set("banner header masthead topbar alert modal overlay discussion social widget widgets toolbar search form".split())
BESIDE = set(
    "site page main top bottom left right center side head upper lower global primary secondary mobile desktop sticky fixed floating list lists box boxes section block blocks container wrapper wrap inner outer "
    "bar bars area item items link links button buttons icon icons unit units slot slots zone row column col panel card cards group holder body content text title author meta count counter date thread tree "
    "posts articles stories news pages products media message messages warning info us you may like more also this by to and your email the in up id js".split()
)
BESIDE_MARKED = {"post", "article", "entry", "blog", "story", "user", "reader", "readers"}
OTHER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form"}

TAG = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?)*+)(>|\Z)""",
    re.DOTALL,
)
MAY_MARK = re.compile("class|id|role", re.IGNORECASE)
MAY_HIDE = re.compile("hidden|style", re.IGNORECASE)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@dataclass
class Line:
    text: str
    weight: int  # characters outside links
    tag: str = ""  # the block that it stands in
    parent: int = 0  # number of the element that holds that block, or the list or table that does
    article: int = 0  # number of the article or main part that holds it; 0: none
    within: str | None = None  # that element
    form: bool = False
    other: int = 0  # number of the outermost menu, advert or the like that holds it; 0: none
    place: int = 0


def names_other(name: str, in_article: bool) -> bool:
    """Whether a class or id says nothing but that it is a menu, header, advert, ...: ``related-posts``, not ``related-work``."""
    words = {w.lower() for w in NAME_WORD.findall(name)}
    if words & OTHER_WORDS and words <= OTHER_WORDS | OUTER_WORDS | BESIDE | BESIDE_MARKED:
        return True
    return not in_article and bool(words & OUTER_WORDS) and words <= OUTER_WORDS | BESIDE


def unshown(tag: str, attributes: str) -> bool:
    """Whether an element is not shown, by itself or by an attribute of that very name."""
    if tag in UNSHOWN:
        return True
    if tag in UNMARKED or not MAY_HIDE.search(attributes):
        return False
    found = [("".join(values), name.lower()) for name, *values in ATTRIBUTE.findall(attributes)]
    return any(name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and bool(UNSEEN.search(value))) for value, name in found)


def marked_other(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is told to be a menu, header, footer, sidebar, notice, advert or comment section.

    Only attributes of these very names count, not others' names or values (``data-id``, ``title="Hidden lakes"``).
    Within an article a header is its own: it holds the title; so is a section called discussion, but not a div of that class.
    """
    if tag in OTHER or (tag == "header" and not in_article):
        return True
    if tag in UNMARKED or not MAY_MARK.search(attributes):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name in ("class", "id"):
            outer = in_article and not (name == "class" and tag == "div" and value.lower() == "discussion")
            if any(names_other(x, outer) for x in value.split()):
                return True
        elif name == "role" and set(value.lower().split()) & OTHER_ROLES:
            return True
    return False


@dataclass(eq=False)
class _Open:
    """An open element: what it adds to the state while it is open."""

    tag: str
    number: int
    unshown: bool = False
    other: bool = False
    link: bool = False
    article: bool = False


@dataclass
class _Reader:
    """The state of a page that is read from start to end."""

    lines: list[Line] = field(default_factory=list)
    stack: list[_Open | None] = field(default_factory=list)  # None: ended before what it holds
    places: dict[str, list[int]] = field(default_factory=lambda: defaultdict(list))  # of each tag's open elements in the stack
    blocks: list[_Open] = field(default_factory=list)
    articles: list[_Open] = field(default_factory=list)
    unshown: int = 0
    other: _Open | None = None  # the outermost menu, advert or the like that is open
    outside: tuple = ()  # the text of the line that it stands in
    links: int = 0
    number: int = 0
    text: list[str] = field(default_factory=list)
    weight: int = 0
    at: tuple = ()  # what the block's first text stands in

    def add(self, text: str) -> None:
        if self.unshown or not text:
            return
        text = unescape(text) if "&" in text else text
        if not self.at and not text.isspace():
            article = self.articles[-1] if self.articles else None
            block, holder = self.blocks[-1] if self.blocks else None, 0
            for up in reversed(self.blocks[-9:-1]):
                holder = up.number
                if up.tag not in IN_LISTS or block.tag not in IN_LISTS:
                    break
            self.at = (block.tag if block else "", holder, article.number if article else 0, article.tag if article else None, bool(self.places["form"]) and self.form_holds(), self.other.number if self.other else 0)
        self.text.append(text)
        if not self.links:
            self.weight += len(text.strip())

    def form_holds(self) -> bool:
        """Whether the innermost form is within the innermost article, if there is one."""
        inner = [self.places[tag][-1] for tag in ARTICLE if self.places[tag]]
        return self.places["form"][-1] > max(inner, default=-1)

    def end_block(self) -> None:
        if self.unshown:
            return
        whole = " ".join("".join(self.text).split())
        if whole:  # a title may be a link to its own page
            self.lines.append(Line(whole, max(self.weight, int(self.at[0] in ("h1", "h2"))), *self.at, len(self.lines)))
        self.text, self.weight, self.at = [], 0, ()

    def last(self, tags: set[str]) -> int:
        """The place of the innermost open element of some tags; -1: none."""
        return max((self.places[tag][-1] for tag in tags if self.places.get(tag)), default=-1)

    def end(self, place: int) -> None:
        """Ends the element at a place of the stack."""
        x = self.stack[place]
        self.stack[place] = None
        of = self.places[x.tag]
        if of[-1] == place:
            of.pop()
        else:
            of.remove(place)
        self.unshown -= x.unshown
        if x is self.other:
            self.end_other()
        self.links -= x.link
        for held in (self.articles if x.article else None, self.blocks if x.tag in BLOCKS else None):
            if held:
                held.pop() if held[-1] is x else held.remove(x)
        while self.stack and self.stack[-1] is None:
            self.stack.pop()

    def end_other(self) -> None:
        """Ends the line within a menu, advert or the like, and goes on with the one that it stands in."""
        hidden, self.unshown = self.unshown, 0
        self.end_block()
        self.unshown, self.other = hidden, None
        self.text, self.weight, self.at = self.outside

    def end_from(self, place: int) -> None:
        """Ends an element with all that it holds."""
        block = False
        while len(self.stack) > place:
            x = self.stack[-1]
            if x.tag in BLOCKS and not block:
                block = True
                self.end_block()
            self.end(len(self.stack) - 1)
        if block:
            self.end_block()

    def start_tag(self, tag: str, attributes: str) -> None:
        block = tag in BLOCKS
        if self.places["head"] and tag not in IN_HEAD:
            self.end_from(self.places["head"][-1])
        if tag in ENDS:
            ended, held = ENDS[tag]
            if (place := self.last(ended)) > self.last(held):
                self.end_from(place)
        if block and tag != "option" and (place := self.last({"p"})) > self.last(SCOPE):
            self.end_from(place)
        if block:
            self.end_block()
        elif tag == "br":
            self.add(" ")
        if tag in VOID or attributes.endswith("/") and (tag == "svg" or self.places["svg"]):
            return
        self.number += 1
        inside = bool(self.articles)
        x = _Open(tag, self.number, unshown=unshown(tag, attributes), other=marked_other(tag, attributes, inside))
        x.link = tag == "a" and "href" in attributes.lower()
        x.article = tag in ARTICLE and not x.other and not x.unshown and not self.other and not self.unshown and (tag == "article" or not inside)
        self.unshown += x.unshown
        if x.other and not self.other:
            self.other, self.outside = x, (self.text, self.weight, self.at)
            self.text, self.weight, self.at = [], 0, ()
        self.links += x.link
        if x.article:
            self.articles.append(x)
        if block:
            self.blocks.append(x)
        self.places[tag].append(len(self.stack))
        self.stack.append(x)

    def end_tag(self, tag: str) -> None:
        if not self.places[tag]:
            if tag in BLOCKS:
                self.end_block()
            return
        place = self.places[tag][-1]
        if tag in BLOCKS or not self.blocks or self.last({self.blocks[-1].tag}) < place:
            self.end_from(place)
        else:  # an inline element that ends before the blocks within it
            self.end(place)


def lines_of(page: str) -> list[Line]:
    """The page's blocks with text, in order."""
    reader, at = _Reader(), 0
    while m := TAG.search(page, at):
        reader.add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if not m[4]:  # the page ends within the tag
            break
        if m[1]:
            reader.end_tag(tag)
        elif tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = close.end() if close else len(page)
        else:
            reader.start_tag(tag, m[3])
    else:
        reader.add(page[at:])
    reader.end_from(0)
    reader.end_block()
    return reader.lines


def _runs(lines: list[Line], sums: list[float], least: float) -> Iterator[tuple[int, int]]:
    """(start, end) of what lies between dives and surges, without the links beside a dive."""
    i, n = 0, len(lines)
    while i < n:
        if not sums[i]:
            i += 1
            continue
        start = i
        while i < n and sums[i]:
            i += 1
        end = i
        if max(sums[start:end]) >= least:
            while start and not lines[start].weight:
                start += 1
            while end < n and not lines[end - 1].weight:
                end -= 1
            yield start, end


def _extended(lines: list[Line], start: int, end: int, heavy: float) -> tuple[int, int]:
    """A run of a page that marks no article: from its heavy lines over what adjoins and stands beside them."""
    core = [i for i in range(start, end) if lines[i].weight >= heavy]
    beside, tags = {lines[i].parent for i in core}, {lines[i].tag for i in core} | TEXTUAL
    a, b = core[0], core[-1] + 1
    while b < end and lines[b].tag not in HEADINGS and lines[b].tag in tags and lines[b].parent in beside:
        b += 1
    while a > start and lines[a].tag != "h1":
        x = lines[a - 1]
        if x.tag not in HEADINGS and (x.tag in IN_LISTS or x.tag not in tags or x.parent not in beside):
            break
        a -= 1
    return a, b


def _parts(lines: list[Line]) -> list[list[Line]]:
    """What stands in one place: each article or stretch beside it, without the menus and adverts in it; and each of these."""
    own, others = [x for x in lines if not x.other], [x for x in lines if x.other]
    return [list(part) for _, part in groupby(own, lambda x: (x.article, x.form))] + [list(part) for _, part in groupby(others, lambda x: x.other)]


def _factor(x: Line, marks: bool) -> float:
    within = BESIDE_ARTICLE if marks and not x.article else WEIGHTS[x.within]
    return OTHER_WEIGHT if x.other else within * (FORM_WEIGHT if x.form else 1)


def main_lines(lines: list[Line], reach: int = REACH, surge: float = SURGE) -> list[Line]:
    """The lines between the surge and dive points of the text's distribution, in page order."""
    parts, all_sums = _parts(lines), []
    whole = [bool(part[0].article) and not part[0].form and not part[0].other for part in parts]
    for part in parts:
        factor = _factor(part[0], any(whole))
        upto = [0.0, *accumulate(x.weight * factor for x in part)]
        all_sums.append([upto[min(i + reach + 1, len(part))] - upto[max(i - reach, 0)] for i in range(len(part))])
    fullest = {k: max(sums) for k, sums in enumerate(all_sums)}
    articles = {k: fullest[k] for k, is_article in enumerate(whole) if is_article}
    first = max(articles, key=articles.get, default=None)
    floor = PARAGRAPH * WEIGHTS[parts[first][0].within] if first is not None else 0
    least = max(max(fullest.values(), default=0), floor) * surge
    surged = {parts[k][0].article for k, most in articles.items() if most >= least or k == first}
    least, kept = max(least, 1e-9), []
    for k, (part, sums) in enumerate(zip(parts, all_sums, strict=True)):
        if whole[k] and part[0].article in surged:
            kept += part
            if k and not any(x.tag in ("h1", "h2") for x in part):  # its title stands before it
                kept += _title_before(parts[k - 1], {x.place for x in kept})
        elif not whole[k]:
            for start, end in _runs(part, sums, least):
                heavy = min(least / _factor(part[0], any(whole)) / (2 * reach + 1), max(x.weight for x in part[start:end]))
                start, end = _extended(part, start, end, heavy)
                kept += part[start:end]
    return sorted(kept, key=lambda x: x.place)


def _title_before(before: list[Line], kept: set[int]) -> list[Line]:
    """The heading at the end of what stands before an article, with the bylines after it; none if it is kept already."""
    for i in range(len(before) - 1, max(-1, len(before) - 2 - BYLINES), -1):
        if before[i].tag in ("h1", "h2") and not before[i].form:
            return [] if before[i].place in kept else before[i:]
    return []


def main_text(page: str | None) -> str:
    return "\n".join(x.text for x in main_lines(lines_of(page or "")))


def extract_html(pages: DataFrame, page_chars: int = 8 << 20) -> DataFrame:
    """page_id, url, text, n_chars (code points of the text) for every row of ``pages``."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, start, size = [], 0, 0
            for i, page in enumerate(batch.column("html")):
                texts.append(main_text(page.as_py()))
                size += len(texts[-1])
                if size >= page_chars or i + 1 == batch.num_rows:
                    part = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)
                    texts, start, size = [], i + 1, 0

    rows = pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html")
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
