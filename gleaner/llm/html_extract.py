"""Main-text extraction by line-block distribution.

The markup is stripped to lines: each block-level element begins a new line, and text that navigation, forms, adverts,
scripts or other furniture hold leaves an empty line in its place. A line's length is that of its text outside links; in
an article or main element, that of all its text. Lengths are summed over a sliding window of `WINDOW` lines; the main
text begins where the sum surges over the page's threshold and ends where it dives to zero, and all text lines between
such points are kept. A list of links between two blocks of text of one parent is no dive: its lines count with all their
text. Lines outside of the page's article and main elements count as furniture if these hold at least half of the text.

Furniture is told by an element's name or by the words of its class, id or role. Such words alone only make an element
suspect: one that holds more than half of the page's text outside links is kept (`page-wrapper widget-area`). Within an
article or main element, and for ids everywhere, all words of a name must be those of furniture (`comments`,
`share-buttons`), so that a heading or a section whose id is made of its title (`related-work`) stays. A button or label
within a paragraph, list item, cell or heading is part of its sentence. The scan goes forward only and takes time in
proportion to the page.

Defined results: null and empty html give an empty text; a page without any text line too. Malformed markup is read as
browsers do for the cases that matter here: an end tag closes the elements left open inside its element, a missing end
tag closes with its parent, an unclosed comment, tag or script runs to the end. Repeated rows are extracted alike.
Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import as_binary

WINDOW = 3
#: Share of the page's densest window that a surge must reach, and its limits in characters.
SURGE_SHARE = 0.2
SURGE_LEAST, SURGE_MOST = 1, 80

# Fixed names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
FURNITURE = frozenset(
    "nav footer aside form header menu dialog button select option label fieldset object applet audio video canvas head".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th"
    " thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements of running text, and those that are part of a sentence within them.
RUNNING = frozenset("p li td th dd dt blockquote figcaption h1 h2 h3 h4 h5 h6".split())
INLINE = frozenset("button label".split())
#: Furniture that doesn't end a sentence that it stands in.
FORM_PARTS = frozenset("select option object applet audio video canvas".split())
MAIN = frozenset("article main".split())
CLOSES_P = BLOCKS - {"html", "body"}
#: Words of class, id or role that name furniture.
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments cookie"
    " cookies consent disqus dropdown footer gdpr header masthead menu modal nav navbar navigation newsletter notice"
    " notices notification overlay pager pagination popup promo promotion promoted related recommended reply replies"
    " respond share sharing sidebar sidebars skip social sponsor sponsored subscribe subscription toolbar topbar widget"
    " complementary contentinfo search alert alertdialog".split()
)

#: Words that furniture's names may have besides.
PARTS = frozenset(
    "site page main left right top bottom sticky fixed global primary secondary inner outer wrapper container box block"
    " section area list item items unit slot bar panel links link buttons button icons group row inline body".split()
)

TAG_NAME = re.compile(r"[A-Za-z][^\s/>]*+")
#: The attributes and the end of a tag. Quotes count after an equals sign only, as in browsers.
TAG_REST = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
SPLIT_NAME = re.compile(r"[^A-Za-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


#: Layout words that a page's outermost content elements may carry without being furniture.
LAYOUT = frozenset("header masthead footer sidebar sidebars social share sharing widget search banner navbar".split())


#: Share of the page's text outside links that an element must hold to be kept in spite of its name, and that article and
#: main elements must hold to be all of the main text.
MOST = 0.5


class Line(NamedTuple):
    """text; length: outside links, or all in an article or main element; inside: of such an element; heading: in a heading;
    parent: the element that holds the line's block; suspect: the number of the innermost element around it that names make
    suspect, or 0."""

    text: str
    length: int
    inside: bool
    heading: bool
    parent: int
    suspect: int


def _named_furniture(name: str, attributes: str, inside: bool) -> bool:
    """Whether class, id or role name furniture. inside: the element stands in an article or main element."""
    if name == "main" or name in HEADINGS:
        return False
    for kind, a, b, c in NAMES.findall(attributes):
        for token in (a or b or c).split():
            words = [w for w in SPLIT_NAME.split(CAMEL.sub("-", token).lower()) if w]
            if (inside or kind.lower() == "id") and not all(w in NAMED or w in PARTS or w.isdigit() for w in words):
                continue
            for before, word in zip(["", *words], words, strict=False):
                if word in NAMED and before not in ("with", "has", "no", "without"):
                    if not (word in LAYOUT and (name == "article" or inside and word in ("header", "masthead"))):
                        return True
    return False


def lines_of(html: str) -> tuple[list[Line], list[int]]:
    """The page's lines, and for each suspect element, from 1 up, the suspect one around it. Furniture is an empty line.
    White space in a line is one space."""
    lines: list[Line] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool]] = []  # open elements; whether each is furniture, suspect
    opened: Counter[str] = Counter()  # their names
    endless: set[str] = set()  # raw elements without an end tag ahead
    blocks = [0, 0]  # numbers of open blocks
    around = [0]  # by suspect element
    suspected = [0]  # open suspect elements
    furniture, links, mains, running, headings, count = 0, 0, 0, 0, 0, 0

    def flush(empty: bool = False) -> None:
        nonlocal linked
        if parts:
            if text := " ".join(unescape("".join(parts)).split()):
                lines.append(Line(text, len(text) if mains else max(0, len(text) - linked), mains > 0, headings > 0, blocks[-2], suspected[-1]))
            parts.clear()
        linked = 0
        if empty and (not lines or lines[-1].text):
            lines.append(Line("", 0, mains > 0, False, blocks[-2], suspected[-1]))

    def shut(depth: int) -> None:
        nonlocal furniture, links, mains, running, headings
        while len(stack) > depth:
            name, own, suspect = stack[-1]
            if (name in BLOCKS or suspect) and not furniture:
                flush()
            stack.pop()
            opened[name] -= 1
            furniture -= own
            links -= name == "a"
            mains -= name in MAIN and not (own or suspect)
            running -= name in RUNNING
            headings -= name in HEADINGS
            if name in BLOCKS:
                blocks.pop()
            if suspect:
                suspected.pop()

    def close(name: str) -> None:
        """Close the innermost open element of that name, and all that is open in it."""
        if opened[name]:
            depth = len(stack) - 1
            while stack[depth][0] != name:
                depth -= 1
            shut(depth)

    at, size, said = 0, len(html), 0  # said: where the text before the next tag begins
    while at < size:
        stop = html.find("<", at)
        m = None
        if stop >= 0:
            ending = html.startswith("/", stop + 1)
            m = TAG_NAME.match(html, stop + 1 + ending)
            if m is None and not html.startswith(("!", "?", "/"), stop + 1):
                at = stop + 1  # a lone sign
                continue
        else:
            stop = size
        if stop > said and not furniture:
            parts.append(html[said:stop])
            if links:
                linked += len(" ".join(unescape(html[said:stop]).split()))
        if stop == size:
            said = size
            break
        if m is None:
            comment = html.startswith("<!--", stop)
            end = html.find("-->" if comment else ">", stop + 2)
            at = said = size if end < 0 else end + (3 if comment else 1)
            continue
        rest = TAG_REST.match(html, m.end())
        at = said = rest.end() if rest else size
        if rest is None:
            break
        name, attributes = m[0].lower(), rest[1]
        if ending:
            close(name)
            continue
        if name in RAW:
            end = None if name in endless else re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(html, at)
            if end:
                at = end.end()
            else:
                endless.add(name)
                at = size if name in ("script", "style") else at
            said = at
            continue
        if name in ("br", "hr", "wbr") and not furniture:
            if name == "br":
                parts.append(" ")
            elif name == "hr":
                flush()
        if name in VOID or attributes.endswith("/"):
            continue
        if name == "body" and opened["head"]:  # the head ends here at the latest
            shut(next(depth for depth, element in enumerate(stack) if element[0] == "head"))
        if name in CLOSES_P:
            close("p")
        hidden = bool(attributes) and HIDDEN.search(attributes) is not None
        suspect = bool(attributes) and not attributes.isspace() and name not in ("html", "body") and _named_furniture(name, attributes, mains > 0)
        # An article's header holds its headline, and a button may be a word of a sentence.
        own = hidden and name not in ("html", "body") or name in FURNITURE and not (name == "header" and mains) and not (name in INLINE and running)
        if not furniture and (own and not (running and name in FORM_PARTS) or suspect or name in BLOCKS):
            flush(own)
        suspect = suspect and not own and not furniture
        count += 1
        if suspect:
            around.append(suspected[-1])
            suspected.append(len(around) - 1)
        stack.append((name, own, suspect))
        opened[name] += 1
        furniture += own
        links += name == "a"
        mains += name in MAIN and not (own or suspect)
        running += name in RUNNING
        headings += name in HEADINGS
        if name in BLOCKS:
            blocks.append(count)
    if said < size and not furniture:  # after a lone sign
        parts.append(html[said:])
    flush()
    return lines, around


def _innocent(lines: list[Line], around: list[int]) -> list[Line]:
    """Lines of suspect elements that hold most of the page's text, and all of its article and main elements, stay; those
    of others are empty."""
    held, inside = [0] * len(around), [0] * len(around)  # 0: the page
    for line in lines:
        held[line.suspect] += line.length
        inside[line.suspect] += line.length * line.inside
    for suspect in range(len(around) - 1, 0, -1):  # inner ones first
        held[around[suspect]] += held[suspect]
        inside[around[suspect]] += inside[suspect]
    kept = [True] * len(around)
    for suspect in range(1, len(around)):
        kept[suspect] = kept[around[suspect]] and held[suspect] > MOST * held[0] and inside[suspect] == inside[0]
    out: list[Line] = []
    for line in lines:
        if not kept[line.suspect]:
            line = line._replace(text="", length=0)
        if line.text or not out or out[-1].text:
            out.append(line)
    return out


def main_lines(lines: list[Line], around: list[int], window: int = WINDOW) -> list[str]:
    """The text lines between surge and dive points."""
    lines = _innocent(lines, around)
    inside = sum(line.length for line in lines if line.inside)
    marked = inside > 0 and inside >= MOST * sum(line.length for line in lines)
    lengths = [line.length if line.inside or not marked else 0 for line in lines]
    last = None  # the last line with text outside links since the last empty line
    for i, line in enumerate(lines):
        if not line.text:
            last = None
        elif lengths[i]:
            if last is not None and lines[last].parent == line.parent:
                lengths[last + 1 : i] = [len(between.text) for between in lines[last + 1 : i]]
            last = i
    if not any(lengths):
        return []
    sums = [sum(lengths[i : i + window]) for i in range(len(lengths))]
    surge = min(SURGE_MOST, max(SURGE_LEAST, SURGE_SHARE * max(sums)))
    kept, start = [], None
    for i, total in enumerate([*sums, 0]):
        if total and start is None:
            start = i
        elif not total and start is not None:
            if max(sums[start:i]) >= surge:
                while not lengths[start] and not (lines[start].text and lines[start].heading):
                    start += 1  # links before the text
                kept += [line.text for line in lines[start:i] if line.text and (line.inside or not marked)]
            start = None
    return kept


def main_text(html: str | None) -> str:
    return "\n\n".join(main_lines(*lines_of(html))) if html else ""


def _main_texts(html: pa.Array) -> pa.Array:
    return pa.array([main_text(raw.decode("utf-8", "replace") if raw else None) for raw in as_binary(html)], pa.string())


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    texts = pages.select("page_id", "url", arrow_udf(_main_texts, "string").asNondeterministic()(F.col("html")).alias("text"))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))
