"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block. Text lengths are summed over sliding windows of lines;
the text between the points where the sums surge and dive is the main text. Links count as no
text, and lines inside elements that cannot hold main text are taken out first.

A page may say itself where its main text is, by article or main. Then only lines inside these are
looked at, and surge and dive decide about each such element as a whole, so none of its lines is lost.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._bytes import slices

#: Lines of a window, and the sum of text lengths that starts main text.
WINDOW_LINES, SURGE = 3, 80

#: Elements whose content is never shown, or never main text.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
DROPPED = frozenset("head nav header footer aside form button select menu dialog template svg canvas object audio video map".split()) | RAW
KEPT = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article blockquote body center dd details dir div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
) | DROPPED
#: Names in class and id that mark boilerplate.
MARKS = frozenset(
    "ad ads advert advertisement advertisements adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer form "
    "gdpr copyright header menu menus modal nav navbar navigation newsletter notice notices notification popup promo promoted related reply replies respond search share sharing "
    "sidebar sidebars social sponsor sponsored subscribe subscription toc toolbar widget".split()
)
#: Words that make a known compound with a mark, before it and after it, and compounds of other words.
BEFORE_MARK = frozenset("bottom global left main mobile page primary reader right secondary site sub top user".split())
AFTER_MARK = frozenset("area bar block box button buttons container icons inner links list policy section signup slot thread toggle unit wrap wrapper".split())
COMPOUNDS = frozenset(
    "article-comments article-footer entry-comments entry-footer page-footer post-comments post-footer related-articles related-content related-links related-posts related-stories".split()
)
#: Elements whose id is often made from their own text, everywhere and in an article or main.
TEXT_IDS = frozenset("h1 h2 h3 h4 h5 h6 a span dt".split())
TEXT_IDS_INSIDE = TEXT_IDS | frozenset("section dd li p".split())
MARKED_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar alert dialog form".split())

#: What may stand in a head; any other start tag ends it.
HEAD_CONTENT = frozenset("head base basefont bgsound link meta template".split()) | RAW
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Start tags that end an open p.
ENDS_P = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form header hr li main menu nav ol p pre section summary table ul".split()
).union(HEADINGS)
#: Items that the next one ends.
ITEMS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt")}
#: Parts of a table and the open ones that each ends.
CELLS = ("td", "th", "caption")
ROWS = ("tr", *CELLS)
PARTS = dict.fromkeys(("td", "th"), CELLS) | {"tr": ROWS} | dict.fromkeys(("tbody", "thead", "tfoot", "caption", "colgroup"), ("tbody", "thead", "tfoot", "colgroup", *ROWS))
#: Elements that an end tag of an element around them does not reach past.
SCOPES = ("table", "td", "th", "caption", "template")
#: Blocks between which and the text there may be further items of a list.
LOOSE = frozenset("address div form p".split())

#: A quote opens a value only after an equals sign, and one that is never closed runs to the end, so every match goes forward.
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>"']|\Z)""", re.I)


#: Styles of what is not shown.
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!\s*important\s*)?(?:;|$)")
#: The next start or end tag of a link.
LINK = re.compile(r"<(/?)a(?=[\s/>])", re.I)
TARGET = re.compile(r"(?:^|[\s\"'/])href\s*=", re.I)


@dataclass
class Line:
    text: str
    linked: int
    #: Which of the page's outermost article and main elements the line is in; 0 for none.
    region: int = 0


def names_boilerplate(name: str) -> bool:
    """Whether a whole class or id is a mark, some marks, or a known compound with marks; a modifier after -- or a number at its end tells nothing."""
    words = [w for w in re.split(r"[-_]+", (name.split("--")[0] or name).rstrip("0123456789")) if w]
    if "-".join(words) in COMPOUNDS:
        return True
    while len(words) > 1 and words[0] in BEFORE_MARK:
        words = words[1:]
    while len(words) > 1 and words[-1] in AFTER_MARK and words[-1] not in MARKS:
        words = words[:-1]
    return bool(words) and all(w in MARKS for w in words)


def is_marked(attributes: str, tag: str = "div", inside: bool = False) -> bool:
    """Whether class, id or role name boilerplate, or the element is hidden; an id that its text may have given does not count."""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" and not value:
            return True
        if name == "aria-hidden":
            if value.strip() == "true":
                return True
        elif name == "style":
            if UNSEEN.search(value):
                return True
        elif name == "role":
            if value in MARKED_ROLES:
                return True
        elif name == "id" and tag in (TEXT_IDS_INSIDE if inside else TEXT_IDS):
            continue
        elif any(map(names_boilerplate, value.split())):
            return True
    return False


class OpenElements:
    """The open elements of a page, with the end tags that HTML lets a page leave out, and those of them whose text is skipped."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.flags: list[bool] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.walls: list[int] = []
        self.skips: list[int] = []

    @property
    def skipping(self) -> bool:
        return bool(self.skips)

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of these names; -1 without one."""
        return max((self.places[t][-1] for t in tags if self.places[t]), default=-1)

    def cut(self, place: int) -> None:
        """End the element at a place and all in it."""
        while len(self.tags) > place:
            tag = self.tags.pop()
            if self.flags.pop():
                self.skips.pop()
            if tag:
                self.places[tag].pop()
            if self.walls and self.walls[-1] == len(self.tags):
                self.walls.pop()

    def take_out(self, tag: str) -> None:
        """End the innermost element of a name, but none of those in it."""
        place = self.places[tag].pop()
        self.tags[place] = ""
        if self.flags[place]:
            self.skips.remove(place)
        self.flags[place] = False

    def release(self) -> None:
        """Skip no open element any longer."""
        for place in self.skips:
            self.flags[place] = False
        self.skips.clear()

    def imply(self, tag: str) -> None:
        """End the elements that a start tag, or text for the empty name, ends."""
        head = self.last("head")
        if head >= 0 and tag not in HEAD_CONTENT and self.last("template") < head:
            self.cut(head)
        if tag in PARTS:
            table = self.last("table", "template")
            ended = [place for t in PARTS[tag] if (place := self.last(t)) > table]
            if ended:
                self.cut(min(ended))
        elif tag in ITEMS:
            if self.walls and self.tags[self.walls[-1]] in ITEMS[tag]:
                self.cut(self.walls[-1])
        elif tag in HEADINGS:
            if self.tags and self.tags[-1] in HEADINGS:
                self.cut(len(self.tags) - 1)
        elif tag == "button" and self.last("button") > self.last(*SCOPES):
            self.cut(self.last("button"))
        if tag in ENDS_P and self.last("p") > self.last("button", *SCOPES):
            self.cut(self.last("p"))

    def start(self, tag: str, skipped: bool) -> None:
        if tag == "form" and self.places["form"]:
            return  # no form is in another
        place = len(self.tags)
        self.places[tag].append(place)
        if tag in BLOCKS and tag not in LOOSE:
            self.walls.append(place)
        self.tags.append(tag)
        self.flags.append(skipped)
        if skipped:
            self.skips.append(place)

    def end(self, tag: str) -> None:
        """End the element that an end tag names, with those in it; without such an element nothing ends."""
        place = self.last(*HEADINGS) if tag in HEADINGS else self.last(tag)
        if tag == "template":
            scope = -1
        elif tag == "table":
            scope = self.last("template")
        elif tag in PARTS:
            scope = self.last("table", "template")
        else:
            scope = self.last(*SCOPES)
        if tag == "form" and place > self.last("template"):
            self.take_out(tag)
        elif place < 0 or place < scope:
            return
        elif tag in BLOCKS or place > max(self.last(*LOOSE), self.walls[-1] if self.walls else -1):
            self.cut(place)
        else:
            self.take_out(tag)


def lines_of(page: str) -> list[Line]:
    """One line per block of text, without markup and without the elements that hold no main text."""
    lines: list[Line] = []
    parts: list[str] = []
    linked = inside = region = 0
    # In a link, and whether that link is closed before the next one begins; else it ends with its block.
    in_link = closed = False
    elements = OpenElements()
    unclosed: set[str] = set()
    at, end = 0, len(page)

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            lines.append(Line(text, min(linked, len(text)), region if inside else 0))
        parts.clear()
        linked = 0

    while at < end:
        m = TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            if elements.places["head"] and elements.tags[-1] == "head" and not page[at:stop].isspace():
                elements.imply("")
            if not elements.skipping:
                parts.append(page[at:stop])
                if in_link:
                    linked += len(page[at:stop].strip())
        if not m:
            break
        at = m.end() if m.end() > m.start() else m.start() + 1
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing = bool(m[1])
        if not closing and tag in RAW:
            shut = None if tag in unclosed else re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if not shut:
                unclosed.add(tag)
            if not elements.skipping:
                close()
                at = shut.end() if shut else end
            elif shut:
                at = shut.end()
            continue
        if closing:
            elements.end(tag)
        else:
            elements.imply(tag)
            if elements.skipping and tag in KEPT and not elements.places["template"]:
                elements.release()  # an element that was never closed
        open_ended = not closing and tag not in VOID and tag not in ("html", "body") and not m[3].endswith("/")
        if elements.skipping:
            if tag == "a":
                in_link = False
            if open_ended:
                elements.start(tag, False)
            continue
        if not closing and tag not in VOID and tag not in ("html", "body") and (tag in DROPPED or (tag not in KEPT and is_marked(m[3], tag, inside > 0))):
            close() if tag in BLOCKS else None
            if open_ended:
                elements.start(tag, True)
            continue
        if open_ended:
            elements.start(tag, False)
        if tag in BLOCKS:
            close()
            in_link &= closed
            if tag in KEPT:
                region += not closing and not inside
                inside = max(0, inside + (-1 if closing else 1))
        elif tag == "a":
            in_link = not closing and bool(TARGET.search(m[3]))
            if in_link:
                following = LINK.search(page, at)
                closed = bool(following and following[1])
        elif tag == "br":
            parts.append("\n")
    close()
    return lines


def surges(lines: list[Line]) -> list[tuple[int, int]]:
    """Stretches between surge and dive of the window sums of text lengths.

    Text that is no link counts with its length. Where a window sums to SURGE, main text starts with
    the unbroken run of text lines that leads up to it; it ends where a whole window has no text.
    """
    size = [len(line.text) - line.linked for line in lines]
    n = len(lines)
    sums = [0]
    for s in size:
        sums.append(sums[-1] + s)
    window = [sums[min(n, i + WINDOW_LINES)] - sums[i] for i in range(n)]
    found: list[tuple[int, int]] = []
    i = done = 0
    while i < n:
        if size[i] and window[i] >= SURGE:
            first = stop = i
            while first and size[first - 1] and first > done:
                first -= 1
            while stop < n and window[stop]:
                stop += 1
            found.append((first, stop))
            i = done = stop
        else:
            i += 1
    return found


def main_lines(lines: list[Line]) -> list[Line]:
    """The lines between surge and dive; of a page with article or main elements, all lines of each such element in which the sums surge."""
    regions: dict[int, list[Line]] = defaultdict(list)
    for line in lines:
        if line.region:
            regions[line.region].append(line)
    inside = [line for own in regions.values() if surges(own) for line in own]
    # Elements without a surge hold a short text, unless they hold links alone.
    if inside or any(len(line.text) > 2 * line.linked for own in regions.values() for line in own):
        return inside
    return [line for first, stop in surges(lines) for line in lines[first:stop]]


def extract(page: str | None) -> str:
    """Main text of one page, blocks joined by an empty line."""
    lines = lines_of(page or "")
    found = main_lines(lines)
    if not found:
        # A page too short for any window to surge: what is no link is the text.
        lines = [line for line in lines if line.region] or lines
        found = [line for line in lines if len(line.text) > 2 * line.linked]
    return "\n\n".join(line.text for line in found)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            texts = [extract(h) for h in part.column("html").to_pylist()]
            yield pa.record_batch(
                [part.column("page_id").cast(pa.int64()), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row.

    A null or empty page has the empty text. Repeated rows, null ids and null URLs are kept as they
    come; an empty table gives an empty result; other columns are not read.
    """
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return slim.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
