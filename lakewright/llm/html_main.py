"""Main text of web pages by two passes of block rules.

A page is cut into blocks of text at block-level tags. The first pass decides blocks by link density,
length and stop-word density, and by where they stand: what is in a menu, header, footer, sidebar, form,
notice, advert or comment area is never main text. Short blocks stay open. The second pass gives an open
block the label of the nearest decided block of its own section (the innermost article, main or body);
of two equally near ones the earlier decides, and a section without a decided block is main text only if
it is an article or main element. In those a list of links decides for itself only, not for its neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINK_DENSITY = 0.5
LONG_WORDS = 12
STOP_DENSITY = 0.1

# HTML element names by role.
SKIPPED = frozenset("script style noscript template title iframe object svg math canvas audio video".split())
BOILER = frozenset("nav header footer aside form menu button select textarea dialog fieldset".split())
ARTICLE = frozenset("article main".split())
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section select summary table tbody "
    "td textarea tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that it for on with as was be by at from are this an or have not but which you he she "
    "le la les de des du un une et en est que qui dans pour par sur au aux avec pas ce il elle ne se plus "
    "der die das und ist in den dem zu von mit ein eine auf als für nicht auch sich es des im dass wie werden "
    "el los las y del al por con para su se lo como más o pero sus no".split()
)
# Words of class, id and role attributes that mark what is not main text.
HINTS = frozenset(
    "ad ads advert advertisement adsense banner sponsor sponsored promo comment comments disqus discussion reply "
    "replies respond sidebar nav navbar navigation menu breadcrumb breadcrumbs footer header masthead cookie cookies "
    "consent gdpr notice notices popup modal newsletter subscribe signup login share sharing social related "
    "recommended widget pagination pager toolbar search complementary contentinfo".split()
)
# Attribute words of the main text's own container, which outweigh a hint.
KEEPS = frozenset("article content main post entry story body".split())
_WORD = re.compile(r"[^\W\d_]+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block(NamedTuple):
    text: str
    section: int  # number of the innermost article, main or body
    article: bool
    boiler: bool
    linked: int  # characters inside links


class _Open(NamedTuple):
    tag: str
    boiler: bool
    section: int
    article: bool


class _Cutter(HTMLParser):
    """Cuts a page into blocks; references are decoded, markup and skipped elements are dropped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0
        self.links = 0
        self.skip: str | None = None
        self.depth = 0
        self.sections = 0
        self.stack = [_Open("", False, 0, False)]

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.stack[-1]
            self.blocks.append(Block(text, top.section, top.article, top.boiler, self.linked))
        self.parts.clear()
        self.linked = 0

    def handle_starttag(self, tag, attrs):
        if self.skip:
            self.depth += tag == self.skip
            return
        if tag in SKIPPED:
            self.skip, self.depth = tag, 1
            return
        if tag == "br":
            self.parts.append(" ")
        if tag == "a":
            self.links += 1
        if tag in BLOCK:
            self.flush()
            if tag == "p":  # a paragraph ends the one before
                self._close("p")
        top = self.stack[-1]
        boiler = top.boiler or tag in BOILER or _hinted(tag, attrs)
        if tag in BLOCK and tag not in VOID:
            article = tag in ARTICLE
            self.sections += article
            section = self.sections if article else top.section
            # An article's own header holds its title.
            boiler = boiler and not (tag == "header" and top.article and not top.boiler)
            self.stack.append(_Open(tag, boiler, section, top.article or article))

    def handle_startendtag(self, tag, attrs):
        if not self.skip and tag in BLOCK:
            self.flush()
        elif not self.skip and tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip:
                self.depth -= 1
                if self.depth <= 0:
                    self.skip = None
            return
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in BLOCK:
            self.flush()
            self._close(tag)

    def _close(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return
            if tag == "p" and self.stack[i].tag != "p":
                return

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def _hinted(tag: str, attrs) -> bool:
    for name, value in attrs:
        if value and name in ("class", "id", "role"):
            words = {w.lower() for w in _NAME.findall(value)}
            if words & HINTS and not (words & KEEPS and tag not in ("p", "span", "li")):
                return True
            if name == "role" and value.lower() in ("navigation", "banner", "search", "form", "alert"):
                return True
    return False


def _decided(block: Block) -> bool | None:
    """First pass: main text, not main text, or open."""
    if block.boiler:
        return False
    if block.linked > LINK_DENSITY * len(block.text):
        return False
    words = [w.lower() for w in _WORD.findall(block.text)]
    if len(words) >= LONG_WORDS:
        if sum(w in STOP_WORDS for w in words) >= STOP_DENSITY * len(words):
            return True
    return None


def main_text(html: str) -> str:
    """The main text of a page: kept blocks in page order, joined by a space."""
    cutter = _Cutter()
    cutter.feed(html)
    cutter.close()
    cutter.flush()
    blocks = cutter.blocks
    first = [_decided(b) for b in blocks]
    last: dict[int, tuple[int, bool]] = {}
    before: list[tuple[int, bool] | None] = []
    for i, (block, label) in enumerate(zip(blocks, first)):
        before.append(last.get(block.section))
        if label is not None and not block.boiler and (label or not block.article):
            last[block.section] = (i, label)
    after: dict[int, tuple[int, bool]] = {}
    kept = []
    for i in range(len(blocks) - 1, -1, -1):
        block, label = blocks[i], first[i]
        if label is None:
            left, right = before[i], after.get(block.section)
            if left and (not right or i - left[0] <= right[0] - i):
                label = left[1]
            elif right:
                label = right[1]
            else:
                label = block.article
            kept.append(block.text if label else "")
        else:
            kept.append(block.text if label else "")
            if not block.boiler and (label or not block.article):
                after[block.section] = (i, label)
    return " ".join(t for t in reversed(kept) if t)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            texts = [main_text(h or "") for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("page_id"),
                    part.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array(list(map(len, texts)), pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row, from the whole html.

    A null or empty html, and a page without main text, give an empty text. Rows come back as often as
    they are given; ids and urls may be null. Broken markup is read as far as it goes.
    """
    rows = pages.select("page_id", F.col("url"), "html")
    types = {n: t for n, t in rows.dtypes}
    return rows.mapInArrow(_extract, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
