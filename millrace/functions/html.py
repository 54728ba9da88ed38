"""Text of web pages by blocks: a tag stack cuts a page into blocks, neighbours tell which of them are boilerplate."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that end a block of text, that hold no text for readers, and that have no end tag.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option "
    "p pre section select summary table tbody td tfoot th thead tr ul".split()
)
SILENT = frozenset("applet audio canvas head iframe math noscript object script style svg template textarea title video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = "array<struct<tag string, depth int, words int, linked int, text string>>"


class _Page(HTMLParser):
    """Blocks of a page: tag and depth of the nearest block element, words, words within links, and the text with its white space joined.

    An end tag closes what is open above its own start tag; one without a start tag closes nothing. Open elements end with the page.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.silent = self.links = 0
        self.parts: list[tuple[str, bool]] = []
        self.blocks: list[dict] = []

    def _end_block(self) -> None:
        text = re.sub(r"\s+", " ", "".join(p for p, _ in self.parts)).strip()
        if text:
            around = [t for t in self.stack if t in BLOCKS]
            linked = "".join(p if link else " " for p, link in self.parts)
            self.blocks.append({"tag": around[-1] if around else "", "depth": len(self.stack), "words": len(text.split()), "linked": min(len(linked.split()), len(text.split())), "text": text})
        self.parts = []

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in BLOCKS:
            self._end_block()
        if tag in VOID:
            return
        self.stack.append(tag)
        self.silent += tag in SILENT
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag in BLOCKS:
            self._end_block()

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.stack:
            return
        if any(t in BLOCKS for t in self.stack[len(self.stack) - 1 - self.stack[::-1].index(tag) :]):
            self._end_block()
        while True:
            top = self.stack.pop()
            self.silent -= top in SILENT
            self.links -= top == "a"
            if top == tag:
                return

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append((data, self.links > 0))

    def close(self) -> None:
        super().close()
        self._end_block()


def page_blocks(html: str | None) -> list[dict]:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page.blocks


def blocks(html: Column) -> Column:
    """The blocks of a page in order; none for null. Scripts, styles, comments and what else readers do not see are left out, entities are resolved."""

    @F.pandas_udf(BLOCK)
    def of(pages: pd.Series) -> pd.Series:
        return pages.map(page_blocks)

    return of(F.coalesce(html, F.lit("")))


def is_content(found: Column) -> Column:
    """For each block, whether it is content: by its own words and link density and those of the blocks before and after it.

    The decision tree of Kohlschütter, Fankhauser and Nejdl (Boilerplate Detection using Shallow Text Features, 2010); beyond the
    ends of a page, a block has no words and no links.
    """
    def density(b: Column) -> Column:
        return F.coalesce(b["linked"] / b["words"], F.lit(0.0))

    def words(b: Column) -> Column:
        return F.coalesce(b["words"], F.lit(0))

    def judged(b: Column, i: Column) -> Column:
        before, after = F.get(found, i - 1), F.get(found, i + 1)
        few = F.when(words(b) > 16, True).when(words(after) > 15, True).otherwise(words(before) > 4)
        linked = (words(b) > 40) | (words(after) > 17)
        return F.when(density(b) > 1 / 3, False).when(density(before) <= 5 / 9, few).otherwise(linked)

    return F.transform(found, judged)


def content(found: Column) -> Column:
    """The text of a page's content blocks, a line each."""
    both = F.arrays_zip(found.alias("b"), is_content(found).alias("c"))
    return F.array_join(F.transform(F.filter(both, lambda x: x["c"]), lambda x: x["b"]["text"]), "\n")
