"""Filings as HTML: text blocks in document order, sections under headings, and what is rejected."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.documents import is_heading

# Roles of elements, and limits of one filing.
REMOVED = frozenset({"script", "style", "noscript", "svg"})
HEADS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
BLOCKS = HEADS | {"p", "li", "tr", "div"}
INNER = HEADS | {"div", "p", "table", "ul", "ol"}
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
MAX_BYTES, MAX_SECTIONS, MAX_HEADING = 25 * 1024 * 1024, 250, 200


class _Element:
    __slots__ = ("name", "parent", "first", "last", "in_table", "removed", "holds_block")

    def __init__(self, name: str, parent: _Element | None, first: int) -> None:
        self.name, self.parent, self.first, self.last = name, parent, first, None
        self.in_table = parent is not None and (parent.in_table or parent.name == "table")
        self.removed = name in REMOVED or (parent is not None and parent.removed)
        self.holds_block = False


class _Reader(HTMLParser):
    """Elements in document order, each with the range of the text pieces inside it."""

    def __init__(self) -> None:
        super().__init__()
        self.elements: list[_Element] = []
        self.open: list[_Element] = []
        self.pieces: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        element = _Element(tag, self.open[-1] if self.open else None, len(self.pieces))
        self.elements.append(element)
        above = element.parent if tag in INNER and not element.removed else None
        while above is not None and not above.holds_block:
            above.holds_block = True
            above = above.parent
        if tag in VOID:
            element.last = len(self.pieces)
        else:
            self.open.append(element)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not any(x.name == tag for x in self.open):
            return
        while True:
            closed = self.open.pop()
            closed.last = len(self.pieces)
            if closed.name == tag:
                return

    def handle_data(self, data: str) -> None:
        text = data.strip()
        if text and not (self.open and self.open[-1].removed):
            self.pieces.append(text)

    def text(self, element: _Element) -> str:
        last = len(self.pieces) if element.last is None else element.last
        return " ".join(" ".join(self.pieces[element.first : last]).split())


def blocks_of(html: str) -> tuple[list[dict], str]:
    """Typed text blocks of a page in document order (a table's rows with their cells apart), and all of its text."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    rows: dict[_Element | None, list[str]] = {}
    for x in reader.elements:
        if x.name in ("td", "th") and not x.removed and x.parent is not None and x.parent.name == "tr":
            rows.setdefault(x.parent, []).append(reader.text(x))
    kinds = (x for x in reader.elements if x.name in BLOCKS and not x.removed)
    shown = (x for x in kinds if not (x.in_table and x.name in ("p", "li", "div")) and not (x.name == "div" and x.holds_block))
    texts = ((x.name, " | ".join(filter(None, rows.get(x, []))) if x.name == "tr" else reader.text(x)) for x in shown)
    return [{"name": name, "text": text} for name, text in texts if text], " ".join(" ".join(reader.pieces).split())


def read_blocks(df: DataFrame, *, key: str, html: str) -> DataFrame:
    """``key, size, blocks array<struct<name, text>>, whole``: one row for each page; a block equal to the one before it is left out.

    Pages that are null, empty or over the limit of bytes have no blocks. A narrow pass; repeated rows stay.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [blocks_of(page) if isinstance(page, str) and 0 < size <= MAX_BYTES else ([], "") for page, size in zip(pdf["html"], pdf["size"], strict=True)]
            yield pd.DataFrame({key: pdf[key], "size": pdf["size"], "blocks": [x[0] for x in found], "whole": [x[1] for x in found]})

    lean = df.select(key, F.col(html).alias("html"), F.coalesce(F.octet_length(html), F.lit(0)).alias("size"))
    kind = df.schema[key].dataType.simpleString()
    made = lean.mapInPandas(read, f"`{key}` {kind}, size int, blocks array<struct<name: string, text: string>>, whole string")
    fresh = F.filter("blocks", lambda x, i: (i == 0) | (x["text"] != F.get("blocks", i - 1)["text"]))
    return made.withColumn("blocks", fresh)


def read_filings(df: DataFrame, *, key: str, html: str) -> DataFrame:
    """``key, status, sections array<struct<section_name, content>>``: one row for each filing.

    A heading is a heading element or a block of a heading's form; what stands under one, blank lines apart, is its section,
    and a page without blocks is one section of all its text. ``status`` is ``ok``, ``empty`` (null or no bytes), ``oversized``,
    ``no_text`` or ``too_many_sections``; all but ``ok`` have no sections. Each page is read by itself in a narrow pass.
    """
    pages = read_blocks(df, key=key, html=html)
    heads = lambda x: (F.char_length(x["text"]) <= MAX_HEADING) & (x["name"].isin(*sorted(HEADS)) | is_heading(x["text"]))
    places = F.filter(F.transform("blocks", lambda x, i: F.when(heads(x), i)), lambda i: i.isNotNull())
    pages = pages.withColumn("cuts", F.concat(F.array(F.lit(-1)), places, F.array(F.size("blocks"))))

    def section(at, k):
        text = F.array_join(F.transform(F.slice("blocks", at + 2, F.get("cuts", k + 1) - at - 1), lambda x: x["text"]), "\n\n")
        name = F.when(at < 0, F.lit("Document")).otherwise(F.get("blocks", at)["text"])
        return F.struct(name.alias("section_name"), text.alias("content"))

    made = F.filter(F.transform(F.slice("cuts", 1, F.size("cuts") - 1), section), lambda x: x["content"] != "")
    alone = F.when(F.col("whole") != "", F.array(F.struct(F.lit("Document").alias("section_name"), F.col("whole").alias("content")))).otherwise(F.slice(made, 1, 0))
    pages = pages.withColumn("found", F.when(F.size("blocks") == 0, alone).otherwise(made))
    state = (
        F.when(F.col("size") == 0, "empty").when(F.col("size") > MAX_BYTES, "oversized").when(F.size("found") == 0, "no_text")
        .when(F.size("found") > MAX_SECTIONS, "too_many_sections").otherwise("ok")
    )
    return pages.select(key, state.alias("status"), F.when(state == "ok", F.col("found")).otherwise(F.slice("found", 1, 0)).alias("sections"))


def filing_sections(df: DataFrame, *, key: str, html: str) -> DataFrame:
    """``key, sequence_number, section_name, content, char_count`` of the filings that can be read."""
    rows = read_filings(df, key=key, html=html).select(key, F.posexplode("sections").alias("sequence_number", "s"))
    return rows.select(key, "sequence_number", "s.section_name", "s.content", F.char_length("s.content").alias("char_count"))
