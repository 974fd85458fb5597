"""Block structure of HTML pages: headings, paragraphs, lists, tables, titles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

HEADINGS = {f"h{i}": i for i in range(1, 7)}
SCHEMA = "page_id long, sequence long, block_type string, heading_level string, text string, rows array<array<string>>, warnings array<string>, page_number int, block_id string, parent_section string, title string, simplified boolean, content_hash string"


class PageReader(HTMLParser):
    """Collects blocks. The text buffer empties only where a captured element opens, so nested or stray ends repeat text."""

    CAPTURED = {*HEADINGS, "p", "li", "title", "td", "th"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int | None, str, list[list[str]] | None]] = []
        self.spanned: set[int] = set()  # places of tables whose cells span others
        self.spans_here = False
        self.text: list[str] = []
        self.open = self.spans = self.simplified = False
        self.title: str | None = None
        self.depth = 0
        self.row: list[str] | None = None
        self.table: list[list[str]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self.CAPTURED:
            self.open, self.text = True, []
            self.spans |= tag in ("td", "th") and any(name in ("colspan", "rowspan") for name, _ in attrs)
        elif tag in ("ul", "ol"):
            self.blocks.append(("LIST", None, "", None))
        elif tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.table, self.spans_here = [], False
        elif tag == "tr" and self.depth == 1:
            self.row = []

    def handle_data(self, data: str) -> None:
        if self.open:
            self.text.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.CAPTURED:
            self.open = False
            self.captured(tag, "".join(self.text).strip())
        elif tag == "tr" and self.depth == 1:
            if self.row is not None:
                self.table.append(self.row)
            self.row = None
        elif tag == "table":
            if self.depth == 1:
                self.blocks.append(("TABLE", None, "", self.table))
                if self.spans_here:
                    self.spanned.add(len(self.blocks))
            self.depth = max(0, self.depth - 1)

    def captured(self, tag: str, text: str) -> None:
        if tag in ("td", "th"):
            if self.row is not None:
                self.row.append(text)
            self.simplified |= self.spans
            self.spans_here |= self.spans
            self.spans = False
        elif tag == "title":
            self.title = text or None
        elif tag == "li":
            self.blocks.append(("LIST_ITEM", None, text, None))
        elif text:
            self.blocks.append(("PARAGRAPH" if tag == "p" else "HEADING", HEADINGS.get(tag), text, None))


def html_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of every page (page_id, html): a stateful reader, so one call per row in Arrow batches. A null page has none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, html in zip(batch["page_id"], batch["html"], strict=True):
                reader = PageReader()
                reader.feed(html or "")
                reader.close()
                section, content = None, hashlib.sha256((html or "").encode()).hexdigest()
                for n, (kind, level, text, rows) in enumerate(reader.blocks, 1):
                    name = f"{page}:p1:b{n}"
                    warnings = ["TABLE_STRUCTURE_SIMPLIFIED"] if n in reader.spanned else []
                    out.append((page, n, kind, None if level is None else str(level), text, rows, warnings, 1, name, section, reader.title, reader.simplified, content))
                    section = name if kind == "HEADING" else section
            yield pd.DataFrame(out, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return pages.select("page_id", "html").mapInPandas(read, SCHEMA)
