"""Markup to Markdown: the standard library's parser says what stands where, column expressions make the text.

A parsed document is an array of blocks. A block is a heading of some level, a paragraph (level 0), or a table, whose rows hold
the cells' texts as they were; blanks, bars, widths and promoted headings are settled by the functions of ``text`` and
``tables``, the same for every source.
"""

from __future__ import annotations

from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import tables as G
from quarry.functions import text as X

BLOCKS = T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType())))]))
UNSEEN = frozenset(("script", "style", "head", "title"))
HEADINGS = {f"h{n}": n for n in range(1, 7)}
#: Elements that begin and end a block.
BOUNDS = frozenset((*HEADINGS, "p", "li", "div", "br"))


class Block(NamedTuple):
    """A heading or paragraph has a text, a table has rows."""

    level: int
    text: str | None
    rows: list[list[str]] | None = None


class _Reader(HTMLParser):
    """Writes each piece of text to the sink on top of a stack: the running paragraph, a cell of the outermost table, or none."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.done: list[Block] = []
        self.level, self.hidden, self.tables = 0, 0, 0
        self.running: list[str] = []
        self.rows: list[list[list[str]]] = []
        self.sink: list[str] | None = self.running

    def paragraph(self, level: int = 0) -> None:
        """Ends the running block; the next one has the given level."""
        if any(x.strip() for x in self.running):
            self.done.append(Block(self.level, " ".join(self.running)))
        self.running, self.level = [], level
        self.sink = self.running

    def table(self) -> None:
        """Ends the outermost table."""
        self.done.append(Block(0, None, [[" ".join(cell) for cell in row] for row in self.rows]))
        self.tables, self.rows, self.sink = 0, [], self.running

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.hidden += tag in UNSEEN
        if tag == "table":
            if not self.tables:
                self.paragraph()
                self.sink = None
            self.tables += 1
        elif self.tables > 1:
            return  # a table in a cell is text of the cell
        elif self.tables and tag == "tr":
            self.rows.append([])
            self.sink = None
        elif self.tables and tag in ("td", "th"):
            span = next((v for n, v in attrs if n == "colspan"), None) or "1"
            self.rows = self.rows or [[]]
            self.sink = []
            self.rows[-1].extend([self.sink, *([] for _ in range(int(span) - 1 if span.isdigit() else 0))])
        elif not self.tables and tag in BOUNDS:
            self.paragraph(HEADINGS.get(tag, 0))

    def handle_endtag(self, tag: str) -> None:
        if tag in UNSEEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "table" and self.tables > 1:
            self.tables -= 1
        elif tag == "table" and self.tables:
            self.table()
        elif self.tables == 1 and tag in ("td", "th", "tr"):
            self.sink = None
        elif not self.tables and tag in BOUNDS:
            self.paragraph()

    def handle_data(self, data: str) -> None:
        if self.sink is not None and not self.hidden:
            self.sink.append(data)


def parsed(html: str | None) -> list[Block]:
    """The blocks of a document in its order; none for null and empty ones. Broken markup never raises."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    if reader.tables:
        reader.table()
    reader.paragraph()
    return reader.done


@F.pandas_udf(BLOCKS)
def blocks(html: pd.Series) -> pd.Series:
    """Column form of :func:`parsed`."""
    return html.map(lambda h: [b._asdict() for b in parsed(h)])


def markdown(parts: Column, promote: bool = True) -> Column:
    """The Markdown of an array of blocks, a blank line between two.

    A paragraph that looks like a heading of an outline becomes one if ``promote``. Rows without text are left out, and
    blocks without any.
    """

    def one(block: Column) -> Column:
        rows = F.filter(F.transform(block.rows, lambda row: F.transform(row, lambda cell: X.html_cell(X.flat(cell)))), lambda row: F.exists(row, lambda cell: cell != ""))
        text = block.text
        line = F.when(block.level > 0, F.concat(F.repeat(F.lit("#"), block.level), F.lit(" "), text)).otherwise(X.promoted(text) if promote else text)
        return F.when(block.rows.isNotNull(), G.markdown(rows)).otherwise(line)

    # texts are made flat in a pass of their own, as an expression in a lambda is evaluated wherever it is named
    flat = F.transform(parts, lambda b: F.struct(b.level.alias("level"), X.flat(b.text).alias("text"), b.rows.alias("rows")))
    return F.array_join(F.filter(F.transform(flat, one), lambda x: x != ""), "\n\n")
