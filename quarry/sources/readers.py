"""Files to Markdown: readers by format, tried in turn, whose failures are rows and never end a job."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import html
from quarry.functions.paths import format_of
from quarry.functions.text import strip

#: A reader gives Markdown, a list of pages of Markdown, or blocks, of which the JVM makes Markdown.
Reader = Callable[[bytes], "str | list[str] | list[html.Block]"]
PAGE_BREAK = "\f"


def decoded(content: Column) -> Column:
    """Text of a binary column as UTF-8, damaged bytes replaced; null if blank."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.when(strip(text) == "", F.lit(None)).otherwise(text)


def read_plain(content: bytes) -> str:
    return content.decode("utf-8", "replace")


def read_html(content: bytes) -> list[html.Block]:
    return html.parsed(read_plain(content))


def read_csv(content: bytes) -> list[html.Block]:
    return [html.Block(0, None, list(csv.reader(io.StringIO(read_plain(content)))))]


#: Readers by file ending, the first that doesn't raise is taken. Formats that need a parser of their own are registered
#: by the caller: a pdf's primary, tolerant and OCR reader, office files, hwp and xls.
READERS: dict[str, list[tuple[str, Reader]]] = {
    "txt": [("primary", read_plain)],
    "md": [("primary", read_plain)],
    "html": [("primary", read_html)],
    "htm": [("primary", read_html)],
    "csv": [("primary", read_csv)],
}


#: Endings that the JVM reads by itself, unless the caller has another reader for them.
PLAIN = ("txt", "md")


def convert(files: DataFrame, readers: dict[str, list[tuple[str, Reader]]] | None = None) -> DataFrame:
    """(path, format, markdown, backend, error) of files with path, ext and content.

    The readers of an ending are tried in order; the note of the last failure is kept if all fail. A reader that gives
    blank text leaves the next one a try (OCR after a pdf without text); blank from all is null text without an error.
    Paragraphs of markup that look like headings become headings. Pages are joined by a form feed.
    """
    known = {**READERS, **(readers or {})}
    own = [e for e in PLAIN if known[e] is READERS[e]]
    ext = F.lower(F.coalesce("ext", F.lit("")))
    plain = files.filter(ext.isin(own)).select("path", "ext", decoded(F.coalesce("content", F.lit(b""))).alias("markdown"), F.lit("primary").alias("backend"), F.lit(None).cast("string").alias("error"))

    def one(ext: str | None, content: bytes | None) -> tuple[str | None, list | None, str, str | None]:
        error, backend = None, "primary"
        tried = known.get((ext or "").lower())
        if not tried:
            return None, None, backend, f"LookupError: no reader for {ext}"
        for name, reader in tried:
            try:
                made = reader(bytes(content or b""))
                blocks = made if isinstance(made, list) and not all(isinstance(x, str) for x in made) else None
                text = None if blocks else PAGE_BREAK.join(made) if isinstance(made, list) else made
                if blocks and any((b.text or "").strip() or any(c.strip() for r in b.rows or () for c in r) for b in blocks) or text and text.strip():
                    return text, blocks and [b._asdict() for b in blocks], name, None
                error, backend = None, name
            except Exception as e:  # noqa: BLE001  a file's fault is a value here
                error = f"{type(e).__name__}: {e}"[:500]
        return None, None, backend, error

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, e, *one(e, c)) for p, e, c in zip(f.path, f.ext, f.content)]
            yield pd.DataFrame(rows, columns=["path", "ext", "text", "blocks", "backend", "error"])

    schema = f"path string, ext string, text string, blocks {html.BLOCKS.simpleString()}, backend string, error string"
    made = files.filter(~ext.isin(own)).select("path", "ext", "content").mapInPandas(work, schema)
    made = made.select("path", "ext", F.when(F.col("blocks").isNotNull(), html.markdown(F.col("blocks"))).otherwise(F.col("text")).alias("markdown"), "backend", "error")
    return plain.unionByName(made).select("path", format_of(F.col("ext")).alias("format"), "markdown", "backend", "error")
