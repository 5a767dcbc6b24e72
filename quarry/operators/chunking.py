"""Structure-aware chunks from Markdown.

Contract of this library's own splitter: blocks end at blank lines, at headings and at the edges of tables; blocks are
packed greedily up to the format's token limit under one path of headings; a block above it is cut at sentences, then at
words, and a word above it at characters; a table is cut at its rows only. Neighbours under one path of headings are merged
while they fit. A token is a run of letters and digits, and in scripts without blanks each character, which stands in for a
model's own. Tails, minimum length and numbers are joins and windows over runs of chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.config import Config
from quarry.functions import text as X
from quarry.operators.store import numbered
from quarry.runtime import saved
from quarry.sources.readers import PAGE_BREAK

HEADING = re.compile(r"(#{1,6})\s+(.*\S)\s*\Z")
UNSPACED = "\u0e00-\u0e7f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"  # Thai, kana, ideographs
TOKEN = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")
SENTENCE = re.compile(r"(?<=[.!?])(?=\s)|(?<=[。！？])")  # places, so that a text keeps its blanks
WORD = re.compile(r"\s*\S+|\s+")


def _size(text: str) -> int:
    return len(TOKEN.findall(text))


def _blocks(markdown: str) -> Iterator[tuple[str, str, int]]:
    """(kind, text, page) of heading, table and text blocks; a form feed begins a page."""
    for page, content in enumerate(markdown.split(PAGE_BREAK), 1):
        held: list[str] = []
        kind = "text"
        for line in [*content.split("\n"), ""]:
            now = "table" if line.lstrip().startswith("|") else "heading" if HEADING.match(line) else "text"
            if held and (not line.strip() or now != kind or now == "heading"):
                yield kind, "\n".join(held), page
                held = []
            if line.strip():
                held.append(line)
                kind = now


def _packed(pieces: list[str], joint: str, limit: int) -> Iterator[str]:
    """Neighbouring pieces joined while they fit; a piece that is larger by itself stays alone. Each is counted once."""
    held: list[str] = []
    total = 0
    for piece in pieces:
        size = _size(piece)
        if held and total + size > limit:
            yield joint.join(held).strip()
            held, total = [], 0
        held.append(piece)
        total += size
    if held:
        yield joint.join(held).strip()


def _cut(word: str, limit: int) -> Iterator[str]:
    """A word of more tokens than the limit, at the ends of tokens."""
    ends = [m.end() for m in TOKEN.finditer(word)]
    at = 0
    for end in [*ends[limit - 1 : -1 : limit], len(word)]:
        yield word[at:end]
        at = end


def _parts(kind: str, text: str, limit: int) -> Iterator[str]:
    """A block in parts of at most the limit: rows of a table, else sentences, words and characters."""
    if _size(text) <= limit:
        yield text
        return
    if kind == "table":
        yield from _packed(text.split("\n"), "\n", limit)
        return
    pieces: list[str] = []
    for sentence in SENTENCE.split(text):
        if _size(sentence) <= limit:
            pieces.append(sentence)
        else:
            for word in WORD.findall(sentence):
                pieces.extend([word] if _size(word) <= limit else _cut(word, limit))
    yield from _packed(pieces, "", limit)


def split_pages(markdown: str | None, limit: int, merge_peers: bool = True) -> list[tuple[list[str], str, list[int]]]:
    """(headings, body, pages) of each chunk; the body begins with its headings' lines."""
    out: list[tuple[list[str], list[str], list[int]]] = []
    path: list[tuple[int, str]] = []
    total, fresh = 0, True  # tokens of the last chunk with its headings, and whether the next block may join it
    for kind, text, page in _blocks(markdown or ""):
        if kind == "heading":
            m = HEADING.match(text)
            level = len(m[1])
            path = [*((n, t) for n, t in path if n < level), (level, m[2])]
            fresh = True
            continue
        heads = [t for _, t in path]
        for part in _parts(kind, text, limit):
            size = _size(part)
            if out and out[-1][0] == heads and (merge_peers or not fresh) and total + size <= limit:
                out[-1][1].append(part)
                out[-1][2].append(page)
                total += size
            else:
                out.append((heads, [part], [page]))
                total = size + sum(map(_size, heads))
            fresh = False
    return [(h, "\n".join([*h, *b]), sorted(set(p))) for h, b, p in out]


def split_markdown(markdown: str | None, limit: int, merge_peers: bool = True) -> list[tuple[list[str], str]]:
    """(headings, body) of each chunk."""
    return [(h, b) for h, b, _ in split_pages(markdown, limit, merge_peers)]


#: Formats whose form feeds begin a page.
PAGED = ("pdf", "pptx")
RAW = "doc_id string, raw_ord int, headings array<string>, body string, overlap_tokens int, pages array<int>"


def raw_chunks(docs: DataFrame, config: Config) -> DataFrame:
    """(doc_id, raw_ord, headings, body, overlap_tokens, pages) of documents with doc_id, format and markdown; none for null text.

    ``pages`` is null outside paged formats.
    """
    limits = {k: (v.max_tokens, v.overlap_tokens) for k, v in config.by_format.items()}
    default, merge = (config.default_params.max_tokens, config.default_params.overlap_tokens), config.merge_peers

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc, fmt, text in zip(f.doc_id, f.format, f.markdown):
                limit, overlap = limits.get(fmt, default)
                rows += [(doc, k, h, b, overlap, p if fmt in PAGED else None) for k, (h, b, p) in enumerate(split_pages(text, limit, merge))]
            yield pd.DataFrame(rows, columns=["doc_id", "raw_ord", "headings", "body", "overlap_tokens", "pages"])

    return docs.select("doc_id", "format", "markdown").mapInPandas(work, RAW)


def finished(raw: DataFrame, min_chars: int = 30) -> DataFrame:
    """Chunks from raw ones: glued rows repaired, short ones dropped, tails put before the next, numbered.

    The tail is that of the body just before, if that was kept; a dropped body breaks the chain. Neighbours meet by their
    place in an equi-join, and numbers are added up over runs, so that no document makes one task. ``raw_ord`` is dense.
    """
    rows = saved(raw.withColumn("body", X.unglued(F.col("body"))).filter(X.long_enough(F.col("body"), min_chars)))  # read twice, split once
    tails = rows.select("doc_id", (F.col("raw_ord") + 1).alias("raw_ord"), X.tail(F.col("body"), F.col("overlap_tokens")).alias("before"))
    both = rows.join(tails, ["doc_id", "raw_ord"], "left").withColumn("text", X.with_tail(F.col("before"), F.col("body")))
    page = X.first_page(F.col("pages")) if "pages" in raw.columns else F.lit(None).cast("int")
    kept = both.select(F.lit("").alias("chunk_id"), "doc_id", F.col("raw_ord").alias("ord"), "text", "headings", page.alias("page_no"), F.length("text").alias("n_chars"))
    return numbered(kept)


def chunks(docs: DataFrame, config: Config | None = None) -> DataFrame:
    """The chunks of Markdown documents."""
    config = config or Config()
    return finished(raw_chunks(docs, config), config.min_chars)
