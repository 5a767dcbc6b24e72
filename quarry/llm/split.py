"""Splitting oversized items at natural boundaries (problem 5), by pointer doubling.

Every position of a text may be a cut. The table of successors gives for each cut the next one of the greedy split: the
farthest natural boundary at which the piece that begins with the overlap is still under the limit. Joining the table
with itself squares it: after k rounds it leaps 2^k cuts, and the cuts reached from the start double with each round, so
all greedy cuts of a whole batch are known after log2(most pieces) rounds.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quarry.llm import arrow_text as A
from quarry.runtime import saved

#: A natural boundary is taken if the piece is then at least this part of the limit; else the next weaker kind is tried.
LEAST_FILL = 0.5
#: Rows of a document are numbered within runs of so many before the runs are added up, so that no document makes one task.
ORD_RUN = 4096
#: Columns of chunks that the pieces keep; others have no meaning for a piece and are left out.
COLUMNS = ("chunk_id", "doc_id", "ord", "text", "headings", "page_no", "source")
# Marks that end a sentence, and those that may close it.
END_MARKS = ".!?。！？｡…"
CLOSING = "\"'”’»」』》〉）)]】"


@lru_cache(maxsize=1)
def _classes() -> dict[str, np.ndarray]:
    """Code point tables: blank, line break, end mark, closing mark, and characters that stay with the one before."""
    t = {k: np.zeros(0x110000, bool) for k in ("blank", "line", "end", "close", "joins")}
    for c in (9, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 10, 0x2028, 0x2029):
        t["blank"][c] = True
    t["line"][[10, 0x2028, 0x2029]] = True
    t["end"][[ord(c) for c in END_MARKS]] = True
    t["close"][[ord(c) for c in CLOSING]] = True
    for c in (*range(0x300, 0x3100), *range(0xA600, 0xAC00), *range(0xFE00, 0xFE30), *range(0xE0100, 0xE01F0), *range(0x1F3FB, 0x1F400)):
        t["joins"][c] = unicodedata.category(chr(c)) in ("Mn", "Mc", "Me") or 0x1F3FB <= c <= 0x1F3FF
    t["joins"][[*range(0x1160, 0x1200), *range(0x200B, 0x200E), 0x2060, 0xFEFF, 0xAD, *range(0xD7B0, 0xD7FC)]] = True
    return t


def cuts(points: np.ndarray, offsets: np.ndarray, limit: np.ndarray, overlap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of all pieces of a batch, in order; start and end are places in ``points``.

    A piece is never above the row's limit. It starts at the cut before it less the overlap, or at the next beginning of
    a word if there is one in the first half of the overlap.
    """
    t = _classes()
    n = len(points)
    rows = np.flatnonzero(np.diff(offsets) > 0)
    if not n:
        return rows, rows, rows
    row = A.rows_of(offsets)
    # what kind of boundary lies before each position 0..n: 0 none, 1 any character, 2 word, 3 sentence, 4 line, 5 paragraph
    prev, here = points[:-1], points[1:]
    kind = np.zeros(n + 1, np.int8)
    kind[1:n][~t["joins"][here]] = 1
    kind[1:n][(prev == 13) & (here == 10)] = 0
    kind[1:n][(prev == 0x200D)] = 0
    word = t["blank"][prev] & ~t["blank"][here]
    kind[1:n][word] = 2
    solid = np.where(t["blank"][points], -1, np.arange(n))
    last = np.maximum.accumulate(solid)  # the last visible character up to each position
    mark = np.where(t["close"][points], -1, np.arange(n))
    mark = np.maximum.accumulate(mark)
    ended = (last >= 0) & t["end"][points[np.maximum(mark[np.maximum(last, 0)], 0)]]
    kind[1:n][word & ended[:-1]] = 3
    wide = (prev >= 0x3000) & (t["end"][prev] | (t["close"][prev] & ended[:-1])) & ~t["end"][here] & ~t["close"][here]
    kind[1:n][wide & ~t["joins"][here]] = 3
    lines = np.concatenate(([0], np.cumsum(t["line"][points])))
    broken = lines[1:n] - lines[np.maximum(last[:-1], 0)]  # line breaks since the last visible character
    kind[1:n][word & (broken == 1)] = 4
    kind[1:n][word & (broken > 1)] = 5
    kind[offsets] = 6  # the ends of the rows are cuts of their own
    end_of, start_of = offsets[1:][row], offsets[:-1][row]
    # the place where the piece after a cut at p begins; p as seen from the row that holds it, and the ends of rows left out
    p = np.arange(n)
    back = np.maximum(p - overlap[row], start_of)
    begins = np.flatnonzero(kind >= 2)
    first = begins[np.minimum(np.searchsorted(begins, back), len(begins) - 1)]
    safe = np.flatnonzero(kind > 0)
    near = safe[np.minimum(np.searchsorted(safe, back), len(safe) - 1)]
    begin = np.where((first >= back) & (first <= p - overlap[row] // 2), first, np.minimum(near, p))
    begin[p == start_of] = start_of[p == start_of]
    far = np.minimum(begin + limit[row], end_of)
    least = np.maximum(begin + (limit[row] * LEAST_FILL).astype(np.int64), p + 1)
    succ = np.full(n + 1, n, np.int64)
    todo = np.ones(n, bool)
    for k in (6, 5, 4, 3, 2, 1):
        places = np.flatnonzero(kind >= k)
        found = places[np.maximum(np.searchsorted(places, far, "right") - 1, 0)]
        fits = todo & (found > p) & ((found >= least) | (found == end_of) | (k == 1))
        succ[:n][fits] = found[fits]
        todo &= ~fits
    hard = np.flatnonzero(todo)  # a cluster longer than the limit: cut it all the same
    succ[hard] = np.maximum(far[hard], hard + 1)
    # the last cut of a row leads to the sink n, so that no row runs into the next
    leap = np.append(np.where(succ[:n] < end_of, succ[:n], n), n)
    reached = np.zeros(n + 1, bool)
    reached[offsets[:-1][rows]] = True
    while True:
        at = np.flatnonzero(reached[:n])
        to = leap[at]
        if (to == n).all():
            break
        reached[to] = True
        leap = leap[leap]
    at = np.flatnonzero(reached[:n])
    return row[at], begin[at], succ[at]


def limits_of(params: DataFrame) -> dict[str, tuple[int | None, int]]:
    """{format: (max_chars, overlap_chars)} of a table of a few rows, formats trimmed and in lower case."""
    return {(r.format or "").strip().lower(): (r.max_chars, r.overlap_chars or 0) for r in params.select("format", "max_chars", "overlap_chars").collect()}


def with_limits(df: DataFrame, params: DataFrame) -> DataFrame:
    """``df`` with the max_chars and overlap_chars of its ``format``, as expressions over the few formats; no join.

    Formats are compared trimmed and in lower case; null ones and those without a row of their own take the row ``default``.
    Where there is no such row they have no limit, and their texts stay whole.
    """
    limits = limits_of(params)
    most, overlap = limits.get("default", (None, 0))
    name = F.lower(F.trim("format"))
    max_chars, overlap_chars = F.lit(most).cast("int"), F.lit(overlap)
    for fmt, (m, o) in limits.items():
        max_chars = F.when(name == fmt, F.coalesce(F.lit(m).cast("int"), F.lit(most).cast("int"))).otherwise(max_chars)
        overlap_chars = F.when(name == fmt, F.lit(o)).otherwise(overlap_chars)
    return df.withColumn("max_chars", max_chars).withColumn("overlap_chars", overlap_chars)


def _identified(chunks: DataFrame) -> DataFrame:
    """The columns that pieces keep; a chunk_id that is null is made of doc_id and ord, and rows that have none of these are left out."""
    rows = chunks.select(*(c for c in COLUMNS if c in chunks.columns))
    return rows.withColumn("chunk_id", F.coalesce("chunk_id", F.concat("doc_id", F.lit("#"), F.col("ord").cast("string")))).filter("chunk_id is not null")


def cut_places(chunks: DataFrame, documents: DataFrame, params: DataFrame) -> DataFrame:
    """(chunk_id, starts, ends) of the chunks that are above the limit of their document's format, and of no others.

    Only texts above the least limit of any format meet their documents, and only those above their own go to Python.
    Rows repeated in full count once.
    """
    least = min((m for m, _ in limits_of(params).values() if m is not None and m >= 0), default=None)
    rows = _identified(chunks).select("chunk_id", "doc_id", "text").filter(F.length("text") > least if least is not None else F.lit(False)).dropDuplicates(["chunk_id"])
    formats = documents.select(F.col("doc_key").alias("doc_id"), "format").dropDuplicates(["doc_id"])
    large = with_limits(rows.join(formats, "doc_id", "left"), params).filter(F.length("text") > F.col("max_chars")).select("chunk_id", "text", "max_chars", "overlap_chars")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.runs(batches, "text"):
            points, offsets = A.code_points(batch.column("text"))
            limit = np.asarray(batch.column("max_chars")).astype(np.int64).clip(1)
            overlap = np.minimum(np.asarray(batch.column("overlap_chars")).astype(np.int64).clip(0), limit // 2)
            row, start, end = cuts(points, offsets, limit, overlap)
            order = np.lexsort((end, row))
            row, start, end = row[order], start[order], end[order]
            at = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(batch))))), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x - offsets[:-1][row], pa.int32())) for x in (start, end)]
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), *lists], names=["chunk_id", "starts", "ends"])

    return large.mapInArrow(work, "chunk_id string, starts array<int>, ends array<int>")


def split(chunks: DataFrame, documents: DataFrame, params: DataFrame) -> DataFrame:
    """Chunks above their format's ``max_chars`` cut into pieces; all others stay as they are.

    ``chunks`` has chunk_id, doc_id, ord, text, headings, page_no and source; ``documents`` doc_key and format; ``params`` one
    row for each format with max_chars and overlap_chars, and one named default (see :func:`with_limits`). The result has
    one row for each piece: chunk_id, doc_id, a new dense ``ord`` within the document, ``piece`` (from 0) and ``n_pieces``
    of the chunk, text, headings, page_no, n_chars and source. Rows repeated in full count once. A null text stays one piece
    with a null text, an empty one stays empty. A chunk whose chunk_id is null goes by its doc_id and ord; if one of these
    is null too it is left out, as nothing names its pieces.

    Cuts are made once and kept as places in the text. Places and numbers join the texts last, by chunk_id, in the one
    shuffle that also drops repeated rows; texts are sliced behind it.
    """
    rows = _identified(chunks)
    places = saved(cut_places(chunks, documents, params))
    n_pieces = F.coalesce(F.size("starts"), F.lit(1))
    counts = rows.select("chunk_id", "doc_id", "ord").dropDuplicates(["chunk_id"]).join(places.select("chunk_id", "starts"), "chunk_id", "left")
    counts = counts.select("chunk_id", "doc_id", "ord", n_pieces.alias("n"), F.floor(F.col("ord") / ORD_RUN).alias("run"))
    runs = W.Window.partitionBy("doc_id", "run").orderBy("ord", "chunk_id").rowsBetween(W.Window.unboundedPreceding, -1)
    sums = counts.groupBy(F.col("doc_id").alias("d"), F.col("run").alias("r")).agg(F.sum("n").alias("n"))
    before = sums.select("d", "r", F.sum("n").over(W.Window.partitionBy("d").orderBy("r").rowsBetween(W.Window.unboundedPreceding, -1)).alias("before"))
    within = counts.withColumn("in_run", F.sum("n").over(runs))
    first = within.join(before, within.doc_id.eqNullSafe(before.d) & within.run.eqNullSafe(before.r)).select("chunk_id", (F.coalesce("in_run", F.lit(0)) + F.coalesce("before", F.lit(0))).alias("first"))
    whole = rows.dropDuplicates(["chunk_id"]).join(first, "chunk_id").join(places, "chunk_id", "left")
    pairs = F.coalesce(F.arrays_zip("starts", "ends"), F.array(F.struct(F.lit(0).alias("starts"), F.lit(2**31 - 1).alias("ends"))))
    pieces = whole.withColumn("n_pieces", n_pieces).select("*", F.posexplode(pairs).alias("piece", "at"))
    text = F.when(F.col("n_pieces") == 1, F.col("text")).otherwise(F.substring("text", F.col("at.starts") + 1, F.col("at.ends") - F.col("at.starts")))
    return pieces.withColumn("text", text).select("chunk_id", "doc_id", (F.col("first") + F.col("piece")).cast("int").alias("ord"), "piece", "n_pieces", "text", "headings", "page_no", F.length("text").alias("n_chars"), "source")


def oversized(chunks: DataFrame, documents: DataFrame, params: DataFrame) -> DataFrame:
    """(chunk_id, n_pieces) of the chunks that are above their limit, as the cuts say."""
    return cut_places(chunks, documents, params).select("chunk_id", F.size("starts").alias("n_pieces")).filter("n_pieces > 1")
