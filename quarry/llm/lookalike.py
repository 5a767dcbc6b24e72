"""One consistent form of texts that look alike (problem 2).

The form is built for a whole Arrow batch at once: code points go through one lookup table (width, invisible characters,
blanks, look-alike letters, other codes of one glyph), characters that stand for several are spread out by offsets, and
marks and conjoining letters are composed in vectorised passes. Letter case, accents, voicing marks, raised, lowered or
circled digits and line breaks are left as they are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import arrow_text as A
from quarry.runtime import saved

# Letters of other alphabets whose glyphs are those of Latin letters.
SAME_GLYPH = dict(
    zip(
        "АВЕКМНОРСТХЅІЈԚԜаеорсухѕіјһԁԛԝ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο",
        "ABEKMHOPCTXSIJQWaeopcyxsijhdqw" + "ABEZHIKMNOPTYXo",
    )
)
# Other codes of one glyph.
SAME_GLYPH |= {"µ": "μ", "‐": "-", "‑": "-", "―": "—", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
# Characters that show nothing.
INVISIBLE = [0x00AD, 0x034F, 0x061C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF, *range(0xE0100, 0xE01F0)]
# Blanks that look like a space.
BLANKS = [0x0009, 0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]

GONE, MANY = -1, -2
END = 0x110000
HANGUL, LEAD, VOWEL, TAIL = 0xAC00, 0x1100, 0x1161, 0x11A7


@lru_cache(maxsize=1)
def tables() -> dict[str, np.ndarray]:
    """The lookup tables, made from the Unicode data of Python once in each worker."""
    one = np.arange(END, dtype=np.int32)
    spread: dict[int, list[int]] = {}
    for c in (*range(0x80, HANGUL), *range(0xD7A4, 0xD800), *range(0xE000, 0x30000)):
        seq = "".join(SAME_GLYPH.get(x, x) for x in unicodedata.normalize("NFD", SAME_GLYPH.get(chr(c), chr(c))))
        if len(seq) == 1:
            one[c] = ord(seq)
        else:
            one[c], spread[c] = MANY, [ord(x) for x in seq]
    for c in range(0xFF01, 0xFF5F):  # full-width forms stand in the order of ASCII; its letters and digits only
        if chr(c - 0xFEE0).isalnum():
            one[c] = c - 0xFEE0
    one[INVISIBLE], one[BLANKS] = GONE, 0x20
    start, size, flat = np.zeros(END, np.int32), np.ones(END, np.int32), []
    for c, seq in spread.items():
        start[c], size[c] = len(flat), len(seq)
        flat += seq
    pairs, mark = {}, np.zeros(END, np.uint8)
    for c in (*range(0x80, 0x3400), *range(0xF900, 0x20000)):
        if k := unicodedata.combining(chr(c)):
            mark[c] = k
        d = unicodedata.decomposition(chr(c))
        if d and d[0] != "<" and len(d := d.split()) == 2 and unicodedata.normalize("NFC", chr(c)) == chr(c):
            pairs[int(d[0], 16) << 21 | int(d[1], 16)] = c
    keys = np.array(sorted(pairs), np.int64)
    follows = mark > 0
    follows[keys & 0x1FFFFF] = True
    return {"one": one, "start": start, "size": size, "flat": np.array(flat, np.int32), "class": mark, "follows": follows, "keys": keys, "made": np.array([pairs[k] for k in keys.tolist()], np.int32)}


def _composed(points: np.ndarray, row: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Marks joined to their letters in canonical order, conjoining jamo to syllables. Returns (points, kept)."""
    alive = np.ones(len(points), bool)
    # leading consonant + vowel, then syllable + final consonant
    lead = np.flatnonzero((points >= LEAD) & (points < LEAD + 19))
    lead = lead[lead + 1 < len(points)]
    v = points[lead + 1] - VOWEL
    lead = lead[(v >= 0) & (v < 21) & (row[lead] == row[lead + 1])]
    points[lead] = HANGUL + ((points[lead] - LEAD) * 21 + points[lead + 1] - VOWEL) * 28
    alive[lead + 1] = False
    for base, final in ((lead, lead + 2), (f := np.flatnonzero((points > TAIL) & (points < TAIL + 28) & (np.arange(len(points)) > 0)) - 1, f + 1)):
        ok = (final < len(points)) & (points[base] >= HANGUL) & (points[base] <= 0xD7A3) & alive[base]
        base, final = base[ok], final[ok]
        k = points[final] - TAIL
        ok = (k > 0) & (k < 28) & ((points[base] - HANGUL) % 28 == 0) & (row[base] == row[final])
        points[base[ok]] += k[ok]
        alive[final[ok]] = False
    after = t["follows"][points] & alive
    if after.any():
        run = np.flatnonzero(after & ~np.concatenate(([False], after[:-1])))
        rank = t["class"][points]
        bad = after[1:] & after[:-1] & (rank[1:] > 0) & (rank[1:] < rank[:-1]) & (row[1:] == row[:-1])
        if bad.any():  # marks of a run into canonical order
            group = np.cumsum(~after | (rank == 0) | np.concatenate(([True], row[1:] != row[:-1])))
            points = points[np.lexsort((np.arange(len(points)), np.where(after, rank, 0), group))]
            rank = t["class"][points]
        base = run - 1
        run, base = run[(base >= 0)], base[base >= 0]
        same = row[np.maximum(base, 0)] == row[run]
        run, base = run[same], base[same]
        last, k = np.zeros(len(run), np.int64), 0
        while len(run):
            here = run + k
            go = here < len(points)
            go[go] = after[here[go]] & (row[here[go]] == row[base[go]])
            run, base, last, here = run[go], base[go], last[go], here[go]
            if not len(run):
                break
            key = points[base].astype(np.int64) << 21 | points[here]
            at = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
            fits = (t["keys"][at] == key) & ((last == 0) | (last < rank[here]))
            points[base[fits]] = t["made"][at[fits]]
            alive[here[fits]] = False
            last = np.where(fits, last, np.maximum(rank[here], 1))
            k += 1
    return points, alive


def same_form(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The consistent form of a batch of texts given as code points and offsets."""
    t = tables()
    if not len(points):
        return points.astype(np.int32), offsets
    row = A.rows_of(offsets)
    new = t["one"][points]
    if (new == MANY).any():
        size = np.where(new == MANY, t["size"][points], 1)
        end = np.cumsum(size)
        src = np.repeat(np.arange(len(points)), size)
        step = np.arange(end[-1]) - np.repeat(end - size, size)
        many = new[src] == MANY
        out = new[src]
        out[many] = t["flat"][t["start"][points[src[many]]] + step[many]]
        new, row = out, row[src]
        offsets = np.concatenate(([0], end))[offsets]
    if (new == GONE).any():
        seen = new != GONE
        row = row[seen]
        new, offsets = A.keep(new, offsets, seen)
    new, alive = _composed(new, row, t)
    return A.keep(new, offsets, alive)


def same_form_array(column: pa.Array) -> pa.Array:
    """The consistent form of a string column; nulls stay null."""
    points, offsets = same_form(*A.code_points(column))
    return A.strings(points.astype(np.uint32), offsets, np.asarray(column.is_valid()))


def _headings(batch: pa.RecordBatch, name: str) -> tuple[pa.Array, np.ndarray]:
    """The elements of a list column, and the list offsets; a null list is an empty one."""
    lists = batch.column(name)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)).astype(np.int64)
    return lists.flatten(), np.concatenate(([0], np.cumsum(sizes)))


def with_same_form(df: DataFrame, text: str = "text", headings: str | None = "headings") -> DataFrame:
    """``df`` with its text and headings in the consistent form; every other column stays.

    Nulls stay null, empty texts empty, and null elements of headings null. Repeated rows are kept.
    """
    names = [c for c in (text, headings) if c]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.runs(batches, text):
            new = []
            for name, column in zip(batch.schema.names, batch.columns):
                if name == text:
                    column = same_form_array(column)
                elif name == headings:
                    flat, at = _headings(batch, name)
                    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), same_form_array(flat))
                    column = pa.ListArray.from_buffers(lists.type, len(lists), [pa.py_buffer(np.packbits(np.asarray(column.is_valid()), bitorder="little").tobytes()), lists.buffers()[1]], children=[lists.values])
                new.append(column)
            yield pa.RecordBatch.from_arrays(new, names=batch.schema.names)

    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == text else T.ArrayType(T.StringType()) if f.name == headings else f.dataType) for f in df.schema])
    assert all(c in df.columns for c in names)
    return df.mapInArrow(work, schema)


def _named(text: str, headings: str, seed: int) -> Column:
    """A 64-bit hash of a text and its headings; nulls are empty. Each element hashes into that of the ones before it."""
    return F.xxhash64(F.lit(seed), F.coalesce(text, F.lit("")), F.size(headings), headings)


def form_keys(chunks: DataFrame) -> DataFrame:
    """(chunk_id, f1, f2, s1, s2): 128-bit names of what a chunk looks like (f) and of what it holds (s), by text and headings.

    A null text looks like an empty one, null headings like none and a null heading like an empty one. The names stand
    for the texts in the shuffles that follow, so that no text moves; the JVM hashes what the form's arrays hold. A null
    chunk_id is dropped.
    """
    rows = chunks.select("chunk_id", "text", "headings").filter("chunk_id is not null")
    filled = F.transform(F.coalesce("headings", F.array().cast("array<string>")), lambda h: F.coalesce(h, F.lit("")))
    rows = rows.select("chunk_id", F.coalesce("text", F.lit("")).alias("text"), filled.alias("headings"))
    rows = rows.select("chunk_id", "text", "headings", *(_named("text", "headings", k).alias(f"s{k}") for k in (1, 2)))
    return with_same_form(rows).select("chunk_id", *(_named("text", "headings", k).alias(f"f{k}") for k in (1, 2)), "s1", "s2")


#: Chunks of a form that one row of its salted self-join meets.
SALT = 1000


def _mixed(chunks: DataFrame) -> DataFrame:
    """Distinct (chunk_id, f1, f2, s1, s2, n) of the chunks whose form is stored in several ways; n chunks have the form."""
    keys = saved(form_keys(chunks))
    ways = keys.groupBy("f1", "f2").agg(F.min(F.struct("s1", "s2")).alias("a"), F.max(F.struct("s1", "s2")).alias("b"), F.count("*").alias("n"))
    return keys.distinct().join(ways.filter("a <> b").select("f1", "f2", "n"), ["f1", "f2"])


def look_alikes(chunks: DataFrame) -> DataFrame:
    """Pairs (chunk_id_1, chunk_id_2) of chunks that look the same while their characters differ, the smaller id first.

    Chunks repeated in full count once. Forms stored in a single way are dropped before the join by a partial
    aggregation, so a form that a third of all chunks share as exact copies makes no pairs; a large form that is stored in
    several ways is salted: a row of one side for each block of the other.
    """
    rows = _mixed(chunks).withColumn("blocks", F.ceil(F.col("n") / SALT))
    left = rows.select("f1", "f2", F.struct("s1", "s2").alias("x"), F.col("chunk_id").alias("chunk_id_1"), F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).alias("salt"))
    right = rows.select("f1", "f2", F.struct("s1", "s2").alias("y"), F.col("chunk_id").alias("chunk_id_2"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("salt"))
    return left.join(right, ["f1", "f2", "salt"]).filter("x <> y and chunk_id_1 < chunk_id_2").select("chunk_id_1", "chunk_id_2").distinct()


def look_alike_classes(chunks: DataFrame) -> DataFrame:
    """(chunk_id, class_id, n_links) of every chunk: the smallest id that looks like it, and how many chunks look like it in other characters.

    Chunks repeated in full are one row. No pairs are made: links are what a class holds less what is stored alike.
    """
    keys = saved(form_keys(chunks).distinct())
    alike = keys.groupBy("f1", "f2", "s1", "s2").agg(F.count("*").alias("n"), F.min("chunk_id").alias("least"))
    classes = alike.groupBy("f1", "f2").agg(F.sum("n").alias("n_class"), F.min("least").alias("class_id"))
    links = alike.join(classes, ["f1", "f2"]).select("f1", "f2", "s1", "s2", "class_id", (F.col("n_class") - F.col("n")).alias("n_links"))
    return keys.join(links, ["f1", "f2", "s1", "s2"]).select("chunk_id", "class_id", "n_links")
