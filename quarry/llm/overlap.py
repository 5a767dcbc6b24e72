"""How much of a chunk's text repeats the end of the chunk before it."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.lookalike import same_form_array

#: So much of the chunk before is looked at where nothing says how long overlaps are, and no more of its text moves in a shuffle.
LONGEST = 600
#: Characters for each token of an overlap given in tokens, and stored characters for each of an overlap's: decomposed writing has up to three.
PER_TOKEN, DECOMPOSED = 4, 3


def longest_overlap(params: DataFrame) -> int:
    """The most characters that an overlap has in any format, with room for decomposed writing; LONGEST at least.

    ``params`` has overlap_chars and overlap_tokens by format, a few rows, of which one number comes to the driver.
    """
    chars = F.greatest(F.coalesce("overlap_chars", F.lit(0)), F.coalesce("overlap_tokens", F.lit(0)) * PER_TOKEN)
    return max(LONGEST, DECOMPOSED * int(params.agg(F.max(chars)).first()[0] or 0))


def overlap_length(before: str | None, text: str | None, longest: int = LONGEST) -> int:
    """The length of the longest beginning of ``text``, up to a line break, with which ``before`` ends; 0 if there is none.

    ``longest`` bounds it, see :func:`longest_overlap`.

    The line break itself is counted, so that ``text[overlap_length(...):]`` is the chunk's own text. If no beginning
    ends the chunk before character by character, what they look like decides (problem 2): a file may have been exported
    in other characters.
    """
    if not before or not text:
        return 0
    breaks = [i for i, c in enumerate(text[: longest + 1]) if c == "\n"]
    for at in reversed(breaks):
        if at and before.endswith(text[:at]):
            return at + 1
    if breaks and not (before.isascii() and text[: breaks[-1]].isascii()):
        seen, head = (x.as_py() for x in same_form_array(pa.array([before, text[: breaks[-1] + 1]])))
        marks = [i for i, c in enumerate(head) if c == "\n"]
        for at, mark in zip(reversed(breaks), reversed(marks)):
            if mark > 0 and seen.endswith(head[:mark]):
                return at + 1
    return 0


def overlap(before: Column, text: Column, longest: int = LONGEST) -> Column:
    """Column form of :func:`overlap_length`."""

    @F.pandas_udf(T.IntegerType())
    def run(before: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([overlap_length(a, b, longest) for a, b in zip(before, text)], dtype="int32")

    return run(before, text)


def with_neighbours(chunks: DataFrame, head: bool = False, longest: int = LONGEST) -> DataFrame:
    """``chunks`` with ``before``, the end of the text of the chunk before, and ``after``, the beginning of the next one's.

    Neighbours meet in an equi-join on (doc_id, ord), a key that is unique, so that no document makes a task of its own.
    ``chunks`` must be distinct in it.
    """
    ends = chunks.select("doc_id", (F.col("ord") + 1).alias("ord"), F.expr(f"right(text, {longest})").alias("before"))
    out = chunks.join(ends, ["doc_id", "ord"], "left")
    if head:
        out = out.join(chunks.select("doc_id", (F.col("ord") - 1).alias("ord"), F.expr(f"left(text, {2 * longest})").alias("after")), ["doc_id", "ord"], "left")
    return out


def own_text(before: Column, text: Column, longest: int = LONGEST) -> Column:
    """The text without its overlap."""
    return F.substring(text, overlap(before, F.expr(f"left(text, {longest + 1})"), longest) + F.lit(1), F.length(text))
