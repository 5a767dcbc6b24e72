"""Tokens by source, language and domain (problem 3), kept up to date by signed deltas.

Three tables carry the state from run to run: ``counts`` has the number of tokens of every part's content under every
tokenizer, by the hash of both; ``snapshot`` the documents as last seen; ``cube`` the totals. A part is a chunk's text without
what it repeats of the chunk before. A run encodes only contents that no earlier run has counted, each once however many
documents hold it, compares the documents with the snapshot, and adds what changed to the cube: a document that is new
counts once, one that is gone counts minus once, and one that changed does both. A tokenizer goes by the digest of its file,
so that another file under the same name counts anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.paths import FORMATS
from quarry.llm import arrow_text as A
from quarry.llm.overlap import LONGEST, own_text
from quarry.llm.tokens import TOKENIZERS, word_counts
from quarry.runtime import saved

# Scripts of languages.
SCRIPT_OF = {"ko": "hangul", "ja": "kana", "zh": "han", "th": "thai", "en": "latin", "de": "latin"}
SCRIPTS = ("hangul", "kana", "han", "thai", "latin", "umlaut")
UNKNOWN = "unknown"
#: Letters of an alphabet say about as much as one syllable or ideograph.
LATIN_LETTERS = 3
#: A text's script decides against its language column if it holds this part of its letters.
CLEAR = 0.6
#: German texts have at least one umlaut or sharp s in so many letters.
UMLAUT = 200

DIMENSIONS = ("source", "lang", "stage", "format")
MEASURES = ("n_docs", "n_tokens", "n_chars")


class State(NamedTuple):
    """counts: p1, p2, tokenizer, n_tokens, n_chars, and letters by script; snapshot: tokenizer, doc_key, h1, h2, n_parts, the
    dimensions, n_tokens, n_chars; cube: tokenizer, the dimensions and measures."""

    counts: DataFrame
    snapshot: DataFrame
    cube: DataFrame


@lru_cache(maxsize=1)
def _script_table() -> np.ndarray:
    t = np.zeros(0x110000, np.uint8)
    for k, spans in enumerate([[(0xAC00, 0xD7A4), (0x1100, 0x1200), (0x3130, 0x3190)], [(0x3041, 0x3100), (0xFF66, 0xFFA0)], [(0x4E00, 0xA000), (0x3400, 0x4DC0), (0xF900, 0xFB00)], [(0xE01, 0xE5C)], [(0x41, 0x5B), (0x61, 0x7B), (0xFF21, 0xFF3B), (0xFF41, 0xFF5B)]], 1):
        for a, b in spans:
            t[a:b] = k
    t[[ord(c) for c in "äöüÄÖÜß"]] = 6
    return t


def tokenizer_id(tokenizer: str, folder: str = TOKENIZERS) -> str:
    """The tokenizer's name and the beginning of the SHA-256 of its file."""
    return f"{tokenizer}:{hashlib.sha256(Path(folder, f'{tokenizer}.tiktoken').read_bytes()).hexdigest()[:16]}"


def own_parts(chunks: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(doc_id, ord, own, p1, p2): each chunk's text without what it repeats of the chunk before, and a 128-bit name of it.

    Repeated rows count once, a null text is an empty one. Text moves once, by the unique key (doc_id, ord), on which
    neighbours meet without another shuffle.
    """
    rows = chunks.select("doc_id", "ord", "text").dropDuplicates(["doc_id", "ord"])
    ends = chunks.select("doc_id", (F.col("ord") + 1).alias("ord"), F.expr(f"right(text, {longest})").alias("before")).dropDuplicates(["doc_id", "ord"])
    own = rows.join(ends, ["doc_id", "ord"], "left").select("doc_id", "ord", F.coalesce(own_text(F.col("before"), F.col("text"), longest), F.lit("")).alias("own"))
    return own.select("*", F.xxhash64("own").alias("p1"), F.xxhash64(F.lit("second"), "own").alias("p2"))


def encoded_parts(parts: DataFrame, tokenizer: str, folder: str = TOKENIZERS) -> DataFrame:
    """(p1, p2, tokenizer, n_tokens, n_chars, hangul .. umlaut): every given part encoded."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = word_counts((tokenizer,), folder), _script_table()
        for batch in A.runs(batches, "own"):
            points, offsets = A.code_points(batch.column("own"))
            letters = np.bincount(A.rows_of(offsets) * 7 + table[points], minlength=len(batch) * 7).reshape(-1, 7)
            yield pa.RecordBatch.from_arrays(
                [batch.column("p1"), batch.column("p2"), pa.array(own.counts(batch.column("own").to_pylist())[0]), pa.array(np.diff(offsets)), *(pa.array(letters[:, k].astype(np.int64)) for k in range(1, 7))],
                names=["p1", "p2", "n_tokens", "n_chars", *SCRIPTS],
            )

    schema = "p1 long, p2 long, n_tokens long, n_chars long, " + ", ".join(f"{s} long" for s in SCRIPTS)
    found = parts.select("p1", "p2", "own").mapInArrow(work, schema)
    return found.select("p1", "p2", F.lit(tokenizer_id(tokenizer, folder)).alias("tokenizer"), "n_tokens", "n_chars", *SCRIPTS)


def summed(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, n_parts, n_tokens, n_chars, hangul .. umlaut) of each document, of its parts' counts.

    The xor of hashes of a document's parts and their places names its content, and needs no order.
    """
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_chars", *SCRIPTS)]
    both = parts.select("doc_id", "ord", "p1", "p2").join(counts, ["p1", "p2"])
    return both.groupBy("doc_id").agg(F.bit_xor(F.xxhash64("ord", "p1", "p2")).alias("h1"), F.bit_xor(F.xxhash64("p2", "p1", "ord")).alias("h2"), F.count("*").alias("n_parts"), *sums)


def clean_language(lang: Column) -> Column:
    """The language of its column: null if there is none, else the rows' own and the texts' letters must agree.

    A locale, upper case and stray blanks don't matter. A null or wrong value is replaced by what the letters say.
    """
    declared = F.nullif(F.regexp_extract(F.lower(F.trim(lang)), "^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit(""))
    letters = {"ko": F.col("hangul"), "ja": F.when(F.col("kana") * 5 > F.col("han"), F.col("kana") + F.col("han")).otherwise(F.lit(0)), "zh": F.when(F.col("kana") * 5 > F.col("han"), F.lit(0)).otherwise(F.col("han")), "th": F.col("thai"), "latin": (F.col("latin") + F.col("umlaut")) / LATIN_LETTERS}
    total = sum(letters.values(), F.lit(0))
    best = F.greatest(*letters.values())
    latin = F.when(F.col("umlaut") * UMLAUT > F.col("latin"), F.lit("de")).otherwise(F.lit("en"))
    seen = F.when(best <= 0, F.lit(None))
    for name, n in letters.items():
        seen = seen.when(n == best, latin if name == "latin" else F.lit(name))
    clear = best >= CLEAR * total
    both_latin = seen.isin("en", "de") & ~declared.isin("ko", "ja", "zh", "th")
    return F.coalesce(F.when(declared.isNull() | (clear & (declared != seen) & ~both_latin), seen), declared, F.lit(UNKNOWN))


def clean_format(fmt: Column, file_name: Column) -> Column:
    """The mapped format, trimmed, in lower case and by file ending; that of the file's name where it is null."""
    known = F.create_map(*(F.lit(x) for kv in FORMATS.items() for x in kv))
    ending = F.lower(F.regexp_extract(file_name, r"\.([^.]+)$", 1))
    own = F.regexp_replace(F.lower(F.trim(F.coalesce(fmt, ending))), r"^\.", "")
    return F.coalesce(F.try_element_at(known, own), F.nullif(own, F.lit("")), F.lit(UNKNOWN))


def clean_stage(stage: Column, rel_path: Column) -> Column:
    """The domain: the path's first part where it is null, and '' for files at the root."""
    first = F.when(F.size(F.split(rel_path, "/")) > 1, F.split(rel_path, "/")[0]).otherwise(F.lit(""))
    return F.trim(F.coalesce(stage, first, F.lit("")))


def _documents(counts: DataFrame, documents: DataFrame) -> DataFrame:
    """The snapshot: a row for each document; documents without chunks have no tokens, chunks without a document no dimensions."""
    rows = documents.select("doc_key", "source", "lang", "stage", "format", "rel_path", "file_name").filter("doc_key is not null").dropDuplicates(["doc_key"])
    both = rows.join(counts, rows.doc_key == counts.doc_id, "full").withColumn("doc_key", F.coalesce("doc_key", "doc_id")).filter("doc_key is not null")
    return both.select(
        "doc_key",
        "h1",
        "h2",
        F.coalesce("n_parts", F.lit(0)).alias("n_parts"),
        F.coalesce(F.trim("source"), F.lit(UNKNOWN)).alias("source"),
        clean_language(F.col("lang")).alias("lang"),
        clean_stage(F.col("stage"), F.col("rel_path")).alias("stage"),
        clean_format(F.col("format"), F.col("file_name")).alias("format"),
        F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
        F.coalesce("n_chars", F.lit(0)).alias("n_chars"),
    )


def deltas(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """Signed rows: what left the snapshot counts minus, what came plus; documents that stay the same give none."""
    plus = after.select("doc_key", *DIMENSIONS, "n_tokens", "n_chars", F.lit(1).alias("sign"))
    if before is None:
        return plus
    minus = before.select("doc_key", *DIMENSIONS, "n_tokens", "n_chars", F.lit(-1).alias("sign"))
    both = plus.unionByName(minus)
    kept = both.groupBy("doc_key", *DIMENSIONS, "n_tokens", "n_chars").agg(F.sum("sign").alias("sign"))
    return kept.filter("sign <> 0")


def update(chunks: DataFrame, documents: DataFrame, state: State | None = None, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, longest: int = LONGEST) -> State:
    """The state after the given chunks and documents, from that before them. See :func:`update_parts`."""
    return update_parts(saved(own_parts(chunks, longest)), documents, state, tokenizer, folder)


def update_parts(parts: DataFrame, documents: DataFrame, state: State | None = None, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> State:
    """The state after the given parts (doc_id, ord, own, p1, p2) and documents, from that before them.

    Only contents that ``state.counts`` lacks under this tokenizer are encoded, each once; what other tokenizers counted
    stays. Empty tables give empty totals. Null and empty texts have no tokens. Failed documents with chunks of an
    earlier run are counted like any other. The three tables are saved, so that a caller who writes them where it keeps
    them encodes nothing again.
    """
    name = tokenizer_id(tokenizer, folder)
    unseen = parts.select("p1", "p2", "doc_id", "ord")
    if state is not None:
        unseen = unseen.join(state.counts.filter(F.col("tokenizer") == name).select("p1", "p2"), ["p1", "p2"], "left_anti")
    one = unseen.groupBy("p1", "p2").agg(F.min(F.struct("doc_id", "ord")).alias("at")).select(F.col("at.doc_id").alias("d"), F.col("at.ord").alias("o"))
    chosen = parts.join(one, parts.doc_id.eqNullSafe(one.d) & parts.ord.eqNullSafe(one.o), "left_semi")
    counts = saved(encoded_parts(chosen, tokenizer, folder))
    if state is not None:
        counts = state.counts.unionByName(counts)
    mine = counts.filter(F.col("tokenizer") == name).drop("tokenizer")
    snapshot = saved(_documents(summed(parts, mine), documents).select(F.lit(name).alias("tokenizer"), "*"))
    before = None if state is None else state.snapshot.filter(F.col("tokenizer") == name)
    changes = deltas(before, snapshot)
    cube = changes.select(F.lit(name).alias("tokenizer"), *DIMENSIONS, F.col("sign").cast("long").alias("n_docs"), (F.col("sign") * F.col("n_tokens")).alias("n_tokens"), (F.col("sign") * F.col("n_chars")).alias("n_chars"))
    if state is not None:
        cube = cube.unionByName(state.cube.select("tokenizer", *DIMENSIONS, *MEASURES))
        snapshot = snapshot.unionByName(state.snapshot.filter(F.col("tokenizer") != name))
    cube = saved(cube.groupBy("tokenizer", *DIMENSIONS).agg(*(F.sum(m).alias(m) for m in MEASURES)).filter("n_docs <> 0"))
    return State(counts, snapshot, cube)


def earlier(parts: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parts, documents) of a store as it may have been before: half of the documents were there, in a sixteenth of these
    the first chunk read otherwise or another source was given, and another sixteenth of copies of them are gone since."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(32))
    old = parts.filter(place("doc_id") < 16)
    other = F.when((place("doc_id") == 0) & (F.col("ord") == 0), F.reverse("own")).otherwise(F.col("own"))
    old = old.select("doc_id", "ord", other.alias("own"))
    gone = old.filter(place("doc_id") == 1).withColumn("doc_id", F.concat(F.lit("gone-"), "doc_id"))
    both = old.unionByName(gone).select("*", F.xxhash64("own").alias("p1"), F.xxhash64(F.lit("second"), "own").alias("p2"))
    docs = documents.filter(place("doc_key") < 16).withColumn("source", F.when(place("doc_key") == 2, F.lit("moved")).otherwise(F.col("source")))
    return both, docs.unionByName(docs.filter(place("doc_key") == 1).withColumn("doc_key", F.concat(F.lit("gone-"), "doc_key")))


def slices(cube: DataFrame) -> DataFrame:
    """Totals by source, language and domain, by each of them, by format, and over all, for each tokenizer; ``slice`` names which.

    Dimensions that a slice adds up are null.
    """
    sets = [("source", "lang", "stage"), ("source",), ("lang",), ("stage",), ("format",), ()]
    name = F.concat_ws(",", *(F.when(F.grouping(d) == 0, F.lit(d)) for d in DIMENSIONS))
    rows = cube.groupingSets([("tokenizer", *s) for s in sets], "tokenizer", *DIMENSIONS).agg(name.alias("slice"), *(F.sum(m).alias(m) for m in MEASURES))
    return rows.select("tokenizer", F.when(F.col("slice") == "", "all").otherwise(F.col("slice")).alias("slice"), *DIMENSIONS, *MEASURES)
