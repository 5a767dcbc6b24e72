"""Repair of text from scanned pages (problem 4): furniture, broken words, misread characters, and reflow.

* Furniture. Digits masked, running headers repeat within a document, and page numbers are digits in a frame. A header
  that occurs once betrays itself by its width: a line of running text is broken only where the next word doesn't fit, so
  an open line after which the next word of the text would have fitted isn't part of it.
* Broken words. A line that ends in a hyphen goes on in the next line of the body, unless the corpus writes the word
  with its hyphen more often than without.
* Misread characters. Words are grouped by a skeleton in which confusable glyphs are one. A rare form is wrong if glyph
  confusions turn a frequent form of its group into it; of several such forms the one is right that stands beside the same
  neighbouring words most often. Confusions that are less usual count only if most neighbours support them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from quarry.llm.overlap import LONGEST, overlap_length, with_neighbours
from quarry.runtime import saved

#: Lines of a page are rarely longer; text that was not scanned has its paragraphs in one line. Up to this part of a scanned
#: document's lines may be all the same, as a table's row or two lines read as one.
PAGE_WIDTH, WIDE_LINES = 90, 0.2
#: A form is the misreading of another if that is at least so many times as frequent, and this frequent.
DOMINANCE, SUPPORT = 5, 4
#: The same for parts of words, which are of so many syllables or letters at least.
PART_DOMINANCE, PART_SUPPORT = 10, 20
PART_SYLLABLES, PART_LETTERS = 2, 6
#: ... and so many at most: a glyph further from both ends of a word is judged by the whole word only.
PART_LONGEST = 24
#: A masked line that isn't a sentence's end is a running header if a document has it so often.
REPEATS = 3
#: ... and if it is no wider than this part of the page's lines, as lines of running text may repeat too.
HEADER_PART = 0.8

# Glyphs and what they are misread as; for Hangul the parts of a syllable.
MISREAD = {"e": "c", "t": "f", "i": "l", "l": "1", "o": "0", "s": "5", "g": "9", "d": "cl", "m": "rn", "u": "ii", "h": "li", "w": "vv", "rn": "m", "0": "o", "5": "s", "8": "b", "1": "l"}
MISREAD_VOWEL = {"ㅏ": "ㅣ", "ㅓ": "ㅣㅕ", "ㅖ": "ㅔ", "ㅡ": "ㅠ", "ㅢ": "ㅚ", "ㅜ": "ㅡ", "ㅗ": "ㅛ"}
MISREAD_LEAD = {"ㅍ": "ㅁ", "ㅈ": "ㅊ", "ㄱ": "ㄲ", "ㄷ": "ㄸ", "ㅂ": "ㅃ"}
# Confusions in either direction that are less usual.
SIMILAR = [("e", "c"), ("t", "f"), ("i", "l"), ("l", "1"), ("o", "0"), ("s", "5"), ("g", "9"), ("g", "q"), ("b", "h"), ("b", "8"), ("u", "v"), ("n", "h"), ("d", "cl"), ("m", "rn"), ("u", "ii"), ("h", "li"), ("w", "vv")]
LEADS, VOWELS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ", "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
# The skeleton of each glyph. Glyphs read as two letters are spelt as two, so the order of confusions doesn't matter.
SKELETON = {"e": "c", "f": "t", "l": "i", "1": "i", "0": "o", "5": "s", "9": "g", "q": "g", "d": "ci", "m": "rii", "w": "iiii", "u": "ii", "v": "ii", "h": "ii", "b": "ii", "8": "ii", "n": "ii"}
SKELETON_VOWEL = {"ㅓ": "ㅏ", "ㅣ": "ㅏ", "ㅕ": "ㅏ", "ㅔ": "ㅖ", "ㅜ": "ㅡ", "ㅠ": "ㅡ", "ㅚ": "ㅢ", "ㅛ": "ㅗ"}
SKELETON_LEAD = {"ㅁ": "ㅍ", "ㅊ": "ㅈ", "ㄲ": "ㄱ", "ㄸ": "ㄷ", "ㅃ": "ㅂ"}

HYPHENS = "-‐­¬"
PAGE = re.compile(r"[^\w%]*(?:p\.|pp\.|page|seite|쪽)?\s*\d{1,4}\s*(?:(?:/|of|von)\s*\d{1,4})?\s*[^\w%,.]*\Z", re.IGNORECASE)
FRAMED = re.compile(r"[\[〈<(―·\-–—]\s*[\dOSBlI]{1,4}\s*[\]〉>)―·\-–—]\Z")
NUMBERED = re.compile(r"\d{1,4}\s{2,}\S|.*\s\|\s*\d{1,4}\Z")
NUMBERS = re.compile(r"[\d,.\s%]+\Z")
SENTENCE_END = re.compile(r"[.!?…。！？][\"”’“»)\]]*\s*\Z")
WORD = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")
LETTER = re.compile(r"[^\W\d_]")
FIRST_WORD = re.compile(r"\s*([^\W\d_]+)")
# a digit among small letters; then numbers that may hold letters, and codes that hold digits
DIGIT_IN_WORD = re.compile(r"(?<=[a-zäöüß])[0159](?=[a-zäöüß])|(?<=[a-zäöüß]{2})[0159]\Z|\A[0159](?=[a-zäöüß]{3})")
NUMBER = re.compile(r"(?<![\w-])[\dOSBlI]+(?:[.,][\dOSBlI]+)+|(?<![\w])\d[\dOSBlI]{2,}(?!\w)|(?<=[A-Z]-)[\dOSBlI]{3,}(?!\w)|(?<![\w-])(?:[OSlI]\d+|\d+[OSlI])(?!\w)")
CODE = re.compile(r"[A-Z]+[a-z]?\d|\d[A-Z]{1,2}\Z")


def skeleton(word: str) -> str:
    """The word with confusable glyphs made one; case does not count."""
    out = []
    for c in word.lower():
        if "가" <= c <= "힣":
            k = ord(c) - 0xAC00
            lead, vowel = LEADS[k // 588], VOWELS[k % 588 // 28]
            out.append(SKELETON_LEAD.get(lead, lead) + SKELETON_VOWEL.get(vowel, vowel) + chr(0x11A7 + k % 28))
        else:
            out.append(SKELETON.get(c, c))
    return "".join(out)


def _table(pairs: list[tuple[str, str]]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    return out


USUAL_TO = _table(list(MISREAD.items()))
SIMILAR_TO = _table([*MISREAD.items(), *SIMILAR, *((b, a) for a, b in SIMILAR)])


def is_misreading(true: str, seen: str, confusions: dict[str, list[str]] = USUAL_TO) -> bool:
    """Whether glyph confusions turn ``true`` into ``seen``; case does not count, and equal words are none."""
    a, b = true.lower(), seen.lower()
    if a == b:
        return False
    reach: dict[int, set[int]] = {0: {0}}  # by place in the true word: the places in the seen one that fit it
    for i in range(len(a)):
        for j in reach.pop(i, ()):
            if j < len(b) and a[i] == b[j]:
                reach.setdefault(i + 1, set()).add(j + 1)
            for n in (1, 2):
                for to in confusions.get(a[i : i + n], ()) if i + n <= len(a) else ():
                    if b.startswith(to, j):
                        reach.setdefault(i + n, set()).add(j + len(to))
            if j < len(b) and "가" <= a[i] <= "힣" and "가" <= b[j] <= "힣":
                x, y = ord(a[i]) - 0xAC00, ord(b[j]) - 0xAC00
                lead = LEADS[y // 588] in MISREAD_LEAD.get(LEADS[x // 588], "") and x % 588 == y % 588
                vowel = VOWELS[y % 588 // 28] in MISREAD_VOWEL.get(VOWELS[x % 588 // 28], "") and x // 588 == y // 588 and x % 28 == y % 28
                if lead or vowel:
                    reach.setdefault(i + 1, set()).add(j + 1)
        if not reach:
            return False
    return len(b) in reach.get(len(a), ())


def first_half(line: str) -> str | None:
    """The letters before the hyphen that a line ends with, if there are any; found from the line's end, in the time of their number."""
    bare = line.rstrip()
    if not bare or bare[-1] not in HYPHENS:
        return None
    end = start = len(bare) - 1
    while start and LETTER.match(bare, start - 1):
        start -= 1
    return bare[start:end] or None


def odd_number(line: str) -> bool:
    """Whether a number of the line holds a letter that stands for a digit."""
    return any(re.search(r"\d", m) and re.search(r"[OSBlI]", m) for m in NUMBER.findall(line))


def odd_word(word: str) -> bool:
    """Whether a word holds a digit that stands for a letter; codes such as CO2 don't."""
    return bool(DIGIT_IN_WORD.search(word)) and not CODE.search(word)


def _is_page_number(line: str) -> bool:
    return bool(line) and (bool(PAGE.match(line)) and not re.search(r"\d[.,]\d", line) or bool(FRAMED.match(line)))


def _lines(chunk_id: str, doc_id: str, order: int, text: str, before: str | None, after: str | None, longest: int) -> list[tuple]:
    """Of one chunk: for each line what can be told without the rest of the document."""
    cut = overlap_length(before, text, longest)
    lines = text.split("\n")
    shared = text[:cut].count("\n")
    following = (after or "")[overlap_length(text, after, longest) :].split("\n") if after else []
    own = lines[shared:]
    rows = []
    plain = [not (_is_page_number(x.strip()) or NUMBERED.match(x.strip()) or NUMBERS.match(x)) and bool(x.strip()) for x in own]
    width = max((len(x) for x, p in zip(own, plain) if p), default=0)
    open_ = [p and not SENTENCE_END.search(x) and first_half(x) is None for x, p in zip(own, plain)]

    def fits(i: int, skip: set[int]) -> bool:
        j = next((j for j in range(i + 1, len(own)) if plain[j] and j not in skip), None)
        return j is not None and len(own[i].rstrip()) + 1 + len(own[j].split(" ")[0]) <= width

    loose = {i for i in range(len(own)) if open_[i] and fits(i, set())}
    loose = {i for i in loose if fits(i, loose - {i})}
    for i, x in enumerate(own):  # a last line that breaks off and is much too short for it
        if open_[i] and not any(plain[i + 1 :]) and len(x) <= 0.6 * width and not following:
            loose.add(i)
    nexts = next((x for x in following if x.strip() and not _is_page_number(x.strip()) and not NUMBERED.match(x.strip())), None)
    for i, line in enumerate(lines):
        k = i - shared
        bare = line.strip()
        number = _is_page_number(bare) or bool(NUMBERED.match(bare))
        mask = re.sub(r"\W+", "", re.sub(r"\d+", "#", skeleton(line))) if k >= 0 and plain[k] and open_[k] and len(bare) <= HEADER_PART * width else None
        short = k >= 0 and plain[k] and fits(k, loose)
        rows.append((chunk_id, doc_id, order, i, line, i - shared, shared, len(own), number or k in loose, mask, bool(NUMBERS.match(line)), short, nexts))
    return rows


LINE_SCHEMA = "chunk_id string, doc_id string, ord int, line_no int, line string, own_no int, shared int, n_own int, loose boolean, mask string, numbers boolean, short boolean, next_head string"


class Scans(NamedTuple):
    """The chunks of scanned files with the ends of their neighbours, and the most characters of an overlap."""

    chunks: DataFrame
    longest: int


def scanned(chunks: DataFrame, documents: DataFrame, longest: int = LONGEST) -> Scans:
    """Distinct chunks of scanned pdf files, with the ends of their neighbours.

    A pdf is a scan if none of its chunks has headings and hardly any of its lines is wider than a page's, so that a wide
    line here and there changes nothing. Null texts are left out, null formats are no pdf.
    """
    bare = F.coalesce(F.size("headings"), F.lit(0)) <= 0
    rows = chunks.select("chunk_id", "doc_id", "ord", "text", bare.alias("bare"))
    widths = F.transform(F.split("text", "\n"), F.length)
    shape = rows.select("doc_id", "bare", F.coalesce(F.size(widths), F.lit(0)).alias("n"), F.coalesce(F.size(F.filter(widths, lambda w: w > PAGE_WIDTH)), F.lit(0)).alias("wide"))
    by_document = shape.groupBy("doc_id").agg(F.bool_and("bare").alias("bare"), F.sum("n").alias("n"), F.sum("wide").alias("wide")).filter(F.col("bare") & (F.col("wide") <= F.col("n") * WIDE_LINES))
    pdf = documents.filter(F.lower(F.trim("format")) == "pdf").select(F.col("doc_key").alias("doc_id")).distinct()
    scans = by_document.select("doc_id").join(pdf, "doc_id", "left_semi")
    kept = rows.filter("bare and text is not null").join(scans, "doc_id", "left_semi").dropDuplicates(["doc_id", "ord"])
    return Scans(with_neighbours(saved(kept.drop("bare")), True, longest), longest)


def lines(scans: Scans) -> DataFrame:
    """One row for each line: its place, whether it is shared with the chunk before, and whether it is ``furniture``."""
    longest = scans.longest

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in LINE_SCHEMA.split(", ")]
        for f in frames:
            yield pd.DataFrame([r for x in zip(f.chunk_id, f.doc_id, f.ord, f.text, f.before, f.after) for r in _lines(*x, longest)], columns=names)

    # the masks of a document's lines, counted once in each line's own chunk
    found = saved(scans.chunks.select("chunk_id", "doc_id", "ord", "text", "before", "after").mapInPandas(work, LINE_SCHEMA))
    often = found.filter("own_no >= 0 and mask is not null and length(mask) > 3").groupBy("doc_id", "mask").count().filter(F.col("count") >= REPEATS).select("doc_id", "mask", F.lit(True).alias("often"))
    return found.join(often, ["doc_id", "mask"], "left").withColumn("furniture", F.col("loose") | F.coalesce("often", F.lit(False))).drop("often", "mask", "loose")


@F.pandas_udf(T.ArrayType(T.StringType()))
def words_of(line: pd.Series) -> pd.Series:
    """The words of a line, a word and its hyphen being one."""
    return line.map(lambda t: WORD.findall(t or ""))


@F.pandas_udf(T.StringType())
def skeleton_of(word: pd.Series) -> pd.Series:
    return word.map(skeleton)


@F.pandas_udf(T.ArrayType(T.StringType()))
def affixes(word: pd.Series) -> pd.Series:
    """A word as ``<word>``, its beginnings ``<wo`` and its ends ``rd>``: of two syllables or six letters at least, and PART_LONGEST at most."""
    out = []
    for w in word:
        part = range(PART_SYLLABLES if re.search("[가-힣]", w) else PART_LETTERS, min(len(w), PART_LONGEST + 1))
        out.append([f"<{w}>", *(f"<{w[:k]}" for k in part), *(f"{w[-k:]}>" for k in part)])
    return pd.Series(out)


@F.pandas_udf(T.StringType())
def repaired(word: pd.Series, key: pd.Series, good: pd.Series) -> pd.Series:
    """A word whose part ``key`` is put right."""
    out = []
    for w, a, b in zip(word, key, good):
        n, b = len(a.strip("<>")), b.strip("<>")
        out.append(b if len(w) == n else b + w[n:] if a[0] == "<" else w[: len(w) - n] + b)
    return pd.Series(out)


@F.pandas_udf(T.StructType([T.StructField("bad_side", T.StringType()), T.StructField("good_side", T.StringType())]))
def other_sides(word: pd.Series, right: pd.Series, part: pd.Series) -> pd.DataFrame:
    """Of a word judged by one side, the parts from the other side up to the changed glyph, as it is and as put right."""
    out = []
    for w, r, p in zip(word, right, part):
        i = next((i for i, (x, y) in enumerate(zip(w, r)) if x != y), 0)
        if p[0] == "<" and p[-1] == ">" or len(w) != len(r):
            out.append((None, None))
        else:
            out.append((f"{w[i:]}>", f"{r[i:]}>") if p[0] == "<" else (f"<{w[: i + 1]}", f"<{r[: i + 1]}"))
    return pd.DataFrame(out, columns=["bad_side", "good_side"])


@F.pandas_udf(T.IntegerType())
def misreads(true: pd.Series, seen: pd.Series) -> pd.Series:
    """1 if usual confusions turn the one into the other, 2 if it takes others or another direction and makes no digit, else 0."""
    return pd.Series([1 if is_misreading(a, b) else 2 if not re.search(r"\d", b) and is_misreading(a, b, SIMILAR_TO) else 0 for a, b in zip(true, seen)], dtype="int32")


def by_context(candidates: DataFrame, body: DataFrame) -> DataFrame:
    """(word, part, right): of each word's candidates (word, part, right, n_good, kind) the one that its neighbours support most.

    A neighbour is the word before or after in the line. A candidate's support is how often the corpus has it beside the
    neighbours that the word has, counted before the join. Without support the most frequent one is right; a candidate
    by unusual confusions must be known beside at least half of the word's neighbours.
    """
    words = F.transform("words", F.lower)
    beside = body.select(F.explode(F.arrays_zip(F.slice(words, 1, F.greatest(F.size("words") - 1, F.lit(0))).alias("a"), F.slice(words, 2, F.greatest(F.size("words") - 1, F.lit(0))).alias("b"))).alias("p"))
    pairs = beside.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("form"), F.lit(0).alias("side"), F.col("b").alias("other"), "n"), F.struct(F.col("b").alias("form"), F.lit(1).alias("side"), F.col("a").alias("other"), "n"))).alias("s")).select("s.*")
    several = W.Window.partitionBy("word")
    rows = saved(candidates.withColumn("several", (F.count("*").over(several) > 1) | (F.col("kind") > 1)))
    open_ = rows.filter("several").select("word", "right").distinct()
    forms = open_.select(F.explode(F.array("word", "right")).alias("form")).distinct()
    sides = saved(sides.join(forms, "form", "left_semi"))
    own = open_.join(sides.select(F.col("form").alias("word"), "side", "other"), "word").withColumn("places", F.count("*").over(W.Window.partitionBy("word", "right")))
    support = own.join(sides.withColumnRenamed("form", "right"), ["right", "side", "other"]).groupBy("word", "right").agg(F.sum("n").alias("support"), (F.count("*") * 2 >= F.max("places")).alias("mostly"))
    ranked = rows.join(support, ["word", "right"], "left").withColumn("support", F.coalesce("support", F.lit(0))).filter("kind = 1 or mostly")
    best = W.Window.partitionBy("word").orderBy(F.col("support").desc(), F.col("kind"), F.col("n_good").desc(), F.col("right"))
    return ranked.withColumn("place", F.row_number().over(best)).filter("place = 1").select("word", "part", "right")


@F.pandas_udf(T.StructType([T.StructField("first", T.StringType()), T.StructField("rest", T.StringType())]))
def broken_word(line: pd.Series, following: pd.Series) -> pd.DataFrame:
    """The two parts of a word that a line's last hyphen breaks; null if the next line doesn't go on with a small letter."""
    out = []
    for a, b in zip(line, following):
        first, n = first_half(a or ""), FIRST_WORD.match(b or "")
        out.append((first, n[1]) if first and n and n[1][0].islower() else (None, None))
    return pd.DataFrame(out, columns=["first", "rest"])


@F.pandas_udf(T.BooleanType())
def odd_characters(line: pd.Series) -> pd.Series:
    return line.map(lambda t: odd_number(t or "") or any(map(odd_word, WORD.findall(t or "")))).astype(bool)


def analysed(scans: Scans) -> tuple[DataFrame, DataFrame]:
    """(own lines with their findings, all lines). Findings: furniture, hyphen, joined, wrong (misread words of the line) and right."""
    every = saved(lines(scans))
    own = every.filter("own_no >= 0")
    later = W.Window.partitionBy("chunk_id").orderBy("line_no").rowsBetween(1, W.Window.unboundedFollowing)
    body = own.withColumn("following", F.coalesce(F.first(F.when(~F.col("furniture"), F.col("line")), ignorenulls=True).over(later), "next_head")).filter("not furniture")
    body = saved(body.withColumn("part", broken_word("line", "following")).withColumn("words", words_of("line")).withColumn("odd", odd_characters("line")))
    count = body.select(F.explode("words").alias("word")).groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"))
    count = saved(count)
    # words broken by the layout: written with the hyphen less often than without
    parts = body.filter("part.first is not null").select("chunk_id", "line_no", F.lower(F.concat("part.first", "part.rest")).alias("joined"), F.lower(F.concat_ws("-", "part.first", "part.rest")).alias("compound"))
    together = count.select(F.col("word").alias("joined"), F.col("n").alias("n_joined"))
    apart = count.select(F.col("word").alias("compound"), F.col("n").alias("n_compound"))
    hyphens = parts.join(together, "joined", "left").join(apart, "compound", "left").filter(F.coalesce("n_joined", F.lit(0)) >= F.coalesce("n_compound", F.lit(0))).select("chunk_id", "line_no", "joined", F.lit(True).alias("hyphen"))
    # misread forms: a frequent form of the same skeleton turns into them
    split_words = hyphens.groupBy(F.col("joined").alias("word")).agg(F.count("*").alias("n"))
    forms = saved(count.unionByName(split_words).groupBy("word").agg(F.sum("n").alias("n")).filter(F.length("word") > 1))
    # each form with its beginnings and ends, so that rare words are judged by parts that many words share
    parts_of = saved(forms.select("word", "n", F.explode(affixes("word")).alias("key")))
    keys = parts_of.groupBy("key").agg(F.sum("n").alias("n")).withColumn("skeleton", skeleton_of("key"))
    keys = saved(keys)
    whole = F.col("key").startswith("<") & F.col("key").endswith(">")
    often = keys.filter(F.col("n") >= F.when(whole, SUPPORT).otherwise(PART_SUPPORT)).select("skeleton", F.col("key").alias("good"), F.col("n").alias("n_good"))
    enough = F.col("n") * F.when(whole, DOMINANCE).otherwise(PART_DOMINANCE) <= F.col("n_good")
    bad = keys.join(often, "skeleton").filter((F.col("key") != F.col("good")) & enough).withColumn("kind", misreads("good", "key")).filter((F.col("kind") == 1) | whole & (F.col("kind") == 2))
    # the longest part of a word that is wrong decides; all forms that it may stand for are candidates
    judged = parts_of.select("word", "key").join(bad.select("key", "good", "n_good", "kind"), "key").withColumn("least", F.min("kind").over(W.Window.partitionBy("word", "key")))
    judged = judged.withColumn("place", F.dense_rank().over(W.Window.partitionBy("word").orderBy("least", F.length("key").desc(), F.col("key").desc()))).filter("place = 1")
    wrong = by_context(judged.select("word", F.col("key").alias("part"), repaired("word", "key", "good").alias("right"), "n_good", "kind"), body)
    # seen from its other side the glyph must not be usual: the beginning of a word up to it, if its end was judged
    wrong = wrong.withColumn("sides", other_sides("word", "right", "part")).join(forms.withColumnRenamed("n", "n_word"), "word")
    usual = keys.select(F.col("key").alias("bad_side"), F.col("n").alias("n_bad"))
    better = keys.select(F.col("key").alias("good_side"), F.col("n").alias("n_good"))
    wrong = wrong.select("word", "right", "n_word", "sides.*").join(usual, "bad_side", "left").join(better, "good_side", "left").filter((F.coalesce("n_bad", F.lit(0)) <= F.col("n_word")) | (F.col("n_bad") <= F.coalesce("n_good", F.lit(0)))).select("word", "right")
    wrong = saved(wrong)
    tokens = body.select("chunk_id", "line_no", F.explode("words").alias("seen")).withColumn("word", F.lower("seen"))
    found = tokens.join(wrong, "word").groupBy("chunk_id", "line_no").agg(F.collect_list("seen").alias("wrong"), F.collect_list("right").alias("right"))
    in_two = hyphens.join(wrong.withColumnRenamed("word", "joined"), "joined").select("chunk_id", "line_no", F.col("right").alias("whole"))
    out = own.join(hyphens, ["chunk_id", "line_no"], "left").join(found, ["chunk_id", "line_no"], "left").join(in_two, ["chunk_id", "line_no"], "left").join(body.select("chunk_id", "line_no", "odd", "part"), ["chunk_id", "line_no"], "left")
    return saved(out.drop("next_head")), every


def _misread_in_parts(first: Column, whole: Column) -> Column:
    """Whether the part of a broken word on its first line differs from the right word."""
    return F.lower(first) != F.substring(whole, 1, F.length(first))


def found(scans: Scans) -> DataFrame:
    """(chunk_id, line_no, kind) of the lines of scanned chunks that are furniture, hyphen or misread.

    ``line_no`` counts the text's lines from 0, overlap included; what was found in a line holds for its copy in the
    overlap of the next chunk too. Texts without lines, null texts and chunks of other files give no rows.
    """
    own, every = analysed(scans)
    broken = F.col("whole").isNotNull()
    here = broken & _misread_in_parts(F.col("part.first"), F.col("whole"))
    next_line = own.filter(broken & ~here).select("chunk_id", (F.col("line_no") + 1).alias("line_no"), F.lit(True).alias("from_above"))
    own = own.join(next_line, ["chunk_id", "line_no"], "left").withColumn("misread", ~F.col("furniture") & (F.coalesce("odd", F.lit(False)) | F.col("wrong").isNotNull() | here.eqNullSafe(True) | F.coalesce("from_above", F.lit(False))))
    kinds = own.select("chunk_id", "doc_id", "ord", "line_no", "n_own", "own_no", "furniture", F.coalesce("hyphen", F.lit(False)).alias("hyphen"), "misread", "odd", "wrong", "line")
    # the copies in the overlap of the next chunk, whose first line may be cut
    copies = every.filter("own_no < 0").select("chunk_id", "doc_id", (F.col("ord") - 1).alias("ord"), "line_no", (-F.col("own_no")).alias("from_end"), F.col("line").alias("copy"))
    source = kinds.withColumn("from_end", F.col("n_own") - F.col("own_no")).drop("chunk_id", "line_no", "n_own", "own_no")
    copied = copies.join(source, ["doc_id", "ord", "from_end"])
    still = (F.col("line_no") > 0) | F.exists("wrong", lambda w: F.col("copy").contains(w)).eqNullSafe(True) | (F.col("odd").eqNullSafe(True) & odd_characters("copy"))
    copied = copied.withColumn("misread", F.col("misread") & still)
    both = kinds.select("chunk_id", "line_no", "furniture", "hyphen", "misread").unionByName(copied.select("chunk_id", "line_no", "furniture", "hyphen", "misread"))
    named = F.array(*(F.when(F.col(k), F.lit(k)) for k in ("furniture", "hyphen", "misread")))
    return both.select("chunk_id", "line_no", F.explode(F.array_compact(named)).alias("kind"))


@F.pandas_udf(T.StringType())
def corrected(line: pd.Series, wrong: pd.Series, right: pd.Series) -> pd.Series:
    """The line with its misread words replaced; a capital first letter stays one."""
    out = []
    for text, bad, good in zip(line, wrong, right):
        for a, b in zip(bad if bad is not None else (), good if good is not None else ()):
            text = re.sub(rf"(?<!\w){re.escape(a)}(?!\w)", lambda m, b=b: b.capitalize() if m[0][0].isupper() else b, text)
        out.append(text)
    return pd.Series(out)


def paragraphs(scans: Scans) -> DataFrame:
    """(chunk_id, paragraph, text): the repaired text of scanned chunks, furniture gone and lines joined.

    Windows over each chunk's lines number the paragraphs: one ends with a line that ends a sentence though the next word
    would have fitted, and lines of numbers stand alone. The overlap with the chunk before is left out.
    """
    own, _ = analysed(scans)
    order = W.Window.partitionBy("chunk_id").orderBy("line_no")
    body = own.filter("not furniture").withColumn("text", corrected("line", "wrong", "right"))
    over = F.lag(F.col("short") | F.col("numbers")).over(order)
    body = body.withColumn("paragraph", F.sum(F.coalesce((over | F.col("numbers")).cast("int"), F.lit(0))).over(order).cast("int"))
    piece = F.when(F.col("hyphen"), F.regexp_replace("text", rf"[{HYPHENS}]\s*$", "")).otherwise(F.concat(F.rtrim("text"), F.lit(" ")))
    grouped = body.groupBy("chunk_id", "paragraph").agg(F.sort_array(F.collect_list(F.struct("line_no", piece.alias("piece")))).alias("parts"))
    return grouped.select("chunk_id", "paragraph", F.trim(F.array_join("parts.piece", "")).alias("text"))
