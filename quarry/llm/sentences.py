"""Sentence boundaries across languages and scripts (problem 8), by cascading tables of break and no-break rules.

A rule is a pair of regular expressions: one for what stands before a position, one for what stands after it. At every
position where a sentence may end the tables are tried in order, that of the language first, then the one for all; the
first rule that matches decides. Positions are found on a shadow of the text in which every character stands for one of
the text, so offsets need no repair: look-alike letters and blanks are brought together, invisible characters left out
with their places remembered.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import arrow_text as A
from quarry.llm.lookalike import BLANKS, INVISIBLE, SAME_GLYPH

OPENERS = "“‘„‚«‹「『《〈（(\\[【〔\"'"
CLOSERS = "\"'”’»›」』》〉）)\\]】〕"
HANGUL = "가-힣ᄀ-ᇿ"
KANA = "ぁ-ヿ"
HAN = "一-鿿々"
THAI = "ก-๛"
B, N = True, False  # break, no break

# Abbreviations after which no sentence ends, whatever follows.
ALWAYS = "Mr|Mrs|Ms|Dr|Prof|St|Sr|Jr|vs|cf|e\\.g|i\\.e|eg|ie|approx|ca|bzw|vgl|z\\.? ?B|d\\.? ?h|u\\.? ?a|z\\.? ?T|sog|inkl|ggf|evtl|bspw|Hr|Fr|Dipl|Ing|al"
# Abbreviations that stand before a number or a name.
BEFORE_NUMBER = "No|Nos|Nr|Fig|Figs|Eq|Sec|Ch|Vol|Ver|Art|Abs|Tab|Abb|Bd|Kap|App|Ref|pp|p|S|Rev|Bl|Ziff"
MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|January|February|March|May|June|July|October|December"

Rule = tuple[bool, str, str]
#: By language, (break?, before, after); `before` ends at the position, `after` starts there and includes the blank.
TABLES: dict[str, list[Rule]] = {
    "ko": [
        (N, rf"[{CLOSERS}]", r"\s*(?:이?라고|이?라는|이?라며|이?란|이?라면|하고|하며|하는)|[고는라을를이가의에로와과은도]"),
        (N, r"…+|\.\.+", r"\s*\S"),
        (N, r"\d\.", rf"\s*[\d({HANGUL}]"),
    ],
    "ja": [
        (N, rf"[{CLOSERS}]", rf"\s*(?:[とはがをにでのもへや、，・]|から|まで|より|という|など)"),
        (N, r"…+|‥+|\.\.+", r"\s*\S"),
    ],
    "zh": [
        (N, rf"[{CLOSERS}]", r"\s*(?:[的，、；：,地得]|等(?!待)|之|一[事词句文案]|这[个一类种样句])"),
        (N, r"…+|\.\.+", r"\s*\S"),
    ],
    "de": [
        (N, rf"\d{{1,2}}\.", rf"\s+(?:{MONTHS})\b"),
        (N, r"(?<![\w\-.,])\d{1,2}\.", r"\s+\d"),
        (N, rf"\b(?:{ALWAYS}|{BEFORE_NUMBER}|z|d)\.", r"\s"),
    ],
    "en": [],
    "th": [
        (N, r"\b(?:[ก-ฮ]\.)+", r""),
        (B, rf"[{THAI}]", rf"\s+[{THAI}{OPENERS}]"),
        (B, rf"ฯ|ๆ", rf"\s+[{THAI}]"),
        (N, r"\s|.", r"\s"),
    ],
    "*": [
        (N, rf"\b(?:{ALWAYS})\.", r"\s"),
        (N, rf"\b(?:{BEFORE_NUMBER})\.", r"\s*\d"),
        (N, rf"\b(?:Ltd|Inc|Co|Corp|a\.m|p\.m|etc|et al)\.", r"\s*[a-zäöüß,;:]"),
        (N, r"(?:^|[\s(])[A-ZÄÖÜ]\.", r"\s+[A-ZÄÖÜ]"),
        (N, r"", r"\s*[,;:，、；：]"),
        (N, rf"[.!?…][{CLOSERS}“‘]*", r"\s*[a-zäöüß]"),
        (N, r"\.", r"[\d/\\@_\-]"),
        (B, rf"[。！？｡]+[{CLOSERS}]*", r""),
        (B, rf"[.!?…][{CLOSERS}“‘]*", r"\s"),
        (B, rf"[{HANGUL}][.!?]+[{CLOSERS}]*", rf"[\w{OPENERS}]"),
        (B, r"[a-zäöüß]{2}[.!?]", r"[A-ZÄÖÜ][a-zäöüß ]|[A-Z]+[a-z]?\d|\d[A-Z]\b"),
        (B, rf"[.!?][”’»」』)]+", rf"[A-ZÄÖÜ{HANGUL}{OPENERS}]"),
        (N, r"", r""),
    ],
}
# Hangul before a full stop and a digit or letter right after it is a sentence end, not a number or a file's ending.
TABLES["ko"].append((B, rf"[{HANGUL}][.!?]+[{CLOSERS}]*", rf"[\dA-Z{HANGUL}{OPENERS}]"))
TABLES["ko"].append((N, r"[\w]\.", r"\w"))

#: Where a sentence may end: end marks with their closing marks. German closes with the mark that others open with.
ENDS = {lang: re.compile(rf"(?:[.!?。！？｡…‥]+[{CLOSERS}{'“‘' if lang == 'de' else ''}]*)+") for lang in TABLES}
ENDS["th"] = re.compile(rf"(?:[.!?。！？…]+[{CLOSERS}]*)+|(?<=[{THAI}{CLOSERS}])(?=\s)")
LIST_MARK = re.compile(r"[ \t]*(?:[-–—•·○●◦▪▫■□◆◇▶►※*∙]|[①-⑳]|[ⅰ-ⅹⅠ-Ⅹ]\.|\(\d{1,2}\)|\d{1,2}\))\s")
LINE = re.compile(r"\r\n|[\n\r  \x0b\x0c\x85]")
FUNCTION_WORDS = {lang: re.compile(rf"\b(?:{words})\b") for lang, words in {"en": "the|of|and|was|is|to|in|by|for|with|are|were|not", "de": "der|die|das|und|wurde|nach|ist|für|nicht|mit|den|eine|werden"}.items()}
SCRIPTS = [("th", re.compile(rf"[{THAI}]")), ("ko", re.compile(rf"[{HANGUL}]")), ("ja", re.compile(rf"[{KANA}]")), ("zh", re.compile(rf"[{HAN}]"))]
WINDOW = 32
#: A paragraph of Latin letters is told by its words if it has so many characters, else it has the text's language.
SHORT_BLOCK = 40


@lru_cache(maxsize=1)
def _shadow_tables() -> tuple[dict[int, int], re.Pattern]:
    one = {ord(a): ord(b) for a, b in SAME_GLYPH.items() if len(b) == 1}
    one |= {c: c - 0xFEE0 for c in range(0xFF10, 0xFF5B) if chr(c - 0xFEE0).isalnum()} | {0xFF0E: 0x2E}
    one |= {b: 0x20 for b in BLANKS if b != 9}
    return one, re.compile("[" + "".join(map(chr, INVISIBLE)) + "]|([ᄀ-ᄒ][ᅡ-ᅵ][ᆨ-ᇂ]?)")


@lru_cache(maxsize=1)
def _rules() -> dict[str, list[tuple[bool, re.Pattern, re.Pattern]]]:
    return {lang: [(kind, re.compile(rf"(?:{before})\Z"), re.compile(after)) for kind, before, after in (*(TABLES[lang] if lang != "*" else ()), *TABLES["*"])] for lang in TABLES}


def language_of(text: str) -> str:
    """The language whose table comes first, by the text's own letters: the column may be null or wrong."""
    counts = {lang: len(p.findall(text)) for lang, p in SCRIPTS}
    latin = len(re.findall(r"[A-Za-zÄÖÜäöüß]", text)) / 6  # letters of words about as informative as one syllable
    if counts["ja"] * 5 > counts["zh"] and counts["ja"] > counts["ko"]:
        counts["ja"] += counts["zh"]
    best = max(counts, key=counts.get)
    if counts[best] and counts[best] >= latin:
        return best
    return max(FUNCTION_WORDS, key=lambda lang: len(FUNCTION_WORDS[lang].findall(text))) if latin else "*"


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches that can hold a sentence: blank lines end them, and a list mark starts one."""
    start, end, at = -1, 0, 0
    for m in (*LINE.finditer(text), None):
        stop = m.start() if m else len(text)
        if not text[at:stop].strip():
            if start >= 0:
                yield start, end
            start = -1
        else:
            if start >= 0 and LIST_MARK.match(text, at):
                yield start, end
                start = -1
            start = at if start < 0 else start
            end = stop
        at = m.end() if m else stop
    if start >= 0:
        yield start, end


def _shadow(text: str) -> tuple[str, list[int] | None]:
    """The text's shadow, and the place in the text of each of its characters; None if they are the same.

    Invisible characters have no shadow, and conjoining jamo one for each syllable.
    """
    one, special = _shadow_tables()
    shadow = text.translate(one)
    if not special.search(shadow):
        return shadow, None
    parts, place, at = [], [], 0
    for m in special.finditer(shadow):
        parts.append(shadow[at : m.start()])
        place.extend(range(at, m.start()))
        if m[1]:
            parts.append(unicodedata.normalize("NFC", m[1]))
            place.append(m.start())
        at = m.end()
    parts.append(shadow[at:])
    place.extend(range(at, len(shadow)))
    return "".join(parts), place


def _language_of_block(block: str, whole: str) -> str:
    """A paragraph's own language: a text may hold several. Latin letters decide only if there are no others, and enough."""
    if any(p.search(block) for _, p in SCRIPTS):
        return max(((len(p.findall(block)) * (5 if lang == "ja" else 1), lang) for lang, p in SCRIPTS))[1]
    if whole in FUNCTION_WORDS or len(block) < SHORT_BLOCK:
        return whole
    return language_of(block)


def starts(text: str | None) -> list[int]:
    """Offsets of the first characters of a text's units; none for null, empty and blank texts."""
    if not text or text.isspace():
        return []
    shadow, place = _shadow(text)
    whole = language_of(shadow)
    out = []
    for start, end in _blocks(shadow):
        while start < end and shadow[start].isspace():
            start += 1
        out.append(start)
        mark = LIST_MARK.match(shadow, start, end)
        begin = mark.end() if mark else start
        lang = _language_of_block(shadow[begin:end], whole)
        rules = _rules()[lang]
        for m in ENDS[lang].finditer(shadow, begin, end):
            p = m.end()
            seen = p  # the window after the mark starts at the last blank before the next visible character
            while seen < end and shadow[seen].isspace():
                seen += 1
            if seen == end:
                continue
            before, after = shadow[max(begin, p - WINDOW) : p], shadow[max(p, seen - 1) : min(end, seen + WINDOW)].replace("\n", " ")
            for kind, left, right in rules:
                if right.match(after) and left.search(before):
                    if kind:
                        while shadow[p].isspace():
                            p += 1
                        if p > out[-1]:
                            out.append(p)
                    break
    return out if place is None else [place[i] for i in out]


def sentences(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start_pos): the first character of every unit of every document, in code points from 0.

    A row has no units where its text is null, empty or blank; a repeated row gives its units again. Needs no shuffle.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.runs(batches, text):
            found = [starts(t) for t in batch.column(text).to_pylist()]
            rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows, pa.int64())), pa.array([p for f in found for p in f], pa.int32())], names=[key, "start_pos"])

    return documents.select(key, text).mapInArrow(work, f"{key} {documents.schema[key].dataType.simpleString()}, start_pos int")


def plain_documents(documents: DataFrame) -> DataFrame:
    """The rows that were read well from plain text files: status ok and format txt, trimmed and in lower case."""
    return documents.filter((F.col("status") == "ok") & (F.lower(F.trim("format")) == "txt"))
