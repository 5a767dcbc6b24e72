"""Text as column expressions: all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
#: Characters for each token of overlap, and how far into the tail a word may be cut away.
CHARS_PER_TOKEN, NEAR = 2.5, 40
TERM = r"[\p{L}\p{N}_]{2,}"
HEADING_MAX = 60
# Line beginnings of Korean outlines, in the order in which they are tried, and their heading levels.
HEADINGS = [
    (r"^제{b}*\p{Nd}+{b}*[장부편]{b}", 1),
    (r"^제{b}*\p{Nd}+{b}*[절관]{b}", 2),
    (r"^\p{Nd}+\.{b}*{s}", 2),
    (r"^\p{Nd}+\.\p{Nd}+\.?{b}*{s}", 3),
    (r"^\p{Nd}+\.\p{Nd}+\.\p{Nd}+\.?{b}*{s}", 4),
    (r"^[가-하]\.{b}*{s}", 3),
    (r"^[□■◇◆▣]{b}*{s}", 3),
    (r"^[○●◎]{b}*{s}", 4),
    (r"^[(（]{b}*\p{Nd}+{b}*[)）]{b}*{s}", 4),
]
# Ends of Korean sentences.
SENTENCE_ENDS = ("다.", "요.", "임.", "함.")


def strip(text: Column) -> Column:
    """Without blanks of any script at both ends."""
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")


def flat(text: Column) -> Column:
    """Every run of blanks one space, none at the ends."""
    return strip(F.regexp_replace(text, rf"{BLANK}+", " "))


def heading_level(line: Column, most_specific: bool = False) -> Column:
    """The heading level of an outline line; null if it is none.

    Long lines, ends of sentences, dates and lines without a letter are none. The first rule that matches decides, so
    ``1.1 x`` has the level of ``1. x``; ``most_specific`` tries the longer numbers first.
    """
    rules = [(p.replace("{b}", BLANK).replace("{s}", r"[^\s\p{Z}]"), n) for p, n in HEADINGS]
    if most_specific:
        rules = [*rules[:2], rules[4], rules[3], rules[2], *rules[5:]]
    sentence = F.lit(False)
    for end in SENTENCE_ENDS:
        sentence = sentence | line.endswith(end)
    none = (F.length(line) > HEADING_MAX) | sentence | line.rlike(rf"^{BLANK}*\p{{Nd}}{{4}}{BLANK}*[.\-/년]") | ~line.rlike("[가-힣A-Za-z]")
    level = F.when(none | line.isNull(), F.lit(None).cast("int"))
    for pattern, n in rules:
        level = level.when(line.rlike(pattern), n)
    return level


def promoted(line: Column) -> Column:
    """The line as a Markdown heading if it is one, else as it is."""
    level = heading_level(line)
    return F.when(level.isNull(), line).otherwise(F.concat(F.repeat(F.lit("#"), F.least(level, F.lit(6))), F.lit(" "), line))


def unglued(text: Column) -> Column:
    """Lost line breaks between table rows put back: two bars without a blank between them never stand in one row."""
    return F.regexp_replace(text, r"\|(?=\|)", "|\n")


def long_enough(body: Column, least: int = 30) -> Column:
    """Whether a chunk's body, without blanks at its ends, is kept."""
    return F.length(strip(body)) >= least


def tail(body: Column, overlap_tokens: Column) -> Column:
    """The end of a body that the next chunk repeats: some characters for each token, from the first word that is whole."""
    n = F.floor(overlap_tokens * F.lit(CHARS_PER_TOKEN)).cast("int")
    end = F.when(n <= 0, F.lit("")).otherwise(F.right(body, n))
    at = F.locate(" ", end)
    return F.when(at.between(1, NEAR), F.substring(end, at + 1, F.length(end))).otherwise(end)


def with_tail(before: Column, body: Column) -> Column:
    """The body after the tail of the one before it, on a line of its own; nothing if there is no tail."""
    return F.when(F.coalesce(before, F.lit("")) == "", body).otherwise(F.concat(before, F.lit("\n"), body))


def html_cell(text: Column) -> Column:
    """A cell of a table from markup or a sheet: bars escaped."""
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def native_cell(text: Column) -> Column:
    """A cell of a native table: line breaks become spaces, bars an entity."""
    return strip(F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("&#124;")))


def text_hash(model_id: str, text: Column) -> Column:
    """The cache key of a text under a model."""
    return F.sha2(F.concat(F.lit(model_id), F.char(F.lit(0)), text), 256)


def model_slug(model_id: Column) -> Column:
    """The model's name as a folder's."""
    return F.replace(F.replace(model_id, F.lit("/"), F.lit("__")), F.lit(":"), F.lit("_"))


def prefixed(prefix: str, text: Column) -> Column:
    """A passage or query with the prefix that its model wants."""
    return F.concat(F.lit(prefix), text)


def terms(text: Column) -> Column:
    """The terms of a text: runs of two or more letters, digits and underscores, in lower case; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


def snippet(text: Column, full: bool = False) -> Column:
    """The beginning of a hit on one line."""
    return text if full else F.replace(F.substring(text, 1, 400), F.lit("\n"), F.lit(" "))


def breadcrumb(headings: Column, page_no: Column) -> Column:
    """The path of headings, and the page if there is one."""
    path = F.array_join(F.coalesce(headings, F.array().cast("array<string>")), " > ")
    return F.when(F.coalesce(page_no, F.lit(0)) > 0, F.concat(path, F.lit(" p."), page_no.cast("string"))).otherwise(path)


def error_note(kind: Column, message: Column) -> Column:
    """A failure in 500 characters."""
    return F.substring(F.concat_ws(": ", kind, message), 1, 500)


def backend_note(backend: Column) -> Column:
    """'' for the primary reader, else its name."""
    return F.when(F.coalesce(backend, F.lit("primary")) == "primary", "").otherwise(F.concat(F.lit("backend:"), backend))


def first_page(pages: Column) -> Column:
    """The first page number that is one, of an array."""
    return F.get(F.filter(pages, lambda p: p > 0), F.lit(0))
