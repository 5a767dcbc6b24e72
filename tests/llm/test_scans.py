import pytest
from pyspark.sql import functions as F

from quarry.llm import scans as K
from quarry.llm.overlap import overlap_length


@pytest.mark.parametrize("true, seen", [("internal", "intemal"), ("rejected", "rejectecl"), ("하였다", "히였다"), ("일정", "일징"), ("review", "revievv"), ("final", "fina1"), ("wurde", "wiirde"), ("의견", "외견"), ("공유", "꽁유"), ("archived", "arcliived"), ("modern", "modem"), ("2035", "203s")])
def test_confusions(true, seen):
    assert K.is_misreading(true, seen)
    assert K.skeleton(true) == K.skeleton(seen)


@pytest.mark.parametrize("a, b", [("하였다", "하였다"), ("Final", "final"), ("히였다", "하였다"), ("cat", "dog"), ("말", "밀다"), ("", "x")])
def test_no_confusions(a, b):
    assert not K.is_misreading(a, b)


def test_odd_characters():
    assert K.odd_word("regi0nal") and K.odd_word("fina1") and K.odd_word("5ensor")
    assert not any(map(K.odd_word, ["CO2", "H2O", "IPv6", "B2B", "5G", "ISO9X", "TRL7", "v4"]))
    assert K.odd_number("on 2036.0S.22. it") and K.odd_number("after 463O units") and not K.odd_number("on 2036.05.22. with API-50")


def test_overlap():
    assert overlap_length("abc def", "def\nown") == 4
    assert overlap_length("x\ny", "x\ny\nown") == 4
    assert overlap_length("값 가", "\u1100\u1161\nown") == 3  # decomposed
    assert overlap_length("abc", "own") == overlap_length(None, "a\nb") == overlap_length("a", None) == overlap_length("b", "a\nb") == 0


BODY = "The committee approved the budget of the project before the final review and the team documented the results. "


def page(words, width, head, number):
    """Lines of running text with a header and a page number after a few lines."""
    lines, line = [], ""
    for w in words:
        if line and len(line) + 1 + len(w) > width:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    lines.append(line)
    return [*lines[:3], head, *lines[3:], f"- {number} -"]


def tables(spark):
    words = (BODY * 6).split()
    first, second = page(words, 52, "Kiregen assembly 2034", 7), page(words, 44, "Kiregen assembly 2034", 8)
    ends = [x.split()[-1] for x in first]
    k = next(i for i in range(4, len(first) - 3) if ends[i].isalpha() and len(ends[i]) > 5 and len(first[i + 1]) + len(ends[i]) - 3 <= 52)
    first[k] = first[k].removesuffix(ends[k]) + ends[k][:4] + "-"
    first[k + 1] = ends[k][4:] + " " + first[k + 1]
    second[0] = second[0].replace("committee", "cornmittee")
    tail = "\n".join(first[-4:])
    chunks = [("s#0", "s", 0, "\n".join(first), None), ("s#0", "s", 0, "\n".join(first), None), ("s#1", "s", 1, tail + "\n" + "\n".join(second), []), ("t#0", "t", 0, BODY * 3, ["H"]), ("u#0", "u", 0, None, None), ("v#0", "v", 0, "a\nb", None), ("w#0", "w", 0, "7\n8", None)]
    docs = [("s", " PDF"), ("t", "pdf"), ("u", "pdf"), ("v", None), ("w", "docx")]
    c = spark.createDataFrame(chunks, "chunk_id string, doc_id string, ord int, text string, headings array<string>")
    return c, spark.createDataFrame(docs, "doc_key string, format string"), first, second, k


def test_found(spark):
    c, d, first, second, k = tables(spark)
    got = {(r.chunk_id, r.line_no, r.kind) for r in K.found(K.scanned(c, d)).collect()}
    n = len(first)
    want = {("s#0", 3, "furniture"), ("s#0", n - 1, "furniture"), ("s#0", k, "hyphen"), ("s#1", 3, "furniture"), ("s#1", 4, "misread"), ("s#1", 7, "furniture"), ("s#1", 4 + len(second) - 1, "furniture")}
    assert got == want
    assert K.found(K.scanned(c.limit(0), d)).count() == 0


def test_paragraphs(spark):
    c, d, *_ = tables(spark)
    text = {}
    for r in sorted(K.paragraphs(K.scanned(c, d)).collect()):
        text.setdefault(r.chunk_id, []).append(r.text)
    assert " ".join(text["s#0"]) == " ".join((BODY * 6).split())
    assert " ".join(text["s#1"]) == " ".join((BODY * 6).split())
    assert set(text) == {"s#0", "s#1"}


def test_a_wide_line_loses_no_document(spark):
    c, d, *_ = tables(spark)
    wide = c.withColumn("text", F.when(F.col("chunk_id") == "s#0", F.concat("text", F.lit("\n" + "x" * 91))).otherwise(F.col("text")))
    before, after = ({r.chunk_id for r in K.scanned(x, d).chunks.collect()} for x in (c, wide))
    assert before == after == {"s#0", "s#1"}


def test_either_direction_needs_context():
    assert not K.is_misreading("the", "tbe") and K.is_misreading("the", "tbe", K.SIMILAR_TO) and K.is_misreading("arnple", "ample", K.SIMILAR_TO)
    assert K.skeleton("the") == K.skeleton("tbe") and K.skeleton("arnple") == K.skeleton("ample") and K.skeleton("ville") == K.skeleton("uille")


def test_neighbours_choose_the_form(spark):
    """dcar may be clear or dear, of which clear is more frequent; near is right by what stands beside it."""
    body = [(["very", "clear", "text"],)] * 30 + [(["my", "dear", "friend"],)] * 9 + [(["my", "dcar", "friend"],), (["tbe", "text"],)] + [(["the", "text"],)] * 8
    df = spark.createDataFrame(body, "words array<string>")
    rows = [("dcar", "<dcar>", "clear", 30, 1), ("dcar", "<dcar>", "dear", 9, 1), ("tbe", "<tbe>", "the", 8, 2), ("tbx", "<tbx>", "thx", 8, 2)]
    got = K.by_context(spark.createDataFrame(rows, "word string, part string, right string, n_good long, kind int"), df).collect()
    assert {(r.word, r.right) for r in got} == {("dcar", "dear"), ("tbe", "the")}


def test_first_half():
    assert [K.first_half(x) for x in ("a wo-", "wo\u00ad ", "x1-", "-", "", "ab", "ab-cd\u2010")] == ["wo", "wo", None, None, None, None, "cd"]


def test_a_very_long_word(spark):
    c, d, *_ = tables(spark)
    long = "q" * 100_000
    more = c.unionByName(spark.createDataFrame([("s#2", "s", 2, f"own\n{long}\nmore", None)], c.schema))
    assert K.found(K.scanned(more, d)).filter("chunk_id <> 's#2'").count() == 7
    import pandas as pd

    assert len(K.affixes.func(pd.Series([long]))[0]) <= 2 * K.PART_LONGEST + 1
