"""Column functions on literal rows."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import html as H
from quarry.functions import paths as P
from quarry.functions import tables as G
from quarry.functions import text as X
from quarry.functions import vectors as V


def values(spark, expression, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(expression).collect()]


def test_headings(spark):
    cases = [("제1장 서론", 1), ("제2절 방법", 2), ("1. 개요", 2), ("1.1 개요", 2), ("가. 목적", 3), ("한. x", None), ("□ 항목", 3), ("○ 세부", 4), ("(1) 내용", 4), ("2020.07.01. ~", None), ("1. 완료한다.", None), ("1. " + "가" * 58, None), ("제1장 서론", 1), ("제1장　서론", 1), ("제1장", None), ("12", None), (None, None), ("", None)]
    assert values(spark, X.heading_level(F.col("x")), [(c,) for c, _ in cases]) == [n for _, n in cases]
    assert values(spark, X.heading_level(F.col("x"), most_specific=True), [("1.1 개요",), ("1.1.1 개요",), ("1. 개요",)]) == [3, 4, 2]
    assert values(spark, X.promoted(F.col("x")), [("1. 개요",), ("말",)]) == ["## 1. 개요", "말"]


def test_glue_repair_is_complete_and_stable(spark):
    cases = [("| a ||---|---|| 14 |||", "| a |\n|---|---|\n| 14 |\n|\n|"), ("|  |", "|  |"), ("||||", "|\n|\n|\n|"), (None, None), ("", "")]
    assert values(spark, X.unglued(F.col("x")), [(c,) for c, _ in cases]) == [w for _, w in cases]
    assert values(spark, X.unglued(X.unglued(F.col("x"))), [(c,) for c, _ in cases]) == [w for _, w in cases]


@pytest.mark.parametrize("body, overlap, want", [("abc", 0, ""), ("x" * 50, 4, "x" * 10), ("aa bb cc dd", 4, "bb cc dd"), (" " + "y" * 9, 4, "y" * 9), ("z" * 39 + " " + "w" * 60, 40, "w" * 60), ("z" * 40 + " " + "w" * 59, 40, "z" * 40 + " " + "w" * 59), (None, 4, None)])
def test_tail(spark, body, overlap, want):
    assert values(spark, X.tail(F.col("x"), F.lit(overlap)), [(body,)]) == [want]


def test_small_text_functions(spark):
    assert values(spark, X.strip(F.col("x")), [("　 a b \n",), (None,), ("",)]) == ["a b", None, ""]
    assert values(spark, X.flat(F.col("x")), [(" a  \n b ",)]) == ["a b"]
    assert values(spark, X.terms(F.col("x")), [("Éeaux 한국어 a b2 x_y",), (None,), ("",)]) == [["éeaux", "한국어", "b2", "x_y"], [], []]
    assert values(spark, X.html_cell(F.col("x")), [("a|b",)]) == ["a\\|b"]
    assert values(spark, X.native_cell(F.col("x")), [(" a|b\nc ",)]) == ["a&#124;b c"]
    assert values(spark, X.model_slug(F.col("x")), [("a/b:c",)]) == ["a__b_c"]
    assert values(spark, X.snippet(F.col("x")), [("a\nb" * 300,)])[0].count("\n") == 0
    assert values(spark, X.long_enough(F.col("x"), 3), [("  ab  ",), ("abc",)]) == [False, True]
    assert values(spark, X.backend_note(F.col("x")), [("primary",), (None,), ("ocr",)]) == ["", "", "backend:ocr"]
    assert values(spark, F.length(X.error_note(F.lit("E"), F.col("x"))), [("m" * 900,)]) == [500]
    assert values(spark, X.with_tail(F.lit(""), F.col("x")), [("b",)]) == ["b"]
    assert values(spark, X.with_tail(F.lit("t"), F.col("x")), [("b",)]) == ["t\nb"]
    assert values(spark, X.first_page(F.col("x")), [([0, 3, 2],), ([],), (None,)], "x array<int>") == [3, None, None]
    assert values(spark, X.breadcrumb(F.col("x"), F.lit(2)), [(["a", "b"],), (None,)], "x array<string>") == ["a > b p.2", " p.2"]


def test_paths(spark):
    assert values(spark, P.extension(F.col("x")), [("a.B.TXT",), (".hidden",), ("none",), ("dir/x.md",)]) == ["txt", "", "", "md"]
    assert values(spark, P.format_of(F.col("x")), [("PDF",), (" .xls ",), ("htm",), ("zip",), (None,), ("",)]) == ["pdf", "xlsx", "txt", None, None, None]
    assert values(spark, P.skip_reason(F.col("x")), [("pdf",), ("zip",), ("dwg",), ("",)]) == [None, "unsupported_binary", "unknown_extension", "unknown_extension"]
    assert values(spark, P.stage_of(F.col("x")), [("a/b/c",), ("c",), (None,)]) == ["a", "", None]
    assert values(spark, P.excluded(F.col("x"), [".git"]), [("a/.git/c",), ("a/c",), ("d/.git",)]) == [True, False, True]
    assert values(spark, P.lock_file(F.col("x")), [("~$a.docx",), ("a",)]) == [True, False]
    assert values(spark, P.stored_format(F.lit("ok"), F.col("x")), [("md",)]) == ["txt"]
    assert values(spark, P.stored_format(F.lit("failed"), F.col("x")), [("md",), ("",)]) == ["md", "none"]


def test_content_hash_sees_only_the_beginning(spark):
    long = spark.range(1).select(F.expr("cast(repeat('a', 8388608) as binary)").alias("x"))
    a = long.select(P.content_sha(F.col("x"))).first()[0]
    b = long.select(P.content_sha(F.concat("x", F.lit(b"z")))).first()[0]
    assert a == b


def test_grid(spark):
    cell = "array<array<struct<text: string, start_row: int, start_col: int>>>"
    grid = [[("A", 0, 0), ("A", 0, 0)], [("b|", 1, 0), ("C", 1, 1)], [("", 2, 0), ("C", 1, 1)], [("d\ne", 3, 0)]]
    df = spark.createDataFrame([(grid,), ([],)], f"x {cell}").coalesce(1)
    rows = df.select(G.grid_rows(F.col("x")).alias("r"))
    assert [r[0] for r in rows.select(G.markdown(F.col("r"))).collect()] == ["| A |  |\n|---|---|\n| b&#124; | C |\n| d e |  |", ""]
    assert values(spark, G.captioned(F.lit("cap"), F.col("x")), [("t",), ("",), (None,)]) == ["cap\n\nt", "cap", "cap"]


def test_html_blocks(spark):
    page = "<h2>T</h2><p>a <b>b&nbsp;c<script>x</script></p><p>1. Aim</p><table><tr><th>h<th colspan=2>i</tr><tr><td>1<table><tr><td>in</td></tr></table></td><td rowspan=2>x|y</td></tr><tr><td> </td></tr></table>tail<table><tr><td>open"
    df = spark.createDataFrame([(page,), ("",), (None,), ("<table></table><p> </p>",)], "html string").coalesce(1)
    got = [r[0] for r in df.select(H.markdown(H.blocks(F.col("html")))).collect()]
    assert got[0].split("\n\n") == ["## T", "a b c", "## 1. Aim", "| h | i |  |\n|---|---|---|\n| 1 in | x\\|y |  |", "tail", "| open |\n|---|"]
    assert got[1:] == ["", "", ""]
    assert H.parsed(None) == H.parsed("") == []


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>").coalesce(1)
    assert [round(r[0], 6) for r in df.select(V.norm(F.col("a"))).collect()] == [5.0, 0.0]
    assert [[round(x, 6) for x in r[0]] for r in df.select(V.unit(F.col("a"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert [round(r[0], 6) for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.96, 0.0]
