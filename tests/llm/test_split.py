import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import arrow_text as A
from quarry.llm import split as S

PIECES = st.lists(st.sampled_from(["word", " ", "\n", "\n\n", ". ", "。", "가나", "\u00e9", "e\u0301", "|", "x" * 30, "?” "]), max_size=60).map("".join)


def pieces(texts, limit, overlap):
    points, offsets = A.code_points(pa.array(texts, pa.string()))
    n = len(texts)
    row, start, end = S.cuts(points, offsets, np.full(n, limit), np.full(n, overlap))
    out = [[] for _ in texts]
    for r, a, b in zip(row.tolist(), start.tolist(), end.tolist()):
        out[r].append((a - int(offsets[r]), b - int(offsets[r])))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(PIECES, max_size=4), st.integers(8, 60), st.integers(0, 4))
def test_pieces_cover_the_text(texts, limit, overlap):
    for text, own in zip(texts, pieces(texts, limit, overlap)):
        if not text:
            assert own == []
            continue
        assert own[0][0] == 0 and own[-1][1] == len(text)
        assert all(0 < b - a <= limit for a, b in own)
        for (_, b), (c, d) in zip(own, own[1:]):
            assert b - overlap <= c <= b < d


@settings(max_examples=100, deadline=None)
@given(st.lists(PIECES, min_size=1, max_size=4), st.integers(8, 60), st.integers(0, 4))
def test_doubling_equals_one_cut_after_another(texts, limit, overlap):
    """Walking the successor table step by step from the start gives the same cuts."""
    together = pieces(texts, limit, overlap)
    for k, text in enumerate(texts):
        assert together[k] == pieces([text], limit, overlap)[0]


def test_boundaries_are_natural():
    text = "First sentence here. Second sentence is here.\nA line of its own\n\nA paragraph begins here and goes on"
    cut = [text[a:b] for a, b in pieces([text], 70, 0)[0]]
    assert cut == ["First sentence here. Second sentence is here.\nA line of its own\n\n", "A paragraph begins here and goes on"]
    cut = [text[a:b] for a, b in pieces([text], 46, 0)[0]]
    assert cut[0] == "First sentence here. Second sentence is here.\n"
    cut = [text[a:b] for a, b in pieces([text], 30, 0)[0]]
    assert cut[0] == "First sentence here. "
    assert pieces(["가\u0301" * 20], 9, 0)[0][0] == (0, 8)  # a mark stays with its letter


PARAMS = [("txt", 40, 8), ("default", 30, 0)]


CHUNKS = "chunk_id string, doc_id string, ord int, text string, headings array<string>, page_no int, source string"


def docs(spark, **formats):
    return spark.createDataFrame(list(formats.items()), "doc_key string, format string")


def test_split_table(spark):
    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [("d#0", "d", 0, "short", ["h"], 1, "s"), (None, "d", 1, long, ["h", "i"], 2, "s"), (None, "d", 1, long, ["h", "i"], 2, "s"), ("d#2", "d", 2, None, None, None, "s"), ("e#0", "e", 0, "", None, None, "s"), ("e#1", "e", 1, "y" * 31, None, None, "s"), ("f#0", "f", 0, "z" * 30, None, None, "s"), (None, None, 1, long, None, None, None)]
    df, d = spark.createDataFrame(rows, CHUNKS), docs(spark, d=" TXT", e="odd")
    params = spark.createDataFrame(PARAMS, "format string, max_chars int, overlap_chars int")
    got = S.split(df, d, params).orderBy("doc_id", "ord").collect()
    assert [(r.chunk_id, r.ord, r.piece) for r in got] == [("d#0", 0, 0), ("d#1", 1, 0), ("d#1", 2, 1), ("d#2", 3, 0), ("e#0", 0, 0), ("e#1", 1, 0), ("e#1", 2, 1), ("f#0", 0, 0)]
    assert got[1].headings == ["h", "i"] == got[2].headings and got[3].text is None and got[4].text == ""
    assert all(r.text is None or len(r.text) <= 40 and r.n_chars == len(r.text) for r in got)
    assert got[1].n_pieces == 2 and got[0].n_pieces == 1
    shared = next(n for n in range(8, 0, -1) if got[1].text.endswith(got[2].text[:n]))
    assert shared >= 4
    assert {r.chunk_id for r in S.oversized(df, d, params).collect()} == {"d#1", "e#1"}
    assert S.split(df.limit(0), d, params).count() == 0


def test_no_default_row_keeps_all_rows(spark):
    rows = [("d#0", "d", 0, "x" * 50, None, None, "s"), ("e#0", "e", 0, "y" * 50, None, None, "s")]
    params = spark.createDataFrame([("txt", 40, 8)], "format string, max_chars int, overlap_chars int")
    got = S.split(spark.createDataFrame(rows, CHUNKS), docs(spark, d="txt"), params).collect()
    assert sorted((r.chunk_id, r.piece) for r in got) == [("d#0", 0), ("d#0", 1), ("e#0", 0)]
    assert len(S.split(spark.createDataFrame(rows, CHUNKS), docs(spark), params.limit(0)).collect()) == 2


def test_texts_move_once(spark):
    rows = [("d#0", "d", 0, "x" * 50, None, None, "s")]
    df = S.split(spark.createDataFrame(rows, CHUNKS), docs(spark, d="txt"), spark.createDataFrame(PARAMS, "format string, max_chars int, overlap_chars int"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan  # the cuts are a table by then


def test_numbers_across_runs(spark, monkeypatch):
    monkeypatch.setattr(S, "ORD_RUN", 2)
    rows = [(f"d#{i}", "d", i, "x" * (50 if i % 2 else 5), None, None, "s") for i in range(7)]
    got = S.split(spark.createDataFrame(rows, CHUNKS), docs(spark, d="txt"), spark.createDataFrame(PARAMS, "format string, max_chars int, overlap_chars int")).orderBy("ord").collect()
    assert [r.ord for r in got] == list(range(len(got))) and len(got) == 10
    assert [int(r.chunk_id[2:]) for r in got] == sorted(int(r.chunk_id[2:]) for r in got)
