import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import arrow_text as A
from quarry.llm import lookalike as K

POOL = [chr(c) for c in [*range(0x20, 0x7F), *range(0xC0, 0x180), *range(0x300, 0x330), *range(0x1E00, 0x1EFA), *range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A8, 0x11C3), *range(0xAC00, 0xAC40), 0x3099, 0x309A, 0x304B, 0x30AB, 0x1F600, 0xF967, 0x9C7, 0x9BE]]


def form(*texts):
    return K.same_form_array(pa.array(texts, pa.string())).to_pylist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from(POOL), max_size=12)), max_size=6))
def test_composes_like_the_standard(texts):
    want = [None if t is None else unicodedata.normalize("NFC", t) for t in texts]
    assert form(*texts) == want
    assert form(*want) == want


@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=20)), max_size=8))
def test_arrow_round_trip(texts):
    texts = [t if t is None else t.encode("utf-8", "replace").decode() for t in texts]
    column = pa.array(texts, pa.string())
    points, offsets = A.code_points(column)
    assert A.strings(points, offsets, column.is_valid().to_numpy(zero_copy_only=False)).to_pylist() == texts
    if texts:
        part = column.slice(1)
        points, offsets = A.code_points(part)
        assert A.strings(points, offsets).to_pylist() == [t or "" for t in texts[1:]]


def test_what_shows_and_what_does_not():
    same = [("\uff21\uff42\uff11", "Ab1"), ("a\u200bb\u00adc\ufeff", "abc"), ("a\u00a0b\u2009c\u3000d", "a b c d"), ("\u03a1\u0430ge \u039f", "Page O"), ("\ufb01n", "fin"), ("\uf967", "\u4e0d"), ("한글", unicodedata.normalize("NFD", "한글")), ("\u304c", "\u304b\u3099"), ("\u212b", "\u00c5")]
    for a, b in same:
        assert form(a) == form(b), (a, b)
    other = [("A", "a"), ("\u00e9", "e"), ("\u304b", "\u304c"), ("2", "\u00b2"), ("1", "\u2460"), ("a\nb", "a b"), ("\u03b1", "a"), ("\u00df", "\u03b2"), ("a  b", "a b")]
    for a, b in other:
        assert form(a) != form(b), (a, b)


def test_pairs(spark):
    rows = [("a", "Text \uff11", ["H"]), ("b", "Text 1", ["H"]), ("b", "Text 1", ["H"]), ("c", "Text 1", ["\u0397"]), ("d", "text 1", ["H"]), ("e", "Text\u00a01", ["H"]), ("f", None, None), ("g", "", []), ("h", "\u200b", None), (None, "Text \uff11", ["H"]), ("i", "Text 1", [None])]
    df = spark.createDataFrame(rows, "chunk_id string, text string, headings array<string>")
    got = {(r.chunk_id_1, r.chunk_id_2) for r in K.look_alikes(df).collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "e"), ("b", "c"), ("b", "e"), ("c", "e"), ("f", "h"), ("g", "h")}
    assert K.look_alikes(df.limit(0)).count() == 0
    formed = {r.chunk_id: (r.text, r.headings) for r in K.with_same_form(df).collect()}
    assert formed["a"] == ("Text 1", ["H"]) and formed["f"] == (None, None) and formed["i"] == ("Text 1", [None]) and formed["g"] == ("", [])
