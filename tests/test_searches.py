"""Searches by whole texts against all documents, on literal tables."""

import math
import re
from collections import Counter

import numpy as np

import __spark_entry__ as entry
from quarry.operators import embed, rerank
from quarry.plans import catalogue, ingest

TEXTS = {
    0: "\nred apple pie\nred plum",
    1: "apple",
    2: "plum plum jam",
    3: "head line\nplum",
    100: "head line\nblue cheese and plum jam",
    101: "blue cheese",
    102: "line",
    103: None,
    200: None,
}


def tables(spark, folder):
    rows = [(i, f"k{i}", t, f"f{i}.md", f"s{i % 2}/f{i}.md", f"s{i % 2}", "txt" if i % 3 else "pdf") for i, t in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, doc_key string, text string, file_name string, rel_path string, stage string, format string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def words(text):
    return re.findall(r"\w\w+", (text or "").lower())


def bm25(corpus, text):
    tf = {i: Counter(words(t)) for i, t in corpus.items()}
    df = Counter(w for c in tf.values() for w in c)
    mean = sum(c.total() for c in tf.values()) / len(tf)
    out = dict.fromkeys(corpus, 0.0)
    for w, times in Counter(words(text)).items():
        for i, c in tf.items():
            if df[w]:
                out[i] += times * math.log((len(tf) + 1) / df[w]) * (0.5 + 2.5 * c[w] / (1.5 * (0.25 + 0.75 * c.total() / mean) + c[w]))
    return out


def test_bm25_takes_every_line_of_a_query(spark, tmp_path):
    rows = entry.queries()["bm25_topk_texts"](spark, tables(spark, tmp_path)).collect()
    assert {r.query_id for r in rows} == {0, 100, 200}
    for q in (0, 100, 200):
        want = bm25(TEXTS, TEXTS[q])
        got = {r.doc_id: r for r in rows if r.query_id == q}
        assert sorted(got) == sorted(TEXTS)
        assert all(abs(got[i].score - want[i]) < 1e-5 for i in TEXTS)
        assert [i for i in sorted(got, key=lambda i: got[i].rank)] == sorted(TEXTS, key=lambda i: (-round(want[i], 9), i))


def test_search_makes_its_own_candidates(spark, tmp_path):
    """By brute force over all chunks; no ranked list is read."""
    d = tables(spark, tmp_path)
    chunks = {f"k{i}#0": t for i, t in TEXTS.items() if i not in (103, 200)}
    rows = [(c, c[:-2], t, 1, ["a"]) for c, t in chunks.items()]
    spark.createDataFrame(rows, "chunk_id string, doc_id string, text string, page_no int, headings array<string>").write.parquet(f"{d}/chunks.parquet")
    got = entry.queries()["search_texts"](spark, d).collect()
    vectors = dict(zip(chunks, embed.hashing(["passage: " + t for t in chunks.values()], 64).astype(float)))
    for q in (0, 100):
        v = embed.hashing(["query: " + TEXTS[q]], 64)[0].astype(float)
        dense, sparse = {c: float(np.dot(v, x)) for c, x in vectors.items()}, bm25(chunks, TEXTS[q])
        place = [{c: n for n, c in enumerate(sorted(chunks, key=lambda c: (-round(s[c], 9), c)), 1)} for s in (dense, sparse)]
        score = {c: sum(1 / (60 + p[c]) for p in place) for c in chunks}
        want = sorted(chunks, key=lambda c: (-score[c], place[0][c], place[1][c], c))[:5]
        assert [r.chunk_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    assert {r.format for r in entry.queries()["search_texts_format"](spark, d).collect()} == {"pdf"}
    assert entry.queries()["search_texts_stage"](spark, d).count() == 0


def test_rerank_query_uses_the_operator(spark, monkeypatch):
    called = []
    monkeypatch.setattr(rerank, "rerank", lambda *a, f=rerank.rerank, **k: called.append(1) or f(*a, **k))
    assert catalogue.rerank_topk(spark, "/root/testdata/sf0.001").count() > 0 and called


def test_ingest_has_no_window_over_copies(spark, tmp_path):
    for name, text in (("a.md", "one text"), ("b.md", "one text"), ("c.md", "one text")):
        (tmp_path / name).write_text(text)
    rows = [(o, str(tmp_path / n), n, 8, 1.0) for o, n in ((1, "a.md"), (0, "c.md"), (0, "b.md"), (0, "gone.md"), (0, "lost.md"))]
    files = spark.createDataFrame(rows, "root_ord int, path string, rel_path string, size_bytes long, mtime double")
    stored = spark.createDataFrame([], "doc_key string, status string, mtime double, content_sha string, rel_path string")
    assert not hasattr(ingest, "W")
    status = {r.rel_path: r.status for r in ingest.run(files, stored).documents.collect()}
    assert set(status) == {"a.md", "b.md", "c.md", "gone.md", "lost.md"}
    assert {n: status[n] for n in ("a.md", "b.md", "c.md")} == {"a.md": "skipped", "b.md": "ok", "c.md": "skipped"}
