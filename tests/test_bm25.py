"""BM25+ keeps the best of each query where the postings lie."""

import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

import __spark_entry__ as entry
from quarry.operators import bm25, embed
from tests.test_searches import tables


def test_pairs_of_queries_and_texts_are_not_shuffled(spark, tmp_path, monkeypatch):
    plans = []
    monkeypatch.setattr(bm25, "saved", lambda df, f=bm25.saved: plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df))
    entry.queries()["bm25_topk_texts"](spark, tables(spark, tmp_path))
    assert plans and not any(re.search(r"hashpartitioning\(query_id#\d+L?, doc_id#", p) for p in plans)


def test_best_in_blocks_equal_all_scores(monkeypatch):
    """With blocks of a few rows: common and rare terms, ties, items that a batch cuts, a term that no query of the pass has."""
    for name, value in (("CORPUS_BLOCK", 3), ("QUERY_BLOCK", 2), ("ROWS", 7)):
        monkeypatch.setattr(bm25, name, value)
    rng = np.random.default_rng(1)
    weights = np.where(rng.random((5, 9)) < 0.6, rng.integers(1, 4, (5, 9)), 0).astype(float)
    parts = np.where(rng.random((40, 10)) < 0.4, rng.integers(1, 3, (40, 10)), 0).astype(float)
    q, term = np.nonzero(weights)
    column = np.array([0, 1, 2, -1, -1, -1, -1, -1, -1])
    base = 0.5 * weights.sum(1)
    sent = SimpleNamespace(value=(pa.array(range(5)), base, np.arange(9) * 10, column, q, term, weights[q, term]))
    place, number = np.nonzero(parts)
    rows = pa.RecordBatch.from_arrays([pa.array([f"{i:03}" for i in place]), pa.array(number * 10), pa.array(parts[place, number])], names=["chunk_id", "number", "part"])
    (got,) = bm25._walked(sent, 6, "query_id", "chunk_id")(rows.slice(k, 5) for k in range(0, len(rows), 5))
    scores = weights @ parts[:, :9].T
    for n in range(5):
        want = sorted((i for i in range(40) if scores[n, i] > 0), key=lambda i: (-scores[n, i], i))[:6]
        assert {(r["chunk_id"], r["score"]) for r in got.to_pylist() if r["query_id"] == n} == {(f"{i:03}", scores[n, i] + base[n]) for i in want}


def test_searches_read_the_chunks_once(spark):
    """What they join and rank is read off one saved table; before, each use dropped repeated rows and joined documents anew."""
    for name in ("search_texts", "search_texts_stage", "search_texts_format"):
        files = entry.queries()[name](spark, "/root/testdata/sf0.001").inputFiles()
        assert files and not any("chunks.parquet" in f for f in files), name


def test_a_term_is_hashed_once(monkeypatch):
    hashed = []
    monkeypatch.setattr(embed.hashlib, "blake2b", lambda x, f=embed.hashlib.blake2b, **k: hashed.append(x) or f(x, **k))
    made = embed.hashing(["onlyhere onlyhere", "onlyhere", ""], 8)
    assert hashed == [b"onlyhere"]
    assert (made[0] == made[1]).all() and abs(np.abs(made[0]).sum() - 1) < 1e-6 and not made[2].any()
