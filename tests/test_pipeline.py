"""Sources, gates, store, chunks, ingestion, search and streaming on small inputs."""

import os
from datetime import datetime, timedelta

import numpy as np

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.config import ChunkParams, Config, api_key, load_env
from quarry.operators import bm25, chunking, dense, embed, evaluate, fusion, gates, rerank, search, store
from quarry.plans import ingest
from quarry.sources import listing, readers
from quarry.streaming import ingest as stream

NO_DOCS = "doc_key string, status string, mtime double, content_sha string"


def test_walk_keeps_hidden_files_and_drops_locks(spark, tmp_path):
    for name in ("a/x.txt", "a/.git/y.txt", "_b/.z.md", "~$lock.docx", "root.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("text")
    found = listing.walk(spark, [str(tmp_path)], [".git"])
    assert {r.rel_path for r in found.collect()} == {"a/x.txt", "_b/.z.md", "root.txt"}
    assert listing.limited(found, 2).count() == 2
    assert listing.limited(found, 0).count() == 3


def test_latest_scan(spark):
    day = datetime(2030, 1, 1)
    rows = [("r", "p", "p", 1, 1.0, day, day), ("r", "p", "p", 2, 2.0, day + timedelta(1), day), ("r", "p", "p", 2, 2.0, day + timedelta(1), day), ("r", "q", "q", None, None, day, day), ("r", None, None, 1, 1.0, day, day)]
    df = spark.createDataFrame(rows, "root string, path string, rel_path string, size_bytes long, mtime double, seen_at timestamp, loaded_at timestamp")
    assert sorted((r.rel_path, r.size_bytes) for r in listing.latest(df).collect()) == [("p", 2), ("q", None)]
    assert listing.latest(df.limit(0)).count() == 0


def test_gates_in_their_order(spark):
    mb = 1024 * 1024
    files = [("a.zip", 999 * mb, 1.0), ("b.dwg", 1, 1.0), ("c.txt", 120 * mb, 1.0), ("d.txt", 120 * mb + 1, 1.0), ("e.txt", 1, 1.0), ("f.txt", 1, 2.0), ("g.txt", 1, 1.0), ("h.txt", 1, 1.0)]
    df = spark.createDataFrame(files, "rel_path string, size_bytes long, mtime double")
    old = df.select(F.substring(F.sha1("rel_path"), 1, 16).alias("doc_key"), "rel_path").withColumn("status", F.expr("case rel_path when 'e.txt' then 'ok' when 'f.txt' then 'ok' when 'g.txt' then 'failed' when 'h.txt' then 'skipped' end")).withColumn("mtime", F.lit(1.0)).filter("status is not null")
    got = {r.rel_path: r.gate for r in gates.gated(df, old).collect()}
    assert got == {"a.zip": "unsupported_binary", "b.dwg": "unknown_extension", "c.txt": None, "d.txt": "too_large", "e.txt": "cached", "f.txt": None, "g.txt": None, "h.txt": "cached"}
    assert all(r.gate != "cached" for r in gates.gated(df, old, force=True).collect())


def test_owners(spark):
    rows = [("k1", "a", "failed", "s1"), ("k2", "b", "ok", "s1"), ("k3", "c", "ok", "s1"), ("k4", "d", "failed", "s2"), ("k5", "e", "ok", None)]
    parsed = spark.createDataFrame(rows, "doc_key string, rel_path string, status string, content_sha string")
    assert [(r.content_sha, r.owner) for r in gates.owners(parsed).collect()] == [("s1", "k2")]
    stored = spark.createDataFrame([("k9", "z", "ok", "s1")], parsed.schema)
    assert [(r.content_sha, r.owner) for r in gates.owners(parsed, stored).collect()] == [("s1", "k9")]


def test_decoding_damage(spark):
    df = spark.createDataFrame([(bytearray(b"ok\xff"),), (bytearray(b" \n"),), (bytearray("가".encode()),)], "c binary").coalesce(1)
    assert [r[0] for r in df.select(readers.decoded(F.col("c"))).collect()] == ["ok�", None, "가"]


def test_reader_chain(spark):
    def bad(_):
        raise ValueError("x" * 900)

    files = spark.createDataFrame([("a", "pdf", bytearray(b"q")), ("b", "md", bytearray(b" ")), ("c", "hwp", bytearray(b"")), ("d", "csv", bytearray(b"h,i\n1"))], "path string, ext string, content binary")
    got = {r.path: r for r in readers.convert(files, {"pdf": [("primary", bad), ("pdf_fallback", lambda c: ""), ("ocr", lambda c: "text")]}).collect()}
    assert (got["a"].markdown, got["a"].backend) == ("text", "ocr")
    assert got["b"].markdown is None and got["b"].error is None
    assert got["c"].error.startswith("LookupError")
    assert got["d"].markdown == "| h | i |\n|---|---|\n| 1 |  |"
    only = readers.convert(files.filter("ext = 'pdf'"), {"pdf": [("primary", bad)]}).first()
    assert only.error.startswith("ValueError: xx") and len(only.error) == 500


def test_chunk_stream(spark):
    rows = [("d", 0, ["h"], "first body that is long enough to stay here", 4), ("d", 1, [], "short", 4), ("d", 2, [], "second body that is long enough to stay", 4), ("d", 3, [], "third body, after a kept one, stays as well", 4)]
    rows = [(*r, p) for r, p in zip(rows, ([0, 3], None, [2], []))]
    raw = spark.createDataFrame(rows, chunking.RAW)
    got = chunking.finished(raw).orderBy("ord").collect()
    assert [r.chunk_id for r in got] == ["d#0", "d#1", "d#2"]
    assert [r.page_no for r in got] == [3, 2, None]
    assert got[1].text == rows[2][3]  # the short one between breaks the chain
    assert got[2].text == "to stay\n" + rows[3][3]
    assert [r.n_chars for r in got] == [len(r.text) for r in got]
    assert chunking.finished(raw.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["# A", "## B", "word " * 30, "one. two. three.", "| a | b |", "", "x" * 50]), max_size=20), st.integers(3, 40))
def test_own_splitter_keeps_all_words(lines, limit):
    text = "\n".join(lines)
    out = chunking.split_markdown(text, limit)
    bodies = " ".join("\n".join(b.split("\n")[len(h) :]) for h, b in out)
    want = [w for line in lines if not line.startswith("#") for w in chunking.TOKEN.findall(line)]
    assert chunking.TOKEN.findall(bodies) == want
    assert chunking.split_markdown(None, limit) == []


def test_scripts_without_blanks_have_limits():
    text = "これは文章です。" * 4500  # 36,000 characters
    out = chunking.split_markdown(text, 512)
    assert all(chunking._size(b) <= 512 for _, b in out) and "".join(b for _, b in out) == text
    assert [b for _, b in chunking.split_markdown("漢" * 1000, 400)] == ["漢" * 400, "漢" * 400, "漢" * 200]
    assert chunking.split_markdown("One.  Two.", 100) == [([], "One.  Two.")]


def test_pages():
    out = chunking.split_pages("one\ftwo words\n\fthree", 3)
    assert [(b, p) for _, b, p in out] == [("one\ntwo words", [1, 2]), ("three", [3])]


def test_numbers_across_runs(spark, monkeypatch):
    monkeypatch.setattr(store, "RUN", 3)
    rows = [(f"x{i}", d, i * 2) for d in ("a", "b") for i in range(8)] + [("y", None, 0), ("z", "a", None)]
    got = store.numbered(spark.createDataFrame(rows, "chunk_id string, doc_id string, ord int")).collect()
    assert sorted(r.ord for r in got if r.doc_id == "a") == list(range(9)) and sorted(r.ord for r in got if r.doc_id == "b") == list(range(8))


def test_ingestion_run(spark, tmp_path):
    body = "A paragraph that is long enough to be kept as a chunk of its own."
    for name, text in {"a/one.txt": body, "a/two.txt": body, "b/bad.html": "", "c.zip": "z", "d.md": "# T\n\n" + body + " More."}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    files = listing.walk(spark, [str(tmp_path)], [])
    stored = spark.createDataFrame([], NO_DOCS)
    out = ingest.run(files, stored)
    docs = {r.rel_path: r for r in out.documents.collect()}
    assert docs["a/one.txt"].status == "ok" and docs["a/one.txt"].n_chunks == 1 and docs["a/one.txt"].stage == "a"
    assert docs["a/two.txt"].error == f"duplicate_of:{docs['a/one.txt'].doc_key}"
    assert (docs["b/bad.html"].status, docs["b/bad.html"].error) == ("skipped", "empty_text")
    assert (docs["c.zip"].status, docs["c.zip"].format, docs["c.zip"].error) == ("skipped", "zip", "unsupported_binary")
    assert docs["d.md"].format == "txt"
    assert {r.outcome: r.documents for r in out.counters.collect()} == {"ok": 2, "duplicate": 1, "skipped": 2, "cached": 0}
    again = ingest.run(files, out.documents)
    assert {r.rel_path for r in again.documents.collect()} == {"c.zip"}  # unsupported ones are seen again, the rest is cached
    assert {r.outcome: r.documents for r in again.counters.collect()}["cached"] == 4


def test_copies_of_a_failed_file_are_tried(spark, tmp_path):
    for name in ("a.xx", "b.txt"):
        (tmp_path / name).write_text("Equal bytes under two names, the first of which no reader can take.")

    def bad(_):
        raise ValueError("no")

    files = spark.createDataFrame([(0, str(tmp_path), str(tmp_path / n), n, 60, 1.0) for n in ("a.xx", "b.txt")], listing.LISTING).withColumn("rel_path", F.regexp_replace("rel_path", "xx", "pdf"))
    out = ingest.run(files, spark.createDataFrame([], NO_DOCS), custom={"pdf": [("primary", bad)]})
    assert {r.rel_path: r.status for r in out.documents.collect()} == {"a.pdf": "failed", "b.txt": "ok"}


def test_store(spark, tmp_path):
    table = store.Snapshots(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.read()
    table.commit(spark.createDataFrame([("a", 1), ("b", 1)], "doc_id string, v int"))
    table.commit(store.upsert(table.read(), spark.createDataFrame([("b", 2), ("c", 2)], "doc_id string, v int")))
    assert sorted((r.doc_id, r.v) for r in table.read().collect()) == [("a", 1), ("b", 2), ("c", 2)]
    old = spark.createDataFrame([("a#0", "a", 0), ("b#0", "b", 0), ("b#1", "b", 1)], "chunk_id string, doc_id string, ord int")
    new = spark.createDataFrame([("x", "b", 7)], old.schema)
    assert sorted(r.chunk_id for r in store.replace_chunks(old, new).collect()) == ["a#0", "b#0"]


def test_stale_chunks_stay_unless_asked(spark):
    docs = spark.createDataFrame([("a", "ok"), ("b", "failed")], "doc_key string, status string").selectExpr("*", "'f' file_name", "'r' rel_path", "'s' stage", "'txt' format")
    chunks = spark.createDataFrame([("a#0", "a", None), ("b#0", "b", ["h"])], "chunk_id string, doc_id string, headings array<string>")
    assert store.all_chunks(chunks, docs).count() == 2
    assert [r.headings for r in store.all_chunks(chunks, docs, active_only=True).collect()] == [[]]


def test_dense_against_numpy(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(300, 8))
    m[7] = m[3]
    rows = [(f"c{i:03}", [float(x) for x in v]) for i, v in enumerate(m)]
    corpus = spark.createDataFrame([*rows, ("null", None)], "chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([(i, rows[i][1]) for i in (3, 50)], "query_id long, embedding array<float>")
    got = dense.top_k(corpus, asked, 10).collect()
    unit = np.asarray([r[1] for r in rows], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for q in (3, 50):
        s = unit @ unit[q]
        want = [f"c{i:03}" for i in sorted(range(300), key=lambda i: (-round(s[i], 9), i))[:10]]
        assert [r.chunk_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    assert dense.top_k(corpus.limit(0), asked, 10).count() == 0
    assert dense.top_k(corpus, asked, 0).count() == 0
    assert dense.top_k(corpus, asked, 1000).count() == 600


def test_bm25_fills_up_and_ignores_unknown_terms(spark):
    docs = spark.createDataFrame([("a", "alpha beta beta"), ("b", "alpha"), ("c", "gamma delta"), ("d", None), ("e", "")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "beta zzz"), (2, "unknown"), (3, "")], "query_id int, text string")
    got = bm25.top_k(bm25.index(docs), asked, 3).collect()
    by = {q: [(r.chunk_id, round(r.score, 6)) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (1, 2, 3)}
    assert [c for c, _ in by[1]] == ["a", "b", "c"] and by[1][0][1] > by[1][1][1] == by[1][2][1] > 0
    assert by[2] == by[3] == [("a", 0.0), ("b", 0.0), ("c", 0.0)]
    paper = bm25.top_k(bm25.index(docs), asked, 3, variant="paper").collect()
    assert [(r.query_id, r.chunk_id) for r in paper] == [(1, "a")]


def lists(spark, pairs):
    return spark.createDataFrame([("q", c, r) for c, r in pairs], "query_id string, chunk_id string, rank int")


@settings(max_examples=15, deadline=None)
@given(st.permutations(list("abcdefg")), st.permutations(list("cdefghij")), st.integers(0, 7), st.integers(0, 8))
def test_fusion_against_a_dict(spark, dense_order, sparse_order, n, m):
    a, b = list(enumerate(dense_order[:n], 1)), list(enumerate(sparse_order[:m], 1))
    scores: dict[str, float] = {}
    for each in (a, b):
        for rank, c in each:
            scores[c] = scores.get(c, 0.0) + 1.0 / (60 + rank)
    want = [c for c, _ in sorted(scores.items(), key=lambda x: -x[1])]
    got = fusion.fuse(lists(spark, [(c, r) for r, c in a]), lists(spark, [(c, r) for r, c in b])).orderBy("fused_rank").collect()
    assert [r.chunk_id for r in got] == want
    assert [r.score for r in got] == [scores[c] for c in want]


def corpus(spark):
    rows = [(f"c{i}", f"doc{i}", 0, f"text number n{i:02} about {'pumps' if i % 2 else 'budgets'} and more", "1단계" if i < 5 else "2단계", "pdf" if i % 2 else "hwp") for i in range(12)]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id string, ord int, text string, stage string, format string")
    return df.selectExpr("*", "'f' file_name", "'r' rel_path", "cast(null as int) page_no", "cast(null as array<string>) headings")


def test_search(spark):
    chunks = corpus(spark)
    vectors = embed.embedded(chunks.select("chunk_id", "text"), "text").drop("text").filter("chunk_id <> 'c3'").unionByName(spark.createDataFrame([("gone", [1.0] * 64)], "chunk_id string, embedding array<float>"))
    asked = spark.createDataFrame([("q1", "pumps number n05")], "query_id string, text string")
    hits = search.search(chunks, vectors, asked).orderBy("rank").collect()
    assert len(hits) == 5 and hits[0].chunk_id == "c5" and hits[0].source.format == "pdf"
    assert all(h.chunk_id not in ("c3", "gone") for h in hits)  # a hole in the vectors shifts nothing
    assert {h.source.stage for h in search.search(chunks, vectors, asked, stage="1단계").collect()} == {"1단계"}
    few = search.search(chunks, vectors, asked, Config(dense_top_k=1, sparse_top_k=1), formats=["hwp"])
    assert few.count() == 0  # filters look at the candidates only
    assert search.search(chunks, vectors, asked, Config(dense_top_k=1, sparse_top_k=1), formats=["hwp"], prefilter=True).count() >= 1
    assert search.search(chunks.limit(0), vectors, asked).count() == 0


def test_filter_stays_above_the_limit(spark):
    fused = lists(spark, [("a", 1)]).withColumnRenamed("rank", "fused_rank").withColumn("score", F.lit(1.0))
    plan = dense.ranked(fused, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_cache(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "cc dd"), (4, None)], "id int, text string")
    none = spark.createDataFrame([], "model_id string, hash string, dim int, vec array<float>")
    cold, new = embed.embed_cached(texts, none, "m")
    assert new.filter("vec is not null").count() == 2
    warm, more = embed.embed_cached(texts, new.filter("vec is not null"), "m")
    assert more.filter("hash is not null").count() == 0
    key = lambda df: sorted((r.id, tuple(r.embedding or ())) for r in df.select("id", "embedding").collect())
    assert key(cold) == key(warm)
    assert embed.embed_cached(texts.limit(0), none, "m")[0].count() == 0
    with pytest.raises(ValueError):
        embed.encoder("nothing")


def test_drift(spark):
    chunks = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "chunk_id string, text string")
    from quarry.functions.text import text_hash

    vectors = chunks.filter("chunk_id <> 'c'").select("chunk_id", text_hash("m", F.when(F.col("chunk_id") == "b", "old").otherwise(F.col("text"))).alias("text_hash")).unionByName(spark.createDataFrame([("d", "h")], "chunk_id string, text_hash string"))
    assert {(r.chunk_id, r.reason) for r in embed.drifted(vectors, chunks, "m").collect()} == {("b", "changed"), ("c", "missing"), ("d", "orphan")}


def test_rerank_is_stable(spark):
    rows = [("q", "aa bb", "aa", 1), ("q", "aa bb", "aa bb", 2), ("q", "aa bb", "bb", 3), ("q", "aa bb", None, 4)]
    df = spark.createDataFrame(rows, "query_id string, query_text string, text string, fused_rank int")
    assert [r.fused_rank for r in rerank.rerank(df, top_k=3).orderBy("rank").collect()] == [2, 1, 3]
    assert rerank.rerank(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        rerank.scorer("nothing")


def test_ndcg(spark):
    gains = spark.createDataFrame([("q", "a", 3), ("q", "b", 1)], "query_id string, chunk_id string, gain int")
    assert evaluate.ndcg(lists(spark, [("a", 1), ("b", 2)]), gains).first().ndcg == pytest.approx(1.0)
    assert evaluate.ndcg(lists(spark, [("x", 1)]), gains).first().ndcg == 0.0


def test_stream_of_scans(spark, tmp_path):
    schema = "root string, path string, rel_path string, ext string, size_bytes long, mtime double, seen_at timestamp, loaded_at timestamp"
    t = datetime(2030, 1, 1, 10)
    rows = [("r", "p", "a.txt", "txt", 1, 1.0, t, t), ("r", "p", "b.txt", "txt", 1, 1.0, t, t)]
    folder, table = tmp_path / "in", store.Snapshots(spark, str(tmp_path / "t"))
    spark.createDataFrame(rows, schema).write.parquet(str(folder))
    follow = lambda: stream.follow(stream.scans(spark, str(folder), schema), table, str(tmp_path / "ck")).awaitTermination()
    follow()
    later = [("r", "p", "a.txt", "txt", 9, 2.0, t + timedelta(1), t), ("r", "p", "b.txt", "txt", 7, 0.5, t - timedelta(1), t + timedelta(2))]
    spark.createDataFrame(later, schema).write.mode("append").parquet(str(folder))
    follow()
    assert sorted((r.rel_path, r.size_bytes) for r in table.read().collect()) == [("a.txt", 9), ("b.txt", 1)]
    counts = stream.windows(spark.createDataFrame(rows + rows, schema)).collect()
    assert [(r.ext, r.scanned, r.files) for r in counts] == [("txt", 2, 2)]


def test_config(tmp_path, monkeypatch):
    monkeypatch.delenv("QUARRY_KEY", raising=False)
    (tmp_path / ".env").write_text("# c\nQUARRY_KEY='v'\n")
    with pytest.raises(RuntimeError):
        api_key("QUARRY_KEY")
    load_env(str(tmp_path / ".env"))
    assert api_key("QUARRY_KEY") == "v"
    monkeypatch.setenv("QUARRY_KEY", "real")
    load_env(str(tmp_path / ".env"))
    assert os.environ["QUARRY_KEY"] == "real"
    assert Config().params("xlsx") == ChunkParams(768, 0) and Config().params("odd") == ChunkParams()


def test_command_line(spark, tmp_path, capsys):
    from quarry import cli

    (tmp_path / "in" / "1단계").mkdir(parents=True)
    (tmp_path / "in" / "1단계" / "a.md").write_text("# Pumps\n\nThe pumps of the cooling unit were tested and approved by the team.")
    (tmp_path / "in" / "b.txt").write_text("The budget of the second year was approved by the office after a review.")
    index = str(tmp_path / "index")
    assert cli.main(["build", str(tmp_path / "in"), "--index", index]) == 0
    assert cli.main(["query", "pumps", "--index", index, "--top-k", "1"]) == 0
    assert "a.md" in capsys.readouterr().out
    assert cli.main(["query", "pumps", "--index", index, "--stage", "none"]) == 1
    assert cli.main(["stats", "--index", index]) == 0
    assert '"documents_ok": 2' in capsys.readouterr().out
    assert cli.main(["build", str(tmp_path / "in"), "--index", index, "--skip-ingest", "--quiet"]) == 0
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "z.zip").write_text("z")
    assert cli.main(["build", str(tmp_path / "none"), "--index", str(tmp_path / "other"), "--quiet"]) == 1
