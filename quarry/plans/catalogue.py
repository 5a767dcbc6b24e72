"""The queries of the search pipeline by name, each with the SQL that says the same.

Every query reads whole tables. Queries of searches are all rows whose id is divisible by 100, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quarry.config import Config
from quarry.functions import html as H
from quarry.functions import paths
from quarry.functions import tables as G
from quarry.functions import text as X
from quarry.functions import vectors as V
from quarry.operators import bm25, chunking, dense, embed, evaluate, fusion, gates, rerank, search, store
from quarry.runtime import saved, table
from quarry.sources import listing as L
from quarry.streaming import ingest as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with its SQL if there is some."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# ---- vectors -------------------------------------------------------------------------------------------------------


@query("""
    with q as (select vec_id as query_id, embedding as v from embeddings where vec_id % 100 = 0),
    s as (select query_id, vec_id, list_dot_product(list_transform(v, lambda x: x::double), list_transform(embedding, lambda x: x::double))
            / ((sqrt(list_sum(list_transform(v, lambda x: x::double * x::double))) + 1e-12::double) * (sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) + 1e-12::double)) as score
          from q cross join embeddings)
    select query_id, vec_id, cast(rank as int) as rank, round(score, 6) as score
    from (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as rank from s) where rank <= 30""")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return dense.top_k(vectors, asked, 30, item="vec_id").select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query("""
    select vec_id, round(n, 6) as norm, round(sqrt(list_sum(list_transform(embedding, lambda x: (x::double / (n + 1e-12::double)) ** 2))), 6) as unit_norm, round(embedding[1]::double / (n + 1e-12::double), 6) as first
    from (select *, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as n from embeddings)""")
def l2_normalise(spark: SparkSession, d: str) -> DataFrame:
    unit = V.unit(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(V.norm(unit), 6).alias("unit_norm"), F.round(F.get(unit, F.lit(0)), 6).alias("first"))


@query("select cast(len(embedding) as int) as dim, count(*) as vectors from embeddings group by 1")
def vector_dim_check(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("vectors"))


@query("""
    select v.vec_id, d.doc_key, round(v.embedding[1]::double, 6) as first from embeddings v join documents d on d.doc_id = v.vec_id where d.status = 'ok'""")
def vector_meta_align(spark: SparkSession, d: str) -> DataFrame:
    """Vectors meet their rows by id, so the vectors of rows that are gone shift no other."""
    docs = table(spark, d, "documents").filter("status = 'ok'").select(F.col("doc_id").alias("vec_id"), "doc_key")
    return table(spark, d, "embeddings").select("vec_id", "embedding").join(docs, "vec_id").select("vec_id", "doc_key", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


# ---- terms and BM25 ------------------------------------------------------------------------------------------------

TERMS_SQL = "unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'))"


@query(f"select doc_id, term, count(*) as tf from (select doc_id, {TERMS_SQL} as term from documents) group by 1, 2")
def tokenise_tf(spark: SparkSession, d: str) -> DataFrame:
    return bm25.postings_of(table(spark, d, "documents"), "doc_id")


@query(f"select term, count(*) as df from (select distinct doc_id, {TERMS_SQL} as term from documents) group by 1")
def corpus_df(spark: SparkSession, d: str) -> DataFrame:
    return bm25.index(table(spark, d, "documents"), "doc_id").stats


@query("""
    with t as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]{2,}') as terms from documents)
    select (select count(*) from t) as n, round((select avg(len(terms)) from t), 6) as avgdl, (select count(distinct term) from (select unnest(terms) as term from t)) as n_terms""")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return bm25.corpus_stats(table(spark, d, "documents"), "doc_id").select("n", F.round("avgdl", 6).alias("avgdl"), "n_terms")


BM25_SQL = """
    with t as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}') as terms from documents),
    p as (select doc_id, term, count(*) as tf from (select doc_id, unnest(terms) as term from t) group by 1, 2),
    df as (select term, count(*) as df from p group by 1),
    n as (select count(*)::double as n, avg(len(terms))::double as avgdl from t),
    q as (select query_id, term, count(*) as times from (select doc_id as query_id, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}')) as term from documents where doc_id % 100 = 0) group by 1, 2),
    w as (select query_id, term, times * ln((n.n + 1.0::double) / df) as w from q join df using (term), n),
    base as (select query_id, 0.5::double * sum(w) as base from w group by 1),
    m as (select query_id, p.doc_id, sum(w * 2.5::double * tf / (1.5::double * (0.25::double + 0.75::double * len(t.terms) / n.avgdl) + tf)) as s
          from w join p using (term) join t on t.doc_id = p.doc_id, n group by 1, 2),
    s as (select i.doc_id as query_id, t.doc_id, coalesce(m.s, 0.0::double) + coalesce(base.base, 0.0::double) as score
          from (select doc_id from documents where doc_id % 100 = 0) i cross join t left join m on m.query_id = i.doc_id and m.doc_id = t.doc_id left join base on base.query_id = i.doc_id)
    select query_id, doc_id, cast(rank as int) as rank, round(score, 6) as score
    from (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from s) where rank <= 30"""


def _bm25(spark: SparkSession, d: str, text: F.Column) -> DataFrame:
    docs = table(spark, d, "documents")
    asked = docs.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), text.alias("text"))
    found = bm25.top_k(bm25.index(docs, "doc_id"), asked, 30, item="doc_id")
    return found.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(BM25_SQL.format(text="split_part(text, chr(10), 1)"))
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The first lines of a hundredth of the documents as queries against all of them."""
    return _bm25(spark, d, F.get(F.split("text", "\n"), F.lit(0)))


@query(BM25_SQL.format(text="text"))
def bm25_topk_texts(spark: SparkSession, d: str) -> DataFrame:
    """The whole texts of a hundredth of the documents as queries against all of them."""
    return _bm25(spark, d, F.col("text"))


@query(BM25_SQL.format(text="'zzqx' || doc_key"))
def bm25_no_match_padding(spark: SparkSession, d: str) -> DataFrame:
    """Queries whose terms no document has still get their number of rows."""
    return _bm25(spark, d, F.concat(F.lit("zzqx"), F.col("doc_key")))


# ---- fusion and search ---------------------------------------------------------------------------------------------

FUSED_SQL = """
    d as (select query_id, chunk_id, min(rank) as dense_rank from ranked_list where ranker = 'dense' group by 1, 2),
    s as (select query_id, chunk_id, min(rank) as sparse_rank from ranked_list where ranker = 'sparse' group by 1, 2),
    f as (select *, coalesce(1.0::double / (60 + dense_rank), 0.0::double) + coalesce(1.0::double / (60 + sparse_rank), 0.0::double) as score from d full join s using (query_id, chunk_id)),
    fused as (select *, cast(row_number() over (partition by query_id order by score desc, dense_rank asc nulls last, sparse_rank asc nulls last, chunk_id) as int) as fused_rank from f)"""


def _fused(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "ranked_list").select("query_id", "ranker", "chunk_id", "rank")
    return fusion.fuse(lists.filter("ranker = 'dense'"), lists.filter("ranker = 'sparse'"))


@query(f"with {FUSED_SQL} select query_id, chunk_id, dense_rank, sparse_rank, score, fused_rank from fused")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("query_id", "chunk_id", "dense_rank", "sparse_rank", "score", "fused_rank")


@query("""
    select query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 12) as score
    from (select query_id, chunk_id, ranker, min(rank) as rank from ranked_list group by 1, 2, 3) group by 1, 2""")
def rrf_many_lists(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse_many(table(spark, d, "ranked_list")).withColumn("score", F.round("score", 12))


@query("""
    select query_id, score, count(*) as n, min(dense_rank) as best_dense, min(sparse_rank) as best_sparse from (with """ + FUSED_SQL + """ select * from fused)
    group by 1, 2 having count(*) > 1""")
def rrf_ties(spark: SparkSession, d: str) -> DataFrame:
    """Scores that several items of a query share."""
    tied = _fused(spark, d).groupBy("query_id", "score").agg(F.count("*").alias("n"), F.min("dense_rank").alias("best_dense"), F.min("sparse_rank").alias("best_sparse"))
    return tied.filter("n > 1")


HITS_SQL = "with " + FUSED_SQL + """,
    c as (select distinct chunk_id, doc_id, page_no, len(coalesce(headings, [])) as n_headings from chunks),
    h as (select fused.*, d.file_name, d.rel_path, d.stage, d.format, c.page_no, cast(c.n_headings as int) as n_headings from fused join c using (chunk_id) join documents d on d.doc_key = c.doc_id {where})
    select query_id, rank, chunk_id, score, file_name, rel_path, stage, format, page_no, n_headings
    from (select *, cast(row_number() over (partition by query_id order by fused_rank) as int) as rank from h) where rank <= 5"""


def _hits(spark: SparkSession, d: str, stage: str | None = None, formats: list[str] | None = None) -> DataFrame:
    chunks = table(spark, d, "chunks").select("chunk_id", "doc_id", "page_no", F.size(F.coalesce("headings", F.array().cast("array<string>"))).alias("n_headings")).distinct()
    docs = table(spark, d, "documents").select(F.col("doc_key").alias("doc_id"), "file_name", "rel_path", "stage", "format")
    # only the chunks of some list are looked up
    listed = _fused(spark, d)
    meta = chunks.join(listed.select("chunk_id").distinct(), "chunk_id", "left_semi").join(docs, "doc_id")
    return search.final(listed, meta, 5, stage, formats).select("query_id", "rank", "chunk_id", "score", "file_name", "rel_path", "stage", "format", "page_no", "n_headings")


@query(HITS_SQL.format(where=""))
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d)


@query(HITS_SQL.format(where="where d.stage = '1단계'"))
def postfilter_stage(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, stage="1단계")


@query(HITS_SQL.format(where="where d.format in ('pdf', 'hwp')"))
def postfilter_format(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, formats=["pdf", "hwp"])


def _searched(spark: SparkSession, d: str, stage: str | None = None, formats: list[str] | None = None) -> DataFrame:
    """Hits of the whole texts of a hundredth of the documents among all chunks, from dense and BM25+ candidates."""
    config = Config()
    docs = table(spark, d, "documents")
    about = docs.select(F.col("doc_key").alias("doc_id"), "file_name", "rel_path", "stage", "format")
    chunks = table(spark, d, "chunks").select("chunk_id", "doc_id", "text", "page_no", "headings").dropDuplicates(["chunk_id"]).join(about, "doc_id")
    chunks = saved(chunks)  # read several times, mostly without the texts
    passages = chunks.select("chunk_id", X.prefixed(config.passage_prefix, F.col("text")).alias("text"))
    cache = spark.createDataFrame([], "model_id string, hash string, dim int, vec array<float>")
    vectors, _ = embed.embed_cached(passages, cache, config.model_id, dimensions=config.dimensions)
    asked = docs.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    hits = search.search(chunks, saved(vectors.select("chunk_id", "embedding")), asked, config, stage=stage, formats=formats)
    return hits.select("query_id", "rank", "chunk_id", "score", "source.file_name", "source.rel_path", "source.stage", "source.format", "source.page_no", F.size(F.coalesce("source.headings", F.array().cast("array<string>"))).alias("n_headings"))


@query()
def search_texts(spark: SparkSession, d: str) -> DataFrame:
    return _searched(spark, d)


@query()
def search_texts_stage(spark: SparkSession, d: str) -> DataFrame:
    return _searched(spark, d, stage="1단계")


@query()
def search_texts_format(spark: SparkSession, d: str) -> DataFrame:
    return _searched(spark, d, formats=["pdf", "hwp"])


@query("""
    select chunk_id, ord, replace(substring(text, 1, 400), chr(10), ' ') as snippet,
      array_to_string(coalesce(headings, []), ' > ') || case when coalesce(page_no, 0) > 0 then ' p.' || page_no else '' end as breadcrumb from chunks""")
def hit_snippet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", "ord", X.snippet(F.col("text")).alias("snippet"), X.breadcrumb(F.col("headings"), F.col("page_no")).alias("breadcrumb"))


@query("""
    with one as (select query_id, chunk_id from (select *, row_number() over (partition by query_id order by rank, chunk_id) as n from ranked_list where ranker = 'dense') where n = 1),
    c as (select distinct chunk_id, text from chunks),
    q as (select one.query_id, list_distinct(regexp_extract_all(lower(c.text), '[\\p{L}\\p{N}_]{2,}')) as terms from one join c using (chunk_id)),
    k as (select query_id, chunk_id, cast(min(rank) as int) as fused_rank from ranked_list where ranker = 'sparse' group by 1, 2),
    s as (select k.query_id, k.chunk_id, k.fused_rank, cast(len(list_intersect(q.terms, list_distinct(regexp_extract_all(lower(c.text), '[\\p{L}\\p{N}_]{2,}')))) as double) as rerank_score from k join q using (query_id) join c on c.chunk_id = k.chunk_id)
    select query_id, chunk_id, fused_rank, rerank_score, rank from (select *, cast(row_number() over (partition by query_id order by rerank_score desc, fused_rank, chunk_id) as int) as rank from s) where rank <= 5""")
def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    """Sparse candidates by the terms they share with the query's best dense hit."""
    lists = table(spark, d, "ranked_list")
    first = W.Window.partitionBy("query_id").orderBy("rank", "chunk_id")
    best = lists.filter("ranker = 'dense'").withColumn("n", F.row_number().over(first)).filter("n = 1").select("query_id", "chunk_id")
    asked = lists.filter("ranker = 'sparse'").groupBy("query_id", "chunk_id").agg(F.min("rank").cast("int").alias("fused_rank"))
    used = best.select("chunk_id").unionByName(asked.select("chunk_id")).distinct()
    texts = table(spark, d, "chunks").select("chunk_id", "text").join(used, "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
    about = best.join(texts, "chunk_id").select("query_id", F.col("text").alias("query_text"))
    candidates = asked.join(about, "query_id").join(texts, "chunk_id").withColumn("place", F.struct("fused_rank", "chunk_id"))
    return rerank.rerank(candidates, rerank.scorer("overlap"), 5, order="place").select("query_id", "chunk_id", "fused_rank", "rerank_score", "rank")


@query("""
    with r as (select query_id, chunk_id, min(rank) as rank from ranked_list where ranker = 'dense' group by 1, 2),
    g as (select query_id, chunk_id, max(11 - rank) as gain from ranked_list where ranker = 'sparse' group by 1, 2),
    dcg as (select query_id, sum(coalesce(gain, 0) / log2(rank + 1.0::double)) as dcg from r left join g using (query_id, chunk_id) where rank <= 10 group by 1),
    ideal as (select query_id, sum(gain / log2(n + 1.0::double)) as ideal from (select *, row_number() over (partition by query_id order by gain desc, chunk_id) as n from g) where n <= 10 group by 1)
    select query_id, round(case when ideal > 0 then dcg / ideal else 0.0::double end, 9) as ndcg from dcg left join ideal using (query_id)""")
def ndcg_at_10(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "ranked_list")
    ranked = lists.filter("ranker = 'dense'").groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))
    gains = lists.filter("ranker = 'sparse'").groupBy("query_id", "chunk_id").agg(F.max(11 - F.col("rank")).alias("gain"))
    return evaluate.ndcg(ranked, gains).withColumn("ndcg", F.round("ndcg", 9))


# ---- files and gates -----------------------------------------------------------------------------------------------


@query("select doc_id, doc_key, substring(sha1(rel_path), 1, 16) as computed, case when position('/' in rel_path) > 0 then split_part(rel_path, '/', 1) else '' end as first_part from documents where rel_path is not null")
def doc_id_sha1(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").filter("rel_path is not null")
    return rows.select("doc_id", "doc_key", paths.doc_key(F.col("rel_path")).alias("computed"), paths.stage_of(F.col("rel_path")).alias("first_part"))


@query("select doc_id, sha256(text) as sha from documents where text is not null")
def content_sha(spark: SparkSession, d: str) -> DataFrame:
    """No text here is above the hashed part of a file."""
    return table(spark, d, "documents").filter("text is not null").select("doc_id", paths.content_sha(F.encode("text", "UTF-8")).alias("sha"))


EXT_SQL = "regexp_replace(lower(trim(ext)), '^[.]', '')"
FORMAT_SQL = f"case when {EXT_SQL} in ('csv', 'htm', 'html', 'md', 'txt') then 'txt' when {EXT_SQL} in ('xls', 'xlsx') then 'xlsx' when {EXT_SQL} in ('pdf', 'docx', 'pptx', 'hwp') then {EXT_SQL} end"
BINARY_SQL = ", ".join(f"'{b}'" for b in paths.BINARY)


@query(f"""
    select ext, {FORMAT_SQL} as format, case when {FORMAT_SQL} is not null then null when {EXT_SQL} in ({BINARY_SQL}) then 'unsupported_binary' else 'unknown_extension' end as reason, count(*) as n
    from file_listing group by all""")
def format_map(spark: SparkSession, d: str) -> DataFrame:
    ext = F.col("ext")
    return table(spark, d, "file_listing").groupBy("ext", paths.format_of(ext).alias("format"), paths.skip_reason(ext).alias("reason")).agg(F.count("*").alias("n"))


LATEST_SQL = """
    latest as (select * exclude (n) from (select *, row_number() over (partition by rel_path order by seen_at desc nulls last, loaded_at desc nulls last, size_bytes desc nulls last, mtime desc nulls last, path) as n
               from file_listing where rel_path is not null) where n = 1)"""


@query(f"with {LATEST_SQL} select rel_path, path, size_bytes, mtime from latest")
def listing_latest(spark: SparkSession, d: str) -> DataFrame:
    return L.latest(table(spark, d, "file_listing")).select("rel_path", "path", "size_bytes", "mtime")


@query(f"""
    with {LATEST_SQL} select rel_path, size_bytes from latest
    where not list_has_any(string_split(rel_path, '/'), ['.git', '__pycache__', '.venv']) and not starts_with(split_part(rel_path, '/', -1), '~$')""")
def listing_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The walk without excluded folders and lock files."""
    rows = L.latest(table(spark, d, "file_listing"))
    keep = ~paths.excluded(F.col("rel_path"), [".git", "__pycache__", ".venv"]) & ~paths.lock_file(F.element_at(F.split("rel_path", "/"), -1))
    return rows.filter(keep).select("rel_path", "size_bytes")


GATE_SQL = LATEST_SQL + """,
    x as (select *, substring(sha1(rel_path), 1, 16) as doc_key, lower(regexp_extract(split_part(rel_path, '/', -1), '[^/][.]([^./]+)$', 1)) as e from latest),
    g as (select x.rel_path, x.doc_key, d.status as old_status,
      case when not (e in ('csv', 'htm', 'html', 'md', 'txt', 'xls', 'xlsx', 'pdf', 'docx', 'pptx', 'hwp')) then case when e in (""" + BINARY_SQL + """) then 'unsupported_binary' else 'unknown_extension' end
           when x.size_bytes > 120 * 1024 * 1024 then 'too_large' when d.status in ('ok', 'skipped') and d.mtime = x.mtime then 'cached' end as gate
      from x left join documents d on d.doc_key = x.doc_key)"""


def _gated(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_key", "status", "mtime")
    rows = L.latest(table(spark, d, "file_listing")).select("rel_path", "size_bytes", "mtime")
    return gates.gated(rows, docs)


@query(f"with {GATE_SQL} select rel_path, doc_key, old_status, gate from g")
def gate_status(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d).select("rel_path", "doc_key", "old_status", "gate")


@query(f"""with {GATE_SQL} select case when old_status is null then 'new' when old_status = 'failed' then 'retry' else 'changed' end as why, count(*) as files from g where gate is null group by 1""")
def incremental_gate(spark: SparkSession, d: str) -> DataFrame:
    """Why files go on to be read."""
    why = F.when(F.col("old_status").isNull(), "new").when(F.col("old_status") == "failed", "retry").otherwise("changed")
    return _gated(spark, d).filter("gate is null").groupBy(why.alias("why")).agg(F.count("*").alias("files"))


@query("""
    select case when status = 'skipped' and starts_with(coalesce(error, ''), 'duplicate_of:') then 'duplicate' else status end as outcome, count(*) as documents, coalesce(sum(n_chunks), 0)::bigint as chunks from documents group by 1""")
def ingest_counters(spark: SparkSession, d: str) -> DataFrame:
    return gates.counters(table(spark, d, "documents"))


@query("""
    with o as (select content_sha, min({'p': rel_path, 'k': doc_key}).k as owner from documents where status = 'ok' and content_sha is not null group by 1)
    select d.doc_key, o.owner, d.doc_key <> o.owner as duplicate from documents d join o using (content_sha)""")
def dedup_by_sha(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_key", "content_sha", "status", "rel_path")
    return docs.join(gates.owners(docs), "content_sha").select("doc_key", "owner", (F.col("doc_key") != F.col("owner")).alias("duplicate"))


@query("""
    select date_trunc('day', seen_at) as window_start, ext, count(*) as scanned, count(distinct rel_path) as files
    from (select distinct on (root, rel_path, seen_at) root, rel_path, seen_at, ext from file_listing where seen_at is not null) group by 1, 2""")
def scan_windows(spark: SparkSession, d: str) -> DataFrame:
    return stream.windows(table(spark, d, "file_listing"))


# ---- text and chunks -----------------------------------------------------------------------------------------------


@query("""
    select distinct chunk_id, replace(replace(text, '||', '|' || chr(10) || '|'), '||', '|' || chr(10) || '|') as repaired from chunks where contains(text, '||')""")
def glue_repair(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").filter(F.contains("text", F.lit("||"))).select("chunk_id", X.unglued(F.col("text")).alias("repaired"))
    return rows.distinct()


BLANK_SQL = "[\\s\\x{1c}-\\x{1f}\\x{85}\\p{Z}]"
SOLID_SQL = "[^\\s\\p{Z}]"
RULES_SQL = "\n".join(f"when regexp_matches(line, '{p.replace('{b}', BLANK_SQL).replace('{s}', SOLID_SQL)}') then {n}" for p, n in X.HEADINGS)


@query(f"""
    with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents where text is not null)
    select doc_id, cast(line_no as int) as line_no, level, repeat('#', level) || ' ' || line as heading from (select *, cast(case
      when length(line) > 60 or suffix(line, '다.') or suffix(line, '요.') or suffix(line, '임.') or suffix(line, '함.') then null
      when regexp_matches(line, '^{BLANK_SQL}*\\p{{Nd}}{{4}}{BLANK_SQL}*[.\\-/년]') or not regexp_matches(line, '[가-힣A-Za-z]') then null
      {RULES_SQL} end as int) as level from l) where level is not null""")
def heading_promote(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    found = lines.withColumn("level", X.heading_level(F.col("line"))).filter("level is not null")
    return found.select("doc_id", "line_no", "level", X.promoted(F.col("line")).alias("heading"))


@query(f"select chunk_id, ord, length(regexp_replace(text, '^{BLANK_SQL}+|{BLANK_SQL}+$', '', 'g'))::int as solid_chars, length(regexp_replace(text, '^{BLANK_SQL}+|{BLANK_SQL}+$', '', 'g')) >= 300 as kept from chunks")
def min_chars(spark: SparkSession, d: str) -> DataFrame:
    """The length filter at a limit that drops some of these chunks."""
    text = F.col("text")
    return table(spark, d, "chunks").select("chunk_id", "ord", F.length(X.strip(text)).alias("solid_chars"), X.long_enough(text, 300).alias("kept"))


@query(f"select doc_id, trim(regexp_replace(regexp_replace(text, '{BLANK_SQL}+', ' ', 'g'), '^ | $', '', 'g'), ' ') as flat, replace(text, '|', '\\|') = text as no_bars from documents where text is not null")
def flat_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts on one line, and whether a cell would have to escape something."""
    rows = table(spark, d, "documents").filter("text is not null")
    return rows.select("doc_id", X.flat(F.col("text")).alias("flat"), (X.html_cell(F.col("text")) == F.col("text")).alias("no_bars"))


@query("select chunk_id, ord, cast(to_json(coalesce(headings, [])) as varchar) as headings_json, coalesce(page_no, 0) > 0 as has_page from chunks")
def headings_export(spark: SparkSession, d: str) -> DataFrame:
    """Headings as JSON, as only an export needs them."""
    return table(spark, d, "chunks").select("chunk_id", "ord", F.to_json(F.coalesce("headings", F.array().cast("array<string>"))).alias("headings_json"), (F.coalesce("page_no", F.lit(0)) > 0).alias("has_page"))


@query("""
    select query_id, ranker, chunk_id, rank, cast(row_number() over (partition by query_id, ranker order by rank, chunk_id) as int) as position,
      rank - row_number() over (partition by query_id, ranker order by rank, chunk_id) = 0 as dense from ranked_list""")
def rank_positions(spark: SparkSession, d: str) -> DataFrame:
    """Ranks from 1 by the order of each list."""
    lists = table(spark, d, "ranked_list").withColumnRenamed("rank", "given").withColumn("position", F.struct("given", "chunk_id"))
    rows = fusion.ranks(lists, "query_id", "ranker")
    return rows.select("query_id", "ranker", "chunk_id", F.col("given").alias("rank"), F.col("rank").alias("position"), (F.col("given") == F.col("rank")).alias("dense"))


@query("""
    select coalesce(d.status, 'no document') as status, count(*) as chunks, count(*) filter (d.status is distinct from 'ok') as stale from chunks c left join documents d on d.doc_key = c.doc_id group by 1""")
def stale_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by their document's status: those of documents that failed later are still searched unless asked otherwise."""
    docs = table(spark, d, "documents").select(F.col("doc_key").alias("doc_id"), "status")
    rows = table(spark, d, "chunks").select("doc_id").join(docs, "doc_id", "left")
    return rows.groupBy(F.coalesce("status", F.lit("no document")).alias("status")).agg(F.count("*").alias("chunks"), F.count_if(~F.col("status").eqNullSafe("ok")).alias("stale"))


PARAMS_SQL = """
    p as (select c.*, lower(trim(d.format)) as fmt, coalesce(o.overlap_tokens, z.overlap_tokens) as overlap_tokens, coalesce(o.max_tokens, z.max_tokens) as max_tokens
      from (select distinct on (chunk_id) chunk_id, doc_id, ord, text from chunks) c left join documents d on d.doc_key = c.doc_id left join chunk_params o on o.format = lower(trim(d.format))
      cross join (select * from chunk_params where format = 'default') z)"""
TAIL_SQL = """
    e as (select *, cast(floor(overlap_tokens * 2.5) as int) as n, case when cast(floor(overlap_tokens * 2.5) as int) <= 0 then '' else right(text, cast(floor(overlap_tokens * 2.5) as int)) end as e from p),
    t as (select *, case when instr(e, ' ') between 1 and 40 then substring(e, instr(e, ' ') + 1) else e end as tail from e)"""


def _with_params(spark: SparkSession, d: str) -> DataFrame:
    """Distinct chunks with the parameters of their format; the few rows of chunk_params are broadcast."""
    params = table(spark, d, "chunk_params").select(F.col("format").alias("fmt"), "max_tokens", "overlap_tokens")
    default = params.filter("fmt = 'default'").select(F.col("max_tokens").alias("m"), F.col("overlap_tokens").alias("o"))
    docs = table(spark, d, "documents").select(F.col("doc_key").alias("doc_id"), F.lower(F.trim("format")).alias("fmt"))
    rows = table(spark, d, "chunks").select("chunk_id", "doc_id", "ord", "text").dropDuplicates(["chunk_id"])
    # the one row of defaults; without it a format that has no row of its own has nulls
    both = rows.join(docs, "doc_id", "left").join(F.broadcast(params), "fmt", "left").join(F.broadcast(default), F.lit(True), "left")
    return both.withColumn("max_tokens", F.coalesce("max_tokens", "m")).withColumn("overlap_tokens", F.coalesce("overlap_tokens", "o")).drop("m", "o")


@query("""
    select d.doc_key, coalesce(o.max_tokens, z.max_tokens) as max_tokens, coalesce(o.overlap_tokens, z.overlap_tokens) as overlap_tokens, coalesce(o.max_chars, z.max_chars) as max_chars
    from documents d left join chunk_params o on o.format = lower(trim(d.format)) cross join (select * from chunk_params where format = 'default') z""")
def param_overlay(spark: SparkSession, d: str) -> DataFrame:
    params = table(spark, d, "chunk_params")
    names = ("max_tokens", "overlap_tokens", "max_chars")
    default = params.filter("format = 'default'").select(*(F.col(c).alias(f"d_{c}") for c in names))
    docs = table(spark, d, "documents").select("doc_key", F.lower(F.trim("format")).alias("format"))
    both = docs.join(F.broadcast(params), "format", "left").join(F.broadcast(default), F.lit(True), "left")
    return both.select("doc_key", *(F.coalesce(c, f"d_{c}").alias(c) for c in names))


@query(f"with {PARAMS_SQL}, {TAIL_SQL} select chunk_id, tail from t")
def overlap_tail(spark: SparkSession, d: str) -> DataFrame:
    return _with_params(spark, d).select("chunk_id", X.tail(F.col("text"), F.col("overlap_tokens")).alias("tail"))


@query(f"""
    with {PARAMS_SQL}, g as (select * replace (replace(replace(text, '||', '|' || chr(10) || '|'), '||', '|' || chr(10) || '|') as text) from p), {TAIL_SQL.replace("from p)", "from g)")},
    k as (select * from t where length(regexp_replace(text, '^{BLANK_SQL}+|{BLANK_SQL}+$', '', 'g')) >= 300),
    w as (select k.*, b.tail as before from k left join k b on b.doc_id = k.doc_id and b.ord = k.ord - 1)
    select doc_id || '#' || ord as chunk_id, doc_id, ord, n_chars from (select doc_id, cast(row_number() over (partition by doc_id order by ord) - 1 as int) as ord, length(case when coalesce(before, '') = '' then text else before || chr(10) || text end)::int as n_chars from w)""")
def chunk_renumber(spark: SparkSession, d: str) -> DataFrame:
    """The chunk stream at a limit that drops some bodies: tails carried over, ids numbered anew."""
    raw = _with_params(spark, d).select("doc_id", F.col("ord").alias("raw_ord"), F.array().cast("array<string>").alias("headings"), F.col("text").alias("body"), "overlap_tokens")
    return chunking.finished(raw, 300).select("chunk_id", "doc_id", "ord", "n_chars")


@query()
def hybrid_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The library's own chunks of every document."""
    docs = table(spark, d, "documents").filter("text is not null").select(F.col("doc_key").alias("doc_id"), paths.format_of(F.col("format")).alias("format"), F.col("text").alias("markdown"))
    return chunking.chunks(docs, Config())


CELLS_SQL = f"list_transform(string_split(trim(line, ' '), '|')[2:-2], lambda c: regexp_replace(c, '^{BLANK_SQL}+|{BLANK_SQL}+$', '', 'g'))"


@query(f"""
    with l as (select chunk_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from (select distinct on (chunk_id) chunk_id, text from chunks)),
    r as (select chunk_id, n, {CELLS_SQL} as cells from l where starts_with(line, '|') and suffix(line, '|') and length(line) > 1),
    b as (select * from r where len(list_filter(cells, lambda c: c <> '')) > 0),
    g as (select chunk_id, list(cells order by n) as rows, max(len(cells)) as width from b group by 1),
    m as (select chunk_id, list_transform(rows, lambda row: '| ' || array_to_string(row || list_transform(range(width - len(row)), lambda x: ''), ' | ') || ' |') as lines, width, rows from g)
    select chunk_id, cast(len(rows) as int) as n_rows, cast(width as int) as width, array_to_string([lines[1], '|' || repeat('---|', width)] || lines[2:], chr(10)) as markdown from m""")
def grid_markdown(spark: SparkSession, d: str) -> DataFrame:
    """The table rows of each chunk brought to one width."""
    chunks = table(spark, d, "chunks").select("chunk_id", "text").dropDuplicates(["chunk_id"])
    lines = F.filter(F.split("text", "\n"), lambda x: x.startswith("|") & x.endswith("|") & (F.length(x) > 1))
    cells = F.transform(lines, lambda x: F.slice(F.split(F.trim(x), r"\|"), F.lit(2), F.size(F.split(x, r"\|")) - 2))
    grid = F.transform(cells, lambda row, r: F.transform(row, lambda c, k: F.struct(F.trim(c).alias("text"), r.alias("start_row"), k.alias("start_col"))))
    rows = chunks.withColumn("rows", G.grid_rows(grid)).filter(F.size("rows") > 0)
    return rows.select("chunk_id", F.size("rows").alias("n_rows"), G.width(F.col("rows")).alias("width"), G.markdown(F.col("rows")).alias("markdown"))


@query(f"""
    with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents where text is not null),
    f as (select doc_id, n, trim(regexp_replace(line, '{BLANK_SQL}+', ' ', 'g'), ' ') as line from l),
    h as (select *, case
      when length(line) > 60 or suffix(line, '다.') or suffix(line, '요.') or suffix(line, '임.') or suffix(line, '함.') then null
      when regexp_matches(line, '^{BLANK_SQL}*\\p{{Nd}}{{4}}{BLANK_SQL}*[.\\-/년]') or not regexp_matches(line, '[가-힣A-Za-z]') then null
      {RULES_SQL} end as level from f where line <> '')
    select doc_id, count(*) as blocks, count(level) as promoted, sum(length(line) + coalesce(level + 1, 0))::bigint as chars from h group by 1""")
def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The lines of every document as paragraphs of markup, read back as blocks, outline lines as headings."""
    docs = table(spark, d, "documents").filter("text is not null")
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<html><body>"), F.array_join(F.transform(F.split(escaped, "\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), ""), F.lit("</body></html>"))
    blocks = docs.select("doc_id", F.explode(H.blocks(page)).alias("b")).select("doc_id", X.flat(F.col("b.text")).alias("line"))
    shown = blocks.withColumn("shown", H.markdown(F.array(F.struct(F.lit(0).alias("level"), F.col("line").alias("text"), F.lit(None).cast("array<array<string>>").alias("rows")))))
    return shown.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("shown") != F.col("line")).alias("promoted"), F.sum(F.length("shown")).alias("chars"))


# ---- the store -----------------------------------------------------------------------------------------------------


@query("""
    select c.chunk_id, c.ord, d.file_name, d.rel_path, d.stage, d.format, cast(len(coalesce(c.headings, [])) as int) as n_headings from chunks c join documents d on d.doc_key = c.doc_id""")
def all_chunks_join(spark: SparkSession, d: str) -> DataFrame:
    rows = store.all_chunks(table(spark, d, "chunks"), table(spark, d, "documents"))
    return rows.select("chunk_id", "ord", "file_name", "rel_path", "stage", "format", F.size("headings").alias("n_headings"))


@query("select format, count(distinct doc_key) as docs, count(c.chunk_id) as chunks from documents d left join chunks c on c.doc_id = d.doc_key where d.status = 'ok' group by 1")
def stats_by_format(spark: SparkSession, d: str) -> DataFrame:
    return store.stats_by_format(table(spark, d, "documents"), table(spark, d, "chunks"))


@query("""
    select count(*) filter (status = 'ok') as documents_ok, count(*) filter (status = 'failed') as documents_failed, count(*) filter (status = 'skipped') as documents_skipped, (select count(*) from chunks) as chunks from documents""")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return store.status_counts(table(spark, d, "documents"), table(spark, d, "chunks"))


@query("select rel_path, coalesce(error, '') as error from documents where status = 'failed'")
def failures_list(spark: SparkSession, d: str) -> DataFrame:
    return store.failures(table(spark, d, "documents"))


@query("select doc_id, case when status = 'ok' then error else substring(concat_ws(': ', status, error), 1, 500) end as note, coalesce(error, '') = '' as primary_reader from documents")
def error_notes(spark: SparkSession, d: str) -> DataFrame:
    note = F.when(F.col("status") == "ok", F.col("error")).otherwise(X.error_note(F.col("status"), F.col("error")))
    return table(spark, d, "documents").select("doc_id", note.alias("note"), (F.coalesce("error", F.lit("")) == "").alias("primary_reader"))


HASH_SQL = "sha256('model-a' || chr(0) || {text})"


@query(f"""
    select count(*) as texts, count(distinct h) as distinct_texts, count(*) filter (cached) as hits, count(distinct h) filter (not cached) as misses from (
      select {HASH_SQL.format(text="'passage: ' || c.text")} as h, {HASH_SQL.format(text="'passage: ' || c.text")} in (select {HASH_SQL.format(text="'passage: ' || x.text")} from chunks x join documents d on d.doc_key = x.doc_id where d.status = 'ok') as cached
      from chunks c)""")
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """Chunks against a cache that holds those of ok documents: joined hits, and misses to encode once each."""
    rows = table(spark, d, "chunks").select("doc_id", X.prefixed("passage: ", F.col("text")).alias("text"))
    ok = table(spark, d, "documents").filter("status = 'ok'").select(F.col("doc_key").alias("doc_id"))
    cache = rows.join(ok, "doc_id", "left_semi").select(F.lit("model-a").alias("model_id"), X.text_hash("model-a", F.col("text")).alias("hash"), F.array(F.lit(0.0)).cast("array<float>").alias("vec"))
    hits, misses = embed.split_by_cache(rows, cache, "model-a")
    every = rows.agg(F.count("*").alias("texts"), F.countDistinct(X.text_hash("model-a", F.col("text"))).alias("distinct_texts"))
    return every.crossJoin(hits.agg(F.count("*").alias("hits"))).crossJoin(misses.agg(F.count("*").alias("misses")))  # one row each


@query(f"""
    select distinct {HASH_SQL.format(text="c.text")} as hash from chunks c
    where {HASH_SQL.format(text="c.text")} not in (select {HASH_SQL.format(text="x.text")} from chunks x join documents d on d.doc_key = x.doc_id where d.status = 'ok')""")
def cache_miss_antijoin(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select("doc_id", "text")
    ok = table(spark, d, "documents").filter("status = 'ok'").select(F.col("doc_key").alias("doc_id"))
    cache = rows.join(ok, "doc_id", "left_semi").select(F.lit("model-a").alias("model_id"), X.text_hash("model-a", F.col("text")).alias("hash"), F.array(F.lit(0.0)).cast("array<float>").alias("vec"))
    return embed.split_by_cache(rows, cache, "model-a")[1].select("hash")


@query(f"""
    with {LATEST_SQL}, n as (select substring(sha1(rel_path), 1, 16) as doc_key, rel_path, size_bytes, mtime from latest)
    select doc_key, rel_path, size_bytes, mtime, status from (
      select n.doc_key, n.rel_path, n.size_bytes, n.mtime, 'seen' as status from n
      union all select d.doc_key, d.rel_path, d.size_bytes, d.mtime, d.status from documents d where d.doc_key not in (select doc_key from n))""")
def upsert_documents(spark: SparkSession, d: str) -> DataFrame:
    """The latest scan of every file put over the stored documents."""
    old = table(spark, d, "documents").select("doc_key", "rel_path", "size_bytes", "mtime", "status")
    new = L.latest(table(spark, d, "file_listing")).select(paths.doc_key(F.col("rel_path")).alias("doc_key"), "rel_path", "size_bytes", "mtime", F.lit("seen").alias("status"))
    return store.upsert(old, new, "doc_key")


@query("""
    with c as (select distinct on (chunk_id) chunk_id, doc_id, ord, text from chunks),
    t as (select doc_id from c where contains(text, '||')),
    n as (select doc_id, chunk_id, ord, replace(replace(text, '||', '|' || chr(10) || '|'), '||', '|' || chr(10) || '|') as text from c where doc_id in (select doc_id from t) and length(text) >= 300),
    k as (select doc_id, cast(row_number() over (partition by doc_id order by ord, chunk_id) - 1 as int) as ord, text from n)
    select doc_id || '#' || ord as chunk_id, doc_id, ord, length(text)::int as n_chars from k
    union all select chunk_id, doc_id, ord, length(text)::int from c where doc_id not in (select doc_id from n)""")
def replace_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents with glued tables get repaired chunks, without short ones, in place of all they had."""
    old = table(spark, d, "chunks").select("chunk_id", "doc_id", "ord", "text").dropDuplicates(["chunk_id"])
    glued = old.filter(F.contains("text", F.lit("||"))).select("doc_id").distinct()
    new = old.join(glued, "doc_id", "left_semi").filter(F.length("text") >= 300).withColumn("text", X.unglued(F.col("text")))
    return store.replace_chunks(old, new).select("chunk_id", "doc_id", "ord", F.length("text").alias("n_chars"))


@query("""
    with l as (select distinct rel_path from file_listing where rel_path is not null) select d.doc_key, d.rel_path from documents d where d.rel_path in (select rel_path from l)""")
def prune_missing(spark: SparkSession, d: str) -> DataFrame:
    return store.prune_missing(table(spark, d, "documents").select("doc_key", "rel_path"), table(spark, d, "file_listing").filter("rel_path is not null")).select("doc_key", "rel_path")


@query()
def embed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A vector of every different chunk text by the stand-in encoder."""
    rows = table(spark, d, "chunks").select("chunk_id", X.prefixed("passage: ", F.col("text")).alias("text")).dropDuplicates(["chunk_id"])
    return embed.embedded(rows, "text").select("chunk_id", "embedding")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
