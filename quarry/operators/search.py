"""Hybrid search: dense and sparse candidates, fused, filtered afterwards, cut, and filled with what a hit shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quarry.config import Config
from quarry.functions import text as X
from quarry.operators import bm25, dense, embed, fusion


def filtered(hits: DataFrame, stage: str | None = None, formats: list[str] | None = None) -> DataFrame:
    """Hits of one stage and of some formats. Blank values are no filter.

    A filter looks at the candidates only: with few of them fewer hits than asked may be left though others match.
    """
    if stage:
        hits = hits.filter(F.col("stage") == stage)
    return hits.filter(F.col("format").isin(list(formats))) if formats else hits


def final(fused: DataFrame, meta: DataFrame, top_k: int = 5, stage: str | None = None, formats: list[str] | None = None, query: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """The best hits of each query with (file_name, rel_path, stage, format, page_no, headings); ``meta`` has these by item.

    The texts themselves are joined by the caller to what is left.
    """
    rows = filtered(fused.join(meta, item), stage, formats)
    order = W.Window.partitionBy(query).orderBy("fused_rank")
    return rows.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= top_k)


def search(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, config: Config | None = None, top_k: int = 0, stage: str | None = None, formats: list[str] | None = None, encode: embed.Encoder = embed.hashing, prefilter: bool = False) -> DataFrame:
    """Hits of a batch of queries (query_id, text) over chunks with their documents' columns and vectors by chunk_id.

    ``top_k`` 0 takes the configured number. Vectors of chunks that are gone are dropped by the join, so that a hole in
    the vectors shifts nothing. ``prefilter`` filters the corpus before the candidates are taken, which is an extension.
    """
    config = config or Config()
    corpus = filtered(chunks, stage, formats) if prefilter else chunks
    kept = vectors.join(corpus.select("chunk_id"), "chunk_id")
    asked = embed.embedded(queries.withColumn("prefixed", X.prefixed(config.query_prefix, F.col("text"))), "prefixed", encode, config.dimensions).drop("prefixed")
    a = dense.top_k(kept, asked, config.dense_top_k)
    b = bm25.top_k(bm25.index(corpus.join(vectors.select("chunk_id"), "chunk_id", "left_semi")), queries, config.sparse_top_k)
    fused = fusion.fuse(a, b, config.rrf_k)
    meta = corpus.select("chunk_id", "file_name", "rel_path", "stage", "format", "page_no", "headings")
    hits = final(fused, meta, top_k or config.final_top_k, stage, formats)
    shown = hits.join(corpus.select("chunk_id", "text"), "chunk_id")
    source = F.struct("file_name", "rel_path", "stage", "format", "page_no", "headings").alias("source")
    return shown.select("query_id", "rank", "chunk_id", F.bround("score", 5).alias("score"), "text", source)  # rounded after the ordering
