"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

RRF_K = 60


def fuse(dense: DataFrame, sparse: DataFrame, k: int = RRF_K, query: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """(query, item, dense_rank, sparse_rank, score, fused_rank) of two ranked lists, by a full outer join.

    The score is 1/(k+rank) of the dense list plus that of the sparse one. Ties keep the order in which a reader of the
    dense list and then the sparse one meets the items. An item that a list repeats counts at its best rank.
    """
    a = dense.groupBy(query, item).agg(F.min("rank").alias("dense_rank"))
    b = sparse.groupBy(query, item).agg(F.min("rank").alias("sparse_rank"))
    both = a.join(b, [query, item], "full")
    part = [F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0)) for c in ("dense_rank", "sparse_rank")]
    order = W.Window.partitionBy(query).orderBy(F.col("score").desc(), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last(), F.col(item))
    return both.withColumn("score", part[0] + part[1]).withColumn("fused_rank", F.row_number().over(order).cast("int"))


def fuse_many(lists: DataFrame, k: int = RRF_K, query: str = "query_id", item: str = "chunk_id", ranker: str = "ranker") -> DataFrame:
    """(query, item, score) of any number of lists (query, ranker, item, rank); an item counts once in each list."""
    once = lists.groupBy(query, item, ranker).agg(F.min("rank").alias("rank"))
    return once.groupBy(query, item).agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"))


def ranks(lists: DataFrame, *by: str) -> DataFrame:
    """Ranks from 1 by the ``position`` in each list, which goes by the given columns (the query if none)."""
    return lists.withColumn("rank", F.row_number().over(W.Window.partitionBy(*(by or ("query_id",))).orderBy("position")).cast("int"))
