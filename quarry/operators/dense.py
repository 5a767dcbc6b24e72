"""Exact nearest vectors by cosine, for batches of queries, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

#: Rows of the corpus and of the queries that are multiplied at once, and bytes of the queries that a pass over the corpus takes along.
CORPUS_BLOCK, QUERY_BLOCK, PASS_BYTES = 4096, 512, 32 << 20
#: Scores are ranked by so many digits, then by id, so that ranks are the same on every run.
DIGITS = 9


def ranked(scores: DataFrame, k: int, query: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """The k best of each query with their rank from 1; Spark cuts each partition to k before the shuffle."""
    best = W.Window.partitionBy(query).orderBy(F.round("score", DIGITS).desc(), F.col(item))
    return scores.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k)


def _unit(column: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows of length one, in doubles."""
    m = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12)


def _best(q: np.ndarray, item: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best of each query, ties within the rounding by item."""
    order = np.lexsort((item, -np.round(score, DIGITS), q))
    first = np.searchsorted(q[order], q[order])
    return order[np.arange(len(order)) - first < k]


def top_k(corpus: DataFrame, queries: DataFrame, k: int = 30, item: str = "chunk_id", query: str = "query_id", vector: str = "embedding") -> DataFrame:
    """(query, item, score, rank): the k vectors of largest cosine for each query; fewer if the corpus is smaller.

    The corpus is multiplied where it lies and is never shuffled: the queries go to it, so many a pass that they take
    PASS_BYTES, and a task keeps the k best of each query as it goes, which is all that leaves it. Null vectors have no
    score. k <= 0 and empty sides give no rows. Zero vectors have a cosine of 0.
    """
    schema = T.StructType([T.StructField(query, queries.schema[query].dataType), T.StructField(item, corpus.schema[item].dataType), T.StructField("score", T.DoubleType())])
    left = corpus.select(item, vector).filter(F.col(vector).isNotNull() & F.col(item).isNotNull())
    right = queries.select(query, vector).filter(F.col(vector).isNotNull())
    size = right.agg(F.sum(F.size(vector) * 8)).first()[0] if k > 0 else None
    found = corpus.sparkSession.createDataFrame([], schema)
    passes = -(-(size or 0) // PASS_BYTES)
    for n in range(passes):
        block = right.filter(F.pmod(F.xxhash64(query), F.lit(passes)) == n).toArrow()  # PASS_BYTES, about
        if len(block):
            ids, m = block.column(query).combine_chunks(), _unit(block.column(vector).combine_chunks())
            found = found.unionByName(left.mapInArrow(_multiplied(corpus.sparkSession.sparkContext.broadcast((ids, m)), k, query, item, vector), schema))
    return ranked(found, k, query, item)


def _multiplied(asked: object, k: int, query: str, item: str, vector: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m = asked.value
        q, score, kept = np.zeros(0, np.int64), np.zeros(0), None
        for batch in batches:
            for at in range(0, len(batch), CORPUS_BLOCK):
                part = batch.slice(at, CORPUS_BLOCK)
                units = _unit(part.column(vector)).T
                for start in range(0, len(m), QUERY_BLOCK):
                    scores = m[start : start + QUERY_BLOCK] @ units
                    n = min(k, scores.shape[1])
                    # ties within the rounding go by item: take them all, what is too much goes next
                    limit = np.round(-np.partition(-scores, n - 1, axis=1)[:, n - 1 : n], DIGITS)
                    r, c = np.nonzero(np.round(scores, DIGITS) >= limit)
                    q, score = np.concatenate((q, r + start)), np.concatenate((score, scores[r, c]))
                    mine = part.column(item).take(pa.array(c))
                    kept = mine if kept is None else pa.concat_arrays([kept, mine])
                items = np.unique(kept.to_numpy(zero_copy_only=False), return_inverse=True)[1]  # their order
                best = _best(q, items, score, k)
                q, score, kept = q[best], score[best], kept.take(pa.array(best))
        if kept is not None:
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), kept, pa.array(score)], names=[query, item, "score"])

    return work
