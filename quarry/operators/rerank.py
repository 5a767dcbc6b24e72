"""Reranking of candidates by a model's score, as an operator of its own; the default search keeps the fused order."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

#: Scores of (query, text) pairs, a batch at a time.
Scorer = Callable[[list[str], list[str]], list[float]]


def overlap_score(queries: list[str], texts: list[str]) -> list[float]:
    """A deterministic stand-in for a model: the distinct terms of the query that the text has."""
    find = re.compile(r"\w\w+").findall
    return [float(len({*find(q.lower())} & {*find(t.lower())})) for q, t in zip(queries, texts)]


#: Scorers by name; callers register their models.
SCORERS: dict[str, Scorer] = {"overlap": overlap_score}


def scorer(name: str) -> Scorer:
    if name not in SCORERS:
        raise ValueError(f"no rerank backend {name}")
    return SCORERS[name]


def rerank(candidates: DataFrame, score: Scorer = overlap_score, top_k: int = 5, query: str = "query_id", order: str = "fused_rank") -> DataFrame:
    """The candidates (query, query_text, text, order) with rerank_score and rank, the best top_k of each query.

    Equal scores keep the order they had. Null texts score as empty ones. No candidates, no rows.
    """

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in batches:
            yield pd.Series(score(q.fillna("").tolist(), t.fillna("").tolist()), dtype="float64")

    best = W.Window.partitionBy(query).orderBy(F.col("rerank_score").desc(), F.col(order))
    scored = candidates.withColumn("rerank_score", run("query_text", "text"))
    return scored.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= top_k)
