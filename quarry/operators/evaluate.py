"""Quality of ranked lists against graded gains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def ndcg(ranked: DataFrame, gains: DataFrame, k: int = 10, query: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """(query, ndcg) of ranked lists (query, item, rank) under gains (query, item, gain); 0 if nothing is to be gained."""
    own = ranked.filter(F.col("rank") <= k).join(gains, [query, item], "left")
    dcg = own.groupBy(query).agg(F.sum(F.coalesce("gain", F.lit(0)) / F.log2(F.col("rank") + F.lit(1.0))).alias("dcg"))
    best = gains.withColumn("n", F.row_number().over(W.Window.partitionBy(query).orderBy(F.col("gain").desc(), F.col(item)))).filter(F.col("n") <= k)
    ideal = best.groupBy(query).agg(F.sum(F.col("gain") / F.log2(F.col("n") + F.lit(1.0))).alias("ideal"))
    return dcg.join(ideal, query, "left").select(query, F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"))
