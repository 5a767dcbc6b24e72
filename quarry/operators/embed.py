"""Embedding through a cache: what was encoded before is joined, the rest is encoded once."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import text_hash

#: Encodes a batch of texts to rows of the given dimension. A model is loaded by the function itself, once in a worker.
Encoder = Callable[[list[str], int], np.ndarray]


@lru_cache(maxsize=400_000)
def _hashed(term: str) -> int:
    return int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "little")


def hashing(texts: list[str], dimensions: int) -> np.ndarray:
    """A deterministic stand-in for a model: signed hashed terms, of length one."""
    out = np.zeros((len(texts), dimensions), np.float32)
    for row, text in zip(out, texts):
        h = np.array([_hashed(term) for term in re.findall(r"\w\w+", text.lower())], np.uint64)
        signs = np.where(h >> np.uint64(63), 1.0, -1.0)
        row += np.bincount((h % np.uint64(dimensions)).astype(np.int64), signs, dimensions)  # whole numbers, whatever their order
    return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-12)


#: Encoders by name; callers register their models.
ENCODERS: dict[str, Encoder] = {"hashing": hashing}


def encoder(name: str) -> Encoder:
    if name not in ENCODERS:
        raise ValueError(f"no embedding backend {name}")
    return ENCODERS[name]


def embedded(df: DataFrame, text: str, encode: Encoder = hashing, dimensions: int = 64, vector: str = "embedding") -> DataFrame:
    """``df`` with a vector of its text column; null for a null text."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            made = iter(encode([t for t in s if t is not None], dimensions)) if s.notna().any() else iter(())
            yield pd.Series([None if t is None else next(made).tolist() for t in s], dtype=object)

    return df.withColumn(vector, run(F.col(text)))


def split_by_cache(texts: DataFrame, cache: DataFrame, model_id: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(hits with their vec, distinct misses): texts with ``hash`` looked up in the cache of a model."""
    hashed = texts.withColumn("hash", text_hash(model_id, F.col(text)))
    own = cache.filter(F.col("model_id") == model_id).select("hash", "vec").dropDuplicates(["hash"])
    return hashed.join(own, "hash"), hashed.join(own, "hash", "left_anti").dropDuplicates(["hash"])


def embed_cached(texts: DataFrame, cache: DataFrame, model_id: str, encode: Encoder = hashing, dimensions: int = 64, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts with embedding and hash, the cache's new rows). Equal texts are encoded once; an empty table gives empty ones.

    The cache's key holds the model's name; give another name to another dimension or length.
    """
    _, misses = split_by_cache(texts, cache, model_id, text)
    new = embedded(misses.select("hash", text), text, encode, dimensions, "vec").select(F.lit(model_id).alias("model_id"), "hash", F.size("vec").alias("dim"), "vec")
    own = cache.filter(F.col("model_id") == model_id).select("hash", "vec").unionByName(new.select("hash", "vec")).dropDuplicates(["hash"])
    hashed = texts.withColumn("hash", text_hash(model_id, F.col(text)))
    return hashed.join(own, "hash", "left").withColumnRenamed("vec", "embedding"), new


def drifted(vectors: DataFrame, chunks: DataFrame, model_id: str) -> DataFrame:
    """(chunk_id, reason) where vectors and chunks no longer agree: missing, orphan or changed text."""
    now = chunks.select("chunk_id", text_hash(model_id, F.col("text")).alias("now"))
    both = vectors.select("chunk_id", F.col("text_hash").alias("then")).join(now, "chunk_id", "full")
    reason = F.when(F.col("then").isNull(), "missing").when(F.col("now").isNull(), "orphan").when(F.col("then") != F.col("now"), "changed")
    return both.select("chunk_id", reason.alias("reason")).filter("reason is not null")
