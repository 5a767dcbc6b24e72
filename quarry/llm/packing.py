"""Filling containers of a fixed capacity (problem 7): best fit, then a local search by swaps.

Items are dealt by hash into shards of a bounded number, each packed by one task on its own: a shard can waste no more than
one container's room beyond what its items force, which among thousands is nothing. Within a shard the largest items go
first, each to the fullest container that takes it; then the containers are worked on, emptiest first: moving one of their items,
or exchanging one for one or two for one with a fuller container, must raise the sum of squared fills. Mass so flows from
empty to full containers until some are empty and go.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import arrow_text as A
from quarry.llm.tokens import TOKENIZERS, word_counts
from quarry.runtime import saved

#: Items of a shard, about.
SHARD = 5000


class Search(NamedTuple):
    """How far the local search goes: passes over the containers, the part of them, emptiest first, that each pass works on,
    and of how many of a container's items pairs are tried. TO_THE_END, which is what is done unless something else is asked
    for, goes on until the containers are as few as the sizes' sum allows or no exchange gains anything."""

    passes: int | None = None
    emptiest: float = 1.0
    pairs_of: int | None = None


TO_THE_END = Search()


def sizes(documents: DataFrame, tokenizers: list[str], folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, tokenizer, size): tokens of each document under each tokenizer; null and empty texts have none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_counts(tuple(tokenizers), folder)
        for batch in A.runs(batches, "text"):
            for name, size in zip(tokenizers, own.counts(batch.column("text").to_pylist())):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([name] * len(batch)), pa.array(size)], names=["doc_id", "tokenizer", "size"])

    return documents.select("doc_id", "text").filter("doc_id is not null").mapInArrow(work, "doc_id long, tokenizer string, size long").dropDuplicates(["doc_id", "tokenizer"])


def best_fit(size: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, largest items first, each into the fullest container with room."""
    where = np.zeros(len(size), np.int64)
    rooms: list[tuple[int, int]] = []  # (room left, container), sorted
    n = 0
    for i in np.argsort(-size, kind="stable").tolist():
        s = int(size[i])
        k = bisect_left(rooms, (s, -1))
        if k < len(rooms):
            room, c = rooms.pop(k)
        else:
            room, c = capacity, n
            n += 1
        where[i] = c
        if room > s or s == 0:
            insort(rooms, (room - s, c))
    return where


def _outs(mine: list[int], paired: list[int], size: np.ndarray) -> Iterator[tuple[int, ...]]:
    """The items, sorted by size, that may go out alone, then the pairs; of items of one size the first, and the first two for pairs."""
    yield from ((i,) for k, i in enumerate(mine) if not k or size[mine[k - 1]] != size[i])
    paired = [i for k, i in enumerate(paired) if k < 2 or size[paired[k - 2]] != size[i]]
    yield from ((i, j) for a, i in enumerate(paired) for j in paired[a + 1 :])


def improve(size: np.ndarray, where: np.ndarray, capacity: int, search: Search = TO_THE_END) -> np.ndarray:
    """The containers after swaps out of the emptiest ones; never more containers than before."""
    where = where.copy()
    n = int(where.max()) + 1 if len(where) else 0
    fill = np.bincount(where, size, n).astype(np.int64)
    used = np.bincount(where, minlength=n) > 0
    least = -(-int(size.sum()) // capacity)
    members = [set() for _ in range(n)]
    for i, c in enumerate(where.tolist()):
        members[c].add(i)

    def put(i: int, c: int) -> None:
        members[where[i]].discard(i)
        fill[where[i]] -= size[i]
        where[i] = c
        members[c].add(i)
        fill[c] += size[i]

    for _ in count() if search.passes is None else range(search.passes):
        order = np.flatnonzero(used & (fill < capacity))
        order = order[np.argsort(fill[order], kind="stable")]
        gained = False
        for c in order[: max(2, int(search.emptiest * len(order)))].tolist():
            if used.sum() <= least:  # no packing has fewer
                return np.unique(where, return_inverse=True)[1]
            tried = True
            while tried and members[c]:
                tried = False
                mine = sorted(members[c], key=lambda i: -size[i])
                room = capacity - fill
                failed = set()
                for out in _outs(mine, mine[: search.pairs_of], size):
                    x = int(sum(size[i] for i in out))
                    if (len(out), x) in failed:  # what is possible depends on the sum alone
                        continue
                    failed.add((len(out), x))
                    if len(out) == 1:
                        fits = np.flatnonzero(used & (room >= x) & (fill > fill[c] - x))
                        fits = fits[fits != c]
                        if len(fits):  # a plain move, to the fullest
                            put(out[0], int(fits[np.argmax(fill[fits])]))
                            tried = gained = True
                            break
                    d = x - size
                    b = fill[where]
                    gain = d * (b - fill[c] + d)
                    ok = (d > 0) & (d <= room[where]) & (where != c) & (gain > 0)
                    if ok.any():
                        y = int(np.argmax(np.where(ok, gain, -1)))
                        to = int(where[y])
                        for i in out:
                            put(i, to)
                        put(y, c)
                        tried = gained = True
                        break
            if not members[c]:
                used[c] = False
        if not gained:
            break
    return np.unique(where, return_inverse=True)[1]


def pack(items: DataFrame, limits: DataFrame, search: Search = TO_THE_END) -> DataFrame:
    """(purpose, doc_id, piece, start, size, container) of sized items (doc_id, tokenizer, size).

    ``limits`` has purpose, tokenizer and capacity, a few rows. An item above the capacity is cut into pieces of the
    whole capacity, each a container of its own, and a rest, which is packed like any other item; no other item is cut.
    Items of size 0 go along with others. Limits that are null or not positive are left out. ``start`` is the piece's
    first token. ``search`` says how far the local search goes.
    """
    items = saved(items.select("doc_id", "tokenizer", "size"))  # narrow, and read several times
    rows = items.join(F.broadcast(limits.select("purpose", "tokenizer", "capacity").filter("capacity > 0")), "tokenizer").select("purpose", "capacity", "doc_id", "size")
    whole = F.floor(F.col("size") / F.col("capacity"))
    full = rows.filter("size > capacity").withColumn("piece", F.explode(F.sequence(F.lit(0), (whole - 1).cast("int"))))
    full = full.select("purpose", "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("start"), F.col("capacity").cast("long").alias("size"), F.concat_ws("-", "purpose", "doc_id", "piece").alias("container"))
    cut = F.col("size") > F.col("capacity")
    rest = rows.withColumn("piece", F.when(cut, whole).otherwise(0).cast("int")).withColumn("start", F.col("piece") * F.col("capacity").cast("long")).withColumn("size", F.col("size") - F.col("start"))
    rest = rest.filter((F.col("piece") == 0) | (F.col("size") > 0))
    shards = rest.groupBy("purpose").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))  # a row for each limit
    dealt = rest.join(F.broadcast(shards), "purpose").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.col("shards")).cast("int"))

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "doc_id"], ascending=[False, True], ignore_index=True)
        size, capacity = group["size"].to_numpy(np.int64), int(group.capacity.iloc[0])
        where = improve(size, best_fit(size, capacity), capacity, search)
        name = f"{group.purpose.iloc[0]}:{group['shard'].iloc[0]}:"
        return group.assign(container=[f"{name}{c}" for c in where])[["purpose", "doc_id", "piece", "start", "size", "container"]]

    packed = dealt.groupBy("purpose", "shard").applyInPandas(work, "purpose string, doc_id long, piece int, start long, size long, container string")
    return full.unionByName(packed)


def usage(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """(purpose, capacity, containers, tokens, at_least, unused_share) of a packing; at_least is what the tokens would need if items could be cut anywhere."""
    n = packed.groupBy("purpose").agg(F.countDistinct("container").alias("containers"), F.sum("size").alias("tokens"))
    out = n.join(limits.select("purpose", "capacity"), "purpose").withColumn("at_least", F.ceil(F.col("tokens") / F.col("capacity")))
    return out.withColumn("unused_share", 1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))).select("purpose", "capacity", "containers", "tokens", "at_least", "unused_share")
