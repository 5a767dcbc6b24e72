"""One run of ingestion over a listing: gates, hashes, ownership of equal contents, reading, chunks, and the rows to store."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.config import Config
from quarry.functions import paths
from quarry.functions import text as X
from quarry.operators import chunking, gates
from quarry.runtime import saved
from quarry.sources import readers


class Ingested(NamedTuple):
    """documents and chunks to put into the store, and the counters of the run."""

    documents: DataFrame
    chunks: DataFrame
    counters: DataFrame


def with_content(files: DataFrame, limit: int | None = None) -> DataFrame:
    """``files`` with their bytes, read by the tasks; at most ``limit`` of each. A file that can't be read has null."""
    names = files.columns

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(len(f)):  # a file at a time, so that a task holds one
                row = f.iloc[k : k + 1].copy()
                try:
                    with open(row.path.iloc[0], "rb") as file:
                        row["content"] = [file.read(limit or -1)]
                except OSError:
                    row["content"] = [None]
                yield row[[*names, "content"]]

    return files.mapInPandas(work, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in files.schema)}, content binary")


def run(listing: DataFrame, stored: DataFrame, config: Config | None = None, force: bool = False, custom: dict | None = None) -> Ingested:
    """The rows that a walk (root_ord, path, rel_path, size_bytes, mtime) adds to the store.

    Of equal contents the first in walk order is read; if that fails, all its other copies are. Failures are rows, a file
    without text is skipped as empty_text, and a document without chunks is ok all the same. Cached files give no rows.
    """
    config = config or Config()
    seen = saved(gates.gated(listing, stored, config.max_file_mb, force).withColumn("ext", paths.extension(F.element_at(F.split("rel_path", "/"), -1))))
    skipped = seen.filter("gate is not null and gate <> 'cached'").select("*", F.lit("skipped").alias("status"), F.col("gate").alias("error"), F.lit(None).cast("string").alias("content_sha"))
    todo = with_content(seen.filter("gate is null"), paths.HASHED_BYTES).withColumn("content_sha", paths.content_sha(F.col("content"))).drop("content")
    todo = saved(todo)
    owned = stored.filter("status = 'ok' and content_sha is not null").groupBy("content_sha").agg(F.min("doc_key").alias("owner"))
    # no window over the copies of a content: of many copies, each task sends on its first; files without a hash are apart
    firsts = todo.filter("content_sha is not null").groupBy("content_sha").agg(F.min(F.struct("root_ord", "path")).alias("first"))
    turns = todo.join(firsts, "content_sha").withColumn("turn", F.when(F.struct("root_ord", "path") == F.col("first"), 1).otherwise(2)).drop("first")
    unread = todo.filter("content_sha is null").select("*", F.lit(1).alias("turn"), F.lit(None).cast("string").alias("owner"))
    todo = saved(turns.join(owned, "content_sha", "left").unionByName(unread))
    free = todo.filter(F.col("owner").isNull() | (F.col("owner") == F.col("doc_key")))

    def read(files: DataFrame) -> DataFrame:
        made = readers.convert(with_content(files.select("path", "ext")), custom).drop("format").withColumnRenamed("error", "read_error")
        return saved(files.join(made, "path"))

    first = read(free.filter("turn = 1"))
    lost = first.filter("read_error is not null").select("content_sha").distinct()
    again = read(free.filter("turn > 1").join(lost, "content_sha", "left_semi"))
    parsed = first.unionByName(again).withColumn("status", F.when(F.col("read_error").isNotNull(), "failed").when(F.col("markdown").isNull(), "skipped").otherwise("ok"))
    parsed = parsed.withColumn("error", F.when(F.col("status") == "failed", F.substring("read_error", 1, 500)).when(F.col("status") == "skipped", "empty_text").otherwise(X.backend_note(F.col("backend"))))
    best = gates.owners(parsed, order="path").withColumnRenamed("owner", "keeps")
    parsed = saved(parsed.join(best, "content_sha", "left"))
    mine = (F.col("status") != "ok") | (F.col("keeps") == F.col("doc_key"))
    kept = parsed.filter(mine)
    twin = parsed.filter(~mine).select("doc_key", F.col("keeps").alias("of")).unionByName(todo.filter("owner is not null and owner <> doc_key").select("doc_key", F.col("owner").alias("of")))
    rest = free.filter("turn > 1").join(parsed.select("doc_key"), "doc_key", "left_anti").join(best, "content_sha", "left").filter("keeps is not null").select("doc_key", F.col("keeps").alias("of"))
    copies = todo.drop("owner").join(twin.unionByName(rest), "doc_key").select("*", F.lit("skipped").alias("status"), F.concat(F.lit("duplicate_of:"), "of").alias("error"))
    texts = kept.filter("status = 'ok'").select(F.col("doc_key").alias("doc_id"), "format", "markdown")
    chunks = saved(chunking.chunks(texts, config))
    n = chunks.groupBy(F.col("doc_id").alias("doc_key")).agg(F.count("*").cast("int").alias("n_chunks"))
    every = None
    for part in (skipped, kept, copies):
        rows = part.select("doc_key", "path", "rel_path", F.element_at(F.split("rel_path", "/"), -1).alias("file_name"), paths.stored_format(F.col("status"), F.col("ext")).alias("format"), paths.stage_of(F.col("rel_path")).alias("stage"), "size_bytes", "mtime", "content_sha", "status", "error")
        every = rows if every is None else every.unionByName(rows)
    documents = saved(every.join(n, "doc_key", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0))))
    cached = seen.filter("gate = 'cached'").agg(F.lit("cached").alias("outcome"), F.count("*").alias("documents"), F.lit(0).cast("long").alias("chunks"))
    return Ingested(documents, chunks, gates.counters(documents).unionByName(cached))
