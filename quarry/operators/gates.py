"""What to do with each listed file: the gates of ingestion as one column, and the ownership of equal contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import paths


def gate(ext: Column, size_bytes: Column, max_file_mb: int, old_status: Column, old_mtime: Column, mtime: Column, force: bool = False) -> Column:
    """The first gate that stops a file, in their order: unsupported, too large, cached; null if it goes on.

    A file is cached if it was ok or skipped with the same time; failed ones are always tried again.
    """
    cached = F.lit(False) if force else old_status.isin("ok", "skipped") & (old_mtime == mtime)
    return F.coalesce(paths.skip_reason(ext), F.when(size_bytes > max_file_mb * 1024 * 1024, "too_large"), F.when(cached, "cached"))


def gated(listing: DataFrame, documents: DataFrame, max_file_mb: int = 120, force: bool = False) -> DataFrame:
    """The listing (rel_path, size_bytes, mtime) with doc_key, format and ``gate``, by an equi-join with the stored documents."""
    rows = listing.withColumn("doc_key", paths.doc_key(F.col("rel_path"))).withColumn("_ext", paths.extension(F.element_at(F.split("rel_path", "/"), -1)))
    old = documents.select("doc_key", F.col("status").alias("_status"), F.col("mtime").alias("_mtime"))
    both = rows.join(old, "doc_key", "left")
    out = both.withColumn("gate", gate(F.col("_ext"), F.col("size_bytes"), max_file_mb, F.col("_status"), F.col("_mtime"), F.col("mtime"), force))
    return out.withColumn("format", paths.format_of(F.col("_ext"))).drop("_ext", "_mtime").withColumnRenamed("_status", "old_status")


def owners(parsed: DataFrame, stored: DataFrame | None = None, order: str = "rel_path") -> DataFrame:
    """(content_sha, owner): of equal contents the document that keeps them.

    A document that the store has as ok already stays the owner; else it is the first ok one in walk order. Contents
    without an ok document have no owner, so that every copy of a failed one is tried.
    """
    ok = parsed.filter((F.col("status") == "ok") & F.col("content_sha").isNotNull())
    first = ok.groupBy("content_sha").agg(F.min(F.struct(F.col(order), F.col("doc_key"))).alias("f")).select("content_sha", F.col("f.doc_key").alias("first"))
    if stored is None:
        return first.withColumnRenamed("first", "owner")
    kept = stored.filter((F.col("status") == "ok") & F.col("content_sha").isNotNull()).groupBy("content_sha").agg(F.min(F.struct(F.col(order), F.col("doc_key"))).alias("f")).select("content_sha", F.col("f.doc_key").alias("kept"))
    return first.join(kept, "content_sha", "full").select("content_sha", F.coalesce("kept", "first").alias("owner"))


def outcome(status: Column, error: Column) -> Column:
    """The counter that a document's row adds to: ok, failed, duplicate or skipped."""
    return F.when((status == "skipped") & F.coalesce(error, F.lit("")).startswith("duplicate_of:"), "duplicate").otherwise(status)


def counters(documents: DataFrame) -> DataFrame:
    """(outcome, documents, chunks) of an ingestion."""
    return documents.groupBy(outcome(F.col("status"), F.col("error")).alias("outcome")).agg(F.count("*").alias("documents"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks"))
