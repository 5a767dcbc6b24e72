"""The store: documents, chunks and vectors as parquet tables that change by whole snapshots.

A snapshot is a set of folders; the table's ``CURRENT`` file names those that hold. Writers write a new folder and then swing
the file, so that a reader never sees half a change and a crash leaves the old state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W


class Snapshots:
    """A parquet table under a folder of any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> list[str] | None:
        marker = self._path(f"{self.folder}/CURRENT")
        if not self._fs.exists(marker):
            return None
        return [r[0] for r in self.spark.read.text(f"{self.folder}/CURRENT").collect()]  # a line for each folder

    def read(self) -> DataFrame:
        if (names := self.current()) is None:
            raise FileNotFoundError(f"{self.folder} has no snapshot: build the index first")
        return self.spark.read.parquet(*(f"{self.folder}/{name}" for name in names))

    def append(self, df: DataFrame) -> str:
        """Adds rows to the current snapshot, whose folders stay as they are."""
        return self.commit(df, self.current() or [])

    def commit(self, df: DataFrame, besides: list[str] | None = None) -> str:
        """Writes a snapshot and makes it the current one, beside some folders of the old. ``df`` may read the snapshot that it replaces."""
        name = f"snapshot-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}")
        temporary, marker = self._path(f"{self.folder}/CURRENT.{name}"), self._path(f"{self.folder}/CURRENT")
        out = self._fs.create(temporary, True)
        out.write(bytearray("\n".join([*(besides or []), name]).encode()))
        out.close()
        # one step that replaces the old name: a crash leaves either the one or the other
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(marker.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.valueOf("OVERWRITE")
        context.rename(self._fs.makeQualified(temporary), self._fs.makeQualified(marker), how)
        return name


def upsert(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their key. ``new`` has one row for each key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


#: Chunks of a document are numbered within runs of so many before the runs are added up, so that no document makes one task.
RUN = 4096


def numbered(chunks: DataFrame) -> DataFrame:
    """Chunks with a dense ``ord`` from 0 within their document, in the order they had, and ids made of both.

    A run holds the chunks whose ord lies in one stretch of RUN; windows number a run, and the runs' sizes are added up.
    """
    rows = chunks.withColumn("_run", F.floor(F.coalesce("ord", F.lit(-1)) / RUN))
    order = W.Window.partitionBy("doc_id", "_run").orderBy("ord", "chunk_id")
    sizes = rows.groupBy(F.col("doc_id").alias("_doc"), F.col("_run").alias("_r")).agg(F.count("*").alias("_n"))
    before = sizes.select("_doc", "_r", F.coalesce(F.sum("_n").over(W.Window.partitionBy("_doc").orderBy("_r").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    both = rows.withColumn("_place", F.row_number().over(order) - 1).join(before, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_run") == F.col("_r")))
    return both.withColumn("ord", (F.col("_place") + F.col("_before")).cast("int")).withColumn("chunk_id", F.concat_ws("#", "doc_id", "ord")).select(*chunks.columns)


def replace_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of the documents in ``new`` replaced by its own, numbered anew."""
    return old.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(numbered(new), allowMissingColumns=True)


def all_chunks(chunks: DataFrame, documents: DataFrame, active_only: bool = False) -> DataFrame:
    """Chunks with their document's file_name, rel_path, stage and format.

    Chunks of documents that failed since are still there unless ``active_only``. Null headings are none.
    """
    docs = documents.filter("status = 'ok'") if active_only else documents
    meta = docs.select(F.col("doc_key").alias("doc_id"), "file_name", "rel_path", "stage", "format")
    return chunks.withColumn("headings", F.coalesce("headings", F.array().cast("array<string>"))).join(meta, "doc_id")


def prune_missing(documents: DataFrame, listing: DataFrame) -> DataFrame:
    """Documents whose file the latest walk still saw."""
    return documents.join(listing.select("rel_path").distinct(), "rel_path", "left_semi")


def status_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents_ok, documents_failed, documents_skipped, chunks."""
    docs = documents.agg(*(F.count_if(F.col("status") == s).alias(f"documents_{s}") for s in ("ok", "failed", "skipped")))
    return docs.crossJoin(chunks.agg(F.count("*").alias("chunks")))  # one row by one row


def stats_by_format(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(format, docs, chunks) of ok documents. Chunks are counted by document before the join, so that no text moves."""
    n = chunks.groupBy(F.col("doc_id").alias("doc_key")).agg(F.count("chunk_id").alias("n"))
    return documents.filter("status = 'ok'").join(n, "doc_key", "left").groupBy("format").agg(F.countDistinct("doc_key").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))


def failures(documents: DataFrame) -> DataFrame:
    """(rel_path, error) of failed documents; the caller orders and cuts what it shows."""
    return documents.filter("status = 'failed'").select("rel_path", F.coalesce("error", F.lit("")).alias("error"))
