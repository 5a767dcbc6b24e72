"""The corpus walk as a stream: scans of files arrive late and repeated, and the store follows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.store import Snapshots, upsert
from quarry.sources.listing import latest


def scans(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of listing rows from parquet files that are put into a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def windows(listing: DataFrame, length: str = "1 day", late: str = "7 days") -> DataFrame:
    """(window_start, ext, scanned, files): rows and different files of each window of seen_at; for streams and tables alike.

    Rows repeated in full count once, and rows later than ``late`` behind the newest are dropped by a stream, as its
    state must end; a table has all of them.
    """
    rows = listing.withWatermark("seen_at", late) if listing.isStreaming else listing
    rows = rows.filter("seen_at is not null").dropDuplicates(["root", "rel_path", "seen_at"])
    out = rows.groupBy(F.window("seen_at", length).alias("w"), "ext").agg(F.count("*").alias("scanned"), F.approx_count_distinct("rel_path", 0.01).alias("files") if listing.isStreaming else F.countDistinct("rel_path").alias("files"))
    return out.select(F.col("w.start").alias("window_start"), "ext", "scanned", "files")


def follow(stream: DataFrame, table: Snapshots, checkpoint: str, key: str = "rel_path", each: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Keeps the table of the latest state of each file: every micro-batch is one snapshot, so a restart goes on after it.

    A batch that is run again after a crash finds its rows already there, and as the latest row of a file wins, the result
    is the same. ``each`` gets what changed, for ingestion.
    """

    def step(batch: DataFrame, _: int) -> None:
        new = latest(batch)
        if table.current() is None:
            table.commit(new)
        else:
            old = table.read()
            newer = latest(new.unionByName(old.join(new.select(key), key, "left_semi")))
            table.commit(upsert(old, newer, key))
        if each is not None:
            each(new)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
