"""The corpus as a table of files."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quarry.functions import paths
from quarry.schema import LISTING


def walk(spark: SparkSession, roots: list[str], exclude_dirs: list[str]) -> DataFrame:
    """Every file below the roots, hidden ones too, but for excluded names and lock files.

    The driver lists only the roots' own entries; each folder below is walked by a task, so that a deep corpus needs no
    single lister. Spark's own file source would silently leave out names that begin with a dot or an underscore.
    """
    entries = [(k, str(Path(r)), str(p)) for k, r in enumerate(roots) for p in sorted(Path(r).iterdir())]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for order, root, entry in zip(frame.root_ord, frame.root, frame.entry):
                found = [entry] if os.path.isfile(entry) else [os.path.join(d, f) for d, _, files in os.walk(entry) for f in files]
                for path in found:
                    stat = os.stat(path)
                    rows.append((order, root, path, Path(path).relative_to(root).as_posix(), stat.st_size, stat.st_mtime))
            yield pd.DataFrame(rows, columns=["root_ord", "root", "path", "rel_path", "size_bytes", "mtime"])

    given = spark.createDataFrame(entries, "root_ord int, root string, entry string").repartition(max(1, min(len(entries), 200)))
    found = given.mapInPandas(work, LISTING)
    return found.filter(~paths.excluded(F.col("rel_path"), exclude_dirs) & ~paths.lock_file(F.element_at(F.split("rel_path", "/"), -1)))


def limited(listing: DataFrame, n: int | None) -> DataFrame:
    """The first n files of the walk, before anything is known of them; 0 and None are no limit."""
    return listing.orderBy("root_ord", "path").limit(n) if n else listing


def latest(listing: DataFrame) -> DataFrame:
    """Each file as its latest scan saw it.

    Scans arrive late and repeated; what was seen last holds, of that what was loaded last. Rows without a path are left
    out; ties are settled by size and time, nulls last, so that the result is one and the same on every run.
    """
    order = [F.col("seen_at").desc_nulls_last(), F.col("loaded_at").desc_nulls_last(), F.col("size_bytes").desc_nulls_last(), F.col("mtime").desc_nulls_last()]
    one = W.Window.partitionBy("rel_path").orderBy(*order, F.col("path"))
    return listing.filter("rel_path is not null").withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")
