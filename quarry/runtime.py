"""What every job needs from its session: tables by path, and a way to cut lineage that survives lost executors."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Whether shuffle files are removed at the end of a query.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table of that name under a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the shared one that the cluster names in ``spark.checkpoint.dir``.

    Only where none is set, as in tests on one machine, a temporary folder takes its place. What lies in it is removed
    when the driver's Python ends, or by :func:`cleared`.
    """
    context = spark.sparkContext
    if getattr(context, "_quarry_folder", None) is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or tempfile.mkdtemp(prefix="spark-checkpoint-")
        context._quarry_folder = f"{named.rstrip('/')}/quarry-{context.applicationId}"
        atexit.register(_at_exit, spark)
    return context._quarry_folder


def _at_exit(spark: SparkSession) -> None:
    try:
        cleared(spark)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass


def cleared(spark: SparkSession) -> None:
    """Removes all saved tables of this application. DataFrames that read them can't be used any more."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/saved")
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once and written as a table into the shared folder; what reads it reads the columns it needs.

    The shuffles that made it are not needed any more, so Spark is told to remove their files when the table is written;
    else they stay until the driver happens to collect its garbage, which on a long job is a multiple of the disk.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/saved/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> SparkSession:
    """Gives the package to the executors, once for each context.

    Where the session names a shared checkpoint folder the archive lies there; only on a session without one, as in tests on
    one machine, it lies in a temporary folder.
    """
    context = spark.sparkContext
    if getattr(context, "_quarry_shipped", None) is None:
        home, archive = Path(__file__).resolve().parent, io.BytesIO()
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, f.relative_to(home.parent))
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared:
            target = f"{shared.rstrip('/')}/quarry-{uuid.uuid4().hex}.zip"
            path = context._jvm.org.apache.hadoop.fs.Path(target)
            out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path, True)
            out.write(bytearray(archive.getvalue()))
            out.close()
        else:
            target = str(Path(tempfile.mkdtemp(prefix="quarry-")) / "quarry.zip")
            Path(target).write_bytes(archive.getvalue())
        context.addPyFile(target)
        context._quarry_shipped = target
    return spark
