"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a partition whose task holds them in memory.
SHARE_ROWS = 500_000

_made: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.

    A session on one machine that names none gets a temporary folder; on a
    cluster that is an error, as executors would write to their own disks.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-scratch-"))
        folder = sc.getCheckpointDir()
    return folder


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    path = f"{shared_folder(spark).rstrip('/')}/cinequarry-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts lineage like ``checkpoint()``, but computes the last stage once
    (a reliable checkpoint computes it twice) and keeps the columns compressed.
    A lost executor costs no recomputation of what was written.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shares(spark: SparkSession, rows: int, each: int | None = None) -> int:
    """Partitions for ``rows``: one a core at least, and so many that none has more than ``each`` or so, however many rows there are."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // (each or SHARE_ROWS)))


def written(spark: SparkSession) -> list[str]:
    """Scratch tables of this application that are still there."""
    return list(_made.get(spark.sparkContext.applicationId, ()))


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that no DataFrame in use reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    own = _made.get(spark.sparkContext.applicationId, [])
    for path in paths:
        if path in own:  # nothing but what settle() wrote
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
            own.remove(path)


def release(spark: SparkSession) -> None:
    """Drop what DataFrames that are out of use still hold.

    Spark deletes their shuffle files and broadcasts once the driver has
    collected its garbage, which a large heap puts off; a heap that has grown
    gives memory back then, too.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
