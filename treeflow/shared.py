"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Lets Spark delete a query's shuffle files as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a folder of this machine is made and set, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="treeflow-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/treeflow/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files; for results that are committed elsewhere."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: cuts lineage, survives executors.

    ``options`` are those of Spark's Parquet writer.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    with shuffles_released(spark):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._treeflow_path = path  # for drop()
    return out


def drop(spark: SparkSession, *paths_or_frames) -> None:
    """Deletes scratch paths through Hadoop's file system, wherever they are."""
    jvm = spark.sparkContext._jvm
    for x in paths_or_frames:
        path = getattr(x, "_treeflow_path", x)
        if isinstance(path, str):
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
