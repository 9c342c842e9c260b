"""Snapshot catalogs and tombstone journals on storage: explicit schemas, append and rewrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT = "ts string, type string, tag string, files bigint, size_bytes bigint, disk_usage_bytes bigint, source string"


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """A catalog in ascending order; fields that older writers lacked get their defaults."""
    rows = spark.read.schema(SNAPSHOT).json(path)
    return rows.withColumns({"disk_usage_bytes": F.coalesce("disk_usage_bytes", F.lit(0).cast("long")), "type": F.coalesce("type", F.lit("full"))}).orderBy("ts")


def append_snapshots(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def rewrite_snapshots(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_tombstones(entries: DataFrame, path: str) -> None:
    """(p, d, t, s) as JSON lines."""
    entries.select("p", "d", "t", "s").write.mode("append").json(path)


def tagged(snapshots: DataFrame, ts: str, tag: str) -> DataFrame:
    return snapshots.withColumn("tag", F.when(F.col("ts") == ts, tag).otherwise(F.col("tag")))


def selected(versions: DataFrame, inode: int, epoch: int) -> DataFrame:
    """The version that a revert to an epoch takes: the newest at or before it."""
    rows = versions.filter((F.col("inode") == inode) & (F.col("epoch_seq") <= epoch))
    return rows.orderBy(F.desc("epoch_seq"), F.desc("timestamp")).limit(1)
