"""Tombstone journals: tolerant reading, compaction, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "p string, d boolean, t bigint, s bigint"


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """Entries of JSON lines; blank and malformed ones are skipped."""
    entry = F.from_json(F.col(column), SCHEMA, {"mode": "PERMISSIVE"})
    ok = F.col("e.p").isNotNull() & F.col("e.d").isNotNull() & F.col("e.t").isNotNull() & F.col("e.s").isNotNull()
    return lines.filter(F.trim(column) != "").select(entry.alias("e")).filter(ok).select("e.*")


def compacted(entries: DataFrame, now: int, ttl: int) -> DataFrame:
    return entries.filter(F.col("t") >= now - ttl)


def replayed(target: DataFrame, entries: DataFrame, excludes=None) -> DataFrame:
    """Target paths that a journal deletes: the path itself, or anything under a deleted directory.

    A path created again after its tombstone stays: the newest tombstone has to be newer than the file.
    """
    last = entries.groupBy("p", "d").agg(F.max("t").alias("t"))
    own = target.join(last.select(F.col("p").alias("rel"), F.col("t").alias("deleted")), "rel")
    parts = F.split("rel", "/")
    up = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    under = target.filter(F.size(parts) > 1).withColumn("dir", up).join(
        last.filter("d").select(F.col("p").alias("dir"), F.col("t").alias("deleted")), "dir"
    )
    gone = own.select("rel", "mtime_sec", "deleted").unionByName(under.select("rel", "mtime_sec", "deleted")).filter("deleted >= mtime_sec")
    gone = gone.select("rel").distinct()
    return excludes(gone) if excludes else gone
