"""Snapshot catalogs, file versions, and what retention rules delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeflow.operators.dedup import dense_ids

_ALL_BEFORE = (Window.unboundedPreceding, -1)


def listed(snapshots: DataFrame) -> DataFrame:
    """The catalog in ascending order; a missing disk usage is the apparent size."""
    return snapshots.withColumn("disk_usage_bytes", F.coalesce("disk_usage_bytes", "size_bytes")).orderBy("ts")


def by_age(snapshots: DataFrame, cutoff: str) -> DataFrame:
    """Untagged snapshots strictly older than the cutoff (timestamps sort as text)."""
    return snapshots.filter((F.col("ts") < cutoff) & F.col("tag").isNull())


def by_count(snapshots: DataFrame, most: int) -> DataFrame:
    """Untagged ones among the oldest n - most; tagged ones hold their place in the quota.

    A catalog is a small table (one row a snapshot of a store), so its order is one window.
    """
    n = F.count("*").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy("ts"))
    ranked = snapshots.withColumns({"_place": place, "_n": n})
    return ranked.filter((F.col("_place") <= F.col("_n") - most) & F.col("tag").isNull()).drop("_place", "_n")


def by_size(snapshots: DataFrame, most: int) -> DataFrame:
    """Oldest untagged first until what remains fits; tagged ones count but stay."""
    free = F.when(F.col("tag").isNull(), F.col("size_bytes")).otherwise(0)
    freed = F.coalesce(F.sum(free).over(Window.orderBy("ts").rowsBetween(*_ALL_BEFORE)), F.lit(0))
    total = F.sum("size_bytes").over(Window.partitionBy())
    rows = snapshots.withColumns({"_freed": freed, "_total": total})
    return rows.filter((F.col("_total") - F.col("_freed") > most) & F.col("tag").isNull()).drop("_freed", "_total")


def combined(snapshots: DataFrame, cutoff: str, count: int, size: int) -> DataFrame:
    """By age, then by count, then by size, each on what the one before left; with the rule that struck."""
    out, left = None, snapshots
    for rule, f, x in (("age", by_age, cutoff), ("count", by_count, count), ("size", by_size, size)):
        gone = f(left, x).withColumn("rule", F.lit(rule))
        left = left.join(gone.select("ts"), "ts", "left_anti")
        out = gone if out is None else out.unionByName(gone)
    return out


def store_stats(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg(
        F.count("*").alias("snapshots"), F.sum("files").cast("long").alias("files"), F.sum("size_bytes").cast("long").alias("apparent"),
        F.sum("disk_usage_bytes").cast("long").alias("disk"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"),
        F.count("tag").alias("tagged"),
    )


def parsed_version(path: str) -> dict[str, Column]:
    """Inode, epoch and timestamp of an ``inode_epoch_timestamp`` name; null parts where it isn't one."""
    parts = F.split(path, "_")
    part = lambda i: F.expr(f"try_cast(get(split({path}, '_'), {i}) AS BIGINT)")
    whole = F.size(parts) >= 3
    return {n: F.when(whole, part(i)) for i, n in enumerate(("inode", "epoch_seq", "timestamp"))}


def version_index(names: DataFrame) -> DataFrame:
    """Well-formed names, each once, by epoch and time."""
    rows = names.withColumns(parsed_version("path")).filter("inode IS NOT NULL AND epoch_seq IS NOT NULL AND timestamp IS NOT NULL")
    return rows.dropDuplicates(["path"]).orderBy("epoch_seq", "timestamp")


def _newest_first():
    return Window.partitionBy("inode").orderBy(F.desc("epoch_seq"), F.desc("timestamp"), F.desc("path"))


def version_retention(versions: DataFrame, keep: int, most: int, now: int, grace: int = 5) -> DataFrame:
    """Versions to delete: beyond the newest ``keep``, then the oldest while a file's total is over ``most``.

    Ones within ``grace`` seconds of now are never deleted. Walking from the oldest, a version goes while
    what is left without its elders is too much, so it goes iff it and all newer kept ones exceed the bound.
    """
    w = _newest_first()
    place = F.row_number().over(w)
    ranked = versions.withColumn("place", place)
    newer = F.sum(F.when(F.col("place") <= keep, F.col("size")).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = ranked.withColumn("with_newer", newer)
    rule = F.when(F.col("place") > keep, "count").when(F.col("with_newer") > most, "bytes")
    return rows.withColumn("rule", rule).filter(F.col("rule").isNotNull() & (F.abs(F.lit(now) - F.col("timestamp")) >= grace)).drop("place", "with_newer")


def emergency(versions: DataFrame, need: int) -> DataFrame:
    """Oldest by modification time until at least ``need`` bytes are freed; the last may overshoot.

    A running sum over all versions: sums of days first (one row a day), then within the day, so no task
    holds more than a day.
    """
    days = versions.groupBy("mtime").agg(F.sum("size").alias("day"))
    before = days.withColumn("_b", F.coalesce(F.sum("day").over(Window.orderBy("mtime").rowsBetween(*_ALL_BEFORE)), F.lit(0))).filter(F.col("_b") < need)
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("mtime").orderBy("path").rowsBetween(*_ALL_BEFORE)), F.lit(0))
    return versions.join(before.select("mtime", "_b"), "mtime").withColumn("_i", inside).filter(F.col("_b") + F.col("_i") < need).drop("_b", "_i")


def latest_match(files: DataFrame, versions: DataFrame) -> DataFrame:
    """For each file the newest of its versions with the same size and modification time."""
    both = files.join(versions.withColumnRenamed("path", "version"), ["inode", "size", "mtime"], "left")
    return both.groupBy("inode", "size", "mtime").agg(F.max_by("version", F.struct("epoch_seq", "timestamp", "version")).alias("version"))


def checkpoints_to_delete(names: DataFrame, keep: int) -> DataFrame:
    """All but the K newest by name, per stream."""
    place = F.row_number().over(Window.partitionBy("stream").orderBy(F.desc("name")))
    return names.withColumn("_p", place).filter(F.col("_p") > keep).drop("_p")


def evicted(identities: DataFrame, high_water: int) -> DataFrame:
    """Identities to drop over the high-water mark, down to 90 % of it: unlinked first, then least recent."""
    n = identities.count()
    if n <= high_water:
        return identities.limit(0)
    order = F.struct((~F.col("unlinked")).alias("kept"), "last_seq", "inode")
    ranked = dense_ids(identities.withColumn("_order", order), "_order", "_place")
    return ranked.filter(F.col("_place") < n - int(high_water * 0.9)).drop("_order", "_place")


def expired(identities: DataFrame, now_seq: int, idle: int = 100_000) -> DataFrame:
    return identities.filter(F.col("unlinked") | (F.lit(now_seq) - F.col("last_seq") > idle))
