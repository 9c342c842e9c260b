"""Sequence analytics over ordered change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CREATES = (8, 10, 16)
DELETES = (9, 5)
LARGE_GAP = 1000


#: Rows of a slice of a sequence domain.
SLICE_ROWS = 100_000


def with_max_before(df: DataFrame, order: str, value: str, name: str, domain: str = "domain") -> DataFrame:
    """Adds the largest ``value`` of the domain's rows that come earlier by ``order`` (null for the first).

    A domain may hold all rows, so it is no window's partition: the order's range is cut into slices, the
    window runs within a slice, and the largest value of the slices before is added from a table of
    one row a slice.
    """
    low, high, n = df.agg(F.min(order), F.max(order), F.count("*")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // max(1, -(-n // SLICE_ROWS))))
    sliced = df.withColumn("_slice", F.floor((F.col(order) - F.lit(low or 0)) / width))
    inside = F.max(value).over(Window.partitionBy(domain, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    tops = sliced.groupBy(domain, "_slice").agg(F.max(value).alias("_top"))
    carry = F.max("_top").over(Window.partitionBy(domain).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select(domain, "_slice", carry.alias("_carry"))
    return sliced.withColumn("_inside", inside).join(tops, [domain, "_slice"]).withColumn(name, F.greatest("_inside", "_carry")).drop("_slice", "_inside", "_carry")


def gaps(events: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Rows that arrive more than one above the highest number so far of their domain (0 at the start)."""
    rows = with_max_before(events, arrival, "seq", "last").withColumn("last", F.coalesce("last", F.lit(0)))
    return rows.filter(F.col("seq") > F.col("last") + 1).select(
        "domain", (F.col("last") + 1).alias("from_seq"), (F.col("seq") - 1).alias("to_seq"),
        (F.col("seq") - F.col("last") > LARGE_GAP).alias("large"),
    )


def reordered(events: DataFrame) -> DataFrame:
    """Events by sequence number, with a ``GAP-from-to`` row in front of each hole; numbers are unique."""
    rows = with_max_before(events.groupBy("domain", "seq").agg(F.min("etype").alias("etype")), "seq", "seq", "before")
    hole = rows.filter("seq > before + 1").select(
        "domain", (F.col("before") + 1).alias("seq"), F.lit(255).alias("etype"),
        F.format_string("GAP-%d-%d", F.col("before") + 1, F.col("seq") - 1).alias("name"),
    )
    return rows.select("domain", "seq", "etype", F.lit(None).cast("string").alias("name")).unionByName(hole)


def late(events: DataFrame, arrival: str = "arrival") -> DataFrame:
    """All events, flagged if a higher number of their domain came before; none is dropped."""
    rows = with_max_before(events, arrival, "seq", "_last")
    return rows.withColumn("late", F.coalesce(F.col("_last") > F.col("seq"), F.lit(False))).drop("_last")


def transient_suppressed(events: DataFrame, drop_pair: bool = False) -> DataFrame:
    """Deletes whose inode was created and not deleted since are dropped; the create stays (or goes too).

    State is set by a create and cleared by any delete, so within creates and deletes it is the event before.
    """
    kind = F.when(F.col("etype").isin(*CREATES), 1).when(F.col("etype").isin(*DELETES), 2)
    w = Window.partitionBy("inode").orderBy("seq")
    marked = events.withColumn("kind", kind)
    own = marked.filter("kind IS NOT NULL").withColumns({"prev": F.lag("kind").over(w), "next": F.lead("kind").over(w)})
    gone = F.coalesce((F.col("kind") == 2) & (F.col("prev") == 1), F.lit(False))
    if drop_pair:
        gone = gone | F.coalesce((F.col("kind") == 1) & (F.col("next") == 2), F.lit(False))
    return own.filter(~gone).drop("prev", "next", "kind").unionByName(marked.filter("kind IS NULL").drop("kind"))


def lifecycle_pruned(events: DataFrame, first: int) -> DataFrame:
    """Of the first m events by number, those of inodes with an unlink among them go.

    Taking the first m is a sort with a limit; the inodes that go come back as a small side of an anti join.
    """
    head = events.orderBy("seq").limit(first)
    gone = head.filter(F.col("etype") == 9).select("inode").distinct()
    limit = head.agg(F.max("seq").alias("head_end"))
    flagged = events.crossJoin(F.broadcast(limit)).join(gone.withColumn("unlinked", F.lit(True)), "inode", "left")
    return flagged.filter(~((F.col("seq") <= F.col("head_end")) & F.coalesce("unlinked", F.lit(False)))).drop("head_end", "unlinked")


def completion_watermark(events: DataFrame) -> DataFrame:
    """(domain, watermark): the highest number with no hole between the first one and it.

    That is the number in front of the first hole, or the last one: two pre-aggregated extremes.
    """
    rows = with_max_before(events.select("domain", "seq").distinct(), "seq", "seq", "before")
    hole = F.min(F.when(F.col("seq") > F.col("before") + 1, F.col("before")))
    return rows.groupBy("domain").agg(F.coalesce(hole, F.max("seq")).alias("watermark"))


def scan_depth(utilisation: Column, base: int) -> Column:
    """How far ahead to look for a merge: ten times above 80 %, twice above 50 %."""
    return F.when(utilisation > 0.8, base * 10).when(utilisation > 0.5, base * 2).otherwise(base)


def rename_storms(events: DataFrame) -> DataFrame:
    """Creates with renames of their inode still to come: their copy is left to the last rename."""
    w = Window.partitionBy("inode").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    pending = F.coalesce(F.count_if(F.col("etype").isin(7, 23)).over(w), F.lit(0))
    return events.withColumn("pending_renames", pending).filter((F.col("etype") == 8) & (F.col("pending_renames") > 0))


def error_streaks(results: DataFrame, least: int = 5) -> DataFrame:
    """Successes right after more than ``least`` failures in a row of a worker: a rescan is due."""
    w = Window.partitionBy("worker").orderBy("seq")
    island = results.withColumn("island", F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    fails = F.count_if(~F.col("ok")).over(Window.partitionBy("worker", "island").orderBy("seq"))
    return island.withColumn("island", F.coalesce("island", F.lit(0))).withColumn("streak", fails).filter(F.col("ok") & (F.col("streak") > least))


def with_type(events: DataFrame, types: DataFrame) -> DataFrame:
    """Events with their type's name, class and predicates; unknown codes count as ``unknown``."""
    known = types.withColumnRenamed("code", "etype")
    joined = events.join(F.broadcast(known), "etype", "left")
    return joined.withColumns({
        "type_name": F.coalesce("type_name", F.lit("unknown")), "tin": F.coalesce("tin", F.lit("bulk")),
        "tin_rank": F.coalesce("tin_rank", F.lit(3)), "control_plane": F.coalesce("control_plane", F.lit(False)),
    })


def worker_of(workers: int, parent: str = "parent_inode", inode: str = "inode") -> Column:
    """Control plane to worker 0; the rest by a hash of the parent, or of the inode where there is none."""
    key = F.when(F.col(parent) != 0, F.col(parent)).otherwise(F.col(inode))
    if workers <= 1:
        return F.lit(0)
    return F.when(F.col("control_plane"), 0).otherwise(1 + F.pmod(F.xxhash64(key), F.lit(workers - 1)).cast("int"))


def queue_drops(events: DataFrame) -> DataFrame:
    """(batch, worker, tin) with how many events are accepted and dropped: only metadata and bulk are dropped."""
    bounded = F.col("tin").isin("metadata", "bulk")
    n, cap = F.count("*"), F.first("tin_capacity")
    out = events.groupBy("batch", "worker", "tin").agg(n.alias("n"), F.max("tin_capacity").alias("cap"))
    accepted = F.when(bounded, F.least("n", "cap")).otherwise(F.col("n"))
    return out.select("batch", "worker", "tin", accepted.cast("long").alias("accepted"), (F.col("n") - accepted).cast("long").alias("dropped"))


def synthetic_parents(events: DataFrame, known: DataFrame) -> DataFrame:
    """A mkdir for every parent that events name and nobody knows, at its first event."""
    unknown = events.filter("parent_inode <> 0").join(known.select(F.col("inode").alias("parent_inode")), "parent_inode", "left_anti")
    return unknown.groupBy("parent_inode").agg(F.min("seq").alias("seq")).select(F.col("parent_inode").alias("inode"), "seq", F.lit(10).alias("etype"))


def error_class(kind: str = "io_kind", etype: str = "etype") -> Column:
    """What to do about a failed change: repair the target, skip, retry or give up."""
    needs_target = F.col(etype).isin(1, 2, 24, 11, 18, 7, 23)
    return (
        F.when((F.col(kind) == "not_found") & needs_target, "target_not_found")
        .when(F.col(kind) == "not_found", "source_not_found")
        .when(F.col(kind) == "permission_denied", "permanent")
        .otherwise("transient")
    )


def operation_kind(etype: str = "etype") -> Column:
    """Kind of a journaled operation."""
    t = F.col(etype)
    return F.when(t.isin(1, 2, 24), "write").when(t == 11, "truncate").when(t.isin(7, 23), "rename").when(t.isin(9, 5), "remove").otherwise("metadata")


def normal_device(dev: str) -> Column:
    """A packed 64-bit device number as (major << 20) | minor."""
    d = F.col(dev)
    major = F.shiftright(d, 8).bitwiseAND(F.lit(0xFFF)).bitwiseOR(F.shiftright(d, 32).bitwiseAND(F.lit(0xFFFFF000)))
    minor = d.bitwiseAND(F.lit(0xFF)).bitwiseOR(F.shiftright(d, 12).bitwiseAND(F.lit(0xFFFFFF00)))
    return F.shiftleft(major, 20).bitwiseOR(minor)
