"""Planning: order of work, choice of copy method, delta or full, memory share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KIB, MIB = 1024, 1024 * 1024


def fan_out(files: DataFrame, targets: DataFrame) -> DataFrame:
    """Every file for every target (a small dimension)."""
    return files.crossJoin(F.broadcast(targets))


def plan_order() -> list[Column]:
    """Small files first, unknown sizes last, fast tiers before slow ones."""
    return [F.col("size").asc_nulls_last(), F.col("tier").asc(), F.col("rel").asc(), F.col("target").asc()]


def copy_method() -> Column:
    """The first tier that applies, over size, t_size, nfs, sparse, same_dev, reflink, copy_range."""
    c = F.col
    return (
        F.when((c("size") == c("t_size")) & (c("size") > 256 * KIB), "delta")
        .when(c("nfs") & ~c("sparse") & (c("size") <= 16 * MIB), "nfs_rpc")
        .when((c("same_dev") | c("nfs")) & (c("size") > 0) & c("reflink"), "reflink")
        .when(~c("sparse") & c("copy_range"), "copy_file_range")
        .when(~c("sparse") & (c("size") <= 64 * KIB), "small")
        .otherwise("io_uring")
    )


def inner_copier() -> Column:
    """Reflink only where supported, on one device, not excluded, and for at least 4 KiB."""
    ok = F.col("reflink") & F.col("same_dev") & ~F.col("nocow") & (F.col("size") >= 4096)
    return F.when(ok, "reflink").otherwise("copy")


def delta_decision(over: int = MIB, half_rule: bool = True) -> Column:
    """Over size, sig_root, src_root, dirty_bytes: none, delta or full."""
    c = F.col
    out = F.when(c("sig_root").isNull() | (c("size") <= over), "full").when(c("sig_root") == c("src_root"), "none")
    if half_rule:
        out = out.when(c("dirty_bytes") >= F.floor(c("size") / 2), "full")
    return out.otherwise("delta")


def storm_label(pending: DataFrame, order: str, limit: int) -> DataFrame:
    """Memory share with hysteresis: ``yield`` starts above the limit and ends below 90 % of it.

    Once yielding the threshold is 0.9 limit, once primary 1.1 limit (limit itself at the start). Between
    the two the label stays, so it is the label at the last sample outside the band.
    """
    low, high = F.lit(int(limit * 0.9)), F.lit(int(limit * 1.1))
    w = Window.partitionBy("label").orderBy(order)
    first = F.row_number().over(w) == 1
    mark = (
        F.when(first, F.when(F.col("pending") > limit, "yield").otherwise("primary"))
        .when(F.col("pending") > high, "yield")
        .when(F.col("pending") <= low, "primary")
    )
    share = F.last("mark", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return pending.withColumn("mark", mark).withColumn("share", share).drop("mark")


def stats(plan: DataFrame) -> DataFrame:
    """Counters by method; sums of sums, so partial results of several sources merge."""
    return plan.groupBy("method").agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))
