"""The event pipeline: order, suppress, classify, coalesce, and merge into a table of current state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeflow import dims
from treeflow.operators import coalesce, filters, sequence
from treeflow.shared import scratch


def events_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(sf_dir)


def run_once(stream: DataFrame, name: str, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> str:
    """Runs a stream over what there is; returns the folder of its output (exactly once per batch)."""
    spark = stream.sparkSession
    out, state = scratch(spark, name), scratch(spark, f"{name}-checkpoint")
    writer = stream.writeStream.option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True)
    if each is None:
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda df, epoch: each(df, epoch, out)).start()
    query.awaitTermination()
    return out


def prepared(changes: DataFrame) -> DataFrame:
    """Changes of one batch without internal traffic and short-lived pairs, with their class."""
    rows = changes.filter(~filters.is_internal("name"))
    return sequence.with_type(sequence.transient_suppressed(rows), dims.event_types(changes.sparkSession))


def state_after(changes: DataFrame) -> DataFrame:
    """(inode, last_seq, bytes, writes, alive): what a batch does to each file, writes merged first."""
    rows = prepared(changes)
    merged = coalesce.contiguous(rows.filter("etype IN (1, 2)").select("inode", "name", "seq", "off", "len"))
    writes = merged.groupBy("inode").agg(F.sum("len").cast("long").alias("bytes"), F.count("*").alias("writes"))
    last = rows.groupBy("inode").agg(F.max("seq").alias("last_seq"), F.max_by(F.col("etype") != 9, F.when(F.col("etype").isin(8, 9), F.col("seq"))).alias("alive"))
    return last.join(writes, "inode", "left").select(
        "inode", "last_seq", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("writes", F.lit(0)).alias("writes"), F.coalesce("alive", F.lit(True)).alias("alive")
    )


def merged_state(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by key: sums add up, the later batch's flags win."""
    both = old.unionByName(new)
    return both.groupBy("inode").agg(
        F.max("last_seq").alias("last_seq"), F.sum("bytes").cast("long").alias("bytes"), F.sum("writes").cast("long").alias("writes"),
        F.max_by("alive", "last_seq").alias("alive"),
    )


def upsert(changes: DataFrame, epoch: int, root: str) -> None:
    """Writes the state after a batch as a new table (version = batch) and leaves the one before alone."""
    spark = changes.sparkSession
    new = state_after(changes)
    if epoch > 0:
        new = merged_state(spark.read.parquet(f"{root}/v{epoch - 1}"), new)
    new.write.mode("overwrite").parquet(f"{root}/v{epoch}")


def newest(spark: SparkSession, root: str) -> DataFrame:
    """The state after the last batch whose table was committed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(path)]  # one folder a batch
    done = [int(n[1:]) for n in names if n[1:].isdigit() and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
    return spark.read.parquet(f"{root}/v{max(done)}")
