"""Merging of contiguous writes: the unlimited case in SQL, the exact capped one as a fold per inode."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contiguous(writes: DataFrame, *keys: str) -> DataFrame:
    """Writes of a file that continue the one before become one, with the first one's number and offset.

    Exact where a file's offsets never go back and no limit binds; see merge_capped() for the rest.
    """
    keys = keys or ("inode", "name")
    w = Window.partitionBy(*keys).orderBy("seq")
    starts = F.when(F.lag(F.col("off") + F.col("len")).over(w) == F.col("off"), 0).otherwise(1)
    island = F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        writes.withColumn("starts", starts).withColumn("island", island)
        .groupBy(*keys, "island")
        .agg(F.min("seq").alias("seq"), F.min("off").alias("off"), F.sum("len").cast("long").alias("len"), F.count("*").alias("merged"))
        .drop("island")
    )


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[Iterator[tuple]]:
    """The rows of one key after the other, as they stream past, from batches that come sorted by their first columns.

    No key's rows are gathered: a fold holds what it keeps itself.
    """
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for _, run in itertools.groupby(rows, key=lambda row: row[:keys]):
        yield run


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    waiting = []
    for row in rows:
        waiting.append(row)
        if len(waiting) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting, strict=True), schema, strict=True)], schema=schema)
            waiting = []
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting, strict=True), schema, strict=True)], schema=schema)


def folded(df: DataFrame, key: str, order: str, columns: list[str], fold, schema: pa.Schema, ddl: str) -> DataFrame:
    """A sequential fold over each key's rows in order: one shuffle, then rows stream past in one pass.

    Many small keys share a batch, so no key pays for a call of its own.
    """
    rows = df.select(key, *columns).repartition(key).sortWithinPartitions(key, order)
    return rows.mapInArrow(lambda batches: _batches((out for run in _runs(batches, 1) for out in fold(run)), schema), ddl)


_LONG = pa.int64()


def merge_capped(writes: DataFrame, depth: int, limit: int) -> DataFrame:
    """The head of a file's queue takes in later writes at its running end, looking ``depth`` rows ahead.

    Rows that don't fit are skipped, not barriers; a head that has reached ``limit`` bytes takes no more,
    so the last one may overshoot.
    """

    def fold(run: Iterator[tuple]) -> Iterator[tuple]:
        rows = list(run)  # one file's writes
        used = [False] * len(rows)
        for i, (inode, seq, name, off, n) in enumerate(rows):
            if used[i]:
                continue
            end, merged, seen, j = off + n, 1, 0, i + 1
            while j < len(rows) and seen < depth and end - off < limit:
                if not used[j]:
                    seen += 1
                    if rows[j][2] == name and rows[j][3] == end:
                        used[j] = True
                        end, merged = end + rows[j][4], merged + 1
                j += 1
            yield inode, name, seq, off, end - off, merged

    schema = pa.schema([("inode", _LONG), ("name", pa.string()), ("seq", _LONG), ("off", _LONG), ("len", _LONG), ("merged", _LONG)])
    return folded(writes, "inode", "seq", ["seq", "name", "off", "len"], fold, schema, "inode long, name string, seq long, off long, len long, merged long")


def aggregate_window(writes: DataFrame, gap_ns: int, most: int) -> DataFrame:
    """The capture-side merge: a write extends the pending one while young, contiguous, of equal flags and
    within the size bound; else the pending one is flushed."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        pending = None
        for inode, t, off, n, flags in rows:
            if (
                pending is not None and t - pending[1] < gap_ns and pending[2] + pending[3] == off
                and pending[3] + n <= most and pending[4] == flags
            ):
                pending[1], pending[3], pending[5] = t, pending[3] + n, pending[5] + 1
                continue
            if pending is not None:
                yield tuple(pending)
            pending = [inode, t, off, n, flags, 1]
        if pending is not None:
            yield tuple(pending)

    schema = pa.schema([(n, _LONG) for n in ("inode", "last_ns", "off", "len", "flags", "merged")])
    return folded(writes, "inode", "ts_ns", ["ts_ns", "off", "len", "flags"], fold, schema, "inode long, last_ns long, off long, len long, flags long, merged long")
