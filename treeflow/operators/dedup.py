"""Chunk tables, first-seen deduplication, manifests, restore, and storage statistics."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeflow.shared import written

#: Seed of the gear table, which is a rule: 64 bits of a digest for each byte value.
GEAR_SEED = b"treeflow gear"


def gear_table() -> np.ndarray:
    digest = lambda b: hashlib.sha256(GEAR_SEED + bytes([b])).digest()[:8]
    return np.array([int.from_bytes(digest(b), "little") for b in range(256)], dtype=np.uint64)


def cut_points(data: bytes, low: int, average: int, high: int, gear: np.ndarray) -> list[int]:
    """Ends of content-defined chunks; ``average`` is a power of two and ``low`` at least its bits.

    The rolling hash shifts left once a byte, so its low k bits depend on the last k bytes alone: all
    candidates come from a sum of k shifted table lookups, and only they are walked one by one.
    """
    k = average.bit_length() - 1
    if average != 1 << k or not k <= low <= high:
        raise ValueError("average has to be a power of two, and its bits at most the least size")
    n = len(data)
    if not n:
        return []
    g = gear[np.frombuffer(data, dtype=np.uint8)]
    h = np.zeros(n, dtype=np.uint64)
    for shift in range(min(k, n)):
        h[shift:] += g[: n - shift] << np.uint64(shift)
    candidates = np.flatnonzero((h & np.uint64(average - 1)) == 0) + 1
    ends, start = [], 0
    while start < n:
        at = np.searchsorted(candidates, start + low)
        end = int(candidates[at]) if at < len(candidates) else n
        end = min(end, start + high, n)
        ends.append(end)
        start = end
    return ends


def content_chunks(tree: DataFrame, low: int, average: int, high: int) -> DataFrame:
    """(rel, ord, start, end, hash): content-defined chunks of every file."""
    schema = pa.schema([("rel", pa.string()), ("ord", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear = gear_table()
        for batch in batches:
            rows = []
            for rel, content in zip(batch.column("rel").to_pylist(), batch.column("content").cast(pa.binary()).to_pylist(), strict=True):
                start = 0
                for i, end in enumerate(cut_points(content or b"", low, average, high, gear)):
                    rows.append((rel, i, start, end, hashlib.sha256(content[start:end]).hexdigest()))
                    start = end
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return tree.select("rel", "content").mapInArrow(run, "rel string, ord long, start long, end long, hash string")


def chunk_index(chunks: DataFrame) -> DataFrame:
    """(hash, chunk_id, size, refs): dense ids in first-seen order of (snapshot, rel, ord).

    ``chunks(snapshot, rel, ord, hash, size)``. First sightings are a pre-aggregated minimum; ids are
    offsets of range-sorted parts plus a number within the part, so no task sees all chunks.
    """
    first = chunks.groupBy("hash").agg(F.min(F.struct("snapshot", "rel", "ord")).alias("first"), F.max("size").alias("size"), F.count("*").alias("refs"))
    return dense_ids(first, "first", "chunk_id").select("hash", "chunk_id", "size", "refs")


def dense_ids(df: DataFrame, order: str, name: str) -> DataFrame:
    """Numbers rows 0, 1, ... in the order of a unique column, without gathering them in one task."""
    parts = df.repartitionByRange(order).sortWithinPartitions(order).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()})
    # Both readers below have to see the same parts, however each is planned.
    parts = written(parts.withColumn("_i", F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))), "dense-ids")
    counts = parts.groupBy("_p").agg((F.max("_i") + 1).alias("_n"))  # one row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_p", before.alias("_o"))
    return parts.join(F.broadcast(offsets), "_p").withColumn(name, (F.col("_o") + F.col("_i")).cast("long")).drop("_p", "_i", "_o")


def manifest(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """(snapshot, rel, chunks): each file's chunk ids in order."""
    with_id = chunks.join(index.select("hash", "chunk_id"), "hash")
    listed = F.array_sort(F.collect_list(F.struct("ord", "chunk_id")))
    return with_id.groupBy("snapshot", "rel").agg(listed.alias("l"), F.sum("size").cast("long").alias("size")).select(
        "snapshot", "rel", F.transform("l", lambda x: x["chunk_id"]).alias("chunks"), "size"
    )


def restored(manifest_: DataFrame, index: DataFrame) -> DataFrame:
    """(snapshot, rel, hash): digest over the digests of a file's chunks, looked up in the index in order."""
    rows = manifest_.select("snapshot", "rel", F.posexplode("chunks").alias("ord", "chunk_id")).join(index, "chunk_id")
    listed = F.array_sort(F.collect_list(F.struct("ord", "hash")))
    return rows.groupBy("snapshot", "rel").agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["hash"]), ""), 256).alias("hash"))


def saving(part: Column, whole: Column) -> Column:
    """1 - part / whole, 0 where there is nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.lit(1.0) - part / whole)


def savings_percent(disk: Column, apparent: Column) -> Column:
    """Percent saved to one digit, half away from zero; may be negative; 0 for nothing."""
    x = (F.lit(1.0) - disk / apparent) * 1000
    rounded = F.when(x < 0, -F.floor(-x + 0.5)).otherwise(F.floor(x + 0.5))
    return F.when(apparent == 0, F.lit(0.0)).otherwise(rounded / 10)


def whole_file_dedup(files: DataFrame) -> DataFrame:
    """The first file (by path) of each content is data, the others refer to it: (rel, role, owner).

    The owner is a pre-aggregated minimum per digest and a join, so a content that very many files share
    is no single task.
    """
    owner = files.groupBy("hash").agg(F.min("rel").alias("owner"))
    return files.join(owner, "hash").withColumn("role", F.when(F.col("rel") == F.col("owner"), "data").otherwise("ref"))


def content_bytes(files: DataFrame) -> DataFrame:
    """Bytes with each content counted once; files without a digest always count."""
    known = files.filter(F.col("hash").isNotNull()).groupBy("hash").agg(F.max("size").alias("size"))
    return known.select("size").unionAll(files.filter(F.col("hash").isNull()).select("size")).agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("unique_bytes"))


def member_class(path: str) -> Column:
    """What a member of a tar archive is."""
    p = F.col(path)
    return F.when(p.startswith("dedup/"), "dedup").when(p.startswith("meta/"), "meta").when(p == "index.json", "index").otherwise("data")


def footer_checksum(content: Column) -> Column:
    """Sum of the bytes of a binary value, modulo 2^32."""
    digits = F.hex(content)
    pairs = F.when(F.length(digits) == 0, F.array().cast("array<long>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits) - 1, F.lit(1)), F.lit(2)), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long"))
    )
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: (a + x) % 4294967296)
