"""Shared pieces of the training-data operators: shared-folder handling and word splitting."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeflow.shared import drop, scratch, shared_dir, shuffles_released, written  # noqa: F401  (used by the operators)

_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Lower-cases A-Z and leaves every other byte (UTF-8 sequences included) alone.
LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
#: As LOWER, and turns every ASCII byte that is neither a digit nor a letter into a space.
LOWER_ALNUM = bytes(
    0x20 if b < 0x80 and not (48 <= b <= 57 or 97 <= b <= 122) else b for b in LOWER
)


def alnum_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.translate(LOWER_ALNUM).split()


def space_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased.

    ``bytes.split()`` splits on exactly the six ASCII white-space bytes.
    """
    return text.translate(LOWER).split()


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


@functools.cache
def _libc():
    """The C library where it can be told to give memory back (glibc), with large blocks kept out of its heap."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):
        return None
    return libc


def lean(run: Callable, forget: Callable | None = None) -> Callable:
    """The same function for mapInArrow; a worker that is kept for other tasks gives memory back at the end.

    ``forget``, a function of a module, empties that module's caches.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = _libc()
        try:
            yield from run(batches)
        finally:
            if forget is not None:
                forget()
            pa.default_memory_pool().release_unused()
            if libc is not None:
                libc.malloc_trim(0)

    return task


def split_batches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that what is derived from one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sized_batches(
    batches: Iterator[pa.RecordBatch], most_bytes: int, name: str = "text"
) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose texts sum to about ``most_bytes`` (one row at least)."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(col: str = "doc_id"):
    """crc32 of the decimal text of an id, the basis of every held-out split."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


#: Rows of the bitmap below; 64 bits each.
_BITMAP_ROWS = 1 << 16


def prefiltered(df: DataFrame, key: str, among: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be in the first column of ``among``, without a shuffle.

    A bitmap of hashed keys of at most 65,536 rows (1 MB, whatever the input) is broadcast. It lets
    some other rows pass, more of them the more keys there are, so a join has to follow.
    """
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long"), F.lit(7)), F.lit(_BITMAP_ROWS * 64))
    name = among.columns[0]
    bits = among.select(place(name).alias("place")).groupBy((F.col("place") / 64).cast("long").alias("_word"))
    bits = bits.agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("_bits"))
    at = place(key)
    return (
        df.withColumn("_place", at)
        .join(F.broadcast(bits), F.expr("cast(_place / 64 as long)") == F.col("_word"))
        .filter(F.expr("getbit(_bits, cast(_place % 64 as int)) = 1"))
        .select(*df.columns)
    )


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list: rows (node, component = smallest node).

    Alternating large-star and small-star rounds; every round is two pre-aggregated minima and joins,
    written to the shared folder. Only nodes with an edge appear.
    """
    spark = links.sparkSession
    edges = written(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges"
    )
    seen = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u <> v").distinct(), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u")
        small = star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(star.select("u", F.col("m").alias("v")))
        small = written(small.filter("u <> v").distinct(), "edges")
        drop(spark, edges, large)
        edges = small
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
