"""Fixed-size chunk leaves, roots, and the ranges that differ between two versions of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_CHUNK, MOST_LEAVES = 65_536, 1800


def chunk_size(size: Column) -> Column:
    """The least power of two that is at least 64 KiB and leaves at most 1800 chunks; integers only."""
    need = F.floor((size + (MOST_LEAVES - 1)) / MOST_LEAVES).cast("long")
    need = F.greatest(need, F.lit(MIN_CHUNK).cast("long"))
    bits = F.length(F.bin(need - 1))  # of need - 1: the power of two at or above need
    return F.when(size <= 0, F.lit(MIN_CHUNK).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int")))


def pieces(text: Column | str, size: int) -> Column:
    """A text cut into pieces of ``size`` characters, in one pass over it; null for a null, none of an empty one."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def signatures(tree: DataFrame, chunk: int, content: str = "content") -> DataFrame:
    """(rel, chars, hashes): digests of each file's chunks in order. Content stays in the scan's own tasks."""
    hashes = F.transform(pieces(content, chunk), lambda x: F.sha2(x, 256))
    return tree.select("rel", F.length(content).cast("long").alias("chars"), hashes.alias("hashes"))


def leaves(signed: DataFrame, chunk: int) -> DataFrame:
    """(rel, idx, offset, length, hash) of each chunk of signatures(); an empty file has none."""
    each = signed.select("rel", "chars", F.posexplode("hashes").alias("idx", "hash"))
    offset = F.col("idx").cast("long") * chunk
    return each.select("rel", F.col("idx").cast("long").alias("idx"), offset.alias("offset"), F.least(F.lit(chunk), F.col("chars") - offset).cast("long").alias("length"), "hash")


def root(hashes: str) -> Column:
    """The digest of all leaf digests in order; one leaf is its own root, no leaf has none."""
    return F.when(F.size(hashes) == 1, F.element_at(hashes, 1)).when(F.size(hashes) > 1, F.sha2(F.array_join(hashes, ""), 256))


def roots(signed: DataFrame) -> DataFrame:
    """(rel, root, leaf_count) of files that aren't empty."""
    some = signed.filter(F.size("hashes") > 0)
    return some.select("rel", root("hashes").alias("root"), F.size("hashes").cast("long").alias("leaf_count"))


def compared(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Signatures of source files beside those of the target's (``old``, null without one): one row a file."""
    return src.join(tgt.select("rel", F.col("hashes").alias("old")), "rel", "left")


def _old(i: Column) -> Column:
    """The target's digest of a chunk, or null."""
    return F.get("old", i)


def dirty_leaves(both: DataFrame, chunk: int) -> DataFrame:
    """Source leaves that the target lacks or has otherwise; leaves that only the target has don't count."""
    changed = leaves(both.select("rel", "chars", F.transform("hashes", lambda h, i: F.when(~_old(i).eqNullSafe(h), h)).alias("hashes")), chunk)
    return changed.filter(F.col("hash").isNotNull())


def dirty_length(chunk: int) -> Column:
    """Characters of a compared file's chunks that differ."""
    length = lambda i: F.least(F.lit(chunk).cast("long"), F.col("chars") - i.cast("long") * chunk)
    changed = F.transform("hashes", lambda h, i: F.when(_old(i).eqNullSafe(h), F.lit(0).cast("long")).otherwise(length(i)))
    return F.aggregate(changed, F.lit(0).cast("long"), lambda a, x: a + x)


def merged_ranges(dirty: DataFrame) -> DataFrame:
    """(rel, offset, length): neighbouring dirty chunks as one range."""
    island = F.col("idx") - F.row_number().over(Window.partitionBy("rel").orderBy("idx"))
    return dirty.withColumn("island", island).groupBy("rel", "island").agg(F.min("offset").alias("offset"), F.sum("length").cast("long").alias("length")).drop("island")


def patched(both: DataFrame) -> DataFrame:
    """What a delta write leaves on the target: its own chunk where equal, the source's where not."""
    each = F.transform("hashes", lambda h, i: F.struct(i.cast("long").alias("idx"), h.alias("hash"), _old(i).eqNullSafe(h).alias("kept")))
    return both.select("rel", F.inline(each))


def block_runs(tree: DataFrame, block: int, content: str = "content") -> DataFrame:
    """Data and hole runs: blocks that hold nothing but NUL characters are holes."""
    each = tree.select("rel", F.posexplode(F.transform(pieces(content, block), lambda x: F.struct(
        (F.length(F.replace(x, F.lit("\x00"), F.lit(""))) == 0).alias("hole"), F.length(x).alias("length")))).alias("idx", "b"))
    flagged = each.select("rel", "idx", "b.hole", "b.length")
    w = Window.partitionBy("rel")
    k = F.row_number().over(w.orderBy("idx")) - F.row_number().over(Window.partitionBy("rel", "hole").orderBy("idx"))
    return (
        flagged.withColumn("k", k).groupBy("rel", "hole", "k")
        .agg((F.min("idx") * block).cast("long").alias("offset"), F.sum("length").cast("long").alias("length")).drop("k")
    )
