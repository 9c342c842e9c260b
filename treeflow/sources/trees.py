"""File trees as tables: recursive listings, content, and resumable directory frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from treeflow.operators import merkle


def walk(spark: SparkSession, root: str, glob: str | None = None, content: bool = False) -> DataFrame:
    """(rel, parent, name, size, mtime_sec[, content]) of every file below a root.

    Without ``content`` only listings are read: the file source doesn't open files whose content isn't asked for.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(root)
    base = root.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    rel = F.substring_index("path", base, -1)
    parts = F.split(rel, "/")
    columns = [
        rel.alias("rel"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("parent"), F.element_at(parts, -1).alias("name"),
        F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime_sec"),
    ]
    return files.select(*columns, *(["content"] if content else []))


def frontier(directories: DataFrame, done: DataFrame) -> DataFrame:
    """Directories still to be scanned: those seen, less those a checkpoint has as done, by depth."""
    left = directories.select("dir").distinct().join(done.select("dir"), "dir", "left_anti")
    return left.withColumn("depth", F.size(F.split("dir", "/"))).orderBy("depth", "dir")


def blocks(df: DataFrame, column: str, size: int) -> DataFrame:
    """A binary or text column cut into blocks of bytes or characters: (..., block, data)."""
    rest = [c for c in df.columns if c != column]
    if isinstance(df.schema[column].dataType, BinaryType):  # a slice of bytes is found at once
        n = F.ceil(F.octet_length(column) / size).cast("int")
        cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(column), i * size + 1, F.lit(size)))
    else:
        cut = merkle.pieces(column, size)
    return df.filter(F.octet_length(column) > 0).select(*rest, F.posexplode(cut).alias("block", "data"))


# First bytes (hexadecimal) of compressed streams.
MAGIC = {"28B52FFD": "zstd", "04224D18": "lz4", "1F8B": "gzip", "FD377A585A00": "xz", "425A68": "bzip2"}


def compression_of(content: str):
    """The compression that a binary column's first bytes tell, or ``none``."""
    head = F.hex(F.substring(content, 1, 6))
    out = F.lit("none")
    for magic, name in MAGIC.items():
        out = F.when(head.startswith(magic), name).otherwise(out)
    return out


def patterns(lines: DataFrame, column: str = "value") -> DataFrame:
    """Patterns of a file: trimmed, without blank lines and comments."""
    trimmed = F.trim(column)
    return lines.select(trimmed.alias("pattern")).filter((F.col("pattern") != "") & ~F.col("pattern").startswith("#"))
