"""Chunk archives: segments of compressed blobs with an index, read back by a Python data source.

A task writes one segment (magic, blobs) and returns an index row per chunk; the index is committed as
Parquet, so segments of attempts that failed are never read. The reader plans one partition per run of
neighbouring chunks and checks every blob's digest.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from treeflow.shared import scratch, written

MAGIC = b"TFAR\x02\x00\x00\x00"
INDEX = "chunk_id long, hash string, segment string, offset long, stored long, size long"
_INDEX = pa.schema([("chunk_id", pa.int64()), ("hash", pa.string()), ("segment", pa.string()), ("offset", pa.int64()), ("stored", pa.int64()), ("size", pa.int64())])


def export(chunks: DataFrame, folder: str | None = None, level: int = 3) -> DataFrame:
    """Writes (chunk_id, data binary) to segments below a shared folder and returns the index."""
    folder = folder or scratch(chunks.sparkSession, "segments")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        out, name, at, packer = None, "", 0, zstandard.ZstdCompressor(level=level)
        for batch in batches:
            rows = []
            for chunk_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.tfar"
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(MAGIC)
                    at = len(MAGIC)
                blob = packer.compress(data)
                out.write(blob)
                rows.append((chunk_id, hashlib.sha256(data).hexdigest(), f"{folder}/{name}", at, len(blob), len(data)))
                at += len(blob)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _INDEX, strict=True)], schema=_INDEX)
        if out is not None:
            out.close()

    return written(chunks.select("chunk_id", F.col("data").cast("binary")).mapInArrow(run, INDEX), "archive-index")


class _Run(InputPartition):
    def __init__(self, segment: str, parts: list[tuple[int, str, int, int]]):
        self.segment, self.parts = segment, parts


class ArchiveReader(DataSourceReader):
    """Partitions of at most ``chunks`` neighbouring blobs of one segment."""

    def __init__(self, index_path: str, chunks: int):
        self.index_path, self.chunks = index_path, chunks

    def partitions(self) -> list[_Run]:
        import pyarrow.dataset as ds

        fs, path = pafs.FileSystem.from_uri(self.index_path)
        rows = sorted(
            (r["segment"], r["offset"], r["chunk_id"], r["hash"], r["stored"])
            for r in ds.dataset(path, filesystem=fs, format="parquet").to_table().to_pylist()
        )
        out: list[_Run] = []
        for segment, offset, chunk_id, digest, stored in rows:
            if not out or out[-1].segment != segment or len(out[-1].parts) >= self.chunks:
                out.append(_Run(segment, []))
            out[-1].parts.append((chunk_id, digest, offset, stored))
        return out or [_Run("", [])]

    def read(self, partition: _Run) -> Iterator[tuple]:
        if not partition.parts:
            return
        fs, path = pafs.FileSystem.from_uri(partition.segment)
        start, end = partition.parts[0][2], partition.parts[-1][2] + partition.parts[-1][3]
        with fs.open_input_file(path) as f:
            if f.read_at(len(MAGIC), 0) != MAGIC:
                raise ValueError(f"{partition.segment} is no segment")
            block = f.read_at(end - start, start)
        unpack = zstandard.ZstdDecompressor()
        for chunk_id, digest, offset, stored in partition.parts:
            data = unpack.decompress(block[offset - start : offset - start + stored])
            if hashlib.sha256(data).hexdigest() != digest:
                raise ValueError(f"chunk {chunk_id} is damaged")
            yield chunk_id, data


class ArchiveSource(DataSource):
    """``spark.read.format("treeflow_archive").option("path", index)``: (chunk_id, data)."""

    @classmethod
    def name(cls) -> str:
        return "treeflow_archive"

    def schema(self) -> str:
        return "chunk_id long, data binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("chunks", 256)))


def read(spark: SparkSession, index: DataFrame) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("treeflow_archive").option("path", index._treeflow_path).load()
