"""WARC archives with an index: records are written once and later read by coalesced byte ranges.

Writing: equal payloads are found by digest (a pre-aggregated count per digest, so a payload that a
third of all pages share is one small row per task, and a join of ids without payloads), each page learns
whether it is a response or a revisit, and every task appends its records, one gzip member each, to archives of its own below the
shared folder. The rows that the tasks return (archive, offset, length, URL, digest) are the index; Spark
commits them as Parquet. A task that is run again writes other archives; the index names only those of
attempts that were committed.

Reading: selected index rows are range-partitioned by (archive, offset), into as many tasks as the records
have bytes for, and sorted; neighbouring ranges
are merged up to a gap and a block size, each block is one read, and records are cut out of it.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeflow.llm.common import lean, scratch, sized_batches, table, written

#: Payloads of fewer bytes are always written in full.
REVISIT_BYTES = 1000
#: An archive is closed once it holds this much.
ARCHIVE_BYTES = 1 << 30
#: Ranges that are at most this far apart are read together, up to a block of BLOCK_BYTES.
GAP_BYTES = 64 << 10
BLOCK_BYTES = 8 << 20
#: Bytes of records that a task reads back.
TASK_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, url string, digest string, record_type string, archive string, offset long, length long"
_INDEX = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()),
    ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
])
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def with_record_types(pages: DataFrame) -> DataFrame:
    """Pages with digest, size, ``record_type`` and ``refers_to``; revisits carry no payload.

    Which pages are revisits is found from ids and digests alone; payloads are dealt by page, so that a
    payload that many pages share is no hot key.
    """
    own = pages.select(
        "page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    ).withColumns({"digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    large = own.filter((F.col("payload_bytes") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).select("page_id", "digest")
    winners = large.groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("copies")).filter("copies > 1")
    revisits = large.join(winners.select("digest", "winner"), "digest").filter("page_id < winner").groupBy("page_id", "digest").agg(F.max("winner").alias("refers_to"))
    revisit = F.col("refers_to").isNotNull()
    return own.join(revisits, ["page_id", "digest"], "left").select(
        "page_id", "url", "digest", "payload_bytes", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        "refers_to", F.when(~revisit, F.col("payload")).alias("payload"),
    )


def _record(page_id, url, digest, size, kind, refers_to, payload) -> bytes:
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Bytes: {size}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = payload or b""
    head += ["Content-Type: text/html;charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes one record per row of ``pages(page_id, url, html)`` and returns the committed index.

    Null html is an empty payload. Of equal payloads of at least 1000 bytes the one with the largest
    page_id is the response, the others are revisits of it; rows that repeat that id with that payload,
    and rows without an id, are responses. A null URL has no header. Other columns are ignored; an
    empty table gives an empty index.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        out, at, name = None, 0, ""
        for batch in sized_batches(batches, 4 << 20, "payload"):
            rows: list[tuple] = []
            for page_id, url, digest, size, kind, refers_to, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)  # members are compressed one by one
                data = _member(_record(page_id, url, digest, size, kind, refers_to, payload))
                out.write(data)
                rows.append((page_id, url, digest, kind, f"{folder}/{name}", at, len(data)))
                at += len(data)
                if at >= archive_bytes:
                    out.close()
                    out = None
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _INDEX, strict=True)], schema=_INDEX
                )
        if out is not None:
            out.close()

    index = with_record_types(pages).mapInArrow(lean(run), INDEX)
    return written(index, "warc-index")


def _parsed(data: bytes) -> tuple:
    record = zlib.decompress(data, 31)
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    payload = rest[: int(fields["Content-Length"])]
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    page = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return (
        page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), int(fields["X-Payload-Bytes"]), digest, kind,
        page(fields["WARC-Refers-To"]) if kind == "revisit" else None, payload if kind == "response" else None,
    )


def coalesced(ranges: Iterator[tuple], gap: int = GAP_BYTES, block: int = BLOCK_BYTES) -> Iterator[tuple]:
    """(archive, start, end, [(offset, length), ...]) for sorted (archive, offset, length) ranges."""
    archive, start, end, parts = None, 0, 0, []
    for name, offset, length in ranges:
        if parts and (name != archive or offset > end + gap or offset + length - start > block):
            yield archive, start, end, parts
            parts = []
        if not parts:
            archive, start, end = name, offset, offset
        parts.append((offset, length))
        end = max(end, offset + length)
    if parts:
        yield archive, start, end, parts


def read_records(selected: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of index rows (any selection of them), read by coalesced ranges of each archive.

    No rows give no records; rows that repeat give their record as often.
    """
    spark = selected.sparkSession
    total = selected.agg(F.sum("length")).first()[0] or 0
    # A given number of tasks: the index rows say little about the bytes behind them.
    tasks = max(1, -(-total // TASK_BYTES), min(spark.sparkContext.defaultParallelism, total // GAP_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        opened, source = None, None
        for archive, start, end, parts in coalesced(ranges):
            if archive != opened:
                fs, path = pafs.FileSystem.from_uri(archive)
                source, opened = fs.open_input_file(path), archive
            block = source.read_at(end - start, start)
            rows = [_parsed(block[a - start : a - start + n]) for a, n in parts]
            columns = [list(c) for c in zip(*rows, strict=True)]
            if not payloads:
                columns[6] = [None] * len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)],
                names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"],
            )

    return (
        selected.select("archive", "offset", "length")
        .repartitionByRange(int(tasks), "archive", "offset")
        .sortWithinPartitions("archive", "offset")
        .mapInArrow(lean(run), RECORDS)
    )


def op3_indexed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(table(spark, sf_dir, "pages"))
    return read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN strlen(h) >= 1000 AND page_id < w THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(h) >= 1000 AND page_id < w THEN w END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS w FROM pages)
"""
