"""Streaming and source queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeflow import lens
from treeflow.lens import CHG_SQL, SRC_SQL
from treeflow.registry import query
from treeflow.shared import scratch
from treeflow.sources import archive, catalog, trees, wire
from treeflow.streaming import pipeline, reorder


def _changes(stream: DataFrame) -> DataFrame:
    code = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in lens.CHANGE_OF.items()), F.lit(0))
    return stream.select(
        (F.col("event_id") + 1).alias("seq"), (F.col("user_id") % 8).cast("long").alias("domain"), F.col("user_id").cast("long").alias("inode"),
        F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("name"), code.cast("int").alias("etype"),
        (F.get_json_object("props", "$.k").cast("long") * 4096).alias("off"), F.floor("value").cast("long").alias("len"), "ts",
    )


@query("stream_event_counts", """SELECT CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS start_s, event_type, count(*) AS n FROM events
GROUP BY 1, 2 HAVING start_s + 86400 <= (SELECT floor(epoch(max(ts))) FROM events)""")
def stream_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts from a stream: the closed windows, which equal the batch's."""
    out = pipeline.run_once(reorder.counted(pipeline.events_stream(spark, d), "1 day", "0 seconds", "event_type"), "stream-counts")
    return spark.read.schema("start_s long, event_type string, n long").parquet(out)


@query("stream_repair_dedup", "SELECT user_id, event_type, count(*) > 0 AS asked FROM events GROUP BY user_id, event_type")
def stream_repair_dedup(spark: SparkSession, d: str) -> DataFrame:
    """With a delay beyond the table's span every repair is asked for once."""
    once = reorder.repairs_once(pipeline.events_stream(spark, d), "3650 days", "user_id", "event_type")
    out = pipeline.run_once(once.select("user_id", "event_type"), "stream-repairs")
    rows = spark.read.schema(once.select("user_id", "event_type").schema).parquet(out)
    return rows.select("user_id", "event_type", F.lit(True).alias("asked"))


@query("stream_reorder", f"""WITH e AS (SELECT inode % 8 AS domain, seq, etype, name FROM ({CHG_SQL}) WHERE seq % 97 <> 0), r AS (SELECT *, lag(seq) OVER (PARTITION BY domain ORDER BY seq) AS b FROM e)
SELECT domain, seq, etype, name, false AS late FROM r UNION ALL SELECT domain, b + 1, 255, 'GAP-' || CAST(b + 1 AS VARCHAR) || '-' || CAST(seq - 1 AS VARCHAR), false FROM r WHERE seq > b + 1""")
def stream_reorder(spark: SparkSession, d: str) -> DataFrame:
    """All changes by number with the gaps between them; under pressure a hole isn't waited for."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", reorder.PROVIDER)
    changes = _changes(pipeline.events_stream(spark, d)).filter("seq % 97 <> 0")
    ordered = reorder.reordered(changes, wait=False)
    out = pipeline.run_once(ordered, "stream-reorder")
    return spark.read.schema(reorder.OUT).parquet(out)


@query("event_pipeline")
def event_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline into a state table, batch by batch."""
    out = pipeline.run_once(_changes(pipeline.events_stream(spark, d)), "event-pipeline", pipeline.upsert)
    return pipeline.newest(spark, out)


# --- sources and sinks --------------------------------------------------------------------------


@query("wire_decode", f"SELECT seq, inode, CAST(etype AS BIGINT) AS etype, off, len, name, CASE WHEN etype = 7 THEN name || '.new' END AS new_name FROM ({CHG_SQL}) WHERE seq % 50 <> 0")
def wire_decode(spark: SparkSession, d: str) -> DataFrame:
    """Changes through the binary record format; truncated records are kept out."""
    c = lens.chg(spark, d).withColumn("new_name", F.concat("name", F.lit(".new")))
    records = wire.encode(c.filter("seq % 50 <> 0")).unionAll(wire.encode(c.filter("seq % 50 = 0")).select(F.substring("record", 1, 40).alias("record")))
    return wire.decode(records).select("seq", "inode", "etype", "off", "len", "name", "new_name")


@query("wire_malformed", f"SELECT count(*) AS malformed FROM ({CHG_SQL}) WHERE seq % 50 = 0")
def wire_malformed(spark: SparkSession, d: str) -> DataFrame:
    records = wire.encode(lens.chg(spark, d))
    short = wire.encode(lens.chg(spark, d).filter("seq % 50 = 0")).select(F.substring("record", 1, 40).alias("record"))
    return wire.malformed(short.unionAll(records)).agg(F.count("*").alias("malformed"))


@query("archive_roundtrip", f"WITH src AS ({SRC_SQL}) SELECT CAST(string_split(name, '.')[1] AS BIGINT) AS chunk_id, sha256(content) AS hash FROM src")
def archive_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Contents written to compressed segments and read back through the data source."""
    chunks = lens.src_tree(spark, d).select(F.split("name", r"\.")[0].cast("long").alias("chunk_id"), F.col("content").alias("data"))
    return archive.read(spark, archive.export(chunks)).select("chunk_id", F.sha2("data", 256).alias("hash"))


@query("tree_walk", f"WITH src AS ({SRC_SQL}) SELECT rel, size FROM src")
def tree_walk(spark: SparkSession, d: str) -> DataFrame:
    """A tree written as files, one a document, and listed again without opening them."""
    root = scratch(spark, "tree")
    files = lens.src_tree(spark, d).select(F.col("parent").alias("parent"), "name", F.col("content").alias("value"))
    write_tree(files, root)
    return trees.walk(spark, root).select("rel", "size")


def write_tree(files: DataFrame, root: str) -> None:
    """(parent, name, value) rows as files, written by the tasks that hold them."""
    from collections.abc import Iterator

    import pyarrow as pa
    import pyarrow.fs as pafs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for parent, name, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs.create_dir(f"{base}/{parent}", recursive=True)
                with fs.open_output_stream(f"{base}/{parent}/{name}", compression=None) as f:
                    f.write((value or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    files.mapInArrow(run, "n long").agg(F.sum("n")).first()


@query("scan_frontier", f"""WITH src AS ({SRC_SQL}) SELECT DISTINCT parent AS dir, CAST(len(string_split(parent, '/')) AS INTEGER) AS depth FROM src WHERE NOT starts_with(parent, 'src1')""")
def scan_frontier(spark: SparkSession, d: str) -> DataFrame:
    dirs = lens.src_tree(spark, d).select(F.col("parent").alias("dir"))
    return trees.frontier(dirs, dirs.filter(F.col("dir").startswith("src1")).distinct())


@query("content_blocks", f"WITH src AS ({SRC_SQL}) SELECT rel, CAST(i AS INTEGER) AS block, sha256(substring(content, i * 4096 + 1, 4096)) AS hash FROM (SELECT rel, content, unnest(range(0, (length(content) + 4095) // 4096)) AS i FROM src)")
def content_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = trees.blocks(lens.src_tree(spark, d).select("rel", "content"), "content", 4096)
    return b.select("rel", "block", F.sha2("data", 256).alias("hash"))


_HEADS = ["28B52FFD0000", "04224D180000", "1F8B08000000", "FD377A585A00", "425A68393141", "7B2261223A31", ""]


@query("compression_sniff", f"""SELECT h, CASE WHEN starts_with(h, '425A68') THEN 'bzip2' WHEN starts_with(h, 'FD377A585A00') THEN 'xz' WHEN starts_with(h, '1F8B') THEN 'gzip' WHEN starts_with(h, '04224D18') THEN 'lz4'
  WHEN starts_with(h, '28B52FFD') THEN 'zstd' ELSE 'none' END AS kind FROM (VALUES {', '.join(f"('{h}')" for h in _HEADS)}) v(h)""")
def compression_sniff(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(h,) for h in _HEADS], "h string").withColumn("content", F.unhex("h"))
    return rows.select("h", trees.compression_of("content").alias("kind"))


@query("pattern_file", "SELECT trim(p) AS pattern FROM (VALUES ('  *.txt '), ('# note'), (''), ('   '), ('src*/x'), (' #x')) v(p) WHERE trim(p) <> '' AND NOT starts_with(trim(p), '#')")
def pattern_file(spark: SparkSession, d: str) -> DataFrame:
    rows = [("  *.txt ",), ("# note",), ("",), ("   ",), ("src*/x",), (" #x",)]
    return trees.patterns(spark.createDataFrame(rows, "value string"))


@query("snapshot_catalog", f"SELECT ts, 'full' AS type, CASE WHEN ts = '1995-02-01T000000' THEN 'keep' ELSE tag END AS tag, files, size_bytes, disk_usage_bytes FROM ({lens.SNAPS_SQL})")
def snapshot_catalog(spark: SparkSession, d: str) -> DataFrame:
    """A catalog appended to, tagged, rewritten and read back."""
    path = scratch(spark, "catalog")
    s = lens.snaps(spark, d)
    catalog.append_snapshots(s.filter("ts < '1995'"), f"{path}/a")
    catalog.append_snapshots(s.filter("ts >= '1995'"), f"{path}/a")
    catalog.rewrite_snapshots(catalog.tagged(catalog.read_snapshots(spark, f"{path}/a"), "1995-02-01T000000", "keep"), f"{path}/b")
    return catalog.read_snapshots(spark, f"{path}/b").select("ts", "type", "tag", "files", "size_bytes", "disk_usage_bytes")


@query("tombstone_append", f"SELECT rel AS p, false AS d, mtime_sec AS t, size AS s FROM ({SRC_SQL}) WHERE size % 3 = 0")
def tombstone_append(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "tombstones")
    rows = lens.src_tree(spark, d).filter("size % 3 = 0").select(F.col("rel").alias("p"), F.lit(False).alias("d"), F.col("mtime_sec").alias("t"), F.col("size").alias("s"))
    catalog.append_tombstones(rows, path)
    return spark.read.schema("p string, d boolean, t bigint, s bigint").json(path)


@query("revert_select", f"SELECT path, epoch_seq FROM ({lens.VERSIONS_SQL}) WHERE inode = (SELECT min(inode) FROM ({lens.VERSIONS_SQL})) ORDER BY epoch_seq DESC, timestamp DESC LIMIT 1")
def revert_select(spark: SparkSession, d: str) -> DataFrame:
    v = lens.versions(spark, d)
    first = v.agg(F.min("inode")).first()[0]
    return catalog.selected(v, first, 1 << 60).select("path", "epoch_seq")
