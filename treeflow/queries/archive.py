"""Merkle delta, chunking, deduplication and archive queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeflow import lens
from treeflow.lens import SRC_SQL, TREES
from treeflow.operators import dedup, diff, merkle
from treeflow.plans import strategy
from treeflow.registry import query

LEAF = 1024
CDC = (256, 1024, 4096)

_LEAVES = """SELECT rel, i AS idx, i * 1024 AS "offset", CAST(length(substring(content, i * 1024 + 1, 1024)) AS BIGINT) AS length,
  sha256(substring(content, i * 1024 + 1, 1024)) AS hash FROM (SELECT rel, content, unnest(range(0, (length(content) + 1023) // 1024)) AS i FROM {})"""
_BOTH = TREES + ", sl AS (" + _LEAVES.format("src") + "), tl AS (" + _LEAVES.format("tgt") + ")"
_ROOT = "SELECT rel, CASE WHEN count(*) = 1 THEN min(hash) ELSE sha256(string_agg(hash, '' ORDER BY idx)) END AS root, count(*) AS leaf_count FROM {} GROUP BY rel"
_DIRTY = _BOTH + ", dirty AS (SELECT sl.* FROM sl LEFT JOIN tl ON sl.rel = tl.rel AND sl.idx = tl.idx WHERE tl.hash IS NULL OR tl.hash <> sl.hash)"


def _src(spark, d):
    return merkle.signatures(lens.src_tree(spark, d), LEAF)


def _tgt(spark, d):
    return merkle.signatures(lens.tgt_tree(spark, d), LEAF)


def _both(spark, d):
    return merkle.compared(_src(spark, d), _tgt(spark, d))


@query("merkle_leaves", f"WITH src AS ({SRC_SQL}) " + _LEAVES.format("src"))
def merkle_leaves(spark: SparkSession, d: str) -> DataFrame:
    return merkle.leaves(_src(spark, d), LEAF)


@query("merkle_root", _BOTH + " " + _ROOT.format("sl"))
def merkle_root(spark: SparkSession, d: str) -> DataFrame:
    return merkle.roots(_src(spark, d))


@query("dirty_ranges", _DIRTY + """, i AS (SELECT *, idx - row_number() OVER (PARTITION BY rel ORDER BY idx) AS k FROM dirty)
SELECT rel, min("offset") AS "offset", CAST(sum(length) AS BIGINT) AS length FROM i GROUP BY rel, k""")
def dirty_ranges(spark: SparkSession, d: str) -> DataFrame:
    return merkle.merged_ranges(merkle.dirty_leaves(_both(spark, d), LEAF))


@query("delta_write", _BOTH + " SELECT sl.rel, sl.idx, sl.hash, coalesce(tl.hash = sl.hash, false) AS kept FROM sl LEFT JOIN tl ON sl.rel = tl.rel AND sl.idx = tl.idx")
def delta_write(spark: SparkSession, d: str) -> DataFrame:
    return merkle.patched(_both(spark, d))


def _delta(over: str, half: str) -> str:
    return _DIRTY + f""", sr AS ({_ROOT.format('sl')}), tr AS ({_ROOT.format('tl')}),
db AS (SELECT rel, CAST(sum(length) AS BIGINT) AS dirty_bytes FROM dirty GROUP BY rel),
j AS (SELECT src.rel, CAST(length(content) AS BIGINT) AS size, tr.root AS sig_root, sr.root AS src_root, coalesce(dirty_bytes, 0) AS dirty_bytes
  FROM src LEFT JOIN sr ON src.rel = sr.rel LEFT JOIN tr ON src.rel = tr.rel LEFT JOIN db ON src.rel = db.rel)
SELECT rel, dirty_bytes, CASE WHEN sig_root IS NULL OR size <= {over} THEN 'full' WHEN sig_root = src_root THEN 'none'
  {half} ELSE 'delta' END AS decision FROM j"""


def _decided(spark: SparkSession, d: str, over: int, half: bool) -> DataFrame:
    j = _both(spark, d).select(
        "rel", F.col("chars").alias("size"), merkle.root("hashes").alias("src_root"), merkle.root("old").alias("sig_root"), merkle.dirty_length(LEAF).alias("dirty_bytes")
    )
    return j.select("rel", "dirty_bytes", strategy.delta_decision(over, half).alias("decision"))


@query("delta_decision", _delta("2048", "WHEN dirty_bytes >= size // 2 THEN 'full'"))
def delta_decision(spark: SparkSession, d: str) -> DataFrame:
    """The daemon's rule, with a threshold of 2 KiB for texts as short as these."""
    return _decided(spark, d, 2048, True)


@query("delta_decision_oneshot", _delta("512", ""))
def delta_decision_oneshot(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d, 512, False)


@query("signature_match", TREES + f""", sl AS ({_LEAVES.format('src')}), tl AS ({_LEAVES.format('tgt')}), sr AS ({_ROOT.format('sl')}), tr AS ({_ROOT.format('tl')}),
j AS (SELECT src.rel, src.size AS a, tgt.size AS b, src.mtime_sec AS s1, tgt.mtime_sec AS s2, CASE WHEN src.mtime_sec % 2 = 0 THEN sr.root END AS r1, tr.root AS r2,
  sha256(src.content) AS h1, CASE WHEN src.size % 3 > 0 THEN sha256(tgt.content) END AS h2 FROM src JOIN tgt ON src.rel = tgt.rel LEFT JOIN sr ON sr.rel = src.rel LEFT JOIN tr ON tr.rel = src.rel)
SELECT rel, CASE WHEN a <> b THEN false WHEN r1 IS NOT NULL AND r2 IS NOT NULL THEN r1 = r2 WHEN s1 <> s2 THEN false
  WHEN h1 IS NOT NULL AND h2 IS NOT NULL THEN h1 = h2 ELSE true END AS same FROM j""")
def signature_match(spark: SparkSession, d: str) -> DataFrame:
    def side(tree, p, root, hash_):
        whole = merkle.root(F.transform(merkle.pieces("content", LEAF), lambda x: F.sha2(x, 256)))
        t = tree.select("rel", "size", "mtime_sec", "mtime_nsec", whole.alias("root"), F.sha2("content", 256).alias("digest"))
        return t.select("rel", F.col("size").alias(p + "size"), F.col("mtime_sec").alias(p + "mtime_sec"), F.col("mtime_nsec").alias(p + "mtime_nsec"), root.alias(p + "merkle_root"), hash_.alias(p + "hash"))

    every_other = F.when(F.col("mtime_sec") % 2 == 0, F.col("root"))
    a = side(lens.src_tree(spark, d), "", every_other, F.col("digest"))
    b = side(lens.tgt_tree(spark, d), "t_", F.col("root"), F.when(F.col("size") % 3 > 0, F.col("digest")))
    return a.join(b, "rel").select("rel", diff.signature_match().alias("same"))


@query("sparse_runs", f"""WITH src AS ({SRC_SQL}), b AS (SELECT rel, i, length(replace(substring(content, i * 4 + 1, 4), chr(0), '')) = 0 AS hole, length(substring(content, i * 4 + 1, 4)) AS length
  FROM (SELECT rel, regexp_replace(content, '[ \\n\\t]|[0-9]', chr(0), 'g') AS content, unnest(range(0, (length(content) + 3) // 4)) AS i FROM src)),
k AS (SELECT *, row_number() OVER (PARTITION BY rel ORDER BY i) - row_number() OVER (PARTITION BY rel, hole ORDER BY i) AS k FROM b)
SELECT rel, hole, CAST(min(i) * 4 AS BIGINT) AS "offset", CAST(sum(length) AS BIGINT) AS length FROM k GROUP BY rel, hole, k""")
def sparse_runs(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose blanks and digits are NUL, in blocks of four characters."""
    t = lens.src_tree(spark, d).withColumn("content", F.regexp_replace("content", "[ \\n\\t]|[0-9]", "\x00"))
    return merkle.block_runs(t, 4)


@query("fn_chunk_size", """SELECT CAST(size AS BIGINT) AS size, CASE WHEN size <= 0 THEN 65536 ELSE CAST(pow(2, ceil(log2(greatest(65536, (size + 1799) // 1800)))) AS BIGINT) END AS chunk
FROM (VALUES (0), (1), (65536), (117964800), (117964801), (235929600), (235929601), (10000000000)) v(size)""")
def fn_chunk_size(spark: SparkSession, d: str) -> DataFrame:
    rows = [(n,) for n in (0, 1, 65536, 117964800, 117964801, 235929600, 235929601, 10_000_000_000)]
    return spark.createDataFrame(rows, "size long").select("size", merkle.chunk_size(F.col("size")).alias("chunk"))


# --- chunking and deduplication -----------------------------------------------------------------


@query("cdc_chunks")
def cdc_chunks(spark: SparkSession, d: str) -> DataFrame:
    return dedup.content_chunks(lens.src_tree(spark, d), *CDC)


_FIXED = TREES + f""", c AS (SELECT 0 AS snapshot, rel, idx AS ord, hash, length AS size FROM ({_LEAVES.format('tgt')})
  UNION ALL SELECT 1, rel, idx, hash, length FROM ({_LEAVES.format('src')})),
f AS (SELECT hash, min(row(snapshot, rel, ord)) AS first, max(size) AS size, count(*) AS refs FROM c GROUP BY hash),
ix AS (SELECT hash, row_number() OVER (ORDER BY first) - 1 AS chunk_id, size, refs FROM f)"""


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Fixed-size chunks of two snapshots: the target tree, then the source tree."""
    at = lambda t, n: t.select(F.lit(n).alias("snapshot"), "rel", F.col("idx").alias("ord"), "hash", F.col("length").alias("size"))
    return at(merkle.leaves(_tgt(spark, d), LEAF), 0).unionByName(at(merkle.leaves(_src(spark, d), LEAF), 1))


@query("chunk_dedup", _FIXED + " SELECT hash, chunk_id, size, refs FROM ix")
def chunk_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.chunk_index(_snapshots(spark, d))


@query("archive_manifest", _FIXED + """ SELECT snapshot, rel, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY ord) AS chunks, CAST(sum(c.size) AS BIGINT) AS size
FROM c JOIN ix USING (hash) GROUP BY snapshot, rel""")
def archive_manifest(spark: SparkSession, d: str) -> DataFrame:
    c = _snapshots(spark, d)
    return dedup.manifest(c, dedup.chunk_index(c)).withColumn("chunks", F.array_join("chunks", ","))


@query("export_stats", _FIXED + """ SELECT (SELECT count(*) FROM (SELECT DISTINCT snapshot, rel FROM c)) AS files, (SELECT count(*) FROM c) AS chunks, count(*) AS unique_chunks,
  (SELECT CAST(sum(size) AS BIGINT) FROM c) AS apparent, CAST(sum(size) AS BIGINT) AS stored,
  round(1.0 - CAST(sum(size) AS DOUBLE) / (SELECT sum(size) FROM c), 6) AS dedup_ratio FROM ix""")
def export_stats(spark: SparkSession, d: str) -> DataFrame:
    c = _snapshots(spark, d)
    whole = c.agg(F.countDistinct("snapshot", "rel").alias("files"), F.count("*").alias("chunks"), F.sum("size").cast("long").alias("apparent"))
    unique = c.groupBy("hash").agg(F.max("size").alias("size")).agg(F.count("*").alias("unique_chunks"), F.sum("size").cast("long").alias("stored"))
    both = whole.crossJoin(unique)  # one row each
    return both.select("files", "chunks", "unique_chunks", "apparent", "stored", F.round(dedup.saving(F.col("stored"), F.col("apparent")), 6).alias("dedup_ratio"))


@query("archive_inspect", TREES + """ SELECT count(*) AS files, count(DISTINCT sha256(content)) AS unique_files, CAST(sum(size) AS BIGINT) AS bytes FROM src""")
def archive_inspect(spark: SparkSession, d: str) -> DataFrame:
    t = lens.src_tree(spark, d).select(F.sha2("content", 256).alias("h"), "size")
    return t.agg(F.count("*").alias("files"), F.countDistinct("h").alias("unique_files"), F.sum("size").cast("long").alias("bytes"))


@query("restore_verify", _FIXED + """ SELECT snapshot, rel, sha256(string_agg(hash, '' ORDER BY ord)) AS hash FROM c GROUP BY snapshot, rel""")
def restore_verify(spark: SparkSession, d: str) -> DataFrame:
    """Restores every file through manifest and index; the twin takes the chunks as they were."""
    c = _snapshots(spark, d)
    index = dedup.chunk_index(c)
    return dedup.restored(dedup.manifest(c, index), index)


@query("restore_select", TREES + """ SELECT rel, size FROM src WHERE regexp_matches(rel, '^src.*/fr/.*$') AND contains(rel, '1') ORDER BY rel DESC LIMIT 1""")
def restore_select(spark: SparkSession, d: str) -> DataFrame:
    """The latest file that matches a glob and a substring: one row overall."""
    t = lens.src_tree(spark, d).select("rel", "size")
    return t.filter(F.col("rel").rlike("^src.*/fr/.*$") & F.col("rel").contains("1")).orderBy(F.desc("rel")).limit(1)


@query("restore_order", _FIXED + """ SELECT snapshot, rel, max(chunk_id) AS last_chunk FROM c JOIN ix USING (hash) GROUP BY snapshot, rel ORDER BY last_chunk, snapshot, rel""")
def restore_order(spark: SparkSession, d: str) -> DataFrame:
    c = _snapshots(spark, d)
    m = dedup.manifest(c, dedup.chunk_index(c))
    return m.select("snapshot", "rel", F.array_max("chunks").alias("last_chunk")).orderBy("last_chunk", "snapshot", "rel")


@query("shared_chunks", _BOTH + """, s AS (SELECT DISTINCT hash FROM sl), t AS (SELECT DISTINCT hash FROM tl)
SELECT (SELECT count(*) FROM s) AS source_chunks, (SELECT count(*) FROM t) AS target_chunks, (SELECT count(*) FROM (SELECT * FROM s INTERSECT SELECT * FROM t)) AS shared""")
def shared_chunks(spark: SparkSession, d: str) -> DataFrame:
    s, t = (x.select(F.explode("hashes").alias("hash")).distinct() for x in (_src(spark, d), _tgt(spark, d)))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(s, "source_chunks").crossJoin(n(t, "target_chunks")).crossJoin(n(s.intersect(t), "shared"))


@query("tar_dedup", f"""WITH src AS ({SRC_SQL}), h AS (SELECT rel, size, sha256(content) AS hash FROM src), o AS (SELECT *, min(rel) OVER (PARTITION BY hash) AS owner FROM h)
SELECT CASE WHEN rel = owner THEN 'data' ELSE 'ref' END AS role, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM o GROUP BY 1""")
def tar_dedup(spark: SparkSession, d: str) -> DataFrame:
    t = lens.src_tree(spark, d).select("rel", "size", F.sha2("content", 256).alias("hash"))
    return dedup.whole_file_dedup(t).groupBy("role").agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))


@query("content_dedup_bytes", f"""WITH src AS ({SRC_SQL}), h AS (SELECT size, CASE WHEN size % 11 <> 0 THEN sha256(content) END AS hash FROM src)
SELECT CAST((SELECT coalesce(sum(m), 0) FROM (SELECT max(size) AS m FROM h WHERE hash IS NOT NULL GROUP BY hash)) + coalesce(sum(size) FILTER (hash IS NULL), 0) AS BIGINT) AS unique_bytes FROM h""")
def content_dedup_bytes(spark: SparkSession, d: str) -> DataFrame:
    t = lens.src_tree(spark, d).select("size", F.when(F.col("size") % 11 != 0, F.sha2("content", 256)).alias("hash"))
    return dedup.content_bytes(t)


@query("disk_usage", f"WITH src AS ({SRC_SQL}) SELECT CAST(sum(size) AS BIGINT) AS apparent, CAST(sum((size + 4095) // 4096 * 8 * 512) AS BIGINT) AS allocated FROM src")
def disk_usage(spark: SparkSession, d: str) -> DataFrame:
    t = lens.src_tree(spark, d).select("size", (F.floor((F.col("size") + 4095) / 4096) * 8).alias("blocks"))
    return t.agg(F.sum("size").cast("long").alias("apparent"), F.sum(F.col("blocks") * 512).cast("long").alias("allocated"))


@query("tar_members", """SELECT p, CASE WHEN starts_with(p, 'dedup/') THEN 'dedup' WHEN starts_with(p, 'meta/') THEN 'meta' WHEN p = 'index.json' THEN 'index' ELSE 'data' END AS class
FROM (VALUES ('dedup/ab'), ('meta/x.json'), ('index.json'), ('2024/a.txt'), ('dedup')) v(p)""")
def tar_members(spark: SparkSession, d: str) -> DataFrame:
    rows = [(x,) for x in ("dedup/ab", "meta/x.json", "index.json", "2024/a.txt", "dedup")]
    return spark.createDataFrame(rows, "p string").select("p", dedup.member_class("p").alias("class"))


@query("fn_footer_checksum", """SELECT event_id, CAST(list_sum(list_transform(range(1, length(props) + 1), lambda i: ascii(substring(props, i, 1)))) % 4294967296 AS BIGINT) AS checksum FROM events""")
def fn_footer_checksum(spark: SparkSession, d: str) -> DataFrame:
    e = lens.read(spark, d, "events")
    return e.select("event_id", dedup.footer_checksum(F.col("props").cast("binary")).alias("checksum"))
