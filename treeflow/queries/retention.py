"""Snapshot, version, retention and journal queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeflow import lens
from treeflow.functions import scalars
from treeflow.lens import EPOCH, SNAPS_SQL, TREES, VERSIONS_SQL
from treeflow.operators import dedup, diff, journal, retention
from treeflow.registry import query

_COLUMNS = "ts, tag, files, size_bytes, disk_usage_bytes"
_S = f"WITH s AS ({SNAPS_SQL})"


@query("snapshot_list", _S + f", g AS (SELECT ts, tag, files, size_bytes, CASE WHEN files % 3 > 0 THEN disk_usage_bytes END AS u FROM s) SELECT ts, tag, files, size_bytes, coalesce(u, size_bytes) AS disk_usage_bytes FROM g ORDER BY ts")
def snapshot_list(spark: SparkSession, d: str) -> DataFrame:
    s = lens.snaps(spark, d).withColumn("disk_usage_bytes", F.when(F.col("files") % 3 > 0, F.col("disk_usage_bytes")))
    return retention.listed(s)


@query("store_stats", _S + """ SELECT count(*) AS snapshots, CAST(sum(files) AS BIGINT) AS files, CAST(sum(size_bytes) AS BIGINT) AS apparent,
  CAST(sum(disk_usage_bytes) AS BIGINT) AS disk, min(ts) AS oldest, max(ts) AS newest, count(tag) AS tagged FROM s""")
def store_stats(spark: SparkSession, d: str) -> DataFrame:
    return retention.store_stats(lens.snaps(spark, d))


@query("savings", _S + """, x AS (SELECT ts, (1.0::DOUBLE - disk_usage_bytes::DOUBLE / size_bytes::DOUBLE) * 1000 AS x FROM s)
SELECT ts, CASE WHEN x < 0 THEN -floor(-x + 0.5) ELSE floor(x + 0.5) END / 10 AS savings_pct FROM x""")
def savings(spark: SparkSession, d: str) -> DataFrame:
    return lens.snaps(spark, d).select("ts", dedup.savings_percent(F.col("disk_usage_bytes"), F.col("size_bytes")).alias("savings_pct"))


@query("prune_by_age", _S + f" SELECT {_COLUMNS} FROM s WHERE ts < '1995-06-01T000000' AND tag IS NULL")
def prune_by_age(spark: SparkSession, d: str) -> DataFrame:
    return retention.by_age(lens.snaps(spark, d), "1995-06-01T000000")


@query("prune_by_count", _S + f", r AS (SELECT *, row_number() OVER (ORDER BY ts) AS p, count(*) OVER () AS n FROM s) SELECT {_COLUMNS} FROM r WHERE p <= n - 30 AND tag IS NULL")
def prune_by_count(spark: SparkSession, d: str) -> DataFrame:
    return retention.by_count(lens.snaps(spark, d), 30)


_SIZE = """SELECT *, sum(size_bytes) OVER () - coalesce(sum(CASE WHEN tag IS NULL THEN size_bytes ELSE 0 END) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rem FROM {}"""


@query("prune_by_size", _S + ", r AS (" + _SIZE.format("s") + f") SELECT {_COLUMNS} FROM r WHERE rem > 20000000000 AND tag IS NULL")
def prune_by_size(spark: SparkSession, d: str) -> DataFrame:
    return retention.by_size(lens.snaps(spark, d), 20_000_000_000)


@query("prune_combined", _S + f""", a AS (SELECT * FROM s WHERE ts < '1993-01-01T000000' AND tag IS NULL), s1 AS (SELECT * FROM s WHERE ts NOT IN (SELECT ts FROM a)),
c AS (SELECT {_COLUMNS} FROM (SELECT *, row_number() OVER (ORDER BY ts) AS p, count(*) OVER () AS n FROM s1) WHERE p <= n - 50 AND tag IS NULL),
s2 AS (SELECT * FROM s1 WHERE ts NOT IN (SELECT ts FROM c)), z AS (SELECT {_COLUMNS} FROM ({_SIZE.format('s2')}) WHERE rem > 10000000000 AND tag IS NULL)
SELECT *, 'age' AS rule FROM a UNION ALL SELECT *, 'count' FROM c UNION ALL SELECT *, 'size' FROM z""")
def prune_combined(spark: SparkSession, d: str) -> DataFrame:
    return retention.combined(lens.snaps(spark, d), "1993-01-01T000000", 50, 10_000_000_000)


@query("latest_per_month", _S + " SELECT ts, files FROM s ORDER BY ts DESC LIMIT 5")
def latest_per_month(spark: SparkSession, d: str) -> DataFrame:
    """The last N of a catalog."""
    return lens.snaps(spark, d).select("ts", "files").orderBy(F.desc("ts")).limit(5)


_V = f"WITH v AS ({VERSIONS_SQL})"


@query("version_index", _V + """, n AS (SELECT path FROM v UNION ALL SELECT path FROM v WHERE size % 5 = 0 UNION ALL SELECT * FROM (VALUES ('junk'), ('1_2'), ('a_b_c')) j(path)),
p AS (SELECT DISTINCT path, string_split(path, '_') AS s FROM n)
SELECT path, TRY_CAST(s[1] AS BIGINT) AS inode, TRY_CAST(s[2] AS BIGINT) AS epoch_seq, TRY_CAST(s[3] AS BIGINT) AS timestamp FROM p
WHERE len(s) >= 3 AND TRY_CAST(s[1] AS BIGINT) IS NOT NULL AND TRY_CAST(s[2] AS BIGINT) IS NOT NULL AND TRY_CAST(s[3] AS BIGINT) IS NOT NULL ORDER BY epoch_seq, timestamp""")
def version_index(spark: SparkSession, d: str) -> DataFrame:
    v = lens.versions(spark, d)
    junk = spark.createDataFrame([("junk",), ("1_2",), ("a_b_c",)], "path string")
    return retention.version_index(v.select("path").unionAll(v.filter("size % 5 = 0").select("path")).unionAll(junk))


@query("version_retention", _V + """, r AS (SELECT *, row_number() OVER w AS place FROM v WINDOW w AS (PARTITION BY inode ORDER BY epoch_seq DESC, timestamp DESC, path DESC)),
t AS (SELECT *, sum(CASE WHEN place <= 6 THEN size ELSE 0 END) OVER (PARTITION BY inode ORDER BY place ROWS UNBOUNDED PRECEDING) AS wn FROM r),
x AS (SELECT *, CASE WHEN place > 6 THEN 'count' WHEN wn > 90000000 THEN 'bytes' END AS rule FROM t)
SELECT path, rule FROM x WHERE rule IS NOT NULL AND abs(800000000 - timestamp) >= 5""")
def version_retention(spark: SparkSession, d: str) -> DataFrame:
    return retention.version_retention(lens.versions(spark, d), 6, 90_000_000, 800_000_000).select("path", "rule")


@query("emergency_prune", _V + """, r AS (SELECT *, coalesce(sum(size) OVER (ORDER BY mtime, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM v)
SELECT path, size, mtime FROM r WHERE b < 5000000000""")
def emergency_prune(spark: SparkSession, d: str) -> DataFrame:
    return retention.emergency(lens.versions(spark, d), 5_000_000_000).select("path", "size", "mtime")


@query("version_match", _V + """, f AS (SELECT DISTINCT inode, size, mtime FROM v WHERE epoch_seq % 3 = 0 UNION SELECT DISTINCT inode, size + 1, mtime FROM v WHERE epoch_seq % 7 = 0)
SELECT f.inode, f.size, f.mtime, arg_max(v.path, row(v.epoch_seq, v.timestamp, v.path)) AS version FROM f LEFT JOIN v USING (inode, size, mtime) GROUP BY 1, 2, 3""")
def version_match(spark: SparkSession, d: str) -> DataFrame:
    v = lens.versions(spark, d)
    f = v.filter("epoch_seq % 3 = 0").select("inode", "size", "mtime").union(v.filter("epoch_seq % 7 = 0").select("inode", F.col("size") + 1, "mtime")).distinct()
    return retention.latest_match(f, v.select("inode", "size", "mtime", "path", "epoch_seq", "timestamp"))


@query("content_match", TREES + """, s AS (SELECT rel, size, sha256(content) AS h, substring(content, 1, 64) AS head FROM src),
t AS (SELECT rel, size, sha256(content) AS h, substring(content, 1, 64) AS head FROM tgt)
SELECT s.rel, min(t.rel) AS version FROM s JOIN t ON s.h = t.h AND s.size = t.size WHERE s.head = t.head GROUP BY s.rel""")
def content_match(spark: SparkSession, d: str) -> DataFrame:
    """A version with the same digest and size whose sample agrees: equi join, then the residual test.

    Both sides are first reduced to one row per content, so copies don't multiply.
    """
    s = lens.src_tree(spark, d).select("rel", "size", F.sha2("content", 256).alias("h"), F.substring("content", 1, 64).alias("head"))
    t = lens.tgt_tree(spark, d).select("rel", "size", F.sha2("content", 256).alias("h"), F.substring("content", 1, 64).alias("t_head"))
    one = t.groupBy("h", "size", "t_head").agg(F.min("rel").alias("version"))
    return s.join(one, ["h", "size"]).filter("head = t_head").groupBy("rel").agg(F.min("version").alias("version"))


@query("checkpoint_keep", """WITH c AS (SELECT event_type AS stream, 'ckpt-' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS name FROM events WHERE event_id % 50 = 0)
SELECT stream, name FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY name DESC) AS p FROM c) WHERE p > 3""")
def checkpoint_keep(spark: SparkSession, d: str) -> DataFrame:
    e = lens.read(spark, d, "events").filter("event_id % 50 = 0")
    c = e.select(F.col("event_type").alias("stream"), F.concat(F.lit("ckpt-"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("name"))
    return retention.checkpoints_to_delete(c, 3)


# --- tombstones ---------------------------------------------------------------------------------

_LINES = f"""lines AS (SELECT '{{"p":"' || source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt","d":false,"t":' || CAST({EPOCH} + doc_id * 100 AS VARCHAR) || ',"s":' || CAST(doc_id AS VARCHAR) || '}}' AS value
  FROM documents WHERE doc_id % 29 = 1 UNION ALL SELECT * FROM (VALUES (''), ('   '), ('not json'), ('{{"p":"x"}}'), ('{{"p":"src5","d":true,"t":{EPOCH + 30000},"s":1}}')) v(value)),
tomb AS (SELECT json_extract_string(value, '$.p') AS p, CAST(json_extract_string(value, '$.d') AS BOOLEAN) AS d, CAST(json_extract_string(value, '$.t') AS BIGINT) AS t,
  CAST(json_extract_string(value, '$.s') AS BIGINT) AS s FROM lines WHERE json_valid(value) AND json_extract_string(value, '$.s') IS NOT NULL)"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    docs = lens.read(spark, d, "documents").filter("doc_id % 29 = 1")
    rel = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    own = docs.select(F.to_json(F.struct(rel.alias("p"), F.lit(False).alias("d"), (F.lit(EPOCH) + F.col("doc_id") * 100).alias("t"), F.col("doc_id").alias("s"))).alias("value"))
    odd = ["", "   ", "not json", '{"p":"x"}', '{"p":"src5","d":true,"t":%d,"s":1}' % (EPOCH + 30000)]
    return own.unionByName(spark.createDataFrame([(x,) for x in odd], "value string"))


@query("tombstone_scan", f"WITH {_LINES} SELECT p, d, t, s FROM tomb")
def tombstone_scan(spark: SparkSession, d: str) -> DataFrame:
    return journal.parsed(lines(spark, d))


@query("tombstone_compact", f"WITH {_LINES} SELECT p, d, t, s FROM tomb WHERE t >= {EPOCH + 60000} - 43200")
def tombstone_compact(spark: SparkSession, d: str) -> DataFrame:
    return journal.compacted(journal.parsed(lines(spark, d)), EPOCH + 60000, 12 * 3600)


@query("delete_propagation", TREES + f""", {_LINES}, l AS (SELECT p, d, max(t) AS t FROM tomb GROUP BY p, d),
g AS (SELECT DISTINCT rel FROM tgt JOIN l ON (rel = p OR (d AND starts_with(rel, p || '/'))) AND t >= mtime_sec) SELECT rel FROM g WHERE NOT regexp_matches(rel, '^.*/es/.*$')""")
def delete_propagation(spark: SparkSession, d: str) -> DataFrame:
    """A journal that isn't empty is replayed (excluded paths stay); without one, what is stale goes."""
    tomb = journal.parsed(lines(spark, d))
    target = lens.tgt_tree(spark, d).select("rel", "mtime_sec")
    if tomb.isEmpty():
        return diff.stale(lens.src_tree(spark, d), target.select("rel"))
    return journal.replayed(target, tomb, lambda x: x.filter(~F.col("rel").rlike("^.*/es/.*$")))


# --- identities ---------------------------------------------------------------------------------

_ID = "WITH i AS (SELECT CAST(c_custkey AS BIGINT) AS inode, c_custkey % 9 = 0 AS unlinked, CAST(c_custkey * 7919 % 100003 AS BIGINT) AS last_seq FROM customer)"


def _identities(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey").cast("long")
    return lens.read(spark, d, "customer").select(k.alias("inode"), (k % 9 == 0).alias("unlinked"), (k * 7919 % 100003).alias("last_seq"))


@query("identity_evict", _ID + """, n AS (SELECT CASE WHEN count(*) > 100 THEN count(*) - 90 ELSE 0 END AS x FROM i)
SELECT inode, unlinked, last_seq FROM (SELECT *, row_number() OVER (ORDER BY unlinked DESC, last_seq, inode) AS p FROM i), n WHERE p <= x""")
def identity_evict(spark: SparkSession, d: str) -> DataFrame:
    return retention.evicted(_identities(spark, d), 100)


@query("identity_expire", _ID + " SELECT inode, unlinked, last_seq FROM i WHERE unlinked OR 150000 - last_seq > 100000")
def identity_expire(spark: SparkSession, d: str) -> DataFrame:
    return retention.expired(_identities(spark, d), 150_000)


@query("snapshot_times", _S + """ SELECT ts, strptime(ts, '%Y-%m-%dT%H%M%S') AS t, substring(ts, 1, 13) || ':' || substring(ts, 14, 2) || ':' || substring(ts, 16, 2) || 'Z' AS iso FROM s""")
def snapshot_times(spark: SparkSession, d: str) -> DataFrame:
    return lens.snaps(spark, d).select("ts", scalars.snapshot_time("ts").alias("t"), scalars.iso_of("ts").alias("iso"))
