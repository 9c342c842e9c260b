"""Change-event queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeflow import dims, lens
from treeflow.lens import CHG_SQL, GAPPY_SQL, SHUFFLED_SQL, WRITES_SQL
from treeflow.operators import coalesce, sequence
from treeflow.registry import query

_TYPES = f"types AS ({dims.event_types_sql()})"


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return sequence.with_type(lens.chg(spark, d), dims.event_types(spark))


@query("event_tins", f"""WITH chg AS ({CHG_SQL}), {_TYPES} SELECT tin, type_name, count(*) AS n, max(seq) AS last_seq
FROM chg JOIN types ON etype = code GROUP BY tin, type_name""")
def event_tins(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d).groupBy("tin", "type_name").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))


@query("device_status", f"WITH chg AS ({CHG_SQL}) SELECT inode % 3 AS device, max(seq) AS max_seq, count(*) AS events FROM chg GROUP BY 1")
def device_status(spark: SparkSession, d: str) -> DataFrame:
    return lens.chg(spark, d).groupBy((F.col("inode") % 3).alias("device")).agg(F.max("seq").alias("max_seq"), F.count("*").alias("events"))


@query("type_predicates", f"WITH {_TYPES} SELECT code, type_name, tin, CAST(tin_rank AS INTEGER) AS tin_rank, control_plane, global_order, structural_metadata FROM types")
def type_predicates(spark: SparkSession, d: str) -> DataFrame:
    return dims.event_types(spark).drop("tin_capacity")


@query("seq_gaps", f"""WITH e AS ({SHUFFLED_SQL}), l AS (SELECT *, coalesce(max(seq) OVER (PARTITION BY domain ORDER BY arrival
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS last FROM e)
SELECT domain, last + 1 AS from_seq, seq - 1 AS to_seq, seq - last > 1000 AS large FROM l WHERE seq > last + 1""")
def seq_gaps(spark: SparkSession, d: str) -> DataFrame:
    return sequence.gaps(lens.chg_shuffled(spark, d))


@query("reorder_gaps", f"""WITH e AS ({GAPPY_SQL}), r AS (SELECT domain, seq, etype, lag(seq) OVER (PARTITION BY domain ORDER BY seq) AS before FROM e)
SELECT domain, seq, etype, CAST(NULL AS VARCHAR) AS name FROM r
UNION ALL SELECT domain, before + 1, 255, 'GAP-' || CAST(before + 1 AS VARCHAR) || '-' || CAST(seq - 1 AS VARCHAR) FROM r WHERE seq > before + 1""")
def reorder_gaps(spark: SparkSession, d: str) -> DataFrame:
    return sequence.reordered(lens.chg_shuffled(spark, d))


@query("late_events", f"""WITH e AS ({SHUFFLED_SQL}) SELECT seq, arrival, coalesce(max(seq) OVER (PARTITION BY domain ORDER BY arrival
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > seq, false) AS late FROM e""")
def late_events(spark: SparkSession, d: str) -> DataFrame:
    return sequence.late(lens.chg_shuffled(spark, d)).select("seq", "arrival", "late")


_KIND = "CASE WHEN etype IN (8, 10, 16) THEN 1 WHEN etype IN (9, 5) THEN 2 END"
_TRANSIENT = f"""WITH e AS ({CHG_SQL}), k AS (SELECT *, {_KIND} AS kind FROM e),
o AS (SELECT *, lag(kind) OVER (PARTITION BY inode ORDER BY seq) AS prev, lead(kind) OVER (PARTITION BY inode ORDER BY seq) AS next FROM k WHERE kind IS NOT NULL)"""


@query("transient_suppress", _TRANSIENT + """ SELECT seq, inode, etype FROM o WHERE NOT coalesce(kind = 2 AND prev = 1, false)
UNION ALL SELECT seq, inode, etype FROM k WHERE kind IS NULL""")
def transient_suppress(spark: SparkSession, d: str) -> DataFrame:
    return sequence.transient_suppressed(lens.chg(spark, d)).select("seq", "inode", "etype")


@query("transient_pairs", _TRANSIENT + """ SELECT seq, inode, etype FROM o WHERE NOT coalesce(kind = 2 AND prev = 1, false) AND NOT coalesce(kind = 1 AND next = 2, false)
UNION ALL SELECT seq, inode, etype FROM k WHERE kind IS NULL""")
def transient_pairs(spark: SparkSession, d: str) -> DataFrame:
    return sequence.transient_suppressed(lens.chg(spark, d), drop_pair=True).select("seq", "inode", "etype")


@query("lifecycle_prune", f"""WITH e AS ({CHG_SQL}), h AS (SELECT * FROM e ORDER BY seq LIMIT 500), u AS (SELECT DISTINCT inode FROM h WHERE etype = 9)
SELECT seq, inode, etype FROM e WHERE NOT (seq <= (SELECT max(seq) FROM h) AND inode IN (SELECT inode FROM u))""")
def lifecycle_prune(spark: SparkSession, d: str) -> DataFrame:
    return sequence.lifecycle_pruned(lens.chg(spark, d), 500).select("seq", "inode", "etype")


@query("contiguous_watermark", f"""WITH e AS ({GAPPY_SQL}), r AS (SELECT seq, seq - row_number() OVER (ORDER BY seq) AS k, min(seq) OVER () AS s FROM e)
SELECT CAST(0 AS BIGINT) AS domain, max(seq) AS watermark FROM r WHERE k = s - 1""")
def contiguous_watermark(spark: SparkSession, d: str) -> DataFrame:
    return sequence.completion_watermark(lens.chg_gappy(spark, d))


@query("rename_storm", f"""WITH e AS ({CHG_SQL}), p AS (SELECT seq, inode, etype, count(*) FILTER (etype IN (7, 23)) OVER (PARTITION BY inode ORDER BY seq DESC
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pending_renames FROM e) SELECT seq, inode, pending_renames FROM p WHERE etype = 8 AND pending_renames > 0""")
def rename_storm(spark: SparkSession, d: str) -> DataFrame:
    return sequence.rename_storms(lens.chg(spark, d)).select("seq", "inode", "pending_renames")


@query("error_streaks", """WITH r AS (SELECT event_id AS seq, user_id % 5 AS worker, event_id % 17 = 0 AS ok FROM events),
i AS (SELECT *, coalesce(sum(CAST(ok AS INTEGER)) OVER (PARTITION BY worker ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM r),
s AS (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY worker, island ORDER BY seq) AS streak FROM i)
SELECT worker, seq, streak FROM s WHERE ok AND streak > 5""")
def error_streaks(spark: SparkSession, d: str) -> DataFrame:
    r = lens.read(spark, d, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 5).alias("worker"), (F.col("event_id") % 17 == 0).alias("ok"))
    return sequence.error_streaks(r).select("worker", "seq", "streak")


@query("scan_depths", """SELECT event_id, CAST(CASE WHEN value > 80 THEN 640 WHEN value > 50 THEN 128 ELSE 64 END AS INTEGER) AS depth FROM events""")
def scan_depths(spark: SparkSession, d: str) -> DataFrame:
    e = lens.read(spark, d, "events")
    return e.select("event_id", sequence.scan_depth(F.col("value") / 100, 64).cast("int").alias("depth"))


@query("worker_routing", f"""WITH e AS ({CHG_SQL}), {_TYPES}, t AS (SELECT inode, control_plane FROM e JOIN types ON etype = code)
SELECT control_plane, count(*) AS events, count(DISTINCT inode) AS inodes, CAST(1 AS BIGINT) AS most_workers_per_inode FROM t GROUP BY control_plane""")
def worker_routing(spark: SparkSession, d: str) -> DataFrame:
    """What routing promises: one worker per inode within a plane (worker ids depend on the hash)."""
    routed = _typed(spark, d).withColumn("parent_inode", F.lit(0).cast("long")).withColumn("worker", sequence.worker_of(8))
    per = routed.groupBy("control_plane", "inode").agg(F.countDistinct("worker").alias("w"), F.count("*").alias("n"))
    return per.groupBy("control_plane").agg(F.sum("n").alias("events"), F.count("*").alias("inodes"), F.max("w").alias("most_workers_per_inode"))


@query("tin_drops", f"""WITH e AS ({CHG_SQL}), {_TYPES}, t AS (SELECT seq // 2000 AS batch, inode % 4 AS worker, tin, tin_capacity AS cap FROM e JOIN types ON etype = code),
g AS (SELECT batch, worker, tin, max(cap) AS cap, count(*) AS n FROM t GROUP BY 1, 2, 3),
a AS (SELECT *, CASE WHEN tin IN ('metadata', 'bulk') THEN least(n, cap) ELSE n END AS accepted FROM g)
SELECT batch, worker, tin, CAST(accepted AS BIGINT) AS accepted, CAST(n - accepted AS BIGINT) AS dropped FROM a""")
def tin_drops(spark: SparkSession, d: str) -> DataFrame:
    e = _typed(spark, d).withColumns({"batch": F.floor(F.col("seq") / 2000), "worker": F.col("inode") % 4})
    return sequence.queue_drops(e)


@query("priority_drain", f"""WITH e AS ({CHG_SQL}), {_TYPES} SELECT seq, tin, row_number() OVER (PARTITION BY seq // 500 ORDER BY tin_rank, seq) AS place FROM e JOIN types ON etype = code""")
def priority_drain(spark: SparkSession, d: str) -> DataFrame:
    """Order within a micro-batch: control, structural, metadata, bulk, each by number."""
    w = Window.partitionBy(F.floor(F.col("seq") / 500)).orderBy("tin_rank", "seq")
    return _typed(spark, d).select("seq", "tin", F.row_number().over(w).cast("long").alias("place"))


@query("synthetic_mkdirs", f"""WITH e AS (SELECT *, inode % 7 AS parent FROM ({CHG_SQL})), known AS (SELECT DISTINCT inode FROM e WHERE etype = 8 AND inode < 3)
SELECT parent AS inode, min(seq) AS seq, 10 AS etype FROM e WHERE parent <> 0 AND parent NOT IN (SELECT inode FROM known) GROUP BY parent""")
def synthetic_mkdirs(spark: SparkSession, d: str) -> DataFrame:
    e = lens.chg(spark, d).withColumn("parent_inode", F.col("inode") % 7)
    return sequence.synthetic_parents(e, e.filter("etype = 8 AND inode < 3").select("inode").distinct())


@query("error_classes", f"""WITH {_TYPES}, k AS (SELECT * FROM (VALUES ('not_found'), ('permission_denied'), ('timed_out'), ('other'), (NULL)) v(io_kind))
SELECT code, io_kind, CASE WHEN io_kind = 'not_found' AND code IN (1, 2, 24, 11, 18, 7, 23) THEN 'target_not_found' WHEN io_kind = 'not_found' THEN 'source_not_found'
  WHEN io_kind = 'permission_denied' THEN 'permanent' ELSE 'transient' END AS class,
  CASE WHEN code IN (1, 2, 24) THEN 'write' WHEN code = 11 THEN 'truncate' WHEN code IN (7, 23) THEN 'rename' WHEN code IN (9, 5) THEN 'remove' ELSE 'metadata' END AS op
FROM types, k""")
def error_classes(spark: SparkSession, d: str) -> DataFrame:
    kinds = spark.createDataFrame([("not_found",), ("permission_denied",), ("timed_out",), ("other",), (None,)], "io_kind string")
    both = dims.event_types(spark).select("code").crossJoin(kinds)
    return both.select("code", "io_kind", sequence.error_class(etype="code").alias("class"), sequence.operation_kind("code").alias("op"))


@query("device_numbers", """WITH v AS (SELECT event_id * 7919 + (user_id << 33) AS dev FROM events)
SELECT dev, ((((dev >> 8) & 4095) | ((dev >> 32) & 4294963200)) << 20) | ((dev & 255) | ((dev >> 12) & 4294967040)) AS normal FROM v""")
def device_numbers(spark: SparkSession, d: str) -> DataFrame:
    e = lens.read(spark, d, "events").select((F.col("event_id") * 7919 + F.shiftleft(F.col("user_id").cast("long"), 33)).alias("dev"))
    return e.select("dev", sequence.normal_device("dev").alias("normal"))


@query("coalesce_writes", f"""WITH w AS ({WRITES_SQL}), s AS (SELECT *, CASE WHEN lag(off + len) OVER (PARTITION BY inode, name ORDER BY seq) = off THEN 0 ELSE 1 END AS st FROM w),
i AS (SELECT *, sum(st) OVER (PARTITION BY inode, name ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT inode, name, min(seq) AS seq, min(off) AS off, CAST(sum(len) AS BIGINT) AS len, count(*) AS merged FROM i GROUP BY inode, name, island""")
def coalesce_writes(spark: SparkSession, d: str) -> DataFrame:
    return coalesce.contiguous(lens.writes(spark, d))


@query("coalesce_writes_capped")
def coalesce_writes_capped(spark: SparkSession, d: str) -> DataFrame:
    return coalesce.merge_capped(lens.writes(spark, d), depth=4, limit=60)


@query("capture_aggregation")
def capture_aggregation(spark: SparkSession, d: str) -> DataFrame:
    w = lens.writes(spark, d).withColumns({"ts_ns": F.col("seq") * 20_000_000, "flags": F.floor(F.col("seq") / 3).cast("long")})
    return coalesce.aggregate_window(w.select("inode", "ts_ns", "off", "len", "flags"), 50_000_000, 1 << 20)


@query("pending_inodes", f"WITH w AS ({WRITES_SQL}) SELECT inode, min(seq) AS first_seq, count(*) AS pending FROM w GROUP BY inode")
def pending_inodes(spark: SparkSession, d: str) -> DataFrame:
    return lens.writes(spark, d).groupBy("inode").agg(F.min("seq").alias("first_seq"), F.count("*").alias("pending"))


@query("session_writes", f"""WITH e AS (SELECT inode, len, epoch_us(ts) AS t FROM ({CHG_SQL}) WHERE etype IN (1, 2)),
s AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY inode ORDER BY t) <= 6 * 3600 * 1000000::BIGINT THEN 0 ELSE 1 END AS st FROM e),
i AS (SELECT *, sum(st) OVER (PARTITION BY inode ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT inode, min(t) AS started_us, count(*) AS writes, CAST(sum(len) AS BIGINT) AS bytes FROM i GROUP BY inode, k""")
def session_writes(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of writes of a file: sessions that end after six hours of silence."""
    w = lens.chg(spark, d).filter("etype IN (1, 2)").withColumn("ts", F.col("ts").cast("timestamp"))
    out = w.groupBy("inode", F.session_window("ts", "21600001 milliseconds").alias("s")).agg(F.count("*").alias("writes"), F.sum("len").cast("long").alias("bytes"))
    return out.select("inode", F.unix_micros("s.start").alias("started_us"), "writes", "bytes")


@query("flush_policy", f"""WITH w AS ({WRITES_SQL}), r AS (SELECT inode, seq, sum(len) OVER (PARTITION BY inode ORDER BY seq ROWS UNBOUNDED PRECEDING) AS bytes, seq - min(seq) OVER (PARTITION BY inode) AS age, inode % 3 = 0 AS busy FROM w)
SELECT inode, seq, bytes >= 60 OR age > 4 OR NOT busy AS flush FROM r""")
def flush_policy(spark: SparkSession, d: str) -> DataFrame:
    """Pending writes are flushed at a byte limit, at an age, or at once while nothing else is to do."""
    w = Window.partitionBy("inode").orderBy("seq")
    r = lens.writes(spark, d).withColumns({
        "bytes": F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0)), "age": F.col("seq") - F.min("seq").over(Window.partitionBy("inode")),
    })
    return r.select("inode", "seq", ((F.col("bytes") >= 60) | (F.col("age") > 4) | (F.col("inode") % 3 != 0)).alias("flush"))
