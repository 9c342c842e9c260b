"""Identity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeflow import lens
from treeflow.lens import CHG_SQL
from treeflow.operators import identity
from treeflow.registry import query

_E = f"WITH e AS (SELECT *, name || '.' || CAST(seq AS VARCHAR) AS new_name FROM ({CHG_SQL}))"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return lens.chg(spark, d).withColumn("new_name", F.concat_ws(".", "name", F.col("seq").cast("string")))


@query("identity_final", _E + """, g AS (SELECT inode, arg_max(CASE WHEN etype = 7 THEN new_name ELSE name END, seq) FILTER (etype IN (7, 8, 10, 16, 17)) AS name,
  max(seq) FILTER (etype IN (7, 8, 10, 16, 17)) AS n, max(seq) FILTER (etype IN (9, 5)) AS x FROM e WHERE etype IN (5, 7, 8, 9, 10, 16, 17) GROUP BY inode)
SELECT inode, name, n IS NOT NULL AND (x IS NULL OR x < n) AS alive FROM g""")
def identity_final(spark: SparkSession, d: str) -> DataFrame:
    return identity.final_names(_events(spark, d))


@query("deferred_renames", _E + """, c AS (SELECT inode, min(seq) AS created FROM e WHERE etype IN (8, 10, 16, 17) GROUP BY inode)
SELECT e.seq, e.inode, CASE WHEN etype = 7 AND e.seq < created THEN created ELSE e.seq END AS at, coalesce(etype = 7 AND e.seq < created, false) AS deferred FROM e LEFT JOIN c USING (inode)""")
def deferred_renames(spark: SparkSession, d: str) -> DataFrame:
    return identity.effective_order(_events(spark, d)).select("seq", "inode", "at", "deferred")


def _moves(spark: SparkSession, d: str) -> DataFrame:
    """Chains of four renames a -> b -> c -> d -> e."""
    e = lens.read(spark, d, "events").filter("event_id % 6 < 4")
    name = lambda x: F.concat(F.lit("n"), x.cast("string"))
    return e.select(name(F.col("event_id")).alias("src"), name(F.col("event_id") + 1).alias("dst"))


_CHAIN = "m AS (SELECT 'n' || CAST(event_id AS VARCHAR) AS src, 'n' || CAST(event_id + 1 AS VARCHAR) AS dst FROM events WHERE event_id % 6 < 4)"


@query("rename_chain_end", f"""WITH RECURSIVE {_CHAIN}, r AS (SELECT src AS start, dst AS "end", CAST(1 AS BIGINT) AS hops FROM m WHERE src NOT IN (SELECT dst FROM m)
  UNION ALL SELECT r.start, m.dst, r.hops + 1 FROM r JOIN m ON r."end" = m.src)
SELECT start, arg_max("end", hops) AS "end", max(hops) AS hops FROM r GROUP BY start""")
def rename_chain_end(spark: SparkSession, d: str) -> DataFrame:
    return identity.chain_ends(_moves(spark, d))


_TREE = "t AS (SELECT CAST(c_custkey AS BIGINT) AS inode, CAST(c_custkey // 5 AS BIGINT) AS parent, 'd' || CAST(c_custkey AS VARCHAR) AS name FROM customer WHERE c_custkey > 0)"


def _entries(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey").cast("long")
    return lens.read(spark, d, "customer").filter("c_custkey > 0").select(k.alias("inode"), F.floor(k / 5).cast("long").alias("parent"), F.concat(F.lit("d"), k.cast("string")).alias("name"))


@query("path_resolve", f"""WITH RECURSIVE {_TREE}, r AS (SELECT inode, name AS path FROM t WHERE parent = 0 UNION ALL SELECT t.inode, r.path || '/' || t.name FROM t JOIN r ON t.parent = r.inode)
SELECT inode, path FROM r""")
def path_resolve(spark: SparkSession, d: str) -> DataFrame:
    return identity.resolved_paths(_entries(spark, d))


@query("rename_exchange", f"""WITH {_TREE}, e AS (SELECT inode, name AS path FROM t), s AS (SELECT 'd' || CAST(i AS VARCHAR) AS a, 'd' || CAST(i + 1 AS VARCHAR) AS b FROM range(10, 1000, 4) r(i)),
x AS (SELECT a, b FROM s UNION ALL SELECT b, a FROM s) SELECT inode, coalesce(x.b, path) AS path FROM e LEFT JOIN x ON path = x.a""")
def rename_exchange(spark: SparkSession, d: str) -> DataFrame:
    name = lambda x: F.concat(F.lit("d"), x.cast("string"))
    swaps = spark.range(10, 1000, 4).select(name(F.col("id")).alias("path_a"), name(F.col("id") + 1).alias("path_b"))
    return identity.exchanged(_entries(spark, d).select("inode", F.col("name").alias("path")), swaps)


@query("parent_paths", _E + """, d AS (SELECT i AS inode, '/dir' || CAST(i AS VARCHAR) AS path FROM range(3) r(i)), n AS (SELECT i AS inode, '/known/' || CAST(i AS VARCHAR) AS path FROM range(0, 100, 3) r(i))
SELECT seq, CASE WHEN d.path IS NOT NULL THEN d.path || '/' || name ELSE coalesce(n.path, name) END AS path FROM e LEFT JOIN d ON d.inode = e.inode % 7 LEFT JOIN n ON n.inode = e.inode""")
def parent_paths(spark: SparkSession, d: str) -> DataFrame:
    e = lens.chg(spark, d).withColumn("parent_inode", F.col("inode") % 7)
    dirs = spark.range(3).select(F.col("id").alias("inode"), F.concat(F.lit("/dir"), F.col("id").cast("string")).alias("path"))
    known = spark.range(0, 100, 3).select(F.col("id").alias("inode"), F.concat(F.lit("/known/"), F.col("id").cast("string")).alias("path"))
    return identity.parent_paths(e, dirs, known).select("seq", "path")


@query("hard_links", _E + """, g AS (SELECT inode, greatest(sum(CASE WHEN etype IN (8, 10, 16, 17, 12) THEN 1 WHEN etype = 9 THEN -1 ELSE 0 END), 0) AS p FROM e GROUP BY inode)
SELECT inode, CAST(p AS BIGINT) AS paths, p = 0 AS unlinked FROM g""")
def hard_links(spark: SparkSession, d: str) -> DataFrame:
    return identity.link_counts(lens.chg(spark, d))


@query("generations", _E + """, k AS (SELECT *, CASE WHEN etype IN (8, 10, 16, 17) THEN 'c' WHEN etype IN (9, 5) THEN 'd' END AS kind FROM e),
b AS (SELECT *, last_value(kind IGNORE NULLS) OVER (PARTITION BY inode ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k)
SELECT seq, inode, CAST(coalesce(sum(CASE WHEN kind = 'c' AND before = 'd' THEN 1 ELSE 0 END) OVER (PARTITION BY inode ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS generation FROM b""")
def generations(spark: SparkSession, d: str) -> DataFrame:
    return identity.generations(lens.chg(spark, d)).select("seq", "inode", F.col("generation").cast("long").alias("generation"))


@query("identity_projection")
def identity_projection(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumns({"tree": F.col("inode") % 16, "flags": F.lit(0).cast("long"), "etype": F.col("etype").cast("long")})
    return identity.projected(e)


@query("hydration_gate", _E + " SELECT seq, inode FROM e WHERE etype IN (1, 2, 11) AND inode NOT IN (SELECT inode FROM e WHERE etype = 8 AND seq < 200)")
def hydration_gate(spark: SparkSession, d: str) -> DataFrame:
    e = lens.chg(spark, d)
    return identity.not_hydrated(e, e.filter("etype = 8 AND seq < 200").select("inode").distinct()).select("seq", "inode")


@query("current_jobs", "SELECT event_id, user_id % 3 AS generation FROM events WHERE user_id % 3 = 2")
def current_jobs(spark: SparkSession, d: str) -> DataFrame:
    return identity.current_jobs(lens.read(spark, d, "events").select("event_id", (F.col("user_id") % 3).alias("generation")), 2)


@query("valid_identities", f"WITH {_TREE} SELECT inode, name AS path FROM t WHERE inode % 13 <> 4")
def valid_identities(spark: SparkSession, d: str) -> DataFrame:
    """Every 13th path was taken by another inode since."""
    index = _entries(spark, d).select("inode", F.col("name").alias("path"))
    live = index.withColumn("inode", F.when(F.col("inode") % 13 == 4, F.col("inode") + 1_000_000).otherwise(F.col("inode")))
    return identity.valid_identities(index, live).select("inode", "path")


@query("sync_flags", _E + """, w AS (SELECT inode, max(seq) AS set_at FROM e WHERE etype IN (1, 2) GROUP BY inode), c AS (SELECT inode, max(seq) AS cleared_at FROM e WHERE etype = 13 GROUP BY inode)
SELECT inode, cleared_at IS NULL OR set_at > cleared_at AS dirty FROM w LEFT JOIN c USING (inode)""")
def sync_flags(spark: SparkSession, d: str) -> DataFrame:
    """A file is dirty from before a write until what clears it; both are idempotent."""
    at = lambda cond, n: F.max(F.when(cond, F.col("seq"))).alias(n)
    g = lens.chg(spark, d).groupBy("inode").agg(at(F.col("etype").isin(1, 2), "set_at"), at(F.col("etype") == 13, "cleared_at"))
    return g.filter("set_at IS NOT NULL").select("inode", (F.col("cleared_at").isNull() | (F.col("set_at") > F.col("cleared_at"))).alias("dirty"))


@query("mount_states", """WITH p AS (SELECT user_id % 4 AS target, event_id AS seq, event_id % 11 < 8 AS up FROM events),
c AS (SELECT *, lag(up) OVER (PARTITION BY target ORDER BY seq) AS was FROM p) SELECT target, seq, CASE WHEN up THEN 'available' ELSE 'outage' END AS state FROM c WHERE was IS DISTINCT FROM up""")
def mount_states(spark: SparkSession, d: str) -> DataFrame:
    """Transitions of each target between available and outage."""
    p = lens.read(spark, d, "events").select((F.col("user_id") % 4).alias("target"), F.col("event_id").alias("seq"), (F.col("event_id") % 11 < 8).alias("up"))
    was = F.lag("up").over(Window.partitionBy("target").orderBy("seq"))
    return p.withColumn("was", was).filter(~F.col("was").eqNullSafe(F.col("up"))).select("target", "seq", F.when(F.col("up"), "available").otherwise("outage").alias("state"))
