"""Tree comparison, reconciliation and planning queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeflow import dims, lens
from treeflow.lens import SRC_SQL, TARGETS_SQL, TREES
from treeflow.operators import diff, filters
from treeflow.plans import strategy
from treeflow.registry import query
from treeflow.shared import scratch, written


@query("tree_verify", TREES + """, f AS (
  SELECT CASE WHEN t.rel IS NULL THEN 'missing' WHEN s.rel IS NULL THEN 'extra' WHEN s.size <> t.size THEN 'size'
    WHEN sha256(s.content) <> sha256(t.content) THEN 'content' ELSE 'ok' END AS finding FROM src s FULL JOIN tgt t ON s.rel = t.rel)
SELECT finding, count(*) AS n FROM f GROUP BY finding""")
def tree_verify(spark: SparkSession, d: str) -> DataFrame:
    found = diff.verify(lens.src_tree(spark, d), lens.tgt_tree(spark, d))
    return found.groupBy("finding").agg(F.count("*").alias("n"))


@query("missing_files", TREES + " SELECT rel, size FROM src WHERE rel NOT IN (SELECT rel FROM tgt)")
def missing_files(spark: SparkSession, d: str) -> DataFrame:
    return diff.missing(lens.src_tree(spark, d).select("rel", "size"), lens.tgt_tree(spark, d))


@query("stale_files", TREES + " SELECT rel, size FROM tgt WHERE rel NOT IN (SELECT rel FROM src)")
def stale_files(spark: SparkSession, d: str) -> DataFrame:
    return diff.stale(lens.src_tree(spark, d), lens.tgt_tree(spark, d).select("rel", "size"))


@query("common_files", TREES + " SELECT rel FROM src INTERSECT SELECT rel FROM tgt")
def common_files(spark: SparkSession, d: str) -> DataFrame:
    return lens.src_tree(spark, d).select("rel").intersect(lens.tgt_tree(spark, d).select("rel"))


@query("needs_copy", TREES + """ SELECT s.rel, s.size, t.rel IS NULL AS absent FROM src s LEFT JOIN tgt t ON s.rel = t.rel
WHERE t.rel IS NULL OR s.size <> t.size OR s.mtime_sec <> t.mtime_sec OR s.mtime_nsec <> t.mtime_nsec""")
def needs_copy(spark: SparkSession, d: str) -> DataFrame:
    both = diff.with_target(lens.src_tree(spark, d).drop("content"), lens.tgt_tree(spark, d))
    return both.filter(diff.needs_copy()).select("rel", "size", F.col("t_exists").isNull().alias("absent"))


@query("post_copy_check", TREES + """ SELECT s.rel, sha256(s.content) = sha256(t.content) AS verified FROM src s JOIN tgt t ON s.rel = t.rel""")
def post_copy_check(spark: SparkSession, d: str) -> DataFrame:
    """Verification after a copy: targets that are missing are left out."""
    side = lambda t, n: t.select("rel", F.sha2("content", 256).alias(n))
    both = side(lens.src_tree(spark, d), "a").join(side(lens.tgt_tree(spark, d), "b"), "rel")
    return both.select("rel", (F.col("a") == F.col("b")).alias("verified"))


_CHILD = "sha256(CAST(size AS VARCHAR) || ':' || CAST(mtime_sec AS VARCHAR) || ':' || CAST(mtime_nsec AS VARCHAR) || ':f')"
_PARTS = "string_split(dir, '/')"
_DIR = f"""WITH f AS (SELECT parent AS dir, name, {_CHILD} AS h, mtime_sec FROM {{}}),
d AS (SELECT dir, count(*) AS n, max(mtime_sec) AS newest FROM f GROUP BY dir),
a AS (SELECT DISTINCT array_to_string({_PARTS}[1 : k], '/') AS dir FROM (SELECT dir, unnest(range(1, len({_PARTS}) + 1)) AS k FROM d)),
e AS (SELECT dir, name, h FROM f UNION ALL SELECT array_to_string({_PARTS}[1 : len({_PARTS}) - 1], '/'), {_PARTS}[-1],
  sha256(CAST(coalesce(n, 0) AS VARCHAR) || ':' || CAST(coalesce(newest, 0) AS VARCHAR) || ':0:d') FROM a LEFT JOIN d USING (dir) WHERE dir <> ''),
s AS (SELECT dir, substr(sha256(name), 1, 3) AS slice, sha256(string_agg(name || ':' || h, chr(10) ORDER BY name, h)) AS h, count(*) AS n FROM e GROUP BY dir, slice)
SELECT dir, sha256(string_agg(slice || ':' || h, chr(10) ORDER BY slice)) AS hash, CAST(sum(n) AS BIGINT) AS children FROM s GROUP BY dir"""


@query("dir_hash", TREES + ", h AS (" + _DIR.format("src") + ") SELECT * FROM h")
def dir_hash(spark: SparkSession, d: str) -> DataFrame:
    return diff.directory_hashes(lens.src_tree(spark, d))


def _stored(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Stored directory hashes: those of the target tree on one target, of the source on the others but for one source."""
    part = src.filter(~F.col("dir").startswith("src3/"))
    names = list(lens.TARGETS)
    at = lambda t, name: t.select(F.lit(name).alias("target"), "dir", "hash")
    return at(tgt, names[0]).unionByName(at(part, names[1])).unionByName(at(src, names[2]))


_PRUNE = TREES + f""", sd AS ({_DIR.format('src')}), td AS ({_DIR.format('tgt')}), targets AS ({TARGETS_SQL}),
stored AS (SELECT 't_nvme' AS target, dir, hash FROM td UNION ALL SELECT 't_hdd', dir, hash FROM sd WHERE NOT starts_with(dir, 'src3/')
  UNION ALL SELECT 't_nfs', dir, hash FROM sd),
dec AS (SELECT sd.dir, bool_and(coalesce(sd.hash = stored.hash, false)) AS pruned FROM sd CROSS JOIN targets
  LEFT JOIN stored ON stored.target = targets.target AND stored.dir = sd.dir GROUP BY sd.dir)"""


@query("dir_prune", _PRUNE + " SELECT dir, pruned FROM dec")
def dir_prune(spark: SparkSession, d: str) -> DataFrame:
    # One row a directory, used for the source and as what two targets have stored: trees are hashed once.
    src = written(diff.directory_hashes(lens.src_tree(spark, d)), "directories")
    return diff.prune_directories(src, _stored(src, diff.directory_hashes(lens.tgt_tree(spark, d))), lens.targets(spark))


@query("files_to_check", _PRUNE + " SELECT rel, size FROM src WHERE parent NOT IN (SELECT dir FROM dec WHERE pruned)")
def files_to_check(spark: SparkSession, d: str) -> DataFrame:
    pruned = diff.unprune_ancestors(dir_prune(spark, d))
    return diff.outside_pruned(lens.src_tree(spark, d).select("rel", "size"), pruned)


@query("unpruned_ancestors", """WITH dec AS (SELECT * FROM (VALUES ('a', true), ('a/b', true), ('a/b/c', false), ('a/d', true), ('e', true)) v(dir, pruned)),
bad AS (SELECT DISTINCT array_to_string(string_split(dir, '/')[1 : n], '/') AS dir FROM
  (SELECT dir, unnest(range(1, len(string_split(dir, '/')))) AS n FROM dec WHERE NOT pruned))
SELECT dir, pruned AND dir NOT IN (SELECT dir FROM bad) AS pruned FROM dec""")
def unpruned_ancestors(spark: SparkSession, d: str) -> DataFrame:
    rows = [("a", True), ("a/b", True), ("a/b/c", False), ("a/d", True), ("e", True)]
    return diff.unprune_ancestors(spark.createDataFrame(rows, "dir string, pruned boolean"))


# A lite hash's threshold is above any text here; queries over the tables take a smaller sample.
def _lite(content, size):
    return F.when(size >= 2048, F.sha2(F.concat(size.cast("string"), F.lit(":"), F.substring(content, 1, 1024), F.right(content, F.lit(1024))), 256))


_LITE = "CASE WHEN size >= 2048 THEN sha256(CAST(size AS VARCHAR) || ':' || substring(content, 1, 1024) || right(content, 1024)) END"


@query("lite_hash", f"WITH src AS ({SRC_SQL}) SELECT rel, {_LITE} AS lite, sha256(content) AS full_hash FROM src")
def lite_hash(spark: SparkSession, d: str) -> DataFrame:
    t = lens.src_tree(spark, d)
    return t.select("rel", _lite(F.col("content"), F.col("size")).alias("lite"), F.sha2("content", 256).alias("full_hash"))


_DECISION = TREES + f""", s AS (SELECT rel, size, mtime_sec, mtime_nsec, {_LITE} AS lite, sha256(content) AS root,
    CAST(string_split(name, '.')[1] AS BIGINT) AS id FROM src),
t AS (SELECT rel, size, mtime_sec, mtime_nsec, {_LITE} AS lite, sha256(content) AS root FROM tgt),
j AS (SELECT s.*, t.size AS t_size, t.mtime_sec AS t_sec, t.mtime_nsec AS t_nsec, t.lite AS t_lite, t.root AS t_root,
    id % 31 = 2 AS dirty, id % 37 <> 4 AS s_ok, id % 41 <> 5 AS t_ok, id % 5 <> 0 AS hashing, id % 3 = 1 AS has_sig,
    CASE WHEN id % 3 = 1 AND id % 2 = 1 THEN coalesce(t.root, s.root) END AS sig_root FROM s LEFT JOIN t ON s.rel = t.rel)
SELECT rel, CASE
  WHEN size = t_size AND mtime_sec = t_sec AND mtime_nsec = t_nsec THEN 'skip:stat'
  WHEN dirty THEN 'skip:dirty' WHEN NOT s_ok THEN 'sync:unreadable_source'
  WHEN has_sig AND t_size IS NULL THEN 'sync:missing'
  WHEN has_sig AND (CASE WHEN size <> size THEN false WHEN sig_root IS NOT NULL THEN root = sig_root ELSE true END) THEN 'skip:signature'
  WHEN t_size IS NULL OR NOT t_ok THEN 'sync:unreadable_target'
  WHEN NOT hashing AND size = t_size AND mtime_sec = t_sec THEN 'skip:coarse' WHEN NOT hashing THEN 'sync:coarse'
  WHEN lite <> t_lite THEN 'sync:lite_hash'
  WHEN sig_root IS NOT NULL AND root <> t_root THEN 'sync:merkle' WHEN sig_root IS NOT NULL THEN 'skip:merkle'
  WHEN NOT (size = t_size AND mtime_sec = t_sec) THEN 'sync:stat' ELSE 'skip:equal' END AS decision FROM j"""


@query("sync_decision", _DECISION)
def sync_decision(spark: SparkSession, d: str) -> DataFrame:
    digest = lambda t: t.select(
        "rel", "name", "size", "mtime_sec", "mtime_nsec", _lite(F.col("content"), F.col("size")).alias("lite"), F.sha2("content", 256).alias("root")
    )
    s, t = digest(lens.src_tree(spark, d)), digest(lens.tgt_tree(spark, d)).drop("name")
    t = t.select("rel", *(F.col(c).alias(f"t_{c}") for c in t.columns if c != "rel"))
    i = F.split("name", r"\.")[0].cast("long")
    both = s.join(t, "rel", "left").withColumns({
        "t_dirty": i % 31 == 2, "s_readable": i % 37 != 4, "t_readable": i % 41 != 5, "hashing": i % 5 != 0, "has_sig": i % 3 == 1,
        "sig_size": F.col("size"), "sig_mtime_sec": F.col("mtime_sec"), "sig_mtime_nsec": F.col("mtime_nsec"), "sig_hash": F.col("lite"),
        "sig_merkle_root": F.when((i % 3 == 1) & (i % 2 == 1), F.coalesce("t_root", "root")),
    })
    return both.select("rel", diff.sync_decision().alias("decision"))


_CAPS = """size, t_size, profile = 'nfs' AS nfs, size > 4096 AND size % 7 = 0 AS sparse, profile <> 'hdd' AS same_dev, size % 2 = 0 AS reflink,
  size % 3 = 0 AS copy_range, size % 5 = 0 AS nocow"""
_METHOD = """CASE WHEN size = t_size AND size > 262144 THEN 'delta' WHEN nfs AND NOT sparse AND size <= 16777216 THEN 'nfs_rpc'
  WHEN (same_dev OR nfs) AND size > 0 AND reflink THEN 'reflink' WHEN NOT sparse AND copy_range THEN 'copy_file_range'
  WHEN NOT sparse AND size <= 65536 THEN 'small' ELSE 'io_uring' END"""
# Sizes of the lens times 64, so that the plan meets all thresholds.
_PLAN = TREES + f""", targets AS ({TARGETS_SQL}), need AS (
  SELECT s.rel, s.size * 64 AS size, t.size * 64 AS t_size FROM src s LEFT JOIN tgt t ON s.rel = t.rel
  WHERE t.rel IS NULL OR s.size <> t.size OR s.mtime_sec <> t.mtime_sec OR s.mtime_nsec <> t.mtime_nsec),
caps AS (SELECT rel, target, tier, {_CAPS} FROM need CROSS JOIN targets),
plan AS (SELECT *, {_METHOD} AS method, CASE WHEN reflink AND same_dev AND NOT nocow AND size >= 4096 THEN 'reflink' ELSE 'copy' END AS copier FROM caps)"""


def _plan(spark: SparkSession, d: str) -> DataFrame:
    both = diff.with_target(lens.src_tree(spark, d).drop("content"), lens.tgt_tree(spark, d))
    need = both.filter(diff.needs_copy()).select("rel", (F.col("size") * 64).alias("size"), (F.col("t_size") * 64).alias("t_size"))
    s, profile = F.col("size"), F.col("profile")
    caps = strategy.fan_out(need, lens.targets(spark)).withColumns({
        "nfs": profile == "nfs", "sparse": (s > 4096) & (s % 7 == 0), "same_dev": profile != "hdd", "reflink": s % 2 == 0,
        "copy_range": s % 3 == 0, "nocow": s % 5 == 0,
    })
    return caps.withColumns({"method": strategy.copy_method(), "copier": strategy.inner_copier()})


@query("sync_plan", _PLAN + " SELECT rel, target, size, method, copier FROM plan ORDER BY size NULLS LAST, tier, rel, target")
def sync_plan(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d).orderBy(*strategy.plan_order()).select("rel", "target", "size", "method", "copier")


@query("sync_stats", _PLAN + " SELECT method, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM plan GROUP BY method")
def sync_stats(spark: SparkSession, d: str) -> DataFrame:
    return strategy.stats(_plan(spark, d))


@query("small_file_batches", _PLAN + """ SELECT target, CAST((row_number() OVER (PARTITION BY target ORDER BY size, rel) - 1) // 64 AS BIGINT) AS batch, rel FROM plan WHERE size <= 65536""")
def small_file_batches(spark: SparkSession, d: str) -> DataFrame:
    """Small jobs in batches of 64, smallest first, per target."""
    w = Window.partitionBy("target").orderBy("size", "rel")
    return _plan(spark, d).filter("size <= 65536").select("target", F.floor((F.row_number().over(w) - 1) / 64).alias("batch"), "rel")


@query("sync_plan_exit", _PLAN + """, t AS (SELECT count(*) AS methods, count(*) FILTER (method = 'io_uring') AS slow FROM plan)
SELECT CASE WHEN methods = 0 THEN 'up_to_date' WHEN slow = methods THEN 'slow_only' ELSE 'mixed' END AS status, methods FROM t""")
def sync_plan_exit(spark: SparkSession, d: str) -> DataFrame:
    t = _plan(spark, d).agg(F.count("*").alias("methods"), F.count_if(F.col("method") == "io_uring").alias("slow"))
    return t.select(F.when(F.col("methods") == 0, "up_to_date").when(F.col("slow") == F.col("methods"), "slow_only").otherwise("mixed").alias("status"), "methods")


@query("stale_delete_order", TREES + """ SELECT rel, len(string_split(rel, '/')) AS depth FROM tgt WHERE rel NOT IN (SELECT rel FROM src) ORDER BY depth DESC, rel DESC""")
def stale_delete_order(spark: SparkSession, d: str) -> DataFrame:
    """Children before parents."""
    gone = diff.stale(lens.src_tree(spark, d), lens.tgt_tree(spark, d).select("rel"))
    return gone.withColumn("depth", F.size(F.split("rel", "/")).cast("long")).orderBy(F.desc("depth"), F.desc("rel"))


@query("dirs_by_depth", f"""WITH src AS ({SRC_SQL}), d AS (SELECT DISTINCT array_to_string(string_split(rel, '/')[1 : n], '/') AS dir, n AS depth FROM
  (SELECT rel, unnest(range(1, len(string_split(rel, '/')))) AS n FROM src)) SELECT dir, depth FROM d ORDER BY depth, dir""")
def dirs_by_depth(spark: SparkSession, d: str) -> DataFrame:
    dirs = diff.with_ancestors(lens.src_tree(spark, d).select("rel"), "rel").select(F.col("ancestor").alias("dir")).distinct()
    return dirs.withColumn("depth", F.size(F.split("dir", "/")).cast("long")).orderBy("depth", "dir")


@query("union_sources", f"""WITH src AS ({SRC_SQL}), u AS (SELECT name AS rel, size, 0 AS o FROM src WHERE starts_with(rel, 'src1/')
  UNION ALL SELECT name, size + 1, 1 FROM src WHERE mtime_sec % 2 = 0) SELECT rel, arg_max(size, o) AS size, CAST(max(o) AS INTEGER) AS source_order FROM u GROUP BY rel""")
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    t = lens.src_tree(spark, d)
    one = t.filter(F.col("rel").startswith("src1/")).select(F.col("name").alias("rel"), "size")
    two = t.filter("mtime_sec % 2 = 0").select(F.col("name").alias("rel"), (F.col("size") + 1).alias("size"))
    return diff.one_owner_per_path([one, two])


# --- filters ------------------------------------------------------------------------------------


@query("filter_rules_oneshot", f"""WITH src AS ({SRC_SQL}) SELECT rel FROM src
WHERE NOT ((regexp_matches(rel, '^src1.*/en/.*$') OR regexp_matches(rel, '^.*7\\.txt$')) AND NOT regexp_matches(rel, '^src1/.*$'))""")
def filter_rules_oneshot(spark: SparkSession, d: str) -> DataFrame:
    return filters.keep_oneshot(lens.src_tree(spark, d).select("rel"), ["src1/*"], ["src1*/en/*", "*7.txt", "[bad"])


@query("filter_rules_daemon", f"""WITH src AS ({SRC_SQL}) SELECT rel FROM src
WHERE NOT regexp_matches(rel, 'src1.*/en') AND (regexp_matches(rel, '/en/') OR regexp_matches(rel, '5.\\.txt'))""")
def filter_rules_daemon(spark: SparkSession, d: str) -> DataFrame:
    return filters.keep_daemon(lens.src_tree(spark, d).select("rel"), ["/en/", "5?.txt"], ["src1*/en"])


_NAMES = [(".treeflow_x", None), ("a.tmp.1", None), ("b.swap_tmp", None), ("c.txt", ".treeflow"), ("d.txt", "e.txt"), ("x.tmp", None), ("", "y.tmp.z")]


@query("internal_traffic", """SELECT name, (starts_with(name, '.treeflow') OR contains(name, '.tmp.') OR ends_with(name, '.swap_tmp')
  OR coalesce(starts_with(new_name, '.treeflow') OR contains(new_name, '.tmp.') OR ends_with(new_name, '.swap_tmp'), false)) AS internal
FROM (VALUES ('.treeflow_x', NULL), ('a.tmp.1', NULL), ('b.swap_tmp', NULL), ('c.txt', '.treeflow'), ('d.txt', 'e.txt'), ('x.tmp', NULL), ('', 'y.tmp.z')) v(name, new_name)""")
def internal_traffic(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(_NAMES, "name string, new_name string").select("name", filters.is_internal("name", "new_name").alias("internal"))


@query("path_traversal_guard", """SELECT p, starts_with(p, '/') OR list_contains(string_split(p, '/'), '..') AS refused
FROM (VALUES ('a/b'), ('../x'), ('a/../b'), ('/etc'), ('a..b/c'), ('..'), ('')) v(p)""")
def path_traversal_guard(spark: SparkSession, d: str) -> DataFrame:
    rows = [("a/b",), ("../x",), ("a/../b",), ("/etc",), ("a..b/c",), ("..",), ("",)]
    return spark.createDataFrame(rows, "p string").select("p", filters.is_traversal("p").alias("refused"))


@query("sparse_files", f"""WITH src AS ({SRC_SQL}) SELECT rel, size > 4096 AND (size // 1500) * 512 < size // 2 AS sparse FROM src""")
def sparse_files(spark: SparkSession, d: str) -> DataFrame:
    t = lens.src_tree(spark, d).withColumn("blocks", F.floor(F.col("size") / 1500))
    return t.select("rel", filters.is_sparse("size", "blocks").alias("sparse"))


@query("zero_blocks", """SELECT id, length(replace(c, chr(0), '')) = 0 AS zero FROM (VALUES (1, ''), (2, chr(0) || chr(0)), (3, 'a' || chr(0)), (4, ' ')) v(id, c)""")
def zero_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = [(1, ""), (2, "\x00\x00"), (3, "a\x00"), (4, " ")]
    return spark.createDataFrame(rows, "id int, c string").select("id", filters.is_zero_block("c").alias("zero"))


@query("dir_metadata_equal", """SELECT id, uid IS NOT DISTINCT FROM t_uid AND gid IS NOT DISTINCT FROM t_gid AND mode IS NOT DISTINCT FROM t_mode
  AND mt IS NOT DISTINCT FROM t_mt AS same FROM (SELECT user_id AS uid, user_id % 3 AS gid, 493 AS mode, event_id AS mt, event_id AS id,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS t_uid, user_id % 3 AS t_gid, CASE WHEN event_id % 7 = 0 THEN 511 ELSE 493 END AS t_mode, event_id AS t_mt FROM events)""")
def dir_metadata_equal(spark: SparkSession, d: str) -> DataFrame:
    e = lens.read(spark, d, "events")
    meta = lambda uid, mode: F.struct(uid.alias("uid"), (F.col("user_id") % 3).alias("gid"), mode.alias("mode"), F.col("event_id").alias("mtime_sec"))
    a = meta(F.col("user_id"), F.lit(493))
    b = meta(F.when(F.col("event_id") % 5 != 0, F.col("user_id")), F.when(F.col("event_id") % 7 == 0, 511).otherwise(493))
    return e.select(F.col("event_id").alias("id"), a.alias("a"), b.alias("b")).select("id", filters.same_directory_metadata("a", "b").alias("same"))


@query("watched_devices", """SELECT event_id FROM events WHERE user_id % 4 IN (1, 2) AND event_id % 10 NOT IN (3, 7)""")
def watched_devices(spark: SparkSession, d: str) -> DataFrame:
    e = lens.read(spark, d, "events").select("event_id", (F.col("user_id") % 4).alias("dev_id"), (F.col("event_id") % 10).alias("pid"))
    devices, pids = spark.createDataFrame([(1,), (2,)], "dev_id long"), spark.createDataFrame([(3,), (7,)], "pid long")
    return filters.watched(e, devices, pids).select("event_id")


# --- recovery -----------------------------------------------------------------------------------

_JOURNAL = """, paused AS (SELECT rel FROM src WHERE size % 9 = 1), failed AS (SELECT rel FROM src WHERE size % 6 = 1),
journal AS (SELECT rel FROM paused UNION SELECT rel FROM failed), jd AS (
  SELECT array_to_string(string_split(rel, '/')[1 : len(string_split(rel, '/')) - 1], '/') AS dir, count(*) AS paths FROM journal GROUP BY 1)"""


def journal(spark: SparkSession, d: str) -> DataFrame:
    """Paths that changed while a target was away: the set union of paused events and failed copies."""
    t = lens.src_tree(spark, d)
    return t.filter("size % 9 = 1").select("rel", "parent").union(t.filter("size % 6 = 1").select("rel", "parent")).distinct()


@query("outage_journal", TREES + _JOURNAL + " SELECT dir, paths FROM jd")
def outage_journal(spark: SparkSession, d: str) -> DataFrame:
    return journal(spark, d).groupBy(F.col("parent").alias("dir")).agg(F.count("*").alias("paths"))


@query("targeted_recovery", TREES + _JOURNAL + """, f AS (SELECT src.* FROM src WHERE parent IN (SELECT dir FROM jd))
SELECT f.rel, CASE WHEN t.rel IS NULL THEN 'missing' ELSE 'changed' END AS reason FROM f LEFT JOIN tgt t ON f.rel = t.rel
WHERE t.rel IS NULL OR f.size <> t.size OR f.mtime_sec <> t.mtime_sec""")
def targeted_recovery(spark: SparkSession, d: str) -> DataFrame:
    """Files of journaled directories that the target lacks or has with another size or whole second."""
    dirs = journal(spark, d).select("parent").distinct()
    files = lens.src_tree(spark, d).drop("content").join(dirs, "parent", "left_semi")
    both = diff.with_target(files, lens.tgt_tree(spark, d)).filter(diff.needs_copy(nanoseconds=False))
    return both.select("rel", F.when(F.col("t_exists").isNull(), "missing").otherwise("changed").alias("reason"))


@query("hydration_choice", TREES + _JOURNAL + """ SELECT CASE WHEN count(*) = 0 OR count(*) > 100000 THEN 'full' ELSE 'targeted_then_full' END AS choice FROM journal""")
def hydration_choice(spark: SparkSession, d: str) -> DataFrame:
    n = F.count("*")
    return journal(spark, d).agg(F.when((n == 0) | (n > 100_000), "full").otherwise("targeted_then_full").alias("choice"))


@query("prescan_targets", TREES + " SELECT s.rel, t.size, t.mtime_sec FROM src s JOIN tgt t ON s.rel = t.rel")
def prescan_targets(spark: SparkSession, d: str) -> DataFrame:
    """Bulk attribute read: files that the target lacks are silently left out."""
    return lens.src_tree(spark, d).select("rel").join(lens.tgt_tree(spark, d).select("rel", "size", "mtime_sec"), "rel")


@query("tier_order", f"{TARGETS_SQL} ORDER BY tier, target")
def tier_order(spark: SparkSession, d: str) -> DataFrame:
    return lens.targets(spark).orderBy("tier", "target")


@query("job_timeout_floors", f"""WITH f AS ({dims.values_sql(dims.TIMEOUT_FLOORS, 'profile, stall, overall, postcopy')})
SELECT profile, x, CAST(greatest(stall, x) AS BIGINT) AS stall, CAST(greatest(overall, x) AS BIGINT) AS overall, CAST(greatest(postcopy, x) AS BIGINT) AS postcopy
FROM f, (VALUES (1), (45), (400)) v(x)""")
def job_timeout_floors(spark: SparkSession, d: str) -> DataFrame:
    floors = dims.table(spark, dims.TIMEOUT_FLOORS, "profile string, stall int, overall int, postcopy int")
    xs = spark.createDataFrame([(1,), (45,), (400,)], "x int")
    at_least = lambda c: F.greatest(c, "x").cast("long").alias(c)
    return floors.crossJoin(xs).select("profile", "x", at_least("stall"), at_least("overall"), at_least("postcopy"))


@query("signature_reuse", TREES + f""", targets AS ({TARGETS_SQL}), need AS (SELECT s.rel, sha256(s.content) AS root FROM src s LEFT JOIN tgt t ON s.rel = t.rel WHERE t.rel IS NULL)
SELECT rel, target, root, row_number() OVER (PARTITION BY rel ORDER BY tier, target) = 1 AS computes FROM need CROSS JOIN targets""")
def signature_reuse(spark: SparkSession, d: str) -> DataFrame:
    """A file's signature is computed once, before the fan-out; the fastest target counts as its owner."""
    need = diff.missing(lens.src_tree(spark, d), lens.tgt_tree(spark, d)).select("rel", F.sha2("content", 256).alias("root"))
    first = min(lens.TARGETS, key=lambda t: (dims.TIERS[lens.TARGETS[t]], t))
    return strategy.fan_out(need, lens.targets(spark)).select("rel", "target", "root", (F.col("target") == first).alias("computes"))


@query("memory_share", """WITH p AS (SELECT event_type AS label, event_id, CAST(floor(value * 1000) AS BIGINT) % 5000 AS pending,
  row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events),
m AS (SELECT *, CASE WHEN n = 1 THEN CASE WHEN pending > 2000 THEN 'yield' ELSE 'primary' END
  WHEN pending > 2200 THEN 'yield' WHEN pending <= 1800 THEN 'primary' END AS mark FROM p)
SELECT event_id, pending, last_value(mark IGNORE NULLS) OVER (PARTITION BY label ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS share FROM m""")
def memory_share(spark: SparkSession, d: str) -> DataFrame:
    p = lens.read(spark, d, "events").select(
        F.col("event_type").alias("label"), "event_id", (F.floor(F.col("value") * 1000).cast("long") % 5000).alias("pending")
    )
    return strategy.storm_label(p, "event_id", 2000).select("event_id", "pending", "share")


@query("merged_counters", _PLAN + """ SELECT target, sum(CASE WHEN method = 'reflink' THEN 1 ELSE 0 END)::BIGINT AS reflinked, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS files FROM plan GROUP BY ROLLUP (target)""")
def merged_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of each target and their merged total (target null)."""
    return _plan(spark, d).rollup("target").agg(
        F.count_if(F.col("method") == "reflink").alias("reflinked"), F.sum("size").cast("long").alias("bytes"), F.count("*").alias("files")
    )


@query("internal_excludes", """SELECT p FROM (VALUES ('.treeflow*'), ('*.tmp.*'), ('*.swap_tmp'), ('*.log')) v(p)""")
def internal_excludes(spark: SparkSession, d: str) -> DataFrame:
    """The engine's own patterns joined to the user's, each once."""
    own = [filters.INTERNAL_PREFIX + "*", f"*{filters.INTERNAL_PART}*", "*" + filters.INTERNAL_SUFFIX]
    arrays = spark.createDataFrame([(own, ["*.log", "*.swap_tmp"])], "own array<string>, users array<string>")
    return arrays.select(F.explode(F.array_union("own", "users")).alias("p"))


@query("signature_store", f"""WITH src AS ({SRC_SQL}) SELECT rel, size, mtime_sec, mtime_nsec, sha256(content) AS hash, CAST(4 AS INTEGER) AS version FROM src WHERE size >= 2048""")
def signature_store(spark: SparkSession, d: str) -> DataFrame:
    """Signatures kept as a table keyed by path, partitioned by version, and read back."""
    path = scratch(spark, "signatures")
    t = lens.src_tree(spark, d).filter("size >= 2048")
    t.select("rel", "size", "mtime_sec", "mtime_nsec", F.sha2("content", 256).alias("hash"), F.lit(4).alias("version")).write.partitionBy("version").parquet(path)
    return spark.read.parquet(path).select("rel", "size", "mtime_sec", "mtime_nsec", "hash", "version")
