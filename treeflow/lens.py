"""The driver's tables seen as file trees, change events, snapshots, versions and telemetry.

Every lens exists twice: as a DataFrame, and as SQL (a CTE body) for the DuckDB twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeflow import dims

EPOCH = 1_704_067_200


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- file trees ---------------------------------------------------------------------------------


def _file(df: DataFrame, rel, content, mtime, ident) -> DataFrame:
    parts = F.split(rel, "/")
    return df.select(
        rel.alias("rel"),
        F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("parent"),
        F.element_at(parts, -1).alias("name"),
        F.octet_length(content).cast("long").alias("size"),
        mtime.cast("long").alias("mtime_sec"),
        (ident * 7919 % 1_000_000_000).cast("long").alias("mtime_nsec"),
        content.alias("content"),
    )


def src_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    rel = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return _file(d, rel, F.col("text"), F.lit(EPOCH) + 60 * F.col("doc_id"), F.col("doc_id"))


def tgt_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").filter("doc_id % 17 <> 0")
    rel = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    middle = F.expr("concat(substring(text, 1, length(text) div 2), '#', substring(text, length(text) div 2 + 2, length(text)))")
    content = F.when(F.col("doc_id") % 10 == 3, middle).otherwise(F.col("text"))
    mtime = F.lit(EPOCH) + 60 * F.col("doc_id") + F.when(F.col("doc_id") % 23 == 5, 3600).otherwise(0)
    kept = _file(d, rel, content, mtime, F.col("doc_id"))
    p = read(spark, sf_dir, "pages")
    extra = F.concat(F.lit("extra/"), F.col("page_id").cast("string"), F.lit(".html"))
    return kept.unionByName(_file(p, extra, F.col("html"), F.lit(EPOCH) + F.col("page_id"), F.col("page_id")))


_FILE_SQL = """SELECT rel, array_to_string(string_split(rel, '/')[1 : len(string_split(rel, '/')) - 1], '/') AS parent,
  string_split(rel, '/')[-1] AS name, CAST(strlen(content) AS BIGINT) AS size, CAST(mtime AS BIGINT) AS mtime_sec,
  CAST(ident * 7919 % 1000000000 AS BIGINT) AS mtime_nsec, content FROM ({})"""
_DOC_REL = "source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt'"
SRC_SQL = _FILE_SQL.format(f"SELECT {_DOC_REL} AS rel, text AS content, {EPOCH} + 60 * doc_id AS mtime, doc_id AS ident FROM documents")
TGT_SQL = _FILE_SQL.format(
    f"""SELECT {_DOC_REL} AS rel, CASE WHEN doc_id % 10 = 3 THEN substring(text, 1, length(text) // 2) || '#' ||
      substring(text, length(text) // 2 + 2) ELSE text END AS content,
      {EPOCH} + 60 * doc_id + CASE WHEN doc_id % 23 = 5 THEN 3600 ELSE 0 END AS mtime, doc_id AS ident FROM documents WHERE doc_id % 17 <> 0
    UNION ALL SELECT 'extra/' || CAST(page_id AS VARCHAR) || '.html', html, {EPOCH} + page_id, page_id FROM pages"""
)
TREES = f"WITH src AS ({SRC_SQL}), tgt AS ({TGT_SQL})"

# Three targets (name, profile).
TARGETS = {"t_nvme": "nvme", "t_hdd": "hdd", "t_nfs": "nfs"}


def targets(spark: SparkSession) -> DataFrame:
    rows = {k: (v, dims.TIERS[v]) for k, v in TARGETS.items()}
    return dims.table(spark, rows, "target string, profile string, tier int")


TARGETS_SQL = dims.values_sql({k: (v, dims.TIERS[v]) for k, v in TARGETS.items()}, "target, profile, tier")


# --- change events ------------------------------------------------------------------------------

# Which change an event of the table stands for.
CHANGE_OF = {"signup": 8, "view": 13, "click": 2, "purchase": 7, "error": 9}


def chg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes: (seq, domain, inode, name, etype, off, len, ts)."""
    e = read(spark, sf_dir, "events")
    code = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in CHANGE_OF.items()), F.lit(0))
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        (F.col("event_id") + 1).alias("seq"),
        F.lit(0).cast("long").alias("domain"),
        F.col("user_id").cast("long").alias("inode"),
        F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("name"),
        code.cast("int").alias("etype"),
        (k * 4096).alias("off"),
        F.floor("value").cast("long").alias("len"),
        "ts",
    )


CHG_SQL = f"""SELECT event_id + 1 AS seq, CAST(0 AS BIGINT) AS domain, CAST(user_id AS BIGINT) AS inode,
  'f' || CAST(user_id AS VARCHAR) AS name,
  CAST(CASE event_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in CHANGE_OF.items())} ELSE 0 END AS INTEGER) AS etype,
  CAST(json_extract_string(props, '$.k') AS BIGINT) * 4096 AS off, CAST(floor(value) AS BIGINT) AS len, ts FROM events"""


def chg_gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes with every 97th and one block of sequence numbers lost."""
    c = chg(spark, sf_dir)
    n = c.agg(F.count("*").alias("n"))
    return (
        c.crossJoin(F.broadcast(n))  # one row
        .filter("seq % 97 <> 0 AND NOT (seq BETWEEN n div 4 AND n div 4 + greatest(50, n div 5))")
        .drop("n")
    )


GAPPY_SQL = f"""SELECT c.* FROM ({CHG_SQL}) c, (SELECT count(*) AS n FROM events) WHERE seq % 97 <> 0
  AND NOT (seq BETWEEN n // 4 AND n // 4 + greatest(50, n // 5))"""


def chg_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gappy changes with their place of arrival, a little out of order."""
    return chg_gappy(spark, sf_dir).withColumn("arrival", F.expr("(seq + (seq * 7919) % 13) * 100000000 + seq"))


SHUFFLED_SQL = f"SELECT *, (seq + (seq * 7919) % 13) * 100000000 + seq AS arrival FROM ({GAPPY_SQL})"


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes of order lines to their order's file, every fourth lost: (inode, name, seq, off, len)."""
    order = [
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus",
    ]
    w = Window.partitionBy("l_orderkey").orderBy(*order)
    rows = read(spark, sf_dir, "lineitem").withColumns({
        "seq": F.row_number().over(w).cast("long"),
        "len": F.col("l_quantity").cast("long"),
        "off": F.coalesce(F.sum(F.col("l_quantity").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    return rows.filter("seq % 4 <> 3").select(
        F.col("l_orderkey").cast("long").alias("inode"),
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("name"),
        "seq", F.col("off").cast("long").alias("off"), "len",
    )


_WR_ORDER = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus"
WRITES_SQL = f"""SELECT * FROM (SELECT CAST(l_orderkey AS BIGINT) AS inode, 'o' || CAST(l_orderkey AS VARCHAR) AS name,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY {_WR_ORDER}) AS seq,
  CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY {_WR_ORDER}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off,
  CAST(l_quantity AS BIGINT) AS len FROM lineitem) WHERE seq % 4 <> 3"""


# --- snapshots and versions ---------------------------------------------------------------------


def snaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot a month: (ts, tag, files, size_bytes, disk_usage_bytes)."""
    o = read(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    month = F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM-dd'T'HHmmss")
    return (
        o.groupBy(month.alias("ts"))
        .agg(
            F.count("*").alias("files"), F.sum(cents).alias("size_bytes"),
            F.coalesce(F.sum(F.when(F.col("o_orderstatus") != "F", cents)), F.lit(0)).cast("long").alias("disk_usage_bytes"),
        )
        .withColumn("tag", F.when(F.substring("ts", 6, 2) == "01", F.concat(F.lit("y"), F.substring("ts", 1, 4))))
        .select("ts", "tag", "files", "size_bytes", "disk_usage_bytes")
    )


SNAPS_SQL = """SELECT ts, CASE WHEN substring(ts, 6, 2) = '01' THEN 'y' || substring(ts, 1, 4) END AS tag, files, size_bytes, disk_usage_bytes
  FROM (SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%dT%H%M%S') AS ts, count(*) AS files,
    CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS size_bytes,
    CAST(coalesce(sum(CASE WHEN o_orderstatus <> 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) END), 0) AS BIGINT) AS disk_usage_bytes
    FROM orders GROUP BY 1)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of a customer's file: (inode, epoch_seq, timestamp, size, mtime, path)."""
    o = read(spark, sf_dir, "orders")
    t = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("long")
    return o.select(
        F.col("o_custkey").cast("long").alias("inode"), F.col("o_orderkey").cast("long").alias("epoch_seq"), t.alias("timestamp"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("size"), (t - t % 86400).alias("mtime"),
        F.concat_ws("_", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), t.cast("string")).alias("path"),
    )


VERSIONS_SQL = """SELECT CAST(o_custkey AS BIGINT) AS inode, CAST(o_orderkey AS BIGINT) AS epoch_seq, t AS timestamp,
  CAST(round(o_totalprice * 100) AS BIGINT) AS size, t - t % 86400 AS mtime,
  CAST(o_custkey AS VARCHAR) || '_' || CAST(o_orderkey AS VARCHAR) || '_' || CAST(t AS VARCHAR) AS path
  FROM (SELECT *, CAST(epoch(o_orderdate) AS BIGINT) AS t FROM orders)"""


# --- telemetry ----------------------------------------------------------------------------------


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples: (event_id, ts, label, worker, latency_us, bytes), latency in whole microseconds."""
    return read(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("event_type").alias("label"), (F.col("user_id") % 4).cast("int").alias("worker"),
        F.floor(F.col("value") * 1000).cast("long").alias("latency_us"),
        (F.get_json_object("props", "$.k").cast("long") * 4096).alias("bytes"),
    )


TELEMETRY_SQL = """SELECT event_id, ts, event_type AS label, CAST(user_id % 4 AS INTEGER) AS worker,
  CAST(floor(value * 1000) AS BIGINT) AS latency_us, CAST(json_extract_string(props, '$.k') AS BIGINT) * 4096 AS bytes FROM events"""
