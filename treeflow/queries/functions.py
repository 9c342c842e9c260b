"""Scalar-function queries over literal values and table columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeflow import lens
from treeflow.functions import scalars
from treeflow.lens import SNAPS_SQL, SRC_SQL
from treeflow.registry import query

_DURATIONS = ["30d", "2w", "90m", "15s", "4h", "5", "x", "", "1.5h", "7D"]
_SIZES = ["50G", "10k", "3m", "1T", "10", "50g", "", "K", "2KB"]
_values = lambda xs: ", ".join(f"('{x}')" for x in xs)


@query("fn_duration", f"""SELECT x, CASE WHEN regexp_matches(x, '^[0-9]+[smhdw]$') THEN CAST(substring(x, 1, length(x) - 1) AS BIGINT) * CASE right(x, 1) WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 ELSE 604800 END END AS seconds
FROM (VALUES {_values(_DURATIONS)}) v(x)""")
def fn_duration(spark: SparkSession, d: str) -> DataFrame:
    """Units are lower case; anything else has no value."""
    rows = spark.createDataFrame([(x,) for x in _DURATIONS], "x string")
    return rows.select("x", scalars.duration_seconds("x").alias("seconds"))


@query("fn_size", f"""SELECT x, CASE WHEN regexp_matches(x, '^[0-9]+[kKmMgGtT]$') THEN CAST(substring(x, 1, length(x) - 1) AS BIGINT) * CASE upper(right(x, 1)) WHEN 'K' THEN 1024 WHEN 'M' THEN 1048576 WHEN 'G' THEN 1073741824 ELSE 1099511627776 END END AS bytes
FROM (VALUES {_values(_SIZES)}) v(x)""")
def fn_size(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in _SIZES], "x string").select("x", scalars.size_bytes("x").alias("bytes"))


_NUMBERS = [0, 1, 1023, 1024, 1536, 1048576, 5_000_000, 1 << 30, 3 << 40]


@query("fn_human_size", f"""SELECT x, CASE WHEN x >= 1099511627776 THEN format('{{:.2f}} TiB', x / 1099511627776) WHEN x >= 1073741824 THEN format('{{:.2f}} GiB', x / 1073741824) WHEN x >= 1048576 THEN format('{{:.2f}} MiB', x / 1048576)
  WHEN x >= 1024 THEN format('{{:.2f}} KiB', x / 1024) ELSE CAST(x AS VARCHAR) || ' B' END AS long_form, CASE WHEN x >= 1073741824 THEN format('{{:.1f}}G', x / 1073741824) WHEN x >= 1048576 THEN format('{{:.1f}}M', x / 1048576)
  WHEN x >= 1024 THEN format('{{:.1f}}K', x / 1024) ELSE CAST(x AS VARCHAR) || 'B' END AS short_form FROM (SELECT CAST(x AS BIGINT) AS x FROM (VALUES {', '.join(f'({n})' for n in _NUMBERS)}) v(x))""")
def fn_human_size(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(n,) for n in _NUMBERS], "x long")
    return rows.select("x", scalars.human_size("x").alias("long_form"), scalars.human_size_short("x").alias("short_form"))


@query("fn_timestamps", f"""WITH s AS ({SNAPS_SQL}), i AS (SELECT ts, substring(ts, 1, 13) || ':' || substring(ts, 14, 2) || ':' || substring(ts, 16, 2) || 'Z' AS iso FROM s)
SELECT ts, iso, replace(replace(iso, 'Z', ''), ':', '') AS back, epoch(strptime(ts, '%Y-%m-%dT%H%M%S'))::BIGINT AS seconds FROM i""")
def fn_timestamps(spark: SparkSession, d: str) -> DataFrame:
    s = lens.snaps(spark, d).select("ts", scalars.iso_of("ts").alias("iso"))
    return s.select("ts", "iso", scalars.name_of_iso("iso").alias("back"), F.unix_timestamp(scalars.snapshot_time("ts").cast("timestamp")).cast("long").alias("seconds"))


@query("fn_paths", f"""WITH src AS ({SRC_SQL}) SELECT rel, array_to_string(string_split(rel, '/')[1 : len(string_split(rel, '/')) - 1], '/') AS parent, CAST(len(string_split(rel, '/')) AS INTEGER) AS depth,
  CASE WHEN starts_with(rel, 'src1/') THEN substring(rel, 6) END AS stripped, rel = 'src2' OR starts_with(rel, 'src2/') AS below FROM src""")
def fn_paths(spark: SparkSession, d: str) -> DataFrame:
    t = lens.src_tree(spark, d)
    return t.select("rel", scalars.parent_of("rel").alias("parent"), F.size(F.split("rel", "/")).alias("depth"), scalars.stripped("rel", "src1").alias("stripped"), scalars.is_below("rel", "src2").alias("below"))


@query("url_parts", r"""SELECT page_id, regexp_extract(url, '^(https?)://([^/?#]+)', 1) AS scheme, regexp_extract(url, '^(https?)://([^/?#]+)', 2) AS host, regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) AS path FROM pages""")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    part = lambda p, i: F.regexp_extract("url", p, i)
    return lens.read(spark, d, "pages").select("page_id", part("^(https?)://([^/?#]+)", 1).alias("scheme"), part("^(https?)://([^/?#]+)", 2).alias("host"), part("^https?://[^/?#]+(/[^?#]*)", 1).alias("path"))


@query("fn_flags", """SELECT event_id, (event_id & 2) <> 0 AS exchange, ((event_id * 4096) & 61440) = 16384 AS is_dir FROM events""")
def fn_flags(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return lens.read(spark, d, "events").select("event_id", (i.bitwiseAND(F.lit(2)) != 0).alias("exchange"), ((i * 4096).bitwiseAND(F.lit(0o170000)) == 0o040000).alias("is_dir"))


@query("fn_copy_timeout", f"""WITH src AS ({SRC_SQL}) SELECT rel, CAST(least(60 + 60 * greatest(1, size * 16384 // 10485760), 300) AS BIGINT) AS seconds FROM src""")
def fn_copy_timeout(spark: SparkSession, d: str) -> DataFrame:
    return lens.src_tree(spark, d).select("rel", scalars.copy_timeout_s(F.col("size") * 16384).alias("seconds"))


@query("fn_progress", """SELECT event_id, CASE WHEN user_id % 4 > 0 THEN round(event_id / (user_id % 4), 6) END AS per_second, CASE WHEN event_id > 0 THEN (100000 - event_id) * (user_id % 4) // event_id END AS eta_s,
  event_id * 0.004::DOUBLE / 64 AS load FROM events""")
def fn_progress(spark: SparkSession, d: str) -> DataFrame:
    n, s = F.col("event_id"), F.col("user_id").cast("long") % 4
    e = lens.read(spark, d, "events")
    return e.select("event_id", scalars.rounded(scalars.throughput(n, s), 6).alias("per_second"), scalars.eta_s(n, F.lit(100_000).cast("long"), s).alias("eta_s"), scalars.reynolds(n, F.lit(0.004), F.lit(64)).alias("load"))


@query("fn_hex_json", """SELECT event_id, lower(hex(encode(event_type))) AS hex, decode(unhex(hex(encode(event_type)))) AS back, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def fn_hex_json(spark: SparkSession, d: str) -> DataFrame:
    e = lens.read(spark, d, "events")
    parsed = F.from_json("props", "k bigint")
    return e.select("event_id", F.lower(F.hex(F.col("event_type").cast("binary"))).alias("hex"), F.decode(F.unhex(F.hex(F.col("event_type").cast("binary"))), "UTF-8").alias("back"), parsed["k"].alias("k"))


@query("fn_partial_hash", f"""WITH src AS ({SRC_SQL}) SELECT rel, sha256(CAST(size AS VARCHAR) || ':' || substring(content, 1, 512) || right(content, 512)) AS sample FROM src""")
def fn_partial_hash(spark: SparkSession, d: str) -> DataFrame:
    """Digest of length, head and tail: enough to tell versions apart."""
    t = lens.src_tree(spark, d)
    return t.select("rel", F.sha2(F.concat(F.col("size").cast("string"), F.lit(":"), F.substring("content", 1, 512), F.right("content", F.lit(512))), 256).alias("sample"))
