"""Telemetry, tuner and benchmark-comparison queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeflow import dims, lens
from treeflow.functions import scalars
from treeflow.lens import TELEMETRY_SQL
from treeflow.operators import telemetry
from treeflow.registry import query

_T = f"WITH t AS ({TELEMETRY_SQL})"


@query("rolling_minmax", _T + """ SELECT event_id, min(latency_us) OVER w AS low, max(latency_us) OVER w AS high FROM t
WINDOW w AS (PARTITION BY label ORDER BY ts RANGE BETWEEN INTERVAL 3 DAYS PRECEDING AND CURRENT ROW)""")
def rolling_minmax(spark: SparkSession, d: str) -> DataFrame:
    """Three days in place of three seconds: the table's events are that far apart."""
    return telemetry.rolling(lens.telemetry(spark, d), "event_id", "latency_us", 3 * 86_400, "label")


@query("ewma_latency", _T + """ SELECT label || '/' || CAST(worker AS VARCHAR) AS key, max(event_id) AS event_id,
  round(list_reduce(list(CAST(latency_us AS DOUBLE) ORDER BY event_id), lambda a, x: 0.25 * x + 0.75 * a), 3) AS ewma FROM t GROUP BY 1""")
def ewma_latency(spark: SparkSession, d: str) -> DataFrame:
    """Where the smoothed latency of each label and worker ends."""
    t = telemetry.with_key(lens.telemetry(spark, d), "label", "worker")
    e = telemetry.ewma(t, "event_id", "latency_us", 0.25)
    return e.groupBy("key").agg(F.max("event_id").alias("event_id"), F.round(F.max_by("ewma", "event_id"), 3).alias("ewma"))


@query("rto_timeout", _T + """, f AS (SELECT label || '/' || CAST(worker AS VARCHAR) AS key, list_reduce(
  list_prepend({'m': 1000000::BIGINT, 'v': 500000::BIGINT, 'x': -1::BIGINT}, list({'m': 0::BIGINT, 'v': 0::BIGINT, 'x': CASE WHEN event_id % 53 = 0 THEN -2 ELSE latency_us * 10 END::BIGINT} ORDER BY event_id)),
  lambda a, r: CASE WHEN r.x = -2 THEN {'m': least(a.m * 2, 30000000), 'v': a.v * 2, 'x': 0::BIGINT}
    ELSE {'m': (a.m * 7 + r.x) // 8, 'v': (a.v * 3 + abs(r.x - a.m)) // 4, 'x': 0::BIGINT} END) AS s FROM t GROUP BY 1)
SELECT key, s.m AS mean_us, s.v AS deviation_us, least(greatest(s.m + 4 * s.v, 5000000), 60000000) AS timeout_us FROM f""")
def rto_timeout(spark: SparkSession, d: str) -> DataFrame:
    """Where mean, deviation and timeout end; every 53rd operation timed out."""
    t = telemetry.with_key(lens.telemetry(spark, d), "label", "worker")
    t = t.withColumn("sample", F.when(F.col("event_id") % 53 != 0, F.col("latency_us") * 10))
    f = telemetry.latency_timeouts(t, "event_id", "sample")
    last = lambda c: F.max_by(c, "event_id").alias(c)
    return f.groupBy("key").agg(last("mean_us"), last("deviation_us"), last("timeout_us"))


@query("throughput_samples")
def throughput_samples(spark: SparkSession, d: str) -> DataFrame:
    t = telemetry.with_key(lens.telemetry(spark, d), "label", "worker")
    return telemetry.rates(t.withColumn("us", F.col("latency_us") % 7000), "event_id", "us", "bytes")


@query("storage_class", _T + """ SELECT event_id, CASE WHEN r < 200 AND l > r * 6 AND l > 10000 THEN 'throttled_nvme' WHEN r < 200 THEN 'nvme' WHEN r > 5000 THEN 'hdd' ELSE 'sata_ssd' END AS class
FROM (SELECT event_id, latency_us % 9000 AS r, latency_us AS l FROM t)""")
def storage_class(spark: SparkSession, d: str) -> DataFrame:
    return lens.telemetry(spark, d).select("event_id", scalars.storage_class(F.col("latency_us") % 9000, F.col("latency_us")).alias("class"))


@query("adaptive_timeouts", f"""WITH c AS ({dims.values_sql(dims.CLASS_TIMEOUTS, 'class, sb, sr, om, pb, pr')}), r AS (SELECT * FROM (VALUES (0.0001), (0.004), (0.02), (0.5)) v(rtt)),
x AS (SELECT class, CAST(rtt AS DOUBLE) AS rtt, CAST(floor(greatest(10, least(sb + sr * CAST(rtt AS DOUBLE), 300))) AS BIGINT) AS stall, om, pb, pr FROM c, r)
SELECT class, rtt, stall, CAST(floor(greatest(stall * 3, least(rtt * 10, greatest(om, stall * 3)))) AS BIGINT) AS overall, CAST(floor(greatest(10, least(pb + pr * rtt, 600))) AS BIGINT) AS postcopy FROM x""")
def adaptive_timeouts(spark: SparkSession, d: str) -> DataFrame:
    c = dims.table(spark, dims.CLASS_TIMEOUTS, "class string, stall_base int, stall_rtt int, overall_max int, post_base int, post_rtt int")
    r = spark.createDataFrame([(0.0001,), (0.004,), (0.02,), (0.5,)], "rtt double")
    return c.crossJoin(r).withColumns(scalars.adaptive_timeouts(F.col("rtt"))).select("class", "rtt", "stall", "overall", "postcopy")


def _fed(spark: SparkSession, d: str) -> DataFrame:
    t = telemetry.with_key(lens.telemetry(spark, d), "label", "worker")
    return t.select(
        "key", "event_id", (F.col("event_id") * 0.05).alias("t"), "bytes", (F.col("latency_us") / 1e6).alias("took"), (F.col("latency_us") / 1e7).alias("latency"),
        (F.col("event_id") % 120 / 100.0).cast("double").alias("stress"), (F.col("event_id") % 200).alias("pending"),
    )


@query("bbr_states")
def bbr_states(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.tuner_states(_fed(spark, d))


@query("tuner_summary")
def tuner_summary(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.tuner_states(_fed(spark, d)).groupBy("key", "state").agg(F.count("*").alias("n"), F.max("batch").alias("batch"))


_O = "o AS (SELECT label, worker, max(latency_us) // 2000 AS batch, CASE WHEN max(latency_us) % 3 = 0 THEN 'probe' ELSE 'drain' END AS state, CAST(sum(bytes) AS BIGINT) AS bw FROM t GROUP BY label, worker)"


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    g = lens.telemetry(spark, d).groupBy("label", "worker").agg(F.max("latency_us").alias("m"), F.sum("bytes").cast("long").alias("bw"))
    return g.select("label", "worker", F.floor(F.col("m") / 2000).alias("batch"), F.when(F.col("m") % 3 == 0, "probe").otherwise("drain").alias("state"), "bw")


@query("worker_divergence", _T + f""", {_O} SELECT label, min(batch) AS low, max(batch) AS high, count(*) >= 2 AND max(batch) > 64 AND max(batch) > min(batch) * 2 AS diverges,
  count(*) >= 2 AND count(DISTINCT state) > 1 AS mixed FROM o GROUP BY label""")
def worker_divergence(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.divergence(_outputs(spark, d))


@query("cluster_max_bandwidth", _T + f", {_O}, m AS (SELECT *, max(bw) OVER (PARTITION BY label) AS best FROM o) SELECT label, worker, CASE WHEN bw < best / 2 THEN best / 2 ELSE CAST(bw AS DOUBLE) END AS effective FROM m")
def cluster_max_bandwidth(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.cluster_floor(_outputs(spark, d)).select("label", "worker", "effective")


@query("target_averages", _T + " SELECT label, count(DISTINCT worker) AS workers, CAST(sum(bytes) AS BIGINT) AS bytes, CASE WHEN count(*) = 0 THEN 0.0 ELSE round(CAST(sum(latency_us) AS DOUBLE) / count(*), 6) END AS latency_us FROM t GROUP BY label")
def target_averages(spark: SparkSession, d: str) -> DataFrame:
    return lens.telemetry(spark, d).groupBy("label").agg(
        F.countDistinct("worker").alias("workers"), F.sum("bytes").cast("long").alias("bytes"),
        F.round(F.coalesce(F.try_divide(F.sum("latency_us").cast("double"), F.count("*")), F.lit(0.0)), 6).alias("latency_us"),
    )


@query("failure_rate", """WITH r AS (SELECT user_id % 5 AS worker, event_id AS seq, event_id % 7 <> 0 AS ok, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) - 1 AS p FROM events)
SELECT worker, p // 101 AS block, count(*) FILTER (NOT ok) AS failed, count(*) AS n, CAST(count(*) FILTER (NOT ok) AS DOUBLE) / count(*) AS rate FROM r GROUP BY worker, p // 101""")
def failure_rate(spark: SparkSession, d: str) -> DataFrame:
    r = lens.read(spark, d, "events").select((F.col("user_id") % 5).alias("worker"), F.col("event_id").alias("seq"), (F.col("event_id") % 7 != 0).alias("ok"))
    return telemetry.failure_rates(r, 100)


@query("stress_score", """WITH s AS (SELECT event_id, 0.85 + (event_id % 20) / 100.0::DOUBLE AS mem, CASE WHEN event_id % 3 > 0 THEN (event_id % 41)::DOUBLE END AS io, (event_id % 90)::DOUBLE AS cpu, (event_id % 13)::DOUBLE AS load FROM events),
c AS (SELECT event_id, greatest(CASE WHEN mem > 0.9::DOUBLE THEN (mem - 0.9::DOUBLE) * 10 ELSE 0 END, CASE WHEN io IS NOT NULL THEN greatest(io / 25, cpu / 80) ELSE load / 8 END, 0) AS score FROM s)
SELECT event_id, round(score, 6) AS score, score >= 1 AS stressed, CASE WHEN score < 0.1 THEN 0 WHEN score < 0.8 THEN 10
  WHEN CAST(floor(least(pow(greatest(score - 0.8::DOUBLE, 0) * 100, 1.2), 500)) AS BIGINT) > 0 THEN CAST(floor(least(pow(greatest(score - 0.8::DOUBLE, 0) * 100, 1.2), 500)) AS BIGINT) ELSE 10 END AS pause_ms FROM c""")
def stress_score(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    s = lens.read(spark, d, "events").select(
        "event_id", (F.lit(0.85) + (i % 20) / 100.0).alias("mem"), F.when(i % 3 > 0, (i % 41).cast("double")).alias("io"), (i % 90).cast("double").alias("cpu"), (i % 13).cast("double").alias("load")
    )
    score = scalars.stress_score(F.col("mem"), F.col("io"), F.col("cpu"), F.col("load"), 25, 80, 8)
    s = s.withColumn("x", score)
    return s.select("event_id", F.round("x", 6).alias("score"), (F.col("x") >= 1).alias("stressed"), scalars.pacing_ms(F.col("x"), 10).alias("pause_ms"))


@query("latency_histogram", _T + """ SELECT label, count(*) FILTER (latency_us <= 10000) AS le_0, count(*) FILTER (latency_us <= 50000) AS le_1, count(*) FILTER (latency_us <= 90000) AS le_2,
  count(*) AS count, CAST(sum(latency_us) AS BIGINT) AS sum FROM t GROUP BY label""")
def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.histogram(lens.telemetry(spark, d), "latency_us", [10_000, 50_000, 90_000], "label")


@query("retry_schedule", """SELECT a AS attempt, CAST(least(50 * pow(2, a), 5000) AS BIGINT) AS retry_ms, CAST(pow(2, least(a, 6)) AS BIGINT) AS poison_s, CAST(least(100 * pow(2, a), 5000) + a % 100 AS BIGINT) AS hydrate_ms,
  CAST(sum(least(50 * pow(2, a), 5000)) OVER (ORDER BY a) AS BIGINT) AS next_attempt_ms FROM range(10) r(a)""")
def retry_schedule(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("id")
    rows = spark.range(10).select(a.alias("attempt"), scalars.retry_backoff_ms(a).alias("retry_ms"), scalars.poison_backoff_s(a).alias("poison_s"), scalars.hydration_backoff_ms(a, a % 100).alias("hydrate_ms"))
    return rows.withColumn("next_attempt_ms", F.sum("retry_ms").over(Window.orderBy("attempt")))


_B = """b AS (SELECT event_type AS workload, 'tool' || CAST(user_id % 3 AS VARCHAR) AS tool, CAST(sum(floor(value * 1000)) AS BIGINT) AS ms, CASE WHEN count(*) % 4 = 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM events GROUP BY 1, 2)"""


def _bench(spark: SparkSession, d: str) -> DataFrame:
    e = lens.read(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("workload"), F.concat(F.lit("tool"), (F.col("user_id") % 3).cast("string")).alias("tool")).agg(
        F.sum(F.floor(F.col("value") * 1000)).cast("long").alias("ms"), F.when(F.count("*") % 4 == 0, "FAIL").otherwise("PASS").alias("status")
    )


@query("benchmark_summary", f"""WITH {_B} SELECT workload, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status <> 'PASS') AS failed, arg_min(tool, row(ms, tool)) AS fastest,
  CAST(max(ms) AS DOUBLE) / min(ms) AS spread FROM b GROUP BY workload""")
def benchmark_summary(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.summary(_bench(spark, d))


@query("baseline_regressions", f"""WITH {_B}, c AS (SELECT workload || '/' || tool AS id, 1e9 / ms AS mbps, status FROM b), o AS (SELECT id, CASE WHEN length(id) % 2 = 0 THEN mbps * 1.25 ELSE mbps END AS base, CASE WHEN length(id) % 3 = 0 THEN 'PASS' ELSE status END AS bs FROM c),
j AS (SELECT c.*, base, bs FROM c JOIN o USING (id))
SELECT id, 'throughput' AS metric, base, mbps FROM j WHERE base > 0 AND mbps > 0 AND mbps / base < 0.9 UNION ALL SELECT id, 'status', base, mbps FROM j WHERE bs = 'PASS' AND status <> 'PASS'""")
def baseline_regressions(spark: SparkSession, d: str) -> DataFrame:
    c = _bench(spark, d).select(F.concat_ws("/", "workload", "tool").alias("id"), (F.lit(1e9) / F.col("ms")).alias("mbps"), "status")
    base = c.select("id", F.when(F.length("id") % 2 == 0, F.col("mbps") * 1.25).otherwise(F.col("mbps")).alias("mbps"), F.when(F.length("id") % 3 == 0, "PASS").otherwise(F.col("status")).alias("status"))
    return telemetry.regressions(c, base)


@query("metrics_text", _T + """ SELECT 'events_total{label="' || label || '"} ' || CAST(count(*) AS VARCHAR) AS line FROM t GROUP BY label""")
def metrics_text(spark: SparkSession, d: str) -> DataFrame:
    rows = lens.telemetry(spark, d).groupBy("label").agg(F.count("*").alias("value")).withColumn("name", F.lit("events_total"))
    return telemetry.metric_text(rows)


@query("status_json", _T + """ SELECT label, '{"events":' || CAST(count(*) AS VARCHAR) || ',"last":' || CAST(max(event_id) AS VARCHAR) || '}' AS status FROM t GROUP BY label""")
def status_json(spark: SparkSession, d: str) -> DataFrame:
    rows = lens.telemetry(spark, d).groupBy("label").agg(F.count("*").alias("events"), F.max("event_id").alias("last"))
    return telemetry.status_json(rows, "label", ["events", "last"])
