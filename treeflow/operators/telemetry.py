"""Telemetry analytics: rolling extremes, smoothing, timeouts, tuner states, divergence, regressions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeflow.operators.coalesce import folded

_L, _D, _S = pa.int64(), pa.float64(), pa.string()


def rolling(samples: DataFrame, ident: str, value: str, seconds: int, *keys: str) -> DataFrame:
    """(ident, low, high): least and largest value of the interval up to and including each sample (peers in time included).

    Time is cut into slices as long as the interval, so an interval is the front of its sample's slice and the
    end of the slice before: two running extremes, whose windows are a key's slice, and no frame is scanned anew
    for a row. ``ident`` tells samples apart.
    """
    at, most = F.unix_micros(F.col("ts").cast("timestamp")), seconds * 1_000_000
    rows = samples.select(*keys, F.col(ident).alias("_id"), F.col(value).alias("_v"), at.alias("_at"), F.floor(at / most).alias("_slice"))
    # Every sample also asks the slice before its own for what it has from there on.
    asked = rows.select(*keys, "_id", F.lit(None).cast(rows.schema["_v"].dataType).alias("_v"), (F.col("_at") - most).alias("_at"), (F.col("_slice") - 1).alias("_slice"), F.lit(True).alias("_asks"))
    both = rows.withColumn("_asks", F.lit(False)).unionByName(asked)
    slices = Window.partitionBy(*keys, "_slice")
    front, end = (slices.orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.col("_at"), F.col("_at").desc()))
    pick = lambda f: F.when(F.col("_asks"), f("_v").over(end)).otherwise(f("_v").over(front))
    found = both.select("_id", pick(F.min).alias("low"), pick(F.max).alias("high"))
    return found.groupBy(F.col("_id").alias(ident)).agg(F.min("low").alias("low"), F.max("high").alias("high"))


def with_key(df: DataFrame, *keys: str) -> DataFrame:
    return df.withColumn("key", F.concat_ws("/", *keys))


def ewma(samples: DataFrame, order: str, value: str, alpha: float) -> DataFrame:
    """Every sample of a key with its exponentially weighted mean; the first sample starts it."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        mean = None
        for key, at, x in rows:
            mean = x if mean is None else alpha * x + (1 - alpha) * mean
            yield key, at, mean

    rows = samples.withColumn(value, F.col(value).cast("double"))
    return folded(rows, "key", order, [order, value], fold, pa.schema([("key", _S), (order, _L), ("ewma", _D)]), f"key string, {order} long, ewma double")


def latency_timeouts(samples: DataFrame, order: str, value: str) -> DataFrame:
    """Smoothed latency, deviation and timeout (us) after each sample of a key, in whole numbers.

    A sample of null is a timeout: it doubles both, the mean up to 30 s. The deviation uses the mean from
    before the sample. Starts at 1 s and 0.5 s; the timeout is mean + 4 deviations within 5 to 60 s.
    """

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        mean, deviation = 1_000_000, 500_000
        for key, at, x in rows:
            if x is None:
                mean, deviation = min(mean * 2, 30_000_000), deviation * 2
            else:
                deviation, mean = (deviation * 3 + abs(x - mean)) // 4, (mean * 7 + x) // 8
            yield key, at, mean, deviation, min(max(mean + 4 * deviation, 5_000_000), 60_000_000)

    schema = pa.schema([("key", _S), (order, _L), ("mean_us", _L), ("deviation_us", _L), ("timeout_us", _L)])
    return folded(samples, "key", order, [order, value], fold, schema, f"key string, {order} long, mean_us long, deviation_us long, timeout_us long")


def rates(samples: DataFrame, order: str, us: str, size: str) -> DataFrame:
    """Committed throughput samples: after 10 ms, or after 0.5 ms once there are bytes."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        took = total = 0
        for key, at, t, n in rows:
            took, total = took + t, total + n
            if took >= 10_000 or (n > 0 and took > 500):
                yield key, at, took, total
                took = total = 0

    schema = pa.schema([("key", _S), (order, _L), ("took_us", _L), ("bytes", _L)])
    return folded(samples, "key", order, [order, us, size], fold, schema, f"key string, {order} long, took_us long, bytes long")


class Tuner:
    """The bandwidth-delay state machine of one worker, fed one telemetry row at a time.

    startup -> drain -> probe, back to drain every six seconds; muted while stressed. Time is a column.
    """

    # Gains on the bandwidth-delay product.
    GAIN = {"startup": 2.0, "drain": 0.5, "probe": 1.5, "muted": 0.75}

    def __init__(self, batch: int = 8, least: int = 1, most: int = 64):
        self.state, self.changed, self.cycle, self.seen = "startup", None, None, None
        self.bandwidth: list[tuple[float, float]] = []
        self.round_trip: list[tuple[float, float]] = []
        self.smooth_bw = self.smooth_rtt = self.short = None
        self.batch, self.least, self.most, self.last_rtt = batch, least, most, 0.000001

    def _to(self, state: str, now: float) -> bool:
        wait = 0.0 if state == "muted" else 0.5
        if state == self.state or now - self.changed < wait:
            return False
        self.state, self.changed = state, now
        return True

    @staticmethod
    def _smooth(mean, x, alpha):
        return x if mean is None else alpha * x + (1 - alpha) * mean

    def step(self, now: float, size: int, took: float, latency: float, stress: float, pending: int, chunk: int = 4096) -> tuple:
        if self.cycle is None:
            self.changed = self.cycle = self.seen = now
        if size > 0 and took > 0:
            self.bandwidth.append((now, size / took))
            self.seen = now
        self.bandwidth = [x for x in self.bandwidth if now - x[0] <= 3][-1000:]
        if now - self.seen > 30 and self.state != "startup" and not pending and self._to("startup", now):
            self.bandwidth, self.round_trip = [], []
        if latency > 0:
            self.round_trip.append((now, latency))
            self.short = self._smooth(self.short, latency, 0.3)
        self.round_trip = [x for x in self.round_trip if now - x[0] <= 3][-1000:]
        best = max((x for _, x in self.bandwidth), default=1_000_000.0)
        self.last_rtt = min((x for _, x in self.round_trip), default=self.last_rtt)
        self.smooth_bw = self._smooth(self.smooth_bw, best, 0.25)
        self.smooth_rtt = self._smooth(self.smooth_rtt, self.last_rtt, 0.25)
        spiking = (self.short or 0) > self.last_rtt * 4 and (self.short or 0) > 0.005
        if stress >= 1.0:
            self._to("muted", now)
        elif stress > 0.8:
            if self.state == "probe":
                self._to("drain", now)
        elif spiking:
            if self.state != "muted" and self._to("drain", now):
                self.cycle = now
        elif self.state == "startup":
            enough = len(self.bandwidth) >= 3
            if (enough and (now - self.cycle > 2 or pending > max(100, 2 * self.most))) or now - self.cycle > 6:
                if self._to("drain", now):
                    self.cycle = now
        elif self.state == "drain":
            if stress < 0.6 and (pending < 2 or now - self.cycle > 1) and self._to("probe", now):
                self.cycle = now
        elif now - self.cycle > 6:
            if self._to("drain", now):
                self.cycle = now
        elif stress < 0.6 and self.state == "muted":
            self._to("probe", now)
        product = max(self.smooth_bw * self.smooth_rtt, chunk * 2.0)
        gain = self.GAIN[self.state] * (0.5 if spiking else 1.0)
        if stress > 0.8:
            gain *= 1 - min(1.0, (stress - 0.8) / 0.2) * 0.5
        target = int(product * gain)
        alpha = 0.5 if spiking else 0.2
        self.batch = min(max(int(self.batch * (1 - alpha) + target // chunk * alpha), self.least), self.most)
        factor = 8.0 if self.state == "muted" else 1.5
        flush = min(max(int(max(self.smooth_rtt * 1e6 * factor, 50.0)), 50), 5_000_000)
        return self.state, self.batch, target, flush


def tuner_states(samples: DataFrame, order: str = "event_id") -> DataFrame:
    """State, batch, target bytes in flight and flush interval after each telemetry row of a worker."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        tuner = Tuner()
        for key, at, t, size, took, latency, stress, pending in rows:
            yield (key, at, *tuner.step(t, size, took, latency, stress, pending))

    schema = pa.schema([("key", _S), (order, _L), ("state", _S), ("batch", _L), ("target_bytes", _L), ("flush_us", _L)])
    columns = [order, "t", "bytes", "took", "latency", "stress", "pending"]
    return folded(samples, "key", order, columns, fold, schema, f"key string, {order} long, state string, batch long, target_bytes long, flush_us long")


def divergence(outputs: DataFrame) -> DataFrame:
    """Targets whose workers' batch sizes differ too much: over 64 and over twice the least."""
    g = outputs.groupBy("label").agg(
        F.count("*").alias("workers"), F.min("batch").alias("low"), F.max("batch").alias("high"), F.countDistinct("state").alias("states")
    )
    diverges = (F.col("workers") >= 2) & (F.col("high") > 64) & (F.col("high") > F.col("low") * 2)
    return g.select("label", "low", "high", diverges.alias("diverges"), ((F.col("workers") >= 2) & (F.col("states") > 1)).alias("mixed"))


def cluster_floor(outputs: DataFrame) -> DataFrame:
    """A worker's bandwidth is at least half of the best of its peers at the same path."""
    best = F.max("bw").over(Window.partitionBy("label"))
    return outputs.withColumn("effective", F.when(F.col("bw") < best / 2, best / 2).otherwise(F.col("bw").cast("double")))


def failure_rates(results: DataFrame, window: int = 1000) -> DataFrame:
    """Share of failures in each block of operations of a worker; counts start anew after a block."""
    place = F.row_number().over(Window.partitionBy("worker").orderBy("seq")) - 1
    block = results.withColumn("block", F.floor(place / (window + 1)).cast("long"))
    return block.groupBy("worker", "block").agg(F.count_if(~F.col("ok")).alias("failed"), F.count("*").alias("n")).withColumn("rate", F.col("failed") / F.col("n"))


def histogram(samples: DataFrame, value: str, bounds: list[float], *keys: str) -> DataFrame:
    """Cumulative bucket counts as a metrics endpoint shows them, with count and sum."""
    upto = [F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]
    return samples.groupBy(*keys).agg(*upto, F.count("*").alias("count"), F.sum(value).cast("long").alias("sum"))


def regressions(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Tests whose throughput fell below nine tenths, or that passed before and don't now."""
    both = current.join(baseline.select("id", F.col("mbps").alias("base"), F.col("status").alias("base_status")), "id")
    slower = (F.col("base") > 0) & (F.col("mbps") > 0) & (F.col("mbps") / F.col("base") < 0.9)
    broke = (F.col("base_status") == "PASS") & (F.col("status") != "PASS")
    found = F.array_compact(F.array(F.when(slower, F.lit("throughput")), F.when(broke, F.lit("status"))))
    return both.select("id", F.explode(found).alias("metric"), "base", "mbps")


def summary(tests: DataFrame) -> DataFrame:
    """Per workload: passed, failed, the fastest tool and how many times the slowest takes."""
    return tests.groupBy("workload").agg(
        F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") != "PASS").alias("failed"),
        F.min_by("tool", F.struct("ms", "tool")).alias("fastest"), (F.max("ms") / F.min("ms")).alias("spread"),
    )


def metric_text(rows: DataFrame) -> DataFrame:
    """Lines of a metrics endpoint: (name, label, value) as ``name{label="x"} value``."""
    return rows.select(F.concat(F.col("name"), F.lit('{label="'), F.col("label"), F.lit('"} '), F.col("value").cast("string")).alias("line"))


def status_json(rows: DataFrame, key: str, columns: list[str | Column]) -> DataFrame:
    return rows.select(key, F.to_json(F.struct(*columns)).alias("status"))
