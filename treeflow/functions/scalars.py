"""Scalar functions as columns: durations, sizes, timestamps, backoffs, timeouts, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds of a duration's unit, bytes of a size's.
DURATION_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800}
SIZE_UNITS = {"K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40}


def _with_unit(c: str, units: dict[str, int], pattern: str, strict: bool) -> Column:
    text = F.trim(c)
    number = F.expr(f"try_cast(regexp_extract(trim({c}), '{pattern}', 1) AS BIGINT)")
    unit = F.regexp_extract(text, pattern, 2)
    factor = F.coalesce(*(F.when(F.upper(unit) == k.upper(), F.lit(v).cast("long")) for k, v in units.items()), F.lit(None).cast("long"))
    out = number * factor
    return F.when(out.isNotNull(), out).otherwise(F.raise_error(F.concat(F.lit("not a quantity: "), F.col(c)))) if strict else out


def duration_seconds(c: str, strict: bool = False) -> Column:
    """``30d`` as seconds; a unit is mandatory. Null (or an error, if strict) for anything else."""
    return _with_unit(c, DURATION_UNITS, "^([0-9]+)([smhdw])$", strict)


def size_bytes(c: str, strict: bool = False) -> Column:
    """``50G`` as bytes; the suffix is mandatory and of either case."""
    return _with_unit(c, SIZE_UNITS, "^([0-9]+)([kKmMgGtT])$", strict)


def human_size(c: str) -> Column:
    """Two decimals from KiB on, whole bytes below."""
    x = F.col(c)
    scaled = lambda p, u: F.concat(F.format_string("%.2f", x / float(1 << p)), F.lit(f" {u}"))
    return (
        F.when(x >= 1 << 40, scaled(40, "TiB")).when(x >= 1 << 30, scaled(30, "GiB")).when(x >= 1 << 20, scaled(20, "MiB"))
        .when(x >= 1 << 10, scaled(10, "KiB")).otherwise(F.concat(x.cast("string"), F.lit(" B")))
    )


def human_size_short(c: str) -> Column:
    """One decimal and a single letter."""
    x = F.col(c)
    scaled = lambda p, u: F.concat(F.format_string("%.1f", x / float(1 << p)), F.lit(u))
    return F.when(x >= 1 << 30, scaled(30, "G")).when(x >= 1 << 20, scaled(20, "M")).when(x >= 1 << 10, scaled(10, "K")).otherwise(F.concat(x.cast("string"), F.lit("B")))


def snapshot_time(c: str) -> Column:
    """A snapshot's name as a time."""
    return F.to_timestamp_ntz(c, F.lit("yyyy-MM-dd'T'HHmmss"))


def iso_of(c: str) -> Column:
    return F.regexp_replace(c, r"^(.{10}T\d\d)(\d\d)(\d\d)$", "$1:$2:$3Z")


def name_of_iso(c: str) -> Column:
    """The file-system safe form of an ISO time."""
    return F.regexp_replace(F.regexp_replace(c, "Z$", ""), ":", "")


def parent_of(c: str) -> Column:
    parts = F.split(c, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")


def stripped(c: str, prefix: str) -> Column:
    """The path below a prefix; null if it isn't below it."""
    return F.when(F.col(c).startswith(prefix + "/"), F.substring(F.col(c), len(prefix) + 2, F.length(c)))


def is_below(c: str, ancestor: str) -> Column:
    return (F.col(c) == ancestor) | F.col(c).startswith(ancestor + "/")


def doubled(base: int, attempt: Column, most: int) -> Column:
    """base * 2^attempt, at most ``most``."""
    return F.least(F.lit(base).cast("double") * F.pow(F.lit(2.0), F.least(attempt, F.lit(40))), F.lit(float(most))).cast("long")


def retry_backoff_ms(attempt: Column) -> Column:
    return doubled(50, attempt, 5000)


def poison_backoff_s(failures: Column) -> Column:
    return F.pow(F.lit(2.0), F.least(failures, F.lit(6))).cast("long")


def hydration_backoff_ms(attempt: Column, jitter: Column) -> Column:
    return doubled(100, attempt, 5000) + jitter


def copy_timeout_s(size: Column) -> Column:
    """A minute, and one for every 10 MiB begun at least once, up to five."""
    return F.least(F.lit(60) + F.lit(60) * F.greatest(F.lit(1), F.floor(size / 10_485_760)), F.lit(300)).cast("long")


def memory_score(used: Column) -> Column:
    return F.when(used > 0.90, (used - 0.90) * 10).otherwise(0.0)


def stress_score(memory: Column, io: Column | None, cpu: Column | None, load: Column, io_limit: float, cpu_limit: float, max_load: float) -> Column:
    """The worst of memory, and of pressure where it is measured, else of load."""
    pressure = F.greatest(io / io_limit, cpu / cpu_limit)
    return F.greatest(memory_score(memory), F.when(io.isNotNull(), pressure).otherwise(load / max_load), F.lit(0.0))


def pacing_ms(score: Column, interval: int, one_shot: bool = False) -> Column:
    """How long a background copy waits at a stress score."""
    threshold, factor, power, most = (1.5, 50.0, 1.1, 250.0) if one_shot else (0.8, 100.0, 1.2, 500.0)
    backoff = F.least(F.pow(F.greatest(score - threshold, F.lit(0.0)) * factor, F.lit(power)), F.lit(most)).cast("long")
    return F.when(score < 0.1, 0).when(score < threshold, interval).when(backoff > 0, backoff).otherwise(interval).cast("long")


def storage_class(rtt_us: Column, latency_us: Column) -> Column:
    """Class of a target's storage by its round trip; a hard latency spike on fast storage is throttling."""
    spike = (latency_us > rtt_us * 6) & (latency_us > 10_000)
    return F.when((rtt_us < 200) & spike, "throttled_nvme").when(rtt_us < 200, "nvme").when(rtt_us > 5000, "hdd").otherwise("sata_ssd")


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.greatest(as_column(low), F.least(x, as_column(high)))


def adaptive_timeouts(rtt_s: Column) -> dict[str, Column]:
    """Stall, overall and post-copy seconds over a class row (stall_base, stall_rtt, overall_max, post_base, post_rtt)."""
    stall = clamp(F.col("stall_base") + F.col("stall_rtt") * rtt_s, 10, 300).cast("long")
    least = stall.cast("double") * 3
    overall = clamp(rtt_s * 10, least, F.greatest(F.col("overall_max").cast("double"), least)).cast("long")
    post = clamp(F.col("post_base") + F.col("post_rtt") * rtt_s, 10, 600).cast("long")
    return {"stall": stall, "overall": overall, "postcopy": post}


def throughput(n: Column, seconds: Column) -> Column:
    """Per second; null unless some time passed."""
    return F.when(seconds > 0, n / seconds)


def eta_s(done: Column, total: Column, seconds: Column) -> Column:
    """Whole seconds, cut towards zero; negative where more than the total is done."""
    return F.when(done > 0, F.call_function("div", (total - done) * seconds, done))


def rounded(x: Column, digits: int) -> Column:
    """Scaled, rounded half away from zero and scaled back, as DuckDB does with doubles; a large number's last bits may change."""
    scale = 10.0**digits
    return F.round(x * scale, 0) / scale


def reynolds(rate: Column, latency_s: Column, capacity: Column) -> Column:
    """Offered work in flight against what a queue holds (Little's law over capacity)."""
    return F.try_divide(rate * latency_s, capacity)
