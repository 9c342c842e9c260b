"""Dimension tables: change-event types, storage profiles, storage classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Event codes, names, priority classes, and the three predicates of a type.
# (code, name, tin, control_plane, global_order, structural_metadata)
EVENT_TYPES = [
    (0, "unknown", "bulk", False, False, False),
    (1, "write", "bulk", False, False, False),
    (2, "writerange", "bulk", False, False, False),
    (3, "setxattr", "metadata", False, False, False),
    (4, "removexattr", "metadata", False, False, False),
    (5, "rmdir", "structural", True, True, True),
    (6, "fsync", "control", False, False, False),
    (7, "rename", "structural", True, True, False),
    (8, "create", "structural", True, False, False),
    (9, "unlink", "structural", True, True, True),
    (10, "mkdir", "structural", True, True, True),
    (11, "truncate", "bulk", False, False, False),
    (12, "link", "structural", True, True, True),
    (13, "chmod", "metadata", False, False, False),
    (14, "chown", "metadata", False, False, False),
    (15, "barrier", "control", False, False, False),
    (16, "mknod", "structural", True, False, True),
    (17, "symlink", "structural", True, False, True),
    (18, "fallocate", "bulk", False, False, False),
    (19, "utimes", "metadata", False, False, False),
    (20, "setflags", "metadata", False, False, False),
    (21, "lock", "metadata", False, False, False),
    (22, "flock", "metadata", False, False, False),
    (23, "rename_incomplete", "structural", True, True, False),
    (24, "clone", "bulk", False, False, False),
    (255, "gap", "control", False, False, False),
]
# Drain order and queue capacity (None: unbounded) of the priority classes.
TINS = {"control": (0, None), "structural": (1, 4096), "metadata": (2, 1024), "bulk": (3, 64)}
# Target profiles, fastest first.
TIERS = {"nvme": 0, "ssd": 1, "hdd": 2, "auto": 2, "sdcard": 3, "network": 4, "nfs": 5}
# Least stall, overall and post-copy timeouts (s) of a profile.
TIMEOUT_FLOORS = {
    "network": (60, 600, 300), "nfs": (60, 600, 300), "hdd": (30, 300, 120), "ssd": (15, 120, 60),
    "auto": (30, 300, 120), "nvme": (10, 60, 30), "sdcard": (10, 60, 30),
}
# Storage class -> stall base and RTT factor, overall maximum, post-copy base and factor.
CLASS_TIMEOUTS = {
    "nvme": (5, 10_000, 120, 10, 50_000), "sata_ssd": (15, 5_000, 300, 30, 50_000), "hdd": (30, 2_000, 600, 60, 50_000),
    "throttled_nvme": (30, 10_000, 300, 60, 50_000), "unknown": (60, 1_000, 600, 300, 10_000),
}


def event_types(spark: SparkSession) -> DataFrame:
    rows = [(c, n, t, TINS[t][0], TINS[t][1], cp, go, sm) for c, n, t, cp, go, sm in EVENT_TYPES]
    return spark.createDataFrame(
        rows,
        "code int, type_name string, tin string, tin_rank int, tin_capacity int, control_plane boolean, global_order boolean, structural_metadata boolean",
    )


def event_types_sql() -> str:
    """The same table as a DuckDB CTE body."""
    lit = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    rows = ", ".join(
        "(" + ", ".join(map(lit, (c, n, t, TINS[t][0], TINS[t][1], cp, go, sm))) + ")" for c, n, t, cp, go, sm in EVENT_TYPES
    )
    return (
        "SELECT * FROM (VALUES " + rows + ") d(code, type_name, tin, tin_rank, tin_capacity, control_plane, global_order, structural_metadata)"
    )


def table(spark: SparkSession, rows: dict, schema: str) -> DataFrame:
    """A dictionary of tuples (or scalars) as a small table, the key first."""
    return spark.createDataFrame([(k, *(v if isinstance(v, tuple) else (v,))) for k, v in rows.items()], schema)


def values_sql(rows: dict, columns: str) -> str:
    lit = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    body = ", ".join("(" + ", ".join(map(lit, (k, *(v if isinstance(v, tuple) else (v,))))) + ")" for k, v in rows.items())
    return f"SELECT * FROM (VALUES {body}) d({columns})"
