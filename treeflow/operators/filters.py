"""Row filters over paths, names and file metadata."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str | None:
    """An anchored regular expression for a shell pattern; ``*`` also crosses ``/``. None: invalid."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append(".*")
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                return None
            body = glob[i + 1 : end]
            negate = body.startswith("!")
            out.append("[" + "^" * negate + re.sub(r"([\\\]\[^&])", r"\\\1", body[negate:]) + "]")
            i = end
        else:
            out.append(re.escape(c) if c in r".^$+{}()|\[]" else c)
        i += 1
    return "^" + "".join(out) + "$"


def wildcard_regex(pattern: str) -> str:
    """The daemon's reading of a pattern: ``*`` and ``?`` only, matched anywhere in the path."""
    return "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) if c in r".^$+{}()|\[]" else c for c in pattern)


def _any(path: str, patterns: Sequence[str | None]) -> Column:
    out = F.lit(False)
    for p in patterns:
        if p is not None:  # invalid patterns are ignored
            out = out | F.col(path).rlike(p)
    return out


def keep_oneshot(df: DataFrame, includes: Sequence[str], excludes: Sequence[str], path: str = "rel") -> DataFrame:
    """Drops a path iff an exclude matches and no include does; includes alone never restrict."""
    return df.filter(~(_any(path, [glob_regex(p) for p in excludes]) & ~_any(path, [glob_regex(p) for p in includes])))


def keep_daemon(df: DataFrame, includes: Sequence[str], excludes: Sequence[str], path: str = "rel") -> DataFrame:
    """Excludes win; if there are includes, a path has to match one."""
    keep = ~_any(path, [wildcard_regex(p) for p in excludes])
    return df.filter(keep & _any(path, [wildcard_regex(p) for p in includes]) if includes else keep)


# Marks of the engine's own temporary files.
INTERNAL_PREFIX, INTERNAL_PART, INTERNAL_SUFFIX = ".treeflow", ".tmp.", ".swap_tmp"


def is_internal(name: str, new_name: str | None = None) -> Column:
    def one(c: str) -> Column:
        x = F.coalesce(F.col(c), F.lit(""))
        return x.startswith(INTERNAL_PREFIX) | x.contains(INTERNAL_PART) | x.endswith(INTERNAL_SUFFIX)

    return one(name) | one(new_name) if new_name else one(name)


def is_traversal(path: str) -> Column:
    """A path that leaves its root: absolute, or with a ``..`` component."""
    return F.col(path).startswith("/") | F.array_contains(F.split(path, "/"), "..")


def is_sparse(size: str, blocks: str) -> Column:
    """Fewer allocated 512-byte blocks than half the size, for files above 4 KiB."""
    return (F.col(size) > 4096) & (F.col(blocks) * 512 < F.floor(F.col(size) / 2))


def is_zero_block(content: str) -> Column:
    """Nothing but NUL characters (an empty block counts)."""
    return F.length(F.replace(F.col(content), F.lit("\x00"), F.lit(""))) == 0


def same_directory_metadata(a: str, b: str, fields: Sequence[str] = ("uid", "gid", "mode", "mtime_sec")) -> Column:
    out = F.lit(True)
    for f in fields:
        out = out & F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}"))
    return out


def watched(events: DataFrame, devices: DataFrame, ignored_pids: DataFrame) -> DataFrame:
    """Events of watched devices, without those of ignored processes."""
    return events.join(F.broadcast(devices), "dev_id", "left_semi").join(F.broadcast(ignored_pids), "pid", "left_anti")
