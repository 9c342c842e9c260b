"""Identities: which paths an inode has after creates, renames, links, unlinks and exchanges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeflow.operators.coalesce import folded
from treeflow.shared import drop, written

CREATES, RENAME, UNLINK, RMDIR, LINK = (8, 10, 16, 17), 7, 9, 5, 12


def final_names(events: DataFrame) -> DataFrame:
    """(inode, name, alive): the name that the last create or rename gave; an unlink after it ends it."""
    named = F.col("etype").isin(*CREATES, RENAME)
    last = events.filter(named | F.col("etype").isin(UNLINK, RMDIR)).groupBy("inode").agg(
        F.max_by(F.when(F.col("etype") == RENAME, F.col("new_name")).otherwise(F.col("name")), F.when(named, F.col("seq"))).alias("name"),
        F.max(F.when(named, F.col("seq"))).alias("named_at"),
        F.max(F.when(~named, F.col("seq"))).alias("gone_at"),
    )
    alive = F.col("named_at").isNotNull() & (F.col("gone_at").isNull() | (F.col("gone_at") < F.col("named_at")))
    return last.select("inode", "name", alive.alias("alive"))


def effective_order(events: DataFrame) -> DataFrame:
    """Renames that come before their inode's first create take effect right after it."""
    created = events.filter(F.col("etype").isin(*CREATES)).groupBy("inode").agg(F.min("seq").alias("created"))
    deferred = (F.col("etype") == RENAME) & (F.col("seq") < F.col("created"))
    joined = events.join(created, "inode", "left")
    at = F.when(deferred, F.col("created")).otherwise(F.col("seq"))
    return joined.withColumns({"at": at, "deferred": F.coalesce(deferred, F.lit(False))}).drop("created")


def chain_ends(moves: DataFrame) -> DataFrame:
    """(start, end, hops): where chains of renames a -> b -> c end, by pointer doubling.

    ``moves(src, dst)``, each name moved from and to at most once. A round joins every pointer with that
    of its end, so a chain of n hops takes log2(n) rounds whatever their number.
    """
    spark = moves.sparkSession
    now = written(moves.select(F.col("src").alias("start"), F.col("dst").alias("end"), F.lit(1).cast("long").alias("hops")), "chains")
    while True:
        nxt = now.select(F.col("start").alias("end"), F.col("end").alias("far"), F.col("hops").alias("more"))
        step = now.join(nxt, "end", "left")
        new = written(step.select("start", F.coalesce("far", "end").alias("end"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("far").isNotNull().alias("moved")), "chains")
        drop(spark, now)
        moved = not new.filter("moved").isEmpty()
        now = new.drop("moved")
        now._treeflow_path = new._treeflow_path
        if not moved:
            break
    heads = moves.join(moves.select(F.col("dst").alias("src")), "src", "left_anti").select(F.col("src").alias("start"))
    return now.join(heads, "start", "left_semi")


def resolved_paths(entries: DataFrame) -> DataFrame:
    """(inode, path): full paths of (inode, parent, name) entries; a parent of 0 is the root.

    Pointer doubling over (ancestor, path so far): rounds grow with the logarithm of the depth. An entry
    whose chain of parents breaks off has the path from there.
    """
    spark = entries.sparkSession
    now = written(entries.select("inode", F.col("parent").alias("up"), F.col("name").alias("path")), "paths")
    while not now.filter("up <> 0").isEmpty():
        above = now.select(F.col("inode").alias("up"), F.col("up").alias("up2"), F.col("path").alias("head"))
        # Roots are done; only the others look up, and nobody looks up the root.
        open_ = now.filter("up <> 0").join(above, "up", "left")
        stepped = open_.select("inode", F.coalesce("up2", F.lit(0)).alias("up"), F.concat_ws("/", "head", "path").alias("path"))
        new = written(now.filter("up = 0").unionByName(stepped), "paths")
        drop(spark, now)
        now = new
    return now.select("inode", "path")


def exchanged(entries: DataFrame, swaps: DataFrame) -> DataFrame:
    """Entries (inode, path) after swaps (path_a, path_b) of both names; a swap without a partner is a move."""
    there = swaps.select(F.col("path_a").alias("path"), F.col("path_b").alias("to")).unionAll(swaps.select(F.col("path_b").alias("path"), F.col("path_a").alias("to")))
    return entries.join(there, "path", "left").select("inode", F.coalesce("to", "path").alias("path"))


def parent_paths(events: DataFrame, directories: DataFrame, inodes: DataFrame) -> DataFrame:
    """Path of an event's file: below its directory's path, else its own inode's, else its bare name."""
    j = events.join(directories.select(F.col("inode").alias("parent_inode"), F.col("path").alias("dir_path")), "parent_inode", "left")
    j = j.join(inodes.select("inode", F.col("path").alias("own_path")), "inode", "left")
    below = F.when(F.col("dir_path").isNotNull(), F.concat_ws("/", "dir_path", "name"))
    return j.withColumn("path", F.coalesce(below, F.col("own_path"), F.col("name"))).drop("dir_path", "own_path")


def link_counts(events: DataFrame) -> DataFrame:
    """(inode, paths, unlinked): names left after creates and links less unlinks; gone only at none."""
    n = F.sum(F.when(F.col("etype").isin(*CREATES, LINK), 1).when(F.col("etype") == UNLINK, -1).otherwise(0))
    return events.groupBy("inode").agg(F.greatest(n, F.lit(0)).cast("long").alias("paths")).withColumn("unlinked", F.col("paths") == 0)


def generations(events: DataFrame) -> DataFrame:
    """A create after a delete starts a new generation of its inode: events with their generation."""
    w = Window.partitionBy("inode").orderBy("seq")
    kind = F.when(F.col("etype").isin(*CREATES), "c").when(F.col("etype").isin(UNLINK, RMDIR), "d")
    before = F.last(F.when(F.col("kind").isNotNull(), F.col("kind")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = events.withColumn("kind", kind).withColumn("before", before)
    fresh = ((F.col("kind") == "c") & (F.col("before") == "d")).cast("int")
    return marked.withColumn("generation", F.coalesce(F.sum(fresh).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).drop("kind", "before")


def projected(events: DataFrame) -> DataFrame:
    """The exact fold of a tree's identities: creates, renames (deferred until the create), exchanges,
    links and unlinks, in order; (tree, inode, paths) at the end.

    Keyed by tree, streamed: what is held is a tree's live names. Use final_names() where exchanges and
    links don't occur; it needs no order.
    """

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        paths: dict[int, list[str]] = {}
        owner: dict[str, int] = {}
        waiting: dict[int, list[tuple]] = {}

        def give(inode, name):
            names = paths.setdefault(inode, [])
            if name in names:
                names.remove(name)
            names.append(name)
            owner[name] = inode

        def take(inode, name):
            if name in paths.get(inode, []):
                paths[inode].remove(name)
            if owner.get(name) == inode:
                del owner[name]

        def apply(row):
            tree, seq, inode, etype, name, new_name, flags = row
            if etype in CREATES:
                give(inode, name)
                for late in waiting.pop(inode, []):
                    apply(late)
            elif etype == RENAME:
                if inode not in paths:
                    waiting.setdefault(inode, []).append(row)
                elif flags & 2 and new_name in owner and owner[new_name] != inode:
                    other = owner[new_name]
                    take(other, new_name)
                    take(inode, name)
                    give(other, name)
                    give(inode, new_name)
                else:
                    take(inode, name)
                    give(inode, new_name)
            elif etype == LINK:
                give(inode, name)
            elif etype == UNLINK:
                take(inode, name)
            elif etype == RMDIR:
                for n in list(paths.pop(inode, [])):
                    owner.pop(n, None)

        tree = None
        for row in rows:
            tree = row[0]
            apply(row)
        for inode in sorted(paths):
            yield tree, inode, ",".join(paths[inode])

    schema = pa.schema([("tree", pa.int64()), ("inode", pa.int64()), ("paths", pa.string())])
    return folded(events, "tree", "seq", ["seq", "inode", "etype", "name", "new_name", "flags"], fold, schema, "tree long, inode long, paths string")


def not_hydrated(events: DataFrame, hydrated: DataFrame) -> DataFrame:
    """Data events of inodes that were never copied go to repair."""
    return events.filter(F.col("etype").isin(1, 2, 11)).join(hydrated.select("inode"), "inode", "left_anti")


def current_jobs(jobs: DataFrame, generation: int) -> DataFrame:
    return jobs.filter(F.col("generation") == generation)


def valid_identities(index: DataFrame, live: DataFrame) -> DataFrame:
    """Index entries whose path still has the same inode; the others are stale."""
    return index.join(live.select("path", "inode"), ["path", "inode"], "left_semi")
