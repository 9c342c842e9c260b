"""Balanced label propagation: linked documents move to their neighbours' shards under quotas.

Documents with equal texts are linked. Every round joins each linked document to the shard that holds
most of its group (and isn't full of it). How many want to go from each shard to each other is a small
table; quotas are the largest shares of these flows, found by scaling, with which what comes into a
shard is at most what leaves it and its room. Movers are drawn by a hash: whole groups while they are
small, single documents of groups that a shard can't hold. Then the law is enforced exactly: each shard
keeps its capacity, linked documents first, and what is over fills the free places, group by group.

Ranks are never taken in one task: rows are ranked within (shard, slice of a hash order), and the number
of rows in earlier slices, a table of bounded size, is added.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeflow.llm.common import drop, table, written

SHARDS = 24
ROUNDS = 10
#: Slices of the order by group and, within it, by document.
GROUP_SLICES, DOC_SLICES = 128, 64
#: A group of more than this part of a shard's capacity moves document by document.
LARGE = 1 / 16


def _unit(*columns: str | Column) -> Column:
    """A hash of the columns as a number from 0 to 1."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def nodes_of(documents: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, gid): size is the text's bytes plus 8, gid tells equal texts."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    crc, size = F.crc32(text), F.octet_length(text).cast("long") + 8
    gid = F.concat_ws(":", F.xxhash64(text).cast("string"), crc.cast("string"), size.cast("string"))
    return documents.select("doc_id", size.alias("size"), crc.alias("text_crc32"), gid.alias("gid"))


def ranked(rows: DataFrame, by: str, name: str) -> DataFrame:
    """Adds a gapless number from 0 within each value of ``by`` (few values): linked documents first,
    then in an order in which the documents of a group are neighbours."""
    slice_ = (
        F.when(F.col("linked"), F.lit(0)).otherwise(F.lit(GROUP_SLICES * DOC_SLICES))
        + F.floor(_unit("gid") * GROUP_SLICES) * DOC_SLICES
        + F.floor(_unit("gid", "doc_id") * DOC_SLICES)
    ).cast("int")
    sliced = rows.withColumn("slice", slice_)
    counts = sliced.groupBy(by, "slice").agg(F.count("*").alias("c"))
    before = Window.partitionBy(by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # At most shards x 2 x GROUP_SLICES x DOC_SLICES rows, whatever the input.
    offsets = counts.select(by, "slice", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(by, "slice").orderBy("gid", "doc_id")
    return (
        sliced.withColumn("_at", F.row_number().over(inside).cast("long") - 1)
        .join(F.broadcast(offsets), [by, "slice"])
        .withColumn(name, F.col("offset") + F.col("_at"))
        .drop("slice", "_at", "offset")
    )


def _by_shard(values: list[int], shard: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.col(shard) + 1)


def quotas(flow: np.ndarray, room: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Shares of the flows between shards: no shard takes in more than leaves it plus its room."""
    share = np.ones_like(flow, dtype=float)
    for _ in range(rounds):
        into, out = (share * flow).sum(axis=0), (share * flow).sum(axis=1)
        over = into > out + room + 1e-9
        if not over.any():
            break
        share[:, over] *= ((out + room)[over] / into[over]).clip(0, 1)
    return share


def propagated(linked: DataFrame, capacity: list[int], rounds: int) -> DataFrame:
    """Rounds of moves of (doc_id, gid, members, shard, ...) rows; loads stay about within the capacities."""
    spark, shards = linked.sparkSession, len(capacity)
    # Equal counts are told apart by a hash, so that no shard is favoured.
    weight = lambda n, shard: F.struct(F.col(n).alias("n"), F.xxhash64("gid", shard).alias("o"), F.col(shard).alias("s"))
    for k in range(rounds):
        held = linked.groupBy("gid", "shard").agg(F.count("*").alias("here")).withColumn("own", weight("here", "shard"))
        load = dict.fromkeys(range(shards), 0) | dict(held.groupBy("shard").agg(F.sum("here")).collect())
        best = held.filter(F.col("here") < _by_shard(capacity, "shard")).groupBy("gid").agg(F.max("own").alias("best"))
        # Towards a shard with more of the group than the own one.
        wishes = held.join(best, "gid").filter(F.col("best") > F.col("own")).select("gid", "shard", F.col("best.s").alias("to"), "here")
        wishes = written(wishes, "wishes")
        flow = np.zeros((shards, shards))
        for s, t, n in wishes.groupBy("shard", "to").agg(F.sum("here")).collect():  # one row a pair of shards
            flow[s, t] = n
        if not flow.any():
            break
        share = quotas(flow, np.array([max(0, capacity[s] - load[s]) for s in range(shards)]))
        moves = linked.join(wishes.drop("here"), ["gid", "shard"], "left")
        large = F.col("members") > LARGE * min(capacity)
        draw = F.when(large, _unit("doc_id", "gid", F.lit(k))).otherwise(_unit("gid", F.lit(k)))
        admitted = F.element_at(F.array(*map(F.lit, share.ravel().tolist())), F.col("shard") * shards + F.col("to") + 1)
        moved = F.when(F.col("to").isNotNull() & (draw < admitted), F.col("to")).otherwise(F.col("shard"))
        after = written(moves.withColumn("shard", moved.cast("int")).select(*linked.columns), "shards")
        drop(spark, linked, wishes)
        linked = after
    return linked


def sharded(documents: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One row per document row with its shard and its place in it; the law is ``rows``.

    Counts of shards differ by one at most. ``documents(doc_id, text)``; other columns are ignored. A
    null text has 8 bytes of size and is taken for an empty one; rows repeated whole are documents of
    one group; a null id is allowed. An empty table gives no rows.
    """
    nodes = written(nodes_of(documents), "nodes")
    n = nodes.count()
    capacity = [n // shards + (s < n % shards) for s in range(shards)]
    groups = nodes.groupBy("gid").agg(F.count("*").alias("members")).filter("members > 1")
    start = F.floor(_unit(F.coalesce(F.col("doc_id"), F.lit(-1)), "gid") * shards).cast("int")
    rows = written(
        nodes.join(groups, "gid", "left").select("*", F.col("members").isNotNull().alias("linked"), start.alias("shard")), "placed"
    )
    linked = propagated(written(rows.filter("linked"), "shards"), capacity, rounds)
    placed = linked.unionByName(rows.filter("not linked"))
    placed = written(ranked(placed, "shard", "place"), "ranked")
    # Documents over a shard's capacity fill the free places of the others, neighbours together.
    load = dict.fromkeys(range(shards), 0) | dict(placed.groupBy("shard").agg(F.count("*")).collect())
    kept = placed.filter(F.col("place") < _by_shard(capacity, "shard"))
    over = placed.filter(F.col("place") >= _by_shard(capacity, "shard")).drop("place").withColumn("pool", F.lit(0))
    target, total = F.lit(shards - 1), 0
    steps = []
    for s in range(shards):
        total += max(0, capacity[s] - load[s])
        steps.append((s, total))
    for s, upto in reversed(steps[:-1]):
        target = F.when(F.col("place") < upto, F.lit(s)).otherwise(target)
    filled = ranked(over, "pool", "place").withColumn("shard", target.cast("int")).drop("pool")
    final = ranked(kept.unionByName(filled).drop("place"), "shard", "slot")
    return final.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def cut_edges(placed: DataFrame, groups: DataFrame) -> DataFrame:
    """For each group the pairs of members in different shards: of n members all pairs less those within."""
    held = placed.join(groups, "doc_id").groupBy("gid", "shard").agg(F.count("*").alias("c"))
    return held.groupBy("gid").agg(F.expr("cast((sum(c) * sum(c) - sum(c * c)) / 2 as long)").alias("cut"))


def op8_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))
