"""Comparison of two trees: verification, what to copy, what to delete, which directories to skip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Files of fewer bytes have no lite hash.
LITE_BYTES = 128 * 1024
SAMPLE_CHARS = 64 * 1024


def verify(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """(rel, finding): missing, extra, size, content or ok, by size first and then by digest.

    Digests are taken before the join: what is shuffled is 64 characters a file, not its content.
    """
    side = lambda t, p: t.select("rel", F.col("size").alias(f"{p}_size"), F.sha2("content", 256).alias(f"{p}_hash"))
    finding = (
        F.when(F.col("t_size").isNull(), "missing")
        .when(F.col("s_size").isNull(), "extra")
        .when(F.col("s_size") != F.col("t_size"), "size")
        .when(F.col("s_hash") != F.col("t_hash"), "content")
        .otherwise("ok")
    )
    return side(src, "s").join(side(tgt, "t"), "rel", "full").select("rel", finding.alias("finding"))


def missing(src: DataFrame, tgt: DataFrame) -> DataFrame:
    return src.join(tgt.select("rel"), "rel", "left_anti")


def stale(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Target files that the source doesn't have (to be deleted)."""
    return tgt.join(src.select("rel"), "rel", "left_anti")


def with_target(src: DataFrame, tgt: DataFrame, *columns: str) -> DataFrame:
    """Source rows with the target's columns as ``t_<name>``, null where the target lacks the file."""
    names = columns or ("size", "mtime_sec", "mtime_nsec")
    return src.join(tgt.select("rel", *(F.col(c).alias(f"t_{c}") for c in names), F.lit(True).alias("t_exists")), "rel", "left")


def needs_copy(nanoseconds: bool = True) -> Column:
    """Over with_target(): absent, or another size or modification time."""
    same = (F.col("size") == F.col("t_size")) & (F.col("mtime_sec") == F.col("t_mtime_sec"))
    if nanoseconds:
        same = same & (F.col("mtime_nsec") == F.col("t_mtime_nsec"))
    return ~F.coalesce(same, F.lit(False))


def lite_hash(content: Column, size: Column) -> Column:
    """Digest of size, head and (above 128 KiB) tail; null for small files."""
    head = F.substring(content, 1, SAMPLE_CHARS)
    tail = F.when(size > LITE_BYTES, F.right(content, F.lit(SAMPLE_CHARS))).otherwise(F.lit(""))
    return F.when(size >= LITE_BYTES, F.sha2(F.concat(size.cast("string"), F.lit(":"), head, tail), 256))


def signature_match(prefix_a: str = "", prefix_b: str = "t_") -> Column:
    """Two signatures agree: sizes first, then Merkle roots alone if both are there, else times and lite hashes."""
    c = lambda p, n: F.col(p + n)
    a, b = prefix_a, prefix_b
    return (
        F.when(c(a, "size") != c(b, "size"), False)
        .when(c(a, "merkle_root").isNotNull() & c(b, "merkle_root").isNotNull(), c(a, "merkle_root") == c(b, "merkle_root"))
        .when((c(a, "mtime_sec") != c(b, "mtime_sec")) | (c(a, "mtime_nsec") != c(b, "mtime_nsec")), False)
        .when(c(a, "hash").isNotNull() & c(b, "hash").isNotNull(), c(a, "hash") == c(b, "hash"))
        .otherwise(True)
    )


def sync_decision(recovery: bool = False) -> Column:
    """The first rule that settles whether a file is synced, as ``sync:<rule>`` or ``skip:<rule>``.

    Over a row with size, mtime_sec, mtime_nsec, lite, root of the source, the same of the target as
    ``t_*`` (null: no target), the target's ``t_dirty`` flag and the stored signature ``sig_size``,
    ``sig_mtime_sec``, ``sig_mtime_nsec``, ``sig_hash``, ``sig_merkle_root`` (``has_sig``), ``s_readable``,
    ``t_readable`` and ``hashing``.
    """
    c = F.col
    same = lambda *names: F.coalesce(_all(c(n) == c(f"t_{n}") for n in names), F.lit(False))
    stored = (
        F.when(c("size") != c("sig_size"), False)
        .when(c("root").isNotNull() & c("sig_merkle_root").isNotNull(), c("root") == c("sig_merkle_root"))
        .when((c("mtime_sec") != c("sig_mtime_sec")) | (c("mtime_nsec") != c("sig_mtime_nsec")), False)
        .when(c("lite").isNotNull() & c("sig_hash").isNotNull(), c("lite") == c("sig_hash"))
        .otherwise(True)
    )
    return (
        F.when(same("size", "mtime_sec", "mtime_nsec"), "skip:stat")
        .when(c("t_dirty"), F.lit("sync:dirty" if recovery else "skip:dirty"))
        .when(~c("s_readable"), "sync:unreadable_source")
        .when(c("has_sig") & c("t_size").isNull(), "sync:missing")
        .when(c("has_sig") & stored, "skip:signature")
        .when(c("t_size").isNull() | ~c("t_readable"), "sync:unreadable_target")
        .when(~c("hashing") & same("size", "mtime_sec"), "skip:coarse")
        .when(~c("hashing"), "sync:coarse")
        .when(c("lite") != c("t_lite"), "sync:lite_hash")
        .when(c("sig_merkle_root").isNotNull() & (c("root") != c("t_root")), "sync:merkle")
        .when(c("sig_merkle_root").isNotNull(), "skip:merkle")
        .when(~same("size", "mtime_sec"), "sync:stat")
        .otherwise("skip:equal")
    )


def _all(conditions) -> Column:
    out = F.lit(True)
    for x in conditions:
        out = out & x
    return out


# --- directories --------------------------------------------------------------------------------


def child_hash(kind: str = "f") -> Column:
    return F.sha2(F.concat_ws(":", F.col("size").cast("string"), F.col("mtime_sec").cast("string"), F.col("mtime_nsec").cast("string"), F.lit(kind)), 256)


#: Hexadecimal digits of a name's digest that tell its slice of a directory.
SLICE_DIGITS = 3


def _listed(tree: DataFrame) -> DataFrame:
    """(dir, name, entry): the files and the subdirectories right below each directory, with digests of their metadata.

    A directory's metadata is how many files it holds and the newest of their times; one that holds only
    directories has neither.
    """
    own = tree.filter(~F.col("name").startswith(".treeflow"))
    files = own.select(F.col("parent").alias("dir"), "name", child_hash().alias("entry"))
    held = own.groupBy(F.col("parent").alias("dir")).agg(F.count("*").alias("n"), F.max("mtime_sec").alias("newest"))
    parts = F.split("dir", "/")
    entry = lambda d, n, newest: F.struct(d.alias("dir"), n.alias("n"), newest.alias("newest"))
    none = F.lit(0).cast("long")
    higher = F.transform(F.when(F.size(parts) > 1, ancestors("dir")).otherwise(F.array()), lambda d: entry(d, none, F.lit(None).cast("long")))
    every = held.select(F.inline(F.concat(F.array(entry(F.col("dir"), F.col("n"), F.col("newest").cast("long"))), higher)))
    every = every.filter("dir <> ''").groupBy("dir").agg(F.sum("n").alias("n"), F.max("newest").alias("newest"))
    digest = F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.coalesce("newest", none).cast("string"), F.lit("0"), F.lit("d")), 256)
    above = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    return files.unionAll(every.select(above.alias("dir"), F.element_at(parts, -1).alias("name"), digest.alias("entry")))


def directory_hashes(tree: DataFrame) -> DataFrame:
    """(dir, hash, children): digest of the names and metadata of a directory's immediate files and subdirectories.

    A directory is hashed in slices of its names, and then over its slices' digests, so that one that holds a
    large part of all files is spread over tasks and no list holds all of its entries. Directories above others
    are listed too, up to the root (the empty path).
    """
    slices = (
        _listed(tree).groupBy("dir", F.substring(F.sha2("name", 256), 1, SLICE_DIGITS).alias("slice"))
        .agg(F.array_sort(F.collect_list(F.struct("name", "entry"))).alias("l"), F.count("*").alias("n"))
        .select("dir", "n", F.concat_ws(":", "slice", F.sha2(F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["name"], x["entry"])), "\n"), 256)).alias("h"))
    )
    listed = slices.groupBy("dir").agg(F.array_sort(F.collect_list("h")).alias("l"), F.sum("n").cast("long").alias("children"))
    return listed.select("dir", F.sha2(F.array_join("l", "\n"), 256).alias("hash"), "children")


def prune_directories(src_hashes: DataFrame, stored: DataFrame, targets: DataFrame) -> DataFrame:
    """(dir, pruned): equal to the stored hash on every target; a target without one is a mismatch.

    ``stored(target, dir, hash)``; ``targets`` is a small dimension.
    """
    wanted = src_hashes.select("dir", "hash").crossJoin(F.broadcast(targets.select("target")))
    return (
        wanted.join(stored.withColumnRenamed("hash", "stored"), ["target", "dir"], "left")
        .groupBy("dir")
        .agg(F.bool_and(F.coalesce(F.col("hash") == F.col("stored"), F.lit(False))).alias("pruned"))
    )


def ancestors(path: str) -> Column:
    """All proper ancestors of a path, the path itself not included: ``a``, ``a/b`` for ``a/b/c``."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def with_ancestors(df: DataFrame, path: str) -> DataFrame:
    return df.filter(F.size(F.split(path, "/")) > 1).withColumn("ancestor", F.explode(ancestors(path)))


def unprune_ancestors(decisions: DataFrame) -> DataFrame:
    """A directory above one that differs isn't skipped, even if its own listing is equal.

    One pass: every directory that differs votes against those above it.
    """
    parts = F.split("dir", "/")
    vote = lambda d, pruned, own: F.struct(d.alias("dir"), pruned.alias("pruned"), F.lit(own).alias("own"))
    above = F.when(F.col("pruned"), F.array()).otherwise(
        F.concat(F.when(F.size(parts) > 1, ancestors("dir")).otherwise(F.array()), F.when(F.col("dir") != "", F.array(F.lit(""))).otherwise(F.array()))
    )
    votes = F.concat(F.array(vote(F.col("dir"), F.col("pruned"), True)), F.transform(above, lambda d: vote(d, F.lit(False), False)))
    counted = decisions.select(F.inline(votes)).groupBy("dir").agg(F.bool_and("pruned").alias("pruned"), F.bool_or("own").alias("own"))
    return counted.filter("own").select("dir", "pruned")


def outside_pruned(files: DataFrame, pruned: DataFrame) -> DataFrame:
    """Files without a pruned ancestor: directories meet pruned ones by equi joins over exploded ancestors, files their directory."""
    of = F.expr("if(instr(rel, '/') > 0, regexp_replace(rel, '/[^/]*$', ''), '')")
    dirs = files.select(of.alias("at")).distinct()
    parts = F.split("at", "/")
    chain = F.concat(F.when(F.size(parts) > 1, ancestors("at")).otherwise(F.array()), F.array("at"))
    skipped = pruned.filter("pruned").select(F.col("dir").alias("ancestor"))
    under = dirs.select("at", F.explode(chain).alias("ancestor")).join(skipped, "ancestor", "left_semi").select("at").distinct()
    return files.withColumn("at", of).join(under, "at", "left_anti").select(*files.columns)


def one_owner_per_path(sources: list[DataFrame]) -> DataFrame:
    """Union of several sources into one destination; of equal paths the last source's file stays."""
    tagged = [s.withColumn("source_order", F.lit(k)) for k, s in enumerate(sources)]
    out = tagged[0]
    for s in tagged[1:]:
        out = out.unionByName(s)
    columns = [c for c in out.columns if c != "rel"]
    best = out.groupBy("rel").agg(F.max_by(F.struct(*columns), "source_order").alias("f"))
    return best.select("rel", "f.*")
