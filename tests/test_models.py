"""Set formulations against sequential models, and properties of byte-level operators."""

from __future__ import annotations

import random

import pytest

from treeflow import dims
from treeflow import registry
from treeflow.operators import coalesce, dedup, diff, filters, identity, journal, merkle, retention, sequence, telemetry
from treeflow.sources.config import Config

CHANGES = "domain long, inode long, seq long, etype int"


def _events(n, inodes, types, seed):
    r = random.Random(seed)
    return [(0, r.randrange(inodes), i + 1, r.choice(types)) for i in range(n)]


def test_transient_suppression_equals_its_state_machine(spark):
    rows = _events(400, 12, [8, 9, 5, 10, 2, 13], 1)
    created, kept = set(), []
    for _, inode, seq, etype in rows:
        if etype in sequence.CREATES:
            created.add(inode)
        elif etype in sequence.DELETES:
            was = inode in created
            created.discard(inode)
            if was:
                continue
        kept.append(seq)
    found = sequence.transient_suppressed(spark.createDataFrame(rows, CHANGES))
    assert sorted(r["seq"] for r in found.collect()) == kept


def test_gaps_equal_a_running_maximum(spark):
    r = random.Random(2)
    numbers = [n for n in range(1, 3000) if r.random() > 0.02 and not 1200 <= n <= 2300]
    rows = [(0, n, i) for i, n in enumerate(numbers)]
    want, last = [], 0
    for _, n, _ in rows:
        if n > last + 1:
            want.append((last + 1, n - 1, n - last > 1000))
        last = max(last, n)
    found = sequence.gaps(spark.createDataFrame(rows, "domain long, seq long, arrival long"))
    assert sorted((x["from_seq"], x["to_seq"], x["large"]) for x in found.collect()) == want


def _merge_model(rows, depth, limit):
    rows, out = list(rows), []
    while rows:
        seq, name, off, n = rows.pop(0)
        end, merged, i, seen = off + n, 1, 0, 0
        while i < len(rows) and seen < depth and end - off < limit:
            seen += 1
            if rows[i][1] == name and rows[i][2] == end:
                end += rows.pop(i)[3]
                merged += 1
            else:
                i += 1
        out.append((seq, off, end - off, merged))
    return out


@pytest.mark.parametrize("depth,limit", [(4, 40), (100, 10_000)])
def test_capped_merge_equals_its_queue(spark, depth, limit):
    r = random.Random(3)
    rows = [(1, "a", i, r.randrange(0, 60, 10), 10) for i in range(80)]
    found = coalesce.merge_capped(spark.createDataFrame(rows, "inode long, name string, seq long, off long, len long"), depth, limit)
    want = _merge_model([(s, n, o, k) for _, n, s, o, k in rows], depth, limit)
    assert sorted((x["seq"], x["off"], x["len"], x["merged"]) for x in found.collect()) == want


def test_merge_skips_rows_that_do_not_fit(spark):
    rows = [(1, "a", 1, 0, 10), (1, "a", 2, 50, 10), (1, "a", 3, 10, 10)]
    df = spark.createDataFrame(rows, "inode long, name string, seq long, off long, len long")
    assert coalesce.merge_capped(df, 10, 1 << 20).count() == 2
    assert coalesce.contiguous(df).count() == 3


def test_prune_by_size_equals_a_loop(spark):
    r = random.Random(4)
    for _ in range(5):
        rows = [(f"{i:03}", "t" if r.random() < 0.3 else None, 1, r.randrange(100), 0) for i in range(30)]
        most, total, gone = r.randrange(1500), sum(x[3] for x in rows), []
        for ts, tag, _, size, _ in rows:
            if total <= most:
                break
            if tag is None:
                gone.append(ts)
                total -= size
        df = spark.createDataFrame(rows, "ts string, tag string, files long, size_bytes long, disk_usage_bytes long")
        assert sorted(x["ts"] for x in retention.by_size(df, most).collect()) == gone


def test_prune_keeps_tagged_and_cutoff(spark):
    rows = [("2024-01-01T000000", "keep", 1, 1, 1), ("2024-01-02T000000", None, 1, 1, 1), ("2024-01-03T000000", None, 1, 1, 1)]
    df = spark.createDataFrame(rows, "ts string, tag string, files long, size_bytes long, disk_usage_bytes long")
    assert [r["ts"] for r in retention.by_age(df, "2024-01-03T000000").collect()] == ["2024-01-02T000000"]
    assert retention.by_count(df, 0).count() == 2
    assert retention.by_count(df.filter("tag IS NOT NULL"), 0).count() == 0


def test_cut_points_equal_the_rolling_hash():
    gear, r = dedup.gear_table(), random.Random(5)
    for n in (0, 1, 5, 300, 5000, 20_000):
        data = r.randbytes(n)
        ends, start, h = [], 0, 0
        for i, b in enumerate(data):
            h = ((h << 1) + int(gear[b])) & ((1 << 64) - 1)
            if i + 1 - start >= 64 and (h & 255 == 0 or i + 1 - start >= 1024):
                ends.append(i + 1)
                start, h = i + 1, 0
        if start < n:
            ends.append(n)
        assert dedup.cut_points(data, 64, 256, 1024, gear) == ends
    with pytest.raises(ValueError):
        dedup.cut_points(b"x", 64, 255, 1024, gear)


def test_one_byte_insert_keeps_most_chunks():
    gear, data = dedup.gear_table(), random.Random(6).randbytes(60_000)

    def chunks(x):
        ends = dedup.cut_points(x, 512, 4096, 16_384, gear)
        return {x[a:b] for a, b in zip([0, *ends], ends, strict=False)}

    a, b = chunks(data), chunks(data[:500] + b"!" + data[500:])
    assert len(a & b) >= len(a) / 2


def test_chunk_sizes_are_powers_of_two(spark):
    sizes = [0, 1, 65_536 * 1800, 65_536 * 1800 + 1, 10**12]
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(s,) for s in sizes], "size long").select("size", merkle.chunk_size(F.col("size")).alias("c")).collect()
    assert [r["c"] for r in rows][:4] == [65_536, 65_536, 65_536, 131_072]
    assert all(r["c"] & (r["c"] - 1) == 0 and -(-r["size"] // r["c"]) <= 1800 for r in rows)


def test_identity_fold_follows_chains_exchanges_and_late_creates(spark):
    rows = [
        (1, 1, 10, 7, "a", "b", 0), (1, 2, 10, 8, "a", None, 0), (1, 3, 10, 7, "b", "c", 0),
        (1, 4, 11, 8, "x", None, 0), (1, 5, 10, 7, "c", "x", 2), (1, 6, 11, 12, "y", None, 0), (1, 7, 11, 9, "c", None, 0),
    ]
    df = spark.createDataFrame(rows, "tree long, seq long, inode long, etype long, name string, new_name string, flags long")
    assert {r["inode"]: r["paths"] for r in identity.projected(df).collect()} == {10: "x", 11: "y"}


def test_rename_chain_of_five_names(spark):
    moves = [(f"{c}{k}", f"{chr(ord(c) + 1)}{k}") for k in range(20) for c in "abcd"]
    found = identity.chain_ends(spark.createDataFrame(moves, "src string, dst string")).collect()
    assert {(r["start"], r["end"], r["hops"]) for r in found} == {(f"a{k}", f"e{k}", 4) for k in range(20)}


def test_generations_and_links(spark):
    rows = [(0, 1, i + 1, t) for i, t in enumerate([8, 2, 9, 8, 9, 9, 8])]
    df = spark.createDataFrame(rows, CHANGES)
    assert [r["generation"] for r in identity.generations(df).orderBy("seq").collect()] == [0, 0, 0, 1, 1, 1, 2]
    two = spark.createDataFrame([(0, 1, 1, 8), (0, 1, 2, 12), (0, 1, 3, 9)], CHANGES)
    assert identity.link_counts(two).first()["unlinked"] is False


def test_globs(spark):
    df = spark.createDataFrame([("a/b.txt",), ("a/c.log",), ("d.txt",)], "rel string")
    kept = lambda f, i, e: sorted(r["rel"] for r in f(df, i, e).collect())
    assert kept(filters.keep_oneshot, [], []) == ["a/b.txt", "a/c.log", "d.txt"]
    assert kept(filters.keep_oneshot, ["*.log"], []) == ["a/b.txt", "a/c.log", "d.txt"]
    assert kept(filters.keep_oneshot, ["*b.txt"], ["*.txt", "[x"]) == ["a/b.txt", "a/c.log"]
    assert kept(filters.keep_daemon, ["a/"], ["c.l*"]) == ["a/b.txt"]


def test_empty_trees(spark):
    none = spark.createDataFrame([], "rel string, parent string, name string, size long, mtime_sec long, mtime_nsec long, content string")
    assert diff.verify(none, none).count() == 0
    assert diff.directory_hashes(none).count() == 0
    assert merkle.leaves(merkle.signatures(none, 1024), 1024).count() == 0
    one = spark.createDataFrame([("d/e", "d", "e", 0, 1, 1, "")], none.schema)
    assert merkle.leaves(merkle.signatures(one, 1024), 1024).count() == 0
    assert [r["finding"] for r in diff.verify(one, none).collect()] == ["missing"]


def test_journal_skips_what_it_cannot_read_and_keeps_recreated_files(spark):
    lines = ['{"p":"a","d":false,"t":10,"s":1}', "", "junk", '{"p":"dir","d":true,"t":10,"s":2}', '{"p":"b","d":false,"t":10,"s":3}']
    entries = journal.parsed(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert entries.count() == 3
    target = spark.createDataFrame([("a", 5), ("b", 20), ("dir/x", 1), ("other", 1)], "rel string, mtime_sec long")
    assert sorted(r["rel"] for r in journal.replayed(target, entries).collect()) == ["a", "dir/x"]


def test_tuner_reaches_probing_and_mutes():
    t = telemetry.Tuner()
    states = [t.step(i * 0.1, 1 << 20, 0.01, 0.001, 0.0, 1)[0] for i in range(100)]
    assert states[0] == "startup" and "drain" in states and states[-1] in ("probe", "drain")
    assert t.step(10.1, 1 << 20, 0.01, 0.001, 1.2, 1)[0] == "muted"


def test_latency_timeout_stays_in_bounds(spark):
    rows = [("k", i, None if i % 2 else 100) for i in range(40)]
    found = telemetry.latency_timeouts(spark.createDataFrame(rows, "key string, event_id long, x long"), "event_id", "x").collect()
    assert len(found) == 40 and all(5_000_000 <= r["timeout_us"] <= 60_000_000 and r["mean_us"] <= 30_000_000 for r in found)


def test_dense_ids_number_every_row(spark):
    df = spark.range(5000).selectExpr("cast(hash(id) as long) * 10000 + id as k").repartition(7)
    rows = dedup.dense_ids(df, "k", "n").orderBy("k").collect()
    assert [r["n"] for r in rows] == list(range(5000))


def test_config_is_validated():
    text = '[[sources]]\npath = "/a"\n[[sources.targets]]\npath = "/b"\nprofile = "nfs"\nworkers = 900\n'
    c = Config.parse(text)
    assert c.sources[0].targets[0].workers == 64 and c.max_versions == 24
    with pytest.raises(ValueError):
        Config.parse(text.replace("nfs", "tape"))


def test_every_type_has_a_class():
    assert {t for _, _, t, *_ in dims.EVENT_TYPES} == set(dims.TINS)


def test_rename_chains_of_the_whole_table(spark):
    """10,000 events: chains that start beyond the first 3,000 are followed too."""
    sf = "/root/testdata/sf0.01"
    ids = {r["event_id"] for r in spark.read.parquet(f"{sf}/events.parquet").select("event_id").collect()}
    moves = {i: i + 1 for i in ids if i % 6 < 4}
    want = set()
    for start in moves.keys() - set(moves.values()):
        end, hops = start, 0
        while end in moves:
            end, hops = moves[end], hops + 1
        want.add((f"n{start}", f"n{end}", hops))
    assert max(ids) > 3000
    assert {(r["start"], r["end"], r["hops"]) for r in registry.QUERIES["rename_chain_end"](spark, sf).collect()} == want
