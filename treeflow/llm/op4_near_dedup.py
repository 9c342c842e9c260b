"""Near-duplicate components: fast similarity sketches, banding, exact verification.

Sketch: rounds of hashed bin placement. In round i every shingle falls into a hashed bin with a value
i + h; after t rounds the bins are taken one by one, so every one of the t coordinates is filled by a
value, after about one pass for large sets, and equal coordinates count the similarity with
concentration bounds. Bands of R coordinates are the keys under which documents meet; a pair at the
threshold misses all BANDS keys with probability (1 - 0.75^R)^BANDS, below 4e-6, and shares fewer than
two with one below 6e-5.

No step emits all pairs of a group. Documents with equal sets are one class from the start (a
pre-aggregated minimum). Then come rounds of stars: every bucket that holds more than one component has
a centre, and each member outside the centre's component is compared with one centre, the one it shares
most buckets with; links are verified on full shingle sets and contracted. Each round compares a
document at most once and takes another centre, so a family of copies becomes one component in a few
rounds, however large. What is left are documents whose buckets still hold several components. Their
parity bitmaps, of two to four bits a shingle, meet bucket by bucket, in blocks of bounded size: bitmaps
differ in at most as many bits as the sets in shingles, so all pairs that can be links are found within
a task, and only those leave it. Rounds that give each document its nearest candidate (as many rows as
documents) contract what can be linked; a last one gives every candidate between what is still apart.
Verification streams each centre's documents past its set, in salted portions, so a centre with very
many members is spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeflow.llm.bpe import Cache
from treeflow.llm.common import components, drop, lean, prefiltered, sized_batches, space_words, split_batches, table, text_bytes, written

SHINGLE = 5
#: Similarity of a link, as a fraction.
SIMILAR = (75, 100)
ROWS, BANDS = 6, 64
#: Rounds of stars, and of nearest candidates, before all candidates are verified; both end early once few comparisons give links.
STARS, NEAREST, WORTHWHILE = 5, 3, 0.2
#: Members of one block of a bucket, and pairs whose bitmaps are compared at once.
BLOCK, COMPARED = 4096, 1 << 19
#: Words of 64 bits of the parity bitmaps: two to four bits a shingle, within these bounds.
LEAST_WORDS, MOST_WORDS = 16, 1024
#: Documents that a portion of a star holds.
PORTION = 256

_MASK = (1 << 64) - 1
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_FULL = np.uint64(_MASK)
_word_hash = Cache(xxhash.xxh3_64_intdigest, 150_000)


def _forget() -> None:
    _word_hash.clear()


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text; a short one's whole sequence is one shingle."""
    out = []
    for text in texts:
        words = space_words(text)
        n = len(words)
        if not n:
            out.append(np.empty(0, dtype=np.uint64))
            continue
        h = np.fromiter(map(_word_hash.__getitem__, words), np.uint64, n)
        k = min(size, n)
        s = np.full(n - k + 1, k, dtype=np.uint64)
        for j in range(k):
            s = s * _P + h[j : n - k + 1 + j]
        out.append(np.unique(_mix(s)))
    return out


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches of sets that aren't empty: one row of t values for each."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    bins = np.full(len(sets) * t, _FULL, dtype=np.uint64)
    active = np.arange(len(sets))
    for i in range(2 * t):
        if not len(active):
            break
        h = _mix(flat + np.uint64((i * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & _MASK))
        at = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        value = np.uint64(i << 32) | (h & np.uint64(0xFFFFFFFF))
        np.minimum.at(bins, owner * t + at, value)
        if i < 8 or i % 8 == 0 or i >= t:
            open_ = (bins.reshape(-1, t)[active] == _FULL).any(axis=1)
            if not open_.all():
                active = active[open_]
                keep = np.isin(owner, active)
                flat, owner = flat[keep], owner[keep]
    return bins.reshape(-1, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band; the band's number is part of it."""
    cells = _mix(sketch).reshape(len(sketch), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sketch), bands)).copy()
    for j in range(rows):
        key = key * _P + cells[:, :, j]
    return _mix(key).view(np.int64)


def signature(s: np.ndarray) -> bytes:
    """The parity bitmap of a set: a bit tells whether an odd number of elements falls on it."""
    words = LEAST_WORDS
    while words * 32 < len(s) and words < MOST_WORDS:
        words *= 2
    at = (s & np.uint64(words * 64 - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=words * 64) & 1).astype(np.uint8), bitorder="little").tobytes()


def _sketched(documents: DataFrame, rows: int, bands: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(split_batches(batches, 2000), 2_000_000):
            sets = shingle_sets(text_bytes(batch))
            some = [i for i, s in enumerate(sets) if len(s)]
            keys = band_keys(sketches([sets[i] for i in some], rows * bands), bands, rows) if some else np.empty((0, bands), np.int64)
            offsets = np.concatenate([[0], np.cumsum([bands if len(s) else 0 for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel())),
                pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
            ], names=["doc_id", "n_shingles", "print", "bands", "signature"])

    return documents.select("doc_id", "text").mapInArrow(lean(run, _forget), "doc_id long, n_shingles long, print binary, bands array<long>, signature binary")


def _verified(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    counted = pairs.groupBy("a").agg(F.count("*").alias("members"))
    portions = F.ceil(F.col("members") / PORTION).cast("long")
    dealt = pairs.join(counted, "a").select("a", "b", F.pmod(F.xxhash64("b"), portions).alias("portion"))
    nodes = pairs.select(F.col("b").alias("node")).unionAll(pairs.select(F.col("a").alias("node"))).distinct()
    texts = prefiltered(documents.select("doc_id", "text"), "doc_id", nodes)
    # One more text per portion for its centre; the rest is one text per pair.
    centres = counted.select("a", F.explode(F.sequence(F.lit(0).cast("long"), portions - 1)).alias("portion"))
    wanted = dealt.select("a", "portion", F.col("b").alias("node")).unionAll(
        centres.select("a", "portion", F.col("a").alias("node"))
    )
    rows = (
        wanted.join(texts, wanted["node"] == texts["doc_id"])
        .select("a", "portion", "node", (F.col("node") != F.col("a")).alias("member"), "text")
        .repartition("a", "portion")
        .sortWithinPartitions("a", "portion", "member", "node")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own, number = None, None, None
        for batch in sized_batches(batches, 4_000_000):
            a, _, node, member, _ = (c.to_pylist() for c in batch.columns)
            out = []
            for x, y, is_member, s in zip(a, node, member, shingle_sets(text_bytes(batch)), strict=True):
                if not is_member:
                    centre, own = x, s
                    continue
                if centre != x:
                    raise ValueError(f"the text of document {x} is missing")
                number = len(np.intersect1d(own, s, assume_unique=True))
                if SIMILAR[1] * number >= SIMILAR[0] * (len(own) + len(s) - number):
                    out.append((x, y))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return written(rows.mapInArrow(lean(run, _forget), "a long, b long"), "links")


def _fits(n: str, m: str):
    """Sets of such different sizes can't be similar."""
    return F.least(n, m) * SIMILAR[1] >= F.greatest(n, m) * SIMILAR[0]


def _with_components(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep")
    )


def _unresolved(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with components, of the buckets that still hold more than one."""
    now = _with_components(members, labels)
    mixed = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("held"))
    return now.join(mixed.filter("lo <> hi").select("key", "held"), "key")


def _folded(bitmaps: np.ndarray, words: int) -> np.ndarray:
    """Parity bitmaps, one per row, folded to so many 64-bit words."""
    return np.bitwise_xor.reduce(bitmaps.reshape(len(bitmaps), -1, words), axis=1)


def candidates(rep: np.ndarray, n: np.ndarray, component: np.ndarray, side: np.ndarray, signatures: list[bytes], every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one bucket, of different components, that may be links.

    The parity bitmaps of two sets differ in at most as many bits as the sets in elements, so a link's
    differ in at most (n + m) / 7 bits; nothing else is left out. Rows of sides 0 and 1 are compared with
    each other, all rows if there is one side only. ``every`` gives all such pairs, else each row gives
    the one with the smallest share of bits that differ.
    """
    width = np.array([len(x) // 8 for x in signatures])
    values, counts = np.unique(component, return_counts=True)
    main = values[counts.argmax()]
    both = len(np.unique(side)) > 1
    found_a, found_b, found_share = [], [], []
    for w in np.unique(width):
        own, wider = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        bits = np.frombuffer(b"".join(signatures[i] for i in own), dtype="<u8").reshape(len(own), w)
        others, other_bits = own, bits
        if len(wider):
            others = np.concatenate([own, wider])
            other_bits = np.vstack([bits, _folded(np.frombuffer(b"".join(signatures[i] for i in wider), dtype="<u8").reshape(len(wider), 2 * w), w)])
        order = np.argsort(n[others], kind="stable")
        others, other_bits = others[order], other_bits[order]
        sizes = n[others]
        # Members of the largest component are only compared with others; that comparison starts from the others.
        lead = np.flatnonzero(component[others] != main)
        step = max(1, COMPARED // max(1, len(others)))
        for at in range(0, len(lead), step):
            x = lead[at : at + step]
            low = np.searchsorted(sizes, -(-SIMILAR[0] * int(sizes[x[0]]) // SIMILAR[1]), "left")
            high = np.searchsorted(sizes, int(sizes[x[-1]]) * SIMILAR[1] // SIMILAR[0], "right")
            y = np.arange(low, high)
            differ = np.zeros((len(x), len(y)), dtype=np.int32)
            for k in range(w):
                differ += np.bitwise_count(other_bits[x, k][:, None] ^ other_bits[low:high, k][None, :])
            total = sizes[x][:, None] + sizes[y][None, :]
            gx, gy = others[x], others[y]
            good = (differ * (SIMILAR[0] + SIMILAR[1]) <= total * (SIMILAR[1] - SIMILAR[0])) & (component[gx][:, None] != component[gy][None, :])
            good &= np.minimum(width[gx][:, None], width[gy][None, :]) == w  # wider pairs are compared in their own width
            if both:
                good &= side[gx][:, None] != side[gy][None, :]
            i, j = np.nonzero(good)
            found_a.append(gx[i])
            found_b.append(gy[j])
            found_share.append(differ[i, j] / total[i, j])
    if not found_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, j, share = (np.concatenate(x) for x in (found_a, found_b, found_share))
    if not every:  # the nearest of each row, from either end of a pair
        i, j, share = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([share, share])
        order = np.lexsort((rep[j], share, rep[i]))
        i, j = i[order], j[order]
        first = np.flatnonzero(np.concatenate([[True], rep[i][1:] != rep[i][:-1]])) if len(i) else np.empty(0, np.int64)
        i, j = i[first], j[first]
    return np.unique(np.stack([np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])], axis=1), axis=0).T if len(i) else (rep[i], rep[j])


def _met(mixed: DataFrame, signatures: DataFrame, every: bool) -> DataFrame:
    """(a, b): candidates() of every bucket. A bucket of more than BLOCK members is cut into blocks, which meet two by two."""
    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep", "key"), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks") > 1, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0))))
    rows = mixed.select("key", "rep", "n", "component", blocks.alias("blocks")).withColumn("own", own)
    rows = rows.withColumn("other", other).join(signatures, "rep")
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(low == high, 0).otherwise((F.col("own") == low).cast("int")).cast("int")
    rows = rows.select("key", low.alias("low"), high.alias("high"), "rep", "n", "component", side.alias("side"), "signature")
    rows = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group = pa.Table.from_batches(parts)
            if group.num_rows < 2:
                return
            rep, n, component, side = (group.column(c).to_numpy() for c in ("rep", "n", "component", "side"))
            a, b = candidates(rep, n, component, side, group.column("signature").to_pylist(), every)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        waiting, last = [], None
        for batch in batches:
            cell = list(zip(*(batch.column(c).to_pylist() for c in ("key", "low", "high")), strict=True))
            start = 0
            for at in range(len(cell)):
                if cell[at] != last:
                    if at > start:
                        waiting.append(batch.slice(start, at - start))
                    if waiting:
                        yield from of(waiting)
                    waiting, last, start = [], cell[at], at
            if len(cell) > start:
                waiting.append(batch.slice(start))
        if waiting:
            yield from of(waiting)

    return rows.mapInArrow(lean(run), "a long, b long")


def near_duplicates(documents: DataFrame, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """One row per document row: set size, component (its smallest id) and whether it is kept.

    ``documents(doc_id, text)``; other columns are ignored. Null and empty texts have no set and are
    linked with nothing. Rows repeated whole are one document and get equal results; a row without an
    id takes no part (no component, not kept). An empty table gives no rows.
    """
    spark = documents.sparkSession
    sk = written(_sketched(documents, rows, bands), "sketches")
    known = sk.filter(F.col("print").isNotNull() & F.col("doc_id").isNotNull())
    classes = written(
        known.groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("signature")),
        "classes",
    )
    buckets = classes.select("rep", "n", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    met = written(buckets.join(shared, "key"), "buckets")
    # A document that many others share buckets with is the likely origin of a family of copies.
    met_by = met.groupBy("rep").agg(F.sum("size").alias("met_by"))
    members = written(met.join(met_by, "rep").select("key", "rep", "n", "met_by"), "members")
    drop(spark, met)

    def star(now: DataFrame, salt: int) -> DataFrame:
        """(a, b): each member with the centre, of another component, that it shares most buckets with."""
        # First the likely origins of families, then others: the same pseudo-random order in all buckets.
        order = -F.col("met_by") if salt == 0 else F.xxhash64("rep", F.lit(salt))
        centre = F.struct(order.alias("o"), F.col("rep").alias("hub"), F.col("n").alias("hub_n"), F.col("component").alias("hub_c"), F.col("met_by").alias("hub_met"))
        centres = now.groupBy("key").agg(F.min(centre).alias("c")).select("key", "c.*")
        near = now.join(centres, "key").filter((F.col("component") != F.col("hub_c")) & _fits("n", "hub_n"))
        counted = near.groupBy("rep", "hub").agg(F.count("*").alias("times"), F.first("hub_met").alias("hub_met"))
        return counted.groupBy("rep").agg(F.max(F.struct("times", "hub_met", "hub"))["hub"].alias("a")).select("a", F.col("rep").alias("b"))

    tried = links = None
    labels = spark.createDataFrame([], "node long, component long")

    def compare(pairs: DataFrame) -> float:
        """Verifies pairs that weren't before; the share of them that are links."""
        nonlocal tried, links, labels
        pairs = pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "a", "b")
        if tried is not None:
            pairs = pairs.join(tried, ["x", "y"], "left_anti")
        new = written(pairs.groupBy("x", "y").agg(F.first("a").alias("a"), F.first("b").alias("b")), "pairs")
        n = new.count()
        if not n:
            return 0.0
        found = _verified(new.select("a", "b"), documents)
        tried = new.select("x", "y") if tried is None else tried.unionAll(new.select("x", "y"))
        links = found if links is None else links.unionAll(found)
        labels = written(components(links), "labels")
        return found.count() / n

    for salt in range(STARS):
        mixed = written(_unresolved(members, labels), "mixed")
        share = compare(star(mixed, salt))
        drop(spark, mixed)
        if share < WORTHWHILE:
            break

    def resolve(every: bool) -> float:
        mixed = written(_unresolved(members, labels).select("key", "rep", "n", "component", "held"), "mixed")
        share = compare(_met(mixed, classes.select("rep", "signature"), every))
        drop(spark, mixed)
        return share

    # What is left: candidates of different components in mixed buckets, first the nearest of each document, then all.
    for _ in range(NEAREST):
        if resolve(every=False) < WORTHWHILE:
            break
    resolve(every=True)

    named = classes.select("print", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("print", F.coalesce("component", "rep").alias("found"))
    out = (
        sk.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("print")).alias("print"))
        .withColumn("deal", F.coalesce(F.col("print"), F.col("doc_id").cast("string").cast("binary")))
        .join(named.withColumnRenamed("print", "deal"), "deal", "left")
        .withColumn("component_id", F.coalesce("found", "doc_id"))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    )
    drop(spark, members)
    return out


def op4_sketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, sym.b FROM r JOIN sym ON r.b = sym.a) SELECT a, b FROM r),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id,
  w.doc_id = least(w.doc_id, coalesce(m, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = w.doc_id
"""
