"""Exact top-k by inner product through a pivot-distance index.

A vector x gets one more coordinate sqrt(M - |x|^2), M the largest squared length, so that all lie on a
sphere and the largest inner product with q is the smallest Euclidean distance to (q, 0). Every vector is
keyed by its nearest pivot and its distance to it; the index is range-partitioned and sorted by (dimension,
pivot, distance, id), so even a vector that a third of all rows share is spread over tasks. A query expands
the sorted annuli of the pivots from the nearest on and stops when the triangle inequality
||q - p| - |x - p|| <= |q - x|, with room for the rounding of distances, rules the rest out: only then, so
results are exact.

Queries are written to the shared folder in files of bounded size. A task holds a bounded part of the index
and reads one file of queries after the other, so the index is read once, whatever the number of queries;
an annulus is held against all queries of a file that reach it in one matrix product. What is shuffled is k
rows per query and part.

Scores are exact integers: products that 64-bit floats can't hold exactly only choose which vectors may be
among the best, and those are scored with Python's integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeflow.llm.common import lean, table, written

TOP = 5
#: Every row whose id this divides is a query.
QUERY_STEP = 50
PIVOTS = 64
#: Vectors (by a hash of the id) that the pivots and first bounds come from; the only sample here.
SAMPLE = 4096
#: Queries of one file.
BLOCK = 4096
#: Vectors of one annulus.
RING = 256
#: Components of the index that a task holds at a time.
PART = 1 << 25
#: Hits of a file of queries that are kept before only the best remain.
HITS = 1 << 18
_EXACT = 2.0**53
_LONG = (-(1 << 63), (1 << 63) - 1)


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, vec): floor(scale * x) of each component, whole numbers held as doubles.

    Rows with a null id, a null vector, or a component that is null or not finite (after scaling) take no part.
    """
    scaled = lambda v: v.cast("double") * scale
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(scaled(v)) < float("inf")))
    # Beyond 2^53 a double has no fraction.
    whole = F.transform("embedding", lambda v: F.when(F.abs(scaled(v)) < _EXACT, F.floor(scaled(v)).cast("double")).otherwise(scaled(v)))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vec"))


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def _by_dimension(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each dimension."""
    lengths = _lengths(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        at = (ends[rows] - d)[:, None] + np.arange(d)
        yield rows, flat[at] if d else np.zeros((len(rows), 0))


def _lifted(x: np.ndarray, largest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(largest - (x * x).sum(axis=1), 0))
    return np.hstack([x, rest[:, None]])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def choose_pivots(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Centres of a few k-means rounds over the sample, from evenly spread starts."""
    pivots = sample[np.linspace(0, len(sample) - 1, min(count, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        near = _distances(sample, pivots).argmin(axis=1)
        for k in range(len(pivots)):
            if (near == k).any():
                pivots[k] = sample[near == k].mean(axis=0)
    return np.unique(pivots, axis=0)


def exact(x: np.ndarray, y: np.ndarray) -> int:
    """The inner product of whole numbers held as doubles, or the nearest long."""
    return min(max(sum(int(a) * int(b) for a, b in zip(x, y, strict=True)), _LONG[0]), _LONG[1])


class Space:
    """Pivots, and the length of the longest vector, of one dimension.

    Without a finite square of that length there are no distances: one pivot, from which all are at 0.
    """

    def __init__(self, sample: np.ndarray, largest: float, count: int):
        dimension = sample.shape[1]
        self.bounded = bool(np.isfinite(largest * 64))
        self.largest = largest if self.bounded else 0.0
        #: What a computed distance may be off by: its square is off by some units in the last place of M.
        self.room = float(np.sqrt(64 * np.finfo(float).eps * (dimension + 8) * self.largest)) + 1e-6
        self.pivots = choose_pivots(_lifted(sample, largest), count) if self.bounded and len(sample) else np.zeros((1, dimension + 1))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.bounded:
            return np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
        d = _distances(_lifted(x, self.largest), self.pivots)
        near = d.argmin(axis=1)
        return near, d[np.arange(len(d)), near]


class Searcher:
    """The top k of some queries of one dimension over parts of the index."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, least: np.ndarray, space: Space, top: int):
        self.ids, self.q, self.space, self.top = ids, queries, space, top
        self.least = np.minimum(least, 2.0**63 - 2048)  # scores end at the largest long
        self.square = (queries * queries).sum(axis=1)
        self.to_pivot = _distances(np.hstack([queries, np.zeros((len(queries), 1))]), space.pivots) if space.bounded else None
        self.most = np.abs(queries).max(axis=1, initial=0)
        self.hits: list[tuple] = []
        self.held = 0

    def reach(self) -> np.ndarray:
        """Distances beyond which nothing can score ``least``."""
        low = self.least - np.abs(self.least) * 1e-12
        return np.sqrt(np.maximum(self.square + self.space.largest - 2 * low, 0)) * (1 + 1e-9) + 2 * self.space.room

    def add(self, pivot: np.ndarray, dist: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """A part of the index, sorted by pivot and distance."""
        starts = np.flatnonzero(np.concatenate([[True], pivot[1:] != pivot[:-1]]))
        ends = np.append(starts[1:], len(pivot))
        rings = np.array([(a, min(a + RING, e)) for s, e in zip(starts, ends, strict=True) for a in range(s, e, RING)])
        if self.space.bounded:
            at = self.to_pivot[:, pivot[rings[:, 0]]]
            bound = np.maximum(np.maximum(dist[rings[:, 0]] - at, at - dist[rings[:, 1] - 1]), 0)
        else:
            bound = np.zeros((len(self.ids), len(rings)))
        reach = self.reach() if self.space.bounded else np.full(len(self.ids), np.inf)
        for r in np.argsort(bound.mean(axis=0), kind="stable"):
            who = np.flatnonzero(bound[:, r] <= reach)
            if not len(who):
                continue
            a, b = rings[r]
            if self._score(who, ids[a:b], x[a:b].astype(np.float64)) and self.space.bounded:
                reach = self.reach()

    def _score(self, who: np.ndarray, ids: np.ndarray, x: np.ndarray) -> bool:
        """Holds vectors against queries; whether bounds have risen."""
        dimension = x.shape[1]
        sure = dimension * float(np.abs(x).max(initial=0)) * float(self.most[who].max()) < _EXACT
        with np.errstate(over="ignore", invalid="ignore"):
            score = self.q[who] @ x.T
            if sure:
                good = score >= self.least[who][:, None]
            else:
                off = (dimension + 2) * 2.0**-51 * (np.abs(self.q[who]) @ np.abs(x).T)
                good = ~(score + off < self.least[who][:, None])
        good &= ids[None, :] != self.ids[who][:, None]
        i, j = np.nonzero(good)
        if not len(i):
            return False
        values = score[i, j].astype(np.int64) if sure else np.array([exact(self.q[who[a]], x[b]) for a, b in zip(i, j, strict=True)], dtype=object)
        self.hits.append((who[i], ids[j], values))
        self.held += len(i)
        if self.held < HITS:
            return False
        self._prune()
        return True

    def _prune(self) -> None:
        q, ids, values = self.best()
        self.hits, self.held = [(q, ids, values)], 0
        last = np.flatnonzero(np.append(q[1:] != q[:-1], True))
        full = last[(last >= self.top - 1) & (q[np.maximum(last - self.top + 1, 0)] == q[last])]
        # A bound may be too low, never too high.
        for k in full:
            value = float(values[k])
            self.least[q[k]] = max(self.least[q[k]], value if abs(value) < _EXACT else value - abs(value) * 2.0**-52)

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, id, score) of the best k of each query, best first."""
        if not self.hits:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        q, ids = (np.concatenate([h[k] for h in self.hits]) for k in (0, 1))
        values = np.concatenate([h[2] for h in self.hits])
        if values.dtype == object:
            order = np.array(sorted(range(len(q)), key=lambda k: (q[k], -values[k], ids[k])))
        else:
            order = np.lexsort((ids, -values, q))
        q, ids, values = q[order], ids[order], values[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = place < self.top
        return q[keep], ids[keep], values[keep]


_INDEX = "vec_id long, vec array<double>, dim int, pivot int, dist double"


def top_inner_products(
    embeddings: DataFrame, step: int = QUERY_STEP, top: int = TOP, pivots: int = PIVOTS, sample: int = SAMPLE, block: int = BLOCK
) -> DataFrame:
    """The ``top`` best other rows of every row whose id ``step`` divides, ties to smaller ids.

    See integer_vectors() for rows that take no part. A query's candidates are the vectors of its own
    dimension. Rows that repeat an id are each candidates of other queries, and none of its own; as a query
    such an id has the smallest of its vectors. Fewer candidates than ``top`` give all; none, and an empty
    table, give no rows. A score beyond a long is the nearest long. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    vectors = written(integer_vectors(embeddings), "vectors")
    schema = "query_id long, rank int, vec_id long, score long"
    some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(sample).collect()
    if not some:
        return spark.createDataFrame([], schema)
    square = F.aggregate("vec", F.lit(0).cast("double"), lambda a, v: a + v * v)
    spaces, known = {}, {}
    # One row a dimension.
    for d, largest in vectors.groupBy(F.size("vec").alias("d")).agg(F.max(square)).collect():
        own = [r for r in some if len(r["vec"]) == d]
        matrix = np.array([r["vec"] for r in own], dtype=np.float64).reshape(len(own), d)
        spaces[d], known[d] = Space(matrix, float(largest), pivots), (np.array([r["vec_id"] for r in own], dtype=np.int64), matrix)
    shared = spark.sparkContext.broadcast((spaces, known))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces, _ = shared.value
        for batch in batches:
            pivot, dist = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows)
            for rows, x in _by_dimension(batch.column("vec")):
                pivot[rows], dist[rows] = spaces[x.shape[1]].place(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("vec"), pa.array(_lengths(batch.column("vec")), pa.int32()), pa.array(pivot), pa.array(dist)],
                names=["vec_id", "vec", "dim", "pivot", "dist"],
            )

    order = ["dim", "pivot", "dist", "vec_id"]
    index = written(vectors.mapInArrow(lean(place), _INDEX).repartitionByRange(*order).sortWithinPartitions(*order), "pivot-index")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bound from the sample: its k-th best score is no better than the k-th best of all."""
        _, known = shared.value
        for batch in batches:
            least = np.full(batch.num_rows, -np.inf)
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            for rows, x in _by_dimension(batch.column("vec")):
                known_ids, matrix = known[x.shape[1]]
                if len(known_ids) < top:
                    continue
                for at in range(0, len(rows), 512):
                    part = rows[at : at + 512]
                    with np.errstate(over="ignore", invalid="ignore"):
                        score = x[at : at + 512] @ matrix.T
                        score -= (x.shape[1] + 2) * 2.0**-51 * (np.abs(x[at : at + 512]) @ np.abs(matrix).T)
                    score[(ids[part][:, None] == known_ids[None, :]) | ~np.isfinite(score)] = -np.inf
                    least[part] = np.floor(np.sort(score, axis=1)[:, -top])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vec"), pa.array(least)], names=["vec_id", "vec", "least"])

    asked = vectors.filter(F.pmod("vec_id", F.lit(step)) == 0).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    asked = written(asked.mapInArrow(lean(bounded), "vec_id long, vec array<double>, least double"), "queries", maxRecordsPerFile=str(block))
    files = sorted(asked.inputFiles())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces, _ = shared.value
        for part in _parts(batches):
            yield from _searched(part, files, spaces, top)

    found = index.mapInArrow(lean(search), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Parts of the index of one dimension each: (dimension, pivots, distances, ids, vectors) runs of batches."""
    held, n, dimension = [], 0, None
    for batch in batches:
        dims = batch.column("dim").to_numpy(zero_copy_only=False)
        for at in np.flatnonzero(np.concatenate([[True], dims[1:] != dims[:-1]])) if len(dims) else ():
            own = batch.slice(at, int(np.searchsorted(dims, dims[at], "right")) - at)
            if held and (dims[at] != dimension or n >= PART):
                yield held
                held, n = [], 0
            dimension = dims[at]
            (_, x), *_ = _by_dimension(own.column("vec"))
            with np.errstate(over="ignore"):
                small = x.astype(np.float32)
            x = small if (small == x).all() else x
            held.append((int(dimension), *(own.column(c).to_numpy(zero_copy_only=False) for c in ("pivot", "dist", "vec_id")), x))
            n += x.size + len(x)
    if held:
        yield held


def _searched(part: list[tuple], files: list[str], spaces: dict, top: int) -> Iterator[pa.RecordBatch]:
    """The best of one part of the index for the queries of all files."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    dimension = part[0][0]
    pivot, dist, ids = (np.concatenate([p[k] for p in part]) for k in (1, 2, 3))
    x = np.concatenate([p[4] for p in part])
    for file in files:
        fs, path = pafs.FileSystem.from_uri(file)
        queries = pq.read_table(path, filesystem=fs).combine_chunks()
        own = queries.filter(pa.array(_lengths(queries.column("vec").combine_chunks()) == dimension))
        if not own.num_rows:
            continue
        (_, q), *_ = _by_dimension(own.column("vec").combine_chunks())
        query_ids, least = (own.column(c).to_numpy() for c in ("vec_id", "least"))
        run = Searcher(query_ids, q, least, spaces[dimension], top)
        run.add(pivot, dist, ids, x)
        who, found, score = run.best()
        if len(who):
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[who]), pa.array(found), pa.array(score.tolist(), pa.int64())], names=["query_id", "vec_id", "score"])


def op7_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
