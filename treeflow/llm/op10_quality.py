"""Quality scores: random-indexing word vectors pooled per document, and a small calibrated network.

Random indexing: every word, and every word shape (letters, digits and marks with runs collapsed), has a
sparse random index vector; a word's vector is the sum of the index vectors of its neighbours in all
texts, normalised, plus its own. Words are hashed into a fixed number of rows, so the vectors
have a fixed size (8 MB) at any vocabulary. A document is the mean of its words' and of its shapes'
vectors and a few ratios of its whole text. The network has one hidden layer and is written in numpy;
its logits are divided by a temperature fitted on a part of the sample that it hasn't seen.

Neighbours are counted over every document, labelled or not: a task adds up one table of whole numbers, and the
tables are summed per row, so the vectors don't depend on how texts are dealt to tasks. The fit of the network uses a
sample of labelled rows of at most SAMPLE documents, chosen by a hash of the id; scoring reads every text once,
whole, and shuffles nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeflow.llm.bpe import Cache
from treeflow.llm.common import id_crc, lean, prefiltered, sized_batches, table, text_bytes, written

#: The bound of the labelled sample.
SAMPLE = 12_000
#: Rows are held out if crc32 of the id's text modulo 3 leaves 1.
FOLDS, HELD_OUT = 3, 1
ROWS, DIM, NONZERO = 1 << 15, 64, 8
WINDOW = 2
HIDDEN, EPOCHS, RATE, DECAY = 32, 30, 3e-3, 1e-4
#: Text bytes that are pooled at a time.
BLOCK = 2_000_000
EXTRAS = 8
#: Tokens whose surroundings are added up at a time: few enough that 32-bit sums of whole numbers are exact.
_AROUND = 1 << 16

_LETTERS = re.compile(rb"[a-z\x80-\xff]+")
_CAPITALS = re.compile(rb"[A-Z]+")
_DIGITS = re.compile(rb"[0-9]+")


def _rows_of(token: bytes) -> int:
    """The rows of a word and of its shape, as one number."""
    plain = token.islower() and token.isalpha()
    shape = b"a" if plain else _DIGITS.sub(b"0", _CAPITALS.sub(b"A", _LETTERS.sub(b"a", token)))
    half = ROWS // 2
    return (xxhash.xxh3_64_intdigest(token) % half) * ROWS + half + xxhash.xxh3_64_intdigest(shape, 1) % half


_token_rows = Cache(_rows_of, 150_000)


def _forget() -> None:
    _token_rows.clear()


def index_vectors() -> np.ndarray:
    """Sparse random vectors of -1 and 1, the same everywhere."""
    random = np.random.default_rng(20240601)
    out = np.zeros((ROWS, DIM), dtype=np.float32)
    place = random.integers(0, DIM, (ROWS, NONZERO))
    out[np.arange(ROWS)[:, None], place] = random.choice([-1.0, 1.0], (ROWS, NONZERO))
    return out


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word rows, shape rows, tokens per text, and ratios of each text."""
    counts, flat = np.zeros(len(texts), dtype=np.int64), []
    extras = np.zeros((len(texts), EXTRAS), dtype=np.float32)
    for i, text in enumerate(texts):
        words = text.split()
        n = counts[i] = len(words)
        flat.append(np.fromiter(map(_token_rows.__getitem__, words), np.int64, n))
        size = max(1, len(text))
        data = np.frombuffer(text, dtype=np.uint8)
        upper = np.count_nonzero((data >= 65) & (data <= 90))
        letters = upper + np.count_nonzero((data >= 97) & (data <= 122)) + np.count_nonzero(data >= 128)
        digits = np.count_nonzero((data >= 48) & (data <= 57))
        blank = np.count_nonzero(data <= 32)
        lines = text.split(b"\n")
        extras[i] = (
            np.log1p(n), len(set(words)) / max(1, n), len(set(lines)) / len(lines), upper / size, letters / size,
            digits / size, (size - letters - digits - blank) / size, np.log1p(size / max(1, n)),
        )
    both = np.concatenate(flat) if flat else np.empty(0, dtype=np.int64)
    return both // ROWS, both % ROWS, counts, extras


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Mean word vector, mean shape vector and ratios of each text."""
    words, shapes, counts, extras = tokens_of(texts)
    out = np.zeros((len(texts), 2 * DIM + EXTRAS), dtype=np.float32)
    ends = np.cumsum(counts)
    for i, (b, e) in enumerate(zip(ends - counts, ends, strict=True)):
        if e > b:
            out[i, :DIM] = vectors[words[b:e]].mean(axis=0)
            out[i, DIM : 2 * DIM] = vectors[shapes[b:e]].mean(axis=0)
    out[:, 2 * DIM :] = extras
    return out


def _sums(own: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and the sums of their rows of values."""
    order = np.argsort(own.astype(np.uint16), kind="stable")  # ROWS at most: a radix sort
    own = own[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return own[first], np.add.reduceat(values[order].astype(np.float32), first, axis=0)


def _neighbours(texts: list[bytes], index: np.ndarray) -> np.ndarray:
    """Sums of the index vectors of the words around each row's words, and of the shapes of its shapes.

    Words are added up token by token; shapes, of which there are few, by how often two are neighbours.
    """
    out = np.zeros((ROWS, DIM), dtype=np.int64)
    blank = [ROWS * ROWS + ROWS] * WINDOW  # between texts: a row of zeros, for word and shape
    flat = list(blank)
    for text in texts:
        flat.extend(map(_token_rows.__getitem__, text.split()))
        flat.extend(blank)
    both = np.array(flat, dtype=np.int64)
    vectors = np.vstack([index, np.zeros((1, DIM))]).astype(np.int8)
    rows = np.minimum(both // ROWS, ROWS)
    for at in range(WINDOW, len(rows) - WINDOW, _AROUND):
        end = min(at + _AROUND, len(rows) - WINDOW)
        near = vectors[rows[at - WINDOW : end + WINDOW]]
        n = end - at
        around = near[:n].copy()
        for k in range(1, 2 * WINDOW + 1):
            if k != WINDOW:
                around += near[k : k + n]
        own, sums = _sums(rows[at:end], around)
        some = own < ROWS
        out[own[some]] += sums[some].astype(np.int64)
    rows = np.where(both >= ROWS * ROWS, ROWS, both % ROWS).astype(np.uint32)
    pairs = []
    for k in range(1, WINDOW + 1):
        a, b = rows[:-k], rows[k:]
        inside = (a < ROWS) & (b < ROWS)
        pairs.append(a[inside] * np.uint32(ROWS) + b[inside])
    code, count = np.unique(np.concatenate(pairs), return_counts=True)
    for own, other in ((code // ROWS, code % ROWS), (code % ROWS, code // ROWS)):
        for at in range(0, len(own), _AROUND):
            part = slice(at, at + _AROUND)
            order = np.argsort(own[part], kind="stable")
            sorted_ = own[part][order]
            first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
            weighted = index[other[part][order]].astype(np.float64) * count[part][order, None]
            out[sorted_[first]] += np.add.reduceat(weighted, first, axis=0).astype(np.int64)
    return out


def _all_neighbours(documents: DataFrame, index: np.ndarray) -> np.ndarray:
    """The neighbours' sums over all documents: one row of DIM whole numbers for each of ROWS."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((ROWS, DIM), dtype=np.int64)
        for batch in sized_batches(batches, BLOCK):
            total += _neighbours(text_bytes(batch), index)
        most = np.abs(total).max(axis=1)
        low = 0
        for kind in (np.int8, np.int16, np.int32, np.int64):  # the length of the value tells which
            high = np.iinfo(kind).max
            some = np.flatnonzero((most > low) & (most <= high))
            low = high
            for at in range(0, len(some), 4096):
                part = some[at : at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([v.tobytes() for v in total[part].astype(kind)], pa.binary())], names=["row", "v"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for batch in batches:
            for row, v in zip(batch.column("row").to_pylist(), batch.column("v").to_pylist(), strict=True):
                total[row] = total.get(row, 0) + np.frombuffer(v, dtype=f"i{len(v) // DIM}").astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["row", "v"])

    schema = "row long, v binary"
    total = np.zeros((ROWS, DIM), dtype=np.float64)
    # Of fixed size: one vector per row.
    for r in documents.select("text").mapInArrow(lean(sums, _forget), schema).repartition("row").mapInArrow(lean(merged), schema).collect():
        total[r["row"]] = np.frombuffer(r["v"], dtype=np.int64)
    return total


@dataclass
class Network:
    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(((x - self.mean) / self.spread) @ self.w1 + self.b1, 0)
        return (h @ self.w2 + self.b2) / self.temperature

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def trained(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the logistic loss over four fifths of the rows; the temperature on the last fifth."""
    random = np.random.default_rng(7)
    order = random.permutation(len(x))
    cut = max(1, len(x) * 4 // 5)
    fit, rest = order[:cut], order[cut:]
    mean, spread = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
    share = float(np.clip(y[fit].mean(), 1e-3, 1 - 1e-3))
    net = Network(
        mean, spread, random.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
        random.normal(0, HIDDEN**-0.5, HIDDEN) * 0.1, float(np.log(share / (1 - share))),
    )
    parameters = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    z, step = (x - mean) / spread, 0
    for _ in range(EPOCHS):
        for at in np.array_split(random.permutation(fit), max(1, len(fit) // 128)):
            a = z[at] @ parameters[0] + parameters[1]
            h = np.maximum(a, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ parameters[2] + parameters[3][0], -40, 40)))
            g = (p - y[at]) / len(at)
            back = np.outer(g, parameters[2]) * (a > 0)
            grads = [z[at].T @ back, back.sum(axis=0), h.T @ g, np.array([g.sum()])]
            step += 1
            for k, grad in enumerate(grads):
                grad = grad + DECAY * parameters[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                parameters[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = parameters[0], parameters[1], parameters[2], float(parameters[3][0])
    if len(rest) >= 50 and 0 < y[rest].mean() < 1:
        logit = net.logits(x[rest])
        loss = lambda t: np.logaddexp(0, np.where(y[rest] > 0, -logit, logit) / t).mean()
        net.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))
    return net


def fitted(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """(word vectors of all texts, network fitted on at most ``sample`` labelled rows outside the held-out fold).

    Without labelled rows, or with one class only, the network is None.
    """
    spark = documents.sparkSession
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (id_crc() % FOLDS != HELD_OUT))
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    chosen = written(chosen, "quality-sample")
    rows = prefiltered(documents.select("doc_id", "text"), "doc_id", chosen).join(F.broadcast(chosen), "doc_id")
    rows = written(rows.repartition(8, "doc_id"), "quality-texts")
    index = index_vectors()
    total = _all_neighbours(documents, index)
    length = np.linalg.norm(total, axis=1, keepdims=True)
    vectors = (total / np.maximum(length, 1e-6) + index / NONZERO**0.5).astype(np.float32)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, BLOCK):
            x = pooled(text_bytes(batch), vectors)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("quality").cast(pa.int32()), pa.array([v.tobytes() for v in x], pa.binary())],
                names=["doc_id", "quality", "x"],
            )

    found = rows.mapInArrow(lean(features, _forget), "doc_id long, quality int, x binary").collect()
    found.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    y = np.array([r["quality"] for r in found], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return vectors, None
    return vectors, trained(np.array([np.frombuffer(r["x"], dtype=np.float32) for r in found], dtype=np.float64), y)


def _applied(documents: DataFrame, model, schema: str, emit) -> DataFrame:
    vectors, network = model
    shared = documents.sparkSession.sparkContext.broadcast((vectors, network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        for batch in sized_batches(batches, BLOCK):
            x = text_bytes(batch)
            score = network.scores(pooled(x, vectors).astype(np.float64)) if network is not None else np.full(len(x), 0.5)
            yield emit(batch, score)

    return documents.mapInArrow(lean(run, _forget), schema)


def quality_scores(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document row: score, prediction, and whether the row was held out from learning.

    ``documents(doc_id, text)``, ``labels(doc_id, quality)``; other columns are no inputs. A null text is
    an empty one and is scored by the text's ratios alone. Labels other than 0 and 1 are ignored; of
    several of one id the largest counts; without both classes every score is 0.5. A null id isn't held
    out. Repeated rows get equal scores; an empty table gives no rows.
    """
    rows = documents.select("doc_id", "text", F.coalesce(id_crc() % FOLDS == HELD_OUT, F.lit(False)).alias("held_out"))

    def emit(batch: pa.RecordBatch, score: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
            names=["doc_id", "held_out", "score", "predicted"],
        )

    return _applied(rows, fitted(documents, labels, sample), "doc_id long, held_out boolean, score double, predicted int", emit)


def accepted(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows predicted 1, all columns kept; each row is judged by its own text in the pass that reads it."""
    emit = lambda batch, score: batch.filter(pa.array(score >= 0.5))
    return _applied(documents, fitted(documents, labels, sample), documents.schema, emit)


def op10_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
