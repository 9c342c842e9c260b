"""A hierarchical Pitman-Yor language model, sampled by Gibbs sweeps over the whole training corpus.

Restaurants: one for every word that comes before another (and one for the start of a text), and one
above them all that they share as their parent; its base is uniform over the vocabulary and one unknown
word. A context is the word before itself, so there are as many restaurants as training words.

A cell is a word in a context. A sweep seats the customers of every cell anew, one after the other,
given the parent's predictive probability, then those of the parent, which are the tables below. A cell
of one customer always has one table, so only cells of several customers take part in a sweep; the
others are counted once, for their word and for their context. Draws come from a hash of word, context,
sweep and customer, so the sample doesn't depend on how rows are dealt to tasks. Probabilities are
averaged over the samples.

Cells of several customers lie in groups by a hash of word and context, so a frequent word or context is
spread over all tasks; words lie in classes by a hash of the word. Both are packed rows of a bounded number
of entries, on average. What a cell needs (its context's tables, its word's customers and tables above) comes
as one number for every distinct word of a group: a class keeps which of its words each group has, and answers
with a packed row; a group sends back the tables per word likewise. So a sweep is two shuffles of packed rows,
and no row is joined.

Words travel as 48-bit hashes (a million words collide once in 500 corpora) and never as texts; the texts
are never shuffled. A task sums its cells for chunks of texts, packs them by ranges of the cells' hashes and
sends them once to where all chunks' counts of a range meet. There a cell's total is known, so what goes on
is small: the cells of several customers, sums per word, and per chunk which of its cells occur never, once
or more often in training. After the sweeps only the last are looked up. Vocabulary and counts are never
gathered in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeflow.llm.common import drop, id_crc, lean, scratch, shuffles_released, sized_batches, table, written

#: A document is held out if crc32 of its id's text leaves no remainder.
HELD_OUT_MOD = 10
SWEEPS, BURN = 4, 2
#: Concentrations of the parent and of the context restaurants.
THETA = (1.0, 1.0)
#: Text bytes of one chunk.
CHUNK_BYTES = 24_000_000
#: A row's id: task, chunk and place of the row in the chunk.
_TASK_BITS, _CHUNK_BITS = 40, 28
#: Cells travel in rows of one part of the range of their keys; words in such rows behind those of the cells.
_BUCKET_BITS = 13
_WORD_BUCKETS = 1 << _BUCKET_BITS
#: Cells that are summed up at once.
_SUMMED = 1_000_000
#: Packed bytes of whole buckets that are worked on at once.
_WHOLE_BYTES = 4_000_000
_WORD_BITS = 48
_CELL = np.dtype([("w", "<u4"), ("w_high", "<u2"), ("u", "<u4"), ("u_high", "<u2")])
_SEVERAL = np.dtype([("w", "<i8"), ("u", "<i8"), ("c", "<i8")])
#: Per word: training count, customers it has as a context, its cells of one customer as a word and as a context, and all its cells.
_SUM = np.dtype([(x, "<i8") for x in ("w", "c", "cu", "n1", "s1", "n", "tu")])
_WORD = np.dtype([("w", "<u8"), ("c", "<i8"), ("cu", "<i8")])
_WORTH = np.dtype([("key", "<u8"), ("v", "<f4")])
#: Cells of several customers of one group, and partial sums per word of one class, about; groups and classes are 2^4 at least.
GROUP_CELLS, CLASS_SUMS, _LEAST_BITS = 400_000, 400_000, 4
#: Kinds of packed rows.
_CELLS, _ROUTES, _STATIC, _WORDS, _MESSAGES, _TABLES, _SAMPLE = range(7)
#: For Spark's Parquet writer: packed values don't repeat.
_PLAIN = {"parquet.enable.dictionary": "false"}
#: What rows that answer no chunk hold, in place of a row's id.
_MODEL, _SEVERAL_ROWS, _SUM_ROWS = -1, -2, -3
_END, _START = np.uint64(0x79B97F4A7C15), np.uint64(0x14F22545F491)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _key(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """One number for a word in a context."""
    return _mix(words + contexts.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def _split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and all the words: ``common.space_words`` of whole columns."""
    low = pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), ""))
    words = pc.ascii_split_whitespace(low)
    found = words.flatten()
    some = np.diff(np.frombuffer(found.buffers()[1], dtype=np.int32)[found.offset : found.offset + len(found) + 1]) > 0
    counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    if not some.all():  # at the ends of texts, and of texts without words
        ends = np.cumsum(counts)
        whole = np.concatenate([[0], np.cumsum(some)])
        counts, found = whole[ends] - whole[ends - counts], found.filter(pa.array(some))
    return counts, found


class Chunk:
    """Tokens of some documents: numbers of their words, the words' hashes, and where each document ends."""

    def __init__(self, batches: list[pa.RecordBatch]):
        counts, words = _split(pa.concat_arrays([b.column("text") for b in batches]))
        words = words.dictionary_encode()
        self.lengths = counts + 1
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.ids = np.ones(int(self.lengths.sum()), dtype=np.int32)
        inside = np.ones(len(self.ids), dtype=bool)
        inside[self.begins + counts] = False
        self.ids[inside] = words.indices.to_numpy(zero_copy_only=False) + 2
        words = words.dictionary.cast(pa.binary()).to_pylist()
        self.hashes = np.empty(len(words) + 2, dtype=np.uint64)
        self.hashes[:2] = _START, _END  # the start and the end of a text
        self.hashes[2:] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) & np.uint64((1 << _WORD_BITS) - 1)

    def contexts(self) -> np.ndarray:
        """The number of the word before each."""
        out = np.zeros_like(self.ids)
        out[1:] = self.ids[:-1]
        out[self.begins] = 0
        return out

    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order of tokens by their cells' keys, where in it each cell begins, and the cells' keys."""
        key = _key(self.hashes[self.ids], self.hashes[self.contexts()])
        order = np.argsort(key).astype(np.int32)
        key = key[order]
        cell = _begins(key)
        return order, cell, key[cell]

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes in the order of their mixed values, and each word's place among them."""
        words, at = np.unique(_mix(self.hashes), return_inverse=True)
        out = np.empty(len(words), dtype=np.uint64)
        out[at] = self.hashes
        return out, at.astype(np.int32)


def _pack_cells(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    out = np.empty(len(words), dtype=_CELL)
    for name, x in (("w", words), ("u", contexts)):
        out[name], out[name + "_high"] = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)
    return out


def _unpack_cells(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = lambda name: cells[name].astype(np.uint64) | (cells[name + "_high"].astype(np.uint64) << np.uint64(32))
    return word("w"), word("u")


def _begins(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)


def _buckets(ordered_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of keys, and how many keys each has."""
    bucket = (ordered_keys >> np.uint64(64 - _BUCKET_BITS)).astype(np.int32)
    first = _begins(bucket)
    return bucket[first], np.diff(np.append(first, len(bucket)))


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Batches gathered to chunks of about ``most`` text bytes; the same rows give the same chunks."""
    waiting, n, number = [], 0, 0
    for batch in sized_batches(batches, most // 8):
        waiting.append(batch)
        n += batch.column("text").nbytes
        if n >= most:
            yield number, waiting
            waiting, n, number = [], 0, number + 1
    if waiting:
        yield number, waiting


def _packed(lengths: np.ndarray, values: np.ndarray, kind: str) -> pa.Array:
    """Runs of numbers as one binary value each."""
    data = np.ascontiguousarray(values.astype(kind))
    offsets = np.concatenate([[0], np.cumsum(lengths * data.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _unpacked(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the runs, and all their numbers."""
    column = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
    if not len(column):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=kind)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return np.diff(offsets).astype(np.int64) // size, np.frombuffer(raw.tobytes(), dtype=kind)


def _longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


_ROWS = "bucket int, id long, a binary, n binary"
_KIND_ROWS = "kind int, " + _ROWS


def _rows(bucket: np.ndarray, lengths: np.ndarray, ids: np.ndarray, a: np.ndarray, kind, n: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Packed rows, some at a time."""
    ends = np.cumsum(lengths)
    for at in range(0, len(bucket), 1024):
        rows = slice(at, at + 1024)
        own = slice(int(ends[at] - lengths[at]), int(ends[rows][-1]))
        counts = pa.nulls(len(bucket[rows]), pa.binary()) if n is None else _packed(lengths[rows], n[own], "<u4")
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[rows].astype(np.int32)), pa.array(ids[rows].astype(np.int64)), _packed(lengths[rows], a[own], kind), counts], names=["bucket", "id", "a", "n"]
        )


def _counted(documents: DataFrame, chunk_bytes: int) -> DataFrame:
    """Per chunk and bucket its cells with their training counts, and its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        for number, group in _chunks(batches, chunk_bytes):
            chunk = Chunk(group)
            train = ~np.concatenate([np.asarray(b.column("held_out").to_pylist(), dtype=bool) for b in group])
            order, cell, key = chunk.cells()
            n = np.add.reduceat(np.repeat(train, chunk.lengths)[order].astype(np.int32), cell)
            cells = _pack_cells(chunk.hashes[chunk.ids[order[cell]]], chunk.hashes[chunk.contexts()[order[cell]]])
            base = (p << _TASK_BITS) + (number << _CHUNK_BITS)
            asked, _ = chunk.asked()
            chunk = order = cell = None
            bucket, lengths = _buckets(_mix(asked))
            bucket = bucket.astype(np.int64) + _WORD_BUCKETS
            yield from _rows(bucket, lengths, base + bucket, asked, "<u8")
            bucket, lengths = _buckets(key)
            yield from _rows(bucket, lengths, base + bucket.astype(np.int64), cells, _CELL, n)

    return documents.mapInArrow(lean(run), _ROWS)


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that come by bucket, cut where a bucket ends, and so that their packed values stay small."""
    held = None
    for batch in batches:
        now = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not now.num_rows:
            continue
        bucket = _longs(now.column("bucket"))
        first = _begins(bucket)
        last = int(first[-1])
        sizes = np.concatenate([[0], np.cumsum(pc.binary_length(now.column("a")).to_numpy(zero_copy_only=False))])
        start = 0
        for at in first[1:]:
            if sizes[at] - sizes[start] >= _WHOLE_BYTES or at == last:
                yield now.slice(start, int(at) - start)
                start = int(at)
        held = now.slice(last)
    if held is not None:
        yield held


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct number is found, in ascending order of the numbers, and every number's place among them."""
    order = np.argsort(values)
    first = _begins(values[order])
    place = np.empty(len(values), dtype=np.uint32)
    place[order] = np.repeat(np.arange(len(first), dtype=np.uint32), np.diff(np.append(first, len(values))))
    return order[first], place


def _summed(w: list[np.ndarray], u: list[np.ndarray], c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Cells summed per word and context, as packed rows."""
    w, u, c = (np.concatenate(x) for x in (w, u, c))
    both = np.concatenate([w, u])
    mixed = _mix(both)
    found, at = _distinct(mixed)
    out = np.zeros(len(found), dtype=_SUM)
    out["w"] = both[found].view(np.int64)
    one = (c == 1).astype(np.float64)
    for own, names in ((at[: len(w)], ("c", "n1", "n")), (at[len(w) :], ("cu", "s1", "tu"))):
        for name, value in zip(names, (c, one, None), strict=True):
            out[name] = np.bincount(own, value, minlength=len(found)).astype(np.int64)  # whole numbers below 2^53
    bucket, lengths = _buckets(mixed[found])
    yield from _rows(bucket, lengths, np.full(len(bucket), _SUM_ROWS), out, _SUM)


def _reduced(counts: DataFrame) -> DataFrame:
    """What is known where the counts of all chunks meet: see the module's text.

    Rows of cells come out with a code per cell (0, 1, 2: training customers, two at most) in ``n`` and the keys
    of those with code 2 in ``a``. Rows of words go through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        n_held = 0
        for whole in _whole_buckets(batches):
            bucket = _longs(whole.column("bucket"))
            cut = int(np.searchsorted(bucket, _WORD_BUCKETS))
            if cut < len(bucket):
                yield whole.slice(cut)
            if not cut:
                continue
            own = whole.slice(0, cut)
            lengths, cells = _unpacked(own.column("a"), _CELL)
            w, u = _unpack_cells(cells)
            key = _key(w, u)
            order = np.argsort(key)
            first = _begins(key[order])
            c = np.add.reduceat(_unpacked(own.column("n"), "<u4")[1][order].astype(np.int64), first)
            place = order[first]
            code = np.empty(len(key), dtype=np.uint8)
            code[order] = np.repeat(np.minimum(c, 2), np.diff(np.append(first, len(key))))
            several = code == 2
            ends = np.cumsum(lengths)
            k = np.concatenate([[0], np.cumsum(several)])
            yield pa.RecordBatch.from_arrays(
                [own.column("bucket"), own.column("id"), _packed(k[ends] - k[ends - lengths], key[several], "<u8"), _packed(lengths, code, "<u1")], names=["bucket", "id", "a", "n"]
            )
            w, u = w[place], u[place]
            some = c > 1
            out = np.empty(int(some.sum()), dtype=_SEVERAL)
            out["w"], out["u"], out["c"] = w[some].view(np.int64), u[some].view(np.int64), c[some]
            bucket, lengths = _buckets(key[place][some])
            yield from _rows(bucket, lengths, np.full(len(bucket), _SEVERAL_ROWS), out, _SEVERAL)
            some = c > 0
            for x, y in zip(held, (w, u, c), strict=True):
                x.append(y[some])
            n_held += int(some.sum())
            if n_held >= _SUMMED:
                yield from _summed(*held)
                held, n_held = ([], [], []), 0
        if n_held:
            yield from _summed(*held)

    return counts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(run), _ROWS)


@dataclass(frozen=True)
class Totals:
    """What a sweep needs of all restaurants, and customers and tables of the contexts at hand."""

    words: int
    parent_customers: float
    parent_tables: float
    customers: np.ndarray
    tables: np.ndarray


class Model:
    """Predictive probabilities and seating under given totals and discounts."""

    def __init__(self, totals: Totals, discounts: tuple[float, float]):
        self.d1, self.d2 = discounts
        self.base = 1.0 / (totals.words + 1)
        self.parent_strength = THETA[0] + self.d1 * totals.parent_tables
        self.parent_all = THETA[0] + totals.parent_customers
        self.strength = THETA[1] + self.d2 * totals.tables
        self.all = THETA[1] + totals.customers

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return self.parent_of(customers - self.d1 * tables)

    def parent_of(self, discounted: np.ndarray) -> np.ndarray:
        return (discounted + self.parent_strength * self.base) / self.parent_all

    def back_off(self) -> np.ndarray:
        """Weight of the parent in each context."""
        return self.strength / self.all

    def unknown(self) -> float:
        return self.parent_strength * self.base / self.parent_all

    def of(self, b, c, t, parent) -> np.ndarray:
        return (c - self.d2 * t) / self.all[b] + self.back_off()[b] * parent


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for positive numbers: Stirling's series after ten steps up."""
    z = x + 10.0
    up = x.copy()
    for k in range(1, 10):
        up *= x + k
    tail = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * z * z)) / (z * z)) / (z * z)) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + tail - np.log(up)


#: Customers that are tried one by one for each new table, and rows that are worked on one by one.
_WALK, _FEW = 8, 200


def seat(customers: np.ndarray, prior: np.ndarray, discount: float, salt: np.ndarray) -> np.ndarray:
    """Tables after seating each row's customers in turn; ``prior`` is strength times parent probability.

    A customer opens a table with probability prior / (prior + seated - discount * tables). Between two new
    tables the chance that m customers in a row open none is a ratio of gamma functions, so the one that opens
    the next is drawn at once, by one number per table, from exactly that law.
    """
    tables = (customers > 0).astype(np.int64)
    at = np.flatnonzero(customers > 1)
    c, p, s = customers[at], prior[at], salt[at]
    seated, t, step = np.ones(len(at), dtype=np.int64), np.ones(len(at), dtype=np.int64), 0
    while len(at) > _FEW:
        u = ((_mix(s + np.uint64(step * 2 + 1)) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
        a, left = seated - discount * t, c - seated
        gap, none = np.zeros(len(at), dtype=np.int64), np.ones(len(at))
        for j in range(_WALK):  # most gaps are short
            none *= (a + j) / (p + a + j)
            gap[(gap == 0) & (none < u) & (left > j)] = j + 1
            if ((gap > 0) | (left <= j + 1)).all():
                break
        far = np.flatnonzero((gap == 0) & (left > _WALK))
        if len(far):
            gap[far] = _opener(a[far], p[far], left[far], np.log(u[far]))
        opens = gap > 0
        seated, t, step = seated + gap, t + opens, step + 1
        going = opens & (seated < c)
        tables[at[~going]] = t[~going]
        at, c, p, s, seated, t = (x[going] for x in (at, c, p, s, seated, t))
    for row in zip(at.tolist(), c.tolist(), p.tolist(), s.tolist(), seated.tolist(), t.tolist(), strict=True):
        tables[row[0]] = _seat_one(*row[1:], discount, step)
    return tables


def _seat_one(customers: int, prior: float, salt: int, seated: int, tables: int, discount: float, step: int) -> int:
    """The tables of one row, of which some customers are seated; for rows with more tables than most."""
    full = (1 << 64) - 1
    while seated < customers:
        x = (salt + 2 * step + 1) & full
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
        u = (((x ^ (x >> 31)) >> 11) + 0.5) / (1 << 53)
        a, none, left, step = seated - discount * tables, 1.0, customers - seated, step + 1
        for j in range(min(_WALK, left)):
            none *= (a + j) / (prior + a + j)
            if none < u:
                gap = j + 1
                break
        else:
            gap, at, bound = 0, a + prior, math.log(u)
            from_ = math.lgamma(at) - math.lgamma(a) - bound
            if left > _WALK and math.lgamma(a + left) - math.lgamma(at + left) + from_ < 0:
                low, gap = _WALK, min(left, 2 * _WALK)
                while math.lgamma(a + gap) - math.lgamma(at + gap) + from_ >= 0:
                    low, gap = gap, min(left, 2 * gap)
                while gap - low > 1:
                    middle = (low + gap) // 2
                    if math.lgamma(a + middle) - math.lgamma(at + middle) + from_ < 0:
                        gap = middle
                    else:
                        low = middle
        if not gap:
            break
        seated, tables = seated + gap, tables + 1
    return tables


def _opener(a: np.ndarray, p: np.ndarray, left: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Which of the next ``left`` customers opens a table, 0 for none; one of the first _WALK doesn't."""
    from_ = log_gamma(p + a) - log_gamma(a)
    none_in = lambda m, k: log_gamma(a[k] + m) - log_gamma(p[k] + a[k] + m) + from_[k]
    out = np.zeros(len(a), dtype=np.int64)
    some = np.flatnonzero(none_in(left, slice(None)) < u)
    low, high = np.full(len(some), _WALK), np.minimum(left[some], 2 * _WALK)
    open_ = np.arange(len(some))
    while len(open_):  # double the range until it holds the opener, among (low, high]
        beyond = none_in(high[open_], some[open_]) >= u[some[open_]]
        open_ = open_[beyond]
        low[open_], high[open_] = high[open_], np.minimum(left[some[open_]], 2 * high[open_])
    open_ = np.flatnonzero(high - low > 1)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        found = none_in(middle, some[open_]) < u[some[open_]]
        high[open_[found]] = middle[found]
        low[open_[~found]] = middle[~found]
        open_ = open_[high[open_] - low[open_] > 1]
    out[some] = high
    return out


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each bucket, of batches that come by bucket."""
    held, number = [], None
    joined = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        bucket = _longs(batch.column("bucket"))
        first = _begins(bucket)
        for at, end in zip(first, np.append(first, len(bucket))[1:], strict=True):
            if held and bucket[at] != number:
                yield number, joined()
                held = []
            number = int(bucket[at])
            held.append(batch.slice(int(at), int(end - at)))
    if held:
        yield number, joined()


def _values(rows: pa.RecordBatch, of: np.ndarray, column: str, kind) -> np.ndarray:
    """The packed numbers of some rows, one after the other."""
    return _unpacked(rows.column(column).take(pa.array(np.flatnonzero(of))), kind)[1]


def _as_rows(kind: int, bucket, ids, a: pa.Array, n: pa.Array) -> pa.RecordBatch:
    rows = [pa.array(np.full(len(a), x) if np.isscalar(x) else x, pa.int64()) for x in (kind, bucket, ids)]
    return pa.RecordBatch.from_arrays([rows[0].cast(pa.int32()), rows[1].cast(pa.int32()), rows[2], a, n], names=["kind", "bucket", "id", "a", "n"])


def _one_row(kind: int, bucket: int, id_: int, a: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return _as_rows(kind, bucket, id_, *(pa.array([x.tobytes()], pa.binary()) for x in (a, n)))


def _by_class(mixed: np.ndarray, bits: int) -> np.ndarray:
    """How many of the words are of each class, by ascending mixed values."""
    return np.bincount((mixed >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)


class _Kinds:
    """Rows written to the shared folder by their kind."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self._treeflow_path = df.sparkSession, scratch(df.sparkSession, name)
        with shuffles_released(self.spark):
            df.write.partitionBy("kind").options(**_PLAIN).parquet(self._treeflow_path)

    def __call__(self, kind: int) -> DataFrame:
        return self.spark.read.schema(_KIND_ROWS).parquet(self._treeflow_path).filter(F.col("kind") == kind).drop("kind")

    def release(self, kind: int) -> None:
        drop(self.spark, f"{self._treeflow_path}/kind={kind}")


def _dealt(run, *frames: DataFrame) -> DataFrame:
    """``run`` over the rows of all frames, bucket by bucket and in the order of their ids."""
    rows = frames[0]
    for x in frames[1:]:
        rows = rows.unionAll(x)
    return rows.repartition("bucket").sortWithinPartitions("bucket", "id").mapInArrow(lean(run), _KIND_ROWS)


def _groups(several: DataFrame, group_bits: int, class_bits: int) -> DataFrame:
    """The cells of every group, with what they share: its words, and which of them each class has to answer for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows in _each(batches):
            cells = _unpacked(rows.column("a"), _SEVERAL)[1]
            words, places, mixed = [], [], []
            for name in ("w", "u"):
                x = np.ascontiguousarray(cells[name]).view(np.uint64)
                m = _mix(x)
                found, place = _distinct(m)
                words.append(x[found])
                places.append(place)
                mixed.append(m[found])
            yield _one_row(_CELLS, group, -3, *words)
            yield _one_row(_CELLS, group, -2, np.concatenate(places), np.ascontiguousarray(cells["c"]))
            lengths = [_by_class(m, class_bits) for m in mixed]
            some = np.flatnonzero(lengths[0] + lengths[1])
            yield _as_rows(_ROUTES, some, group, *(_packed(n[some], m, "<u8") for n, m in zip(lengths, mixed, strict=True)))

    several = several.select(F.shiftright("bucket", _BUCKET_BITS - group_bits).alias("bucket"), F.col("bucket").cast("long").alias("id"), "a", "n")
    return _dealt(run, several)


def _classes(sums: DataFrame, routes: DataFrame, class_bits: int) -> DataFrame:
    """The words of every class, with one table for every cell and one above, and their first messages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _each(batches):
            ids = _longs(rows.column("id"))
            sums = _values(rows, ids < 0, "a", _SUM)
            mixed = _mix(np.ascontiguousarray(sums["w"]).view(np.uint64))
            order = np.argsort(mixed)
            first = _begins(mixed[order])
            mixed = mixed[order][first]
            at = {x: np.add.reduceat(sums[x][order], first) for x in ("c", "cu", "n1", "s1", "n", "tu")}
            words = np.empty(len(first), dtype=_WORD)
            words["w"], words["c"], words["cu"] = sums["w"][order][first].view(np.uint64), at["c"], at["cu"]
            n = at["n"]
            known = np.array([at["c"].sum(), at["n1"].sum(), (n == 1).sum(), (n == 2).sum(), (n > 0).sum(), n.sum(), (n > 0).sum()], dtype=np.int64)
            yield _one_row(_WORDS, number, -1, words, known)
            yield _one_row(_STATIC, number, -3, np.ascontiguousarray(words["w"]), np.empty(0))
            yield _one_row(_STATIC, number, -2, at["n1"], at["s1"])
            groups = ids[ids >= 0]
            routes = rows.slice(len(ids) - len(groups))
            places, answers = [], []
            for column, x in (("a", n), ("n", at["tu"])):
                lengths, asked = _unpacked(routes.column(column), "<u8")
                place = np.searchsorted(mixed, asked)
                places.append(_packed(lengths, place, "<u4"))
                answers.append(_packed(lengths, x[place], "<f8"))
            yield _as_rows(_STATIC, number, groups, *places)
            yield _as_rows(_MESSAGES, groups, number, *answers)

    sums = sums.select(F.shiftright("bucket", _BUCKET_BITS - class_bits).alias("bucket"), F.lit(-1).cast("long").alias("id"), "a", "n")
    return _dealt(run, sums, routes)


def _seed(sweep: int) -> np.uint64:
    return np.uint64((sweep * 0x632BE59BD9B4E019) & ((1 << 64) - 1))


def _swept(frames: list[DataFrame], totals: Totals, discounts: tuple[float, float], sweep: int, class_bits: int, samples: int, last: bool) -> DataFrame:
    """The cells of several customers, seated anew: tables per word and context go back to the classes.

    ``samples`` counts those that this sweep completes; with any, sums of the cells' tables are kept too, in the last
    sweep what the cells are worth.
    """
    seed = _seed(sweep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows in _each(batches):
            ids = _longs(rows.column("id"))
            w, u = (_values(rows, ids == -3, x, "<u8") for x in ("a", "n"))
            at, beside = _values(rows, ids == -2, "a", "<u4").reshape(2, -1)
            c = _values(rows, ids == -2, "n", "<i8")
            above, tu = (_values(rows, ids >= 0, x, "<f8") for x in ("a", "n"))
            model = Model(replace(totals, customers=np.zeros(len(u)), tables=tu), discounts)
            parent = model.parent_of(above - model.d1 if sweep == 1 else above)  # at first one table each
            cell_w, cell_u = w[at], u[beside]
            t = seat(c, model.strength[beside] * parent[at], model.d2, _key(cell_w ^ seed, cell_u))
            packed = []
            for words, place in ((w, at), (u, beside)):
                tables = np.bincount(place, t, minlength=len(words))  # whole numbers below 2^53
                packed.append((_by_class(_mix(words), class_bits), tables))
            some = np.flatnonzero(packed[0][0] + packed[1][0])
            yield _as_rows(_TABLES, some, _WORD_BUCKETS + group, *(_packed(n[some], x, "<i8") for n, x in packed))
            if samples:
                t = t + _values(rows, ids == -1, "a", "<i8") if (ids == -1).any() else t
                if not last:
                    yield _one_row(_SAMPLE, group, -1, t, np.empty(0))
                    continue
                out = np.empty(len(c), dtype=_WORTH)
                out["key"], out["v"] = _key(cell_w, cell_u), c - model.d2 * t / samples
                bucket, lengths = _buckets(out["key"])
                yield _as_rows(_SAMPLE, bucket, _MODEL, packed_ := _packed(lengths, out, _WORTH), pa.nulls(len(packed_), pa.binary()))

    return _dealt(run, *frames)


def _resummed(frames: list[DataFrame], totals: Totals, discounts: tuple[float, float], sweep: int) -> DataFrame:
    """The words of all classes after a sweep of the cells, seated above anew, and their messages to the cells."""
    seed = _seed(sweep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(totals, discounts)
        for number, rows in _each(batches):
            ids = _longs(rows.column("id"))
            w = _values(rows, ids == -3, "a", "<u8")
            routes, back = (ids >= 0) & (ids < _WORD_BUCKETS), ids >= _WORD_BUCKETS
            groups, asked, own = ids[routes], [], []
            for column in ("a", "n"):
                lengths, place = _unpacked(rows.column(column).take(pa.array(np.flatnonzero(routes))), "<u4")
                once = _values(rows, ids == -2, column, "<i8")
                own.append(once + np.bincount(place, _values(rows, back, column, "<i8"), minlength=len(w)).astype(np.int64))
                asked.append((lengths, place))
            n, tu = own
            tw = seat(n, np.full(len(w), model.parent_strength * model.base), model.d1, _mix(w ^ seed))
            tw = np.where(n > 0, tw, 0)
            known = np.array([0, 0, 0, 0, (n > 0).sum(), n.sum(), tw.sum()], dtype=np.int64)
            yield _one_row(_SAMPLE, number, sweep, np.concatenate([n, tw, tu]), known)
            answers = (_packed(lengths, x[place], "<f8") for x, (lengths, place) in zip((n - model.d1 * tw, tu), asked, strict=True))
            yield _as_rows(_MESSAGES, groups, number, *answers)

    return _dealt(run, *frames)


def _known(rows: DataFrame) -> np.ndarray:
    """Training tokens, cells of one customer, words above of one and of two customers; words, and customers and tables above."""
    return sum((np.frombuffer(r["n"], dtype="<i8") for r in rows.select("n").toLocalIterator()), start=np.zeros(7, dtype=np.int64))


def _totals(known: np.ndarray) -> Totals:
    none = np.empty(0)
    return Totals(int(known[4]), float(known[5]), float(known[6]), none, none)


def _answered(queries: DataFrame, model: DataFrame, answer) -> DataFrame:
    """(id, v): ``answer(model rows, query rows)`` for every row of the queries, bucket by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_buckets(batches):
            ids = _longs(whole.column("id"))
            known, query = (whole.take(pa.array(np.flatnonzero(x))) for x in (ids < 0, ids >= 0))
            if query.num_rows:
                yield pa.RecordBatch.from_arrays([query.column("id"), answer(known, query)], names=["id", "v"])

    rows = queries.unionAll(model)
    return rows.repartition("bucket").sortWithinPartitions("bucket", "id").mapInArrow(lean(run), "id long, v binary")


def _cells_answered(queries: DataFrame, cells: DataFrame, discount: float) -> DataFrame:
    """For every row of cells: customers less the discounted tables, averaged."""

    def answer(known: pa.RecordBatch, query: pa.RecordBatch) -> pa.Array:
        model = np.sort(_unpacked(known.column("a"), _WORTH)[1], order="key")
        asked = _unpacked(query.column("a"), "<u8")[1]
        lengths, code = _unpacked(query.column("n"), "<u1")
        v = np.where(code == 0, 0.0, 1 - discount)  # a cell of one customer has one table
        v[code == 2] = model["v"][np.searchsorted(model["key"], asked)]
        return _packed(lengths, v, "<f4")

    return _answered(queries, cells, answer)


def _word_kind(samples: int) -> np.dtype:
    """A word's training count, what its context's customers are divided by, and of each sample its own probability above
    and its context's weight of it."""
    return np.dtype([("w", "<u8"), ("c", "<i8"), ("all", "<f4"), ("p", "<f4", (samples,)), ("back_off", "<f4", (samples,))])


def _answer_kind(samples: int) -> np.dtype:
    """As _word_kind(), without the word."""
    return np.dtype(_word_kind(samples).descr[1:])


def _words_answered(queries: DataFrame, words: list[DataFrame], samples: list[Totals], discounts: tuple[float, float]) -> DataFrame:
    """For every row of words what their probabilities are made of."""
    kind = _word_kind(len(samples))

    def filled(w, c, cu, each) -> np.ndarray:
        out = np.empty(len(w), dtype=kind)
        out["w"], out["c"], out["all"] = w, c, THETA[1] + cu
        for k, totals in enumerate(samples):
            n, tw, tu = each[3 * k : 3 * k + 3]
            model = Model(replace(totals, customers=cu, tables=tu), discounts)
            out["p"][:, k], out["back_off"][:, k] = model.parent(n, tw), model.back_off()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _each(batches):
            ids = _longs(rows.column("id"))
            own = _values(rows, ids < 0, "a", _WORD)
            each = _values(rows, ids >= 0, "a", "<i8").reshape(3 * len(samples), -1)
            out = filled(own["w"], own["c"], own["cu"], each)
            bucket, lengths = _buckets(_mix(own["w"]))
            yield _as_rows(0, bucket.astype(np.int64) + _WORD_BUCKETS, _MODEL, packed := _packed(lengths, out, kind), pa.nulls(len(packed), pa.binary()))

    none = np.zeros(1)
    unknown = filled(np.zeros(1, dtype=np.uint64), none, none, [none] * 3 * len(samples))

    def answer(known: pa.RecordBatch, query: pa.RecordBatch) -> pa.Array:
        model = _unpacked(known.column("a"), kind)[1]
        model = model[np.argsort(model["w"])]
        lengths, asked = _unpacked(query.column("a"), "<u8")
        at = np.searchsorted(model["w"], asked)
        at[np.append(model["w"], 0)[at] != asked] = len(model)
        out = np.empty(len(asked), dtype=_answer_kind(len(samples)))
        for name in out.dtype.names:
            out[name] = np.concatenate([model[name], unknown[name]])[at]
        return _packed(lengths, out, out.dtype)

    return _answered(queries, _dealt(run, *words).drop("kind"), answer)


def _scored(documents: DataFrame, folders: tuple[str, str], chunk_bytes: int, tokens: int, vocabulary: int, samples: int) -> DataFrame:
    kind = _answer_kind(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds
        import pyarrow.fs as pafs

        task, tables = TaskContext.get().partitionId(), None

        def own(k: int, number: int) -> pa.Array:
            low = (task << _TASK_BITS) + (number << _CHUNK_BITS)
            mine = (ds.field("id") >= low) & (ds.field("id") < low + (1 << _CHUNK_BITS))
            return tables[k].to_table(columns=["id", "v"], filter=mine).sort_by("id").column("v").combine_chunks()

        for number, group in _chunks(batches, chunk_bytes):
            if tables is None:
                found = [pafs.FileSystem.from_uri(f) for f in folders]
                tables = [ds.dataset(f"{root}/task={task}", filesystem=fs, format="parquet") for fs, root in found]
            chunk = Chunk(group)
            order, cell, key = chunk.cells()
            lengths, value = _unpacked(own(1, number), "<f4")
            if len(value) != len(cell) or not (lengths == _buckets(key)[1]).all():
                raise ValueError("the documents were not read in the same parts twice; write them to a table first")
            v = np.empty(len(order), dtype=np.float32)
            v[order] = np.repeat(value, np.diff(np.append(cell, len(order))))
            order = cell = key = value = None
            asked, place = chunk.asked()
            known = _unpacked(own(0, number), kind)[1]
            if len(known) != len(asked):
                raise ValueError("the documents were not read in the same parts twice; write them to a table first")
            known = known[place]  # as the chunk numbers its words
            above, back_off = np.ascontiguousarray(known["p"]).astype(np.float64), np.ascontiguousarray(known["back_off"]).astype(np.float64)
            customers, there = known["all"].astype(np.float64), (known["c"] > 0).astype(np.int64)
            base = np.log10((known["c"] + 0.1) / (tokens + 0.1 * (vocabulary + 1)))
            known, contexts = None, chunk.contexts()
            at = first = 0
            for batch in group:
                lengths = chunk.lengths[at : at + batch.num_rows]
                end = first + int(lengths.sum())
                begins = np.cumsum(lengths) - lengths
                word, before = chunk.ids[first:end], contexts[first:end]
                p = np.einsum("ij,ij->i", above[word], back_off[before]) / samples + v[first:end] / customers[before]
                n_known, base_score, score = (np.add.reduceat(y, begins) for y in (there[word], base[word], np.log10(p)))
                at, first = at + batch.num_rows, end
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(lengths), pa.array(n_known),
                    pa.array(np.full(batch.num_rows, tokens, dtype=np.int64)), pa.array(base_score), pa.array(score),
                ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return documents.mapInArrow(
        lean(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def _twice(cells: DataFrame) -> int:
    """Cells of two customers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int((_unpacked(batch.column("n"), "<i8")[1] == 2).sum())], pa.int64())], names=["twice"])

    return cells.filter("id = -2").select("n").mapInArrow(lean(run), "twice long").agg(F.sum("twice")).first()[0] or 0


def language_scores(
    documents: DataFrame, stable: bool = False, sweeps: int = SWEEPS, burn: int = BURN, chunk_bytes: int = CHUNK_BYTES,
    group_cells: int = GROUP_CELLS, class_sums: int = CLASS_SUMS,
) -> DataFrame:
    """One row per document row: log10 probability of its text under the model, and the base's.

    ``documents(doc_id, text)``; other columns are ignored. ``stable`` says that the rows come straight
    from files, so that reading twice gives the same parts; others are written to a table first. A null
    text is an empty one: its end is its only token. A null id counts as training. Repeated rows count
    as often as they are there. Without training tokens every word has the base probability; an empty
    table gives no rows.
    """
    spark = documents.sparkSession
    held_out = F.coalesce(id_crc() % HELD_OUT_MOD == 0, F.lit(False))
    rows = documents.select("doc_id", "text", held_out.alias("held_out"))
    if not stable:
        rows = written(rows, "lm-documents")
    counts = written(_reduced(_counted(rows, chunk_bytes)), "lm-counts", compression="zstd", **_PLAIN)
    several, sums = (counts.filter(F.col("id") == x) for x in (_SEVERAL_ROWS, _SUM_ROWS))
    sizes = {r[0]: r[1] for r in counts.filter(F.col("id") < 0).groupBy("id").agg(F.sum(F.octet_length("a"))).collect()}
    bits = lambda rows, kind, most: min(_BUCKET_BITS, max(_LEAST_BITS, math.ceil(math.log2(max(1, sizes.get(rows, 0) / kind.itemsize / most)))))
    group_bits, class_bits = bits(_SEVERAL_ROWS, _SEVERAL, group_cells), bits(_SUM_ROWS, _SUM, class_sums)
    groups = _Kinds(_groups(several, group_bits, class_bits), "lm-cells")
    classes = _Kinds(_classes(sums, groups(_ROUTES), class_bits), "lm-words")
    # Discounts from how many cells, and how many words above, have one and two customers.
    known = _known(classes(_WORDS))
    tokens, once, above_once, above_twice = (int(x) for x in known[:4])
    twice = _twice(groups(_CELLS))
    discount = lambda once, twice: min(0.95, max(0.05, once / max(1.0, once + 2 * twice)))
    discounts = (discount(above_once, above_twice), discount(once, twice))
    totals = _totals(known)
    groups.release(_ROUTES)
    samples, words, messages, before = [], [classes(_WORDS)], classes, None
    done: list[_Kinds] = [groups, classes]
    for sweep in range(1, sweeps + 1):
        n_samples, last = max(0, sweep - burn), sweep == sweeps
        frames = [groups(_CELLS), messages(_MESSAGES), *([before(_SAMPLE)] if before else [])]
        after = _Kinds(_swept(frames, totals, discounts, sweep, class_bits, n_samples, last), "lm-tables")
        messages.release(_MESSAGES)
        if before:
            before.release(_SAMPLE)
        messages = _Kinds(_resummed([classes(_STATIC), after(_TABLES)], totals, discounts, sweep), "lm-messages")
        after.release(_TABLES)
        totals = _totals(_known(messages(_SAMPLE)))
        done += [after, messages]
        if n_samples:
            before = after
            words.append(messages(_SAMPLE))
            samples.append(totals)
    for x, kind in ((groups, _CELLS), (classes, _STATIC), (messages, _MESSAGES)):
        x.release(kind)
    task = F.shiftright("id", _TASK_BITS).cast("int")
    queries = counts.filter("id >= 0")
    answers = (
        _words_answered(queries.filter(F.col("bucket") >= _WORD_BUCKETS), words, samples, discounts),
        _cells_answered(queries.filter(F.col("bucket") < _WORD_BUCKETS), before(_SAMPLE), discounts[1]),
    )
    folders = scratch(spark, "lm-words-asked"), scratch(spark, "lm-cells-asked")
    with shuffles_released(spark):
        for folder, rows_ in zip(folders, answers, strict=True):
            rows_.repartition(task).withColumn("task", task).sortWithinPartitions("task", "id").write.partitionBy("task").parquet(folder)
    drop(spark, counts, *done)
    return _scored(rows, folders, chunk_bytes, tokens, samples[-1].words, len(samples))


def op6_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"), stable=True)
