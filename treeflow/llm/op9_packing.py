"""Hierarchical packing of documents into sequences of several context sizes, all of them full.

A document's ids are cut into full windows of the longest size; what remains is routed to the
shortest tier that holds it. Within a block of documents each tier is packed best-fit, the longest
first; a window's gap is filled with whole remainders of shorter tiers and at last with the front of
one. Every tier is a power of two, so a full window of any tier has no padding; what is left when a
task ends is cut into powers of two. Windows are dealt to step groups so that each group has the same
number of tokens as far as its windows allow.

Documents are read and encoded once, and nothing is shuffled: a sequence lies within one task. A task's
result depends on its rows alone, so one that is run again gives the same sequences.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from treeflow.llm.bpe import PartEncoder, default_vocabulary, encoding
from treeflow.llm.common import lean, split_batches, table, texts

#: Tokens of the tiers, longest first; all powers of two.
TIERS = (1024, 512, 256, 128)
#: Tokens of a step group.
STEP_TOKENS = 64 * 1024
#: Remainders that a task holds before it packs them.
BLOCK_PIECES = 20_000
#: Bits of a sequence id below the task's number.
_LOCAL_BITS = 36

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()),
    ("step_group", pa.int64()),
])


@functools.cache
def _ids(path: str):
    """A function from a text to its ids as little-endian unsigned 32-bit integers."""
    import numpy as np

    encoder = encoding(path)
    special = (encoder.max_token_value + 1).to_bytes(4, "little")
    of = PartEncoder(lambda part: np.array(encoder.encode_ordinary(part), dtype="<u4").tobytes(), special)
    return lambda text: b"".join(of(text))


class _Open:
    """A window of one tier being filled with pieces (document, start, ids as bytes)."""

    __slots__ = ("gap", "pieces", "tier")

    def __init__(self, tier: int):
        self.tier, self.gap, self.pieces = tier, tier, []

    def add(self, doc, start: int, data: bytes) -> None:
        self.pieces.append((doc, start, data))
        self.gap -= len(data) // 4


def pack(remainders: list[tuple], tiers: tuple[int, ...]) -> tuple[list[_Open], list[tuple]]:
    """Packs (document, start, ids) pieces shorter than the longest tier: full windows, and what is left.

    Left pieces sum to less than a window of the shortest tier that had gaps to fill.
    """
    pools: dict[int, list[tuple]] = {t: [] for t in tiers}
    for piece in remainders:
        n = len(piece[2]) // 4
        pools[min(t for t in tiers if t >= n)].append(piece)
    size = lambda p: len(p[2]) // 4
    for pool in pools.values():
        pool.sort(key=size)
    full: list[_Open] = []
    for k, tier in enumerate(tiers):
        below = tiers[k:]
        while pools[tier]:
            window = _Open(tier)
            window.add(*pools[tier].pop())
            while window.gap:
                pool = next((pools[t] for t in below if pools[t] and size(pools[t][0]) <= window.gap), None)
                if pool is not None:  # the largest whole piece that fits, from the longest tier that has one
                    piece = pool.pop(bisect.bisect_right(pool, window.gap, key=size) - 1)
                    window.add(*piece)
                    continue
                pool = next((pools[t] for t in reversed(below) if pools[t]), None)
                if pool is None:
                    return full, window.pieces
                doc, start, data = pool.pop(0)  # the shortest one left is cut; its end stays in a pool
                cut = window.gap
                window.add(doc, start, data[: 4 * cut])
                rest = (doc, start + cut, data[4 * cut :])
                home = pools[min(t for t in tiers if t >= size(rest))]
                home.insert(bisect.bisect_left(home, size(rest), key=size), rest)
            full.append(window)
    return full, []


def binary_windows(pieces: list[tuple], longest: int) -> list[_Open]:
    """Cuts pieces into windows of falling powers of two, all full."""
    left = sum(len(p[2]) // 4 for p in pieces)
    queue, out = list(pieces), []
    while left:
        window = _Open(min(longest, 1 << (left.bit_length() - 1)))
        while window.gap:
            doc, start, data = queue.pop(0)
            cut = min(window.gap, len(data) // 4)
            window.add(doc, start, data[: 4 * cut])
            if 4 * cut < len(data):
                queue.insert(0, (doc, start + cut, data[4 * cut :]))
        left -= window.tier
        out.append(window)
    return out


class _Emitter:
    """Numbers windows and deals them to step groups of equal tokens."""

    def __init__(self, task: int, step_tokens: int):
        self.next, self.step_tokens = task << _LOCAL_BITS, step_tokens
        self.group, self.room = task << _LOCAL_BITS, step_tokens

    def rows(self, windows: list[_Open]) -> Iterator[tuple]:
        for window in windows:
            if self.room < window.tier:
                self.group, self.room = self.group + 1, self.step_tokens
            self.room -= window.tier
            at = 0
            for (doc, tokens), start, data in window.pieces:
                n = len(data) // 4
                yield doc, start, n, zlib.crc32(data), tokens, self.next, at, window.tier, self.group
                at += n
            self.next += 1


def packed(
    documents: DataFrame, vocabulary: str | None = None, tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS, block_pieces: int = BLOCK_PIECES,
) -> DataFrame:
    """One row per piece of a document: which ids of it lie where in which sequence.

    A null text is an empty one; every document ends with id 0, so an empty one is a single id.
    Repeated rows are documents of their own; other columns are ignored. All sequences are full: of a
    tier's length, or of a smaller power of two for the last few of a task.
    """
    path = vocabulary or default_vocabulary()
    longest, end = max(tiers), bytes(4)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, emit = _ids(path), _Emitter(TaskContext.get().partitionId(), step_tokens)
        waiting: list[tuple] = []
        for batch in split_batches(batches, 1000):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                data = ids(text) + end
                doc, n = (doc_id, len(data) // 4), len(data) // 4
                whole = n - n % longest
                for start in range(0, whole, longest):
                    window = _Open(longest)
                    window.add(doc, start, data[4 * start : 4 * (start + longest)])
                    rows += emit.rows([window])
                if whole < n:
                    waiting.append((doc, whole, data[4 * whole :]))
            if len(waiting) >= block_pieces:
                windows, waiting = pack(waiting, tiers)
                rows += emit.rows(windows)
            if rows:
                yield batch_of(rows)
        windows, left = pack(waiting, tiers)
        rows = [*emit.rows(windows), *emit.rows(binary_windows(left, longest))]
        if rows:
            yield batch_of(rows)

    return documents.select("doc_id", "text").mapInArrow(lean(run), _SCHEMA)


def op9_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
