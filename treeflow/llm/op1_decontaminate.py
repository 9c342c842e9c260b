"""Benchmark decontamination with suffix arrays over the training documents.

Each task concatenates the words of its documents into shards of a bounded number of words,
builds the shard's word suffix array, and binary-searches every suffix of every benchmark item
in it. The interval of a suffix holds the locations of its longest verbatim matches.

The documents are read once and never shuffled. Words that occur in no item are one sentinel:
a match can't cross them, so suffixes that start at one are left out of the array (a match can't
start there either). Items reach executors as files of bounded size in the shared folder; a test set
beyond one of them is searched file by file within the same pass over a shard, and a worker holds one
at a time.

Matches shorter than a window affect no document, so suffixes are compared to that depth first. What
agrees so far is extended along every place of the window in the items to the whole match.
"""

from __future__ import annotations

import functools
import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeflow.llm.common import alnum_words, lean, scratch, sized_batches, table, text_bytes

#: Words in a window; an item with fewer words is one window by itself.
WINDOW = 13
#: A document is contaminated if hit words are at least this part (1/20) of its words.
HIT_PART = 20
#: Text bytes in one shard of the training suffix array.
SHARD_BYTES = 4_000_000
#: Item words in one file.
BLOCK_WORDS = 2_000_000
#: Occurrences of windows in a shard and in the items that are held against each other at once.
PAIRS = 1 << 20


@dataclass
class ItemBlock:
    """Suffixes of a block of items as integer words, ready for searching.

    Window k has ``lengths[k]`` words and lies at the places ``places[first[k] : first[k + 1]]`` of ``words``;
    ``starts[k]`` is one of them. ``owners`` are the items of places, as places in ``names`` (sorted).
    """

    vocabulary: dict[bytes, int]
    words: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    places: np.ndarray
    owners: np.ndarray
    names: list[str]

    @property
    def starts(self) -> np.ndarray:
        return self.places[self.first[:-1]]

    @classmethod
    def of(cls, items: list[tuple[object, bytes]], window: int) -> ItemBlock:
        vocabulary: dict[bytes, int] = {}
        flat: list[int] = [0]  # a sentinel before, between and behind the items
        seen: dict[tuple[int, ...], int] = {}
        lengths, kinds, places, owners = [], [], [], []
        names = sorted({str(item) for item, _ in items})
        number = {name: k for k, name in enumerate(names)}
        for item, text in items:
            w = [vocabulary.setdefault(x, len(vocabulary) + 1) for x in alnum_words(text)]
            n = min(window, len(w))
            if not n:
                continue
            base = len(flat)
            flat += [*w, 0]
            for at in range(len(w) - n + 1):
                key = tuple(w[at : at + n])
                if (k := seen.setdefault(key, len(lengths))) == len(lengths):
                    lengths.append(n)
                kinds.append(k)
                places.append(base + at)
                owners.append(number[str(item)])
        as_array = lambda x: np.array(x, dtype=np.int64)
        kinds = as_array(kinds)
        order = np.argsort(kinds, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(kinds, minlength=len(lengths)))]).astype(np.int64)
        return cls(vocabulary, as_array(flat), as_array(lengths), first, as_array(places)[order], as_array(owners)[order], names)


def _packed(words: np.ndarray, bits: int, per_key: int, keys: int) -> list[np.ndarray]:
    """For each place the next ``keys * per_key`` words, ``per_key`` to an unsigned 64-bit key."""
    n = len(words)
    padded = np.concatenate([words, np.zeros(keys * per_key, dtype=np.int64)]).astype(np.uint64)
    out = []
    for k in range(keys):
        key = np.zeros(n, dtype=np.uint64)
        for j in range(per_key):
            key = (key << np.uint64(bits)) | padded[k * per_key + j : k * per_key + j + n]
        out.append(key)
    return out


class SuffixArray:
    """Word suffixes of one shard in lexicographic order, to a depth of the window's words."""

    def __init__(self, words: np.ndarray, vocabulary_size: int, depth: int):
        self.bits = max(1, int(vocabulary_size).bit_length())
        self.per_key = max(1, 63 // self.bits)
        self.levels = -(-depth // self.per_key)
        keys = _packed(words, self.bits, self.per_key, self.levels)
        places = np.flatnonzero(words)
        places = places[np.argsort(keys[0][places], kind="stable")]
        first = keys[0][places]
        tie = first[1:] == first[:-1]
        tied = np.concatenate([[False], tie]) | np.concatenate([tie, [False]])
        at = np.flatnonzero(tied) if len(places) > 1 else np.array([], dtype=np.int64)
        if len(at) and self.levels > 1:  # only suffixes that agree on a key need the next ones
            group = np.cumsum(np.concatenate([[True], first[at][1:] != first[at][:-1]]))
            sub = places[at]
            places[at] = sub[np.lexsort((*(key[sub] for key in keys[:0:-1]), group))]
        self.places = places
        self.keys = [key[places] for key in keys]

    def intervals(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """Binary search: for each query suffix the half-open interval of places whose suffixes
        begin with its first ``lengths`` words."""
        lo = np.zeros(len(starts), dtype=np.int64)
        hi = np.full(len(starts), len(self.places), dtype=np.int64)
        padded = np.concatenate([words, np.zeros(self.levels * self.per_key, dtype=np.int64)])
        for level in range(self.levels):
            low = np.zeros(len(starts), dtype=np.uint64)
            high = np.zeros(len(starts), dtype=np.uint64)
            for j in range(self.per_key):
                at = level * self.per_key + j
                inside = at < lengths
                word = padded[np.minimum(starts + at, len(padded) - 1)].astype(np.uint64)
                low = (low << np.uint64(self.bits)) | np.where(inside, word, np.uint64(0))
                high = (high << np.uint64(self.bits)) | np.where(
                    inside, word, np.uint64((1 << self.bits) - 1)
                )
            open_ = np.flatnonzero((lengths > level * self.per_key) & (lo < hi))
            if not len(open_):
                break
            key = self.keys[level]
            if level == 0:
                lo[open_] = np.searchsorted(key, low[open_], "left")
                hi[open_] = np.searchsorted(key, high[open_], "right")
            else:
                for q in open_:
                    part = key[lo[q] : hi[q]]
                    a, b = np.searchsorted(part, [low[q]], "left")[0], np.searchsorted(part, [high[q]], "right")[0]
                    lo[q], hi[q] = lo[q] + a, lo[q] + b
        return lo, hi


def _shard_matches(words: np.ndarray, block: ItemBlock, window: int) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences of windows in a shard: their places and the numbers of the windows."""
    none = np.array([], dtype=np.int64)
    if not len(block.lengths) or not words.any():
        return none, none
    array = SuffixArray(words, len(block.vocabulary) + 1, window)
    lo, hi = array.intervals(block.words, block.starts, block.lengths)
    some = np.flatnonzero(hi > lo)
    if not len(some):
        return none, none
    return (
        np.concatenate([array.places[lo[k] : hi[k]] for k in some]),
        np.repeat(some, (hi - lo)[some]),
    )


def _maximal(words: np.ndarray, places: np.ndarray, windows: np.ndarray, block: ItemBlock) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, lengths, items) of the matches that no word before or behind extends.

    Every occurrence of a window is held against every place that the window has in the items.
    """
    here = np.concatenate([words, [0]])
    copies = np.diff(block.first)[windows]
    ends = np.cumsum(copies)
    at = 0
    while at < len(places):  # some pairs at a time
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        k = copies[at:to]
        place = np.repeat(places[at:to], k)
        own = np.repeat(block.first[windows[at:to]], k) + np.arange(len(place)) - np.repeat(np.cumsum(k) - k, k)
        length = np.repeat(block.lengths[windows[at:to]], k)
        item_at, item = block.places[own], block.owners[own]
        before = block.words[item_at - 1]
        begins = (before == 0) | (place == 0) | (here[place - 1] != before)
        place, item_at, length, item = place[begins], item_at[begins], length[begins], item[begins]
        open_ = np.arange(len(place))
        while len(open_):
            next_ = block.words[item_at[open_] + length[open_]]
            open_ = open_[(next_ != 0) & (here[np.minimum(place[open_] + length[open_], len(words))] == next_)]
            length[open_] += 1
        yield place, length, item
        at = to


def _scan(batches: Iterator[pa.RecordBatch], blocks: list[str], window: int, shard_bytes: int):
    """For every shard: (batch, word counts, per-document hits, items and longest matches)."""
    for batch in sized_batches(batches, shard_bytes):
        docs = [alnum_words(x) for x in text_bytes(batch)]
        counts = np.array([len(d) for d in docs], dtype=np.int64)
        ends = np.cumsum(counts + 1)  # a sentinel after each document
        begins = ends - counts - 1
        total = int(ends[-1]) if len(ends) else 0
        cover = np.zeros(total + 1, dtype=np.int64)
        items: list[set[str]] = [set() for _ in docs]
        best: list[tuple] = [(0, None, None)] * len(docs)  # words, place, item
        for path in blocks:
            block = _opened(path)
            words = np.zeros(total, dtype=np.int64)
            get = block.vocabulary.get
            for d, begin, n in zip(docs, begins, counts, strict=True):
                words[begin : begin + n] = np.fromiter((get(w, 0) for w in d), np.int64, n)
            places, windows = _shard_matches(words, block, window)
            if not len(places):
                continue
            np.add.at(cover, places, 1)
            np.add.at(cover, places + block.lengths[windows], -1)
            owner = np.searchsorted(ends, places, "right")
            for pair in np.unique(owner * len(block.lengths) + windows).tolist():
                doc, k = divmod(pair, len(block.lengths))
                items[doc].update(block.names[x] for x in block.owners[block.first[k] : block.first[k + 1]])
            for place, length, item in _maximal(words, places, windows, block):
                owner = np.searchsorted(ends, place, "right")
                order = np.lexsort((item, place, -length, owner))
                for j in order[np.flatnonzero(np.concatenate([[True], owner[order][1:] != owner[order][:-1]]))] if len(order) else ():
                    i = int(owner[j])
                    found = (int(length[j]), int(place[j] - begins[i]), block.names[item[j]])
                    if not best[i][0] or (-found[0], *found[1:]) < (-best[i][0], *best[i][1:]):
                        best[i] = found
        hit = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
        yield batch, counts, hit[ends] - hit[begins], items, best


OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
    ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("longest_match", pa.int64()),
    ("longest_item", pa.string()), ("longest_at", pa.int64()),
])


def item_blocks(spark: SparkSession, benchmark: DataFrame, window: int, block_words: int) -> list[str]:
    """Files of the items in the shared folder, each of at most ``block_words`` words (or one longer item).

    The rows come to the driver one partition at a time; a file is written as soon as it is full, so
    neither side holds more than its bound at once.
    """
    folder = scratch(spark, "items")
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    blocks, rows, n = [], [], 0

    def close() -> None:
        path = f"{len(blocks)}.pickle"
        with fs.open_output_stream(f"{root}/{path}", compression=None) as out:
            out.write(pickle.dumps(ItemBlock.of(rows, window)))
        blocks.append(f"{folder}/{path}")

    for item, text in benchmark.filter(F.col("item_id").isNotNull()).select("item_id", F.col("text").cast("binary")).toLocalIterator():
        rows.append((item, bytes(text or b"")))
        n += len(alnum_words(rows[-1][1]))
        if n >= block_words:
            close()
            rows, n = [], 0
    if rows:
        close()
    return blocks


@functools.lru_cache(maxsize=1)
def _opened(path: str) -> ItemBlock:
    """An item file of item_blocks(); a worker keeps the one it read last."""
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(name, compression=None) as f:
        return pickle.loads(f.read())


def contamination(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW,
    shard_bytes: int = SHARD_BYTES, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document row: hit words, items with windows in it, and its longest match.

    ``documents(doc_id, text)``, ``benchmark(item_id, text)``; other columns are ignored, whatever
    their names. A null or empty text has no words, no hits and isn't contaminated; an item without
    words has no window; items with equal windows all count; repeated rows each give a row; empty
    tables give no rows or no hits. ``longest_match`` is in words (0 without a match), ``longest_at``
    the word of the document where it starts (null without one).
    """
    blocks = item_blocks(documents.sparkSession, benchmark, window, block_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, counts, hits, items, best in _scan(batches, blocks, window, shard_bytes):
            yield pa.record_batch([
                batch.column("doc_id").cast(pa.int64()), pa.array(counts), pa.array(np.asarray(hits, dtype=np.int64)),
                pa.array([len(i) for i in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items]),
                pa.array([bool(h > 0 and HIT_PART * h >= n) for h, n in zip(hits, counts, strict=True)], pa.bool_()),
                pa.array([b[0] for b in best], pa.int64()), pa.array([b[2] for b in best], pa.string()),
                pa.array([b[1] for b in best], pa.int64()),
            ], schema=OUT)

    return documents.select("doc_id", "text").mapInArrow(
        lean(run), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_item string, longest_at long"
    )


def decontaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``documents`` whose texts aren't contaminated, all columns kept.

    The verdict of a row depends on its own text alone, so it is taken in the pass that reads the
    row: no join back by id, and rows that repeat an id are judged each by its own text.
    """
    blocks = item_blocks(documents.sparkSession, benchmark, window, BLOCK_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, counts, hits, _, _ in _scan(batches, blocks, window, SHARD_BYTES):
            keep = [not (h > 0 and HIT_PART * h >= n) for h, n in zip(hits, counts, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(lean(run), documents.schema)


def op1_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT item_id, i AS j, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
occ AS (SELECT doc_id, i, j, grams.n, item_id FROM grams JOIN win ON grams.g = win.g AND grams.n = win.n),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM occ)) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM occ) GROUP BY doc_id),
runs AS (
  SELECT doc_id, CAST(item_id AS VARCHAR) AS x, min(i) AS i, count(*) + n - 1 AS words
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j, n ORDER BY i) AS run FROM (SELECT DISTINCT * FROM occ))
  GROUP BY doc_id, item_id, i - j, n, run),
longest AS (
  SELECT doc_id, words, x, i FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, i, x) = 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  CAST(coalesce(words, 0) AS BIGINT) AS longest_match, x AS longest_item, CAST(i - 1 AS BIGINT) AS longest_at
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN longest USING (doc_id)
"""
