"""Exact token counts at every prefix of a text, by dynamic programming over its bytes.

The last token of a prefix of a piece is the only vocabulary entry that ends there and whose pair with
the last token in front of it encodes to just those two tokens. So the count at a byte is one more than
the count where that entry starts, and one pass over a piece gives the counts at all its prefixes.
Pieces repeat; their tables are computed once per cached piece. The table of a text answers how many
tokens any prefix has and how long a prefix fits a budget without encoding again.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeflow.llm.bpe import SPECIAL, Cache, PartEncoder, default_vocabulary, encoding
from treeflow.llm.common import lean, sized_batches, split_batches, table, texts

#: Documents of more tokens are over the limit.
LIMIT = 512
_SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_CONTRACTION = re.compile(r"'(?:ll|ve|re)")


class PrefixCounter:
    """Prefix token counts under one byte-pair vocabulary."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        self.encoder = encoding(path)
        self.ranks = self.encoder._mergeable_ranks
        self.longest = max(map(len, self.ranks))
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.pairs = Cache(self._pair, 500_000)
        self.pieces = Cache(lambda piece: self.table(piece)[-1], 700_000)
        self.total = PartEncoder(self._part, 1, 250_000)

    def _pair(self, pair: tuple[bytes, bytes]) -> bool:
        a, b = pair
        return self.encoder._encode_single_piece(a + b) == [self.ranks[a], self.ranks[b]]

    def table(self, piece: str) -> list[int]:
        """Counts at byte 0, 1, ... of a piece of the pre-tokenizer."""
        w = piece.encode()
        counts, last = [0] * (len(w) + 1), [b""] * (len(w) + 1)
        ranks, pairs, longest = self.ranks, self.pairs, self.longest
        for i in range(1, len(w) + 1):
            for j in range(max(0, i - longest), i):
                token = w[j:i]
                if token in ranks and (not j or pairs[last[j], token]):
                    counts[i], last[i] = counts[j] + 1, token
                    break
        return counts

    def _part(self, part: str) -> int:
        return sum(map(self.pieces.__getitem__, self.find(part)))

    def count(self, text: str) -> int:
        """Tokens of the whole text: the last entry of its table, through the caches."""
        return sum(self.total(text))

    def _plain_table(self, text: str) -> np.ndarray:
        """Counts at every code point of a text without the added token.

        Within a piece a prefix is a piece of the same kind, but for two cases: a contraction cut short
        is an apostrophe and a letter, and white space at the end of a prefix is one piece as far as
        it goes, while its last character may belong to what follows in the text.
        """
        out, done, before, run = [0], 0, 0, ""
        for piece in self.find(text):
            counts = self.table(piece)
            blank = len(piece) - len(piece.lstrip()) if not piece.isspace() else len(piece)
            at = 0
            for i, c in enumerate(piece):
                at += len(c.encode())
                if i < blank:
                    if not run:
                        before = done
                    run += c
                    out.append(before + self.table(run)[-1])
                else:
                    run = ""
                    out.append(done + counts[at])
            if _CONTRACTION.fullmatch(piece):
                out[-2] = done + 2
            done += counts[-1]
        return np.array(out)

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of ``text[:i]`` for every i from 0 to len(text)."""
        out, base = np.zeros(1, dtype=np.int64), 0
        parts = text.split(SPECIAL)
        for k, part in enumerate(parts):
            more = k + 1 < len(parts)
            # Until its last character is there, the added token is ordinary text behind the part.
            counts = base + self._plain_table(part + SPECIAL[:-1] * more)
            out = np.concatenate([out, counts[1:]])
            if more:
                base = int(counts[len(part)]) + 1
                out = np.append(out, base)
        return out

    def longest_prefix(self, text: str, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens."""
        counts = self.prefix_counts(text)
        fits = np.flatnonzero(counts <= budget)
        return int(fits[-1]) if len(fits) else 0


@functools.cache
def _counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(documents: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document row: bytes, tokens, and whether the tokens are over the limit.

    A null text counts as empty (0 bytes, 0 tokens). Repeated rows each give a row, a null id is kept, an
    empty table gives no rows; other columns are ignored. A text is counted whole, however long.
    ``vocabulary`` is a file that every executor can read.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path).count
        for batch in split_batches(batches, 1000):
            tokens = pa.array([count(x) for x in texts(batch)], pa.int64())
            n_bytes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), n_bytes, tokens, pc.greater(tokens, limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return documents.select("doc_id", "text").mapInArrow(lean(run), _SCHEMA)


def prefix_tables(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per document row: ``counts[i]`` is how many tokens its first i code points have, from 0 on.

    Written once, the table answers any later budget or truncation without the texts or an encoder: see
    fitting_prefixes() and prefix_tokens(). A null or empty text has the single entry 0; repeated rows each
    give a row; an empty table gives no rows; other columns are ignored.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in sized_batches(batches, 1_000_000):
            found = [counter.prefix_counts(x).astype(np.int32) for x in texts(batch)]
            ends = np.concatenate([[0], np.cumsum([len(c) for c in found])]).astype(np.int32)
            counts = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), counts], names=["doc_id", "counts"])

    return documents.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, counts array<int>")


def fitting_prefixes(tables: DataFrame, budget: int) -> DataFrame:
    """(doc_id, n_chars): the longest prefix of each text, in code points, within a budget, from prefix_tables().

    A prefix that cuts a word may have more tokens than a longer one, so all entries are looked at. A budget
    below 0 fits nothing: null.
    """
    fits = F.transform("counts", lambda n, i: F.when(n <= budget, i))
    return tables.select("doc_id", F.array_max(fits).cast("long").alias("n_chars"))


def prefix_tokens(tables: DataFrame, n_chars: int) -> DataFrame:
    """(doc_id, n_tokens): tokens of the first ``n_chars`` code points of each text, of all of a shorter one."""
    at = F.least(F.lit(n_chars), F.size("counts") - 1)
    return tables.select("doc_id", F.get("counts", at).cast("long").alias("n_tokens"))


def op5_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
