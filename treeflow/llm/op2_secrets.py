"""Secret scans: three exact patterns, and strings that a tokenizer spends many tokens on.

Natural words cost few tokens for their length under a byte-pair vocabulary; random keys don't.
A run of key characters whose ratio of characters to tokens is low is reported as ``random``,
unless it is a known digest (hex of a digest's length), an identifier without letters (number, date,
rule of dashes) or a UUID, or lies in a span that a pattern has already found. Whether letters are words,
names, paths or a key is for the ratio to tell.

A document is read and scanned whole in one pass; nothing is shuffled.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from treeflow.llm.common import lean, split_batches, table, texts

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
#: A text without any of these has no match of _ASSIGN; a plain search is many times faster.
_STEMS = ("passw", "secret", "token", "apikey", "api_key")
# Greedy runs: a run that is too short has no long enough match inside it, so the bound may stand
# in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_LEAST = 8

#: Candidates for the token-efficiency test; shorter strings have too few tokens to judge.
CANDIDATE_CHARS = 20
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Characters per token below which a string counts as random, and the same for strings without a digit:
#: long invented words come near the first.
RATIO, LETTERS_RATIO = 2.2, 2.05
_DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
_HEX_ANY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_NUMBER = re.compile(r"[0-9_=+/-]+")


@functools.cache
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def looks_random(run: str, vocabulary: str, ratio: float) -> bool:
    """The token-efficiency test of one run of key characters."""
    if _UUID.fullmatch(run) or _NUMBER.fullmatch(run):
        return False
    if len(run) in _DIGEST_LENGTHS and _HEX_ANY.fullmatch(run):
        return False
    least = ratio if any(c.isdigit() for c in run) else min(ratio, LETTERS_RATIO)
    return len(run) / len(_encoder(vocabulary).encode_ordinary(run)) < least


def spans(text: str, vocabulary: str, ratio: float = RATIO) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret, by start and then kind as listed; code points."""
    out = []
    low = text.lower() if any(c in text for c in "=:") else ""
    if low and any(x in low for x in _STEMS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= _LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    runs = [(m.start(), m.end()) for m in _RUN.finditer(text)]
    # A hex run is a part of a run of key characters, so only those need the search.
    for a, b in runs:
        if b - a >= 32:
            out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text, a, b)]
    base = list(out)
    for a, b in runs:
        if all(b <= x or y <= a for x, y, _ in base) and looks_random(text[a:b], vocabulary, ratio):
            out.append((a, b, "random"))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def secret_spans(documents: DataFrame, vocabulary: str | None = None, ratio: float = RATIO) -> DataFrame:
    """One row per document row: counts by kind and all spans.

    A null text counts as empty; an empty text has no spans, ``base_sha256`` is then the digest of
    the empty string. Repeated rows each give a row, a null id is kept, an empty table gives no rows; other
    columns are ignored. A text is scanned whole, however long. ``vocabulary`` is a file of ranks that every
    executor can read.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in split_batches(batches, 2000):
            found = [spans(x, path, ratio) for x in texts(batch)]
            count = lambda kind: pa.array([sum(s[2] == kind for s in f) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").cast(pa.int64()), *(count(k) for k in KINDS),
                pa.array([hashlib.sha256(_joined([s for s in f if s[2] != "random"]).encode()).hexdigest() for f in found], pa.string()),
                pa.array([_joined(f) for f in found], pa.string()),
            ], names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return documents.select("doc_id", "text").mapInArrow(lean(run), _SCHEMA)


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each span (spans that overlap count as one) replaced by its first kind."""
    out, at = [], 0
    merged: list[list] = []
    for a, b, kind in found:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, kind])
    for a, b, kind in merged:
        out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join([*out, text[at:]])


def redacted(documents: DataFrame, vocabulary: str | None = None, ratio: float = RATIO) -> DataFrame:
    """The same rows and columns with the secrets in ``text`` replaced; ``n_chars`` follows if present.

    A null text stays null; a text without secrets stays as it is. Repeated rows stay as many; an empty
    table stays empty.
    """
    path = vocabulary or default_vocabulary()
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in split_batches(batches, 2000):
            raw = batch.column("text").to_pylist()
            found = [spans(x or "", path, ratio) for x in raw]
            changed = [redact(x, f) if f else x for x, f in zip(raw, found, strict=True)]
            columns = dict(zip(names, batch.columns, strict=True))
            columns["text"] = pa.array(changed, pa.string())
            if "n_chars" in columns:
                kind = columns["n_chars"].type
                old = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([len(x) if f else n for x, f, n in zip(changed, found, old, strict=True)], kind)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return documents.mapInArrow(lean(run), documents.schema)


def op2_token_efficiency_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))
