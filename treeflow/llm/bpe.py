"""Byte-pair encoding of whole texts by way of cached words.

The pre-tokenizer of the vocabulary never lets a piece run from a visible character into white space,
so a text may be cut in front of any white space that follows a visible character, and each part
encoded for itself. Parts repeat; their results are cached per worker, in bounded caches.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable, Iterator

#: The one added token of the vocabulary. The library finds it inside texts by default.
SPECIAL = "<|endoftext|>"
_PART = re.compile(r"\s*\S+|\s+")
#: White space in front of a space: parts can't be told by single spaces.
_RUN = re.compile(r"\s ")
_ASCII_RUNS = tuple(c + " " for c in " \n\t\r\x0b\x0c")
#: Python counts these as white space, the pre-tokenizer doesn't.
_CONTROL = re.compile(r"[\x1c-\x1f]")
#: Longer parts are not kept.
_LONG = 64


class Cache(dict):
    """A dict that computes what it lacks and starts anew when full."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= _LONG:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


@functools.cache
def encoding(path: str):
    """The byte-pair encoder of a ``.json`` vocabulary's ranks (the ``.tiktoken`` file beside it)."""
    import public_tokenizers
    import tiktoken

    with open(re.sub(r"\.json$", ".tiktoken", path), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PartEncoder:
    """Applies a function of independent parts to texts.

    ``value(part)`` is computed once per cached part; ``special`` is the value of the added token.
    """

    def __init__(self, value: Callable[[str], object], special: object, limit: int = 300_000):
        self.value, self.special = value, special
        self.plain = Cache(value, limit // 4)
        self.spaced = Cache(lambda part: value(" " + part), limit)

    def __call__(self, text: str) -> Iterator:
        """The values of the parts of a text, in order."""
        if SPECIAL in text:
            for k, between in enumerate(text.split(SPECIAL)):
                if k:
                    yield self.special
                if between:
                    yield from self.parts(between)
        elif text:
            yield from self.parts(text)

    def parts(self, text: str) -> Iterator:
        if any(x in text for x in _ASCII_RUNS) if text.isascii() else _RUN.search(text):
            if _CONTROL.search(text):
                return iter((self.value(text),))
            return map(self.plain.__getitem__, _PART.findall(text))
        first, *rest = text.split(" ")
        spaced = map(self.spaced.__getitem__, rest)
        if not first:
            return spaced
        return _chain(self.plain[first], spaced)


def _chain(first, rest):
    yield first
    yield from rest
