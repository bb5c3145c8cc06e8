"""Encode a text as the sum of its words.

Every pre-tokenisation rule used here puts a boundary in front of a space whose neighbours are
not both white space, so the ids of a text are the ids of its space-separated chunks, one after
another.  Chunks recur, so each is encoded once per worker and kept in a bounded table; a text
in which the rule does not hold (runs of white space, special-token strings) is encoded whole.
"""

from __future__ import annotations

import re

#: Chunks remembered per worker and table: the first ones, which hold the frequent ones (results do not depend on it).
CACHE_ENTRIES = 600_000

#: A space between white space on both sides, or after white space at the end: not a chunk boundary.
_UNSAFE = re.compile(r"\s (?:\s|\Z)")


class ChunkTable(dict):
    """chunk (without its leading space) -> encoded value, filled on first use."""

    def __init__(self, owner: "ChunkEncoder", prefix: str):
        super().__init__()
        self.owner, self.prefix = owner, prefix

    def __missing__(self, chunk):
        owner = self.owner
        if chunk.isalpha():
            value = owner.word(self.prefix, chunk)
            if len(self) < CACHE_ENTRIES:
                self[chunk] = value
            return value
        parts = chunk.split("\n")
        if len(parts) > 1 and all(p.isprintable() and p and " " not in p for p in parts):
            # single line ends between words are pre-tokens of their own; too varied to remember
            values = [self[parts[0]]]
            for p in parts[1:]:
                values += [owner.newline, owner.head[p]] if owner.newline else [owner.head[p]]
            return owner.sep.join(values)
        if chunk[-1:] in (".", ",") and chunk[:-1].isalpha() and owner.letters(chunk[:-1]):
            value = owner.sep.join((self[chunk[:-1]], owner.head[chunk[-1]]))
        else:
            value = owner.whole(self.prefix + chunk)
        if len(self) < CACHE_ENTRIES:
            self[chunk] = value
        return value


class ChunkEncoder:
    """``encode(str) -> bytes`` lifted to whole texts; the bytes of the chunks are joined by ``sep``.

    ``special``: texts with this string are encoded whole, as special tokens may be hidden there.
    ``letters``: whether a word of letters is still one after the tokenizer's normalisation (a capital
    may become a letter and a mark, which then belongs to the punctuation behind it).
    ``word(prefix, letters)``: a shorter way for chunks of letters alone.
    """

    def __init__(self, encode, sep: bytes = b"", special: str = "<|", letters=lambda word: True, word=None):
        self.whole, self.sep, self.special, self.letters = encode, sep, special, letters
        self.word = word or (lambda prefix, chunk: encode(prefix + chunk))
        self.head, self.rest = ChunkTable(self, ""), ChunkTable(self, " ")
        self.newline = encode("\n")

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if (self.special and self.special in text) or ("  " in text or not text.isprintable()) and _UNSAFE.search(text):
            return self.whole(text)
        first, *more = text.split(" ")
        parts = list(map(self.rest.__getitem__, more))
        if first:
            parts.insert(0, self.head[first])
        return self.sep.join(parts) if not self.sep else self.sep.join(filter(None, parts))
