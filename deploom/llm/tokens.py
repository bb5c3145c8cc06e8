"""Whole-text encoders over the tokenizers library, remembered per worker."""

from __future__ import annotations

import functools
import os
from array import array

from .chunks import ChunkEncoder
from .common import one_table_at_a_time


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else the next free code point from 256."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


def library_encoder(path: str) -> ChunkEncoder:
    """The worker's encoder of one tokenizers file."""
    one_table_at_a_time("tokens:" + path, _encoder.cache_clear)
    return _encoder(path)


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> ChunkEncoder:
    """Encoder of one tokenizers file: text -> ids as little-endian unsigned 32-bit integers.

    A word of letters alone is a single pre-token, so it goes straight to the library's model;
    anything else takes the library's whole pipeline.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    model, normalizer = tok.model, tok.normalizer
    stand_in = dict(enumerate(byte_alphabet()))
    space = stand_in[32]
    lower = normalizer is not None  # the word-level file drops white space and lowers case

    def encode(chunk: str) -> bytes:
        return array("I", tok.encode(chunk, add_special_tokens=False).ids).tobytes()

    def word(prefix: str, chunk: str) -> bytes:
        if lower and chunk.isascii():
            body = chunk.lower()
            if body != chunk:  # capitals share the small letters' entry
                return encoder.head[body]
        elif lower:
            body = normalizer.normalize_str(chunk)
            if not body.isalpha():
                return encode(prefix + chunk)
        else:
            body = prefix + chunk
        mapped = body.replace(" ", space) if body.isascii() else body.encode().decode("latin1").translate(stand_in)
        return array("I", [t.id for t in model.tokenize(mapped)]).tobytes()

    def letters(word: str) -> bool:
        return not lower or word.isascii() or normalizer.normalize_str(word).isalpha()

    encoder = ChunkEncoder(encode, letters=letters, word=word)
    return encoder

