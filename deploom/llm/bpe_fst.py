"""Byte-level BPE as a lazily determinised finite-state transducer.

The ids of a byte string under rank-ordered merges are the one segmentation into tokens whose
neighbours are all *compatible* (two tokens are, if merging their joined bytes gives just them).
So each prefix has exactly one last token, and the prefixes form a tree.  A state keeps what later
bytes can still see: the last token emitted, the bytes behind it, and the last token of each prefix
that some vocabulary entry may still continue.  Reading a byte adds one prefix; the tokens on which
all live prefixes agree are emitted.  The lookahead is therefore bounded by the longest entry.
States and transitions are made on first use, in a bounded table; once it is full, it is emptied and
recording goes on from the current state, so every byte string runs through the transducer.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkEncoder
from .common import map_batches, one_table_at_a_time, text_or_empty

#: States recorded per worker before the table is emptied.
STATE_LIMIT = 400_000
#: Pairs of tokens known to be compatible or not, per worker, before they are forgotten.
PAIR_LIMIT = 600_000

START = -1
_BYTE = [bytes((b,)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class MergeTransducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        prefixes = {t[:k] for t in ranks for k in range(1, len(t))}
        #: byte string -> its token if it is one, and whether it begins a longer entry
        self.entries = {x: (ranks.get(x), x in prefixes) for x in (*ranks, *prefixes)}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.spines: tuple[dict, dict] = {}, {}
        self.reset()

    def reset(self) -> None:
        self.number = {(START, b"", ()): 0}
        #: left token, bytes since, last token of each prefix of them (None: cut off), way of the whole, and
        #: the prefixes that an entry may continue: (place, last token, way); a way is a bit set of token ends
        self.states = [(START, b"", (), 1, ((0, START, 1),))]
        #: state << 8 | byte -> next state and emitted tokens
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.final: list[tuple[int, ...] | None] = [None]

    def merge(self, data: bytes, below: float = float("inf")) -> list[int]:
        """Merges by lowest rank, leftmost first, of ranks under ``below``: the definition, used to compile single entries."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and r < below and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def spine(self, token: int, side: int) -> list[tuple[bytes, float, float]]:
        """What stands at one end of ``token`` (side 0: its begin, 1: its end) while its bytes merge.

        Each piece with the rank of the merge that makes it and of the one that uses it up: the token
        itself first, a single byte last.
        """
        got = self.spines[side].get(token)
        if got is None:
            piece, used, got = self.bytes_of[token], float("inf"), []
            while len(piece) > 1:
                made = self.ranks[piece]
                got.append((piece, made, used))
                piece, used = self.halves(piece)[side], made
            got.append((piece, -1, used))
            self.spines[side][token] = got
        return got

    def halves(self, piece: bytes) -> tuple[bytes, bytes]:
        """The two pieces whose merge makes an entry."""
        parts = self.merge(piece, self.ranks[piece])
        return self.bytes_of[parts[0]], self.bytes_of[parts[1]]

    def fits(self, left: int, token: int) -> bool:
        """Whether ``token`` may follow ``left``: no merge across their border comes before those inside.

        Merges run by rising rank, so it is enough to look at pieces that stand at the border together.
        """
        for x in (left, token):
            if x != START and x not in self.whole:
                self.whole[x] = self.merge(self.bytes_of[x]) == [x]
        if not self.whole[token] or left == START:
            return self.whole[token]
        for a, made_a, used_a in self.spine(left, 1):
            for b, made_b, used_b in self.spine(token, 0):
                if max(made_a, made_b) < min(used_a, used_b):
                    across = self.ranks.get(a + b)
                    if across is not None and across < used_a and across <= used_b:
                        return False
        return True

    def move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Compile the transition of ``state`` on ``byte``: (next state, emitted tokens)."""
        left, window, last, _, live = self.states[state]
        window += _BYTE[byte]
        n, entries, compatible = len(window), self.entries, self.compatible
        way, common, needed, still = 0, -1, 0, []
        for x in live:  # the longest entry first
            got = entries.get(window[x[0] :])
            if got is None:
                continue
            found, longer = got
            if found is not None and not way:
                pair = x[1], found
                ok = compatible.get(pair)
                if ok is None:
                    ok = compatible[pair] = self.fits(*pair)
                if ok:
                    token, way = found, x[2] | 1 << n
            if longer:
                still.append(x)
                common &= x[2]
                needed |= x[2]
        if not way:
            raise ValueError("the vocabulary lacks a single byte")
        common &= way
        needed |= way
        last += (token,)
        base = common.bit_length() - 1
        if base:
            emitted = tuple([last[k - 1] for k in range(1, base + 1) if common >> k & 1])
            left, window, last = emitted[-1], window[base:], last[base:]
            still = [(j - base, t, ends >> base) for j, t, ends in still]
            n, way, needed = n - base, way >> base, needed >> base
        else:
            emitted = ()
        still.append((n, token if n else left, way))
        if needed.bit_count() <= n:
            last = tuple([t if needed >> k & 1 else None for k, t in enumerate(last, 1)])
        key = left, window, last
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append((left, window, last, way, still))
            self.final.append(None)
        got = self.moves[state << 8 | byte] = number, emitted
        return got

    def keep_only(self, state: int) -> int:
        """Empty the table but for ``state``; its new number."""
        kept = self.states[state]
        if len(self.compatible) > PAIR_LIMIT:
            self.compatible.clear()
        self.reset()
        if not state:
            return 0
        self.number[kept[:3]] = 1
        self.states.append(kept)
        self.final.append(None)
        return 1

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pre-token; a whole entry is itself, as in the rank files' library."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        state, out, moves = 0, [], self.moves
        for byte in piece:
            got = moves.get(state << 8 | byte)
            if got is None:
                if len(self.states) > STATE_LIMIT:
                    state = self.keep_only(state)
                    moves = self.moves
                got = self.move(state, byte)
            state, emitted = got
            if emitted:
                out += emitted
        final = self.final[state]
        if final is None:
            _, _, last, way, _ = self.states[state]
            final = self.final[state] = tuple([t for k, t in enumerate(last, 1) if way >> k & 1])
        out += final
        return out


class Utf8Machine:
    """Incremental UTF-8: feed bytes, get the text of all complete code points; the rest waits.

    The state is the bytes of an unfinished code point (at most three); ill-formed bytes become
    U+FFFD as soon as they are known to be so.
    """

    def __init__(self):
        self.held = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end begin a code point that may still be completed."""
        for k in range(1, min(3, len(data)) + 1):
            b = data[-k]
            if b < 0x80:
                return 0
            if b >= 0xC2:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4 if b < 0xF5 else 0
                if k >= need:
                    return 0
                second = data[-k + 1] if k > 1 else None
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, (0x80, 0xBF))
                return k if second is None or low <= second <= high else 0
            if b >= 0xC0:
                return 0
        return 0

    def feed(self, data: bytes, last: bool = False) -> str:
        data = self.held + data
        keep = 0 if last else self.unfinished(data)
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")


class StreamDecoder:
    """ids in, text out, a run of ids at a time."""

    def __init__(self, table: list[bytes]):
        self.table, self.machine = table, Utf8Machine()

    def feed(self, ids: list[int], last: bool = False) -> str:
        return self.machine.feed(b"".join(map(self.table.__getitem__, ids)), last)


#: A character that is neither letter nor number nor white space in any version of Unicode.
_PLAIN = "\uffff"


def newer_characters() -> str:
    """Characters that are letters or numbers for the ``regex`` module, but not yet for tiktoken's tables."""
    import regex
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    ranks = {b: i for i, b in enumerate(_BYTE)}
    newer = set()
    for kind in (r"\p{L}", r"\p{N}"):
        # a tokenizer of single bytes gives back just what its pattern matches
        known = tiktoken.Encoding(kind, pat_str=kind, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(every)
        newer |= set(regex.findall(kind, every)) - set(bytes(known).decode())
    return "".join(sorted(newer))


class RankTokenizer:
    """Encoder and decoder of one rank file with its pre-tokenising pattern, read with tiktoken's letters and numbers."""

    #: ids that the decoder takes at a time
    RUN = 1 << 16

    def __init__(self, path: str, pattern: str):
        import regex

        ranks = load_ranks(path)
        self.fst, self.pattern = MergeTransducer(ranks), regex.compile(pattern)
        newer = newer_characters()
        self.newer, self.as_plain = frozenset(newer), dict.fromkeys(map(ord, newer), _PLAIN)
        self.table = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.table[i] = t
        self.decimal = [str(i).encode() for i in range(len(self.table))]
        encode = self.fst.encode
        self.chunks = ChunkEncoder(self.encode_chunk, special="", word=lambda prefix, chunk: array("I", encode((prefix + chunk).encode())).tobytes())

    def encode_chunk(self, chunk: str) -> bytes:
        if chunk.isascii() or self.newer.isdisjoint(chunk):
            parts = self.pattern.findall(chunk)
        else:  # cut where the chunk would be cut with a plain character in their place
            parts = [chunk[m.start() : m.end()] for m in self.pattern.finditer(chunk.translate(self.as_plain))]
        return array("I", [i for p in parts for i in self.fst.encode(p.encode())]).tobytes()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.chunks(text), "<u4")

    def decode(self, ids: np.ndarray):
        """Text of ``ids``, run by run."""
        stream = StreamDecoder(self.table)
        for k in range(0, len(ids), self.RUN):
            yield stream.feed(ids[k : k + self.RUN].tolist())
        yield stream.feed([], last=True)


def rank_tokenizer(path: str, pattern: str) -> RankTokenizer:
    """The worker's tokenizer of one rank file."""
    one_table_at_a_time("ranks:" + path, _rank_tokenizer.cache_clear)
    return _rank_tokenizer(path, pattern)


@functools.lru_cache(maxsize=1)
def _rank_tokenizer(path: str, pattern: str) -> RankTokenizer:
    import gc

    tokenizer = RankTokenizer(path, pattern)
    # the tables hold no cycles: searching them for some costs a third of the time
    gc.freeze()
    gc.set_threshold(200_000)
    return tokenizer


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null texts count as empty (no ids); repeated rows give a row each; null doc_ids stay null; other
    columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())

    def run(b):
        tok = rank_tokenizer(path, pattern)
        count, first, second = [], [], []
        for text in b.column(1).to_pylist():
            ids = tok.encode(text)
            count.append(len(ids))
            first.append(hashlib.sha256(b",".join(map(tok.decimal.__getitem__, ids.tolist()))).hexdigest())
            back = hashlib.sha256()
            for part in tok.decode(ids):
                back.update(part.encode())
            second.append(back.hexdigest())
        return {"doc_id": b.column(0), "n_tokens": count, "ids_sha256": first, "decoded_sha256": second}

    return map_batches(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
