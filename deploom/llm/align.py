"""Alignment of two tokenizers' ids over the same bytes.

A text is cut where both tokenizers cut whatever stands there, such as before a space behind a
character that is no white space.  No token, link or group crosses such a place, so a text is the sequence of
its *units*.  Each Arrow partition numbers its units, encodes new ones with both tokenizers, and
aligns them in DuckDB: the tokens are interval tables over the bytes of the new units one after another;
an ASOF join finds the token of B in which a token of A begins, a range join those that begin inside
it; window sums over the common ends number the groups.

Two passes over the texts: the first adds up how often each pair of ids is linked, by partition,
and Spark merges the partial counts; the second aligns again and adds up the counts along each
text.  The ``HOT_PAIRS`` most frequent pairs are broadcast; links of others leave the second pass
as rows and are joined.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from itertools import chain
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_table_at_a_time, ship, text_or_empty, written

#: Most pairs that are broadcast (17 bytes each).
HOT_PAIRS = 1 << 20
#: Bytes of units and their groups that a worker keeps, those beyond that it holds before it drops them again, and what an entry takes beside its text.
UNIT_BYTES, MORE_BYTES, ENTRY_BYTES = 320 << 20, 40 << 20, 160
#: Characters of text that are aligned by one statement, and characters beyond which a unit is not kept.
TEXT_SLICE, LONG_UNIT = 1 << 20, 1 << 12
#: Tokens of a long unit that are aligned by one statement: it is cut at common ends.
LONG_TOKENS = 100_000
#: Pairs of one row of partial counts.
PARTIAL_ROWS = 1 << 16

_A_BITS = 32
#: Characters of units that are encoded as one text.
JOINED = 1 << 17
#: White space before a space: no cut there.
_INSIDE = re.compile(r"\s ")
_REGULAR = re.compile(r" ?\S+")


def _cuts(pieces: list[str]) -> re.Pattern:
    """Where both tokenizers cut, whatever stands there.

    Before white space that begins with a space or line end, behind a character that is none; behind
    a single line end; and between a letter and a mark of punctuation, where B has no piece with both.
    A takes letters and marks apart, apostrophes left out.
    """
    letter, held = r"[^\W\d_]", " ".join(pieces)
    joined = {p: set(re.findall(f"({letter}){re.escape(p)}", held)) for p in ".,;:!?*%&)"}
    marks = "".join(p for p, letters in joined.items() if len(letters) < 5)
    letters = "".join(sorted(set().union(*(joined[p] for p in marks))))
    return re.compile(r"(?=[ \n])(?<=\S)|(?<=\n)(?<=\S\n)(?=\S)" + (f"|(?=[{re.escape(marks)}])(?<=[^\\W\\d_{letters}])" if marks else ""))


LINKS = """
with first as (select a.unit, a.id as a_id, f.id as b_id from a asof join b f on a.s >= f.s),
more as (select a.unit, a.id as a_id, b.id as b_id from a join b on b.s > a.s and b.s < a.e)
select * from first union all select * from more order by unit
"""
GROUPS = """
with every as (
 select 0 as side, a.i, a.unit, a.id, (b.e is not null)::int as cut from a left join b using (e)
 union all select 1, b.i, b.unit, b.id, (a.e is not null)::int from b left join a using (e)),
numbered as (select side, i, unit, id, coalesce(sum(cut) over (partition by side order by i rows between unbounded preceding and 1 preceding), 0)::bigint as g from every)
select unit, side, id, g from numbered order by g, side, i
"""


class Tokenizers:
    """Both tokenizers of a worker, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import duckdb
        import sentencepiece
        from tokenizers import Tokenizer

        from .tokens import byte_alphabet

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = {c: bytes((k,)) for k, c in enumerate(byte_alphabet())}
        n = self.a.get_vocab_size()
        self.a_bytes = [b"".join(byte.get(c, c.encode()) for c in self.a.id_to_token(i)) for i in range(n)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes((int(p[3:5], 16),)) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.blank = pieces.index("▁")
        # what stands behind a token in a group's text, for either side: within, before the other side, before a group, at the end
        self.shown = np.array([[f"{i}{end}" for i in range(max(n, len(pieces)))] for end in (",", "|", ";", "")], dtype=object)
        self.cut = _cuts(pieces)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})

    def units(self, text: str) -> list[str]:
        """A space and the text, cut where both tokenizers always cut."""
        return self.cut.split(" " + text)

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both for a text that begins with a space, which B adds by itself."""
        b = self.b.encode(text[1:], num_threads=1) or [self.blank]
        return np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64), np.array(b, np.int64)

    def _alone(self, unit: str) -> "Flat | None":
        """A unit's ids by itself: one that begins without a space stands behind a line end, which is cut off again."""
        if unit[0] == " ":
            a, b = self._ids(unit)
        elif unit[0] == "\n":
            a, b = self._ids(" ." + unit)
            a, b = a[1:], b[1:]
        else:
            a, b = self._ids(" .\n" + unit)
            a, b = a[2:], b[2:]
        return Flat(a, np.array([len(a)]), b, np.array([len(b)])) if self._same(a, b, unit) else None

    def _same(self, a: np.ndarray, b: np.ndarray, text: str) -> bool:
        raw = text.encode()
        return all(b"".join(map(t.__getitem__, ids.tolist())) == raw for t, ids in ((self.a_bytes, a), (self.b_bytes, b)))

    def encode(self, units: list[str]) -> tuple[list[str], "Flat", list[str]]:
        """(units whose tokens' bytes are theirs, those tokens, the other units).

        Units without white space but for one space in front are encoded many at once, as one text.
        """
        good, bad, flats, alone = [], [], [], []
        chosen, size = [], 0

        def together():
            flat = self._together(chosen)
            if flat is None:  # some unit's bytes differ
                alone.extend(chosen)
            else:
                good.extend(chosen)
                flats.append(flat)
            chosen.clear()

        for u in units:
            if not _REGULAR.fullmatch(u):
                alone.append(u)
                continue
            chosen.append(u)
            size += len(u)
            if size > JOINED:
                together()
                size = 0
        if chosen:
            together()
        for u in alone:
            flat = self._alone(u)
            (bad if flat is None else good).append(u)
            if flat is not None:
                flats.append(flat)
        return good, _joined(flats), bad

    def _together(self, units: list[str]) -> "Flat | None":
        parts, is_unit = [" ."], [False]
        for u in units:
            if u[0] != " ":
                parts.append("\n")
                is_unit.append(False)
            parts.append(u)
            is_unit.append(True)
        text, is_unit = "".join(parts), np.array(is_unit)
        a, b = self._ids(text)
        if not self._same(a, b, text):
            return None
        ends, out = np.cumsum([len(p.encode()) for p in parts]), []
        for ids, size in ((a, self.a_size), (b, self.b_size)):
            stop = np.cumsum(size[ids])
            part = np.searchsorted(ends, stop - size[ids], side="right")
            if not (stop <= ends[part]).all():
                return None
            out += [ids[is_unit[part]], np.bincount(part, minlength=len(parts))[is_unit]]
        return Flat(*out)

    def align(self, flat: "Flat") -> tuple[dict, list[str], np.ndarray]:
        """Links (unit, a_id, b_id) in order of the units, and each one's groups as text and their number."""
        import pyarrow as pa

        for name, ids, count, size in (("a", flat.a, flat.n_a, self.a_size), ("b", flat.b, flat.n_b, self.b_size)):
            ends = np.cumsum(size[ids])
            self.db.register(name, pa.table({"i": np.arange(len(ids)), "unit": np.repeat(np.arange(len(count)), count), "id": ids, "s": ends - size[ids], "e": ends}))
        links = self.db.execute(LINKS).fetchnumpy()
        held = self.db.execute(GROUPS).fetchnumpy()
        for name in ("a", "b"):
            self.db.unregister(name)
        unit, side, g = held["unit"], held["side"], held["g"]
        new_unit, new_group, new_side = np.diff(unit, append=-1) != 0, np.diff(g, append=-1) != 0, np.diff(side, append=-1) != 0
        end = np.where(new_unit, 3, np.where(new_group, 2, np.where(new_side, 1, 0)))
        texts = self.shown[end, held["id"]].tolist()
        stops = (np.flatnonzero(new_unit) + 1).tolist()
        shown = ["".join(texts[s:e]) for s, e in zip([0, *stops[:-1]], stops)]
        return links, shown, np.bincount(unit[new_group], minlength=len(flat.n_a))

    def pieces(self, flat: "Flat") -> tuple["Flat", np.ndarray]:
        """Long units cut at common ends into pieces of about LONG_TOKENS tokens, and how many pieces each unit has."""
        n = np.maximum(flat.n_a, flat.n_b)
        if not len(n) or n.max() <= LONG_TOKENS:
            return flat, np.ones(len(n), np.int64)
        at_a, at_b, out, parts = np.cumsum(flat.n_a) - flat.n_a, np.cumsum(flat.n_b) - flat.n_b, [], []
        for k in range(len(n)):
            a, b = flat.a[at_a[k] : at_a[k] + flat.n_a[k]], flat.b[at_b[k] : at_b[k] + flat.n_b[k]]
            ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
            common = np.intersect1d(ends_a, ends_b, assume_unique=True)
            to_a, to_b = np.searchsorted(ends_a, common) + 1, np.searchsorted(ends_b, common) + 1
            # the last common end of every stretch of LONG_TOKENS
            last = np.flatnonzero(np.diff(np.maximum(to_a, to_b) // LONG_TOKENS, append=-1))
            out.append(Flat(a, np.diff(to_a[last], prepend=0), b, np.diff(to_b[last], prepend=0)))
            parts.append(len(last))
        return _joined(out), np.array(parts)


class Flat(NamedTuple):
    """Ids of units one after another, and how many each unit has, for A and for B."""

    a: np.ndarray
    n_a: np.ndarray
    b: np.ndarray
    n_b: np.ndarray


def _joined(flats: list[Flat]) -> Flat:
    if not flats:
        return Flat(*[np.zeros(0, np.int64)] * 4)
    return Flat(*map(np.concatenate, zip(*flats)))


class _Lookup:
    """Numbers by whole units, spaces in front included."""

    def __init__(self, units: "Units"):
        self.get = units._find


class Units:
    """Units of a worker, numbered as they come, with their alignment; number 0 stands for units without tokens.

    The first UNIT_BYTES, which hold the frequent ones, stay for all texts and tasks to come; later
    ones are dropped whenever they take MORE_BYTES.

    ``word`` gives the number of a unit that begins with a space, by what stands behind it, ``known`` that
    of any other.  What stands between two spaces may be several units: it is in ``word`` too, as a
    negative number that stands for the ``several[-number]``.  Long ones are not remembered.
    """

    def __init__(self, both: Tokenizers):
        self.both = both
        self.word: dict[str, int] = {}
        self.known: dict[str, int] = {}
        self.several: list[tuple[int, ...]] = [()]
        self.shown = [""]
        self.sums = [np.zeros((1, 4), np.int64)]  # n_a, n_b, n_groups, n_links
        self.pair, self.unit, self.first = [], [], []  # links of units added together, in their order, and the first one's number
        self.bytes = 0
        self.kept = None  # where units begin that are dropped again: (bytes, several, numbers, additions)

    def drop(self) -> None:
        """Forget the units beyond the first ones."""
        self.bytes, several, numbers, additions = self.kept
        for unit in self.later:
            table, key = self._place(unit)
            table.pop(key, None)
        del self.several[several:], self.shown[numbers:], self.sums[additions + 1 :]
        for held in (self.pair, self.unit, self.first):
            del held[additions:]
        self.later.clear()

    def full(self) -> bool:
        """Whether it is time to drop; the first ones are closed on the way."""
        if self.kept is None and self.bytes > UNIT_BYTES:
            self.kept, self.later = (self.bytes, len(self.several), len(self.shown), len(self.pair)), []
        return self.kept is not None and self.bytes - self.kept[0] > MORE_BYTES

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """The sequence of unit numbers of each text: empty for empty texts and for those that have no tokens."""
        cut = [self._chunks(t) for t in texts]
        numbers = [list(map(table.get, chunks)) for table, chunks in cut]
        unknown = [k for k, got in enumerate(numbers) if None in got]
        if unknown:
            fresh = list(dict.fromkeys((" " + c if cut[k][0] is self.word else c) for k in unknown for c, n in zip(cut[k][1], numbers[k]) if n is None))
            long = self._number_all(fresh)
            for k in unknown:
                table, chunks = cut[k]
                numbers[k] = list(map(table.get, chunks))
            for u in long:
                table, key = self._place(u)
                del table[key]
        out = []
        for got in numbers:
            seq = np.array(self._expanded(got), np.int64)
            out.append(seq if len(seq) and seq.min() > 0 else seq[:0])
        return out

    def _number_all(self, chunks: list[str]) -> list[str]:
        """Number new chunks and the units they are cut into; those too long to be remembered come back."""
        parts = list(map(self.both.cut.split, chunks))
        self._number([u for u in dict.fromkeys(chain.from_iterable(parts)) if self._find(u) is None])
        for c, units in zip(chunks, parts):
            if len(units) > 1:
                self._remember(c, tuple(self._expanded(list(map(self._find, units)))))
        return [u for u in dict.fromkeys(chain(chunks, chain.from_iterable(parts))) if len(u) > LONG_UNIT]

    def _chunks(self, text: str) -> tuple[dict, list[str]]:
        """What a text is cut into, and the table that has its numbers."""
        if not text:
            return self.word, []
        if text[0] != " " and not _INSIDE.search(text):
            return self.word, text.split(" ")
        units = self.both.units(text)
        return _Lookup(self), units

    def _place(self, unit: str) -> tuple[dict, str]:
        return (self.word, unit[1:]) if unit[0] == " " else (self.known, unit)

    def _find(self, unit: str) -> int | None:
        return self.word.get(unit[1:]) if unit[0] == " " else self.known.get(unit)

    def _expanded(self, numbers: list[int]) -> list[int]:
        several = self.several
        return [m for n in numbers for m in (several[-n] if n < 0 else (n,))] if min(numbers, default=0) < 0 else numbers

    def _remember(self, unit: str, numbers: tuple[int, ...]) -> None:
        """A unit of one number as that; of several as a place among the ``several``."""
        table, key = self._place(unit)
        if len(numbers) == 1:
            table[key] = numbers[0]
        else:
            table[key] = -len(self.several)
            self.several.append(numbers)
            self.bytes += 80 + 8 * len(numbers)
        self._noted(unit)

    def _noted(self, unit: str) -> None:
        self.bytes += len(unit) + ENTRY_BYTES
        if self.kept is not None:
            self.later.append(unit)

    def _number(self, new: list[str]) -> None:
        good, flat, bad = self.both.encode(new)
        for u in bad:
            self._remember(u, (0,))
        if not good:
            return
        flat, parts = self.both.pieces(flat)
        first = len(self.shown)
        self._add(flat, *self.both.align(flat), first)
        if len(parts) == parts.sum():
            for u, n in zip(good, range(first, first + len(good))):
                table, key = self._place(u)
                table[key] = n
                self._noted(u)
        else:
            for u, stop, n in zip(good, (first + np.cumsum(parts)).tolist(), parts.tolist()):
                self._remember(u, tuple(range(stop - n, stop)))

    def _add(self, flat: Flat, links: dict, shown: list[str], n_groups: np.ndarray, first: int) -> None:
        count = len(flat.n_a)
        unit = links["unit"].astype(np.int64)
        self.sums.append(np.stack([flat.n_a, flat.n_b, n_groups, np.bincount(unit, minlength=count)], axis=1))
        self.shown += shown
        self.bytes += sum(map(len, shown)) + 100 * count + 16 * len(unit)
        self.pair.append(links["a_id"].astype(np.int64) << _A_BITS | links["b_id"].astype(np.int64))
        self.unit.append(unit + first)
        self.first.append(first)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(pair, unit) of every link."""
        none = [np.zeros(0, np.int64)]
        return np.concatenate(self.pair or none), np.concatenate(self.unit or none)


@functools.lru_cache(maxsize=1)
def _units(a_path: str, b_path: str) -> Units:
    import gc

    units = Units(Tokenizers(a_path, b_path))
    # the tables hold no cycles: searching them for some takes time
    gc.freeze()
    gc.set_threshold(200_000)
    return units


def worker_units(a_path: str, b_path: str) -> Units:
    """The units of this worker, which its tasks share."""
    one_table_at_a_time(f"align:{a_path}:{b_path}", _units.cache_clear)
    return _units(a_path, b_path)


def _slices(texts: list[str]):
    """(start, stop) of runs of texts of about TEXT_SLICE characters."""
    start = held = 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= TEXT_SLICE:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, at = np.unique(keys, return_inverse=True)
    return own, np.bincount(at, values, len(own)).astype(np.int64)


PARTIAL = "pair array<long>, n array<long>"


def _count_pairs(a_path: str, b_path: str, batches):
    """Partial counts of linked pairs: one set of rows whenever the units are full, and at the end."""
    import pyarrow as pa

    units = worker_units(a_path, b_path)
    used = np.zeros(0, np.int64)

    def close():
        pair, unit = units.links()
        times = np.zeros(len(units.shown), np.int64)
        times[: len(used)] = used
        got, total = _summed(pair, times[unit])
        for at in range(0, len(got), PARTIAL_ROWS):
            stop = at + PARTIAL_ROWS
            yield pa.RecordBatch.from_pydict({"pair": pa.array([got[at:stop]], pa.list_(pa.int64())), "n": pa.array([total[at:stop]], pa.list_(pa.int64()))})

    for b in batches:
        texts = b.column(0).to_pylist()
        for start, stop in _slices(texts):
            seqs = units.texts(texts[start:stop])
            more = np.bincount(np.concatenate(seqs), minlength=len(units.shown))
            more[: len(used)] += used
            used = more
            if units.full():
                yield from close()
                units.drop()
                used = np.zeros(0, np.int64)
    yield from close()


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, row long, cold array<long>, cold_n array<long>"


class _Values:
    """What each unit adds to a text: n_a, n_b, n_groups, n_links, links at their B id's best count, sum of counts; and the links of pairs outside the table."""

    def __init__(self, hot: tuple[np.ndarray, np.ndarray, np.ndarray], units: Units):
        self.pairs, self.counts, self.best = hot
        self.units = units
        self.taken, self.rows = 0, np.zeros((1024, 6), np.int64)
        self.cold_unit, self.cold_pair = [np.zeros(0, np.int64)] * 2
        self.update()

    def drop(self) -> None:
        """After the units' own ``drop``."""
        self.taken = len(self.units.pair)
        kept = np.searchsorted(self.cold_unit, len(self.units.shown))
        self.cold_unit, self.cold_pair = self.cold_unit[:kept], self.cold_pair[:kept]

    def update(self) -> None:
        """Take in the units that came since."""
        u = self.units
        size = len(u.shown)
        if size > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(size, 2 * len(self.rows)) - len(self.rows), 6), np.int64)])
        for k in range(self.taken, len(u.pair)):
            pair, unit, first = u.pair[k], u.unit[k], u.first[k]
            rows = self.rows[first : first + len(u.sums[k + 1])]
            rows[:, :4], rows[:, 4:] = u.sums[k + 1], 0
            found = np.zeros(len(pair), bool)
            if len(self.pairs):
                at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
                found = self.pairs[at] == pair
                np.add.at(rows[:, 4], unit[found] - first, self.best[at[found]].astype(np.int64))
                np.add.at(rows[:, 5], unit[found] - first, self.counts[at[found]])
            if not found.all():
                self.cold_unit = np.concatenate([self.cold_unit, unit[~found]])
                self.cold_pair = np.concatenate([self.cold_pair, pair[~found]])
        self.taken = len(u.pair)

    def cold(self, seq: np.ndarray) -> tuple[np.ndarray | None, np.ndarray | None]:
        """Pairs outside the table and how often a text links them."""
        if not len(self.cold_unit) or not len(seq):
            return None, None
        own, times = np.unique(seq, return_counts=True)
        start, stop = np.searchsorted(self.cold_unit, own), np.searchsorted(self.cold_unit, own, side="right")
        n = stop - start
        if not n.any():
            return None, None
        at = np.repeat(stop - np.cumsum(n), n) + np.arange(n.sum())  # the links of each unit, one unit after another
        return _summed(self.cold_pair[at], np.repeat(times, n))


def _align_rows(a_path: str, b_path: str, hot, batches):
    """Rows of the result, without what pairs outside the broadcast table add: these go along as ``cold`` pairs and their links."""
    import pyarrow as pa
    from pyspark import TaskContext

    units = worker_units(a_path, b_path)
    values = _Values(hot.value, units)
    row, many = TaskContext.get().partitionId() << 33, pa.list_(pa.int64())
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for start, stop in _slices(texts):
            seqs = units.texts(texts[start:stop])
            values.update()
            sums = np.array([values.rows[seq].sum(axis=0) for seq in seqs]).reshape(-1, 6)
            marks = [hashlib.sha256(";".join(map(units.shown.__getitem__, seq.tolist())).encode()).hexdigest() if len(seq) else "" for seq in seqs]
            cold = [values.cold(seq) for seq in seqs]
            n = stop - start
            arrays = [pa.array(ids[start:stop], pa.int64()), *map(pa.array, sums.T), pa.array(marks, pa.string()), pa.array(range(row, row + n), pa.int64()), *[pa.array(c, many) for c in zip(*cold)]]
            row += n
            yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in ROWS.split(", ")])
            if units.full():
                units.drop()
                values.drop()


def pair_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """pair (A's id, then 32 bits of B's), n (links in the corpus) and best (whether no pair of its B id has more), as a written table."""
    ship(docs.sparkSession)
    partial = docs.select(text_or_empty()).mapInArrow(functools.partial(_count_pairs, a_path, b_path), PARTIAL)
    pairs = partial.select(F.inline(F.arrays_zip("pair", "n"))).groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = written(pairs.where("n > 0"), "pairs")
    b_id = F.col("pair").bitwiseAND((1 << _A_BITS) - 1)
    # one row per id of B's vocabulary
    most = pairs.groupBy(b_id.alias("b_id")).agg(F.max("n").alias("most"))
    return pairs.join(most, b_id == most["b_id"]).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every text.

    Null and empty texts, and texts whose tokens' bytes are not the text's (B reads U+2581 as a
    space), have no tokens: zeros and an empty string, and nothing of them is counted.  Strings of
    special tokens are plain text.  Repeated rows and rows without doc_id each count and stay; an
    empty table gives no rows.  Columns other than doc_id and text are not read.  A text without
    spaces is one unit, encoded whole and aligned piece by piece.
    """
    spark = docs.sparkSession
    counts = written(pair_counts(docs, a_path, b_path), "counts")
    every = counts.count()
    hot = counts if every <= HOT_PAIRS else counts.orderBy(F.desc("n"), "pair").limit(HOT_PAIRS)
    if every > HOT_PAIRS:
        hot = written(hot, "hot")
    got = hot.toPandas().sort_values("pair")
    table = spark.sparkContext.broadcast((got["pair"].to_numpy(np.int64), got["n"].to_numpy(np.int64), got["best"].to_numpy(bool)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty()).mapInArrow(functools.partial(_align_rows, a_path, b_path, table), ROWS)
    if every <= HOT_PAIRS:
        return rows.select(*COLUMNS)
    rows = written(rows, "aligned")
    cold = rows.where("cold is not null").select("row", F.inline(F.arrays_zip(F.col("cold").alias("pair"), F.col("cold_n").alias("links"))))
    cold = cold.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more_sum"))
    more = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).cast("long").alias(c)
    return rows.join(cold, "row", "left").select(*[more(c, {"n_best": "more_best", "count_sum": "more_sum"}[c]) if c in ("n_best", "count_sum") else F.col(c) for c in COLUMNS])
