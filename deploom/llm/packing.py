"""Best-fit packing of documents into fixed-length training sequences.

Bounded-space online best-fit: a task keeps at most ``OPEN_BINS`` sequences open, found through a
bitset keyed by free space (bit f is set while some open sequence has f free tokens).  A piece goes
where the least space remains; if none fits a new sequence opens, and when too many are open the
fullest closes first.  The pieces of sequences still open after ``TASK_PIECES`` pieces are dealt anew in
a second round, longest first, by the same packer; what is open after that stays part-filled: at most
``OPEN_BINS`` sequences for every ``TASK_PIECES`` pieces of the second round.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, ship, text_or_empty, written

SEQUENCE = 2048
OPEN_BINS = 2048
#: Pieces that one packer takes: many enough that its open sequences hardly count, few enough to be held.
TASK_PIECES = 200_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class BestFit:
    """Online packer; ``add(length)`` gives (sequence number, offset)."""

    def __init__(self, capacity: int = SEQUENCE, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.open, self.made = 0, 0, 0  # bitset of free space, sequences open, sequences begun
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError("a piece must have 1 to capacity tokens")
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self.take(free)
        else:
            free, number = self.capacity, self.made
            self.made += 1
        if left := free - length:
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.open_bins:
                self.take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        return number, self.capacity - free

    def take(self, free: int) -> int:
        number = self.by_free[free].pop()
        self.open -= 1
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        return number


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Encode each text once, add the end id, cut only what is longer than a sequence; one row a piece."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())

    def run(b):
        from .tokens import library_encoder

        encode, end = library_encoder(tokenizer_path), np.uint32(end_id).tobytes()
        doc, piece, start, length, crc = [], [], [], [], []
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids = encode(text) + end
            for k in range(0, len(ids), 4 * SEQUENCE):
                own = ids[k : k + 4 * SEQUENCE]
                doc.append(i)
                piece.append(k // (4 * SEQUENCE))
                start.append(k // 4)
                length.append(len(own) // 4)
                crc.append(zlib.crc32(own))
        return {"doc_id": doc, "piece": piece, "start": start, "length": length, "ids_crc32": crc}

    return map_batches(rows, run, PIECES)


def _fill(pieces: DataFrame, first: int) -> DataFrame:
    """One round: ``pieces`` with sequence_id (from ``first``), offset, and whether the sequence was still open at the end.

    No shuffle: neighbouring input splits are joined until a task has about ``TASK_PIECES`` rows, and a
    task begins a new packer after so many.
    """
    ship(pieces.sparkSession)
    names, schema = pieces.columns, pieces.schema

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = first + (TaskContext.get().partitionId() << 36)
        held, rows = [], 0

        def close():
            nonlocal number, held, rows
            packer, t = BestFit(), pa.Table.from_batches(held).combine_chunks()
            got = [packer.add(n) for n in t.column("length").to_pylist()]
            still = {x for own in packer.by_free for x in own}
            ids, offset = pa.array([number + g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())
            t = pa.Table.from_arrays([*t.columns, ids, offset, pa.array([g[0] in still for g in got])], names=[*names, "sequence_id", "offset", "open"])
            number, held, rows = number + packer.made, [], 0
            return t.to_batches(max_chunksize=10_000)

        for b in batches:
            while b.num_rows:
                part = b.slice(0, TASK_PIECES - rows)
                held.append(part)
                rows += part.num_rows
                b = b.slice(part.num_rows)
                if rows == TASK_PIECES:
                    yield from close()
        if rows:
            yield from close()

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", sequence_id long, offset long, open boolean"
    return pieces.mapInArrow(run, ddl)


def pack_pieces(pieces: DataFrame) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (PIECES), a written table whose ``length`` is 1 to ``SEQUENCE``."""
    names = pieces.columns
    tasks = max(1, round(pieces.count() / TASK_PIECES))
    once = written(_fill(pieces.coalesce(tasks), 0), "packed")
    rest = once.where("open").select(*names)
    tasks = max(1, round(rest.count() / TASK_PIECES))
    again = _fill(rest.coalesce(tasks).sortWithinPartitions(F.desc("length")), 1 << 62)
    return once.where(~F.col("open")).unionByName(again).select(*names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Pack whole documents.

    Null texts count as empty (one piece holding the end id); repeated rows are packed each, as are rows
    of one doc_id; null doc_ids stay null; any order of equal lengths will do; an empty table gives no
    rows; columns other than doc_id and text are not read, whatever their names.
    """
    return pack_pieces(written(cut_pieces(docs, tokenizer_path), "pieces"))
