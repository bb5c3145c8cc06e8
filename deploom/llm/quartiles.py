"""Document fingerprints: bytes in threes hashed to buckets, each bucket's quartile, and the length.

Every window of five bytes gives six triplets; each is hashed to one of ``BUCKETS`` counters.  A
counter is encoded by the quartile of all counters that it falls into (two bits), so a fingerprint
neither grows with the text nor changes where all of it is repeated.  The length goes beside on a logarithmic scale.

Two fingerprints are compared by a difference score: quartiles apart, summed over the buckets, and
steps of length apart, ``LENGTH_CAP`` at most.  The score's bound is what it would be if each bucket
were empty on one side; likeness is one less their ratio.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, shuffle_partitions, text_or_empty, written

BUCKETS = 512
#: Places of the triplets in a window of five bytes.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4))
#: Steps of the length per factor of two, the most that count, and what a step weighs against one quartile.
LENGTH_STEPS, LENGTH_CAP, LENGTH_WEIGHT = 8, 16, 10
#: Bytes hashed at once.
SLICE = 1 << 20
#: No byte of UTF-8: a text's ends are triplets too.
_EDGE = b"\xff\xff"


def _buckets(data: np.ndarray, n: int, place: tuple[int, int, int], salt: int) -> np.ndarray:
    """The bucket of the triplet at each of the first n bytes."""
    a, b, c = (data[p : p + n] for p in place)
    h = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77) + c * np.uint32(0xC2B2AE3D) + np.uint32(salt * 0x27D4EB2F & 0xFFFFFFFF)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    return h % np.uint32(BUCKETS)


def counts(raw: bytes) -> np.ndarray:
    """How many triplets of a text fall into each bucket; a text without bytes has none."""
    out = np.zeros(BUCKETS, np.int64)
    if not raw:
        return out
    ends = _EDGE + raw + _EDGE
    for at in range(0, len(ends), SLICE):
        data = np.frombuffer(ends[at : at + SLICE + 4], np.uint8).astype(np.uint32)
        for salt, place in enumerate(TRIPLETS):
            n = min(SLICE, len(data) - place[2])
            if n > 0:
                out += np.bincount(_buckets(data, n, place, salt), minlength=BUCKETS)
    return out


def length_code(n: int) -> int:
    return int(round(LENGTH_STEPS * np.log2(1 + n)))


def fingerprint(raw: bytes) -> str:
    """Hex: two bytes of length, then the quartile of each bucket, two bits each."""
    c = counts(raw)
    q = np.partition(c, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1])[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (c[:, None] > q).sum(axis=1).astype(np.uint8).reshape(-1, 4)
    return length_code(len(raw)).to_bytes(2, "big").hex() + (code[:, 0] << 6 | code[:, 1] << 4 | code[:, 2] << 2 | code[:, 3]).astype(np.uint8).tobytes().hex()


def codes(shown: str) -> tuple[int, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(shown), np.uint8)
    packed = raw[2:]
    return int(raw[0]) << 8 | int(raw[1]), np.stack([packed >> 6, packed >> 4 & 3, packed >> 2 & 3, packed & 3], axis=1).reshape(-1).astype(np.int64)


def likeness(one: str, other: str) -> float:
    """1 for equal fingerprints, 0 if they share nothing."""
    (n, a), (m, b) = codes(one), codes(other)
    apart = min(abs(n - m), LENGTH_CAP)
    score = int(np.abs(a - b).sum()) + LENGTH_WEIGHT * apart
    bound = int(np.maximum(a, b).sum()) + LENGTH_WEIGHT * (LENGTH_CAP if max(n, m) else 0)
    return 1.0 - score / bound if bound else 1.0


def edit(text: str, following: str) -> str:
    """The last third of a text replaced by as much of the beginning of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


ROWS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_STAGED = ROWS + ", part int, kind int, text string"
INNER, FIRST, LAST = 0, 1, 2


def compared(doc_id, text: str, mark: str, following: str, next_mark: str) -> tuple:
    """One row of the result: a text and its fingerprint, the next text and its."""
    changed = edit(text, following).encode()
    other = mark if changed == text.encode() else fingerprint(changed)
    return doc_id, len(text), hashlib.sha256(changed).hexdigest(), mark, other, likeness(mark, other), likeness(mark, next_mark)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likeness to the edited and to the next one.

    The next document is the one that follows in descending doc_id (null doc_ids last, equal ones by
    the md5 of their texts), the first one after the last; a table of one row follows itself.  Null
    texts are empty; an empty text has the fingerprint of no triplets, and is edited to an empty
    one.  Repeated rows stay and follow one another.  Columns other than doc_id and text are not read.

    Rows are dealt by ranges of the order, so each part pairs its rows as they come.  Only the first
    and last row of a part, whose neighbours are elsewhere, are written with their texts and paired
    by a join.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())
    rows = rows.withColumn("tie", F.md5("text")).withColumn("salt", F.rand(5))
    order = F.col("doc_id").desc_nulls_last()
    dealt = rows.repartitionByRange(shuffle_partitions(spark), order, "tie", "salt").sortWithinPartitions(order, "tie")
    staged = written(dealt.select("doc_id", "text").mapInArrow(_pair_rows, _STAGED), "fingerprints")
    ends = staged.where(f"kind <> {INNER}").select("part", "kind", "doc_id", "text", "fingerprint")
    first = ends.where(f"kind = {FIRST}").select(F.col("part").alias("at"), F.col("text").alias("following"), F.col("fingerprint").alias("next_mark"))
    # one number for each part that holds rows
    parts = first.select("at")
    ring = Window.orderBy("at")
    after = parts.select(F.col("at").alias("part"), F.coalesce(F.lead("at").over(ring), F.first("at").over(ring)).alias("at"))
    last = ends.where(f"kind = {LAST}").select("part", "doc_id", "text", "fingerprint")
    met = last.join(after, "part").join(first, "at").select("doc_id", "text", "fingerprint", "following", "next_mark")
    names = [c.split()[0] for c in ROWS.split(", ")]
    return staged.where(f"kind = {INNER}").select(*names).unionByName(met.mapInArrow(_meet_rows, ROWS))


def _arrow(rows: list[tuple], ddl: str):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    fields = [f.split() for f in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def _pair_rows(batches):
    from pyspark import TaskContext

    part, held = TaskContext.get().partitionId(), None
    end = lambda kind, doc_id, text, mark: (doc_id, None, None, mark, None, None, None, part, kind, text)
    for b in batches:
        out = []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            mark = held[2] if held and held[1] == text else fingerprint(text.encode())
            if held:
                out.append((*compared(*held, text, mark), part, INNER, None))
            else:
                out.append(end(FIRST, doc_id, text, mark))
            held = doc_id, text, mark
        yield _arrow(out, _STAGED)
    if held:
        yield _arrow([end(LAST, *held)], _STAGED)


def _meet_rows(batches):
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(5))):
            yield _arrow([compared(*row)], ROWS)
