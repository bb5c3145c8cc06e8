"""Token-id files in patched frame-of-reference blocks.

A *segment* holds the ids of consecutive documents.  Its stream of ids is cut into blocks of
``BLOCK``.  A block stores its minimum, the differences from it packed at a width that
``PERCENTILE`` of them need, and the rest as exceptions (place, full difference).  The segment's
index gives where each block starts, so any block decodes alone:

    magic "PFB2" | u32 block size | u64 documents | u64 of them without doc_id (first) | u64 ids | u64 blocks
    i64 doc_id[documents] | u64 length[documents] | u64 start[blocks + 1]
    per block: u32 minimum | u8 width | u8 0 | u16 exceptions | packed | u8 place[] | u32 difference[]

Segments are the rows of a Parquet table (``part``, ``segment``, ``base``, ``n_ids``, ``payload``)
that Spark's writer puts in any store; ``part`` ascends with doc_id.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, shuffle_partitions, text_or_empty, written

BLOCK = 128
PERCENTILE = 90
#: Ids after which a segment is closed; a document is never cut.
SEGMENT_IDS = 1 << 19

SEGMENTS = "part int, segment int, base long, n_ids long, payload binary"
_MAGIC = b"PFB2"


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """rows (n, BLOCK) of integers below 2**width -> (n, BLOCK * width / 8) bytes, high bits first."""
    n, kind = len(rows), ">u2" if width <= 16 else ">u4"
    size = int(kind[2]) * 8
    bits = np.unpackbits(rows.astype(kind).view(np.uint8).reshape(n, BLOCK, size // 8), axis=2)
    return np.packbits(bits[:, :, size - width :].reshape(n, BLOCK * width), axis=1)


def _unpack(data: np.ndarray, width: int) -> np.ndarray:
    n, kind = len(data), ">u2" if width <= 16 else ">u4"
    size = int(kind[2]) * 8
    bits = np.zeros((n, BLOCK, size), np.uint8)
    bits[:, :, size - width :] = np.unpackbits(data, axis=1).reshape(n, BLOCK, width)
    return np.packbits(bits, axis=2).view(kind).reshape(n, BLOCK).astype(np.uint32)


def encode_segment(doc_ids, lengths, ids: np.ndarray) -> bytes:
    """Ids of whole documents (uint32, one after another) -> one segment; doc_ids that are None come first."""
    n, nulls = len(ids), sum(i is None for i in doc_ids)
    doc_ids = [0] * nulls + list(doc_ids[nulls:])
    blocks = -(-n // BLOCK)
    full = np.empty(blocks * BLOCK, np.uint32)
    full[:n] = ids
    full[n:] = ids[-1] if n else 0
    full = full.reshape(blocks, BLOCK)
    low = full.min(axis=1) if blocks else np.zeros(0, np.uint32)
    diff = full - low[:, None]
    rank = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    typical = np.partition(diff, rank, axis=1)[:, rank] if blocks else low
    width = np.ceil(np.log2(typical.astype(np.float64) + 1)).astype(np.int64)
    outlier = (diff.astype(np.uint64) >> width[:, None].astype(np.uint64)) > 0
    n_exc = outlier.sum(axis=1)
    size = 8 + BLOCK * width // 8 + 5 * n_exc
    start = np.zeros(blocks + 1, np.int64)
    np.cumsum(size, out=start[1:])
    body = np.zeros(int(start[-1]), np.uint8)
    head = np.zeros(blocks, np.dtype([("low", "<u4"), ("width", "u1"), ("zero", "u1"), ("exc", "<u2")]))
    head["low"], head["width"], head["exc"] = low, width, n_exc
    _scatter(body, start[:-1], head.view(np.uint8).reshape(blocks, 8))
    for w in np.unique(width):
        if w:
            at = np.flatnonzero(width == w)
            mask = np.uint32((1 << int(w)) - 1)
            _scatter(body, start[at] + 8, _pack(diff[at] & mask, int(w)))
    row, place = np.nonzero(outlier)
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n_exc) - n_exc, n_exc)
        at = start[row] + 8 + BLOCK * width[row] // 8
        body[at + nth] = place
        _scatter(body, at + n_exc[row] + 4 * nth, diff[row, place].astype("<u4").view(np.uint8).reshape(-1, 4))
    sizes = np.array([len(doc_ids), nulls, n, blocks], "<u8").tobytes()
    return b"".join((_MAGIC, np.uint32(BLOCK).tobytes(), sizes, np.asarray(doc_ids, "<i8").tobytes(), np.asarray(lengths, "<u8").tobytes(), start.astype("<u8").tobytes(), body.tobytes()))


def _scatter(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    if rows.size:
        out[at[:, None] + np.arange(rows.shape[1])] = rows


def read_index(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int, int]:
    """(doc ids, lengths, block starts, number of ids, where blocks begin, documents without doc_id) of a segment."""
    if payload[:4] != _MAGIC or int.from_bytes(payload[4:8], "little") != BLOCK:
        raise ValueError("not a segment of patched blocks")
    docs, nulls, n, blocks = (int(x) for x in np.frombuffer(payload, "<u8", 4, 8))
    at = 40
    doc_ids = np.frombuffer(payload, "<i8", docs, at)
    lengths = np.frombuffer(payload, "<u8", docs, at + 8 * docs).astype(np.int64)
    start = np.frombuffer(payload, "<u8", blocks + 1, at + 16 * docs).astype(np.int64)
    return doc_ids, lengths, start, n, at + 16 * docs + 8 * (blocks + 1), nulls


def decode_blocks(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks first..last (exclusive; all by default), found through the index."""
    _, _, start, n, at, _ = read_index(payload)
    last = len(start) - 1 if last is None else last
    body, start = np.frombuffer(payload, np.uint8, offset=at), start[first : last + 1]
    count = len(start) - 1
    if count <= 0:
        return np.zeros(0, np.uint32)
    head = body[start[:-1, None] + np.arange(8)].copy().view(np.dtype([("low", "<u4"), ("width", "u1"), ("zero", "u1"), ("exc", "<u2")])).reshape(-1)
    width, n_exc = head["width"].astype(np.int64), head["exc"].astype(np.int64)
    diff = np.zeros((count, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            diff[rows] = _unpack(body[start[rows, None] + 8 + np.arange(BLOCK * w // 8)], int(w))
    row = np.repeat(np.arange(count), n_exc)
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n_exc) - n_exc, n_exc)
        where = start[row] + 8 + BLOCK * width[row] // 8
        value = body[(where + n_exc[row] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").reshape(-1)
        diff[row, body[where + nth]] = value
    ids = (diff + head["low"][:, None]).reshape(-1)
    return ids[: n - first * BLOCK] if last * BLOCK > n else ids


def write_segments(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write segments in ascending doc_id order; the table as read back.

    One shuffle: texts are range-partitioned by doc_id (bounds come from a scan, not from encoding),
    sorted, encoded and packed in one pass.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())
    rows = rows.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from .tokens import library_encoder

        encode, end = library_encoder(tokenizer_path), np.uint32(end_id).tobytes()
        part, made, base = TaskContext.get().partitionId(), 0, 0
        doc_ids, parts, held = [], [], 0

        def close():
            nonlocal made, base, doc_ids, parts, held
            ids = np.frombuffer(b"".join(parts), "<u4")
            payload = encode_segment(doc_ids, [len(p) // 4 for p in parts], ids)
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "segment": pa.array([made], pa.int32()), "base": pa.array([base], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()), "payload": pa.array([payload], pa.binary())})
            made, base, doc_ids, parts, held = made + 1, base + len(ids), [], [], 0
            return out

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = encode(text) + end
                doc_ids.append(i)
                parts.append(got)
                held += len(got) // 4
                if held >= SEGMENT_IDS:
                    yield close()
        if doc_ids:
            yield close()

    return written(rows.mapInArrow(run, SEGMENTS), "tokens", compression="none")


def part_starts(segments: DataFrame) -> dict[int, int]:
    """Ids before each part: one total a partition comes to the driver, never one a document."""
    totals, at, out = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect(), 0, {}
    for r in sorted(totals, key=lambda r: r["part"]):
        out[r["part"]] = at
        at += r["n"]
    return out


def read_documents(segments: DataFrame) -> DataFrame:
    """Decode segments: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    starts = part_starts(segments)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for part, base, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                doc_ids, lengths, *_, nulls = read_index(payload)
                raw = decode_blocks(payload).astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                begins = ends - lengths
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(begins.tolist(), ends.tolist())]
                shown = pa.array([None] * nulls + doc_ids[nulls:].tolist(), pa.int64())
                yield pa.RecordBatch.from_pydict({"doc_id": shown, "start": pa.array(begins + base + starts[part]), "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crc, pa.int64())})

    return segments.select("part", "base", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write and read back.

    Null texts count as empty and give the end id alone; an empty table gives no rows; repeated rows
    stay, each with its own place (ties on doc_id in text order); null doc_ids come first; columns
    other than doc_id and text are not read.
    """
    return read_documents(write_segments(docs, tokenizer_path))
