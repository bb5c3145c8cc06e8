"""Repeated passages: Burrows-Wheeler transforms of shards, merged by refining their interleave.

A byte goes if a 100-byte string that covers it also starts earlier.  Sorting all suffixes of a corpus
anew is out of reach, and not needed: only windows of 100 bytes must be told apart.

1. Documents are put into *shards* (about 1 MB, compressed, one row each), kept as a table dealt by shard.
2. Each window picks an *anchor* inside it: the place of the smallest 8-byte hash among those whose 66
   bytes before or after fit as well.  Equal windows pick the same anchor.  Anchors whose 66 bytes occur
   once in the corpus cannot lie in a repeat; the others' windows, as runs of neighbouring starts, make
   the shard's *records*, aligned on their anchor at column ``SPAN`` and dealt to buckets by those 66 bytes.
3. A shard sends each bucket the transform of its records: per column the symbols in the order of the
   suffixes that begin one column on (the transform of aligned strings, where the step to the left of a
   suffix stays in its record).
4. A bucket merges the transforms of its shards.  The interleave begins as shard after shard; each column
   refines it by one symbol: every rank takes its shard's next symbol from the transform, and the stable
   order of these symbols is the interleave one column to the left.  No suffix is compared or sorted.
   The common prefix of neighbours follows along: one more than the least of those between their former
   ranks where they take the same symbol, none otherwise.  Stretches with 100 bytes in common are the
   repeated intervals, of which the earliest start stays.
5. Records of anchors that occur more than ``HOT`` times first meet in parts of a bucket, each of about
   the square root of all shards.  Windows still without an earlier copy there are dealt on by their own
   100 bytes, so that neither a passage nor a short line that stands in every document fills a task.
6. Intervals return to their shard, where covered bytes are taken out.

Only blobs travel: per (shard, bucket) one row, however common a passage is.
"""

from __future__ import annotations

import atexit
import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _remove, quoted, shared_dir, ship, shuffle_partitions, written

LENGTH = 100
#: Bytes of text in a shard, and of compressed text in one partition of the shards' table.
SHARD_BYTES, PART_BYTES = 1 << 20, 32 << 20
#: Compressed text bytes for which three buckets are made.
BUCKET_BYTES = 16 << 20
#: The context that identifies an anchor, and how far before a window's anchor it starts on the left side.
CORE, REACH = 66, 32
SIDE = CORE - REACH
SPAN = LENGTH - REACH
WIDTH = SPAN + LENGTH
#: Occurrences from which an anchor's records meet in parts first.
HOT = 256
#: Bits of a place in a shard, below the hash that chooses anchors: the same for all shards.
PLACE = 40

_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
SHARD = "shard long, doc_ids binary, nulls binary, lengths binary, data binary, rest binary"
#: What stands for a null doc_id where age counts: nothing is earlier.
_NULL_ID = -(1 << 63)


def _zip(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def _unzip(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def make_shards(docs: DataFrame, keep_columns: bool) -> DataFrame:
    """Pack documents into shards; with ``keep_columns`` their other columns ride along as Arrow bytes."""
    ship(docs.sparkSession)
    names = docs.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the others by their place: Arrow functions name their input's columns unquoted
    others = [quoted(c).alias(f"c{k}") for k, c in enumerate(c for c in names if c != "text")] if keep_columns else []
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("bytes"), F.col("text").isNull().alias("null"), *others)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = b.column(0).to_pylist()
            k = 0
            while k < len(texts):
                begin, held, size = k, [], 0
                while k < len(texts) and (size < SHARD_BYTES):
                    held.append(texts[k].encode())
                    size += len(held[-1])
                    k += 1
                rest = b""
                if keep_columns:
                    part = b.slice(begin, k - begin).select(b.schema.names[2:])
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema) as w:
                        w.write_batch(part)
                    rest = _zip(sink.getvalue().to_pybytes())
                yield pa.RecordBatch.from_pydict({"shard": pa.array([number], pa.int64()), "doc_ids": pa.array([np.array([_NULL_ID if i is None else i for i in ids[begin:k]], "<i8").tobytes()], pa.binary()), "nulls": pa.array([bytes(i is None for i in ids[begin:k])], pa.binary()), "lengths": pa.array([np.array([len(x) for x in held], "<i8").tobytes()], pa.binary()), "data": pa.array([_zip(b"".join(held))], pa.binary()), "rest": pa.array([rest], pa.binary())})
                number += 1

    return _dealt_by_shard(rows.mapInArrow(run, SHARD), docs)


def _dealt_by_shard(shards: DataFrame, docs: DataFrame) -> DataFrame:
    """A written table dealt by shard: what is joined to it by shard comes to it, its own rows stay."""
    spark = shards.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-size // (3 * PART_BYTES)))
    name = f"deploom_shards_{uuid.uuid4().hex[:12]}"
    path = f"{shared_dir(spark)}/{name}"
    shards.repartition(parts, "shard").write.format("parquet").option("compression", "none").option("path", path).bucketBy(parts, "shard").sortBy("shard").saveAsTable(name)
    atexit.register(_remove, spark, path)
    return spark.table(name)


class Runs:
    """Windows of one shard as runs of neighbouring starts that share an anchor and a side of it."""

    def __init__(self, data: bytes, lengths: np.ndarray):
        self.data = data
        n = len(data)
        ends = np.cumsum(lengths)
        begins = ends - lengths
        last = ends - LENGTH  # last start in each document
        long_ = np.flatnonzero(lengths >= LENGTH)
        if not len(long_):
            self.start = self.count = self.left = self.doc = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        a = np.frombuffer(data, np.uint8).astype(np.uint64)
        for step in (1, 2, 4):
            a = a[:-step] | a[step:] << np.uint64(8 * step)
        order = (a * np.uint64(_ODD[0])) & np.uint64(~((1 << PLACE) - 1) & (1 << 64) - 1) | np.arange(len(a), dtype=np.uint64)
        width, done = SPAN + 1, 1
        while done < width:  # smallest of the window's possible anchors, leftmost at ties
            step = min(done, width - done)
            order = np.minimum(order[:-step], order[step:])
            done += step
        anchor = (order & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        starts = np.concatenate([np.arange(begins[d], last[d] + 1) for d in long_])
        doc = np.repeat(long_, last[long_] + 1 - begins[long_])
        at = anchor[starts]
        side = at - starts >= SIDE
        new = np.ones(len(starts), bool)
        new[1:] = (at[1:] != at[:-1]) | (side[1:] != side[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        self.start = starts[first]
        self.count = np.diff(np.append(first, len(starts)))
        self.left = at[first] - self.start
        self.doc = doc[first]
        core = at[first] - np.where(side[first], SIDE, 0)
        key = side[first].astype(np.uint64) + np.uint64(1)
        for k in (*range(0, CORE - 8, 8), CORE - 8):
            key = (key ^ a[core + k]) * np.uint64(_ODD[1])
            key ^= key >> np.uint64(31)
        key = key * np.uint64(_ODD[2])
        self.key = key ^ (key >> np.uint64(29))


RECORD = np.dtype([("doc_id", "<i8"), ("shard", "<i8"), ("doc", "<i4"), ("start", "<i8"), ("count", "<i2"), ("left", "<i2")])
COVER = np.dtype([("doc", "<i4"), ("first", "<i8"), ("last", "<i8")])  # starts first..last, in bytes of the document
#: A transform on its way: bucket, part (-1: not in parts), its records, its columns; or the covers of a shard.
SENT = "bucket int, part int, records binary, columns binary, shard long, covers binary"


def _sent(rows: list[tuple]):
    import pyarrow as pa

    kinds = (("bucket", pa.int32()), ("part", pa.int32()), ("records", pa.binary()), ("columns", pa.binary()), ("shard", pa.int64()), ("covers", pa.binary()))
    return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds)})


def _grouped(keys: np.ndarray):
    """Places in the order of equal keys, and per key (key, its stretch of that order)."""
    order = np.argsort(keys, kind="stable")
    own, first = np.unique(keys[order], return_index=True)
    return order, list(zip(own.tolist(), map(slice, first.tolist(), [*first[1:].tolist(), len(order)])))


def _short(key: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket above 32 more bits of the key: all that is sent.  A clash only makes a candidate more."""
    return key % np.uint64(buckets) << np.uint64(32) | key // np.uint64(buckets) & np.uint64(0xFFFFFFFF)


def transforms(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """(width, n): the transforms of the groups of aligned records, side by side; ``rows`` (n, width) in the order of ``group``.

    Column c lists the symbols at c, in each group by the order of its suffixes from c + 1.
    """
    table = np.ascontiguousarray(rows.T)
    out, order = np.empty_like(table), np.arange(len(rows))
    number = np.unique(group, return_inverse=True)[1]
    number = number.astype(np.uint16 if len(rows) == 0 or number[-1] < 1 << 16 else np.int64)
    for c in range(len(table) - 1, -1, -1):
        out[c] = table[c][order]
        order = order[np.argsort(out[c], kind="stable")]
        order = order[np.argsort(number[order], kind="stable")]
    return out


def merged(columns: list[np.ndarray]):
    """Merge transforms (width, n) by refining their interleave; per column from the last: (column, records, symbols, common).

    ``records``: numbers of the records, source after source, in the order of their suffixes from the column;
    ``symbols``: theirs at the column; ``common``: bytes that each suffix has in common with the one before.
    """
    sizes = [c.shape[1] for c in columns]
    flat, n = np.concatenate(columns, axis=1), sum(sizes)
    source = np.repeat(np.arange(len(sizes)), sizes).astype(np.uint16 if len(sizes) < 1 << 16 else np.int64)
    records, place, common = np.arange(n), np.arange(n), np.zeros(n, np.uint8)
    for c in range(len(flat) - 1, -1, -1):
        symbols = flat[c][place]  # each rank takes the next one of its source
        order = np.argsort(symbols, kind="stable")
        symbols = symbols[order]
        same = np.flatnonzero(symbols[1:] == symbols[:-1]) + 1
        refined = np.zeros(n, np.uint8)
        if len(same):
            between = np.stack((order[same - 1], order[same]), axis=1).ravel() + 1
            refined[same] = np.minimum.reduceat(np.append(common, 0), between)[::2] + 1
        common, records, source = refined, records[order], source[order]
        place = np.empty(n, np.int64)
        place[np.argsort(source, kind="stable")] = np.arange(n)
        yield c, records, symbols, common


def find_covers(shards: DataFrame) -> DataFrame:
    """shard, covers: per row a blob of ``COVER`` intervals of starts whose windows begin earlier elsewhere."""
    import pyarrow as pa

    spark = shards.sparkSession
    sizes = shards.agg(F.sum(F.octet_length("data")), F.count("*")).first()
    buckets = max(shuffle_partitions(spark), -(-3 * (sizes[0] or 0) // BUCKET_BYTES))
    parts = max(1, int(sizes[1] ** 0.5))

    def keys(batches):
        for b in batches:
            for shard, lengths, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                key, n = np.unique(_short(Runs(_unzip(data), np.frombuffer(lengths, "<i8")).key, buckets), return_counts=True)
                _, groups = _grouped((key >> np.uint64(32)).astype(np.int64))
                if groups:
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([g for g, _ in groups], pa.int32()), "shard": pa.array([shard] * len(groups), pa.int64()), "keys": pa.array([key[x].astype("<u4").tobytes() for _, x in groups], pa.binary()), "counts": pa.array([_zip(n[x].astype("<u4").tobytes()) for _, x in groups], pa.binary())})

    dealt = shards.select("shard", "lengths", "data").mapInArrow(keys, "bucket int, shard long, keys binary, counts binary")

    def repeated(t):
        own = [np.frombuffer(x, "<u4") for x in t.column("keys").to_pylist()]
        counts = np.concatenate([np.frombuffer(_unzip(x), "<u4") for x in t.column("counts").to_pylist()]).astype(np.int64)
        _, back = np.unique(np.concatenate(own), return_inverse=True)
        total = np.split(np.bincount(back, weights=counts)[back], np.cumsum([len(p) for p in own])[:-1])
        twice, hot = ([p[n >= least].tobytes() for p, n in zip(own, total)] for least in (2, HOT))
        return pa.table({"shard": t.column("shard"), "bucket": t.column("bucket"), "twice": pa.array(twice, pa.binary()), "hot": pa.array(hot, pa.binary())})

    # a partition per bucket, however many the session has by default: no task grows with the input
    known = dealt.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(repeated, "shard long, bucket int, twice binary, hot binary")
    # what a shard gets back is no more than the keys of its own 1 MB
    known = known.groupBy("shard").agg(F.collect_list(F.struct("bucket", "twice", "hot")).alias("known"))
    joined = shards.select("shard", "doc_ids", "lengths", "data").join(known, "shard")

    def candidates(batches):
        for b in batches:
            for row in b.to_pylist():
                yield from _candidates(row, buckets, parts).to_batches()

    def merge(t):
        rows = [(None, None, None, None, s, c) for s, c in zip(t.column("shard").to_pylist(), t.column("covers").to_pylist()) if c]
        records = [np.frombuffer(_unzip(x), RECORD) for x in t.column("records").to_pylist()]
        columns = [np.frombuffer(_unzip(x), np.uint8).reshape(-1, len(r)) for x, r in zip(t.column("columns").to_pylist(), records)]
        covers, windows = merge_records(records, columns, t.column("part")[0].as_py() >= 0)
        rows += [(None, None, None, None, *x) for x in covers]
        if windows:
            rows += _windows(*windows, buckets)
        return _sent(rows)

    # both kinds of rows are read from the written table: intervals, and windows that are dealt on
    once = written(joined.mapInArrow(candidates, SENT).repartition(buckets, "bucket", "part").groupBy("bucket", "part").applyInArrow(merge, SENT), "merged", compression="none")
    again = once.where("bucket is not null").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(merge, SENT)
    return once.where("bucket is null").select("shard", "covers").unionByName(again.select("shard", "covers"))


def _candidates(row: dict, buckets: int, parts: int):
    """Transforms of one shard for each bucket; windows that repeat within the shard in the same run are covered at once."""
    data, lengths = _unzip(row["data"]), np.frombuffer(row["lengths"], "<i8")
    doc_ids, begins, runs = np.frombuffer(row["doc_ids"], "<i8"), np.cumsum(lengths) - lengths, Runs(data, lengths)
    twice, hot = (np.concatenate([np.frombuffer(x[name], "<u4").astype(np.uint64) | np.uint64(x["bucket"] << 32) for x in row["known"]]) for name in ("twice", "hot"))
    short = _short(runs.key, buckets)
    at = np.flatnonzero(np.isin(short, twice))
    # by age, so that the earliest of equal runs stays
    at = at[np.lexsort((runs.start[at], doc_ids[runs.doc[at]]))] if len(at) else at
    seen, keep = set(), np.ones(len(at), bool)
    for k, (s, c, left) in enumerate(zip(runs.start[at].tolist(), runs.count[at].tolist(), runs.left[at].tolist())):
        body = (left, data[s : s + c + LENGTH - 1])
        if body in seen:
            keep[k] = False
        seen.add(body)
    covered, at = at[~keep], at[keep]
    cover = np.zeros(len(covered), COVER)
    if len(covered):
        cover["doc"] = runs.doc[covered]
        cover["first"] = runs.start[covered] - begins[runs.doc[covered]]
        cover["last"] = cover["first"] + runs.count[covered] - 1
    part = row["shard"] * _ODD[0] % (1 << 64) >> 40
    where = np.where(np.isin(short[at], hot), part % parts, -1)
    order, groups = _grouped((short[at] >> np.uint64(32)).astype(np.int64) * (parts + 1) + where + 1)
    at = at[order]
    record = np.zeros(len(at), RECORD)
    if len(at):
        for name, x in (("doc_id", doc_ids[runs.doc[at]]), ("shard", row["shard"]), ("doc", runs.doc[at]), ("start", runs.start[at] - begins[runs.doc[at]]), ("count", runs.count[at]), ("left", runs.left[at])):
            record[name] = x
    rows = np.zeros((len(at), WIDTH), np.uint8)
    size = runs.count[at] + LENGTH - 1
    shift = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    rows[np.repeat(np.arange(len(at)), size), np.repeat(SPAN - runs.left[at], size) + shift] = np.frombuffer(data, np.uint8)[np.repeat(runs.start[at], size) + shift]
    group = np.zeros(len(at), np.int64)
    for k, (_, own) in enumerate(groups):
        group[own] = k
    columns = transforms(rows, group)
    out = [(g // (parts + 1), g % (parts + 1) - 1, _zip(record[own].tobytes()), _zip(columns[:, own].tobytes()), row["shard"], None) for g, own in groups]
    if len(cover):
        out[0] = (*out[0][:5], cover.tobytes())  # any row of the shard may carry them
    return _sent(out)


def merge_records(records: list[np.ndarray], columns: list[np.ndarray], pass_on: bool = False):
    """Merge transforms of aligned records: covered starts as (shard, blob), and the windows to ``pass_on``.

    Those are the windows without an earlier copy here, as records of one window each, and their bytes.
    """
    rec = np.concatenate(records)
    n, width = len(rec), len(columns[0])
    column = width - LENGTH - rec["left"].astype(np.int64)  # of the first start
    last_column = column + rec["count"] - 1
    same = np.lexsort((rec["doc"], rec["shard"], rec["doc_id"]))
    document, fields = np.zeros(n, np.int64), rec[["doc_id", "shard", "doc"]][same]
    document[same] = np.cumsum(np.concatenate(([0], (fields[1:] != fields[:-1]).astype(np.int64))))
    covered = np.zeros((width - LENGTH + 1, n), bool)
    rows = np.zeros((n, width), np.uint8) if pass_on else None
    for c, own, symbols, common in merged(columns):
        if pass_on:
            rows[own, c] = symbols
        if c > width - LENGTH:
            continue
        interval = np.cumsum(common < LENGTH)
        inside = (column[own] <= c) & (c <= last_column[own])
        own, interval = own[inside], interval[inside]
        if not (interval[1:] == interval[:-1]).any():
            continue
        begin = rec["start"][own] + (c - column[own])
        order = np.lexsort((begin, document[own], interval))
        own, interval = own[order], interval[order]
        covered[c, own[1:][interval[1:] == interval[:-1]]] = True
    edge = np.diff(np.concatenate((np.zeros((1, n), np.int8), covered.astype(np.int8), np.zeros((1, n), np.int8))), axis=0).T
    at, first = np.nonzero(edge == 1)
    _, after = np.nonzero(edge == -1)
    cover = np.zeros(len(at), COVER)
    cover["doc"] = rec["doc"][at]
    cover["first"] = rec["start"][at] + first - column[at]
    cover["last"] = rec["start"][at] + after - 1 - column[at]
    order, groups = _grouped(rec["shard"][at])
    covers = [(shard, cover[order[own]].tobytes()) for shard, own in groups]
    if not pass_on:
        return covers, None
    place = np.arange(len(covered))[:, None]
    c, at = np.nonzero(~covered & (column <= place) & (place <= last_column))
    single = rec[at]
    single["start"] += c - column[at]
    single["count"], single["left"] = 1, 0
    return covers, (single, rows[at[:, None], c[:, None] + np.arange(LENGTH)])


def _windows(single: np.ndarray, rows: np.ndarray, buckets: int) -> list[tuple]:
    """Rows to send: single windows dealt by their own bytes, as transforms of ``LENGTH`` columns."""
    padded = np.zeros((len(rows), -(-LENGTH // 8) * 8), np.uint8)
    padded[:, :LENGTH] = rows
    key = np.zeros(len(rows), np.uint64)
    for word in padded.view("<u8").T:
        key = (key ^ word) * np.uint64(_ODD[1])
        key ^= key >> np.uint64(31)
    order, groups = _grouped((key % np.uint64(buckets)).astype(np.int64))
    group = np.zeros(len(rows), np.int64)
    for k, (_, own) in enumerate(groups):
        group[own] = k
    columns = transforms(rows[order], group)
    return [(g, -1, _zip(single[order[own]].tobytes()), _zip(np.ascontiguousarray(columns[:, own]).tobytes()), None, None) for g, own in groups]


def _removed(data: bytes, lengths: np.ndarray, covers) -> np.ndarray:
    """Mask of bytes to take out of a shard."""
    change = np.zeros(len(data) + 1, np.int32)
    begins = np.cumsum(lengths) - lengths
    for blob in covers or ():
        c = np.frombuffer(blob, COVER)
        np.add.at(change, begins[c["doc"]] + c["first"], 1)
        np.add.at(change, begins[c["doc"]] + c["last"] + LENGTH, -1)
    return np.cumsum(change[:-1]) > 0


def _with_covers(shards: DataFrame) -> DataFrame:
    covers = find_covers(shards).groupBy("shard").agg(F.collect_list("covers").alias("covers"))
    return shards.join(covers, "shard", "left")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per document.

    Null texts count as empty; rows that repeat a doc_id are ordered by their place in the input; null
    doc_ids come first; an empty table gives no rows; other columns are not read.
    """
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                data, lengths = _unzip(row["data"]), np.frombuffer(row["lengths"], "<i8")
                gone, raw = _removed(data, lengths, row["covers"]), np.frombuffer(data, np.uint8)
                out, at = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}, 0
                for i, none, n in zip(np.frombuffer(row["doc_ids"], "<i8").tolist(), row["nulls"], lengths.tolist()):
                    own = gone[at : at + n]
                    out["doc_id"].append(None if none else i)
                    out["n_bytes"].append(n)
                    out["n_removed"].append(int(own.sum()))
                    out["n_spans"].append(int(own[:1].sum()) + int((own[1:] & ~own[:-1]).sum()))
                    out["kept_sha256"].append(hashlib.sha256(raw[at : at + n][~own].tobytes()).hexdigest())
                    at += n
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))

    rows = _with_covers(make_shards(docs, False)).select("doc_ids", "nulls", "lengths", "data", "covers")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated bytes taken out of ``text``; same rows and columns, null texts stay null.

    A character of which only a part is covered loses its other bytes too.
    """
    import pyarrow as pa

    schema = docs.schema
    names = docs.columns

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for b in batches:
            for row in b.to_pylist():
                data, lengths = _unzip(row["data"]), np.frombuffer(row["lengths"], "<i8")
                gone, raw, at, texts = _removed(data, lengths, row["covers"]), np.frombuffer(data, np.uint8), 0, []
                for n in lengths.tolist():
                    texts.append(raw[at : at + n][~gone[at : at + n]].tobytes().decode("utf-8", "ignore"))
                    at += n
                rest = pa.ipc.open_stream(_unzip(row["rest"])).read_all().combine_chunks().to_batches()[0]
                null = rest.column(0).to_pylist()
                texts = [None if x else t for x, t in zip(null, texts)]
                others = iter(rest.columns[1:])
                columns = [pa.array(texts, pa.string()) if c == "text" else next(others) for c in names]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target)], schema=target)

    rows = _with_covers(make_shards(docs, True)).select("lengths", "data", "rest", "covers")
    return rows.mapInArrow(run, schema)
