"""SimHash near-duplicates with pivot distance tables.

Copies of one fingerprint collapse first.  For distinct fingerprints the Hamming distances to
``PIVOTS`` reference fingerprints are precomputed; by the triangle inequality a pair whose distances
to any one pivot differ by more than the radius is no link, so pairs are discarded by the largest
coordinate difference and only survivors are verified by XOR and bit count.

Distances to pivots concentrate, so pivots alone cannot deal pairs out to tasks.  That is done by
equal bit blocks: within radius r two fingerprints agree on b - r of b blocks, whatever b is, so
every pair meets in a bucket keyed by some b - r blocks.  b grows with the number of fingerprints
(bucket sizes stay level), and buckets beyond ``TILE`` rows are split into tiles.

``similar_documents`` takes the links of these fingerprints and verifies them by the Jaccard similarity
of word shingles.  Documents of 0.8 differ in some ten of 64 bits, a radius at which blocks no longer
deal out pairs; pairs beyond ``RADIUS`` meet by bands of minimal hashes as well.  Pivot distances, then
fingerprints discard, and what is left is verified on the shingles themselves.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_batches, quoted, row_key, ship, text_or_empty, written
from .components import components, unite

RADIUS = 4
PIVOTS = 16
SEED = 42
SHINGLE = 4
#: Rows of a bucket that one tile takes.
TILE = 8192

#: The corpus stage: shingles of so many words, linked at this Jaccard similarity.
WORDS, SIMILAR = 5, 0.8
#: Two documents of Jaccard similarity s share a band with probability 1 - (1 - s**ROWS)**BANDS: 0.9996 at 0.8.
BANDS, ROWS = 20, 5
#: Differing bits beyond which a pair is not verified: at 0.8 the mean is 9.7, the deviation 2.9.
WIDE_RADIUS = 22
#: Documents of a cluster that one tile takes.
TILE_DOCUMENTS = 512

#: ASCII capitals to small letters, byte by byte.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def pivot_table(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed, spread out, made by a multiplicative rule."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """64-bit SimHash of the XXH64 (seed 42) of word shingles, repeats included; no words: 0."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()
    n = len(words) - width + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n <= 1:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begin = np.concatenate(([0], ends[: n - 1])).tolist()
    hashes = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(begin, (ends[width - 1 :] - 1).tolist())], np.uint64)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8)[:, ::-1], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), key (tells rows apart by doc_id and text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(), row_key(docs).alias("key"))

    def run(b):
        got = [fingerprint(t.encode()) for t in b.column(1).to_pylist()]
        return {"doc_id": b.column(0), "fp": np.array(got, np.uint64).view(np.int64), "key": b.column(2)}

    return map_batches(rows, run, "doc_id long, fp long, key binary")


def block_plan(n: int, radius: int = RADIUS) -> list[int]:
    """Masks whose equality deals out pairs: unions of blocks - radius of the blocks, for the fewest blocks that keep random buckets small."""
    blocks = radius + 1
    while blocks < 2 * radius + 2 and n >> (64 * (blocks - radius) // blocks) > 256:
        blocks += 1
    edge = [64 * k // blocks for k in range(blocks + 1)]
    block = [(1 << edge[k + 1]) - (1 << edge[k]) for k in range(blocks)]
    return [sum(c) for c in itertools.combinations(block, blocks - radius)]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Spanning links (a, b) of all pairs of distinct fingerprints ``fp`` at ``radius`` or fewer differing bits."""
    spark = distinct.sparkSession
    ship(spark)
    pivots = pivot_table()
    masks = [m - (1 << 64) if m >> 63 else m for m in block_plan(distinct.count(), radius)]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("mask", "key"))
    keyed = written(keyed, "blocks")
    large = keyed.groupBy("mask", "key").agg(F.count("*").alias("rows")).where(F.col("rows") > TILE).select("mask", "key", F.ceil(F.col("rows") / TILE).cast("int").alias("tiles"))
    parts = keyed.join(large, ["mask", "key"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    parts = parts.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    parts = parts.select("mask", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(pivots[:1].view(np.int64)[0])))).cast("int").alias("d0"))
    parts = parts.repartition("mask", "key", "i", "j").sortWithinPartitions("mask", "key", "i", "j", "d0")

    def run(batches):
        import pyarrow as pa

        for fp, group, d0 in _whole_groups(batches):
            a, b = _group_links(fp, group, d0, pivots, radius)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return parts.mapInArrow(run, "a long, b long")


def _whole_groups(batches):
    """Sorted rows in runs that hold whole buckets: fingerprints, bucket number, distance to the first pivot."""
    held = None
    for b in itertools.chain(batches, [None]):
        if b is not None:
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 3, 4, 5)]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            if not len(held[0]):
                continue
        if held is None or not len(held[0]):
            continue
        new = np.zeros(len(held[0]), bool)
        for c in held[:4]:
            new[1:] |= c[1:] != c[:-1]
        cut = len(new) if b is None else int(np.flatnonzero(new)[-1]) if new.any() else 0
        if cut:
            yield held[4][:cut], np.cumsum(new[:cut]), held[5][:cut]
            held = [c[cut:] for c in held]


def _group_links(fp, group, d0, pivots, radius):
    """Links within buckets: rows are sorted by bucket and distance to the first pivot."""
    own = fp.view(np.uint64) if fp.dtype == np.int64 else fp.astype(np.int64).view(np.uint64)
    table = np.bitwise_count(own[:, None] ^ pivots[None, 1:]).astype(np.int8)
    label = np.arange(len(own))
    near, step = np.arange(len(own) - 1), 1
    while len(near):
        near = near[near + step < len(own)]
        far = near + step
        within = (group[near] == group[far]) & (d0[far] - d0[near] <= radius)
        near, far = near[within], far[within]  # sorted: what fails here fails at every larger step
        a, b = near, far
        for k in range(table.shape[1]):
            keep = np.abs(table[a, k] - table[b, k]) <= radius
            a, b = a[keep], b[keep]
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
        keep = np.bitwise_count(own[a] ^ own[b]) <= radius
        unite(label, a[keep], b[keep])
        step += 1
    linked = np.flatnonzero(label != np.arange(len(own)))
    return own[linked].view(np.int64), own[label[linked]].view(np.int64)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, key, component_id (smallest doc_id reachable over links, itself included).

    Null and empty texts have fingerprint zero and link like any other; repeated rows share a
    component; null doc_ids get the component of their fingerprint; an empty table gives no rows;
    other columns are not read.
    """
    prints = written(fingerprints(docs), "prints")
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = components(links(first.select("fp"))).withColumnRenamed("node", "fp")
    grouped = named.join(first, "fp")
    smallest = grouped.groupBy("component").agg(F.min("first").alias("smallest"))
    better = grouped.join(smallest, "component").select("fp", "smallest")
    of_print = first.join(better, "fp", "left").select("fp", F.coalesce("smallest", "first").alias("component_id"))
    # a table of its own, so that adaptive execution can split a common fingerprint's rows in the join
    return prints.join(written(of_print, "of_print"), "fp").select("doc_id", "fp", "key", "component_id")


def shingle_set(text: bytes, width: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles; fewer words make one shingle, no words none."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    n, joined = max(1, len(words) - width + 1), b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begin = np.concatenate(([0], ends[: n - 1])).tolist()
    return np.unique(np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(begin, (ends[-n:] - 1).tolist())], np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of ``ROWS`` minimal hashes, as signed longs."""
    flip, odd = pivot_table(2 * BANDS * ROWS).reshape(2, -1)
    odd = odd | np.uint64(1)
    least = np.min([((hashes[k : k + 4096, None] ^ flip) * odd).min(axis=0) for k in range(0, len(hashes), 4096)], axis=0)
    x = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        x = (x ^ row) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return x.view(np.int64)


def _set_prints(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash of each set."""
    out = np.empty(len(sets), np.uint64)
    for k, h in enumerate(sets):
        ones = np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1).sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(h)).view(np.uint64)[0]
    return out


def _similar_links(group: np.ndarray, sets: list[np.ndarray], similarity: float, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (places) of all pairs of one group whose sets have this Jaccard similarity."""
    prints, size, label = _set_prints(sets), np.array([len(h) for h in sets]), np.arange(len(sets))
    table = np.bitwise_count(prints[:, None] ^ pivot_table()[None, :]).astype(np.int8)
    near, step = np.arange(len(sets) - 1), 1
    while len(near):
        near = near[near + step < len(sets)]
        near = near[group[near] == group[near + step]]
        a, b = near, near + step
        keep = (label[a] != label[b]) & (np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]))
        a, b = a[keep], b[keep]
        for k in range(table.shape[1]):
            keep = np.abs(table[a, k] - table[b, k]) <= radius
            a, b = a[keep], b[keep]
        keep = np.bitwise_count(prints[a] ^ prints[b]) <= radius
        a, b = a[keep], b[keep]
        both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist())], np.int64)
        keep = both >= similarity * (size[a] + size[b] - both)
        unite(label, a[keep], b[keep])
        step += 1
    linked = np.flatnonzero(label != np.arange(len(sets)))
    return linked, label[linked]


def similar_documents(docs: DataFrame, width: int = WORDS, similarity: float = SIMILAR, radius: int = WIDE_RADIUS) -> DataFrame:
    """doc_id, key, component_id: smallest doc_id over links of Jaccard ``similarity`` or more between sets of ``width``-word shingles.

    Documents of one set (of no words: the empty set) share a component; null doc_ids and repeated rows as in ``near_duplicates``.
    """
    spark = docs.sparkSession

    def sketch(b):
        node, fp, keys = [], [], []
        for t in b.column(1).to_pylist():
            h = shingle_set(t.encode(), width)
            node.append(_set_name(h))
            fp.append(int(_set_prints([h]).view(np.int64)[0]) if len(h) else None)
            keys.append(bands(h) if len(h) else None)
        return {"doc_id": b.column(0), "key": b.column(2), "node": node, "fp": fp, "bands": keys}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(), row_key(docs).alias("key"))
    prints = written(map_batches(rows, sketch, "doc_id long, key binary, node long, fp long, bands array<long>"), "sketches")
    # candidates: links of fingerprints, and whoever shares a fingerprint or a band, as stars; their components are the clusters to verify
    same = written(prints.where("fp is not null").groupBy("fp").agg(F.min("node").alias("hub"), F.max("node").alias("last")), "same_print")
    hub = lambda side: same.select(F.col("fp").alias(side), F.col("hub").alias(side + "_hub"))
    near = links(same.select("fp")).join(hub("a"), "a").join(hub("b"), "b").select(F.col("a_hub").alias("a"), F.col("b_hub").alias("b"))
    near = near.unionByName(prints.join(same.where("hub <> last"), "fp").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    banded = prints.select("node", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").select("band", "hub")
    banded = banded.join(hubs, "band").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    clusters = components(near.unionByName(banded))
    clusters = written(clusters, "clusters")
    large = clusters.groupBy("component").agg(F.count("*").alias("rows")).select("component", F.ceil(F.col("rows") / TILE_DOCUMENTS).cast("int").alias("tiles"))
    one = prints.join(clusters, "node").groupBy("node", "component").agg(F.min("key").alias("key")).join(large, "component")
    members = rows.select("key", "text").join(one, "key").dropDuplicates(["node"])
    parts = members.withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    parts = parts.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "text")
    parts = parts.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")

    def verify(batches):
        import pyarrow as pa

        for names, group, texts in _whole_clusters(batches):
            a, b = _similar_links(group, [shingle_set(t.encode(), width) for t in texts], similarity, radius)
            yield pa.RecordBatch.from_pydict({"a": pa.array(names[a], pa.int64()), "b": pa.array(names[b], pa.int64())})

    ship(spark)
    named = components(parts.mapInArrow(verify, "a long, b long"))
    first = prints.groupBy(F.col("node")).agg(F.min("doc_id").alias("first"))
    grouped = named.join(first, "node")
    smallest = grouped.groupBy("component").agg(F.min("first").alias("smallest"))
    better = grouped.join(smallest, "component").select("node", "smallest")
    of_node = first.join(better, "node", "left").select("node", F.coalesce("smallest", "first").alias("component_id"))
    return prints.select("doc_id", "key", "node").join(written(of_node, "of_node"), "node").select("doc_id", "key", "component_id")


def _set_name(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(hashes.tobytes(), SEED)
    return x - (1 << 64) if x >> 63 else x


def _whole_clusters(batches, rows: int = 2048):
    """Sorted rows (component, i, j, node, text) in runs of whole tiles: nodes, tile number, texts."""
    held, texts = [np.zeros(0, np.int64)] * 4, []
    for b in itertools.chain(batches, [None]):
        if b is not None:
            held = [np.concatenate((h, b.column(k).to_numpy(zero_copy_only=False))) for k, h in enumerate(held)]
            texts += b.column(4).to_pylist()
        new = np.zeros(len(texts), bool)
        for c in held[:3]:
            new[1:] |= c[1:] != c[:-1]
        ends = np.flatnonzero(new).tolist() + ([len(texts)] if b is None else [])
        begin = 0
        for k, end in enumerate(ends):
            if end > begin and (end - begin >= rows or k + 1 == len(ends)):
                yield held[3][begin:end], np.cumsum(new[begin:end]), texts[begin:end]
                begin = end
        held, texts = [h[begin:] for h in held], texts[begin:]


def representatives(docs: DataFrame, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does (its smallest doc_id; of repeated rows, one).

    Components are those of ``near_duplicates``, or with ``similarity`` those of ``similar_documents``.
    Null and empty texts are documents like any other; rows without a doc_id stay where no document
    with one is in their component; an empty table gives no rows; other columns pass as they are,
    whatever their names.
    """
    grouped = near_duplicates(docs) if similarity is None else similar_documents(docs, similarity=similarity)
    kept = written(grouped.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("key").agg(F.count("*").alias("rows")), "kept")
    key, own = fresh(docs, "key", "own_key")
    out = docs.withColumn(key, row_key(docs)).join(kept.select(F.col("key").alias(own)), F.col(key) == F.col(own), "left_semi")
    if not kept.where("rows > 1").isEmpty():
        out = out.dropDuplicates([key])
    return out.select(*map(quoted, docs.columns))
