"""Near-duplicate vectors by product quantisation.

A coarse quantiser (k-means) has one inverted list per centroid; a member's residual is coded by
``SUBSPACES`` small codebooks, and the length of what the code misses is kept beside it.  In a list,
distances come from a table of query-to-codeword distances; by the triangle inequality a member is
dropped only if table distance minus its coding error exceeds the radius.  Survivors are reranked by
the exact cosine, so what can be lost is only a link whose list neither end probes.

Sufficient probes: let x have home c and y, within the radius r of x, have home c'.  As y is no farther
from c' than from c, |x - c'|^2 - |x - c|^2 is at most 2 (x - y).(c' - c), hence at most 2 r |c' - c|.
In d dimensions an offset of length r in no particular direction has a share of that product with
standard deviation r |c' - c| / sqrt(d), so ``DEVIATIONS`` of them bound it; where that is no less than the
geometric bound (d up to ``DEVIATIONS`` squared), no link at all is lost.

A pair is compared where either end probes the other's list, and counts for both ends once: the end
that probes is credited by the tile, and so is the other one if it does not probe back.

Copies of a vector collapse first.  Lists are cut into blocks and their queries into chunks; a task
takes one tile and returns counts and a spanning forest, never all pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, ship, written
from .components import components, unite
from .vectors import dimensions, finite, pack, scaled, unit, unpack

COSINE = 0.95
SUBSPACES, CODES = 8, 64
#: Vectors a list on average, lists at most, and vectors a list that the quantisers are fitted on (smallest hashes).
LIST_ROWS, MAX_LISTS, FIT_ROWS = 256, 8192, 16
#: Standard deviations of an offset's direction that probes allow for.
DEVIATIONS = 4.0
MEMBERS, QUERIES = 2048, 4096


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))[:, None]
        c = np.where(n > 0, total / np.maximum(n, 1), c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmax(x[k : k + 4096] @ c.T - half, axis=1) for k in range(0, max(1, len(x)), 4096)])


class Quantiser:
    def __init__(self, sample: np.ndarray, total: int):
        """sample: unit vectors (n, dim); total: how many there are in all."""
        self.dim = sample.shape[1]
        lists = max(1, min(MAX_LISTS, total // LIST_ROWS, len(sample) // FIT_ROWS))
        self.coarse = kmeans(sample, lists)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        self.cuts = np.linspace(0, self.dim, min(SUBSPACES, self.dim) + 1).astype(int)
        self.books = [kmeans(rest[:, a:b], min(CODES, len(sample)), 6) for a, b in zip(self.cuts, self.cuts[1:])]

    def encode(self, unit: np.ndarray):
        """Home list, codes (n, subspaces) and coding error of each vector."""
        home = nearest(unit, self.coarse)
        rest = unit - self.coarse[home]
        codes = np.stack([nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], axis=1).astype(np.uint8)
        missed = rest - np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], axis=1)
        return home, codes, np.sqrt((missed**2).sum(1))

    def probes(self, unit: np.ndarray, home: np.ndarray, radius: float) -> list[np.ndarray]:
        """The lists that each vector is compared with, in rising order, its own among them."""
        share, out = min(1.0, DEVIATIONS / np.sqrt(self.dim)), []
        length = (self.coarse**2).sum(1)
        for k in range(0, len(unit), 512):
            x, own = unit[k : k + 512], home[k : k + 512]
            square = length - 2 * x @ self.coarse.T  # less the own length
            between = np.sqrt(np.maximum(0, length[own][:, None] + length - 2 * self.coarse[own] @ self.coarse.T))
            rows = np.arange(len(x))
            near = square - square[rows, own][:, None] <= 2 * radius * share * between + 1e-6
            near[rows, own] = True
            out += [np.flatnonzero(r).astype(np.int32) for r in near]
        return out

    def tables(self, unit: np.ndarray, which: int) -> np.ndarray:
        """(n, subspaces, codes) squared distances of residuals to codewords in list ``which``."""
        rest = unit - self.coarse[which]
        return np.stack([((rest[:, None, a:b] - book[None]) ** 2).sum(2) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], axis=1).astype(np.float32)


def radius_of(cosine: float) -> float:
    return float(np.sqrt(max(0.0, 2 - 2 * cosine)))


def tile_links(model: Quantiser, which: int, query, members, codes, error, same, home, back, query_weight, weight, cosine: float = COSINE):
    """Linked weight of queries and of members, and the forest label of both (places, queries first).

    ``same``: place of each query among the members, or -1; ``home``: list of each query; ``back``:
    (members, lists), whether a member probes a list, so that links of its own are counted there.
    """
    n, m, radius = len(query), len(members), radius_of(cosine)
    label, links, returned = np.arange(n + m), np.zeros(n, np.int64), np.zeros(m, np.int64)
    both = np.flatnonzero(same >= 0)
    unite(label, both, n + same[both])
    qn, mn = np.sqrt((query**2).sum(1)), np.sqrt((members**2).sum(1))
    for k in range(0, n, 128):
        table = model.tables(query[k : k + 128] / qn[k : k + 128, None], which)
        square = np.zeros((len(table), m), np.float32)
        for j in range(table.shape[1]):
            square += table[:, j, codes[:, j]]
        i, j = np.nonzero(np.sqrt(square) - error <= radius + 1e-4)
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)] + k, j[at : at + (1 << 16)]
            cos = np.einsum("ij,ij->i", query[a], members[b]) / (qn[a] * mn[b])
            keep = (cos >= cosine) & (same[a] != b)
            a, b = a[keep], b[keep]
            np.add.at(links, a, weight[b])
            alone = ~back[b, home[a]]
            np.add.at(returned, b[alone], query_weight[a[alone]])
            unite(label, a, n + b)
    return links, returned, label


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Null and zero vectors, and vectors with null or non-finite components, link with nothing and are
    kept; finite vectors of any length link by their direction alone, the smallest and largest numbers
    included; vectors of different dimensions never link; repeated rows and rows that share a vec_id count
    as vectors each and link like any others; a null vec_id takes part, its row is kept only if no
    vector linked with it has a vec_id (component_id null then); an empty table gives no rows; other
    columns are not read, whatever their names.
    """
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    usable = base.where(finite() & F.exists("embedding", lambda x: x != 0))
    dims = [d for d in dimensions(usable) if d > 0]
    keyed = base.withColumn("ok", F.coalesce(finite() & F.exists("embedding", lambda x: x != 0), F.lit(False)))
    out = keyed.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    for d in dims:
        out = out.unionByName(_one_dimension(usable.where(F.size("embedding") == d), d, cosine))
    return out


def _one_dimension(usable: DataFrame, dim: int, cosine: float) -> DataFrame:
    import pickle

    spark = usable.sparkSession
    ship(spark)
    # single-precision input travels as it is; all arithmetic is in double precision
    kind = "<f4" if usable.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    plain = F.transform("embedding", lambda x: x + F.lit(0).cast("float" if kind == "<f4" else "double")).alias("v")

    def bytes_of(b):
        return {"vec_id": b.column(0), "v": pack(b.column(1), kind)}

    rows = written(map_batches(usable.select("vec_id", plain), bytes_of, "vec_id long, v binary"), "vectors")
    groups = rows.groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    groups = written(groups.select("v", "first", "n", F.monotonically_increasing_id().alias("own")), "groups")  # own: number of a distinct vector
    total = groups.count()
    fit = FIT_ROWS * max(1, min(MAX_LISTS, total // LIST_ROWS)) + 4096
    taken = groups.select("v").orderBy(F.xxhash64("v"), "v").limit(fit).collect()
    sample = np.frombuffer(b"".join(bytes(r["v"]) for r in taken), kind).reshape(-1, dim).astype(float)
    model = Quantiser(unit(sample), total)
    blob, radius, lists = pickle.dumps(model, protocol=5), radius_of(cosine), len(model.coarse)

    def code(b):
        own = pickle.loads(blob)
        x = unpack(b.column(1), kind, dim).astype(float)
        x = unit(x)
        home, codes, error = own.encode(x)
        return {"own": b.column(0), "v": b.column(1), "n": b.column(2), "home": home.astype(np.int32), "codes": [c.tobytes() for c in codes], "error": error.astype(np.float32) * np.float32(1 + 1e-6), "probes": [p.tolist() for p in own.probes(x, home, radius)]}

    coded = written(map_batches(groups.select("own", "v", "n"), code, "own long, v binary, n long, home int, codes binary, error float, probes array<int>"), "coded")
    asks = coded.select(F.col("own").alias("asking"), F.col("n").alias("asking_n"), F.col("home").alias("asking_home"), F.col("v").alias("query"), F.explode("probes").alias("list"))
    size = coded.groupBy(F.col("home").alias("list")).agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks"))
    asked = coded.select(F.explode("probes").alias("list")).groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("chunks"))
    shape = size.join(asked, "list")  # a row per list, at most MAX_LISTS
    left = coded.withColumnRenamed("home", "list").join(shape, "list").withColumn("block", F.pmod(F.xxhash64("own"), F.col("blocks")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("list", "block", "chunk", "own", "v", "n", "codes", "error", "probes")
    right = asks.join(shape, "list").withColumn("chunk", F.pmod(F.xxhash64("asking"), F.col("chunks")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("list", "block", "chunk", "asking", "asking_n", "asking_home", "query")

    def tile(a, b):
        import pyarrow as pa

        if not a.num_rows or not b.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("own", "links", "root")})
        model = pickle.loads(blob)
        mid, qid = a.column("own").to_numpy(), b.column("asking").to_numpy()
        codes = np.frombuffer(b"".join(a.column("codes").to_pylist()), np.uint8).reshape(len(mid), -1)
        back = np.zeros((len(mid), lists), bool)
        probes = a.column("probes").combine_chunks()
        back[np.repeat(np.arange(len(mid)), probes.value_lengths().to_numpy()), probes.flatten().to_numpy()] = True
        order = np.argsort(mid)
        place = order[np.minimum(np.searchsorted(mid[order], qid), len(mid) - 1)]
        same = np.where(mid[place] == qid, place, -1)
        links, returned, label = tile_links(model, a.column("list")[0].as_py(), scaled(unpack(b.column("query"), kind, dim).astype(float)), scaled(unpack(a.column("v"), kind, dim).astype(float)), codes, a.column("error").to_numpy(), same, b.column("asking_home").to_numpy(), back, b.column("asking_n").to_numpy(), a.column("n").to_numpy(), cosine)
        ids, links = np.concatenate((qid, mid)), np.concatenate((links, returned))
        root = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(root, label, ids)
        keep = (links > 0) | (root[label] != ids)
        return pa.table({"own": ids[keep], "links": links[keep], "root": root[label][keep]})

    key = ("list", "block", "chunk")
    got = written(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(tile, "own long, links long, root long"), "tiles")
    count = got.groupBy("own").agg(F.sum("links").alias("links"))
    named = components(got.select(F.col("own").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "own")
    linked = groups.select("own", "first").join(named, "own")
    smallest = linked.groupBy("component").agg(F.min("first").alias("smallest"))
    better = linked.join(smallest, "component").select("own", "smallest", F.lit(True).alias("linked"))
    whole = groups.join(count, "own", "left").join(better, "own", "left").select("v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.when(F.col("linked"), F.col("smallest")).otherwise(F.col("first")).alias("component_id"))
    return rows.join(whole, "v").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
