"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are dealt by falling length into *runs* of about ``RUN`` rows, a run into buckets of
``BUCKET``.  Each query first meets the run of the longest vectors, which gives it a lower bound of its
k-th score.  A query goes on only to the runs whose longest vector can reach its bound, and rows only
to the queries that want them.  In a task, buckets follow by falling length and the bound rises with
them.  It becomes a local cosine threshold, bound / (|q| * longest in the bucket): above 1 the bucket is
skipped; from ``COORDINATE`` on the query's largest coordinates prune (partial product plus the rest's
Cauchy-Schwarz bound); below, only length prunes.  Survivors are verified by their integer products.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, ship, shuffle_partitions, written
from .vectors import dimensions, finite, pack, unpack

BUCKET, RUN, QUERIES = 4096, 32_768, 4096
#: Fewer queries make a block where there would be less blocks than partitions, but not fewer than this.
LEAST_QUERIES = 256
#: Runs at most; longer ones are cut into tiles of ``RUN`` rows that share a length range.
MAX_RUNS = 1024
#: Local cosine threshold from which coordinates prune, and the share of coordinates looked at first.
COORDINATE, FIRST = 0.25, 0.25
SCALE = 64
_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1


def tile_scores(query, bound, rows, ids, query_ids, k):
    """Best k rows of one bucket for each query at or above its bound: (query place, row place, score).

    query (m, d), rows (n, d) int64; rows sorted by falling length.
    """
    most = float(np.abs(query.astype(np.float64)).max(initial=0)) * float(np.abs(rows.astype(np.float64)).max(initial=0)) * rows.shape[1]
    small = most < 2**53
    q, p = (query.astype(np.float64), rows.astype(np.float64)) if small else (query, rows) if most < 2**62 else (query.astype(object), rows.astype(object))
    qn, pn = np.sqrt((query.astype(np.float64) ** 2).sum(1)), np.sqrt((rows.astype(np.float64) ** 2).sum(1))
    longest = pn.max(initial=0)
    local = np.where(np.isneginf(bound), -np.inf, bound / np.maximum(qn * longest, 1e-300))
    out = []
    plain = np.flatnonzero(local < COORDINATE)
    for at in np.array_split(plain, -(-len(plain) // 128)) if len(plain) else []:
        # length pruning: only rows long enough for the weakest bound of these queries
        need = np.min(np.where(bound[at] > 0, bound[at] / np.maximum(qn[at], 1e-300), 0))
        n = int(np.searchsorted(-pn, -(need * (1 - 1e-9) - 1e-6), side="right"))
        scores = _held(q[at] @ p[:n].T)
        for i, s in zip(at, scores):
            out.append(_best(i, np.arange(n), s, bound[i], ids, query_ids[i], k))
    first = max(1, int(rows.shape[1] * FIRST))
    for i in np.flatnonzero((local >= COORDINATE) & (local <= 1 + 1e-9)):
        n = int(np.searchsorted(-pn, -(bound[i] / qn[i] * (1 - 1e-9) - 1e-6), side="right"))
        focus = np.argpartition(-np.abs(q[i]), first - 1)[:first]
        own = p[:n, focus].astype(np.float64)
        part = own @ q[i, focus].astype(np.float64)
        rest = np.sqrt(np.maximum(0, qn[i] ** 2 - (q[i, focus].astype(np.float64) ** 2).sum())) * np.sqrt(np.maximum(0, pn[:n] ** 2 - (own**2).sum(1)))
        alive = np.flatnonzero(part + rest * (1 + 1e-9) + 1e-6 >= bound[i])
        out.append(_best(i, alive, _held(p[alive] @ q[i]), bound[i], ids, query_ids[i], k))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _held(scores: np.ndarray) -> np.ndarray:
    """Products of whole numbers of any size, as the nearest of 64 bits."""
    return np.clip(scores, _LOWEST, _HIGHEST).astype(np.int64) if scores.dtype == object else scores


def _best(i, places, scores, bound, ids, own, k):
    keep = (scores >= bound) & (ids[places] != own)
    places, scores = places[keep], scores[keep]
    if len(places) > k:
        kth = -np.partition(-scores, k - 1)[k - 1]
        keep = scores >= kth
        places, scores = places[keep], scores[keep]
        order = np.lexsort((ids[places], -scores))[:k]
        places, scores = places[order], scores[order]
    return np.full(len(places), i), places, scores.astype(np.int64)


def run_scores(query, bound, rows, ids, query_ids, k):
    """Best k rows of a run for each query, bucket after bucket by falling length: (query place, vec_id, score)."""
    bound = bound.astype(np.float64).copy()
    place, found, score = (np.zeros(0, np.int64) for _ in range(3))
    for at in range(0, len(rows), BUCKET):
        i, j, s = tile_scores(query, bound, rows[at : at + BUCKET], ids[at : at + BUCKET], query_ids, k)
        place, found, score = np.concatenate((place, i)), np.concatenate((found, ids[at : at + BUCKET][j])), np.concatenate((score, s))
        order = np.lexsort((found, -score, place))
        place, found, score = place[order], found[order], score[order]
        first = np.searchsorted(place, place)
        rank = np.arange(len(place)) - first
        full = rank == k - 1
        bound[place[full]] = np.maximum(bound[place[full]], score[full])
        place, found, score = place[rank < k], found[rank < k], score[rank < k]
    return place, found, score


def top_products(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every query row with all rows of other vec_ids.

    ``vectors``: vec_id, embedding; components become floor(SCALE * x).  Components and scores beyond
    64 bits become the largest or smallest number of 64 bits, and rank as such.  Null vectors, vectors with null or
    non-finite components and null vec_ids take no part; vectors of different dimensions are not
    compared; ties go to the smaller vec_id; rows that repeat a vec_id are candidates each, and queries
    each, with ranks of their own, but never candidates of one another; an empty table gives no rows;
    other columns are not read, whatever their names.
    """
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & finite())
    out = [_one_dimension(valid.where(F.size("embedding") == d), d, is_query, k) for d in dimensions(valid) if d > 0]
    if not out:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return functools.reduce(DataFrame.unionByName, out)


def _one_dimension(valid: DataFrame, dim: int, is_query, k: int) -> DataFrame:
    spark = valid.sparkSession
    ship(spark)
    whole = valid.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("v")).withColumn("length", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    runs = max(1, min(MAX_RUNS, -(-whole.count() // RUN)))
    cuts = np.zeros(0)
    if runs > 1:  # at most MAX_RUNS numbers
        cuts = np.unique(whole.select(F.percentile_approx("length", [i / runs for i in range(1, runs)], 20 * runs)).first()[0])

    def dealt(b):
        length = b.column(2).to_numpy()
        return {"row": b.column(3), "vec_id": b.column(0), "length": length, "run": (len(cuts) - np.searchsorted(cuts, length, side="right")).astype(np.int32), "v": pack(b.column(1), "<i8")}

    numbered = whole.select("vec_id", "v", "length", F.monotonically_increasing_id())
    rows = written(map_batches(numbered, dealt, "row long, vec_id long, length double, run int, v binary"), "runs")
    # a line per run: how many tiles it is cut into and its longest vector
    lines = sorted(rows.groupBy("run").agg(F.count("*").alias("n"), F.max("length").alias("longest")).collect(), key=lambda r: r["run"])
    tiles = np.array([-(-r["n"] // RUN) for r in lines])
    begin, longest = np.concatenate(([0], np.cumsum(tiles))), np.sqrt([r["longest"] for r in lines])
    of_run = spark.createDataFrame([(r["run"], place, int(tiles[place]), int(begin[place])) for place, r in enumerate(lines)], "run int, place int, tiles int, begin int")
    rows = rows.join(F.broadcast(of_run), "run").select("row", "vec_id", "length", "v", "place", (F.col("begin") + F.pmod(F.xxhash64("row"), F.col("tiles"))).cast("int").alias("tile"))
    queries = rows.where(is_query(F.col("vec_id"))).select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.sqrt("length").alias("norm"), F.col("v").alias("q"))
    # the tile of the longest vectors gives each query a bound
    asking = queries.count()
    size = min(QUERIES, max(LEAST_QUERIES, -(-asking // shuffle_partitions(spark))))
    blocks = max(1, -(-asking // size))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).withColumn("tile", F.lit(0)).withColumn("bound", F.lit(float("-inf")))
    offered = rows.where("tile = 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    seed = written(_tiles(offered, asked, dim, k), "seed")
    if len(begin) == 2 and begin[1] == 1:
        return _ranked(seed, k)
    bound = seed.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("low")).where(F.col("n") >= k).select("query", F.col("low").cast("double").alias("bound"))
    asked = queries.join(bound, "query", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))

    def reach(b):
        """In how many runs, from the longest vectors on, a query may still find something."""
        norm, low = b.column(2).to_numpy(), b.column(4).to_numpy()
        need = np.where(low > 0, low / np.maximum(norm, 1e-300), 0) * (1 - 1e-9) - 1e-6
        far = np.searchsorted(-longest, -need, side="right").astype(np.int32)
        return {**{c: b.column(n) for n, c in enumerate(("query", "query_id", "norm", "q", "bound"))}, "reach": far, "last": begin[far].astype(np.int32)}

    asked = written(map_batches(asked.select("query", "query_id", "norm", "q", "bound"), reach, "query long, query_id long, norm double, q binary, bound double, reach int, last int"), "bounds")
    # queries of one reach form blocks; blocks are numbered by rising reach
    counts = sorted((r["reach"], -(-r["count"] // size)) for r in asked.groupBy("reach").count().collect())
    if not counts:
        return _ranked(seed, k)
    starts = np.concatenate(([0], np.cumsum([n for _, n in counts]))).astype(int)
    of_reach = spark.createDataFrame([(r, n, int(s)) for (r, n), s in zip(counts, starts)], "reach int, blocks int, first int")
    asked = asked.join(F.broadcast(of_reach), "reach").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("query"), F.col("blocks"))).cast("int"))
    asked = asked.where("last > 1").withColumn("tile", F.explode(F.sequence(F.lit(1), F.col("last") - 1)))
    first = [int(starts[sum(r <= place for r, _ in counts)]) for place in range(len(lines))]
    wanted = spark.createDataFrame([(p, f) for p, f in enumerate(first) if f < starts[-1]], "place int, wanted int")
    offered = rows.where("tile > 0").join(F.broadcast(wanted), "place").withColumn("block", F.explode(F.sequence(F.col("wanted"), F.lit(int(starts[-1]) - 1))))
    return _ranked(seed.unionByName(_tiles(offered, asked, dim, k)), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _tiles(rows: DataFrame, queries: DataFrame, dim: int, k: int) -> DataFrame:
    """The tiles (tile of rows, block of queries): query, query_id, vec_id, score, at most k a query."""
    import pyarrow as pa

    kinds = {c: pa.int64() for c in ("query", "query_id", "vec_id", "score")}

    def run(a, b):
        if not a.num_rows or not b.num_rows:
            return pa.table({c: pa.array([], t) for c, t in kinds.items()})
        ids = a.column("vec_id").to_numpy()
        order = np.lexsort((ids, -a.column("length").to_numpy()))
        ids, p = ids[order], unpack(a.column("v"), "<i8", dim)[order]
        own = b.column("query_id").to_numpy()
        i, j, s = run_scores(unpack(b.column("q"), "<i8", dim), b.column("bound").to_numpy(), p, ids, own, k)
        return pa.table({"query": b.column("query").to_numpy()[i], "query_id": own[i], "vec_id": j, "score": s})

    left = rows.select("tile", "block", "vec_id", "length", "v")
    right = queries.select("tile", "block", "query", "query_id", "q", "bound")
    return left.groupBy("tile", "block").cogroup(right.groupBy("tile", "block")).applyInArrow(run, "query long, query_id long, vec_id long, score long")
