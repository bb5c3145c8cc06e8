import numpy as np
import pytest

from deploom.llm import pq, topk


def table(spark, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(150, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(base)]
    rows += [(200 + i, (base[i % 20] + rng.normal(scale=0.05, size=16)).tolist()) for i in range(120)]
    rows += [(400 + i, base[0].tolist()) for i in range(20)]
    rows += [(500, None), (520, [0.0] * 16), (540, [float("nan")] * 16), (560, [None] * 16), (580, [float("inf")] + [1.0] * 15), (600, [1.0, 2.0]), (601, [1.0, 2.0]), (620, []), (None, base[3].tolist())]
    rows += [(400, base[0].tolist()), (5, base[7].tolist()), (5, base[7].tolist()), (60, (base[8] + 0.01).tolist()), (60, (base[8] + 0.02).tolist()), (40, base[2].tolist()), (None, base[90].tolist()), (None, (-base[90]).tolist())]
    return spark.createDataFrame([(i, v, 0, "r", 1) for i, v in rows], "vec_id long, embedding array<double>, label int, rep string, n int"), rows


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def brute_links(rows, cosine=0.95):
    """Sorted (vec_id, n_links, component_id, kept) by definition, row by row."""
    n, size = len(rows), np.array([len(v) if usable(v) and any(v) else 0 for _, v in rows])
    up, count = list(range(n)), [0] * n

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for d in set(size.tolist()) - {0}:
        at = np.flatnonzero(size == d)
        x = np.array([rows[i][1] for i in at], float)
        norm = np.sqrt((x**2).sum(1))
        for a, b in zip(*np.nonzero(x @ x.T / np.outer(norm, norm) >= cosine)):
            if a != b:
                count[at[a]] += 1
                up[find(int(at[a]))] = find(int(at[b]))
    low = {}
    for i, (vec_id, _) in enumerate(rows):
        if vec_id is not None:
            low[find(i)] = min(vec_id, low.get(find(i), vec_id))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted(((v, count[i], low.get(find(i)), v == low.get(find(i))) for i, (v, _) in enumerate(rows)), key=key), key


def test_near_vectors(spark):
    df, rows = table(spark)
    want, key = brute_links(rows)
    assert sorted(map(tuple, pq.near_vectors(df).collect()), key=key) == want
    assert pq.near_vectors(df.limit(0)).count() == 0


def planted(dim, n=1500, seed=2):
    """Vectors and for each one a neighbour at cosine 0.95 to 0.97."""
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(2, n, dim))
    x /= np.sqrt((x**2).sum(1))[:, None]
    y -= (x * y).sum(1)[:, None] * x
    y /= np.sqrt((y**2).sum(1))[:, None]
    cos = rng.uniform(0.9501, 0.97, n)[:, None]
    return np.concatenate((x, cos * x + np.sqrt(1 - cos**2) * y))


@pytest.mark.parametrize("dim", [8, 16, 64])
def test_planted_neighbours_over_many_lists(spark, monkeypatch, dim):
    """Up to 16 dimensions the probes lose nothing; beyond, hardly anything.  Small tiles, so that lists are cut."""
    monkeypatch.setattr(pq, "LIST_ROWS", 40)
    monkeypatch.setattr(pq, "MEMBERS", 30)
    monkeypatch.setattr(pq, "QUERIES", 200)
    rows = [(i, v.tolist()) for i, v in enumerate(planted(dim))]
    got = sorted(map(tuple, pq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    want, _ = brute_links(rows)
    if dim <= pq.DEVIATIONS**2:
        assert got == want
    found, every = sum(r[1] for r in got), sum(r[1] for r in want)
    assert found % 2 == 0 and 0.99 * every <= found <= every  # both ends of a link count it
    linked = {r[0] for r in got if r[1]}
    assert len(linked) >= 0.99 * len(rows)


def brute_products(rows, k):
    whole = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in rows if i is not None and usable(v)]
    out = []
    for i, v in whole:
        if i % 20 == 0:
            best = sorted((-int(v @ w), j) for j, w in whole if j != i and len(w) == len(v))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_products(spark, monkeypatch):
    df, rows = table(spark, 3)
    want = brute_products(rows, 7)
    assert any(want[i] == want[i + 1] for i in range(len(want) - 1))  # a query row that occurs twice is ranked twice
    for run, bucket, queries in ((32_768, 4096, 4096), (40, 12, 3), (64, 64, 5)):
        monkeypatch.setattr(topk, "RUN", run)
        monkeypatch.setattr(topk, "BUCKET", bucket)
        monkeypatch.setattr(topk, "QUERIES", queries)
        monkeypatch.setattr(topk, "LEAST_QUERIES", queries)
        assert sorted(map(tuple, topk.top_products(df, lambda v: v % 20 == 0, k=7).collect())) == want
    assert topk.top_products(df.limit(0), lambda v: v % 20 == 0).count() == 0


def test_lengths_prune_runs(spark, monkeypatch):
    """Very unequal lengths, a third of them the same vector: short runs are not asked for."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 8)) * rng.exponential(2.0, (600, 1)) ** 2
    x[::3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    monkeypatch.setattr(topk, "RUN", 50)
    offered = []
    tiles = topk._tiles
    monkeypatch.setattr(topk, "_tiles", lambda a, b, dim, k: offered.append(b) or tiles(a, b, dim, k))
    got = topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda v: v % 20 == 0, k=5)
    assert sorted(map(tuple, got.collect())) == brute_products(rows, 5)
    asked = offered[1].select("query", "tile").distinct().count()
    assert asked < 0.7 * 30 * 11  # of 30 queries with 11 or more further tiles each


def test_tiles_prune_exactly():
    rng = np.random.default_rng(5)
    rows = np.sort(rng.integers(-60, 60, (500, 24)), axis=0) * rng.integers(1, 4, (500, 1))
    rows = rows[np.argsort(-(rows**2).sum(1), kind="stable")]
    queries, ids = rng.integers(-60, 60, (40, 24)), np.arange(500)
    scores = queries @ rows.T
    for share in (0.0, 0.5, 0.98):  # length pruning, coordinate pruning, skipping
        bound = np.quantile(scores, share, axis=1) if share else np.full(40, -np.inf)
        i, j, s = topk.tile_scores(queries, bound, rows, ids, np.full(40, -1), 10)
        for q in range(40):
            want = sorted(((-int(x), k) for k, x in enumerate(scores[q]) if x >= bound[q]))[:10]
            assert sorted(zip((-s[i == q]).tolist(), j[i == q].tolist())) == want


def test_tiny_and_huge_vectors(spark):
    """Neither one row of the smallest numbers nor of the largest ones changes what others link with; both link by direction."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(200, 16))
    rows = [(i, x) for i, x in enumerate(base)] + [(300 + i, x + rng.normal(scale=0.02, size=16)) for i, x in enumerate(base[:100])]
    odd = [(500, base[0] * 1e-200), (501, base[1] * 1e200), (502, base[1] * 1e-300), (503, base[2] * 5e-320), (504, np.eye(16)[0] * 1.7e308), (505, np.eye(16)[0] * 5e-324), (506, -np.eye(16)[0] * 1e-200)]
    scaled = [(i, x / np.abs(x).max()) for i, x in rows + odd]
    frame = lambda r: spark.createDataFrame([(i, x.tolist()) for i, x in r], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in pq.near_vectors(frame(rows + odd)).collect())
    want, _ = brute_links([(i, x.tolist()) for i, x in scaled])
    # the third odd row has few digits left: its direction is rounded
    assert [g[:2] for g in got if g[0] not in (2, 302, 503)] == [w[:2] for w in want if w[0] not in (2, 302, 503)]
    links = {g[0]: g[1] for g in got}
    assert links[500] >= 2 and links[501] >= 3 and links[504] == 1 and links[505] == 1 and links[506] == 0
    before = {r[0]: r[1] for r in pq.near_vectors(frame(rows)).collect()}
    assert all(links[i] == n for i, n in before.items() if i not in (0, 1, 2, 300, 301, 302))


def test_products_beyond_64_bits(spark):
    rows = [(0, [1e9, 1e9]), (1, [1e9, 1e9]), (2, [-1e9, -1e9]), (3, [1e30, 1.0]), (4, [1.0, 1.0]), (5, [2e7, 2e7]), (20, [3e7, 0.0]), (40, [-1e30, 1e30])]
    got = [tuple(r) for r in topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda v: v % 20 == 0).collect()]
    low, high = -(1 << 63), (1 << 63) - 1
    held = lambda x: max(low, min(high, x))
    whole = {i: [held(int(np.floor(np.float64(64 * x)))) for x in v] for i, v in rows}
    want = []
    for q in (0, 20, 40):
        scores = sorted((-held(sum(a * b for a, b in zip(whole[q], whole[i]))), i) for i in whole if i != q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert sorted(got) == sorted(want)
