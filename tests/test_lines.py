"""Single ways in lines: sums, trees and node records without paths or repeated reading of the members."""

import json
import random

import pyarrow as pa
import pytest
from test_single_ways import check, chain, package_set, reach

from deploom import queries as Q
from deploom.operators import fixpoint, forest, walk
from deploom.operators.stats import Graph
from deploom.writers import reports


def printed(size, edges):
    """(line, depth, id, parent, ref) of the tree by walking it."""
    below = {n: sorted(b for a, b in edges if a == n) for n in size}
    out, shown = [], {}

    def go(n, depth, parent):
        out.append([len(out) + 1, depth, n, parent, None if n == "std" else shown.get(n)])
        if n not in shown:
            shown[n] = len(out)
            for b in below[n] if n != "std" else ():
                go(b, depth + 1, n)

    for n in sorted(set(size) - {b for _, b in edges}):
        go(n, 0, None)
    return out


def single_ways(seed, n, far):
    """Packages whose names say nothing of their place: each imports its next step (one of the ``far`` newest) and some of what that imports."""
    rnd = random.Random(seed)
    names = [f"p{k:03d}" for k in rnd.sample(range(1000), n)]
    below = {"std": set(), names[0]: {"std"}}
    for k in range(1, n):
        step = names[rnd.randrange(max(0, k - far), k)]
        below[names[k]] = {step} | {x for x in below[step] if rnd.random() < 0.6}
    below["alone"] = set()
    return {x: i + 1 for i, x in enumerate(sorted(below))}, sorted((a, b) for a in below for b in below[a])


@pytest.fixture
def no_paths(monkeypatch):
    def refused(*_):
        raise AssertionError("paths or pairs")

    monkeypatch.setattr(forest, "smallest_paths", refused)
    monkeypatch.setattr(forest, "sweep", refused)
    for name in ("pair_closure", "smallest_paths"):
        monkeypatch.setattr(fixpoint, name, refused)


def test_walk_opens_what_a_reader_would(spark):
    rnd = random.Random(5)
    for _ in range(300):
        n = rnd.randint(2, 12)
        names = rnd.sample([f"n{k:02d}" for k in range(40)], n)
        below = {names[n - 1]: {"z"}}
        for k in range(n - 2, -1, -1):
            below[names[k]] = {names[k + 1]} | {x for x in below[names[k + 1]] if rnd.random() < 0.7}
        edges = [(a, b) for a in names for b in below[a]]
        before = [sum(len(below[x]) for x in names[:k]) for k in range(n)]
        rows = []
        for i, a in enumerate(names):
            seen = []
            for nth, b in enumerate(sorted(below[a]), 1):
                to = names.index(b) if b in names else None
                least = min(seen, default=None)
                rows.append((a, b, 7, i, 1, len(edges), nth, least, None if least is None else before[least], to, None if to is None else before[to]))
                seen += [] if to is None else [to]
        batch = pa.RecordBatch.from_pylist([dict(zip(("a", "b", *walk.GIVEN), r)) for r in rows], pa.schema([("a", pa.string()), ("b", pa.string()), *[(c, pa.int64()) for c in walk.GIVEN]]))
        cut = rnd.randrange(len(rows) + 1)
        got = [r for b in walk.walker(("a", "b"))([batch.slice(0, cut), batch.slice(cut)]) for r in b.to_pylist()]
        want = printed(dict.fromkeys([*names, "z"], 1), edges)
        assert sorted((r["line"], r["depth"], r["b"], r["a"]) for r in got) == [tuple(w[:4]) for w in want[1:]]
        assert {r["line"] for r in got if r["opened"]} == {w[0] for w in want[1:] if w[4] is None and w[2] != "z"}


@pytest.mark.parametrize("seed, n, far", [(1, 70, 2), (2, 60, 12)])
def test_tree_needs_no_paths(spark, no_paths, seed, n, far):
    size, edges = single_ways(seed, n, far)
    got = sorted([r["line"], r["depth"], r["id"], r["parent_id"], r["ref"]] for r in Graph(package_set(spark, size, edges)).tree().collect())
    assert got == printed(size, edges)


def test_printed_tree_needs_no_paths(spark, no_paths):
    at = "/root/testdata/sf0.001"
    rows = {r["line"]: r for r in Q.QUERIES["tree_lines_whole"](spark, at).collect()}
    lines = [r["line"] for r in Q.QUERIES["tree_text"](spark, at).orderBy("line_no").collect()]
    assert len(lines) == len(rows) > 1000
    for k, line in enumerate(lines, 1):
        r = rows[k]
        assert line.startswith(f"{k:<4}" + "  " * r["depth"] + "  ") and r["id"] in line and (r["ref"] is None or line.endswith(f" @{r['ref']}"))


def test_long_lines_are_cut(spark, monkeypatch):
    """No line is longer than ``LINE``: what is cut adds up as lines do."""
    monkeypatch.setattr(forest, "LINE", 4)
    size, edges = chain()
    graph = check(spark, size, edges)
    assert graph.forest().lines.agg({"n": "max"}).first()[0] <= 4
    got = sorted([r["line"], r["depth"], r["id"], r["parent_id"], r["ref"]] for r in graph.tree().collect())
    assert got == printed(size, edges)


def test_node_records(spark, no_paths):
    size, edges = single_ways(3, 40, 5)
    far = reach(edges)
    for r in reports.node_json(Graph(package_set(spark, size, edges))).collect():
        got, n = json.loads(r["json"]), r["id"]
        assert got.get("ImportsNodes", []) == sorted(b for a, b in edges if a == n) == list(got["Package"].get("Imports", {}))
        assert (got["Down"]["PackageCount"], got["Down"]["Go"]["Lines"]) == (len(far.get(n, ())), sum(size[x] for x in far.get(n, ())))
        assert (got["Up"]["PackageCount"], got["Up"]["Go"]["Lines"]) == (sum(n in f for f in far.values()), sum(size[x] for x in far if n in far[x]))


def test_a_union_of_patterns_is_one_load(spark):
    at = "/root/testdata/sf0.001"
    joined = Q.engine(spark, at).calc(Q.GRAPH).packages()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in joined


def test_names_that_share_a_key_get_others(spark, monkeypatch):
    """The hash is changed where two names share one."""
    from pyspark.sql import functions as F

    whole, used = F.xxhash64, []

    def weak(salt, *cols):
        used.append(salt)
        return whole(salt, *cols) % F.when(salt == 0, 3).otherwise(1 << 62)

    edges = spark.createDataFrame([("", f"n{k}", f"n{k + 1}") for k in range(20)], "variant string, src_id string, dst_id string")
    monkeypatch.setattr(forest.F, "xxhash64", weak)
    pairs, _ = forest.hashed(edges)
    assert pairs.select("s").distinct().count() == 20 and len(used) > 6
