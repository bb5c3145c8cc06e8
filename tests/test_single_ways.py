"""Sums, cut, tree and reduction along single ways: no row per reachable pair, and the same results on any graph."""

import random

import pytest

from deploom.operators import fixpoint, graph_ops
from deploom.operators.sets import PackageSet
from deploom.operators.stats import Graph
from deploom.sources.catalog import Catalog


def package_set(spark, size, edges):
    rows = [("base", n, n, None, n == "std", 1, x) for n, x in size.items()]
    packages = spark.createDataFrame(rows, "variant string, id string, name string, module_path string, is_std boolean, package_count long, go_lines long")
    catalog = Catalog.of(packages, spark.createDataFrame([("base", a, b, b) for a, b in edges], "variant string, src_id string, import_path string, dst_id string"))
    return PackageSet(packages.select("id", "variant"), catalog)


def reach(edges):
    below = {}
    for a, b in edges:
        below.setdefault(a, set()).add(b)
    out = {}
    for n in {x for e in edges for x in e}:
        seen, todo = set(), list(below.get(n, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += below.get(x, ())
        out[n] = seen
    return out


def chain():
    """A chain in which each package imports its next two and the last: one way, though every package but two has three imports."""
    edges = [(f"c{k:02d}", f"c{k + d:02d}") for k in range(30) for d in (1, 2) if k + d < 30] + [(f"c{k:02d}", "end") for k in range(30)] + [("end", "std"), ("x", "end")]
    return {n: i + 1 for i, n in enumerate(sorted({x for e in edges for x in e}))}, edges


def random_graph(seed, acyclic):
    rnd, n = random.Random(seed), 24
    edges = {(f"n{a:02d}", f"n{b:02d}") for a in range(n) for b in [rnd.randrange(n) for _ in range(rnd.choice([0, 1, 1, 2, 3]))] if (a < b if acyclic else True)}
    edges |= {(f"t{k}", f"t{k + 1}") for k in range(5)} | {("t5", "n03")}
    return {x: i + 1 for i, x in enumerate(sorted({x for e in edges for x in e}))}, sorted(edges)


def check(spark, size, edges):
    s = package_set(spark, size, edges)
    graph, far = Graph(s), reach(edges)
    down = {r["id"]: (r["package_count"], r["go_lines"]) for r in graph.down().collect()}
    up = {r["id"]: (r["package_count"], r["go_lines"]) for r in graph.up().collect()}
    total = lambda ids: (len(ids), sum(size[x] for x in ids))
    assert down == {n: total(far[n] - {n}) for n in size}
    assert up == {n: total({x for x in size if n in far[x]} - {n}) for n in size}
    reduced = {tuple(r) for r in Graph(graph_ops.transitive(s)).edges().collect()}
    assert reduced == {(a, b) for a, b in edges if not any(b in far[v] for u, v in edges if u == a)}
    above = {n: {a for a, b in edges if b == n} for n in size}
    want = {}
    for n in size:
        gone = {n}
        while more := {x for x in size if x not in gone and above[x] and above[x] <= gone}:
            gone |= more
        want[n] = total(gone)
    assert {r["id"]: (r["cut_package_count"], r["cut_go_lines"]) for r in graph.cut().collect()} == want
    return graph


def test_chain_needs_no_pairs(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("rows for pairs")

    for name in ("pair_closure", "cut_closure", "smallest_paths"):
        monkeypatch.setattr(fixpoint, name, refused)
    size, edges = chain()
    lines = [(r["depth"], r["id"]) for r in check(spark, size, edges).tree().orderBy("line").collect()]
    assert lines[:31] == [(k, f"c{k:02d}") for k in range(30)] + [(30, "end")] and len(lines) == len(edges) + 2


@pytest.mark.parametrize("seed, acyclic", [(1, True), (2, False)])
def test_other_graphs(spark, seed, acyclic):
    check(spark, *random_graph(seed, acyclic))
