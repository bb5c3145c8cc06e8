"""Operators on a small module whose answers were worked out by hand, and on random graphs against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from deploom.engine import Engine
from deploom.operators import fixpoint, graph_ops
from deploom.operators.sets import PackageSet
from deploom.operators.stats import Graph
from deploom.plans.expr import ExprError
from deploom.sources.catalog import Catalog, Context

EDGES = "shop>cart shop>login shop>price desk>login desk>bill desk>ledger cron>bill bill>ledger cart>ledger cart>price ledger>disk login>keys keys>disk price>disk"
MAIN = ("shop", "desk", "cron")


def catalog(spark, edges, extra=(), mains=()):
    pairs = [e.split(">") for e in edges]
    ids = sorted({x for p in pairs for x in p} | set(extra))
    packages = spark.createDataFrame([("base", i, "main" if i in mains else "p", "m", False, 1, 10) for i in ids], "variant string, id string, name string, module_path string, is_std boolean, package_count bigint, go_lines bigint")
    imports = spark.createDataFrame([("base", a, b, b) for a, b in pairs], "variant string, src_id string, import_path string, dst_id string")
    return Catalog.of(packages, imports)


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(catalog(spark, EDGES.split(), mains=MAIN))


def ids(s):
    return sorted(r["id"] for r in s.members.collect())


def test_selectors(engine):
    assert ids(engine.calc("...:source")) == sorted(MAIN)
    assert ids(engine.calc("...:main")) == sorted(MAIN)
    assert ids(engine.calc("incoming(..., ledger)")) == ["bill", "cart", "desk", "ledger"]
    assert ids(engine.calc("reach(..., ledger)")) == ["bill", "cart", "cron", "desk", "ledger", "shop"]
    assert ids(engine.calc("cart:import")) == ["ledger", "price"]
    assert ids(engine.calc("cart:import:all")) == ["disk", "ledger", "price"]
    assert ids(engine.calc("xor(shop cart, cart desk)")) == ["desk", "shop"]
    for wrong in ("nothing(a)", "a:unknown", "q := cart; q := desk"):
        with pytest.raises(ExprError):
            engine.calc(wrong)
    with pytest.raises(ExprError, match=r"^\[.*nothing.* .*unknown.*\]$"):
        engine.calc("nothing(a) + b:unknown + cart")


def test_default_is_the_working_folder(spark):
    pairs = ["m>m/x", "m/x>m/x/y"]
    c = catalog(spark, pairs)
    assert ids(Engine(c).calc()) == ["m"]
    inner = Catalog(c.packages, c.edges, root="m/x")
    assert ids(Engine(inner).calc()) == ["m/x"] and ids(Engine(inner).calc("./...")) == ["m/x", "m/x/y"] and ids(Engine(inner).calc("./y")) == ["m/x/y"]


def test_sums_and_cut(engine):
    g = Graph(engine.calc("..."))
    down = {r["id"]: r["package_count"] for r in g.down().collect()}
    assert down == {"shop": 6, "desk": 5, "cron": 3, "cart": 3, "bill": 2, "login": 2, "ledger": 1, "price": 1, "keys": 1, "disk": 0}
    up = {r["id"]: r["package_count"] for r in g.up().collect()}
    assert up == {"disk": 9, "ledger": 5, "keys": 3, "price": 2, "login": 2, "bill": 2, "cart": 1, "shop": 0, "desk": 0, "cron": 0}
    cut = [(r["id"], r["in_degree"], r["cut_package_count"]) for r in engine.cut("...").collect()]
    assert cut == [("shop", 0, 3), ("cron", 0, 1), ("desk", 0, 1), ("cart", 1, 1), ("keys", 1, 1), ("login", 2, 2), ("bill", 2, 1), ("price", 2, 1), ("disk", 3, 1), ("ledger", 3, 1)]


def test_reduction(engine):
    kept = {(r["src"], r["dst"]) for r in Graph(engine.calc("transitive(...)")).edges().collect()}
    whole = {tuple(e.split(">")) for e in EDGES.split()}
    assert whole - kept == {("shop", "price"), ("desk", "ledger")}


def test_tree(engine):
    rows = [(r["line"], r["depth"], r["id"], r["ref"]) for r in engine.tree("...").orderBy("line").collect()]
    assert rows == [
        (1, 0, "cron", None), (2, 1, "bill", None), (3, 2, "ledger", None), (4, 3, "disk", None),
        (5, 0, "desk", None), (6, 1, "bill", 2), (7, 1, "ledger", 3), (8, 1, "login", None), (9, 2, "keys", None), (10, 3, "disk", 4),
        (11, 0, "shop", None), (12, 1, "cart", None), (13, 2, "ledger", 3), (14, 2, "price", None), (15, 3, "disk", 4), (16, 1, "login", 8), (17, 1, "price", 14),
    ]


def test_sources_count_importers_inside_only(spark):
    c = catalog(spark, ["a>b", "b>c", "x>b"])
    members = spark.createDataFrame([(i, "base") for i in "abc"], "id string, variant string")
    assert ids(graph_ops.sources(PackageSet(members, c))) == ["a"]


def test_variants_and_tests(spark):
    packages = spark.createDataFrame([(v, i, "p", "m", False, 1) for v, i in (("base", "a"), ("base", "b"), ("base", "a.test"), ("goos=x", "a"), ("goos=x", "c"))], "variant string, id string, name string, module_path string, is_std boolean, package_count bigint")
    imports = spark.createDataFrame([("base", "a", "b", "b"), ("goos=x", "a", "c", "c")], "variant string, src_id string, import_path string, dst_id string")
    e = Engine(Catalog.of(packages, imports))
    assert ids(e.calc("goos=x(a:all) - a:all")) == ["c"]
    assert ids(e.calc("goos=x(a) + a:all")) == ["a", "b"]
    assert ids(e.calc("...:test")) == ["a.test"] and ids(e.calc("...:+test")) == ["a", "a.test", "b"]
    assert ids(e.calc("(a + b):+test")) == ["a", "b"] and ids(e.calc("test=1(...)")) == ["a", "a.test", "b"]
    assert Context().set("Test", "1").tests and Context().set("purego", "1").key() == "tag=purego"


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, monkeypatch, seed):
    rnd = random.Random(seed)
    nodes = [f"n{i:02d}" for i in range(14)]
    pairs = sorted({(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(24)} - {(n, n) for n in nodes})
    after = {n: {b for a, b in pairs if a == n} for n in nodes}

    def below(start):
        seen, todo = set(), [start]
        while todo:
            for b in after[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        return seen

    c = catalog(spark, [f"{a}>{b}" for a, b in pairs], nodes)
    roots = nodes[:3]
    members = spark.createDataFrame([(i, "base") for i in roots], "id string, variant string")
    got = {r["id"] for r in fixpoint.closure(members, c.edges).collect()}
    assert got == set(roots).union(*(below(r) for r in roots))
    every = spark.createDataFrame([(i, "base") for i in nodes], "id string, variant string")
    x = PackageSet(every, c)
    goal = nodes[5]
    assert ids(graph_ops.reach(x, x.with_(every.where(F.col("id") == goal)))) == sorted(n for n in nodes if n == goal or goal in below(n))
    want = {(n, m) for n in nodes for m in below(n)}
    for growth in (fixpoint.GROWTH, 0):  # with edges of several steps, and one by one
        monkeypatch.setattr(fixpoint, "GROWTH", growth)
        assert {(r["root"], r["id"]) for r in fixpoint.pair_closure(every, c.edges).collect()} == want
        callers = fixpoint.reverse_reach(spark.createDataFrame([(goal,)], "node string"), c.edges.select(F.col("dst_id").alias("target"), F.col("src_id").alias("source")))
        assert {r["node"] for r in callers.collect()} == {goal} | {n for n, m in want if m == goal}
    # acyclic part: cut against its definition
    down = [(a, b) for a, b in pairs if a < b]
    c = catalog(spark, [f"{a}>{b}" for a, b in down], nodes)
    cut = {r["id"]: r["cut_package_count"] for r in Graph(PackageSet(every, c)).cut().collect()}
    for n in nodes:
        gone = {n}
        while more := {b for _, b in down if b not in gone and all(a in gone for a, y in down if y == b)}:
            gone |= more
        assert cut[n] == len(gone), n


def test_empty_sets(spark, engine):
    assert ids(engine.calc("none:all")) == [] and ids(engine.calc("reach(none, cart)")) == []
    assert Graph(engine.calc("none")).totals().first()["package_count"] == 0
    assert engine.graph("none", type="edges").count() == 0


def test_writers(engine):
    dot = [r["line"] for r in engine.graph("cart price", type="DOT", template="{{.ID}}", colors={"red": "cart"}).orderBy("line_no").collect()]
    assert dot[0] == "digraph G {" and dot[-1] == "}" and '    "cart" [label="cart" href="https://pkg.go.dev/cart" color="red"];' in dot
    assert [r["line"] for r in engine.graph("cart price", type="tgf").orderBy("line_no").collect()] == ["1 cart", "2 price", "#", "1 2"]
    assert [r["line"] for r in engine.graph("cart price", type="digraph").orderBy("line_no").collect()] == ["cart price", "price"]
    xml = "\n".join(r["line"] for r in engine.graph("cart price", type="graphml").orderBy("line_no").collect())
    from xml.dom.minidom import parseString

    assert len(parseString(xml).getElementsByTagName("node")) == 2


def printed(df):
    return [r["line"] for r in df.orderBy("line_no").collect()]


def test_printed_tables(engine):
    assert printed(engine.list_text("cart login shop", fmt="{{.ID}}\t{{.Down.PackageCount}}\t{{.Stat.Go.Lines}}")) == ["ID      Down.PackageCount   Stat.Go.Lines", "cart    0" + " " * 19 + "10", "login   0" + " " * 19 + "10", "shop    2" + " " * 19 + "10"]
    assert printed(engine.list_text("cart", header="-", align=False, fmt="{{.ID}}\t{{.InDegree}}")) == ["cart\t0"]
    assert printed(engine.cut_text("...", fmt="{{.ID}}\t{{.Cut.PackageCount}}", header="who\tn"))[:3] == ["who      n", "shop     3", "cron     1"]


def test_records(engine):
    import json

    got = {r["id"]: json.loads(r["json"]) for r in engine.json("cart price ledger").collect()}
    assert got["cart"]["Package"] == {"ID": "cart", "Name": "p", "Imports": {"ledger": "ledger", "price": "price"}} and got["cart"]["ImportsNodes"] == ["ledger", "price"]
    assert (got["cart"]["Down"]["PackageCount"], got["ledger"]["Up"]["Go"]["Lines"], got["price"]["Stat"]["Go"]["Lines"]) == (2, 10, 10)
    assert "ImportsNodes" not in got["price"] and got["price"]["Package"]["Imports"] == {"disk": "disk"} and "Errors" not in got["cart"]


def test_modules(spark):
    rows = [("a.test/x", "a.test/x", "v1.2.3", False, None, None), ("a.test/x/s", "a.test/x", "v1.2.3", False, None, None), ("b.test/y/v2/s", "b.test/y/v2", "v2.0.1", False, "c.test/z", "v0.1.0"), ("d.test/w/v3", "d.test/w/v3", "v2.0.0", False, None, None), ("e.test/u/v3", "e.test/u/v3", None, True, None, None), ("gopkg.in/q.v2", "gopkg.in/q.v2", "v2.4.0", False, None, None), ("f.test/m/v2", "f.test/m/v2", "v2.1.0", False, None, None), ("f.test/m/s", "f.test/m", "v1.1.0", False, None, None)]
    packages = spark.createDataFrame([("base", i, "p", m, v, loc, rp, rv, False, 1) for i, m, v, loc, rp, rv in rows], "variant string, id string, name string, module_path string, module_version string, is_local boolean, replace_path string, replace_version string, is_std boolean, package_count bigint")
    imports = spark.createDataFrame([], "variant string, src_id string, import_path string, dst_id string")
    got = {r["id"]: (r["repo_root"], r["single_module"], r["module_label"]) for r in Engine(Catalog.of(packages, imports)).graph_of("...").module_tree().collect()}
    assert got["a.test/x/s"] == ("a.test/x", True, "a.test/x@v1.2.3")
    assert got["b.test/y/v2/s"] == ("b.test/y", True, "b.test/y/v2@v2.0.1 =>\\nc.test/z@v0.1.0")
    assert got["d.test/w/v3"] == ("d.test/w", False, "d.test/w/v3@v2.0.0")
    assert got["e.test/u/v3"] == ("e.test/u", True, "e.test/u/v3 (local)")
    assert got["gopkg.in/q.v2"] == ("gopkg.in/q", True, "gopkg.in/q.v2@v2.4.0")
    assert got["f.test/m/s"][:2] == ("f.test/m", False) == got["f.test/m/v2"][:2]


def test_variants_meet(spark):
    """Where variants meet, the first loaded stays, whatever their names; the other order gives the other result."""
    from deploom.sources.catalog import Catalog
    from deploom.engine import Engine

    packages = [(v, i, "p", None, False) for v in ("base", "tag=a") for i in ("r", "s", "x", "y", "z")]
    imports = [("base", "r", "x"), ("base", "x", "y"), ("tag=a", "s", "x"), ("tag=a", "x", "z"), ("tag=a", "r", "z")]
    c = Catalog.of(spark.createDataFrame(packages, "variant string, id string, name string, module_path string, is_std boolean"), spark.createDataFrame([(v, a, b, b) for v, a, b in imports], "variant string, src_id string, import_path string, dst_id string"))
    run = lambda e: {(r["id"], r["variant"]) for r in Engine(c).calc(e).members.collect()}
    assert run("(r + a=1(s)):all") == {("r", "base"), ("x", "base"), ("y", "base"), ("s", "tag=a")}
    assert run("(a=1(s) + r):all") == {("r", "base"), ("x", "tag=a"), ("z", "tag=a"), ("s", "tag=a")}
    assert run("(a=1(r) + x):all") == {("r", "tag=a"), ("z", "tag=a"), ("x", "base"), ("y", "base")}
