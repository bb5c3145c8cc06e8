"""Cut, tree and writers over every package of a small warehouse, against brute force."""

import random

import pytest

from deploom import queries as Q


@pytest.fixture(scope="module")
def warehouse(spark, tmp_path_factory):
    """Folder, nodes (id to go_lines) and edges of 6 customers, 40 orders, 3 suppliers, 3 nations and 2 regions."""
    rnd, at = random.Random(3), str(tmp_path_factory.mktemp("warehouse"))
    orders = [(k, rnd.randint(1, 6), f"1995-01-{rnd.randint(1, 28):02d}", rnd.choice("OFP"), rnd.choice(["1-URGENT", "2-HIGH", "3-MEDIUM"]), 100.5 + k) for k in range(1, 41)]
    tables = {
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderdate string, o_orderstatus string, o_orderpriority string, o_totalprice double"),
        "customer": ([(c, c % 3) for c in range(1, 7)], "c_custkey long, c_nationkey int"),
        "supplier": ([(s, s % 3) for s in range(1, 4)], "s_suppkey long, s_nationkey int"),
        "nation": ([(n, n % 2) for n in range(3)], "n_nationkey int, n_regionkey int"),
        "region": ([(0,), (1,)], "r_regionkey int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    name = lambda o: f"order/{o[0]}" + (".test" if o[3] == "P" and o[4] == "1-URGENT" else "")
    nodes = {name(o): o[0] % 500 for o in orders} | {f"cust/{c}": c for c in range(1, 7)} | {f"supp/{s}": s for s in range(1, 4)} | {f"nation/{n}": 100 for n in range(3)} | {f"region/{r}": 200 for r in range(2)}
    edges = {(name(o), f"cust/{o[1]}") for o in orders} | {(f"cust/{c}", f"nation/{c % 3}") for c in range(1, 7)} | {(f"supp/{s}", f"nation/{s % 3}") for s in range(1, 4)} | {(f"nation/{n}", f"region/{n % 2}") for n in range(3)}
    for c in range(1, 7):
        own = sorted((o for o in orders if o[1] == c), key=lambda o: (o[2], o[0]))
        edges |= {(name(own[i]), name(own[i - d])) for d in (1, 2) for i in range(d, len(own))}
    assert any(n.endswith(".test") for n in nodes)
    nodes = {n: x for n, x in nodes.items() if not n.endswith(".test")}
    return at, nodes, sorted((a, b) for a, b in edges if a in nodes and b in nodes)


def test_changed_tables_are_read_again(spark, tmp_path, warehouse):
    """Derived tables hold only as long as the files they come from."""
    import shutil

    at = str(tmp_path / "w")
    shutil.copytree(warehouse[0], at)
    run = lambda: {r["id"] for r in Q.QUERIES["pattern_prefix"](spark, at).collect()}
    before = run()
    spark.createDataFrame([(s, 0) for s in range(1, 9)], "s_suppkey long, s_nationkey int").write.mode("overwrite").parquet(f"{at}/supplier.parquet")
    spark.catalog.clearCache()
    assert before == {"supp/1", "supp/2", "supp/3"} and run() == {f"supp/{s}" for s in range(1, 9)}


def test_cut(spark, warehouse):
    at, nodes, edges = warehouse
    above = {n: {a for a, b in edges if b == n} for n in nodes}
    want = {}
    for n in nodes:
        gone = {n}
        while more := {x for x in nodes if x not in gone and above[x] and above[x] <= gone}:
            gone |= more
        want[n] = (len(above[n]), sum(a == n for a, _ in edges), len(gone), sum(nodes[x] for x in gone))
    got = {r["id"]: (r["in_degree"], r["out_degree"], r["cut_package_count"], r["cut_go_lines"]) for r in Q.QUERIES["graph_cut_whole"](spark, at).collect()}
    assert got == want and max(w[2] for w in want.values()) > 3


def test_tree(spark, warehouse):
    at, nodes, edges = warehouse
    below = {n: sorted(b for a, b in edges if a == n) for n in nodes}
    want, shown = [], {}

    def walk(n, depth, parent):
        line = len(want) + 1
        want.append((line, depth, n, parent, shown.get(n)))
        if n not in shown:
            shown[n] = line
            if not n.startswith("region/"):
                for b in below[n]:
                    walk(b, depth + 1, n)

    for n in sorted(set(nodes) - {b for _, b in edges}):
        walk(n, 0, None)
    want = [(*w[:4], None if w[2].startswith("region/") else w[4]) for w in want]
    got = sorted(tuple(r) for r in Q.QUERIES["tree_lines_whole"](spark, at).collect())
    assert got == want and set(nodes) == {w[2] for w in want}
    last = {p: max(w[2] for w in want if w[3] == p) for p in {w[3] for w in want} - {None}}
    printed = [f"{line:<4}" + "  " * depth + ("  └ " if parent and n == last[parent] else "  ├ ") + n + (" ~" if n.startswith("region/") else f" @{ref}" if ref else "") for line, depth, n, parent, ref in want]
    assert [r["line"] for r in Q.QUERIES["tree_text"](spark, at).orderBy("line_no").collect()] == printed


def test_writers(spark, warehouse):
    at, nodes, edges = warehouse
    lines = lambda q: [r["line"] for r in Q.QUERIES[q](spark, at).orderBy("line_no").collect()]
    order = sorted(nodes)
    place = {n: i + 1 for i, n in enumerate(order)}
    assert lines("edges_out_whole") == [f"{a} {b}" for a, b in edges]
    assert lines("digraph_out_whole") == [" ".join([n, *(b for a, b in edges if a == n)]) for n in order]
    assert lines("tgf_out_whole") == [f"{place[n]} {n}" for n in order] + ["#"] + [f"{place[a]} {place[b]}" for a, b in edges]
    key = lambda n: n.replace("/", "_")
    assert [x for x in lines("mermaid_out_whole") if "-->" in x] == [f"    {key(a)} --> {key(b)}" for a, b in edges]
    for q in ("dot_out_whole", "dot_color_out", "dot_cluster_out"):
        got = lines(q)
        assert sum(" -> " in x and x.startswith('    "') for x in got) == len(edges), q
        assert all(any(x.startswith(f'    "{n}" [label=') for x in got) for n in nodes), q
    got = lines("graphml_out")
    assert all(any(f'<node id="{n}"' in x for x in got) for n in nodes) and sum("<edge " in x for x in got) == len(edges)


def test_modules_and_build_steps(spark, warehouse):
    at, nodes, _ = warehouse
    got = sorted(r["id"] for r in Q.QUERIES["sel_module_whole"](spark, at).collect())
    assert got == sorted(n for n in nodes if n.startswith(("cust/", "nation/")))
    want = []
    for r in spark.read.parquet(f"{at}/orders.parquet").collect():
        k = r["o_orderkey"]
        if r["o_orderpriority"] == "1-URGENT":
            want.append(("link", "", f"out/{k}", f"{k}.a"))
        else:
            want.append(("compile", f"order/{k}", f"out/{k}.a", f"{k}.go,{k}.s" if r["o_orderstatus"] == "F" else f"{k}.go"))
    assert sorted(map(tuple, Q.QUERIES["exec_inputs"](spark, at).collect())) == sorted(want)
