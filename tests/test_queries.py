"""Driver queries against their SQL on the smallest tables."""

import os

import pytest

from deploom import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
SOME = ["set_union", "set_subtract", "load_group", "sel_all", "sel_import", "sel_source", "sel_main", "sel_test", "fn_incoming", "expr_context", "graph_totals", "graph_degree", "module_tree", "file_line_stats", "mem_string", "mem_string_short", "rel_rename", "num_funcs", "nm_parse", "weight_rollup", "weight_topk", "weight_diff_cum", "deadcode_edges", "list_text", "weight_text", "weight_diff_text", "node_json", "exec_inputs", "exec_text", "exec_commands", "weight_own", "syntax_files", "syntax_list", "syntax_json", "module_paths", "pattern_here", "template_builtins", "list_format", "sel_test_minus", "pattern_std", "list_without_std", "exec_sizes", "symbol_kinds", "weight_diff_alias", "tree_print", "closure_of_variants"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    key = lambda row: tuple((v is None, "" if v is None else v) for v in row)
    got = sorted(key([r[c] for c in columns]) for r in df.collect())
    rows = duck.execute(Q.ORACLES[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    want = sorted(key([r[names.index(c)] for c in columns]) for r in rows.fetchall())
    assert got == want and (got or (name == "sel_test" and not want))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
