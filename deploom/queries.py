"""Driver queries over the warehouse-derived tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions import scalars as S
from .functions.declarations import COLUMNS, declarations
from .functions.symbols import is_linker_data, package_of_symbol, package_of_type
from .functions.template import compile_template
from .operators import deadcode, weight
from .operators.stats import Graph
from .sources.warehouse import catalog, ctes, go_files, module_catalog, source_catalog, stamp, symbol_lines
from .writers import tables

STATS = ("package_count", "go_size", "go_lines", "go_blank", "decl_func")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


_ENGINES: dict[tuple, Engine] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """One engine per application and state of a folder, so that commands share what is worked out of a graph."""
    key = spark.sparkContext.applicationId, sf_dir, stamp(spark, sf_dir)
    if key not in _ENGINES:
        _ENGINES[key] = Engine(catalog(spark, sf_dir))
    return _ENGINES[key]


#: The set language in DuckDB: parts of a recursive statement.
LIVE = "select id from packages where id not like '%.test'"


def start(pattern: str) -> str:
    return f"select id from packages where id like '{pattern}/%' and id not like '%.test'"


def recursive(*defs: str, tables_: tuple = ("packages", "imports_base")) -> str:
    return "with recursive " + ",\n".join((ctes(*tables_), *defs)) + "\n"


def closure(name: str, seed: str, edges: str = "imports_base") -> str:
    return f"{name}(id) as (select id from ({seed}) union select e.dst_id from {name} c join {edges} e on e.src_id = c.id)"


def backward(name: str, seed: str, edges: str = "imports_base") -> str:
    return f"{name}(id) as (select id from ({seed}) union select e.src_id from {name} c join {edges} e on e.dst_id = c.id)"


def expression(name: str, text: str, oracle: str) -> None:
    """A query that is one expression; its result is the ids."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir).calc(text).ids()

    query(name, oracle)(run)


ORDERS, CUSTS, SUPPS, NATIONS, REGIONS = map(start, ("order", "cust", "supp", "nation", "region"))
BASE = recursive()
expression("set_union", "nation/... + region/... + nation/1", BASE + f"{NATIONS} union {REGIONS}")
expression("set_subtract", "cust/... - cust/1 - cust/2", BASE + f"{CUSTS} except select id from packages where id in ('cust/1', 'cust/2')")
expression("set_intersect", "shared(cust/...:all, supp/...:all)", recursive(closure("a", CUSTS), closure("b", SUPPS)) + "select id from a intersect select id from b")
expression("set_xor", "xor(cust/...:all, supp/...:all)", recursive(closure("a", CUSTS), closure("b", SUPPS)) + "(select id from a except select id from b) union (select id from b except select id from a)")
expression("load_group", "nation/... region/... cust/1", BASE + f"{NATIONS} union {REGIONS} union select id from packages where id = 'cust/1'")
expression("pattern_prefix", "supp/...", BASE + SUPPS)
expression("sel_all", "supp/...:all", recursive(closure("a", SUPPS)) + "select id from a")
expression("sel_import", "order/...:import", BASE + f"select distinct dst_id as id from imports_base where src_id in ({ORDERS}) and dst_id not in ({ORDERS})")
expression("sel_import_all", "order/...:import:all", recursive(f"d as (select distinct dst_id as id from imports_base where src_id in ({ORDERS}) and dst_id not in ({ORDERS}))", closure("a", "select id from d")) + "select id from a")
expression("sel_module", "(cust/1 cust/2):mod", recursive(closure("a", "select id from packages where id in ('cust/1', 'cust/2')")) + "select id from packages where id in ('cust/1', 'cust/2') union select a.id from a join packages p on p.id = a.id where p.module_path in (select module_path from packages where id in ('cust/1', 'cust/2'))")
_OC = f"select * from ({ORDERS}) union select * from ({CUSTS})"
_SOURCES = "select id from x where id not in (select dst_id from imports_base where src_id in (select id from x))"
expression("sel_source", "(order/... + cust/...):source", recursive(f"x as ({_OC})") + _SOURCES)
expression("sel_nosource", "(order/... + cust/...):nosource", recursive(f"x as ({_OC})") + f"select id from x except ({_SOURCES})")
expression("sel_main", "order/...:main", BASE + f"select id from packages where name = 'main' and id in ({ORDERS})")
expression("sel_test", "order/...:test", BASE + "select id from packages where id like 'order/%.test'")
expression("sel_test_plus", "order/...:+test", BASE + "select id from packages where id like 'order/%'")
expression("sel_plus_import", "supp/...:+import", BASE + f"{SUPPS} union select dst_id from imports_base where src_id in ({SUPPS})")
expression("sel_minus_source", "(order/... + cust/...):-source", recursive(f"x as ({_OC})") + f"select id from x except ({_SOURCES})")
expression("fn_reach", "reach(order/..., nation/3)", recursive(backward("b", "select 'nation/3' as id")) + f"select id from b where id in ({ORDERS})")
expression("fn_incoming", "incoming(order/... + cust/..., cust/1 cust/2)", recursive(f"x as ({_OC})") + "select id from packages where id in ('cust/1', 'cust/2') union select src_id from imports_base where dst_id in ('cust/1', 'cust/2') and src_id in (select id from x)")
expression("expr_variables", "a := nation/...; b := a + region/...; b - region/1", BASE + f"{NATIONS} union select id from ({REGIONS}) where id <> 'region/1'")


@query("expr_context", recursive(closure("a", f"select id from packages where name = 'main' and id in ({ORDERS})", "alt"), tables_=("packages", "imports_base", "alt")) + "select id, 'alt' as variant from a where id <> 'cust/1'")
def expr_context(spark, sf_dir):
    return engine(spark, sf_dir).calc("alt=1(order/...:main:all) - cust/1").members


@query("fn_transitive_edges", recursive(f"x as ({ORDERS} union {CUSTS})", "far(src, via, id) as (select src_id, dst_id, dst_id from imports_base where src_id in (select id from x) union select f.src, f.via, e.dst_id from far f join imports_base e on e.src_id = f.id)") + "select distinct i.src_id as src, i.dst_id as dst from imports_base i where i.src_id in (select id from x) and i.dst_id in (select id from x) and not exists (select 1 from far f where f.src = i.src_id and f.id = i.dst_id and f.via <> i.dst_id)")
def fn_transitive_edges(spark, sf_dir):
    return Graph(engine(spark, sf_dir).calc("transitive(order/... + cust/...)")).edges()


GRAPH = "cust/... + nation/... + region/... + order/..."
_G = f"g as ({LIVE} and id not like 'supp/%')"
_SUMS = ", ".join(f"sum({c})::bigint as {c}" for c in STATS)
_STATS = "s as (select id, 1::bigint as package_count, go_size, go_lines, go_blank, decl_func from packages where id in (select id from g))"
_PAIRS = "r(root, id) as (select src_id, dst_id from imports_base where src_id in (select id from g) union select r.root, e.dst_id from r join imports_base e on e.src_id = r.id)"
_ZERO = ", ".join(f"coalesce({c}, 0)::bigint as {c}" for c in STATS)


def graph(spark, sf_dir, text=GRAPH) -> Graph:
    return engine(spark, sf_dir).graph_of(text, std=True)


@query("graph_totals", recursive(_G, _STATS) + f"select {_SUMS} from s")
def graph_totals(spark, sf_dir):
    return graph(spark, sf_dir).totals().select(*STATS)


@query("graph_down", recursive(_G, _STATS, _PAIRS, f"d as (select root as id, {_SUMS} from r join s using (id) group by root)") + f"select g.id, {_ZERO} from g left join d using (id)")
def graph_down(spark, sf_dir):
    return graph(spark, sf_dir).down().select("id", *STATS)


@query("graph_up", recursive(_G, _STATS, _PAIRS, f"u as (select r.id, {_SUMS} from r join s on s.id = r.root group by r.id)") + f"select g.id, {_ZERO} from g left join u using (id)")
def graph_up(spark, sf_dir):
    return graph(spark, sf_dir).up().select("id", *STATS)


_EDGES = "e as (select distinct src_id as src, dst_id as dst from imports_base where src_id in (select id from g) and dst_id in (select id from g))"


@query("graph_edges", recursive(_G, _EDGES) + "select src, dst from e")
def graph_edges(spark, sf_dir):
    return graph(spark, sf_dir).edges()


@query("graph_degree", recursive(_G, _EDGES) + "select g.id, (select count(*) from e where e.dst = g.id)::bigint as in_degree, (select count(*) from e where e.src = g.id)::bigint as out_degree from g")
def graph_degree(spark, sf_dir):
    return graph(spark, sf_dir).degrees()


#: A part of the graph that the brute definitions in SQL can afford; the same operators run on all of it as ``*_whole``.
SMALL = "reach(order/..., cust/1 cust/2 cust/4) + cust/1 cust/2 cust/4"
_SMALL = backward("back", "select id from packages where id in ('cust/1', 'cust/2', 'cust/4')"), "g as (select id from back where id not like '%.test')"
_ROOTS = "roots as (select id from g where id not in (select dst from e))"
# what a member takes along: all that no path from a root reaches once it is gone
_LEFT = "kept(start, id) as (select g.id, roots.id from g, roots where roots.id <> g.id union select k.start, e.dst from kept k join e on e.src = k.id where e.dst <> k.start)"


@query("graph_cut", recursive(*_SMALL, _EDGES, _ROOTS, _LEFT, _STATS, "gone as (select a.id as start, b.id from g a, g b where not exists (select 1 from kept k where k.start = a.id and k.id = b.id))") + "select start as id, (select count(*) from e where e.dst = start)::bigint as in_degree, (select count(*) from e where e.src = start)::bigint as out_degree, " + ", ".join(f"sum({c})::bigint as cut_{c}" for c in STATS) + " from gone join s using (id) where start not in ('cust/2') group by start")
def graph_cut(spark, sf_dir):
    return engine(spark, sf_dir).cut(SMALL, exclude="cust/2").select("id", "in_degree", "out_degree", *["cut_" + c for c in STATS])


@query("tree_lines", recursive(*_SMALL, _EDGES, _ROOTS, "paths(id, path) as (select id, [id] from roots union select e.dst, list_append(p.path, e.dst) from paths p join e on e.src = p.id)", "best as (select id, min(path) as path from paths group by id)", "shown as (select id, path, null::varchar as parent_id from best join roots using (id) union all select e.dst, list_append(b.path, e.dst), e.src from e join best b on b.id = e.src)", "lines as (select row_number() over (order by path) as line, len(path) - 1 as depth, id, parent_id, path from shown)") + "select l.line::bigint as line, l.depth::bigint as depth, l.id, l.parent_id, case when l.line > f.line then f.line end::bigint as ref from lines l join best b on b.id = l.id join lines f on f.path = b.path")
def tree_lines(spark, sf_dir):
    return engine(spark, sf_dir).tree(SMALL).select("line", "depth", "id", "parent_id", "ref")


_EDGE_SMALL = recursive(*_SMALL, _EDGES)


def written_graph(name: str, kind: str, oracle: str | None, **options) -> None:
    def run(spark, sf_dir):
        return engine(spark, sf_dir).graph(SMALL, type=kind, **options)

    query(name, oracle)(run)


def _report(*parts: str) -> str:
    """Union of (part, k1, k2, k3, line) selects, numbered."""
    return "select row_number() over (order by part, k1, k2, k3)::bigint as line_no, line from (" + " union all ".join(parts) + ") t"


written_graph("edges_out", "edges", _EDGE_SMALL + _report("select 0 as part, src as k1, dst as k2, 0 as k3, src || ' ' || dst as line from e"))
written_graph("digraph_out", "digraph", _EDGE_SMALL + _report("select 0 as part, g.id as k1, '' as k2, 0 as k3, g.id || coalesce((select ' ' || string_agg(dst, ' ' order by dst) from e where e.src = g.id), '') as line from g"))
written_graph("tgf_out", "tgf", recursive(*_SMALL, _EDGES, "n as (select id, row_number() over (order by id) as i from g)") + _report("select 0 as part, id as k1, '' as k2, 0 as k3, i || ' ' || id as line from n", "select 1, '', '', 0, '#'", "select 2, src, dst, 0, a.i || ' ' || b.i from e join n a on a.id = src join n b on b.id = dst"))
_KEY = "regexp_replace({}, '[^a-zA-Z0-9]+', '_', 'g')"
written_graph("mermaid_out", "mermaid", _EDGE_SMALL + _report("select 0 as part, '' as k1, '' as k2, 0 as k3, 'flowchart LR' as line", f"""select 1, id, '', 0, '    ' || {_KEY.format('id')} || '["' || id || '"]' from g""", f"""select 1, id, '', 1, '    click ' || {_KEY.format('id')} || ' "https://pkg.go.dev/' || id || '" _blank' from g""", f"select 2, src, dst, 0, '    ' || {_KEY.format('src')} || ' --> ' || {_KEY.format('dst')} from e"), nocolor=True)
_HEAD = ["digraph G {", '    node [fontsize=10 shape=rectangle target="_graphviz"];', "    edge [tailport=e];", "    compound=true;", "    rankdir=LR;", "    newrank=true;", '    ranksep="1.5";', '    quantum="0.5";']
written_graph("dot_out", "dot", _EDGE_SMALL + _report(*[f"select 0 as part, '' as k1, '' as k2, {i} as k3, '{x}' as line" for i, x in enumerate(_HEAD)], """select 1, id, '', 0, '    "' || id || '" [label="' || id || '" href="https://pkg.go.dev/' || id || '" ];' from g""", """select 2, src, dst, 0, '    "' || src || '" -> "' || dst || '" [];' from e""", "select 3, '', '', 0, '}'"), template="{{.ID}}", nocolor=True)
#: Every package, the standard library included: cut, tree and the writers on all of it (brute force in tests/test_whole_graph.py; SQL for the plain writers).
WHOLE = "..."


def written_whole(name: str, kind: str, **options) -> None:
    def run(spark, sf_dir):
        return engine(spark, sf_dir).graph(WHOLE, type=kind, std=True, **options)

    query(name)(run)


written_whole("dot_color_out", "dot", colors={"red": "cust/...", "blue": "cust/1"})
written_whole("dot_cluster_out", "dot", cluster=True)
written_whole("graphml_out", "graphml")
written_whole("edges_out_whole", "edges")
written_whole("digraph_out_whole", "digraph")
written_whole("tgf_out_whole", "tgf")
written_whole("mermaid_out_whole", "mermaid", nocolor=True)
written_whole("dot_out_whole", "dot", template="{{.ID}}", nocolor=True)


for _name in ("edges_out", "digraph_out", "tgf_out", "mermaid_out", "dot_out"):
    ORACLES[f"{_name}_whole"] = ORACLES[_name].replace(",\n".join(_SMALL), f"g as ({LIVE})")


@query("graph_cut_whole")
def graph_cut_whole(spark, sf_dir):
    return engine(spark, sf_dir).cut(WHOLE, std=True).select("id", "in_degree", "out_degree", *["cut_" + c for c in STATS])


@query("tree_lines_whole")
def tree_lines_whole(spark, sf_dir):
    return engine(spark, sf_dir).tree(WHOLE, std=True).select("line", "depth", "id", "parent_id", "ref")


@query("graph_color", BASE + "select id, ('0x' || substr(sha256(id), 1, 4))::bigint as hue from packages where id not like '%.test'")
def graph_color(spark, sf_dir):
    return engine(spark, sf_dir).calc("...").packages().select("id", S.hue_number(F.col("id")).alias("hue"))


@query("module_tree", recursive(_G) + "select p.id, coalesce(module_path, p.id) as repo_root, module_path, module_path is not null as single_module, count(*) over (partition by module_path, coalesce(module_path, p.id)) = 1 as only_child from packages p where p.id in (select id from g)")
def module_tree(spark, sf_dir):
    return graph(spark, sf_dir).module_tree().select("id", "repo_root", "module_path", "single_module", "only_child")


@query("list_format", BASE + "select id, id || ' ' || go_lines || ' ' || round(go_lines::double / 7)::bigint || ' ' || case when name = 'main' then 'm' else '-' end as line from packages where (id like 'cust/%' or id like 'order/%') and id not like '%.test'")
def list_format(spark, sf_dir):
    nodes = engine(spark, sf_dir).calc("cust/... order/...").packages().withColumn("is_main", F.col("name") == "main")
    field = lambda p: {"ID": F.col("id"), "Lines": F.col("go_lines"), "Main": F.col("is_main")}[p]
    return nodes.select("id", compile_template("{{.ID}} {{.Lines}} {{div .Lines 7 | round}} {{if .Main}}m{{else}}-{{end}}", field, nodes).alias("line"))


@query("file_line_stats", r"""select doc_id, case when contains(t, chr(0)) then 0 else 1 end::bigint as files, case when contains(t, chr(0)) then 1 else 0 end::bigint as binary_files, strlen(t)::bigint as size,
 case when contains(t, chr(0)) then 0 else len(list_filter(p, lambda x: regexp_matches(x, '[^\r \t]'))) end::bigint as lines,
 case when contains(t, chr(0)) then 0 else len(p) - len(list_filter(p, lambda x: regexp_matches(x, '[^\r \t]'))) - case when regexp_matches(p[-1], '[^\r \t]') then 0 else 1 end end::bigint as blank
from (select doc_id, coalesce(text, '') as t, string_split(coalesce(text, ''), chr(10)) as p from documents) d""")
def file_line_stats(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    s = docs.select("doc_id", S.line_stats(F.coalesce("text", F.lit(""))).alias("s"))
    return s.select("doc_id", "s.files", F.col("s.binary").alias("binary_files"), "s.size", "s.lines", "s.blank")


def _size_sql(digits: int, suffix: str) -> str:
    cases = " ".join(f"when abs(v) >= {(1 << p) * 2 // 3} then printf('%.{digits}f{u}{suffix}', abs(v)::double / {float(1 << p)})" for p, u in S.UNITS if p < 50)
    return f"select v, case when v < 0 then '-' else '' end || case {cases} else abs(v) || 'B' end as shown from (select distinct (o_totalprice * (o_orderkey % 5000) - 100000)::bigint as v from orders)"


def _sizes(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.round(F.col("o_totalprice") * (F.col("o_orderkey") % 5000) - 100000).cast("bigint").alias("v")).distinct()


@query("mem_string", _size_sql(1, "B").replace("(o_totalprice * (o_orderkey % 5000) - 100000)::bigint", "round(o_totalprice * (o_orderkey % 5000) - 100000)::bigint"))
def mem_string(spark, sf_dir):
    return _sizes(spark, sf_dir).select("v", S.mem_string(F.col("v")).alias("shown"))


@query("mem_string_short", _size_sql(2, "").replace("(o_totalprice * (o_orderkey % 5000) - 100000)::bigint", "round(o_totalprice * (o_orderkey % 5000) - 100000)::bigint"))
def mem_string_short(spark, sf_dir):
    return _sizes(spark, sf_dir).select("v", S.mem_string_short(F.col("v")).alias("shown"))


@query("rel_rename", BASE + "select id, case when id = 'cust' then './' when id like 'cust/%' then './' || substr(id, 6) else id end as rel, case when id like 'order/%' then 'o/' || substr(id, 7) when id like 'nation/%' then substr(id, 8) else id end as renamed from packages where id not like '%.test'")
def rel_rename(spark, sf_dir):
    ids = engine(spark, sf_dir).calc("...").ids()
    return ids.select("id", S.rel("cust", F.col("id")).alias("rel"), S.rename(F.col("id"), "order", "o", "nation", "").alias("renamed"))


@query("num_funcs", "select o_orderkey, (o_orderkey % 7 + 2.5)::double as added, case when o_orderkey % 7 = 0 then 'inf' else 'finite' end as divided, round((o_orderkey % 7)::double / 2)::double as rounded, case when o_orderkey % 7 = 0 then '-inf' else 'finite' end as logged, trunc(o_totalprice)::bigint as whole from orders")
def num_funcs(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey") % 7
    kind = lambda c: F.when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").when(F.isnan(c), "nan").otherwise("finite")
    return o.select("o_orderkey", S.add(k, F.lit(2.5)).alias("added"), kind(S.div(F.lit(1), k)).alias("divided"), S.round_half_away(S.div(k, F.lit(2))).alias("rounded"), kind(S.log(k)).alias("logged"), S.to_int(F.col("o_totalprice")).alias("whole"))


#: The listing's fields in DuckDB: every derived line has an address.  Path and name part at the first dot
#: behind the last slash before any parenthesis; without one at that slash.
_SYM = """field as (select binary_name as "binary", line_no, string_split(line, ' ') as f from nm_lines),
head as (select *, f[4] as q, case when strpos(f[4], '(') > 0 then substr(f[4], 1, strpos(f[4], '(') - 1) else f[4] end as b from field),
slashed as (select *, greatest(length(b) - length(list_last(string_split(b, '/'))) - 1, 0) as slash from head),
sym as (select *, slash + greatest(strpos(substr(b, slash + 1), '.') - 1, 0) as p from slashed),
symbols as (select * from (select "binary", line_no, ('0x' || f[1])::bigint as addr, f[2]::bigint as size, f[3] as code, q as qualified_name, array_to_string(f[5:], ' ') as info,
 case when p > 0 then string_split(substr(q, 1, p), '/') else []::varchar[] end as path, case when p > 0 then substr(q, p + 2) else q end as name from sym) t where not starts_with(coalesce(path[1], ''), 'go.itab.') and not starts_with(coalesce(path[1], ''), 'type..'))"""
_NM = recursive(_SYM, tables_=("nm_lines",))
_PREFIX = "pre as (select \"binary\", unnest(list_concat([''], list_transform(range(1, len(path) + 1), lambda i: '/' || array_to_string(path[1:i], '/')))) as p, '/' || array_to_string(path, '/') as own, size from symbols where code in ('T', 't', 'D', 'd', 'R', 'r'))"
_ROLL = "roll as (select \"binary\", p as path, sum(size)::bigint as total_size, sum(case when p = own then size else 0 end)::bigint as size, count(case when p = own then 1 end)::bigint as symbols from pre group by \"binary\", p)"


def symbols(spark, sf_dir) -> DataFrame:
    return weight.parse_symbols(symbol_lines(spark, sf_dir))


@query("nm_parse", _NM + "select \"binary\", line_no, addr, size, code, qualified_name, info, array_to_string(path, '|') as path, name from symbols")
def nm_parse(spark, sf_dir):
    return symbols(spark, sf_dir).select("binary", "line_no", F.col("addr").cast("bigint").alias("addr"), "size", "code", "qualified_name", "info", F.array_join("path", "|").alias("path"), "name")


@query("nm_filter", _NM + "select \"binary\", code, count(*)::bigint as n, sum(size)::bigint as size from symbols where code in ('T', 't', 'D', 'd', 'R', 'r') group by all")
def nm_filter(spark, sf_dir):
    return weight.sized(symbols(spark, sf_dir)).groupBy("binary", "code").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


@query("weight_rollup", recursive(_SYM, _PREFIX, _ROLL, tables_=("nm_lines",)) + "select \"binary\", path, total_size from roll")
def weight_rollup(spark, sf_dir):
    return weight.rollup(weight.sized(symbols(spark, sf_dir))).select("binary", "path", "total_size")


@query("weight_own", recursive(_SYM, _PREFIX, _ROLL, tables_=("nm_lines",)) + "select \"binary\", path, size, symbols from roll where symbols > 0")
def weight_own(spark, sf_dir):
    return weight.rollup(weight.sized(symbols(spark, sf_dir))).where("symbols > 0").select("binary", "path", "size", "symbols")


@query("weight_topk", recursive(_SYM, _PREFIX, _ROLL, tables_=("nm_lines",)) + "select \"binary\", path, total_size, size, symbols from roll where total_size >= 1024 qualify row_number() over (partition by \"binary\" order by size desc, total_size desc, path) <= 20")
def weight_topk(spark, sf_dir):
    return Engine.weight(symbols(spark, sf_dir), limit=20)


_DIFF = recursive(_SYM, "one as (select \"binary\", qualified_name, size from symbols where code in ('T', 't', 'D', 'd', 'R', 'r') qualify row_number() over (partition by \"binary\", qualified_name order by line_no desc, size desc) = 1)", "w as (select qualified_name, max(case when \"binary\" = 'v1' then size end) as size_0, max(case when \"binary\" = 'v2' then size end) as size_1, max(case when \"binary\" = 'v3' then size end) as size_2 from one group by 1)", "d as (select *, coalesce(size_0, 0) as delta_0, coalesce(size_1, 0) - coalesce(size_0, 0) as delta_1, coalesce(size_2, 0) - coalesce(size_1, 0) as delta_2, coalesce(size_2, 0) - coalesce(size_0, 0) as total_delta from w)", "f as (select *, greatest(case when size_1 is null then 0 else abs(delta_1) end, case when size_2 is null then 0 else abs(delta_2) end)::bigint as max_abs_delta from d where abs(total_delta) >= 1024)", tables_=("nm_lines",))


@query("weight_diff", _DIFF + "select qualified_name, size_0, size_1, size_2, delta_0, delta_1, delta_2, total_delta, max_abs_delta from f")
def weight_diff(spark, sf_dir):
    return Engine.weight_diff(symbols(spark, sf_dir), ["v1", "v2", "v3"])


@query("weight_diff_cum", _DIFF + "select qualified_name, total_delta, (sum(total_delta) over (order by abs(total_delta) desc, qualified_name rows unbounded preceding))::bigint as cumulative, case when total_delta = 0 then '~' when total_delta > 0 then '+' || total_delta else total_delta::varchar end as shown from f")
def weight_diff_cum(spark, sf_dir):
    return Engine.weight_diff(symbols(spark, sf_dir), ["v1", "v2", "v3"], cumulative=True).select("qualified_name", "total_delta", "cumulative", weight.delta_text(F.col("total_delta")).alias("shown"))


@query("symbol_package", recursive(tables_=("nm_lines",)) + "select q as symbol, regexp_extract(q, '^((?:.*/)?[^/.]*)\\.[^/]*$', 1) as package, count(*)::bigint as n from (select string_split(line, ' ')[4] as q from nm_lines) t where not starts_with(q, 'go.itab.') group by all")
def symbol_package(spark, sf_dir):
    return symbols(spark, sf_dir).groupBy(F.col("qualified_name").alias("symbol"), package_of_symbol(F.col("qualified_name")).alias("package")).agg(F.count("*").alias("n"))


@query("deadcode_pkgs", recursive("marked as (select src_id as id from imports_base where dst_id = 'region/2' and src_id not like '%.test')", backward("b", "select id from marked", "(select * from imports_base where src_id not like '%.test' and dst_id not like '%.test')")) + "select id from b where id not like '%.test'")
def deadcode_pkgs(spark, sf_dir):
    return engine(spark, sf_dir).calc("deadcode(...)").ids()


@query("deadcode_edges", recursive(tables_=("imports_base",)) + "select count(*)::bigint as n, count(distinct src_id)::bigint as sources from (select distinct src_id, dst_id from imports_base where src_id not like '%.test' and dst_id not like '%.test')")
def deadcode_edges(spark, sf_dir):
    _, edges = deadcode.parse_dump(catalog(spark, sf_dir).dump)
    return edges.agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@query("sel_module_whole", recursive(closure("a", CUSTS)) + f"{CUSTS} union select a.id from a join packages p on p.id = a.id where p.module_path in (select module_path from packages where id in ({CUSTS}))")
def sel_module_whole(spark, sf_dir):
    return engine(spark, sf_dir).calc("cust/...:mod").ids()


_STEPS = """with steps as (select o_orderkey, case when link then 'link' else 'compile' end as command, case when link then '' else 'order/' || o_orderkey end as package, 'out/' || o_orderkey || case when link then '' else '.a' end as output,
 case when link then o_orderkey || '.a' when o_orderstatus = 'F' then o_orderkey || '.go,' || o_orderkey || '.s' else o_orderkey || '.go' end as inputs, case when not link and o_orderstatus = 'F' then 2 else 1 end as n, o_orderkey % 10 = 3 as failed, o_orderkey % 60 as seconds
from (select *, o_orderpriority = '1-URGENT' as link from orders) o)
"""


def build_log(spark, sf_dir) -> DataFrame:
    """Each order is compiled (closed ones with an assembler file beside), or linked if it has priority."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey").cast("string")
    text = lambda *parts: F.array(*[F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p]) if isinstance(p, tuple) else F.lit(p) for p in parts])
    build = text("/go/pkg/tool/compile.exe", "-o", ("out/", key, ".a"), "-p", ("order/", key), "-I", "x.go", "-complete", (key, ".go"))
    build = F.concat(build, F.when(F.col("o_orderstatus") == "F", text((key, ".s"), "readme.md")).otherwise(text("readme.md")))
    link = text("/go/pkg/tool/link", "-o", ("out/", key), "-D", "y.o", (key, ".a"))
    start = F.lit("2020-01-01 00:00:00").cast("timestamp")
    return o.select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", link).otherwise(build).alias("args"), (F.col("o_orderkey") * 1000).cast("bigint").alias("user_ns"), F.lit(0).cast("bigint").alias("system_ns"), start.alias("start"), (start + F.make_dt_interval(secs=F.col("o_orderkey") % 60)).alias("finish"), (F.col("o_orderkey") % 10 == 3).cast("int").alias("exit_status"))


@query("exec_inputs", _STEPS + "select command, package, output, inputs from steps")
def exec_inputs(spark, sf_dir):
    from .operators.execlog import records

    return records(build_log(spark, sf_dir)).select("command", "package", "output", F.array_join("inputs", ",").alias("inputs"))


@query("tree_text")
def tree_text(spark, sf_dir):
    return tables.tree_lines(engine(spark, sf_dir).tree(WHOLE, std=True))


#: The printed reports: aligned cells as one expression over a relation ``t`` of ordered rows.
def _aligned(rows: str, cells: list[str], header: list[str], order: str, padding: int = 3) -> str:
    names = [f"c{i}" for i in range(len(cells))]
    titles = ", ".join("'" + h + "'" for h in header)
    shown = " || ".join([f"rpad({n}, (select max(length({n})) from every)::int + {padding}, ' ')" for n in names[:-1]] + names[-1:])
    return f""", body as (select row_number() over (order by {order}) + 1 as line_no, {", ".join(f"{c} as {n}" for c, n in zip(cells, names))} from ({rows}) t),
every as (select 1 as line_no, {", ".join(f"{t} as {n}" for t, n in zip(titles.split(", "), names))} union all select * from body)
select line_no::bigint as line_no, {shown} as line from every"""


LIST_FORMAT = "{{.ID}}\t{{.Stat.Go.Lines}}\t{{.Down.PackageCount}}\t{{.Stat.Decls.Total}}"


@query("list_text", recursive(_G, _STATS, _PAIRS, "d as (select root as id, count(*) as n from r join s using (id) group by root)") + _aligned("select s.id, go_lines, coalesce(n, 0) as n, decl_func from s left join d using (id)", ["id", "go_lines::varchar", "n::varchar", "decl_func::varchar"], ["ID", "Stat.Go.Lines", "Down.PackageCount", "Stat.Decls.Total"], "id"))
def list_text(spark, sf_dir):
    return engine(spark, sf_dir).list_text(GRAPH, std=True, fmt=LIST_FORMAT)


@query("cut_text", ORACLES["graph_cut"].replace("select start as id,", ", cuts as (select start as id,", 1) + ")" + _aligned("select * from cuts", ["id", "in_degree::varchar", "cut_package_count::varchar", "cut_go_lines::varchar"], ["ID", "InDegree", "Cut.PackageCount", "Cut.Go.Lines"], "in_degree, cut_package_count desc, id"))
def cut_text(spark, sf_dir):
    return engine(spark, sf_dir).cut_text(SMALL, exclude="cust/2", fmt="{{.ID}}\t{{.InDegree}}\t{{.Cut.PackageCount}}\t{{.Cut.Go.Lines}}")


@query("weight_text", recursive(_SYM, _PREFIX, _ROLL, tables_=("nm_lines",)) + """, shown as (select * from roll where total_size >= 1024),
below as (select "binary", case when len(path) > 0 then '/' || array_to_string(path, '/') else '' end as path, name, code, size, line_no from symbols where code in ('T', 't', 'D', 'd', 'R', 'r') and size >= 1024),
every as (select "binary", path, size as node_size, total_size, 0 as place, lpad(total_size::varchar, greatest(10, length(total_size::varchar))::int, ' ') || ' ' || lpad(size::varchar, greatest(10, length(size::varchar))::int, ' ') || ' ' || path || ' [syms ' || symbols || ']' as line from shown
 union all select "binary", path, s.size, s.total_size, row_number() over (partition by "binary", path order by b.size desc, name, code, line_no), repeat(' ', 11) || lpad(b.size::varchar, greatest(10, length(b.size::varchar))::int, ' ') || ' ' || code || ' ' || name from below b join shown s using ("binary", path))
select "binary", row_number() over (order by "binary", node_size desc, total_size desc, path, place)::bigint as line_no, line from every""")
def weight_text(spark, sf_dir):
    return Engine.weight_text(symbols(spark, sf_dir))


def _right(c: str, n: int) -> str:
    return f"lpad({c}, greatest({n}, length({c}))::int, ' ')"


def _delta(c: str) -> str:
    return _right(f"(case when {c} = 0 then '~' when {c} > 0 then '+' || {c} else {c}::varchar end)", 8)


_RUNNING = "select *, sum(total_delta) over (order by abs(total_delta) desc, qualified_name rows unbounded preceding)::bigint as run from f"
_CELLS = ["qualified_name", _right("coalesce(size_0::varchar, '-')", 7), _right("coalesce(size_1::varchar, '-')", 7), _delta("delta_1"), _right("coalesce(size_2::varchar, '-')", 7), _delta("delta_2"), _delta("total_delta"), _delta("run")]


@query("weight_diff_text", _DIFF + _aligned(_RUNNING, _CELLS, ["name", "     v1", "     v2", "  delta", "     v3", "  delta", "total ∆", "cum. ∆"], "abs(total_delta) desc, qualified_name", 4))
def weight_diff_text(spark, sf_dir):
    return Engine.weight_diff_text(symbols(spark, sf_dir), ["v1", "v2", "v3"], minimum=1024, cumulative=True)


def _stat_sql(t: str) -> str:
    counts = {c: f"coalesce({t}.{c}, 0)" for c in STATS}
    group = lambda name, start, leaves: f'"{name}":{{' + ",".join(f'"{x}":' + (f"\' || {counts[start + x.lower()]} || \'" if start + x.lower() in counts else "0") for x in leaves) + "}"
    source = ("Files", "Binary", "Size", "Lines", "Blank")
    return "\'{\"PackageCount\":\' || " + counts["package_count"] + " || \'," + ",".join((group("Go", "go_", source), group("OtherFiles", "other_", source), group("Decls", "decl_", ("Func", "Type", "Const", "Var", "Other")), group("Tokens", "token_", ("Code", "Comment", "Basic")))) + "}\'"


_JSON = f"""select g.id, '{{"Package":{{"ID":"' || g.id || '","Name":"' || p.name || '"' || coalesce(',"Imports":{{' || i.every || '}}', '') || '}}' || coalesce(',"ImportsNodes":[' || n.inside || ']', '') || ',"Stat":' || {_stat_sql("s")} || ',"Up":' || {_stat_sql("u")} || ',"Down":' || {_stat_sql("d")} || '}}' as json
from g join packages p using (id) join s using (id) left join u using (id) left join d using (id)
left join (select src_id as id, string_agg('"' || dst_id || '":"' || dst_id || '"', ',' order by dst_id) as every from (select distinct src_id, dst_id from imports_base) x group by 1) i using (id)
left join (select src as id, string_agg('"' || dst || '"', ',' order by dst) as inside from e group by 1) n using (id)"""


@query("node_json", recursive(_G, _EDGES, _STATS, _PAIRS, f"d as (select root as id, {_SUMS} from r join s using (id) group by root)", f"u as (select r.id, {_SUMS} from r join s on s.id = r.root group by r.id)") + _JSON)
def node_json(spark, sf_dir):
    return engine(spark, sf_dir).json(GRAPH, std=True)


@query("exec_text", _STEPS + "select o_orderkey, command || ' ' || package || ' ' || output || ' ' || n || ' ' || case when failed then 'failed' else 'ok' end as line from steps")
def exec_text(spark, sf_dir):
    log = build_log(spark, sf_dir)
    return Engine.exec_text(log, "{{.Command}} {{.PackageName}} {{.Output}} {{len .Inputs}} {{if .ExitStatus}}failed{{else}}ok{{end}}").select("o_orderkey", "line")


@query("exec_commands", _STEPS + "select command, count(*)::bigint as steps, sum(o_orderkey * 1000)::bigint as user_ns, sum(n)::bigint as inputs, sum(seconds * 1000000000)::bigint as wall_ns, count(case when failed then 1 end)::bigint as failed from steps group by 1")
def exec_commands(spark, sf_dir):
    return Engine.exec_stats(build_log(spark, sf_dir)).select("command", "steps", "user_ns", "inputs", "wall_ns", "failed")


#: What a derived source file counts: by hand, 31 nodes of code and one literal without the return's sums.
_FILES = """counted as (select *, o_orderkey % 7 as n, o_orderpriority = '2-HIGH' as broken, (o_orderstatus = 'F')::int as led, (o_orderpriority = '1-URGENT')::int as urgent from go_files join (select o_orderkey, o_orderstatus, o_orderpriority from orders) using (o_orderkey)),
files as (select *, 'expected a type, found ''{''' as message, 12 + led as line, case when broken then 0 else 1 end as whole from counted)"""


@query("syntax_files", recursive(_FILES, tables_=("go_files",)) + "select path, 1::bigint as func, 1::bigint as type, 0::bigint as const, 0::bigint as var, 1::bigint as other, (31 + n + case when broken then 4 else 0 end)::bigint as code, (led + urgent)::bigint as comment, (1 + n)::bigint as basic, not broken as parsed, case when broken then line || ':14: ' || message end as error from files")
def syntax_files(spark, sf_dir):
    got = declarations(go_files(spark, sf_dir))
    first = F.get("errors", F.lit(0))
    return got.select("path", *COLUMNS, "parsed", F.concat(first["line"], F.lit(":"), first["column"], F.lit(": "), first["message"]).alias("error"))


_PACKAGES = """sums as (select id, sum(8 + led + broken::int)::bigint as go_lines, sum(3 * whole)::bigint as decls, sum((31 + n) * whole)::bigint as code, sum((led + urgent) * whole)::bigint as comment, sum((1 + n) * whole)::bigint as basic, count(*) as go_files, sum(strlen(text))::bigint as go_size, sum(3)::bigint as go_blank, sum(whole)::bigint as whole,
 list('failed to parse "' || path || '": ' || path || ':' || line || ':14: ' || message order by path) filter (where broken) as errors from files group by id)"""
SYNTAX_FORMAT = "{{.ID}}\t{{.Stat.Go.Lines}}\t{{.Stat.Decls.Total}}\t{{.Stat.Tokens.Code}}\t{{.Stat.Tokens.Comment}}\t{{.Stat.Tokens.Basic}}"
_NUMBERS = ["id", "go_lines::varchar", "decls::varchar", "code::varchar", "comment::varchar", "basic::varchar"]


@query("syntax_list", recursive(_FILES, _PACKAGES, tables_=("go_files",)) + _aligned("select * from sums", _NUMBERS, ["ID", "Stat.Go.Lines", "Stat.Decls.Total", "Stat.Tokens.Code", "Stat.Tokens.Comment", "Stat.Tokens.Basic"], "id"))
def syntax_list(spark, sf_dir):
    return Engine(source_catalog(spark, sf_dir)).list_text("...", fmt=SYNTAX_FORMAT)


def _source_sql(files: str, size: str, lines: str, blank: str) -> str:
    return f"""'{{"Files":' || {files} || ',"Binary":0,"Size":' || {size} || ',"Lines":' || {lines} || ',"Blank":' || {blank} || '}}'"""


_NOTHING = _source_sql("0", "0", "0", "0")
_NO_STAT = f"""'{{"PackageCount":0,"Go":' || {_NOTHING} || ',"OtherFiles":' || {_NOTHING} || ',"Decls":{{"Func":0,"Type":0,"Const":0,"Var":0,"Other":0}},"Tokens":{{"Code":0,"Comment":0,"Basic":0}}}}'"""


@query("syntax_json", recursive(_FILES, _PACKAGES, tables_=("go_files",)) + f"""select id, '{{"Package":{{"ID":"' || id || '","Name":"cust"}},"Stat":{{"PackageCount":1,"Go":' || {_source_sql("go_files", "go_size", "go_lines", "go_blank")} || ',"OtherFiles":' || {_NOTHING} || ',"Decls":{{"Func":' || whole || ',"Type":' || whole || ',"Const":0,"Var":0,"Other":' || whole || '}},"Tokens":{{"Code":' || code || ',"Comment":' || comment || ',"Basic":' || basic || '}}}},"Up":' || {_NO_STAT} || ',"Down":' || {_NO_STAT} || coalesce(',"Errors":[' || array_to_string(list_transform(errors, lambda e: '"' || replace(e, '"', chr(92) || '"') || '"'), ',') || ']', '') || '}}' as json from sums""")
def syntax_json(spark, sf_dir):
    return Engine(source_catalog(spark, sf_dir)).json("...")


_LOCAL = "placed as (select id, path, n_nationkey, module_path, version, replace_path, module_path is not null and n_nationkey % 4 in (1, 2) as is_local from module_packages left join modules on id = module_path or starts_with(id, module_path || '/'))"


@query("module_paths", recursive(_LOCAL, tables_=("module_packages",)) + r"""select id, module_path, is_local, module_path || coalesce('@' || version, '') || case when is_local then ' (local)' else '' end || coalesce(' =>\n' || replace_path, '') as module_label from placed""")
def module_paths(spark, sf_dir):
    return Engine(module_catalog(spark, sf_dir)).graph_of("...").module_tree().select("id", "module_path", "is_local", "module_label")


@query("pattern_here", recursive(_LOCAL, tables_=("module_packages",)) + "select id from placed where is_local and id = module_path")
def pattern_here(spark, sf_dir):
    """``.`` names the top packages of local modules, which follow from their files' paths."""
    return Engine(module_catalog(spark, sf_dir)).calc(".").ids()


#: Comparisons, logic, variables, else if, index, slice and print, over every order.
BUILTINS = """{{$k := .Key}}{{$kind := "small"}}{{if ge .Price 200000.0}}{{$kind = "large"}}{{else if and (gt .Price 100000.0) (ne .Status "F")}}{{$kind = "middle"}}{{end -}}
{{$kind}} {{if eq .Status "O" "P"}}open{{else}}closed{{end}} {{not .Text}}{{not .Zero}} {{or .Zero .Text}} {{and .Text .Rest}} {{index .Words 0}}:{{slice .Status 0 1}}:{{slice .Words 1 2}} {{print $k 7 .Status}} {{len .Words}}{{len .Text}}
{{- range $i, $w := .Words}} {{$i}}={{$w}}{{if eq $w "LOW"}}!{{else with $i}}+{{.}}{{end}}{{else}} none{{end}} {{printf "%03d|%q|%v|%t" .Rest .Status .Ratio (lt .Rest 3)}}{{range .Rest}}.{{end}}"""


@query("template_builtins", """select o_orderkey, case when o_totalprice >= 200000 then 'large' when o_totalprice > 100000 and o_orderstatus <> 'F' then 'middle' else 'small' end
 || ' ' || case when o_orderstatus in ('O', 'P') then 'open' else 'closed' end || ' falsetrue false ' || r || ' ' || w[1] || ':' || o_orderstatus || ':[' || coalesce(w[2], '') || '] ' || o_orderkey || ' 7' || o_orderstatus || ' ' || len(w) || '5'
 || ' 0=' || w[1] || case when w[1] = 'LOW' then '!' else '' end || coalesce(' 1=' || w[2] || case when w[2] = 'LOW' then '!' else '+1' end, '')
 || ' ' || lpad(r::varchar, 3, '0') || '|"' || o_orderstatus || '"|' || case r when 0 then '0' when 1 then '0.25' when 2 then '0.5' when 3 then '0.75' else '1' end || '|' || (r < 3) || repeat('.', r::int) as line
 from (select *, o_orderkey % 5 as r, [substr(o_orderpriority, 1, 1), substr(o_orderpriority, 3)] as w from orders) o""")
def template_builtins(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    priority = F.col("o_orderpriority")
    fields = {"Key": F.col("o_orderkey"), "Price": F.col("o_totalprice").cast("double"), "Status": F.col("o_orderstatus"), "Zero": F.lit(0), "Text": F.lit("false"), "Rest": F.col("o_orderkey") % 5, "Ratio": (F.col("o_orderkey") % 5) / 4, "Words": F.array(F.substring(priority, 1, 1), F.substr(priority, F.lit(3)))}
    return o.select("o_orderkey", compile_template(BUILTINS, fields.__getitem__, o).alias("line"))


#: What only tests held so far: loads without tests, the standard library, sizes of inputs, symbol kinds, aliases, the printed tree.
expression("sel_test_minus", "order/...:-test", BASE + ORDERS)
expression("pattern_std", "std + nation/1", BASE + "select id from packages where is_std or id = 'nation/1'")


@query("list_without_std", BASE + f"select id, id || ' ' || name as line from packages where id in ({LIVE}) and not is_std")
def list_without_std(spark, sf_dir):
    return engine(spark, sf_dir).list("...", fmt="{{.ID}} {{.Name}}").select("id", "line")


@query("exec_sizes", _STEPS + """, held as (select o_orderkey || '.go' as path, o_orderkey % 1000 as size from orders where o_orderkey % 2 = 0 union all select o_orderkey || '.s', 7 from orders union all select 'out/' || o_orderkey, o_orderkey from orders where o_orderkey % 3 = 0)
select o_orderkey, coalesce(i.size, 0)::bigint as input_size, coalesce(o.size, 0)::bigint as output_size from steps left join held o on o.path = output
left join (select o_orderkey, sum(size) as size from (select o_orderkey, unnest(string_split(inputs, ',')) as path from steps) u join held using (path) group by 1) i using (o_orderkey)""")
def exec_sizes(spark, sf_dir):
    from .operators.execlog import with_sizes

    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    key = F.col("o_orderkey").cast("string")
    kinds = o.where("o_orderkey % 2 = 0").select(F.concat(key, F.lit(".go")).alias("path"), (F.col("o_orderkey") % 1000).alias("size")), o.select(F.concat(key, F.lit(".s")).alias("path"), F.lit(7).cast("bigint").alias("size")), o.where("o_orderkey % 3 = 0").select(F.concat(F.lit("out/"), key).alias("path"), F.col("o_orderkey").alias("size"))
    files = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    return with_sizes(build_log(spark, sf_dir), files).select("o_orderkey", F.col("input_size").cast("bigint").alias("input_size"), F.col("output_size").cast("bigint").alias("output_size"))


_SYMBOL = "case p_partkey % 7 when 0 then 'type:*' || p_brand || '/x.T' when 1 then 'go:itab.' || p_brand when 2 then p_brand || '..stmp_' || p_size when 3 then 'a/b.' || p_brand || '.arginfo1' when 4 then 'type:**a.b/' || p_brand || '.T' when 5 then ' a.b/' || p_brand else 'x/' || p_brand || '.F.g' end"


@query("symbol_kinds", f"""select p_partkey, s as symbol, case p_partkey % 7 when 0 then p_brand || '/x' when 4 then 'a.b/' || p_brand when 2 then p_brand when 3 then 'a/b' when 6 then 'x/' || p_brand when 1 then 'go:itab' else '' end as package, p_partkey % 7 in (1, 2, 3) as linker_data from (select p_partkey, p_brand, {_SYMBOL} as s from part) p""")
def symbol_kinds(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey", f"{_SYMBOL} as symbol")
    return rows.select("p_partkey", "symbol", package_of_type(F.col("symbol")).alias("package"), is_linker_data(F.col("symbol")).alias("linker_data"))


@query("weight_diff_alias", _DIFF.replace("max(case when \"binary\" = 'v2' then size end) as size_1, max(case when \"binary\" = 'v3' then size end) as size_2", "max(case when \"binary\" = 'v3' then size end) as size_1").replace(", coalesce(size_2, 0) - coalesce(size_1, 0) as delta_2, coalesce(size_2, 0) - coalesce(size_0, 0) as total_delta", ", coalesce(size_1, 0) - coalesce(size_0, 0) as total_delta").replace("greatest(case when size_1 is null then 0 else abs(delta_1) end, case when size_2 is null then 0 else abs(delta_2) end)", "case when size_1 is null then 0 else abs(delta_1) end").replace("from symbols where code in ('T', 't', 'D', 'd', 'R', 'r') qualify", "from symbols where code in ('T', 't', 'D', 'd', 'R', 'r') and \"binary\" <> 'v2' qualify") + _aligned("select * from f", ["qualified_name", _right("coalesce(size_0::varchar, '-')", 7), _right("coalesce(size_1::varchar, '-')", 7), _delta("delta_1")], ["name", "    old", "    new", "  delta"], "abs(total_delta) desc, qualified_name", 4))
def weight_diff_alias(spark, sf_dir):
    pairs = [weight.parse_alias(a) for a in ("old=v1", "new=v3")]
    return Engine.weight_diff_text(symbols(spark, sf_dir), [path for _, path in pairs], [alias for alias, _ in pairs], minimum=1024)


@query("tree_print", ORACLES["tree_lines"].replace("select l.line::bigint as line, l.depth::bigint as depth, l.id, l.parent_id, case when l.line > f.line then f.line end::bigint as ref", ", told as (select l.line, l.depth, l.id, l.parent_id, case when l.line > f.line then f.line end as ref").replace("join lines f on f.path = b.path", "join lines f on f.path = b.path)") + " select line::bigint as line_no, rpad(line::varchar, 4, ' ') || repeat('  ', depth::int) || case when parent_id is not null and row_number() over (partition by parent_id order by id desc) = 1 then '  └ ' else '  ├ ' end || id || coalesce(' @' || ref, '') as line from told")
def tree_print(spark, sf_dir):
    return tables.tree_lines(engine(spark, sf_dir).tree(SMALL))


@query("closure_of_variants", recursive(closure("a", "select 'cust/1' as id"), closure("b", ORDERS, "alt"), tables_=("packages", "imports_base", "alt")) + "select id, 'base' as variant from a union all select id, 'alt' from b where id not in (select id from a)")
def closure_of_variants(spark, sf_dir):
    """What two variants reach: the one loaded first stays."""
    return engine(spark, sf_dir).calc("(cust/1 + alt=1(order/...)):all").members
