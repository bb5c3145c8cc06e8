"""Graph, symbol and dump tables derived from a TPC-H-like warehouse, in SQL that Spark and DuckDB share.

Packages are orders, customers, suppliers, nations and regions; imports are foreign keys and, per
customer, each order's two predecessors.  Nations are the modules, regions the standard library.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import materialise
from .catalog import Catalog

PK_ORDER = """select o_orderkey, o_custkey, o_orderdate, o_orderstatus, o_orderpriority, o_totalprice,
  'order/' || cast(o_orderkey as varchar(20)) || case when o_orderstatus = 'P' and o_orderpriority = '1-URGENT' then '.test' else '' end as id
from {orders}"""

IMPORTS = """select id as src_id, 'cust/' || cast(o_custkey as varchar(20)) as dst_id from {pk_order}
union all select 'cust/' || cast(c_custkey as varchar(20)), 'nation/' || cast(c_nationkey as varchar(20)) from {customer}
union all select 'supp/' || cast(s_suppkey as varchar(20)), 'nation/' || cast(s_nationkey as varchar(20)) from {supplier}
union all select 'nation/' || cast(n_nationkey as varchar(20)), 'region/' || cast(n_regionkey as varchar(20)) from {nation}
union all select src_id, dst_id from (
  select id as src_id, lag(id, 1) over (partition by o_custkey order by o_orderdate, o_orderkey) as dst_id from {pk_order}) t where dst_id is not null
union all select src_id, dst_id from (
  select id as src_id, lag(id, 2) over (partition by o_custkey order by o_orderdate, o_orderkey) as dst_id from {pk_order}) t where dst_id is not null"""

PACKAGES = """select id, case when o_orderpriority = '2-HIGH' then 'main' else 'order' end as name,
  'nation/' || cast(c_nationkey as varchar(20)) as module_path, false as is_std,
  cast(floor(o_totalprice) as bigint) as go_size, o_orderkey % 500 as go_lines, o_orderkey % 7 as go_blank, o_orderkey % 11 as decl_func
from {pk_order} join {customer} on o_custkey = c_custkey
union all select 'cust/' || cast(c_custkey as varchar(20)), 'cust', 'nation/' || cast(c_nationkey as varchar(20)), false, 1000 + c_custkey % 977, c_custkey % 300, c_custkey % 5, c_custkey % 13 from {customer}
union all select 'supp/' || cast(s_suppkey as varchar(20)), 'supp', 'nation/' || cast(s_nationkey as varchar(20)), false, 2000 + s_suppkey % 499, s_suppkey % 200, s_suppkey % 3, s_suppkey % 17 from {supplier}
union all select 'nation/' || cast(n_nationkey as varchar(20)), 'nation', 'nation/' || cast(n_nationkey as varchar(20)), false, cast(4096 as bigint), cast(100 as bigint), cast(10 as bigint), cast(n_nationkey as bigint) from {nation}
union all select 'region/' || cast(r_regionkey as varchar(20)), 'region', cast(null as varchar(20)), true, cast(8192 as bigint), cast(200 as bigint), cast(20 as bigint), cast(r_regionkey as bigint) from {region}"""

NM_LINES = """select case l_returnflag when 'A' then 'v1' when 'N' then 'v2' else 'v3' end as binary_name,
  l_orderkey * 10 + l_linenumber as line_no,
  lower(hex(l_orderkey)) || ' ' || cast(cast(l_quantity as bigint) * 64 as varchar(20)) || ' ' ||
  case when l_linestatus = 'O' then 'T' when l_linenumber % 2 = 0 then 'D' else 'B' end || case l_linenumber
    when 4 then ' go:info.acme.test/' || p_brand
    when 5 then ' base.' || p_brand || '.once'
    when 6 then ' acme.test/' || p_brand || '.(*T).f(x/y.z)'
    when 7 then ' go.itab.*' || p_brand || '/x.T'
    else ' acme.test/' || p_brand || '/' || p_type || '.' || replace(p_name, ' ', '_') end as line
from {lineitem} join {part} on l_partkey = p_partkey"""

DUMP = """select src_id || '.F' || case when dst_id = 'region/2' then ' <ReflectMethod>' else '' end || ' -> ' || dst_id || '.F' as line
from {imports_base} where src_id not like '%.test' and dst_id not like '%.test'"""

#: A source file per order, in its customer's package; those of priority 2-HIGH end in an error.
GO_FILES = """select o_orderkey, 'cust/' || cast(o_custkey as varchar(20)) as id, 'src/' || cast(o_custkey as varchar(20)) || '/' || cast(o_orderkey as varchar(20)) || '.go' as path,
  'package c' || cast(o_custkey as varchar(20)) || chr(10) || chr(10) || 'import "fmt"' || chr(10) || chr(10)
  || case when o_orderstatus = 'F' then '// closed' || chr(10) else '' end
  || 'type T' || cast(o_orderkey as varchar(20)) || ' struct {{' || chr(10) || chr(9) || 'a, b int' || case when o_orderpriority = '1-URGENT' then ' // urgent' else '' end || chr(10) || '}}' || chr(10) || chr(10)
  || 'func (t *T' || cast(o_orderkey as varchar(20)) || ') f(x int) int {{' || chr(10) || chr(9) || 'return x' || repeat(' + 1', cast(o_orderkey % 7 as int)) || chr(10) || '}}' || chr(10)
  || case when o_orderpriority = '2-HIGH' then 'func broken( {{' || chr(10) else '' end as text
from {orders}"""

#: A module per nation: in the cache, in a folder of its own, inside the one before, or replaced; customers are its packages.
MODULES = """select n_nationkey, 'example.test/Nation' || cast(n_nationkey as varchar(20)) as module_path, case when n_nationkey % 4 = 0 then 'v1.' || cast(n_nationkey as varchar(20)) || '.0-RC' end as version,
  case n_nationkey % 4 when 0 then '/go/pkg/mod/example.test/!nation' || cast(n_nationkey as varchar(20)) || '@v1.' || cast(n_nationkey as varchar(20)) || '.0-!r!c'
    when 2 then '/work/nation' || cast(n_nationkey - 1 as varchar(20)) || '/inner' else '/work/nation' || cast(n_nationkey as varchar(20)) end as dir,
  case when n_nationkey % 4 = 3 then '../fork' end as replace_path, cast(null as varchar(20)) as replace_version
from {nation}"""

MODULE_PACKAGES = """select module_path as id, dir || '/a.go' as path from {modules}
union all select module_path || '/c' || cast(c_custkey as varchar(20)), dir || '/c' || cast(c_custkey as varchar(20)) || '/b.go' from {modules} join {customer} on c_nationkey = n_nationkey
union all select 'plain/' || cast(s_suppkey as varchar(20)), case when s_suppkey % 2 = 0 then '/elsewhere/s.go' end from {supplier}"""

#: The second variant lacks the customer edges of finished orders.
ALT = """select i.src_id, i.dst_id from {imports_base} i left join (select id from {pk_order} where o_orderstatus = 'F') f on f.id = i.src_id
where f.id is null or i.dst_id not like 'cust/%'"""


def _read(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


_MANIFESTS: dict[tuple, Catalog] = {}
_TABLES = ("orders", "customer", "supplier", "nation", "region")


def stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the files of a warehouse's tables: what is derived from them holds as long as these do."""
    out, jvm = [], spark.sparkContext._jvm
    for name in _TABLES:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path):
            out.append((f.getPath().getName(), f.getLen(), f.getModificationTime()))
    return tuple(out)


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The manifest of a warehouse: derived once per application and state of the folder, then read as plain tables."""
    key = spark.sparkContext.applicationId, sf_dir, stamp(spark, sf_dir)
    if key not in _MANIFESTS:
        _MANIFESTS[key] = _derive(spark, sf_dir)
    return _MANIFESTS[key]


def imports(t: dict[str, DataFrame]) -> DataFrame:
    """src_id, dst_id, alt (whether the second variant has it too): the rows of ``IMPORTS`` and ``ALT`` from one window over the orders, whose keys are unique."""
    pk = t["orders"].sparkSession.sql(PK_ORDER, orders=t["orders"])
    own = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    cust = F.concat(F.lit("cust/"), F.col("o_custkey").cast("string"))
    pk = pk.select("id", (F.col("o_orderstatus") == "F").alias("closed"), F.array(cust, F.lag("id", 1).over(own), F.lag("id", 2).over(own)).alias("found"))
    of_orders = pk.select(F.col("id").alias("src_id"), "closed", F.posexplode("found").alias("place", "dst_id")).where("place = 0 or dst_id is not null")
    of_orders = of_orders.select("src_id", "dst_id", (~F.coalesce("closed", F.lit(False)) | (F.col("place") > 0)).alias("alt"))
    keys = lambda name, a, b, to: t[name].select(F.concat(F.lit(name[:4] + "/" if name in ("customer", "supplier") else "nation/"), F.col(a).cast("string")).alias("src_id"), F.concat(F.lit(to), F.col(b).cast("string")).alias("dst_id"), F.lit(True).alias("alt"))
    others = [keys("customer", "c_custkey", "c_nationkey", "nation/"), keys("supplier", "s_suppkey", "s_nationkey", "nation/"), keys("nation", "n_nationkey", "n_regionkey", "region/")]
    return reduce(DataFrame.unionByName, others, of_orders)


def _derive(spark: SparkSession, sf_dir: str) -> Catalog:
    t = _read(spark, sf_dir, *_TABLES)
    pk = spark.sql(PK_ORDER, orders=t["orders"])
    # both variants are views of what is written once
    base = materialise(imports(t), "imports")
    named = lambda rows, variant: rows.withColumn("variant", F.lit(variant))
    edges = base.select("src_id", "dst_id")
    rows = named(edges, "base").unionByName(named(base.where("alt").select("src_id", "dst_id"), "alt"))
    packages = spark.sql(PACKAGES, pk_order=pk, **{n: t[n] for n in ("customer", "supplier", "nation", "region")})
    packages = materialise(packages.withColumn("package_count", F.lit(1).cast("bigint")), "packages")
    dump = spark.sql(DUMP, imports_base=edges)
    return Catalog.of(named(packages, "base").unionByName(named(packages, "alt")), rows.withColumn("import_path", F.col("dst_id")), dump, {"tag=alt": "alt"})


def go_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, id, path, text."""
    return spark.sql(GO_FILES, **_read(spark, sf_dir, "orders"))


def source_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """Customers' packages with the statistics of their source files; they import nothing."""
    from .package_stats import package_stats

    files = go_files(spark, sf_dir)
    lists = files.groupBy("id").agg(F.collect_list("path").alias("go_files")).select(F.lit("base").alias("variant"), "id", "go_files", F.expr("cast(null as array<string>)").alias("other_files"))
    stats = package_stats(lists, files.select("path", F.encode("text", "UTF-8").alias("content")))
    packages = stats.withColumn("name", F.lit("cust")).withColumn("module_path", F.lit(None).cast("string")).withColumn("is_std", F.lit(False))
    none = spark.createDataFrame([], "variant string, src_id string, import_path string, dst_id string")
    return Catalog.of(materialise(packages, "packages"), none)


def module_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """Packages whose modules follow from where their files lie."""
    from .modules import locate

    t = _read(spark, sf_dir, "nation", "customer", "supplier")
    roots = spark.sql(MODULES, nation=t["nation"])
    packages = spark.sql(MODULE_PACKAGES, modules=roots, customer=t["customer"], supplier=t["supplier"])
    packages = packages.select("id", F.array_compact(F.array("path")).alias("go_files"))
    rows = packages.join(locate(packages, roots.where("n_nationkey % 4 <> 0"), "/go/pkg/mod"), "id")
    rows = rows.withColumn("variant", F.lit("base")).withColumn("name", F.lit("p")).withColumn("is_std", F.lit(False)).withColumn("package_count", F.lit(1).cast("bigint"))
    none = spark.createDataFrame([], "variant string, src_id string, import_path string, dst_id string")
    return Catalog.of(materialise(rows, "packages"), none)


def symbol_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _read(spark, sf_dir, "lineitem", "part")
    return spark.sql(NM_LINES, **t).withColumnRenamed("binary_name", "binary")


def ctes(*names: str) -> str:
    """``name as (...)`` definitions for DuckDB, with what they build on."""
    every = {"pk_order": PK_ORDER, "imports_base": IMPORTS, "packages": PACKAGES, "nm_lines": NM_LINES, "dumpdep": DUMP, "alt": ALT, "go_files": GO_FILES, "modules": MODULES, "module_packages": MODULE_PACKAGES}
    needs = {"imports_base": ["pk_order"], "packages": ["pk_order"], "dumpdep": ["imports_base"], "alt": ["imports_base", "pk_order"], "module_packages": ["modules"]}
    order: list[str] = []

    def add(n):
        for x in needs.get(n, []):
            add(x)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    tables = {x: x for x in ("orders", "customer", "supplier", "nation", "region", "lineitem", "part", *every)}
    return ",\n".join(f"{n} as ({every[n].format(**tables)})" for n in order)
