"""Work that grew beyond the tables: derived imports, colours, callers."""

import re

from pyspark.sql import functions as F

from deploom import queries as Q
from deploom.functions.scalars import path_color
from deploom.operators import fixpoint
from deploom.sources import warehouse as W

AT = "/root/testdata/sf0.001"


def test_imports_are_those_of_the_sql(spark):
    t = W._read(spark, AT, *W._TABLES)
    pk = spark.sql(W.PK_ORDER, orders=t["orders"])
    base = spark.sql(W.IMPORTS, pk_order=pk, customer=t["customer"], supplier=t["supplier"], nation=t["nation"])
    alt = spark.sql(W.ALT, imports_base=base, pk_order=pk)
    got = W.imports(t)
    rows = lambda df: sorted(map(tuple, df.select("src_id", "dst_id").collect()))
    assert rows(got) == rows(base) and rows(got.where("alt")) == rows(alt)


def test_windows_over_orders_run_once(spark):
    plan = W.imports(W._read(spark, AT, *W._TABLES))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?m)^[ :+\-*()0-9]*Window \[", plan)) == 1


def test_a_path_is_hashed_once_for_its_colour(spark):
    plan = spark.range(1).select(path_color(F.col("id").cast("string"), 0.9, 0.3, 0.7).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1


def test_shallow_callers_join_no_edges_with_themselves(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("edges joined with themselves")

    monkeypatch.setattr(fixpoint, "shortcuts", refused)
    assert Q.QUERIES["deadcode_pkgs"](spark, AT).count() > 0


def test_deep_callers(spark):
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(20)], "target string, source string")
    assert fixpoint.reverse_reach(spark.createDataFrame([("n0",)], "node string"), edges).count() == 21
