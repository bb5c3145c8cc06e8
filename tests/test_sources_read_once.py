"""Reading source files: tasks, how often texts are read, and what files of one shape share."""

import re

from pyspark.sql import functions as F

from deploom.functions import syntax
from deploom.functions.declarations import declarations, read_source
from deploom.functions.scalars import line_stats
from deploom.sources.package_stats import package_stats


def test_a_single_split_is_read_by_several_tasks(spark):
    files = spark.range(200).select(F.concat(F.lit("f"), "id").alias("path"), F.lit("package p\n").alias("text")).coalesce(1)
    assert declarations(files).select(F.spark_partition_id()).distinct().count() > 1


def test_texts_are_shuffled_and_read_once(spark):
    packages = spark.createDataFrame([("base", "p", ["a.go"], [])], "variant string, id string, go_files array<string>, other_files array<string>")
    files = spark.createDataFrame([("a.go", b"package p\n")], "path string, content binary")
    plan = package_stats(packages, files)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"MapInArrow ", plan)) == 1 and len(re.findall(r"Join \[path#", plan)) == 1


def test_lines_are_split_once(spark):
    plan = spark.range(1).select(line_stats(F.col("id").cast("string")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("filter(") == 1


def test_files_of_one_shape_are_walked_once(monkeypatch):
    monkeypatch.setattr(syntax, "_shapes", syntax._Shapes())
    a, b = (read_source(f"package {n}\n\n// {n}\nvar {n} = f({v}) // é\n\nfunc ({n} {{\n") for n, v in (("p", "1"), ("longer", '"x"')))
    assert len(syntax._shapes) == 1 and (a.decls, a.nodes) == (b.decls, b.nodes) and a.decls["var"] == 1
    assert a.errors[0][:2] == (6, 9) and b.errors[0][:2] == (6, 14) and a.errors[0][2] == b.errors[0][2]


def test_shapes_differ_by_lines_and_comments():
    """Where a line, a comment or a blank before a declaration's word stands changes what is counted."""
    recovered = [read_source("package p\nvar = 1\n" + blank + "var x int\n").decls["var"] for blank in ("", " ")]
    assert recovered == [1, 0]
    led = [read_source("package p\n// a\n" + gap + "var x int\n").nodes["comment"] for gap in ("", "\n")]
    assert led == [1, 0]


def test_what_a_worker_keeps_is_bounded(monkeypatch):
    monkeypatch.setattr(syntax, "_KEPT", 100)
    monkeypatch.setattr(syntax, "_SORTS", len(syntax._FIXED) + 50)
    shapes, sorts = syntax._Shapes(), syntax._Sorts(syntax._FIXED)
    monkeypatch.setattr(syntax, "_shapes", shapes)
    monkeypatch.setattr(syntax, "_sorts", sorts)
    for n in range(40):
        assert read_source("package p\nvar x = 1" + f" + y{n}" * n + "\n").nodes["code"] == 5 + 2 * n
        assert sum(map(len, shapes)) <= 100 and len(sorts) <= len(syntax._FIXED) + 50


def test_files_that_end_too_early():
    for text in ("func f(", "func f(a,", "type T[K any,", "func f[T any,"):
        got = read_source("package p\n" + text)
        assert got.errors and got.errors[0][0] == 2, text
