"""Linker dependency dumps: parsing, and packages that keep dead code alive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.symbols import is_linker_data, package_of_symbol, package_of_type
from .fixpoint import reverse_reach

MARK = " <ReflectMethod>"


def parse_dump(dump: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines ``source -> target`` to (seeds: node, edges: target, source)."""
    cut = F.instr("line", " -> ")
    sides = dump.where(cut > 0).select(F.trim(F.expr("substring(line, 1, instr(line, ' -> ') - 1)")).alias("source"), F.trim(F.expr("substring(line, instr(line, ' -> ') + 4)")).alias("target"))

    def plain(c):
        return F.trim(F.regexp_replace(c, " <.*$", ""))

    sides = sides.select(F.contains("source", F.lit(MARK)).alias("source_marked"), F.contains("target", F.lit(MARK)).alias("target_marked"), plain(F.col("source")).alias("source"), plain(F.col("target")).alias("target"))
    seeds = sides.where("source_marked").select(F.col("source").alias("node")).unionByName(sides.where("target_marked").select(F.col("target").alias("node")))
    s, t = F.col("source"), F.col("target")
    own_type, far_type = s.startswith("type:"), t.startswith("type:")
    kept = sides.where(~is_linker_data(s) & ~is_linker_data(t) & ~(own_type & far_type) & (~far_type | own_type | (package_of_type(t) == package_of_symbol(s))))
    return seeds, kept.select("target", "source").distinct()


def blocked_packages(dump: DataFrame) -> DataFrame:
    """package: those with a symbol that reaches a marked one."""
    seeds, edges = parse_dump(dump)
    return reverse_reach(seeds, edges).select(package_of_symbol(F.col("node")).alias("package")).distinct()
