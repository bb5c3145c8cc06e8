"""Tables and trees as text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.template import compile_template
from .graphs import node_field


def header_of(template: str) -> str:
    """The header that a format implies: what is left without its braces."""
    return re.sub(r"(\{\{\s*\.?|\s*\}\})", "", template)


def table(nodes: DataFrame, template: str, order: list | None = None) -> DataFrame:
    """(id, line): one formatted line a node."""
    return nodes.select("id", compile_template(template, node_field(nodes)).alias("line"), *[c for c in nodes.columns if c in ("in_degree", "cut_package_count")]).orderBy(*(order or ["id"]))


def tree_lines(tree: DataFrame, template: str = "{{.ID}}") -> DataFrame:
    """(line_no, line) of a tree."""
    mark = F.when(F.col("is_std"), " ~").when(F.col("ref").isNotNull(), F.concat(F.lit(" @"), F.col("ref").cast("string"))).otherwise("")
    branch = F.when(F.col("is_last"), "  └ ").otherwise("  ├ ")
    label = compile_template(template, lambda path: {"ID": F.col("id"), "ParentID": F.col("parent_id")}[path], tree)
    return tree.select(F.col("line").alias("line_no"), F.concat(F.rpad(F.col("line").cast("string"), 4, " "), F.repeat(F.lit("  "), F.col("depth").cast("int")), branch, label, mark).alias("line"))
