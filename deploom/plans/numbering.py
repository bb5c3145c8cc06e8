"""Global order without a single task: rows are range-partitioned, numbered in their part, and shifted by what stands before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import materialise


def in_order(df: DataFrame, order: list, number: str = "line_no", running: dict[str, str] | None = None) -> DataFrame:
    """``df`` with its rows' numbers from 1 in ``order``, and for each (new column, column) of ``running`` the sum so far.

    One line per part comes to the driver.
    """
    running = running or {}
    own = [F.expr(c) if isinstance(c, str) else c for c in order]
    placed = df.repartitionByRange(*own).sortWithinPartitions(*own)
    placed = materialise(placed.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__place")), "ordered")
    sums = [F.sum(c).cast("bigint").alias(new) for new, c in running.items()]
    parts = sorted(placed.groupBy("__part").agg(F.count("*").alias("__rows"), F.min("__place").alias("__first"), *sums).collect(), key=lambda r: r["__part"])
    before, lines = [0] * (1 + len(running)), []
    for r in parts:
        lines.append((r["__part"], before[0] - r["__first"], *before[1:]))
        before = [a + (b or 0) for a, b in zip(before, (r["__rows"], *(r[new] for new in running)))]
    schema = ", ".join(["__part int", "__shift bigint", *(f"`__{new}` bigint" for new in running)])
    out = placed.join(F.broadcast(df.sparkSession.createDataFrame(lines, schema)), "__part")
    window = Window.partitionBy("__part").orderBy("__place")
    sums = [(F.sum(c).over(window) + F.col(f"__{new}")).cast("bigint").alias(new) for new, c in running.items()]
    return out.select(*df.columns, (F.col("__shift") + F.col("__place") + 1).cast("bigint").alias(number), *sums)
