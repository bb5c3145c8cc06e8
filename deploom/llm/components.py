"""Connected components by alternating star contraction, wholly in DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long, a <> b) -> one row per node that has a link: node, component (its smallest node).

    Each round points every node's larger neighbours at its smallest one, then its smaller neighbours
    too; it ends when the edges are stars.  Every round is a written table, so lineage stays short.
    Minima are partial aggregates; where a hub's edges make a join partition skewed (five times the
    median and 256 MB by default), adaptive execution splits it, smaller ones stay whole.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (now := _state(edges)) != before:
        before = now
        if not now[0]:
            break
        large = _star(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "b > a")
        small = _star(large, "true")
        edges = written(small, "edges")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _star(edges: DataFrame, which: str) -> DataFrame:
    """For each a with the smallest m of itself and its neighbours b: edges b -> m (where ``which``) and a -> m."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    out = edges.join(least, "a").where(which).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union-find on arrays: afterwards label[x] is the smallest index linked with x."""
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
