"""Selectors and functions over package sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import materialise
from . import fixpoint, forest
from .sets import PackageSet


def is_test(id_: Column) -> Column:
    """Ids of test packages by their suffix."""
    return id_.endswith(".test") | id_.endswith("_test") | id_.endswith(".test]")


def own_edges(s: PackageSet) -> DataFrame:
    """Edges whose source is a member, of the member's variant."""
    return s.catalog.edges.join(s.members.select(F.col("id").alias("src_id"), "variant"), ["src_id", "variant"], "left_semi")


def closure(s: PackageSet) -> PackageSet:
    return s.with_(fixpoint.closure(s.members, s.catalog.edges, tuple(s.catalog.loaded)))


def imports(s: PackageSet) -> PackageSet:
    """Direct imports that are not members."""
    found = own_edges(s).groupBy(F.col("dst_id").alias("id")).agg(F.min("dst_variant").alias("variant"))
    return s.with_(found.join(s.ids(), "id", "left_anti"))


def modules(s: PackageSet) -> PackageSet:
    """Members and whatever they reach in their own modules; null modules never match."""
    wanted = s.packages().select("module_path").where(F.col("module_path").isNotNull()).distinct()
    reached = closure(s)
    return s.union(reached.with_(reached.packages().join(wanted, "module_path", "left_semi")))


def sources(s: PackageSet) -> PackageSet:
    """Members without an importer inside the set."""
    imported = own_edges(s).select(F.col("dst_id").alias("id"))
    return s.with_(s.members.join(imported, "id", "left_anti"))


def sources_of_all(s: PackageSet) -> PackageSet:
    """Members that nothing in the whole closure imports."""
    return s.with_(s.members.join(own_edges(closure(s)).select(F.col("dst_id").alias("id")), "id", "left_anti"))


def mains(s: PackageSet) -> PackageSet:
    return s.with_(s.packages().where(F.col("name") == "main"))


def tests(s: PackageSet) -> PackageSet:
    return s.with_(s.members.where(is_test(F.col("id"))))


def reach(x: PackageSet, y: PackageSet) -> PackageSet:
    """Members of x that are in y or have a path, through any packages, to it."""
    edges = x.catalog.edges
    # targets in every variant in which something points at them
    direct = edges.join(y.ids(), edges["dst_id"] == y.members["id"], "left_semi").select(F.col("dst_id").alias("id"), F.col("dst_variant").alias("variant"))
    targets = direct.unionByName(y.members).distinct()
    found = fixpoint.ancestors(targets, edges)
    return x.with_(x.members.join(found, ["id", "variant"], "left_semi").unionByName(x.members.join(y.ids(), "id", "left_semi").select("id", "variant")).distinct())


def incoming(x: PackageSet, y: PackageSet) -> PackageSet:
    """Members of x that import a member of y directly, and all of y."""
    direct = own_edges(x).join(y.ids(), F.col("dst_id") == y.members["id"], "left_semi").select(F.col("src_id").alias("id"))
    return x.with_(x.members.join(direct, "id", "left_semi")).union(y)


def transitive(s: PackageSet) -> PackageSet:
    """Same members with reduced edges: u -> v goes if v is reachable from a direct import of u."""
    edges, single = own_edges(s), None
    if s.catalog.edges.where("variant <> dst_variant").isEmpty():  # no path leaves its variant
        variants = [r[0] for r in s.members.select("variant").distinct().collect()]
        pairs, key = forest.hashed(s.catalog.edges.where(F.col("variant").isin(variants)))
        calm = forest.ways(materialise(forest.adjacency(pairs), "adjacency")).calm().select("k", "next")
        edges = edges.withColumn("k", key(F.col("variant"), F.col("src_id")))
        calm = calm.join(edges.where("import_path <> dst_id").select("k"), "k", "left_anti")
        # of a single way's imports the next step reaches all others
        own = [c for c in edges.columns if c != "k"]
        single = edges.join(calm, "k").where(key(F.col("variant"), F.col("dst_id")) == F.col("next")).select(*own)
        edges = materialise(edges.join(calm, "k", "left_anti").select(*own), "branching")
    if single is not None and edges.isEmpty():
        kept = single
    else:
        direct = edges.select(F.col("dst_id").alias("id"), F.col("dst_variant").alias("variant")).distinct()
        pairs = fixpoint.pair_closure(direct, s.catalog.edges).select(F.col("root").alias("via"), F.col("id").alias("far"))
        spare = edges.join(pairs, edges["dst_id"] == pairs["via"]).select("src_id", F.col("far").alias("import_path")).distinct()
        kept = edges.join(spare, ["src_id", "import_path"], "left_anti")
        kept = kept if single is None else kept.unionByName(single)
    mark = F.concat("variant", F.lit("#reduced"))
    inside = s.members.select(F.col("id").alias("dst_id"), F.col("variant").alias("dst_variant"), F.lit(True).alias("inside"))
    kept = kept.join(inside, ["dst_id", "dst_variant"], "left")
    reduced = materialise(kept.select(mark.alias("variant"), "src_id", "import_path", "dst_id", F.when(F.col("inside"), F.concat("dst_variant", F.lit("#reduced"))).otherwise(F.col("dst_variant")).alias("dst_variant")), "reduced")
    members = s.members.select("id", F.concat("variant", F.lit("#reduced")).alias("variant"))
    return PackageSet(members, s.catalog.with_edges(reduced))


def deadcode(s: PackageSet) -> PackageSet:
    """Members that reach a symbol by which dead code cannot be removed."""
    from .deadcode import blocked_packages

    blocked = blocked_packages(s.catalog.dump)
    return s.with_(s.members.join(blocked.select(F.col("package").alias("id")), "id", "left_semi"))
