"""The recursive part: semi-naive frontier loops, one short plan per round.

A round joins only the rows found in the round before with the edges.  Each round's rows are a
written table, so neither lineage nor the plan grows with the depth, and lost executors cost a
round at most.  Where only reachability counts, edges are first joined with themselves, as long as
that does not multiply them, so that a round takes several steps at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import counted, materialise

#: Rounds after which the visited rows are written as one table again.
COMPACT = 16
#: How often edges are joined with themselves, and how many times their number is allowed.
DOUBLINGS, GROWTH = 2, 5
#: Rounds of a plain reverse reach before edges are joined with themselves.
PLAIN = 6


def shortcuts(edges: DataFrame, src: str, dst: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Edges of up to 2 ** DOUBLINGS steps (``within`` equal values of further columns); fewer where they would be more than GROWTH times as many."""
    key = [*within, src, dst]
    out, first = counted(edges.select(*key).distinct(), "edges")
    for _ in range(DOUBLINGS):
        left = out.select(*within, src, F.col(dst).alias("__via"))
        right = out.select(*within, F.col(src).alias("__via"), dst)
        longer, n = counted(out.unionByName(left.join(right, [*within, "__via"]).select(*key)).distinct(), "shortcuts")
        if n > GROWTH * first:
            break
        out = longer
    return out


def frontier_loop(seed: DataFrame, step, key: list[str], name: str = "frontier", visited: DataFrame | None = None) -> DataFrame:
    """Least fixpoint of ``visited = seed + step(new rows)``, unique by ``key``; what is ``visited`` before stays and goes no further.

    ``step(frontier)`` gives candidate rows, unique by ``key``; those not visited become the next
    frontier.  Ends when there are none, on cyclic input too.
    """
    seed = materialise(seed, name)
    visited, frontier, rounds = seed if visited is None else visited.unionByName(seed), seed, 0
    while True:
        frontier, found = counted(step(frontier).join(visited.select(*key), key, "left_anti").select(*seed.columns), name)
        if not found:
            return visited
        visited = visited.unionByName(frontier)
        rounds += 1
        if rounds % COMPACT == 0:
            visited = materialise(visited, name)


def closure(members: DataFrame, edges: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """Members (id, variant) and everything they reach.

    ``order``: variants by their first load.  Where several meet on an id, the one loaded first stays: its
    members are followed to their end before the next one's.  Within one load, the first by name.
    """

    def step(frontier):
        found = frontier.join(edges, (frontier["id"] == edges["src_id"]) & (frontier["variant"] == edges["variant"]))
        return found.groupBy(F.col("dst_id").alias("id")).agg(F.min("dst_variant").alias("variant"))

    members = members.select("id", "variant")
    if len(order) < 2:
        return frontier_loop(members, step, ["id"], "closure")
    loaded, visited = F.split_part("variant", F.lit("#"), F.lit(1)), None
    members = materialise(members, "members")
    for own in (*[members.where(loaded == v) for v in order], members.where(~loaded.isin(*order))):
        seed = own if visited is None else own.join(visited.select("id"), "id", "left_anti")
        visited = frontier_loop(seed, step, ["id"], "closure", visited)
    return visited


def ancestors(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, variant) from which some target (id, variant) can be reached, targets included."""

    def step(frontier):
        found = frontier.join(edges, (frontier["id"] == edges["dst_id"]) & (frontier["variant"] == edges["dst_variant"]))
        return found.select(F.col("src_id").alias("id"), edges["variant"].alias("variant")).distinct()

    return frontier_loop(targets.select("id", "variant").distinct(), step, ["id", "variant"], "ancestors")


def pair_closure(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, id, variant): everything each root (id, variant) reaches; a root itself only through a cycle."""
    if edges.where("variant <> dst_variant").isEmpty():  # no path leaves its variant
        own = edges.join(roots.select("variant").distinct(), "variant", "left_semi")
        edges = shortcuts(own, "src_id", "dst_id", ("variant",)).withColumn("dst_variant", F.col("variant"))
    first = roots.join(edges, (roots["id"] == edges["src_id"]) & (roots["variant"] == edges["variant"])).groupBy(F.col("src_id").alias("root"), F.col("dst_id").alias("id")).agg(F.min("dst_variant").alias("variant"))

    def step(frontier):
        found = frontier.join(edges, (frontier["id"] == edges["src_id"]) & (frontier["variant"] == edges["variant"]))
        return found.groupBy("root", F.col("dst_id").alias("id")).agg(F.min("dst_variant").alias("variant"))

    return frontier_loop(first, step, ["root", "id"], "pairs")


def reverse_reach(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Plain reverse reachability: seeds (node), edges (target, source)."""
    ways, rounds = edges.select("target", "source"), 0

    def step(frontier):
        nonlocal ways, rounds
        rounds += 1
        if rounds == PLAIN:
            ways = shortcuts(edges, "target", "source")
        return frontier.join(ways, frontier["node"] == ways["target"]).select(F.col("source").alias("node")).distinct()

    return frontier_loop(seeds.select("node").distinct(), step, ["node"], "callers")


def cut_closure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, id): what goes when ``start`` is removed and, in turn, whatever has no importer left.

    edges: distinct (src, dst) inside the graph.  A node falls once the fallen part holds all its importers.
    """
    degree = materialise(edges.groupBy("dst").agg(F.count("*").alias("degree")), "degree")
    begin = materialise(nodes.select(F.col("id").alias("start"), "id"), "cut")
    removed, frontier = begin, begin
    lost = None  # (start, id, lost): importers that have fallen so far
    while True:
        more = frontier.join(edges, frontier["id"] == edges["src"]).groupBy("start", F.col("dst").alias("id")).agg(F.count("*").alias("lost"))
        lost = more if lost is None else lost.unionByName(more).groupBy("start", "id").agg(F.sum("lost").alias("lost"))
        lost = materialise(lost, "lost")
        ripe = lost.join(degree, lost["id"] == degree["dst"]).where("lost = degree").select("start", "id")
        frontier, found = counted(ripe.join(removed, ["start", "id"], "left_anti"), "cut")
        if not found:
            return removed
        removed = removed.unionByName(frontier)


def smallest_paths(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, path): for each reachable node the smallest path of ids from a root, in the order of arrays.

    edges (src, dst) must be acyclic.  Relaxation: only nodes whose path improved go on.
    """
    best = materialise(roots.select("id", F.array("id").alias("path")), "paths")
    changed, rounds = best, 0
    limit = None
    while True:
        tried = changed.join(edges, changed["id"] == edges["src"]).groupBy(F.col("dst").alias("id")).agg(F.min(F.concat("path", F.array("dst"))).alias("new"))
        better = tried.join(best, "id", "left").where(F.col("path").isNull() | (F.col("new") < F.col("path"))).select("id", F.col("new").alias("path"))
        changed, found = counted(better, "paths")
        if not found:
            return best
        best = materialise(best.join(changed.select("id"), "id", "left_anti").unionByName(changed), "paths")
        rounds += 1
        if rounds % 64 == 0:
            limit = limit or best.count() + edges.select("src").distinct().count()
            if rounds > limit:
                raise ValueError("the graph has a cycle; a tree needs an acyclic one")
