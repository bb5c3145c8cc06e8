"""Reach sets along single ways: where one direct import reaches all others, a package's reach set is that import and its reach set.

Packages are keyed by hashes (``hashed`` verifies that no two share one).  An import that itself imports
all others of a package is its next step; where none does, edges that another edge's end repeats are
dropped and the only one left is.  Where a package is the next step of one only, the two stand in one
line: places in lines follow from doubling pointers, sums along a line are running sums, and lines, of
which there are far fewer than packages, add up by doubling pointers again.  So a path of n steps takes
log2(n) rounds and no row per reachable pair.  This holds where nothing below is on a cycle or keeps
several edges; the others are ``wild`` and keep their pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import counted, folder, materialise, present
from . import fixpoint

#: Packages a line holds at most; longer ones go on as a line of their own.
LINE = 65_536


@dataclass(frozen=True)
class Forest:
    #: k, line, pos, next, the package's values: all that import something or are the next step of another
    place: DataFrame
    #: line, next (the line it leads to), n, hops (packages from its first to the end), lost, total_ (own values) and far_ (those of the lines after it)
    lines: DataFrame
    #: pointers (line, next) of 1, 2, 4, ... lines
    rounds: list[DataFrame]
    #: whether some packages follow no single way, and the keys of those among them that stand in no line
    wild: bool
    circles: DataFrame | None
    columns: tuple[str, ...]

    def calm(self) -> DataFrame:
        """k, next, hops of all that import something and follow single ways to an end."""
        lines = self.lines.where("not lost").select("line", F.col("hops").alias("__hops"))
        return self.place.where("next is not null").join(lines, "line").select("k", "next", (F.col("__hops") - F.col("pos") - 1).alias("hops"))

    def lost(self) -> DataFrame:
        """(k) of all others that import something."""
        out = self.place.join(self.lines.where("lost").select("line"), "line", "left_semi").select("k")
        return out if self.circles is None else out.unionByName(self.circles)

    def above(self, columns: list[str]) -> DataFrame:
        """line and, for each of ``columns``, the sum over all packages in the lines that lead to it."""
        own = materialise(self.lines.select("line", *[F.when(F.col("lost"), 0).otherwise(F.col("total_" + c)).cast("bigint").alias(c) for c in columns]), "own")
        sums = own
        for step in self.rounds:
            more = step.join(sums, "line").select(F.col("next").alias("line"), *columns)
            sums = materialise(sums.unionByName(more).groupBy("line").agg(*[F.sum(c).alias(c) for c in columns]), "above")
        return sums.unionByName(own.select("line", *[(-F.col(c)).alias(c) for c in columns])).groupBy("line").agg(*[F.sum(c).cast("bigint").alias(c) for c in columns])

    def least(self, own: DataFrame) -> DataFrame:
        """line and the least ``first`` of own (line, first) in the lines that lead to it, itself included."""
        found = own
        for step in self.rounds:
            more = step.join(found, "line").select(F.col("next").alias("line"), "first")
            found = materialise(found.unionByName(more).groupBy("line").agg(F.min("first").alias("first")), "least")
        return found

    def sums(self, below: list[str], above: list[str]) -> DataFrame:
        """k, down_ of each of ``below`` and up_ of each of ``above``: sums over all below and above calm packages and their ends."""
        rows = self.place.join(self.lines.select("line", "lost", *["total_" + c for c in below], *["far_" + c for c in below]), "line")
        if above:
            rows = rows.join(self.above(above).select("line", *[F.col(c).alias("above_" + c) for c in above]), "line")
        so_far = Window.partitionBy("line").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        zero = F.lit(0).cast("bigint")
        before = {c: F.sum(c).over(so_far) for c in {*below, *above}}
        down = [F.when(F.col("lost"), zero).otherwise(F.col("total_" + c) + F.col("far_" + c) - before[c]).cast("bigint").alias("down_" + c) for c in below]
        up = [(F.when(F.col("lost"), zero).otherwise(before[c] - F.col(c)) + F.col("above_" + c)).cast("bigint").alias("up_" + c) for c in above]
        return rows.select("k", *down, *up)


def hashed(edges: DataFrame, others: DataFrame | None = None) -> tuple[DataFrame, Callable[[Column, Column], Column]]:
    """(s, d) of edges (variant, src_id, dst_id), and the hash by which packages, ``others`` (variant, id) too, are keyed: one by which no two share a key."""
    for salt in count():
        key = lambda variant, id_, salt=salt: F.xxhash64(F.lit(salt), variant, id_)
        ends = [(edges, "src_id"), (edges, "dst_id")] + ([(others, "id")] if others is not None else [])
        names = reduce(DataFrame.unionByName, [t.select(key(F.col("variant"), F.col(c)).alias("k"), key(F.col("variant"), F.concat(c, F.lit("#"))).alias("check")) for t, c in ends])
        if names.groupBy("k").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b").isEmpty():
            return edges.select(key(F.col("variant"), F.col("src_id")).alias("s"), key(F.col("variant"), F.col("dst_id")).alias("d")), key


def adjacency(pairs: DataFrame) -> DataFrame:
    """s and ds, all it imports, of (s, d)."""
    return pairs.repartition("s").groupBy("s").agg(F.collect_set("d").alias("ds"))


def _steps(adj: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(k, next) of all that import something (null: none that reaches all others), and the rows of adj whose step was found by dropping edges."""
    several = adj.where("size(ds) > 1")
    far = adj.select(F.col("s").alias("via"), F.col("ds").alias("far"))
    ways = several.select("s", "ds", F.explode("ds").alias("via")).join(far, "via")
    whole = ways.where("array_except(ds, far) = array(via)").select(F.col("s").alias("k"), F.col("via").alias("next"))
    single = adj.select(F.col("s").alias("k"), F.expr("if(size(ds) = 1 and ds[0] <> s, ds[0], null)").alias("next"))
    steps = single.unionByName(whole).groupBy("k").agg(F.count("next").alias("n"), F.min("next").alias("next"))
    steps, rest = counted(steps.select("k", F.expr("if(n = 1, next, null)").alias("next"), F.expr("if(n = 1, null, 1)").alias("rest")), "steps", "rest")
    if not rest:
        return steps.select("k", "next"), None
    others = materialise(several.join(steps.where("rest = 1").select(F.col("k").alias("s")), "s", "left_semi"), "branching")
    ways = others.select("s", "ds", F.explode("ds").alias("via")).join(far, "via", "left")
    again = F.expr("if(via = s or far is null, cast(array() as array<bigint>), array_except(far, array(via)))")
    kept = ways.groupBy("s").agg(F.first("ds").alias("ds"), F.flatten(F.collect_list(again)).alias("again")).select("s", F.expr("array_except(ds, again)").alias("kept"))
    found = materialise(kept.select(F.col("s").alias("k"), F.expr("if(size(kept) = 1 and kept[0] <> s, kept[0], null)").alias("next")), "steps")
    checked = others.join(found.where("next is not null").select(F.col("k").alias("s")), "s", "left_semi")
    return steps.join(found.select("k"), "k", "left_anti").select("k", "next").unionByName(found), checked


def _double(start: DataFrame, key: str, rows: int, sums: dict[str, str], name: str, ends: bool) -> tuple[list[DataFrame], list[DataFrame], DataFrame | None]:
    """Pointers ``next`` of start, doubled until they end; ``sums`` (column: how it grows by the far one's ``__column``).

    start: ``key``, next, done and the sums; ``rows`` of it are not done.  Returns the finished rows, each
    round's pointers, and what runs in circles.  ``ends``: a pointer ends where it is null; else where it
    leads out of the table, and it is kept.
    """
    table, active, done, rounds = start, rows, [], []
    while active:
        done.append(table.where("done"))
        if 2 ** len(rounds) > 2 * rows:
            return done, rounds, table.where("not done")
        rounds.append(table.where("not done").select(key, "next"))
        every = reduce(DataFrame.unionByName, done, table.where("not done"))
        far = every.select(F.col(key).alias("next"), F.col("next").alias("__next"), F.col("done").alias("__done"), *[F.col(c).alias("__" + c) for c in sums])
        found = table.where("not done").join(far, "next", "left")
        to = F.col("__next") if ends else F.coalesce("__next", "next")
        found = found.select(key, to.alias("next"), F.coalesce("__done", F.lit(True)).alias("done"), *[F.expr(e).alias(c) for c, e in sums.items()])
        table, active = counted(found.withColumn("active", F.expr("if(done, null, 1)")), name, "active")
        table = table.drop("active")
    done.append(table)
    return done, rounds, None


def ways(adj: DataFrame, values: DataFrame | None = None, columns: tuple[str, ...] = ()) -> Forest:
    """The forest of adj (a written table of s, ds); values (k, *columns), unique by k, are those of the packages."""
    steps, loose = _steps(adj)
    out = _lines(steps, values, columns)
    if loose is None:
        return out
    # steps found by dropping edges: each edge has to lead nearer to the end, so nothing there is on a cycle
    lines = out.lines.select("line", F.col("hops").alias("__hops"), F.col("lost").alias("__lost"))
    at = out.place.join(lines, "line").select("k", (F.col("__hops") - F.col("pos") - 1).alias("hops"), F.col("__lost").alias("lost"))
    of = lambda c, name: at.select(F.col("k").alias(c), F.col("hops").alias(name), F.col("lost").alias(name + "_lost"))
    edges = loose.select("s", F.explode("ds").alias("d"))
    checked = edges.join(of("s", "a"), "s").where("not a_lost").join(of("d", "b"), "d", "left")
    bad, n = counted(checked.where("b_lost or b >= a").select(F.col("s").alias("id"), F.lit("").alias("variant")).distinct(), "bad")
    if not n:
        return out
    every = adj.select(F.col("s").alias("src_id"), F.explode("ds").alias("dst_id"), F.lit("").alias("variant")).withColumn("dst_variant", F.col("variant"))
    lost = materialise(fixpoint.ancestors(bad, every).select(F.col("id").alias("k")).distinct(), "lost")
    return _lines(steps.join(lost, "k", "left_anti").unionByName(lost.withColumn("next", F.lit(None).cast("bigint"))), values, columns)


def _lines(steps: DataFrame, values: DataFrame | None, columns: tuple[str, ...]) -> Forest:
    before = steps.where("next is not null").groupBy(F.col("next").alias("k")).agg(F.count("*").alias("n"), F.min("k").alias("before"))
    nodes = steps.withColumn("known", F.lit(True)).join(before, "k", "full").select("k", "next", (F.col("known").isNotNull() & F.col("next").isNull()).alias("lost"), F.expr("if(n = 1, before, null)").alias("before"))
    nodes, linked = counted(nodes, "nodes", "before")
    start = nodes.where("before is not null").select("k", F.col("before").alias("next"), F.lit(False).alias("done"), F.lit(1).cast("bigint").alias("pos"))
    done, rounds, circles = _double(start, "k", linked, {"pos": "pos + coalesce(__pos, 0)"}, "pointers", False)
    place = nodes.select("k", "next", "lost")
    if done:
        found = reduce(DataFrame.unionByName, done).select("k", F.col("next").alias("line"), "pos")
        place = place.join(found, "k", "left")
    else:
        place = place.withColumn("line", F.lit(None).cast("bigint")).withColumn("pos", F.lit(None).cast("bigint"))
    place = place.select("k", "next", "lost", F.coalesce("line", "k").alias("line"), F.coalesce("pos", F.lit(0)).cast("bigint").alias("pos"))
    if circles is not None:
        circles = materialise(circles.select("k"), "circles")
        place = place.join(circles, "k", "left_anti")
    if values is not None:
        zero = F.lit(0).cast("bigint")
        place = place.join(values, "k", "left").select("k", "next", "lost", "line", "pos", *[F.coalesce(c, zero).cast("bigint").alias(c) for c in columns])
    place = materialise(place, "place")
    if 2 ** len(rounds) > LINE:
        parts = place.where((F.col("pos") > 0) & (F.col("pos") % LINE == 0)).select("line", F.floor(F.col("pos") / LINE).alias("__part"), F.col("k").alias("__line"))
        cut = place.withColumn("__part", F.floor(F.col("pos") / LINE)).join(F.broadcast(parts), ["line", "__part"], "left")
        place = materialise(cut.select("k", "next", "lost", F.coalesce("__line", "line").alias("line"), (F.col("pos") % LINE).alias("pos"), *columns), "place")
    lines = place.groupBy("line").agg(F.count("*").alias("n"), F.max_by("next", "pos").alias("next"), F.max("lost").alias("lost"), *[F.sum(c).alias("total_" + c) for c in columns])
    lines, joined = counted(lines, "lines", "next")
    far = {c: "far_" + c for c in columns}
    grow = {"hops": "hops + coalesce(__hops, 0)", "lost": "lost or coalesce(__lost, true)", **{f: f"{f} + coalesce(__{f}, 0)" for f in far.values()}}
    start = lines.select("line", "next", F.col("next").isNull().alias("done"), F.col("n").alias("hops"), "lost", *[F.col("total_" + c).alias(f) for c, f in far.items()])
    ended, rounds, round_ = _double(start, "line", joined, grow, "lines", True)
    ended = ended or [start]
    if round_ is not None:
        ended.append(round_.withColumn("lost", F.lit(True)))
    found = reduce(DataFrame.unionByName, ended).select("line", "hops", "lost", *far.values())
    found = lines.drop("lost").join(found, "line").select("line", "next", "n", "hops", "lost", *["total_" + c for c in columns], *[(F.col(f) - F.col("total_" + c)).alias(f) for c, f in far.items()])
    lines, lost = counted(found.withColumn("__lost", F.expr("if(lost, 1, null)")), "lines", "__lost")
    return Forest(place.drop("lost"), lines.drop("__lost"), rounds, bool(lost) or circles is not None, circles, tuple(columns))


def levels(edges: DataFrame) -> DataFrame | None:
    """(id, hops) for all that import something in edges (src, dst): each edge leads to fewer hops. None where ways are not single."""
    named = edges.select(F.lit("").alias("variant"), F.col("src").alias("src_id"), F.col("dst").alias("dst_id"))
    pairs, key = hashed(named)
    found = ways(materialise(adjacency(pairs), "adjacency"))
    if found.wild:
        return None
    ids = edges.select(F.col("src").alias("id")).distinct().withColumn("k", key(F.lit(""), F.col("id")))
    return materialise(ids.join(found.calm(), "k").select("id", "hops"), "levels")


def sweep(start: DataFrame, edges: DataFrame, hops: DataFrame, message: str, result: str) -> DataFrame:
    """(id, path) in the order of ``hops``, importers first: each node and each edge is worked on once.

    start (id, path): first messages.  ``result``: a node's path from its messages ``path``; ``message``:
    what its importer ``id`` tells ``dst``.  Messages wait in a folder per level; nodes without any have no row.
    """
    spark = edges.sparkSession
    at = folder(spark, "sweep")
    to = hops.select(F.col("id").alias("dst"), F.col("hops").alias("to"))
    tagged = edges.join(hops.select(F.col("id").alias("src"), "hops"), "src").join(to, "dst", "left").select("src", "dst", F.coalesce("to", F.lit(0)).cast("bigint").alias("to"), "hops")
    tagged.repartition("hops", F.pmod(F.xxhash64("src"), F.lit(32))).write.partitionBy("hops").parquet(f"{at}/edges")
    start.join(hops, "id", "left").select("id", "path", F.coalesce("hops", F.lit(0)).alias("to")).write.partitionBy("to").parquet(f"{at}/inbox/from=start")
    top = hops.agg(F.max("hops")).first()[0] or 0
    inbox, done = "id string, path array<string>", []
    for h in range(top, -1, -1):
        waiting = present(spark, f"{at}/inbox/from=*/to={h}")
        if not waiting:
            continue
        path = f"{at}/done/{h}"
        spark.read.schema(inbox).parquet(*waiting).groupBy("id").agg(F.expr(result).alias("path")).write.parquet(path)
        done.append(path)
        if h:
            out = spark.read.schema("src string, dst string, to bigint").parquet(f"{at}/edges/hops={h}") if present(spark, f"{at}/edges/hops={h}") else None
            if out is not None:
                told = spark.read.schema(inbox).parquet(path).join(out, F.col("id") == F.col("src"))
                told.select(F.col("dst").alias("id"), F.expr(message).alias("path"), "to").write.partitionBy("to").parquet(f"{at}/inbox/from={h}")
    return spark.read.schema(inbox).parquet(*done) if done else start.limit(0)


#: What two sorted paths have in common begins all that lie between them.
_COMMON = "transform(array(struct(min(path) as a, max(path) as b)), x -> slice(x.a, 1, cast(if(array_position(zip_with(x.a, x.b, (p, q) -> p <=> q), false) = 0, size(x.a), array_position(zip_with(x.a, x.b, (p, q) -> p <=> q), false) - 1) as int)))[0]"


def dominators(nodes: DataFrame, edges: DataFrame, hops: DataFrame) -> DataFrame:
    """(id, path): all without which the sources reach a node no more, itself last; the common part of its importers' paths."""
    start = nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti").select("id", F.expr("cast(array() as array<string>)").alias("path"))
    return sweep(start, edges, hops, "path", f"concat({_COMMON}, array(id))")


def smallest_paths(roots: DataFrame, edges: DataFrame, hops: DataFrame) -> DataFrame:
    """(id, path): the smallest path of ids from a root, in the order of arrays."""
    return sweep(roots.select("id", F.array("id").alias("path")), edges, hops, "concat(path, array(dst))", "min(path)")
