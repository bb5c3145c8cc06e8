"""Graph aggregates: totals, up and down sums over the closure, degrees, cut."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import materialise
from ..plans.numbering import in_order
from ..schema import STAT_FIELDS
from . import fixpoint, forest, walk
from .graph_ops import own_edges
from .sets import PackageSet


#: A module path's own part and its major version: ``/v2`` behind it, or ``.v2`` where versions stand in the name.
_SPLIT = r"^(.*?)(/v[0-9]+|(?<=^gopkg\.in/.{1,200})\.v[0-9]+)?$"


class Graph:
    """A set's induced graph; what up and down sums share is worked out once."""

    def __init__(self, s: PackageSet):
        self.set = s
        self.stats = s.catalog.stat_columns
        self._pairs = self._forest = self._edges = self._variants = self.key = None

    def nodes(self) -> DataFrame:
        return self.set.packages()

    def totals(self) -> DataFrame:
        return self.nodes().agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in self.stats])

    def edges(self) -> DataFrame:
        """Induced edges (src, dst): the import path names a member."""
        if self._edges is None:
            ids = self.set.ids()
            inside = own_edges(self.set).join(ids, F.col("import_path") == ids["id"], "left_semi")
            self._edges = materialise(inside.select(F.col("src_id").alias("src"), F.col("import_path").alias("dst")).distinct(), "induced")
        return self._edges

    def imports(self) -> DataFrame:
        """What each member imports, inside the set or not: src_id, import_path, dst_id."""
        return own_edges(self.set).select("src_id", "import_path", "dst_id").distinct()

    def variants(self) -> list[str]:
        if self._variants is None:
            self._variants = sorted(r[0] for r in self.set.members.select("variant").distinct().collect())
        return self._variants

    def own_imports(self) -> DataFrame:
        """All edges of the members' variants."""
        return self.set.catalog.edges.where(F.col("variant").isin(self.variants()))

    def forest(self) -> forest.Forest | None:
        """The members' variants as single ways with the values of members; None where paths change their variant."""
        if self._forest is None:
            if not self.set.catalog.edges.where("variant <> dst_variant").isEmpty():
                return None
            nodes = self.nodes().select("id", "variant", *self.stats)
            pairs, self.key = forest.hashed(self.own_imports(), nodes if len(self.variants()) == 1 else self._in_variants(nodes).select(F.col("__v").alias("variant"), "id"))
            columns = [*self.stats, *["own_" + c for c in self.stats]] if len(self.variants()) > 1 else self.stats
            self._forest = forest.ways(materialise(forest.adjacency(pairs), "adjacency"), self._keyed(nodes).select("k", *columns), tuple(columns))
        return self._forest

    def _in_variants(self, nodes: DataFrame) -> DataFrame:
        return nodes.crossJoin(F.broadcast(nodes.sparkSession.createDataFrame([(v,) for v in self.variants()], "__v string")))

    def _keyed(self, nodes: DataFrame) -> DataFrame:
        """``nodes`` with k and, where there are several variants, a row in each: ``mine`` in their own, which alone has values own_."""
        if len(self.variants()) == 1:
            return nodes.withColumn("k", self.key(F.col("variant"), F.col("id"))).withColumn("mine", F.lit(True))
        mine = F.col("variant") == F.col("__v")
        return self._in_variants(nodes).select("*", self.key(F.col("__v"), F.col("id")).alias("k"), mine.alias("mine"), *[F.when(mine, F.col(c)).otherwise(0).alias("own_" + c) for c in self.stats]).drop("__v")

    def pairs(self) -> DataFrame:
        """(root, id) for members that follow no single way and all they reach; cycles back to a root left out."""
        if self._pairs is None:
            roots, ways = self.set.members, self.forest()
            if ways is not None:
                lost = ways.lost()
                roots = roots.withColumn("k", self.key(F.col("variant"), F.col("id"))).join(lost, "k", "left_semi").select("id", "variant")
            self._pairs = fixpoint.pair_closure(roots, self.set.catalog.edges).where("root <> id").select("root", "id")
        return self._pairs

    def with_sums(self, parts: tuple[str, ...] = ("up", "down")) -> DataFrame:
        """The members with k (but where paths change their variant) and, as up_ and down_, the statistics of all members above and below each."""
        ways, nodes = self.forest(), self.nodes()
        zero, found = F.lit(0).cast("bigint"), []
        names = [f"{p}_{c}" for p in parts for c in self.stats]
        whole = lambda df: df.select("id", *[(F.col(n) if n in df.columns else zero).alias(n) for n in names])
        if ways is not None:
            own = self.stats if len(self.variants()) == 1 else ["own_" + c for c in self.stats]
            sums = ways.sums(self.stats if "down" in parts else [], list(own) if "up" in parts else [])
            if len(self.variants()) == 1 and not ways.wild:
                rows = self._keyed(nodes).drop("mine").join(sums, "k", "left")
                return rows.select("k", *nodes.columns, *[F.coalesce(n, zero).alias(n) for n in names])
            keyed = self._keyed(nodes.select("id", "variant", *self.stats)).select("k", "id", "mine").join(sums, "k")
            found.append(whole(keyed.select("id", *[F.when(F.col("mine"), F.col("down_" + c)).otherwise(0).alias("down_" + c) for c in self.stats if "down" in parts], *[F.col("up_" + o).alias("up_" + c) for c, o in zip(self.stats, own) if "up" in parts])))
        if ways is None or ways.wild:
            pairs, stats = self.pairs(), nodes.select("id", *self.stats)
            if "down" in parts:
                found.append(whole(pairs.join(stats, "id").select(F.col("root").alias("id"), *[F.col(c).alias("down_" + c) for c in self.stats])))
            if "up" in parts:
                found.append(whole(pairs.join(stats.withColumnRenamed("id", "root"), "root").select("id", *[F.col(c).alias("up_" + c) for c in self.stats])))
        sums = reduce(DataFrame.unionByName, found).groupBy("id").agg(*[F.sum(n).cast("bigint").alias(n) for n in names])
        out = nodes.join(sums, "id", "left").select(*nodes.columns, *[F.coalesce(n, zero).alias(n) for n in names])
        return out if ways is None else out.withColumn("k", self.key(F.col("variant"), F.col("id")))

    def down(self) -> DataFrame:
        """Statistics of all members below each member."""
        return self.with_sums(("down",)).select("id", *[F.col("down_" + c).alias(c) for c in self.stats])

    def up(self) -> DataFrame:
        """Statistics of all members above each member."""
        return self.with_sums(("up",)).select("id", *[F.col("up_" + c).alias(c) for c in self.stats])

    def degrees(self) -> DataFrame:
        edges = self.edges()
        inn = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
        out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
        zero = F.lit(0).cast("bigint")
        return self.set.ids().join(inn, "id", "left").join(out, "id", "left").select("id", F.coalesce("in_degree", zero).alias("in_degree"), F.coalesce("out_degree", zero).alias("out_degree"))

    def cut(self, exclude: PackageSet | None = None) -> DataFrame:
        """id, degrees, and the statistics of what goes with each member; fewest importers first, then most packages.

        ``exclude`` is left out of the result only.
        """
        edges = self.edges()
        hops = forest.levels(edges)
        if hops is None:
            fallen = fixpoint.cut_closure(self.set.ids(), edges)
        else:
            fallen = forest.dominators(self.set.ids(), edges, hops).select(F.explode("path").alias("start"), "id")
        stats = self.nodes().select("id", *self.stats)
        sums = fallen.join(stats, "id").groupBy(F.col("start").alias("id")).agg(*[F.sum(c).cast("bigint").alias("cut_" + c) for c in self.stats])
        out = self.degrees().join(sums, "id")
        if exclude is not None:
            out = out.join(exclude.ids(), "id", "left_anti")
        return out.orderBy("in_degree", F.desc("cut_package_count"), "id")

    def module_tree(self) -> DataFrame:
        """repo, module and package levels of each member: id, repo_root, module_path, module_label, is_local, only_child, single_module.

        A repository with one module is shown as that module if their paths agree and the module's
        version is of the major number in its path; local modules have no version to compare.
        """
        nodes = self.nodes()
        has = lambda name, kind: F.col(name) if name in nodes.columns else F.lit(None).cast(kind)
        n = nodes.select("id", "module_path", F.coalesce(has("is_local", "boolean"), F.lit(False)).alias("is_local"), *[has(c, "string").alias(c) for c in ("module_version", "replace_path", "replace_version")])
        cut = F.regexp_extract("module_path", _SPLIT, 1), F.regexp_extract("module_path", _SPLIT, 2)
        n = n.withColumn("repo_root", F.coalesce(F.when(cut[0] != "", cut[0]).otherwise(F.col("module_path")), "id")).withColumn("major", cut[1])
        per = n.where(F.col("module_path").isNotNull()).groupBy("repo_root").agg(F.count_distinct("module_path").alias("modules"))
        n = n.withColumn("only_child", F.count("*").over(Window.partitionBy("repo_root", "module_path")) == 1)
        own = F.concat(F.lit("v"), F.regexp_extract("major", "[0-9]+", 0))
        agrees = (F.col("major") == "") | F.col("is_local") | F.coalesce(F.regexp_extract("module_version", r"^(v[0-9]+)(\.|$)", 1) == own, F.lit(False))
        at = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit("@"), c)).otherwise("")
        label = F.concat("module_path", at(F.col("module_version")), F.when(F.col("is_local"), " (local)").otherwise(""), F.when(F.col("replace_path").isNotNull(), F.concat(F.lit(" =>\\n"), "replace_path", at(F.col("replace_version")))).otherwise(""))
        return n.join(per, "repo_root", "left").select("id", "repo_root", "module_path", label.alias("module_label"), "is_local", "only_child", F.coalesce((F.col("modules") == 1) & agrees, F.lit(False)).alias("single_module"))

    def tree(self) -> DataFrame:
        """Rows of the printed tree: line, depth, id, parent_id, ref (line of the expanded occurrence), is_std, is_last.

        Each node's smallest path from a source is where it is expanded; every in-set edge out of an
        expanded node gives one row at that path plus the child.  Along single ways lines follow from
        the ways' stretches, else the paths are worked out.
        """
        out = self._tree_of_ways()
        return self._tree_of_paths() if out is None else out

    def _tree_of_ways(self) -> DataFrame | None:
        """The tree without a path: None where ways are not single, variants several, or imports named otherwise."""
        if len(self.variants()) != 1 or not self.own_imports().where("import_path <> dst_id").isEmpty():
            return None
        nodes = self.nodes().select("variant", "id", "is_std")
        pairs, key = forest.hashed(self.own_imports(), nodes)
        members = materialise(nodes.select(key(F.col("variant"), F.col("id")).alias("k"), "id", F.coalesce("is_std", F.lit(False)).alias("is_std")), "members")
        inside = pairs.join(members.select(F.col("k").alias("d")), "d", "left_semi")
        adj = forest.adjacency(inside).join(members.select(F.col("k").alias("s"), "is_std"), "s")
        adj = materialise(adj, "adjacency")
        open_, closed = adj.where("not is_std").select("s", "ds"), adj.where("is_std").select(F.explode("ds").alias("k")).distinct()
        ways = forest.ways(open_, open_.select(F.col("s").alias("k"), F.size("ds").cast("bigint").alias("out")), ("out",))
        if ways.wild:
            return None
        # sources in the order of their ids; each line belongs to the first of those that reach it
        first_of = ways.lines.select("line").join(ways.lines.select(F.col("next").alias("line")), "line", "left_anti").select(F.col("line").alias("k"))
        below = ways.place.select("k").join(first_of, "k", "left_anti").unionByName(closed)
        sources = in_order(members.join(below, "k", "left_anti"), ["id"], "first")
        owned = ways.least(sources.select(F.col("k").alias("line"), "first").join(ways.lines.select("line"), "line", "left_semi"))
        along = Window.partitionBy("first").orderBy(F.desc("hops"))
        so_far, all_ = along.rowsBetween(Window.unboundedPreceding, Window.currentRow), along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        owned = ways.lines.select("line", "n", "hops", "total_out").join(owned, "line")
        owned = materialise(owned.select("line", "first", (F.sum("n").over(so_far) - F.col("n")).alias("start"), (F.sum("total_out").over(so_far) - F.col("total_out")).alias("start_before"), F.sum("total_out").over(all_).alias("edges")), "owned")
        edges = owned.groupBy("first").agg(F.max("edges").alias("edges"))
        sources = sources.join(edges, "first", "left").withColumn("edges", F.coalesce("edges", F.lit(0).cast("bigint"))).withColumn("rows", F.col("edges") + 1)
        sources = materialise(in_order(sources, ["first"], "nth", {"upto": "rows"}).select("k", "id", "is_std", "first", "edges", (F.col("upto") - F.col("rows") + 1).alias("line")), "sources")
        owned = owned.drop("edges").join(sources.select("first", "edges", F.col("line").alias("base")), "first")
        before = F.sum("out").over(Window.partitionBy("line").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("out")
        at = ways.place.join(owned, "line").select("k", F.col("first").alias("root"), (F.col("start") + F.col("pos")).alias("idx"), (F.col("start_before") + before).alias("before"), "base", "edges")
        at = materialise(at.join(members, "k"), "at")
        out = open_.join(at.select(F.col("k").alias("s"), F.col("id").alias("parent_id"), "root", "idx", "base", "edges"), "s")
        out = out.select("parent_id", "root", "idx", "base", "edges", F.explode("ds").alias("k"))
        out = out.join(at.select("k", "id", "is_std", F.col("root").alias("__root"), F.col("idx").alias("__idx"), F.col("before").alias("__before")), "k")
        own = lambda c: F.when(F.col("root") == F.col("__root"), F.col(c))
        out = out.select("k", "id", "parent_id", "is_std", "root", "idx", "base", "edges", own("__idx").alias("to"), own("__before").alias("to_before"))
        rows = out.repartition("root").sortWithinPartitions("root", "idx", "id")
        imports = Window.partitionBy("root", "idx").orderBy("id")
        earlier = imports.rowsBetween(Window.unboundedPreceding, -1)
        nth, n = F.row_number().over(imports).cast("bigint"), F.count("*").over(imports.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        rows = rows.select("*", nth.alias("nth"), F.min("to").over(earlier).alias("cut"), F.min("to_before").over(earlier).alias("cut_before"), (nth == n).alias("is_last"))
        kept = ("k", "id", "parent_id", "is_std", "is_last")
        rows = rows.select(*kept, *walk.GIVEN)
        rows = materialise(rows.mapInArrow(walk.walker(kept), "k bigint, id string, parent_id string, is_std boolean, is_last boolean, line bigint, depth bigint, opened boolean"), "walked")
        cells = lambda df, ref: df.select("line", "depth", "id", "parent_id", ref.alias("ref"), "is_std", "is_last")
        none = F.lit(None).cast("bigint")
        tops = sources.select("line", F.lit(0).cast("bigint").alias("depth"), "id", F.lit(None).cast("string").alias("parent_id"), "is_std", F.lit(False).alias("is_last"))
        opened = rows.where("opened").select("k", F.col("line").alias("first_line")).unionByName(sources.select("k", F.col("line").alias("first_line")))
        again = rows.where("not opened and not is_std").join(opened, "k")
        return cells(tops, none).unionByName(cells(rows.where("opened or is_std"), none)).unionByName(cells(again, F.when(F.col("line") > F.col("first_line"), F.col("first_line"))))

    def _tree_of_paths(self) -> DataFrame:
        from .graph_ops import sources

        roots = sources(self.set).ids()
        std = self.nodes().where("is_std").select("id")
        edges = self.edges()
        open_edges = materialise(edges.join(std, edges["src"] == std["id"], "left_anti"), "tree")
        hops = forest.levels(open_edges)
        best = fixpoint.smallest_paths(roots, open_edges) if hops is None else forest.smallest_paths(roots, open_edges, hops)
        below = open_edges.join(best, open_edges["src"] == best["id"]).select(F.col("dst").alias("id"), F.col("src").alias("parent_id"), F.concat("path", F.array("dst")).alias("path"))
        rows = roots.select("id", F.lit(None).cast("string").alias("parent_id"), F.array("id").alias("path")).unionByName(below)
        siblings = Window.partitionBy("parent_id").orderBy(F.desc("id"))
        rows = rows.withColumn("is_last", F.col("parent_id").isNotNull() & (F.row_number().over(siblings) == 1))
        rows = in_order(rows, ["path"], "line")
        first = rows.join(best.select("path"), "path", "left_semi").select("id", F.col("line").alias("first_line"))
        marks = std.withColumn("is_std", F.lit(True))
        out = rows.join(first, "id", "left").join(marks, "id", "left").withColumn("is_std", F.coalesce("is_std", F.lit(False)))
        return out.select("line", (F.size("path") - 1).cast("bigint").alias("depth"), "id", "parent_id", F.when(~F.col("is_std") & (F.col("line") > F.col("first_line")), F.col("first_line")).alias("ref"), "is_std", "is_last")


def declarations_total(nodes: DataFrame, start: str = "") -> Column:
    """All declarations of a node: the sum of its five counts, as far as they are held."""
    held = [start + c for c in STAT_FIELDS if c.startswith("decl_") and start + c in nodes.columns]
    return sum((F.coalesce(c, F.lit(0)) for c in held), F.lit(0)).cast("bigint")


def add_stats(a: DataFrame, b: DataFrame, columns: list[str], sign: int = 1) -> DataFrame:
    """Field-wise sum (or, with sign -1, difference) of two statistic tables by id; a missing row is zero."""
    b = b.select("id", *[F.col(c).alias("__" + c) for c in columns])
    return a.join(b, "id", "full").select("id", *[(F.coalesce(c, F.lit(0)) + sign * F.coalesce("__" + c, F.lit(0))).cast("bigint").alias(c) for c in columns])
