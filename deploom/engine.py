"""Public interface: the commands of the tool, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import execlog, weight
from .operators.sets import PackageSet
from .operators.stats import Graph
from .plans.compiler import Evaluator
from .plans.expr import explain_expr, join_arguments
from .sources.catalog import Catalog, Context
from .writers import graphs, reports, tables


class Engine:
    """Commands over one catalogue.  ``std`` keeps packages of the standard library in results."""

    explain_expr = staticmethod(explain_expr)

    def __init__(self, catalog: Catalog, context: Context = Context(), default_pattern: str = ".", compat_mod: bool = False):
        self.catalog, self.context, self.default, self.compat_mod = catalog, context, default_pattern, compat_mod
        self._graphs: dict[tuple[str, bool], Graph] = {}

    def calc(self, *expr: str) -> PackageSet:
        return Evaluator(self.catalog, self.context, self.default, self.compat_mod).run(join_arguments(expr))

    def _set(self, expr: str, std: bool) -> PackageSet:
        got = self.calc(expr)
        return got if std else got.subtract(PackageSet(self.catalog.std(self.context), self.catalog))

    def graph_of(self, expr: str, std: bool = False) -> Graph:
        """The graph of an expression; what it has worked out (a written table) serves later commands too."""
        key = expr, std
        if key not in self._graphs:
            self._graphs[key] = Graph(self._set(expr, std))
        return self._graphs[key]

    def _nodes(self, expr: str, std: bool, fmt: str) -> DataFrame:
        graph = self.graph_of(expr, std)
        parts = tuple(part for name, part in ((".Up.", "up"), (".Down.", "down")) if name in fmt)
        nodes = graph.with_sums(parts) if parts else graph.nodes()
        if "Degree" in fmt:
            nodes = nodes.join(graph.degrees(), "id")
        return nodes

    def list(self, expr: str, std: bool = False, fmt: str = "{{.ID}}", relations: bool = True) -> DataFrame:
        """(id, line) in id order; fields of Up and Down are computed if the format asks for them."""
        return tables.table(self._nodes(expr, std, fmt), fmt)

    def list_text(self, expr: str, std: bool = False, fmt: str = "{{.ID}}", header: str = "", align: bool = True) -> DataFrame:
        """(line_no, line) of the printed list; ``header`` "-" leaves the header out, an empty one follows from the format."""
        return reports.list_table(self._nodes(expr, std, fmt), fmt, header, align)

    def json(self, expr: str, std: bool = False) -> DataFrame:
        """(id, json) of each member."""
        return reports.node_json(self.graph_of(expr, std))

    def graph(self, expr: str, type: str = "dot", std: bool = False, cluster: bool = False, colors: dict[str, str] | None = None, **options) -> DataFrame:
        """(line_no, line) in one of the graph formats; ``colors`` maps a colour to an expression, later ones win."""
        got = Graph(self._set(expr, std))
        kind = type.lower()
        if kind not in graphs.WRITERS:
            raise ValueError(f"unknown output type {type!r}")
        if kind in ("dot", "mermaid", "graphml"):
            options["colors"] = [(c, self.calc(e)) for c, e in (colors or {}).items()]
        if kind == "dot" and cluster:
            return graphs.dot_clusters(got, **options)
        return graphs.WRITERS[kind](got, **options)

    def tree(self, expr: str, std: bool = False) -> DataFrame:
        """line, depth, id, parent_id, ref, is_std, is_last."""
        return Graph(self._set(expr, std)).tree()

    def cut(self, expr: str, exclude: str | None = None, std: bool = False) -> DataFrame:
        hidden = None
        if exclude:
            hidden = self.calc(exclude)
        return Graph(self._set(expr, std)).cut(hidden)

    def cut_text(self, expr: str, exclude: str | None = None, std: bool = False, fmt: str = reports.CUT_FORMAT, header: str = "", align: bool = True) -> DataFrame:
        """(line_no, line) of the printed cut table."""
        return reports.cut_table(self.cut(expr, exclude, std), fmt, header, align)

    weight_text = staticmethod(reports.weight_lines)
    weight_diff_text = staticmethod(reports.weight_diff_lines)
    exec_text = staticmethod(reports.exec_lines)

    @staticmethod
    def weight(symbols: DataFrame, **options) -> DataFrame:
        return weight.listing(symbols, **options)

    @staticmethod
    def weight_diff(symbols: DataFrame, binaries: list[str], **options) -> DataFrame:
        return weight.diff(symbols, binaries, **options)

    @staticmethod
    def exec_stats(exec_log: DataFrame) -> DataFrame:
        return execlog.by_command(exec_log)
