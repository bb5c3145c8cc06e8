"""Printed reports as (line_no, line): aligned tables, symbol listings, size differences, build steps; node records as JSON.

Nothing is aligned or numbered on the driver: column widths are one aggregate, line numbers come from
range partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import scalars as S
from ..functions.template import compile_template
from ..operators import execlog, weight
from ..operators.stats import Graph
from ..plans.lineage import materialise
from ..plans.numbering import in_order
from ..schema import RUSAGE, STAT_FIELDS
from .graphs import node_field
from .tables import header_of


def aligned(rows: DataFrame, header: str | None, order: list, padding: int = 3, align: bool = True) -> DataFrame:
    """(line_no, line) of ``line`` columns in ``order``; tab-separated cells are padded to their column but for the last.

    ``header``: a first line, or None.
    """
    placed = in_order(rows, order, "line_no").select("line_no", "line")
    if header is not None:
        first = placed.sparkSession.createDataFrame([(0, header)], "line_no bigint, line string")
        placed = first.unionByName(placed).withColumn("line_no", F.col("line_no") + 1)
    if not align:
        return placed
    cells = placed.withColumn("cells", F.split("line", "\t"))
    each = cells.select(F.posexplode(F.slice("cells", 1, F.size("cells") - 1)).alias("place", "cell"))
    widths = each.groupBy("place").agg((F.max(F.length("cell")) + padding).alias("width"))
    widths = widths.agg(F.map_from_entries(F.collect_list(F.struct("place", "width"))).alias("widths"))  # one row, an entry per column
    padded = F.transform("cells", lambda c, i: F.when(i == F.size("cells") - 1, c).otherwise(F.rpad(c, F.try_element_at("widths", i), " ")))
    return cells.crossJoin(F.broadcast(widths)).select("line_no", F.array_join(padded, "").alias("line"))


def _header(fmt: str, header: str) -> str | None:
    return None if header == "-" else header or header_of(fmt)


def list_table(nodes: DataFrame, fmt: str, header: str = "", align: bool = True) -> DataFrame:
    """One formatted line a node in id order; ``header`` "-" leaves it out, an empty one follows from the format."""
    rows = nodes.select("id", compile_template(fmt, node_field(nodes)).alias("line"))
    return aligned(rows, _header(fmt, header), ["id"], align=align)


CUT_FORMAT = "{{.ID}}\t{{.InDegree}}\t{{.Cut.PackageCount}}\t{{.Cut.AllFiles.Size}}\t{{.Cut.Go.Lines}}"


def cut_table(cut: DataFrame, fmt: str = CUT_FORMAT, header: str = "", align: bool = True) -> DataFrame:
    """One formatted line a member: fewest importers first, then most packages, then by id."""
    rows = cut.select("id", "in_degree", "cut_package_count", compile_template(fmt, node_field(cut)).alias("line"))
    return aligned(rows, _header(fmt, header), [F.col("in_degree"), F.desc("cut_package_count"), F.col("id")], align=align)


def _size(humanized: bool, short: bool = False) -> Callable[[Column], Column]:
    if not humanized:
        return lambda c: c.cast("string")
    return S.mem_string_short if short else S.mem_string


def _right(c: Column, width: int) -> Column:
    return F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length(c))), c)


def weight_lines(symbols: DataFrame, sort: str = "", cumulative: bool = False, minimum: int = 1024, limit: int = 0, every: bool = False, humanized: bool = False) -> DataFrame:
    """binary, line_no, line: each binary's printed tree, a line per node of at least ``minimum`` in all, and below it its symbols of at least as much.

    Lines are numbered through; binaries stand one after another.  What the report needs of the
    symbols is written once.
    """
    show = _size(humanized)
    kind = sort or ("totalsize" if cumulative else "size")
    symbols = materialise(weight.sized(symbols, every).select("binary", "line_no", "code", "size", "path", "name"), "symbols")
    nodes = materialise(weight.listing(symbols, sort, cumulative, minimum, limit, True), "nodes")
    order = {"size": [F.desc("node_size"), F.desc("total_size")], "totalsize": [F.desc("total_size")], "name": []}[kind]
    own = F.concat(_right(show(F.col("total_size")), 10), F.lit(" "), _right(show(F.col("size")), 10), F.lit(" "), "path", F.lit(" [syms "), F.col("symbols").cast("string"), F.lit("]"))
    heads = nodes.select("binary", "path", F.col("size").alias("node_size"), "total_size", F.lit(0).cast("bigint").alias("place"), own.alias("line"))
    line = F.concat(F.repeat(F.lit(" "), F.lit(11)), _right(show(F.col("size")), 10), F.lit(" "), F.col("code"), F.lit(" "), F.col("name"))
    inside = weight.node_symbols(symbols, kind == "name", minimum, True).select("binary", weight.node_path().alias("path"), F.col("place").cast("bigint").alias("place"), line.alias("line"))
    below = inside.join(nodes.select("binary", "path", F.col("size").alias("node_size"), "total_size"), ["binary", "path"]).select(*heads.columns)
    rows = materialise(heads.unionByName(below), "report")
    return in_order(rows, [F.col("binary"), *order, F.col("path"), F.col("place")]).select("binary", "line_no", "line")


def weight_diff_lines(symbols: DataFrame, binaries: list[str], aliases: list[str] | None = None, minimum: int = 0, cumulative: bool = False, every: bool = False, humanized: bool = False, color: bool = False) -> DataFrame:
    """The printed difference: name, size and delta per binary, a total beyond two binaries, the running total if asked for."""
    show = _size(humanized, True)
    names = aliases or binaries

    def delta(c: Column) -> Column:
        grown = F.concat(F.lit("+"), show(c))
        if color:
            grown = F.concat(F.lit("\x1b[7m"), grown, F.lit("\x1b[0m"))
        return _right(F.when(c == 0, "~").when(c > 0, grown).otherwise(show(c)), 8)

    header, cells = ["name"], [F.col("qualified_name")]
    for i, name in enumerate(names):
        header.append(f"{name:>7}")
        cells.append(_right(F.coalesce(show(F.col(f"size_{i}")), F.lit("-")), 7))
        if i:
            header.append("  delta")
            cells.append(delta(F.col(f"delta_{i}")))
    if len(binaries) > 2:
        header.append("total ∆")
        cells.append(delta(F.col("total_delta")))
    if cumulative:
        header.append("cum. ∆")
        cells.append(delta(F.col("cumulative")))
    rows = weight.diff(symbols, binaries, minimum, cumulative, every)
    rows = rows.select(F.abs("total_delta").alias("change"), "qualified_name", F.concat_ws("\t", *cells).alias("line"))
    return aligned(rows, "\t".join(header), [F.desc("change"), F.col("qualified_name")], padding=4)


#: Names of the resource counters in formats, in the order of the log's columns.
USAGE = dict(zip(("MaximumResidentSetSize", "IntegralSharedMemorySize", "IntegralUnsharedDataSize", "IntegralUnsharedStackSize", "PageReclaims", "PageFaults", "Swaps", "BlockInputOperations", "BlockOutputOperations", "IPCMessagesSent", "IPCMessagesReceived", "SignalsReceived", "VoluntaryContextSwitches", "InvoluntaryContextSwitches"), RUSAGE))
_BYTES = ("MaximumResidentSetSize", "IntegralSharedMemorySize", "IntegralUnsharedDataSize", "IntegralUnsharedStackSize")


def exec_line(df: DataFrame, fmt: str) -> Column:
    """A build step's line: fields of the record, times in seconds, sizes with their unit."""
    seconds = lambda c: F.concat((F.col(c) / 1e9).cast("string"), F.lit("s"))
    fields = {"Command": "command", "PackageName": "package", "Output": "output", "Args": "args", "Inputs": "inputs", "HasUsage": "has_usage", "ExitStatus": "exit_status", "Start": "start", "Finish": "finish"}

    def field(path: str) -> Column:
        path = path.removeprefix("Usage.")
        if path in ("UserTime", "SystemTime"):
            return seconds("user_ns" if path == "UserTime" else "system_ns")
        if path in ("OutputSize", "InputsSize"):
            size = F.col("output_size" if path == "OutputSize" else "input_size")
            return size, S.mem_string(size)
        if path in USAGE:
            count = F.coalesce(USAGE[path], F.lit(0))
            return (count, S.mem_string(count)) if path in _BYTES else count
        if path not in fields:
            raise ValueError(f"unknown field {path!r}")
        return F.col(fields[path])

    return compile_template(fmt, field, df)


EXEC_FORMAT = "{{.Command}} {{.PackageName}} {{.UserTime}}"


def exec_lines(log: DataFrame, fmt: str = EXEC_FORMAT, files: DataFrame | None = None) -> DataFrame:
    """``log`` with ``line``, the formatted record of each build step."""
    rows = execlog.records(log) if files is None else execlog.with_sizes(log, files)
    return rows.withColumn("line", exec_line(rows, fmt))


def _stat(nodes: DataFrame, start: str) -> Column:
    """The statistics struct of a node record; counts that are not held are 0."""
    groups: dict[str, list[Column]] = {}
    for c, path in STAT_FIELDS.items():
        value = F.coalesce(start + c, F.lit(0).cast("bigint")) if start + c in nodes.columns else F.lit(0).cast("bigint")
        group, _, leaf = path.rpartition(".")
        groups.setdefault(group, []).append(value.alias(leaf))
    return F.struct(*groups.pop(""), *[F.struct(*cells).alias(g) for g, cells in groups.items()])


def node_json(graph: Graph) -> DataFrame:
    """(id, json): a record per member, with what it holds, its imports inside the set, and its own, upper and lower sums."""
    nodes, at = graph.with_sums(), "k"
    if "k" not in nodes.columns:  # paths change their variant
        nodes, at = nodes.withColumn("k", F.col("id")), "id"
    # a member's import path is looked for by its hash first
    ids = graph.set.ids().select(F.xxhash64("id").alias("hash"), F.col("id").alias("import_path"), F.lit(True).alias("inside"))
    if at == "k":
        imports = graph.own_imports().select(graph.key(F.col("variant"), F.col("src_id")).alias("k"), "import_path", "dst_id")
    else:
        imports = graph.imports().select(F.col("src_id").alias("k"), "import_path", "dst_id")
    imports = imports.withColumn("hash", F.xxhash64("import_path")).join(ids, ["hash", "import_path"], "left").repartition("k")
    imports = imports.groupBy("k").agg(F.sort_array(F.collect_set(F.struct("import_path", "dst_id", "inside"))).alias("every"))
    nodes = nodes.join(imports, "k", "left")
    named = F.transform(F.filter("every", lambda x: x["inside"]), lambda x: x["import_path"])
    nodes = nodes.withColumn("imports_nodes", F.when(F.size(named) > 0, F.array_distinct(named))).withColumn("imports", F.transform("every", lambda x: F.struct(x["import_path"].alias("import_path"), x["dst_id"].alias("dst_id"))))
    lists = {"GoFiles": "go_files", "CompiledGoFiles": "compiled_go_files", "OtherFiles": "other_files", "IgnoredFiles": "ignored_files"}
    package = [F.col("id").alias("ID")]
    for name, c in (("Name", "name"), ("PkgPath", "pkg_path"), *lists.items(), ("ExportFile", "export_file")):
        if name in lists:  # counts of a package's files have names like these
            c = next((x for x in ("list_" + c, c) if x in nodes.columns and isinstance(nodes.schema[x].dataType, ArrayType)), "")
        if c in nodes.columns:  # empty values are left out
            package.append(F.when((F.size(c) if name in lists else F.length(c)) > 0, F.col(c)).alias(name))
    package.append(F.when(F.size("imports") > 0, F.map_from_entries("imports")).alias("Imports"))
    errors = [F.when(F.size("errors") > 0, F.col("errors")).alias("Errors")] if "errors" in nodes.columns else []
    record = F.struct(F.struct(*package).alias("Package"), F.col("imports_nodes").alias("ImportsNodes"), _stat(nodes, "").alias("Stat"), _stat(nodes, "up_").alias("Up"), _stat(nodes, "down_").alias("Down"), *errors)
    return nodes.select("id", F.to_json(record).alias("json"))
