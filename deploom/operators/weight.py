"""Symbol sizes: listing parser, roll-up over path prefixes, N-way diff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.symbols import takes_room
from ..plans.lineage import materialise
from ..plans.numbering import in_order

#: A symbol of this size stands for none.
NO_SIZE = 1 << 32


#: What parts path and name, before any parenthesis: the first dot behind the last slash; else the last
#: slash, unless it begins the name.  The group is the path.
_PATH = r"^([^(]*/[^/.(]*(?=\.[^/(]*(?:\(|$))|[^(]+(?=/[^/.(]*(?:\(|$))|[^/.(]+(?=\.[^/(]*(?:\(|$)))"


def _once(**columns) -> list:
    """Columns behind a generator of one row: worked out once, whatever refers to them later."""
    return [F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))]


def _fields(lines: DataFrame) -> DataFrame:
    """Lines with their fields, the place of the type among them (null: none), address and size."""
    df = lines.select("*", *_once(f=F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")))
    kind = lambda i: F.coalesce(F.get("f", F.lit(i)).rlike(r"^[A-Za-z_?]$"), F.lit(False))
    df = df.select("*", *_once(at=F.when(kind(1), 1).when(kind(2), 2)))
    addr = F.when(F.col("at") == 2, F.get("f", F.lit(0))).otherwise("0")
    addr = F.when(addr.rlike("^0*[0-9A-Fa-f]{1,16}$"), F.conv(addr, 16, 10).cast("decimal(20,0)"))
    return df.select("*", *_once(addr=addr, size=F.get("f", F.col("at") - 1).try_cast("bigint")))


def malformed(lines: DataFrame) -> DataFrame:
    """binary, line_no, line, error: lines that are no symbols, each with the reason; ``parse_symbols`` leaves them out."""
    problem = F.when(F.size("f") < 2, "invalid symbol text").when(F.col("at").isNull(), "no symbol type").when(F.col("addr").isNull(), "invalid address").when(F.col("size").isNull(), "invalid size")
    return _fields(lines).select("binary", "line_no", "line", problem.alias("error")).where("error is not null")


def parse_symbols(lines: DataFrame) -> DataFrame:
    """``[addr] size type [name [info...]]`` lines (binary, line_no, line) to symbols; nameless and type-data symbols go."""
    df = _fields(lines).where("at is not null and addr is not null and size is not null")
    df = df.select(
        "binary",
        "line_no",
        "addr",
        F.when(F.col("size") == NO_SIZE, 0).otherwise(F.col("size")).cast("bigint").alias("size"),
        F.get("f", F.col("at")).alias("code"),
        F.coalesce(F.get("f", F.col("at") + 1), F.lit("")).alias("qualified_name"),
        F.array_join(F.slice("f", F.col("at") + 3, F.size("f")), " ").alias("info"),
    ).where("qualified_name <> ''")
    df = df.select("*", *_once(head=F.regexp_extract("qualified_name", _PATH, 1)))
    none = F.expr("cast(array() as array<string>)")
    path = F.when(F.col("head") == "", none).otherwise(F.split("head", "/"))
    name = F.when(F.col("head") == "", F.col("qualified_name")).otherwise(F.expr("substring(qualified_name, length(head) + 2)"))
    df = df.where(~F.col("head").startswith("go.itab.") & ~F.col("head").startswith("type.."))
    return df.select("binary", "line_no", "addr", "size", "code", "qualified_name", "info", path.alias("path"), name.alias("name"))


def sized(symbols: DataFrame, every: bool = False) -> DataFrame:
    """Only symbols that take room, unless ``every``."""
    return symbols if every else symbols.where(takes_room(F.col("code")))


def node_path(depth: Column | None = None) -> Column:
    """The path of a symbol's node, or of the one ``depth`` levels below the root: /a/b, the root empty."""
    part = F.col("path") if depth is None else F.slice("path", 1, depth)
    return F.when(F.size(part) == 0, "").otherwise(F.concat(F.lit("/"), F.array_join(part, "/")))


def rollup(symbols: DataFrame) -> DataFrame:
    """binary, path (/a/b; root empty), total_size, size and symbols of the node itself; a ragged roll-up by exploded prefixes.

    Symbols are added up by their own node first, so a prefix meets each node once.
    """
    own = symbols.groupBy("binary", "path").agg(F.sum("size").alias("size"), F.count("*").alias("symbols"))
    n = F.size("path")
    prefixed = own.select("binary", "size", "symbols", n.alias("own"), "path", F.explode(F.sequence(F.lit(0), n)).alias("depth"))
    here = F.col("depth") == F.col("own")
    own_sum = lambda c: F.sum(F.when(here, F.col(c)).otherwise(0)).cast("bigint").alias(c)
    return prefixed.groupBy("binary", node_path(F.col("depth")).alias("path")).agg(F.sum("size").cast("bigint").alias("total_size"), own_sum("size"), own_sum("symbols"))


def listing(symbols: DataFrame, sort: str = "", cumulative: bool = False, minimum: int = 1024, limit: int = 0, every: bool = False) -> DataFrame:
    """Each binary's rolled-up tree, sorted by size, totalsize or name; ``limit`` keeps the top rows of each."""
    order = {"size": [F.desc("size"), F.desc("total_size")], "totalsize": [F.desc("total_size")], "name": []}[sort or ("totalsize" if cumulative else "size")]
    out = rollup(sized(symbols, every)).where(F.col("total_size") >= minimum)
    if limit > 0:
        out = out.withColumn("place", F.row_number().over(Window.partitionBy("binary").orderBy(*order, "path"))).where(F.col("place") <= limit).drop("place")
    return out.orderBy("binary", *order, "path")


def node_symbols(symbols: DataFrame, by_name: bool = False, minimum: int = 1024, every: bool = False) -> DataFrame:
    """Symbols of each binary's nodes with their place in it, by size or name; then by name, code and line."""
    order = [] if by_name else [F.desc("size")]
    own = Window.partitionBy("binary", "path").orderBy(*order, "name", "code", "line_no")
    return sized(symbols, every).where(F.col("size") >= minimum).withColumn("place", F.row_number().over(own))


def diff(symbols: DataFrame, binaries: list[str], minimum: int = 1024, cumulative: bool = False, every: bool = False) -> DataFrame:
    """qualified_name, size_i and delta_i per binary, total_delta, max_abs_delta[, cumulative].

    The last occurrence of a name in a binary counts; a missing cell stays null and counts 0 in sums.
    """
    rows = sized(symbols, every).where(F.col("binary").isin(binaries)).groupBy("qualified_name", "binary").agg(F.max_by("size", F.struct("line_no", "size")).alias("size"))
    wide = rows.groupBy("qualified_name").pivot("binary", binaries).agg(F.first("size"))
    value = lambda b: F.coalesce(F.col(f"`{b}`"), F.lit(0))
    out, previous, sizes, deltas, changes = ["qualified_name"], None, [], [], []
    for i, b in enumerate(binaries):
        delta = value(b) - previous if previous is not None else value(b)
        sizes.append(F.col(f"`{b}`").alias(f"size_{i}"))
        deltas.append(delta.alias(f"delta_{i}"))
        if i:
            changes.append(F.when(F.col(f"`{b}`").isNotNull(), F.abs(delta)).otherwise(0))
        previous = value(b)
    total = (value(binaries[-1]) - value(binaries[0])).alias("total_delta")
    largest = (F.greatest(*changes) if len(changes) > 1 else changes[0] if changes else F.lit(0)).cast("bigint").alias("max_abs_delta")
    wide = wide.select(*out, *sizes, *deltas, total, largest).where(F.abs("total_delta") >= minimum)
    order = [F.desc(F.abs("total_delta")), F.col("qualified_name")]
    if cumulative:  # over the rows of the printed report
        wide = in_order(materialise(wide, "diff"), order, "place", {"cumulative": "total_delta"}).drop("place")
    return wide.orderBy(*order)


def delta_text(delta, inverse: bool = False):
    """~ for none, a sign otherwise; ``inverse`` adds the terminal's inverse video to growth."""
    grown = F.concat(F.lit("+"), delta.cast("string"))
    if inverse:
        grown = F.concat(F.lit("\x1b[7m"), grown, F.lit("\x1b[0m"))
    return F.when(delta == 0, "~").when(delta > 0, grown).otherwise(delta.cast("string"))


def parse_alias(argument: str) -> tuple[str, str]:
    """alias=path, split at the first =; without one the path names itself."""
    alias, sep, path = argument.partition("=")
    return (alias, path) if sep else (argument, argument)
