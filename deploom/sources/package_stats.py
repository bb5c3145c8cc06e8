"""Statistics of packages from their files: sizes, lines, declarations and syntax nodes, with what went wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.declarations import COLUMNS, counted, spread
from ..functions.syntax import DECLS
from ..functions.scalars import line_stats

SOURCE = ("files", "binary", "size", "lines", "blank")


def package_stats(packages: DataFrame, files: DataFrame) -> DataFrame:
    """variant, id, package_count, go_*, other_*, decl_*, token_*, errors per package.

    packages (variant, id, go_files, other_files: arrays of paths); files (path, content: binary).  A
    source file that is not there adds nothing, another file counts as one; both are errors.  A source
    file that does not parse keeps its lines and is an error, with its first place and the number of others.  Empty files are none.
    """
    each = [packages.select("variant", "id", F.lit(kind).alias("kind"), F.explode(column).alias("path")) for kind, column in (("go", "go_files"), ("other", "other_files"))]
    wanted = each[0].unionByName(each[1])
    # a path's uses travel with its file, which is read once: one shuffle of the texts, none of paths behind it
    uses = wanted.groupBy("path").agg(F.collect_list(F.struct("variant", "id", "kind")).alias("uses"))
    found = uses.join(spread(files.select("path", "content", F.lit(True).alias("found")), "path"), "path", "left")
    text = F.decode("content", "ISO-8859-1")
    is_source = F.coalesce("found", F.lit(False)) & F.exists("uses", lambda u: u["kind"] == "go")
    found = found.select("path", "uses", "content", F.coalesce("found", F.lit(False)).alias("found"), is_source.alias("is_source"), F.octet_length("content").cast("bigint").alias("bytes"), line_stats(text).alias("s"))
    read = counted(found, "content", "is_source").withColumnRenamed("errors", "mistakes")
    rows = read.select("*", F.explode("uses").alias("use")).select("use.*", *[c for c in read.columns if c != "uses"])
    missing, go = ~F.col("found"), F.col("kind") == "go"
    quoted = F.concat(F.lit('"'), "path", F.lit('"'))
    first, others = F.get("mistakes", F.lit(0)), F.size("mistakes") - 1
    place = F.concat_ws(":", "path", first["line"], first["column"], F.concat(F.lit(" "), first["message"]))
    more = F.when(others > 1, F.concat(F.lit(" (and "), others.cast("string"), F.lit(" more errors)"))).when(others == 1, " (and 1 more error)").otherwise("")
    error = F.when(missing, F.concat(F.when(go, "failed to read ").otherwise("failed to open "), quoted)).when(go & ~F.col("parsed"), F.concat(F.lit("failed to parse "), quoted, F.lit(": "), place, more))
    zero = F.lit(0).cast("bigint")
    out = []
    for kind, prefix in (("go", "go_"), ("other", "other_")):
        own = F.col("kind") == kind
        for c in SOURCE:
            value = F.col("bytes") if c == "size" else F.col(f"s.{c}")
            absent = F.lit(1).cast("bigint") if (kind, c) == ("other", "files") else zero
            out.append(F.sum(F.when(own, F.coalesce(F.when(F.col("found"), value), absent)).otherwise(zero)).alias(prefix + c))
    out += [F.sum(F.when(go & F.col("parsed"), F.col(c)).otherwise(zero)).alias(("decl_" if c in DECLS else "token_") + c) for c in COLUMNS]
    sums = rows.groupBy("variant", "id").agg(*out, F.array_sort(F.collect_list(error)).alias("errors"))
    every = packages.select("variant", "id", F.lit(1).cast("bigint").alias("package_count")).join(sums, ["variant", "id"], "left")
    counts = [c for c in sums.columns if c not in ("variant", "id", "errors")]
    return every.select("variant", "id", "package_count", *[F.coalesce(c, zero).alias(c) for c in counts], F.coalesce("errors", F.expr("cast(array() as array<string>)")).alias("errors"))
