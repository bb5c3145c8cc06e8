"""Build-step records: what their arguments say, and aggregates over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import materialise
from ..schema import RUSAGE

#: Flags whose next argument is not an input, and extensions of inputs.
SKIP_NEXT = ("-I", "-D", "-trimpath")
INPUT_EXTENSIONS = (".a", ".o", ".h", ".s", ".c", ".go")


def classify(args: Column) -> Column:
    """struct(command, package, output, inputs) of an argument vector, by an index-aware fold with skip state."""
    command = F.regexp_replace(F.regexp_extract(F.coalesce(F.get(args, F.lit(0)), F.lit("")), r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    begin = F.struct(F.lit("").alias("wait"), F.lit("").alias("package"), F.lit("").alias("output"), F.expr("cast(array() as array<string>)").alias("inputs"))

    def step(acc, a):
        is_input = F.lit(False)
        for e in INPUT_EXTENSIONS:
            is_input = is_input | a.endswith(e)
        takes = a.isin(*SKIP_NEXT, "-o", "-p")
        flag = a.startswith("-")
        free = acc["wait"] == ""
        return F.struct(
            F.when(free & takes, a).otherwise("").alias("wait"),
            F.when(acc["wait"] == "-p", a).otherwise(acc["package"]).alias("package"),
            F.when(acc["wait"] == "-o", a).otherwise(acc["output"]).alias("output"),
            F.when(free & ~flag & is_input, F.concat(acc["inputs"], F.array(a))).otherwise(acc["inputs"]).alias("inputs"),
        )

    rest = F.slice(args, 2, F.greatest(F.size(args) - 1, F.lit(0)))
    return F.aggregate(rest, begin, step, lambda acc: F.struct(command.alias("command"), acc["package"].alias("package"), acc["output"].alias("output"), acc["inputs"].alias("inputs")))


def records(log: DataFrame) -> DataFrame:
    return log.withColumn("info", classify(F.col("args"))).select("*", "info.*").drop("info")


def with_sizes(log: DataFrame, files: DataFrame) -> DataFrame:
    """Input and output sizes from a table (path, size); files that are not there count 0."""
    r = materialise(records(log).withColumn("step", F.monotonically_increasing_id()), "steps")
    inputs = r.select("step", F.explode("inputs").alias("path")).join(files, "path", "left").groupBy("step").agg(F.sum(F.coalesce("size", F.lit(0))).alias("input_size"))
    r = r.join(inputs, "step", "left").withColumn("input_size", F.coalesce("input_size", F.lit(0)))
    out = files.select(F.col("path").alias("output"), F.col("size").alias("output_size"))
    return r.join(out, "output", "left").withColumn("output_size", F.coalesce("output_size", F.lit(0))).drop("step")


def by_command(log: DataFrame) -> DataFrame:
    """Steps, failures, wall and CPU time, inputs, and the sums (of sizes in memory: the largest) of resource counters per command."""
    r = records(log)
    have = lambda c: c in r.columns
    out = [F.count("*").alias("steps"), F.sum("user_ns").alias("user_ns"), F.sum("system_ns").alias("system_ns"), F.sum(F.size("inputs")).cast("bigint").alias("inputs")]
    if have("start") and have("finish"):
        wall = (F.unix_micros("finish") - F.unix_micros("start")) * 1000
        out += [F.sum(wall).alias("wall_ns"), F.max(wall).alias("longest_ns")]
    if have("exit_status"):
        out.append(F.count(F.when(F.col("exit_status") != 0, 1)).alias("failed"))
    if have("has_usage"):
        out.append(F.count(F.when(F.col("has_usage"), 1)).alias("with_usage"))
        for c in RUSAGE:
            if have(c):
                own = F.when(F.col("has_usage"), F.col(c))
                out.append((F.max(own) if c == "maxrss" else F.sum(own)).alias(c))
    return r.groupBy("command").agg(*out)
