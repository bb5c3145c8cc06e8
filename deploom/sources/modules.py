"""Which module a package belongs to, worked out from where its files lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unescaped(path: Column) -> Column:
    """A module cache's spelling of a path, in which a capital is written as ``!`` and its small letter."""
    parts = F.transform(F.split(path, "!"), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))))
    return F.array_join(parts, "")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def locate(packages: DataFrame, roots: DataFrame, modcache: str) -> DataFrame:
    """id, module_path, module_version, module_dir, replace_path, replace_version and is_local of every package.

    packages (id, go_files: array of paths); roots (module_path, dir, version, replace_path,
    replace_version): the folders that hold a module.  A package's folder is that of its first file
    in order of names; its module is the one of the longest folder above (or at) that folder.  Below
    ``modcache`` the path itself names module and version, in the cache's spelling.  A module is
    local if it is not replaced and its folder is outside the cache.  A package without files, or
    below no module, has none (nulls), and is not local.  Of two roots with one folder the module
    first by name counts.

    Each folder is joined with its own parents, so the join is one on equal folders, whatever the
    number of modules.
    """
    cache = modcache.rstrip("/") + "/"
    own = packages.select("id", folder(F.array_min("go_files")).alias("at"))
    places = own.where("at is not null").select("at").distinct()
    inside = F.col("at").startswith(cache)
    rest = F.substr(F.col("at"), F.lit(len(cache) + 1))
    named = r"^(.+?)@([^/]+)"
    cached = places.where(inside & rest.rlike(named)).select(
        "at",
        unescaped(F.regexp_extract(rest, named, 1)).alias("module_path"),
        unescaped(F.regexp_extract(rest, named, 2)).alias("module_version"),
        F.concat(F.lit(cache), F.regexp_extract(rest, named, 0)).alias("module_dir"),
        *[F.lit(None).cast("string").alias(c) for c in ("replace_path", "replace_version")],
        F.lit(False).alias("is_local"),
    )
    steps = F.split("at", "/")
    above = places.where(~inside).select("at", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))).alias("dir"))
    held = roots.groupBy(F.regexp_replace("dir", "(?<=.)/+$", "").alias("dir")).agg(F.min(F.struct("module_path", "version", "replace_path", "replace_version")).alias("module"))
    found = above.join(held, "dir").groupBy("at").agg(F.max_by(F.struct("dir", "module"), F.length("dir")).alias("root"))
    found = found.select("at", "root.module.module_path", F.col("root.module.version").alias("module_version"), F.col("root.dir").alias("module_dir"), "root.module.replace_path", "root.module.replace_version", F.col("root.module.replace_path").isNull().alias("is_local"))
    return own.join(cached.unionByName(found), "at", "left").select("id", "module_path", "module_version", "module_dir", "replace_path", "replace_version", F.coalesce("is_local", F.lit(False)).alias("is_local"))
