"""The package catalogue: what the loader's manifest holds, by variant."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import IMPORTS, PACKAGES, STAT_FIELDS

#: Context keys that go to the environment; all others are build tags.
ENVIRONMENT = ("goos", "goarch", "goenv", "goflags", "goroot", "cgo_enabled")


@dataclass(frozen=True)
class Context:
    """Build context of an expression: environment and tags as sorted pairs."""

    env: tuple[tuple[str, str], ...] = ()
    tags: tuple[tuple[str, str], ...] = ()

    def set(self, key: str, value: str) -> "Context":
        name = key.lower()
        if name in ENVIRONMENT:
            return replace(self, env=tuple(sorted({**dict(self.env), name: value}.items())))
        return replace(self, tags=tuple(sorted({**{k: v for k, v in self.tags if k.lower() != name}, key: value}.items())))

    @property
    def tests(self) -> bool:
        return any(k.lower() == "test" and v == "1" for k, v in self.tags)

    def build_tags(self) -> list[str]:
        return [k for k, v in self.tags if v == "1" and k.lower() != "test"]

    def key(self) -> str:
        """Name of the variant, tests aside: ``base`` or its settings."""
        parts = [f"{k}={v}" for k, v in self.env] + [f"tag={t}" for t in sorted(self.build_tags())]
        return ",".join(parts) or "base"


def replace_alias(pattern: str) -> str:
    return "runtime/cgo" if pattern == "C" else pattern


@dataclass(frozen=True)
class Catalog:
    """packages (variant, id, name, pkg_path, module_path, is_std, statistics) and edges (variant, src_id, import_path, dst_id, dst_variant)."""

    packages: DataFrame
    edges: DataFrame
    dump: DataFrame | None = None
    #: settings -> variant; settings not listed are their own variant
    variants: dict[str, str] = field(default_factory=dict)
    #: id of the package in the working folder, which ``.`` names; empty: the top packages of local modules
    root: str = ""
    #: variants in the order of their first load by the expression that is worked out
    loaded: list[str] = field(default_factory=list)

    @staticmethod
    def of(packages: DataFrame, imports: DataFrame, dump: DataFrame | None = None, variants: dict[str, str] | None = None, root: str = "") -> "Catalog":
        edges = imports.select("variant", "src_id", "import_path", "dst_id", F.col("variant").alias("dst_variant"))
        return Catalog(packages, edges, dump, variants or {}, root)

    @property
    def stat_columns(self) -> list[str]:
        return [c for c in STAT_FIELDS if c in self.packages.columns]

    def with_edges(self, extra: DataFrame) -> "Catalog":
        return replace(self, edges=self.edges.unionByName(extra))

    def merged(self, other: "Catalog") -> "Catalog":
        """The catalogue with the edges of both; sets of one catalogue keep it."""
        return self if other is self or other.edges is self.edges else replace(self, edges=self.edges.unionByName(other.edges).distinct())

    def variant(self, context: Context) -> str:
        return self.variants.get(context.key(), context.key())

    def matches(self, patterns: list[str]) -> Column:
        """One predicate for all patterns: an id, ``p/...`` (p and all below), ``...``, ``std``, or these from the root (``.``)."""
        out = F.lit(False)
        for p in map(replace_alias, patterns):
            if self.root and (p == "." or p.startswith("./")):
                p = self.root + p[1:]
            if p == ".":
                local = F.col("is_local") if "is_local" in self.packages.columns else ~F.col("is_std")
                out = out | F.coalesce((F.col("id") == F.col("module_path")) & local, F.lit(False))
            elif p in ("...", "./..."):
                out = out | F.lit(True)
            elif p == "std":
                out = out | F.col("is_std")
            elif p.endswith("/..."):
                out = out | (F.col("id") == p[:-4]) | F.col("id").startswith(p[:-3])
            else:
                out = out | (F.col("id") == p)
        return out

    def load(self, patterns: list[str], context: Context, tests: bool | None = None) -> DataFrame:
        """The rows of one load; test packages only with ``tests``."""
        from ..operators.graph_ops import is_test

        if self.variant(context) not in self.loaded:
            self.loaded.append(self.variant(context))
        rows = self.packages.where((F.col("variant") == self.variant(context)) & self.matches(patterns))
        if not (context.tests if tests is None else tests):
            rows = rows.where(~is_test(F.col("id")))
        return rows

    def std(self, context: Context) -> DataFrame:
        return self.packages.where((F.col("variant") == self.variant(context)) & F.col("is_std")).select("id", "variant")


def read_manifest(spark: SparkSession, packages: str, imports: str, stats: str | None = None, fmt: str = "parquet", modcache: str = "/go/pkg/mod", roots: DataFrame | None = None) -> Catalog:
    """Catalogue from manifest tables (Parquet partitioned by variant, or JSON), with explicit schemas.

    ``roots`` (module_path, dir, version, replace_path, replace_version): modules then follow from
    where each package's files lie, not from the manifest's records.
    """
    from ..schema import PACKAGE_STATS

    p = spark.read.schema(PACKAGES).format(fmt).load(packages)
    p = p.withColumn("module_path", F.col("module.path")).withColumn("module_version", F.col("module.version")).withColumn("replace_path", F.col("module.replace.path")).withColumn("replace_version", F.col("module.replace.version")).withColumn("is_local", F.col("module.path").isNotNull() & F.col("module.replace").isNull() & F.coalesce(~F.concat("module.dir", F.lit("/")).startswith(modcache.rstrip("/") + "/"), F.lit(True)))
    if roots is not None:
        from .modules import locate

        found = locate(p.select("id", "go_files").groupBy("id").agg(F.max_by("go_files", F.size("go_files")).alias("go_files")), roots, modcache)
        p = p.drop(*[c for c in found.columns if c != "id"]).join(found, "id", "left")
    if stats:
        # counts of files take the names of the lists
        p = p.withColumnsRenamed({c: "list_" + c for c in ("go_files", "other_files")})
        s = spark.read.schema(PACKAGE_STATS).format(fmt).load(stats)
        flat = [F.col("stat." + ("package_count" if "." not in path else _nested(path))).alias(c) for c, path in STAT_FIELDS.items()]
        p = p.join(s.select("variant", "id", *flat), ["variant", "id"], "left")
    else:
        p = p.withColumn("package_count", F.lit(1).cast("bigint"))
    return Catalog.of(p, spark.read.schema(IMPORTS).format(fmt).load(imports))


def _nested(path: str) -> str:
    a, b = path.split(".")
    return {"Go": "go", "OtherFiles": "other_files", "Decls": "decls", "Tokens": "tokens"}[a] + "." + b.lower()


def read_lines(spark: SparkSession, path: str, column: str = "line") -> DataFrame:
    """Text sources (symbol listings, linker dumps): the file, the line's number in it from 1, and the line.

    A file's splits are counted each; a line's number is its place in its split behind those before.
    """
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").alias(column))
    splits = text.groupBy("file", "block").agg(F.count("*").alias("lines"), F.min("place").alias("first"))
    before = F.sum("lines").over(Window.partitionBy("file").orderBy("block")) - F.col("lines")
    splits = splits.select("file", "block", (before - F.col("first") + 1).alias("shift"))
    return text.join(splits, ["file", "block"]).select("file", (F.col("place") + F.col("shift")).alias("line_no"), column)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Source files: path, content, and their line statistics."""
    from ..functions.scalars import line_stats

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.withColumn("source", line_stats(F.decode("content", "ISO-8859-1"))).withColumn("source", F.col("source").withField("size", F.octet_length("content").cast("bigint")))
