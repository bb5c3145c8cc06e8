"""Modules of packages from their files' paths."""

from deploom.sources.catalog import read_manifest
from deploom.sources.modules import locate
from deploom.schema import IMPORTS, PACKAGES

ROOTS = [
    ("me.test/outer", "/work/outer", None, None, None),
    ("me.test/outer/inner", "/work/outer/inner/", None, None, None),
    ("me.test/other", "/work/outer2", "v1.0.0", "../fork", "v9"),
    ("b.test/twice", "/work/twice", None, None, None),
    ("a.test/twice", "/work/twice", None, None, None),
]
PLACES = {
    "cached": ("/go/pkg/mod/github.com/!azure/!s!d!k@v1.2.3-!r!c/sub/x.go", ("github.com/Azure/SDK", "v1.2.3-RC", "/go/pkg/mod/github.com/!azure/!s!d!k@v1.2.3-!r!c", None, None, False)),
    "root": ("/work/outer/x.go", ("me.test/outer", None, "/work/outer", None, None, True)),
    "deep": ("/work/outer/a/b/x.go", ("me.test/outer", None, "/work/outer", None, None, True)),
    "inner": ("/work/outer/inner/a/x.go", ("me.test/outer/inner", None, "/work/outer/inner", None, None, True)),
    "like inner": ("/work/outer/innermost/x.go", ("me.test/outer", None, "/work/outer", None, None, True)),
    "replaced": ("/work/outer2/x.go", ("me.test/other", "v1.0.0", "/work/outer2", "../fork", "v9", False)),
    "twice": ("/work/twice/x.go", ("a.test/twice", None, "/work/twice", None, None, True)),
    "beside the cache": ("/go/pkg/modern/x.go", (None,) * 5 + (False,)),
    "cache without version": ("/go/pkg/mod/cache/x.go", (None,) * 5 + (False,)),
    "none": (None, (None,) * 5 + (False,)),
}
COLUMNS = ["module_path", "module_version", "module_dir", "replace_path", "replace_version", "is_local"]


def roots(spark):
    return spark.createDataFrame(ROOTS, "module_path string, dir string, version string, replace_path string, replace_version string")


def test_longest_folder_wins(spark):
    packages = spark.createDataFrame([(i, [at, at + "z"] if at else None) for i, (at, _) in PLACES.items()], "id string, go_files array<string>")
    got = {r["id"]: tuple(r[c] for c in COLUMNS) for r in locate(packages, roots(spark), "/go/pkg/mod/").collect()}
    assert got == {i: want for i, (_, want) in PLACES.items()}
    assert locate(packages.limit(0), roots(spark), "/go/pkg/mod").count() == 0
    assert all(r["module_path"] is None for r in locate(packages, roots(spark).limit(0), "/go/pkg/mod").where("id <> 'cached'").collect())


def test_manifest_with_roots(spark, tmp_path):
    rows = [("base", i, "p", i, None, False, [at] if at else None, None, None, None, None, None) for i, (at, _) in PLACES.items()]
    spark.createDataFrame(rows, PACKAGES).write.json(str(tmp_path / "p"))
    spark.createDataFrame([], IMPORTS).write.json(str(tmp_path / "i"))
    c = read_manifest(spark, str(tmp_path / "p"), str(tmp_path / "i"), fmt="json", roots=roots(spark))
    got = {r["id"]: (r["module_path"], r["is_local"]) for r in c.packages.collect()}
    assert got == {i: (want[0], want[5]) for i, (_, want) in PLACES.items()}
