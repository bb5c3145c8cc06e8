"""Counts of source files, by hand."""

import pytest

from deploom.functions.declarations import COLUMNS, declarations, read_source
from deploom.sources.package_stats import package_stats

SOURCE = '''package a // func no()
import (
	"x"
	. "func"
)
/* type no struct{} */
type T struct { f func() }
const (
	A = iota
	B
)
var f = func() int { var inner int; return inner }
var g =
	func() {}
func (t *T) m() { type local int }
func main() { s := `
func no() {}`; _ = s }; func last() {}
'''
#: What is counted for each: file and its name always make 2.
PIECES = [
    # text, declarations, code, comment, basic (beside file and name)
    ('import "x"', {"other": 1}, 2, 0, 1),
    ('import (\n\ta "x"\n\t. "y" // why\n)', {"other": 1}, 5, 1, 2),
    ("// doc\n// more\nvar x int", {"var": 1}, 4, 1, 0),
    ("// apart\n\nvar x int // end", {"var": 1}, 4, 1, 0),
    ("var x, y = 1, f(2)", {"var": 1}, 6, 0, 2),  # GenDecl ValueSpec x y, call f
    ("const (\n\t// lead\n\tA = iota // end\n\tB\n)", {"const": 1}, 6, 2, 0),
    ("type T struct {\n\t// lead\n\ta, b int `tag` // end\n\t*E\n\tp.Q\n}", {"type": 1}, 5 + 4 + 3 + 4, 2, 1),  # GenDecl TypeSpec T Struct list; Field a b int; Field Star E; Field Sel p Q
    ("type I interface {\n\tM(a, b int) (x, y string)\n\tE\n\t~int | string\n}", {"type": 1}, 5 + (1 + 1 + 1 + (1 + 1 + 3) + (1 + 1 + 3)) + 2 + 5, 0, 0),
    ("type A = [3]map[string]*chan<- int", {"type": 1}, 3 + 1 + 1 + 1 + 1 + 1 + 1, 0, 1),
    ("type G[K comparable, V any] struct{}", {"type": 1}, 3 + 1 + 3 + 3 + 2, 0, 0),
    ("type N [n]int", {"type": 1}, 3 + 3, 0, 0),
    ("func f()", {"func": 1}, 1 + 1 + 1 + 1, 0, 0),
    ("func (r *R) f(a int, b ...string) error {}", {"func": 1}, 1 + (1 + 1 + 1 + 2) + 1 + 1 + (1 + 3 + 4) + (1 + 1 + 1) + 1, 0, 0),
    ("func f(int, p.Q)", {"func": 1}, 1 + 1 + 1 + (1 + 2 + 4), 0, 0),
    ("func f(a G[int], G[int])", {"func": 1}, None, 0, 0),
    ("func f() { return }", {"func": 1}, 5 + 1, 0, 0),
    ("func f() { return a + b*-c, <-d }", {"func": 1}, 5 + 1 + 6 + 2, 0, 0),
    ("func f() { x := []int{1, 2}; x[0]++ }", {"func": 1}, 5 + (1 + 1 + 1 + 2) + (1 + 1 + 1), 0, 3),
    ("func f() { if a := g(); a { } else if b { } else { } }", {"func": 1}, 5 + 1 + (1 + 1 + 2) + 1 + 1 + (1 + 1 + 1) + 1, 0, 0),
    ("func f() { for i := 0; i < n; i++ { continue } }", {"func": 1}, 5 + 1 + 2 + 3 + 2 + 2, 0, 1),
    ("func f() { for k, v := range m { } ; for range c { } ; for { break L } }", {"func": 1}, 5 + 5 + 3 + 4, 0, 0),
    ("func f() { for a { } ; for ; ; { } }", {"func": 1}, 5 + 3 + 2, 0, 0),
    ("func f() { switch a { case 1, b: c(); default: } }", {"func": 1}, 5 + 1 + 1 + 1 + (1 + 1 + 3) + 1, 0, 1),
    ("func f() { switch x := y.(type) { case T: } ; switch y.(type) { } ; switch { } }", {"func": 1}, 5 + (1 + 4 + 1 + 2) + (1 + 3 + 1) + 2, 0, 0),
    ("func f() { select { case v := <-c: case c <- 1: case <-d: default: } }", {"func": 1}, 5 + 2 + (1 + 4) + (1 + 2) + (1 + 3) + 1, 0, 1),
    ("func f() { L: for { } ; M: }", {"func": 1}, 5 + (2 + 2) + (2 + 1), 0, 0),
    ("func f() { go g(1); defer func() {}() }", {"func": 1}, 5 + (1 + 2) + (1 + 1 + 4), 0, 1),
    ("func f() { x.y(a...).(T).z[1:2:3] = &p.Q{A: {1}, 2} }", {"func": 1}, None, 0, 5),
    ("func f() { var a int; const c = 1; type t int }", {"func": 1}, 5 + 5 + 4 + 5, 0, 1),
    ("func f() { if x == (T{}) { } ; for _, a := range []int{1} { } }", {"func": 1}, 5 + (1 + 1 + 1 + 1 + 2 + 1) + (1 + 2 + 3 + 1), 0, 1),
    ("func f() { _ = map[string]T{\"a\": {}, `b`: T{}} ; ; }", {"func": 1}, 5 + (2 + 4) + (1 + 1) + (1 + 2) + 1, 0, 2),
    ("func f[T any](x T) (<-chan T, error)", {"func": 1}, 1 + 1 + (1 + 3) + 1 + (1 + 3) + (1 + 3 + 2), 0, 0),
    ("var h = func(a int) int { return a } /* x */", {"var": 1}, 3 + 1 + 1 + 4 + 3 + 1 + 2, 1, 0),
    ("var n = 0x1F + 1e-3 + .5i + 'a' + '\\'' + `\n//`", {"var": 1}, 3 + 5, 0, 6),
]


@pytest.mark.parametrize("text, decls, code, comment, basic", PIECES)
def test_nodes_by_hand(text, decls, code, comment, basic):
    got = read_source("package p\n\n" + text + "\n")
    assert not got.errors
    assert {k: n for k, n in got.decls.items() if n} == decls
    assert (got.nodes["comment"], got.nodes["basic"]) == (comment, basic)
    if code is not None:
        assert got.nodes["code"] == code + 2


def test_pieces_add_up():
    """A file of several pieces counts what its pieces count."""
    whole = read_source("package p\n\n" + "\n\n".join(p[0] for p in PIECES) + "\n")
    assert not whole.errors
    each = [read_source("package p\n\n" + p[0] + "\n") for p in PIECES]
    assert whole.nodes["code"] - 2 == sum(e.nodes["code"] - 2 for e in each)
    assert whole.nodes["basic"] == sum(e.nodes["basic"] for e in each) and whole.nodes["comment"] == sum(e.nodes["comment"] for e in each)
    assert sum(whole.decls.values()) == len(PIECES)


def test_counts(spark):
    want = {"func": 3, "type": 1, "const": 1, "var": 2, "other": 1}
    assert read_source(SOURCE).decls == want and sum(read_source("").decls.values()) == 0
    rows = declarations(spark.createDataFrame([("a", SOURCE), ("b", None), ("c", "package c")], "path string, text string")).collect()
    got = {r["path"]: r for r in rows}
    assert {k: got["a"][k] for k in want} == want and got["a"]["parsed"] and got["a"]["errors"] == []
    assert not got["b"]["parsed"] and [tuple(e) for e in got["b"]["errors"]] == [(1, 1, "expected 'package', found 'EOF'")]
    assert {k: got["c"][k] for k in COLUMNS} == dict.fromkeys(COLUMNS, 0) | {"code": 2}


BROKEN = '''package p

func good() {}

func bad( {
	x := 1
}

var y = (1 + ]

// é
type é struct { a int; } ; const c = "open
func late() { if x { } else y }
var last = 1
'''


def test_errors_and_recovery():
    got = read_source(BROKEN)
    assert [e[:2] for e in got.errors] == [(12, 39), (5, 11), (9, 14), (13, 29)]
    assert got.errors[1][2] == "expected a type, found '{'" and got.errors[3][2] == "expected if statement or block, found 'y'"
    assert (got.decls["func"], got.decls["var"], got.decls["type"]) == (1, 1, 1)
    for text, place in (("package", (1, 8)), ("pack p", (1, 1)), ("package p\nfunc f() {", (2, 11)), ("package p\nx := 1", (2, 1)), ("package p\nvar a int b", (2, 11)), ("package p\n/* open", (2, 1))):
        assert read_source(text).errors[0][:2] == place, text
    many = read_source("package p\n" + "var = 1\n" * 50)
    assert len(many.errors) == 10
    deep = read_source("package p\nvar x = " + "(" * 800 + "1" + ")" * 800 + "\n")
    assert not deep.errors and deep.nodes["code"] == 2 + 3 + 800
    assert read_source("package p\nvar x = " + "(" * 100_000).errors


def test_packages_from_files(spark):
    files = [("a.go", SOURCE.encode()), ("b.go", b"package b\n\nvar x = 1\n"), ("bad.go", b"package b\nfunc f( {\n"), ("worse.go", b"package b\nvar (\nvar x = ]\nvar = 2\n"), ("x.s", b"one\n\ntwo"), ("empty.h", b""), ("y.bin", b"a\x00b\n")]
    packages = [("base", "p", ["a.go", "b.go", "gone.go"], ["x.s", "empty.h", "gone.c"]), ("base", "q", ["bad.go", "worse.go"], ["y.bin"]), ("alt", "q", [], None)]
    got = {(r["variant"], r["id"]): r for r in package_stats(spark.createDataFrame(packages, "variant string, id string, go_files array<string>, other_files array<string>"), spark.createDataFrame(files, "path string, content binary")).collect()}
    p, q = got["base", "p"], got["base", "q"]
    assert (p["package_count"], p["go_files"], p["go_size"], p["decl_func"], p["decl_var"], p["decl_type"]) == (1, 2, len(SOURCE) + 21, 3, 3, 1)
    one = read_source(SOURCE)
    assert (p["token_code"], p["token_comment"], p["token_basic"]) == (one.nodes["code"] + 5, one.nodes["comment"], one.nodes["basic"] + 1)
    assert (p["other_files"], p["other_size"], p["other_lines"], p["other_blank"]) == (3, 8, 2, 1)
    assert p["errors"] == ['failed to open "gone.c"', 'failed to read "gone.go"']
    assert (q["go_files"], q["go_lines"], q["decl_func"], q["token_code"], q["other_binary"], q["other_lines"]) == (2, 6, 0, 0, 1, 0)
    assert q["errors"] == ["failed to parse \"bad.go\": bad.go:2:9: expected a type, found '{'", "failed to parse \"worse.go\": worse.go:3:1: expected a name, found 'var' (and 1 more error)"]
    assert got["alt", "q"]["package_count"] == 1 and got["alt", "q"]["errors"] == []
