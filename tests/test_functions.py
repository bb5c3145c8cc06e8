import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from deploom.functions import scalars as S
from deploom.functions.symbols import is_linker_data, package_of_symbol, package_of_type
from deploom.functions.template import compile_template
from deploom.operators import deadcode, execlog, weight
from deploom.sources.catalog import read_lines
from deploom.writers import reports
from deploom.writers.tables import header_of


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


SIZES = [(0, "0B"), (681, "681B"), (682, "0.7KB"), (1000, "1.0KB"), (1280, "1.2KB"), (699049, "682.7KB"), (699050, "0.7MB"), (-2048, "-2.0KB"), (3 << 30, "3.0GB")]


def test_sizes(spark):
    df = spark.createDataFrame(SIZES, "v bigint, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", S.mem_string(F.col("v"))).collect())
    assert one(spark, S.mem_string_short(F.lit(1280))) == "1.25K" and one(spark, S.mem_string_short(F.lit(5))) == "5B"


def test_numbers(spark):
    assert one(spark, S.div(F.lit(1), F.lit(0))) == math.inf and math.isnan(one(spark, S.div(F.lit(0), F.lit(0))))
    assert one(spark, S.log(F.lit(0))) == -math.inf and math.isnan(one(spark, S.log10(F.lit(-1))))
    assert math.isnan(one(spark, S.to_float(F.lit("x")))) and math.isnan(one(spark, S.add()))
    assert one(spark, S.to_int(F.lit("-2.7"))) == -2 and one(spark, S.round_half_away(F.lit(-2.5))) == -3.0


def test_prefixes(spark):
    assert one(spark, S.rel("a/b", F.lit("a/b/c"))) == "./c" and one(spark, S.rel("a/b", F.lit("a/b"))) == "./" and one(spark, S.rel("a/b", F.lit("a/bc"))) == "a/bc"
    assert one(spark, S.rename(F.lit("a/x"), "a", "")) == "x" and one(spark, S.rename(F.lit("a/x"), "a", "z")) == "z/x"


@pytest.mark.parametrize("text,want", [("", (1, 0, 0, 0, 0)), ("a", (1, 0, 1, 1, 0)), ("a\n", (1, 0, 2, 1, 0)), ("a\n \t\n", (1, 0, 5, 1, 1)), (" ", (1, 0, 1, 0, 0)), ("a\x00b", (0, 1, 3, 0, 0))])
def test_line_stats(spark, text, want):
    s = one(spark, S.line_stats(F.lit(text)))
    assert (s["files"], s["binary"], s["size"], s["lines"], s["blank"]) == want


#: One or more lines per rule: line, size, code, name with path, info, path, name.
SYMBOLS = [
    ("40a0 12 t acme.test/till/coin.count", 12, "t", "acme.test/till/coin.count", "", ["acme.test", "till", "coin"], "count"),
    ("  7 d till.open", 7, "d", "till.open", "", ["till"], "open"),  # no address, no slash
    ("ff 30 R sum.table extra words here", 30, "R", "sum.table", "extra words here", ["sum"], "table"),
    ("1 2 T go:blob.acme.test/coin", 2, "T", "go:blob.acme.test/coin", "", ["go:blob.acme.test"], "coin"),  # slash, no dot behind it
    ("1 2 T p/q/r", 2, "T", "p/q/r", "", ["p", "q"], "r"),
    ("1 2 T p.q/r(s/t.u)", 2, "T", "p.q/r(s/t.u)", "", ["p.q"], "r(s/t.u)"),  # nothing behind a parenthesis counts
    ("1 2 T p/q.(*R).s(t/u.v)", 2, "T", "p/q.(*R).s(t/u.v)", "", ["p", "q"], "(*R).s(t/u.v)"),
    ("1 2 T p/.q", 2, "T", "p/.q", "", ["p", ""], "q"),
    ("1 2 _ .hidden", 2, "_", ".hidden", "", [], ".hidden"),  # a dot in front parts nothing
    ("1 2 ? /root", 2, "?", "/root", "", [], "/root"),
    ("1 2 T /root.x", 2, "T", "/root.x", "", ["", "root"], "x"),
    ("1 2 T plain", 2, "T", "plain", "", [], "plain"),
    ("1 2 T żółw/ß.é", 2, "T", "żółw/ß.é", "", ["żółw", "ß"], "é"),
    ("FFFFFFFFFFFFFFFF 4294967296 U ext.sym", 0, "U", "ext.sym", "", ["ext"], "sym"),  # this size stands for none
    ("1 -3 D neg.size", -3, "D", "neg.size", "", ["neg"], "size"),
]


def by_definition(name):
    """Path and name, character by character."""
    end = name.index("(") if "(" in name else len(name)
    slash = max(name.rfind("/", 0, end), 0)
    cut = slash + max(name[slash:end].find("."), 0)
    return (name[:cut].split("/"), name[cut + 1 :]) if cut else ([], name)


def test_symbols(spark):
    rnd = random.Random(7)
    odd = ["".join(rnd.choice("ab/.(") for _ in range(rnd.randint(1, 9))) for _ in range(400)]
    rows = [("b", i, s[0]) for i, s in enumerate(SYMBOLS)] + [("b", 1000 + i, f"1 2 T {x}") for i, x in enumerate(odd)]
    bad = {900: "                  0 U", 901: "1 8 D go.itab.x/y.z", 902: "1 8 D type..eq.x/y.z", 903: "junk", 904: "zz 1 T a.b", 905: "1 xx T a.b", 906: "1 2 TT a.b", 907: "go.itab.x/y 5 T", 908: "1 8 D go.itab.x/y"}
    lines = spark.createDataFrame(rows + [("b", n, x) for n, x in bad.items()], "binary string, line_no bigint, line string")
    got = {r["line_no"]: r for r in weight.parse_symbols(lines).collect()}
    assert set(bad) & set(got) == set()
    for i, (_, size, code, name, info, path, last) in enumerate(SYMBOLS):
        r = got[i]
        assert (r["size"], r["code"], r["qualified_name"], r["info"], r["path"], r["name"]) == (size, code, name, info, path, last)
        assert by_definition(name) == (path, last)
    for i, x in enumerate(odd):
        assert (got[1000 + i]["path"], got[1000 + i]["name"]) == by_definition(x), x
    assert got[13]["addr"] == 2**64 - 1
    errors = {r["line_no"]: r["error"] for r in weight.malformed(lines).collect()}
    assert errors == {903: "invalid symbol text", 904: "invalid address", 905: "invalid size", 906: "no symbol type", 907: "invalid address"}


def test_lines_are_numbered_in_their_file(spark, tmp_path):
    for n in (1, 700, 40_000):
        (tmp_path / f"f{n}.txt").write_text("".join(f"line {k} {'x' * (k % 50)}\n" for k in range(1, n + 1)))
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        rows = read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
    assert len(rows) == 40_701 and all(r["line"].split()[1] == str(r["line_no"]) for r in rows)


def test_rollup_and_diff(spark):
    rows = [("v1", 1, "1 2000 T a/b.f"), ("v1", 2, "1 3000 T a/b.f"), ("v1", 3, "1 500 T a.g"), ("v2", 1, "1 9000 T a/b.f"), ("v2", 2, "1 7 B a.z")]
    s = weight.parse_symbols(spark.createDataFrame(rows, "binary string, line_no bigint, line string"))
    roll = {(r["binary"], r["path"]): (r["total_size"], r["size"], r["symbols"]) for r in weight.rollup(weight.sized(s)).collect()}
    assert roll == {("v1", ""): (5500, 0, 0), ("v1", "/a"): (5500, 500, 1), ("v1", "/a/b"): (5000, 5000, 2), ("v2", ""): (9000, 0, 0), ("v2", "/a"): (9000, 0, 0), ("v2", "/a/b"): (9000, 9000, 1)}
    assert [(r["binary"], r["path"]) for r in weight.listing(s, limit=1).collect()] == [("v1", "/a/b"), ("v2", "/a/b")]
    d = weight.diff(s, ["v1", "v2"], minimum=0, cumulative=True).collect()
    assert [(r["qualified_name"], r["size_0"], r["size_1"], r["total_delta"], r["cumulative"]) for r in d] == [("a/b.f", 3000, 9000, 6000, 6000), ("a.g", 500, None, -500, 5500)]


def lines_of(df):
    return [r["line"] for r in df.orderBy("line_no").collect()]


def test_printed_sizes(spark):
    rows = [("v1", 1, "1 2000 T a/b.f"), ("v1", 2, "1 3000 T a/b.g"), ("v1", 3, "1 500 T a.h"), ("v2", 1, "1 9000 T a/b.f"), ("v2", 2, "1 7 D a.z")]
    s = weight.parse_symbols(spark.createDataFrame(rows, "binary string, line_no bigint, line string"))
    one = s.where("binary = 'v1'")
    assert lines_of(reports.weight_lines(one)) == ["      5000       5000 /a/b [syms 2]", " " * 17 + "3000 T g", " " * 17 + "2000 T f", "      5500        500 /a [syms 1]", "      5500          0  [syms 0]"]
    assert lines_of(reports.weight_lines(one, sort="name", minimum=0, humanized=True))[0] == "     5.4KB         0B  [syms 0]"
    assert lines_of(reports.weight_diff_lines(s, ["v1", "v2"], ["old", "new"], cumulative=True)) == [
        "name     " + "    old    " + "    new    " + "  delta     " + "cum. ∆",
        "a/b.f    " + "   2000    " + "   9000    " + "   +7000    " + "   +7000",
        "a/b.g    " + "   3000    " + "      -    " + "   -3000    " + "   +4000",
        "a.h      " + "    500    " + "      -    " + "    -500    " + "   +3500",
        "a.z      " + "      -    " + "      7    " + "      +7    " + "   +3507",
    ]
    assert "\x1b[7m+7000\x1b[0m" in lines_of(reports.weight_diff_lines(s, ["v1", "v2"], color=True))[1]
    wide = lines_of(reports.weight_diff_lines(s, ["v1", "v2", "v3"]))
    assert "total ∆" in wide[0] and wide[1].split() == ["a/b.g", "3000", "-", "-3000", "-", "~", "-3000"]


def test_build_steps(spark):
    from deploom.schema import EXEC_LOG

    usage = lambda n: [n * k for k in range(1, 15)]
    t = lambda s: datetime.datetime(2020, 1, 1, 0, 0, s)
    rows = [(["/x/compile", "-o", "o.a", "-p", "a/b", "in.go"], t(0), t(3), 1_500_000_000, 0, 0, True, *usage(1024)), (["compile.exe", "-p", "c", "in.go", "no.go"], t(5), t(6), 10, 20, 2, True, *usage(2)), (["link"], t(0), t(1), 0, 0, 0, False, *[None] * 14)]
    log = spark.createDataFrame(rows, EXEC_LOG)
    files = spark.createDataFrame([("in.go", 2048), ("o.a", 100)], "path string, size bigint")
    got = [r["line"] for r in reports.exec_lines(log, "{{.Command}} {{.PackageName}} {{.UserTime}} {{.OutputSize}} {{.InputsSize}} {{.MaximumResidentSetSize}} {{.Swaps}} {{len .Inputs}} {{.ExitStatus}}", files).orderBy("line").collect()]
    assert got == ["compile a/b 1.5s 100B 2.0KB 1.0KB 7168 1 0", "compile c 1.0E-8s 0B 2.0KB 2B 14 2 2", "link  0.0s 0B 0B 0B 0 0 0"]
    by = {r["command"]: r for r in execlog.by_command(log).collect()}
    c = by["compile"]
    assert (c["steps"], c["failed"], c["wall_ns"], c["longest_ns"], c["inputs"], c["with_usage"], c["maxrss"], c["nswap"]) == (2, 1, 4 * 10**9, 3 * 10**9, 3, 2, 1024, 7 * 1026)
    assert by["link"]["with_usage"] == 0 and by["link"]["maxrss"] is None


DUMP = [
    "main.main -> reflect.test/dirty.CallByName",
    "reflect.test/dirty.CallByName <ReflectMethod> -> reflect.Value.Call",
    "reflect.test/clean.init -> fmt.init",
    "go:string.x -> reflect.test/clean.init",
    "type:*a/b.T -> type:*a/b.U",
    "a/c.F -> type:*a/b.T",
    "no arrow here",
]


def test_dead_code(spark):
    dump = spark.createDataFrame([(x,) for x in DUMP], "line string")
    _, edges = deadcode.parse_dump(dump)
    assert {(r["source"], r["target"]) for r in edges.collect()} == {("main.main", "reflect.test/dirty.CallByName"), ("reflect.test/dirty.CallByName", "reflect.Value.Call"), ("reflect.test/clean.init", "fmt.init")}
    assert {r["package"] for r in deadcode.blocked_packages(dump).collect()} == {"main", "reflect.test/dirty"}
    assert one(spark, package_of_symbol(F.lit("a.b/c"))) == "" and one(spark, package_of_type(F.lit("type:**a/b.T"))) == "a/b"
    assert one(spark, is_linker_data(F.lit("x.f.arginfo1"))) and not one(spark, is_linker_data(F.lit("x.f")))


def test_arguments(spark):
    args = ["/go/compile.exe", "-o", "out.a", "-p", "a/b", "-I", "x.go", "-std", "a.go", "b.s", "c.md"]
    i = one(spark, execlog.classify(F.array(*map(F.lit, args))))
    assert (i["command"], i["package"], i["output"], i["inputs"]) == ("compile", "a/b", "out.a", ["a.go", "b.s"])


def test_templates(spark):
    field = lambda p: {"ID": F.lit("a/b"), "N": F.lit(1500), "Files": F.array(F.lit("x"), F.lit("y")), "Zero": F.lit(0)}[p]
    for text, want in [("{{.ID}}-{{.N}}", "a/b-1500"), ('{{rel "a" .ID}}', "./b"), ("{{div .N 1000 | round | int}}", "2"), ('{{printf "%05.1f|%s" (div .N 1000) .ID}}', "001.5|a/b"), ("{{if .Zero}}y{{else}}n{{end}}", "n"), ("{{range .Files}}<{{.}}>{{end}}", "<x><y>"), ("{{with .ID}}[{{.}}]{{end}}", "[a/b]"), ("{{len .Files}}", "2")]:
        assert one(spark, compile_template(text, field)) == want, text
    assert header_of("{{.ID}}\t{{ .Stat.Go.Lines }}") == "ID\tStat.Go.Lines"
    rows = spark.createDataFrame([(1, "a\tb"), (2, "ccc\td")], "n int, line string")
    assert lines_of(reports.aligned(rows, None, ["n"])) == ["a     b", "ccc   d"]


def test_colors(spark):
    import colorsys
    import hashlib

    for path in ("a/b", "acme.test/x", "z"):
        hue = int(hashlib.sha256(path.encode()).hexdigest()[:4], 16) / 65535
        want = "#" + "".join(f"{int(c * 255 + 1e-9):02x}" for c in colorsys.hls_to_rgb(hue, 0.3, 0.9)) + f"{int(0.7 * 255):02x}"
        got = one(spark, S.path_color(F.lit(path), 0.9, 0.3, 0.7))
        assert all(abs(int(got[k : k + 2], 16) - int(want[k : k + 2], 16)) <= 1 for k in (1, 3, 5, 7))
