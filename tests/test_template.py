"""The formatting language: kinds of values, comparisons, branches, variables, builtins."""

import pytest
from pyspark.sql import functions as F

from deploom.functions.template import TemplateError, compile_template

ROW = "id string, n bigint, zero int, half double, yes boolean, no boolean, text string, none string, files array<string>, empty array<int>, sizes map<string,bigint>, rec struct<a:string,b:struct<c:bigint>>, recs array<struct<name:string,size:bigint>>"
DATA = ("a/b", 1500, 0, 0.5, True, False, "false", None, ["x", "y<z"], [], {"k": 7, "j": 1}, ("in", (3,)), [("p", 1), ("q", 2)])

CASES = [
    # truth follows the kind: the text "false" is true, zero and empty are not
    ("{{if .text}}y{{else}}n{{end}}{{if .zero}}y{{else}}n{{end}}{{if .no}}y{{else}}n{{end}}{{if .empty}}y{{else}}n{{end}}{{if .none}}y{{else}}n{{end}}{{if .rec}}y{{else}}n{{end}}{{if `0`}}y{{end}}", "ynnnnyy"),
    ("{{eq .n 1500}} {{eq .id `x` `a/b`}} {{ne .id `x`}} {{lt .zero 1}} {{le .half 0.5}} {{gt .id `a`}} {{ge 1 2}} {{eq .yes true}}", "true true true true true true false true"),
    ("{{and .n .text}} {{and .zero .text}} {{or .zero .id}} {{or .none .empty .half}} {{not .zero}} {{not .files}}", "false 0 a/b 0.5 true false"),
    ("{{if and .yes (or .no (gt .n 1000))}}big{{end}}", "big"),
    ("{{if .no}}a{{else if .zero}}b{{else if eq .id `a/b`}}c{{else}}d{{end}}", "c"),
    ("{{with .none}}{{.}}{{else with .id}}<{{.}}>{{end}}{{with .rec}}{{.a}}{{.b.c}}{{$.id}}{{end}}", "<a/b>in3a/b"),
    ("{{$x := 1}}{{$y := .id}}{{if .yes}}{{$x = 2}}{{$z := 5}}{{$z}}{{else}}{{$y = `no`}}{{end}}{{$x}}{{$y}}{{if .no}}{{$x = 9}}{{end}}{{$x}}", "52a/b2"),
    ("{{if $v := .n}}{{$v}}{{end}}{{with $w := .rec}}{{$w.b.c}}{{.a}}{{end}}", "15003in"),
    ("{{range $i, $f := .files}}{{if $i}}, {{end}}{{$i}}:{{$f}}{{end}}{{range .empty}}x{{else}} none{{end}}", "0:x, 1:y<z none"),
    ("{{range .recs}}{{.name}}={{.size}};{{end}}{{range $k, $v := .sizes}}{{$k}}{{$v}}{{end}}{{range 3}}{{.}}{{end}}", "p=1;q=2;j1k7012"),
    ("{{range $r := .recs}}{{range $.files}}{{$r.name}}{{.}} {{end}}{{end}}", "px py<z qx qy<z "),
    ("{{index .files 1}} {{index .sizes `k`}}{{index .sizes `absent`}} {{(index .recs 1).name}} {{index `abc` 1}}", "y<z 7 q 98"),
    ("{{slice .id 1}} {{slice .id 0 1}} {{slice .files 1 2}} {{slice `äb` 2}}", "/b a [y<z] b"),
    ("{{print .n 7 .id .yes .no}}|{{println .n .id}}|{{html (index .files 1)}}|{{urlquery `a b&*`}}", "1500 7a/btrue false|1500 a/b\n|y&lt;z|a+b%26%2A"),
    ("{{len .id}}{{len .files}}{{len .sizes}}{{len .empty}}{{len `ä`}}", "32202"),
    ("{{.files}} {{.sizes}} {{.rec}} {{.empty}} {{.none}}.", "[x y<z] map[j:1 k:7] {in {3}} [] ."),
    ('{{printf "%d|%5.2f|%-4s|%04d|%x|%q|%v|%t|%s|%%" .n .half .id .zero 255 .id .half .yes .files}}', '1500| 0.50|a/b |0000|ff|"a/b"|0.5|true|[x y<z]|%'),
    ("{{.n | printf `%d-%s` 3}}", "3-1500"),
    ("{{div 1 3}} {{mul 1000 1000}} {{mul 1000 999}} {{div 1 100000}} {{div 1 10000}} {{sub 0 2}} {{div 1 0}} {{div .n 7 | round}} {{float 123456.5}} {{mul 12345678 100}}", "0.3333333333333333 1e+06 999000 1e-05 0.0001 -2 +Inf 214 123456.5 1.2345678e+09"),
    ("a {{- /* nothing */ -}}  b{{/* x */}} {{`c` -}} \n d", "ab cd"),
    ("{{'a'}} {{0x1F}} {{1e3}} {{-4}} {{true}} {{\"q\\\"t\"}}", '97 31 1000 -4 true q"t'),
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([DATA], ROW)


def test_templates(frame):
    got = frame.select(*[compile_template(t, F.col, frame).alias(f"c{k}") for k, (t, _) in enumerate(CASES)]).first()
    for (text, want), value in zip(CASES, got):
        assert value == want, text


def test_kinds_without_a_frame(spark):
    """Literals tell their kind; a column that is not known is asked when it is resolved."""
    field = {"t": F.lit("false"), "z": F.lit(0), "unknown": F.col("text"), "number": F.col("zero")}.__getitem__
    row = spark.createDataFrame([DATA], ROW).select(compile_template("{{if .t}}y{{end}}{{if .z}}y{{end}}{{if .unknown}}y{{end}}{{if .number}}y{{end}}{{eq .unknown `false`}}", field)).first()
    assert row[0] == "yytrue"


def test_shown_sizes(frame):
    field = lambda path: (F.col("n"), F.concat(F.col("n").cast("string"), F.lit("B")))
    text = "{{.Size}} {{div .Size 1000}} {{if gt .Size 1000}}big{{end}} {{printf `%v` .Size}}"
    assert frame.select(compile_template(text, field, frame)).first()[0] == "1500B 1.5 big 1500B"


@pytest.mark.parametrize("text", ["{{if .n}}", "{{end}}", "{{.n", "{{nope .n}}", "{{eq .n `x`}}", "{{lt .yes .no}}", "{{$x}}", "{{$x = 1}}", "{{range .n}}{{else if}}{{end}}", "{{range .yes}}{{end}}", "{{len .n}}", "{{rel .id .id}}", "{{printf .id}}", "{{printf `%d`}}", "{{(.n}}", "{{if .n}}{{else while .n}}{{end}}", "{{$x := 1}}{{range .files}}{{$x = 2}}{{end}}", "{{$x := 1}}{{if .n}}{{$x = `a`}}{{end}}", "{{.n 1}}", "{{}}", "{{eq .files .files}}", "{{with .rec}}{{.z}}{{end}}"])
def test_mistakes(frame, text):
    if text == "{{.n":  # no action at all
        assert frame.select(compile_template(text, F.col, frame)).first()[0] == text
    elif text == "{{}}":
        assert frame.select(compile_template(text, F.col, frame)).first()[0] == ""
    else:
        with pytest.raises(TemplateError):
            compile_template(text, F.col, frame)


def test_places_out_of_range(frame):
    for text in ("{{index .files 2}}", "{{index .files -1}}", "{{slice .id 2 1}}", "{{slice .files 3}}"):
        with pytest.raises(Exception):
            frame.select(compile_template(text, F.col, frame)).collect()
