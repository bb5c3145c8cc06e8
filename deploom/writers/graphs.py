"""Graph formats as string columns; only the final numbering of a report is a global order.

Rows carry (part, k1, k2, k3) as their place: header, per-node and per-edge lines sort by it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import path_color
from ..functions.template import compile_template
from ..operators.stats import Graph, declarations_total
from ..plans.lineage import materialise
from ..plans.numbering import in_order
from ..schema import STAT_FIELDS

DOCS = "https://pkg.go.dev/"

#: Fixed values: (saturation, lightness, alpha) of the formats.
DOT, GRAPHML, MERMAID_FILL, MERMAID_STROKE = (0.9, 0.3, 0.7), (0.6, 0.6, None), (0.6, 0.7, 0.6), (0.6, 0.3, 0.8)

#: CSS names that the XML format writes as hex.
CSS = {"black": "#000000", "white": "#ffffff", "red": "#ff0000", "green": "#008000", "blue": "#0000ff", "yellow": "#ffff00", "orange": "#ffa500", "purple": "#800080", "gray": "#808080", "grey": "#808080", "pink": "#ffc0cb", "brown": "#a52a2a", "cyan": "#00ffff", "magenta": "#ff00ff", "lime": "#00ff00", "navy": "#000080", "teal": "#008080", "olive": "#808000", "maroon": "#800000", "silver": "#c0c0c0"}


def node_field(df: DataFrame):
    """Template paths to columns of a node table; sizes are numbers, shown with their unit."""
    from ..functions.scalars import mem_string

    names = {"ID": "id", "PkgPath": "pkg_path", "Name": "name", "Module.Path": "module_path", "InDegree": "in_degree", "OutDegree": "out_degree", "Color": "color"}
    for prefix, start in (("Stat.", ""), ("Up.", "up_"), ("Down.", "down_"), ("Cut.", "cut_")):
        names |= {prefix + path: start + c for c, path in STAT_FIELDS.items()}

    def field(path: str) -> Column:
        if path.startswith("Package."):
            path = path[8:]
        for prefix, start in (("Stat.", ""), ("Up.", "up_"), ("Down.", "down_"), ("Cut.", "cut_")):
            if path == prefix + "Decls.Total":
                return declarations_total(df, start)
            if path.startswith(prefix + "AllFiles."):
                part = path.rpartition(".")[2].lower()
                total = sum((F.coalesce(c, F.lit(0)) for c in (f"{start}go_{part}", f"{start}other_{part}") if c in df.columns), F.lit(0))
                return (total, mem_string(total)) if part == "size" else total
        column = names.get(path)
        if column is None or column not in df.columns:
            if column is None:
                raise ValueError(f"unknown field {path!r}")
            return F.lit(0) if path not in ("PkgPath", "Color") else F.col("id") if path == "PkgPath" else F.lit("")
        return (F.col(column), mem_string(F.col(column))) if path.endswith(".Size") else F.col(column)

    field.frame = df
    return field


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def numbered(*parts: DataFrame) -> DataFrame:
    """Lines in report order."""
    rows = reduce(DataFrame.unionByName, parts)
    return in_order(rows, ["part", "k1", "k2", "k3"]).select("line_no", "line")


def _lines(df: DataFrame, part: int, line: Column, k1=None, k2=None, k3=None) -> DataFrame:
    text = lambda k: F.lit("") if k is None else k
    return df.select(F.lit(part).alias("part"), text(k1).alias("k1"), text(k2).alias("k2"), (F.lit(0) if k3 is None else k3).cast("bigint").alias("k3"), line.alias("line"))


def fixed(spark, part: int, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([(part, "", "", i, x) for i, x in enumerate(lines)], "part int, k1 string, k2 string, k3 bigint, line string")


def labelled(graph: Graph, template: str, colors: list | None = None, **shades: Column) -> DataFrame:
    """Nodes with their label, colour override (of several (colour, set) the last that holds a node wins) and ``shades``, written once."""
    nodes = graph.nodes()
    color = F.lit("")
    for i, (name, members) in enumerate(colors or []):
        nodes = nodes.join(members.ids().withColumn(f"__c{i}", F.lit(name)), "id", "left")
    if colors:
        color = F.coalesce(*[F.col(f"__c{i}") for i in reversed(range(len(colors)))], F.lit(""))
    path = F.col("pkg_path") if "pkg_path" in nodes.columns else F.col("id")
    rows = nodes.select("id", path.alias("pkg_path"), "module_path", color.alias("color"), compile_template(template, node_field(nodes)).alias("label"))
    rows = rows.withColumns(shades) if shades else rows
    return materialise(rows, "labelled")  # each part of a report reads it, and so does the sampling for its order


def _color(preset, nocolor: bool, path="pkg_path", own="color") -> Column:
    plain = F.lit("") if nocolor else path_color(F.col(path), *preset)
    return F.when(F.col(own) != "", F.col(own)).otherwise(plain)


def _ends(graph: Graph, nodes: DataFrame, src: tuple[str, ...] = (), dst: tuple[str, ...] = ()) -> DataFrame:
    """Edges with what lines need of both ends (all of them members); an end of which nothing is needed is not joined."""
    out = graph.edges()
    for end, columns in (("src", src), ("dst", dst)):
        if columns:
            out = out.join(nodes.select(F.col("id").alias(end), *[F.col("pkg_path" if c == "path" else c).alias(f"{end}_{c}") for c in columns]), end)
    return out


def edges(graph: Graph, template: str = "{{.ID}}") -> DataFrame:
    ends = _ends(graph, labelled(graph, template), ("label",), ("label",))
    return numbered(_lines(ends, 0, F.concat_ws(" ", "src_label", "dst_label"), F.col("src"), F.col("dst")))


def digraph(graph: Graph, template: str = "{{.ID}}") -> DataFrame:
    nodes = labelled(graph, template)
    below = _ends(graph, nodes, dst=("label",)).groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("dst", "dst_label"))), lambda x: x["dst_label"]).alias("below"))
    rows = nodes.join(below, nodes["id"] == below["src"], "left")
    line = F.when(F.col("below").isNull(), F.col("label")).otherwise(F.concat(F.col("label"), F.lit(" "), F.array_join("below", " ")))
    return numbered(_lines(rows, 0, line, F.col("id")))


def tgf(graph: Graph, template: str = "{{.ID}}") -> DataFrame:
    nodes = in_order(labelled(graph, template), ["id"], "n").withColumn("n", F.col("n").cast("string"))
    ends = graph.edges().join(nodes.select(F.col("id").alias("src"), F.col("n").alias("a")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("n").alias("b")), "dst")
    spark = nodes.sparkSession
    return numbered(_lines(nodes, 0, F.concat_ws(" ", "n", "label"), F.col("id")), fixed(spark, 1, ["#"]), _lines(ends, 2, F.concat_ws(" ", "a", "b"), F.col("src"), F.col("dst")))


def mermaid(graph: Graph, template: str = "{{.ID}}", docs: str = DOCS, nocolor: bool = False, colors=None) -> DataFrame:
    nodes = labelled(graph, template, colors)
    key = lambda c: F.regexp_replace(c, "[^a-zA-Z0-9]+", "_")
    pad = F.lit("    ")
    n = key(F.col("id"))
    rows = [fixed(nodes.sparkSession, 0, ["flowchart LR"]), _lines(nodes, 1, F.concat(pad, n, F.lit("["), quoted(F.col("label")), F.lit("]")), F.col("id"), k3=F.lit(0)), _lines(nodes, 1, F.concat(pad, F.lit("click "), n, F.lit(" "), quoted(F.concat(F.lit(docs), "id")), F.lit(" _blank")), F.col("id"), k3=F.lit(1))]
    fill = nodes.withColumn("shade", _color(MERMAID_FILL, nocolor)).where("shade <> ''")
    rows.append(_lines(fill, 1, F.concat(pad, F.lit("style "), n, F.lit(" fill:"), F.col("shade")), F.col("id"), k3=F.lit(2)))
    ends = in_order(_ends(graph, nodes, dst=() if nocolor and not colors else ("path", "color")), ["src", "dst"], "link").withColumn("link", (F.col("link") - 1).cast("string"))
    rows.append(_lines(ends, 2, F.concat(pad, key(F.col("src")), F.lit(" --> "), key(F.col("dst"))), F.col("src"), F.col("dst"), F.lit(0)))
    if "dst_color" not in ends.columns:  # no shades
        return numbered(*rows)
    stroke = ends.withColumn("shade", _color(MERMAID_STROKE, nocolor, "dst_path", "dst_color")).where("shade <> ''")
    rows.append(_lines(stroke, 2, F.concat(pad, F.lit("linkStyle "), F.col("link"), F.lit(" stroke:"), F.col("shade")), F.col("src"), F.col("dst"), F.lit(1)))
    return numbered(*rows)


def _dot_color(nocolor: bool) -> Column:
    c = _color(DOT, nocolor)
    return F.when(c == "", "").otherwise(F.concat(F.lit('color="'), c, F.lit('"')))


def _dot_head(nocolor: bool) -> list[str]:
    pen = "" if nocolor else "penwidth=2 "
    return [
        "digraph G {",
        f'    node [{pen}fontsize=10 shape=rectangle target="_graphviz"];',
        "    edge [tailport=e];" if nocolor else "    edge [tailport=e penwidth=2];",
        "    compound=true;",
        "    rankdir=LR;",
        "    newrank=true;",
        '    ranksep="1.5";',
        '    quantum="0.5";',
    ]


DOT_LABEL = r"{{.ID}}\l{{ .Stat.Go.Lines }} / {{ .Stat.Go.Size }}\l"


def dot(graph: Graph, template: str = DOT_LABEL, docs: str = DOCS, nocolor: bool = False, colors=None) -> DataFrame:
    nodes = labelled(graph, template, colors, shade=_dot_color(nocolor))
    spark = nodes.sparkSession
    node = F.concat(F.lit("    "), quoted(F.col("id")), F.lit(' [label="'), F.col("label"), F.lit('" href='), quoted(F.concat(F.lit(docs), "id")), F.lit(" "), F.col("shade"), F.lit("];"))
    edge = F.concat(F.lit("    "), quoted(F.col("src")), F.lit(" -> "), quoted(F.col("dst")), F.lit(" ["), F.col("dst_shade"), F.lit("];"))
    return numbered(fixed(spark, 0, _dot_head(nocolor)), _lines(nodes, 1, node, F.col("id")), _lines(_shaded(graph, nodes, nocolor and not colors), 2, edge, F.col("src"), F.col("dst")), fixed(spark, 3, ["}"]))


def _shaded(graph: Graph, nodes: DataFrame, plain: bool) -> DataFrame:
    """Edges with the shade of their end, empty in plain reports."""
    if plain:
        return graph.edges().withColumn("dst_shade", F.lit(""))
    return _ends(graph, nodes, dst=("shade",))


def dot_clusters(graph: Graph, template: str = DOT_LABEL, docs: str = DOCS, nocolor: bool = False, short: bool = False, colors=None) -> DataFrame:
    """Nodes nested in their module's subgraph (and the repository's, where that has other modules)."""
    levels = graph.module_tree()
    nodes = labelled(graph, template, colors, shade=_dot_color(nocolor)).drop("module_path").join(materialise(levels, "modules"), "id")
    if short:
        inner = F.when(F.col("module_path").isNotNull() & F.col("id").startswith(F.concat("module_path", F.lit("/"))), F.expr("substring(id, length(module_path) + 2)")).otherwise(F.col("id"))
        nodes = nodes.withColumn("label", F.replace("label", F.col("id"), inner))
    spark = nodes.sparkSession
    nodes = nodes.withColumn("is_module", F.coalesce(F.col("id") == F.col("module_path"), F.lit(False)))
    c = F.col("shade")
    hub = F.concat(F.lit("    "), quoted(F.col("id")), F.lit(' [label="" tooltip="'), F.col("id"), F.lit('" shape='), F.when(F.col("only_child"), "point").otherwise("circle"), F.lit(" "), c, F.lit(" rank=0];"))
    plain = F.concat(F.lit("    "), quoted(F.col("id")), F.lit(' [label="'), F.col("label"), F.lit('" tooltip="'), F.col("id"), F.lit('" href='), quoted(F.concat(F.lit(docs), "id")), F.lit(" "), c, F.lit("];"))
    place = F.coalesce("module_path", F.lit(""))
    rows = [fixed(spark, 0, _dot_head(nocolor)), _lines(nodes, 1, F.when(F.col("is_module"), hub).otherwise(plain), F.concat(F.col("repo_root"), F.lit("\x01"), place, F.lit("\x02"), "id"), k3=F.lit(0))]
    repos = nodes.where(F.col("module_path").isNotNull() & ~F.col("single_module")).select("repo_root").distinct()
    name = F.col("repo_root")
    for i, line in enumerate((F.concat(F.lit("subgraph "), quoted(F.concat(F.lit("cluster_"), name)), F.lit(" {")), F.concat(F.lit('    label="'), name, F.lit('"')), F.concat(F.lit('    tooltip="'), name, F.lit('"')), F.concat(F.lit("    href="), quoted(F.concat(F.lit(docs), name))))):
        rows.append(_lines(repos, 1, line, name, k3=F.lit(i)))
    rows.append(_lines(repos, 1, F.lit("}"), F.concat(name, F.lit("\x7f"))))
    mods = nodes.where(F.col("module_path").isNotNull()).select("repo_root", "module_path", "module_label").distinct()
    title = F.col("module_label")
    at = F.concat("repo_root", F.lit("\x01"), "module_path")
    for i, line in enumerate((F.concat(F.lit("subgraph "), quoted(F.concat(F.lit("cluster_"), "module_path")), F.lit(" {")), F.concat(F.lit('    label="'), title, F.lit('"')), F.concat(F.lit('    tooltip="'), title, F.lit('"')), F.concat(F.lit("    href="), quoted(F.concat(F.lit(docs), "module_path", F.lit("@")))))):
        rows.append(_lines(mods, 1, line, at, k3=F.lit(i)))
    rows.append(_lines(mods, 1, F.lit("}"), F.concat(at, F.lit("\x03"))))
    hubs = nodes.select(F.col("id").alias("dst"), F.col("is_module").alias("hub"), F.col("module_path").alias("dst_module"), F.col("shade").alias("dst_shade"))
    ends = graph.edges().join(hubs, "dst").join(nodes.select(F.col("id").alias("src"), F.col("module_path").alias("src_module")), "src")
    head = F.when(F.col("hub") & ~F.col("src_module").eqNullSafe(F.col("dst_module")), F.concat(F.lit(" lhead="), quoted(F.concat(F.lit("cluster_"), "dst")))).otherwise("")
    edge = F.concat(F.lit("    "), quoted(F.col("src")), F.lit(" -> "), quoted(F.col("dst")), F.lit(' [tooltip="'), F.col("src"), F.lit(" -> "), F.col("dst"), F.lit('"'), head, F.lit(" "), F.col("dst_shade"), F.lit("];"))
    return numbered(*rows, _lines(ends, 2, edge, F.col("src"), F.col("dst")), fixed(spark, 3, ["}"]))


def escaped(c: Column) -> Column:
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;"), ("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def graphml(graph: Graph, template: str = "{{.ID}}", nocolor: bool = False, colors=None) -> DataFrame:
    c = _color(GRAPHML, nocolor)
    names = F.create_map(*[x for k, v in CSS.items() for x in (F.lit(k), F.lit(v))])
    nodes = labelled(graph, template, colors, shade=F.coalesce(F.try_element_at(names, F.lower(c)), c))
    spark = nodes.sparkSession
    label = escaped(F.col("label"))
    module = F.when(F.coalesce("module_path", F.lit("")) != "", F.concat(F.lit('<data key="module">'), escaped(F.col("module_path")), F.lit("</data>"))).otherwise("")
    shape = F.concat(F.lit('<data key="ynodelabel"><y:ShapeNode><y:Fill color="'), F.col("shade"), F.lit('" transparent="false" /><y:NodeLabel>'), label, F.lit("</y:NodeLabel></y:ShapeNode></data>"))
    node = F.concat(F.lit('\t\t<node id="'), escaped(F.col("id")), F.lit('">'), F.when(F.col("label") != "", F.concat(F.lit('<data key="label">'), label, F.lit("</data>"))).otherwise(""), module, F.when(F.col("label") != "", shape).otherwise(""), F.lit("</node>"))
    line = F.concat(F.lit('<data key="yedgelabel"><y:PolyLineEdge><y:LineStyle color="'), F.col("dst_shade"), F.lit('" type="line" width="1.0" /></y:PolyLineEdge></data>'))
    edge = F.concat(F.lit('\t\t<edge source="'), escaped(F.col("src")), F.lit('" target="'), escaped(F.col("dst")), F.lit('">'), F.when(F.col("src_label") != "", line).otherwise(""), F.lit("</edge>"))
    head = ['<graphml xmlns="http://graphml.graphdrawing.org/xmlns" xmlns:y="http://www.yworks.com/xml/graphml">', '\t<key for="node" id="label" attr.name="label" attr.type="string"></key>', '\t<key for="node" id="module" attr.name="module" attr.type="string"></key>', '\t<key for="node" id="ynodelabel" yfiles.type="nodegraphics"></key>', '\t<key for="edge" id="yedgelabel" yfiles.type="edgegraphics"></key>', '\t<graph edgedefault="directed">']
    return numbered(fixed(spark, 0, head), _lines(nodes, 1, node, F.col("id")), _lines(_ends(graph, nodes, ("label",), ("shade",)), 2, edge, F.col("src"), F.col("dst")), fixed(spark, 3, ["\t</graph>", "</graphml>"]))


WRITERS = {"dot": dot, "mermaid": mermaid, "graphml": graphml, "tgf": tgf, "edges": edges, "digraph": digraph}
