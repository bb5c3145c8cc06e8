"""The formatting language, compiled to one column.

Every value has a kind (text, int, float, bool, list, map, record), known from the columns' types
while compiling: it decides what is true, what may be compared, and how a value is printed.
Supported: text, comments, trim marks, fields, literals, calls, pipelines and parentheses;
``if``/``else if``/``else``, ``with`` and ``range`` (with ``else``), variables; the functions
``and or not eq ne lt le gt ge len index slice print printf println html urlquery json`` and those
of ``NUMERIC``, ``rel`` and ``rename``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scalars as S

_TOKEN = re.compile(r"""\s*("(?:[^"\\]|\\.)*"|`[^`]*`|'(?:[^'\\]|\\.)'|\(|\)|\||,|:=|=|-?0[xX][0-9a-fA-F]+|-?[0-9]+(?:\.[0-9]*)?(?:[eE][-+]?[0-9]+)?|\$?[.A-Za-z_0-9]+|\$)""")


#: In front of a field that belongs to the parenthesis right before it.
_OF = ")."


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Value:
    """A column with its type; ``shown``: how it is printed, where not as itself; ``plain``: a literal's value."""

    col: Column
    type: T.DataType | None
    shown: Column | None = None
    plain: object = None
    truth: Column | None = None

    @property
    def kind(self) -> str:
        for kind, types in (("text", (T.StringType, T.VarcharType, T.CharType)), ("bool", (T.BooleanType,)), ("int", (T.IntegralType,)), ("float", (T.FractionalType,)), ("list", (T.ArrayType,)), ("map", (T.MapType,)), ("record", (T.StructType,)), ("time", (T.TimestampType, T.TimestampNTZType, T.DateType)), ("none", (T.NullType,))):
            if isinstance(self.type, types):
                return kind
        return "any"

    def part(self, path: str) -> "Value":
        out = self
        for name in filter(None, path.split(".")):
            if out.kind == "record" and name in out.type.fieldNames():
                out = Value(out.col.getField(name), out.type[name].dataType)
            elif out.kind == "map":
                out = Value(F.try_element_at(out.col, F.lit(name)), out.type.valueType)
            elif out.kind == "any":
                out = Value(out.col[name], None)
            else:
                raise TemplateError(f"no field {name!r} in a value of kind {out.kind}")
        return out

    def text(self) -> Column:
        """As printed: floats without needless digits, lists and maps in brackets; nothing for null."""
        if self.shown is not None:
            return F.coalesce(self.shown, F.lit(""))
        c = self.col
        if self.kind == "float":
            c = float_text(c.cast("double"))
        elif self.kind == "list":
            c = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: Value(x, self.type.elementType).text()), " "), F.lit("]"))
        elif self.kind == "map":
            pairs = F.array_sort(F.map_entries(c))
            c = F.concat(F.lit("map["), F.array_join(F.transform(pairs, lambda p: F.concat(Value(p["key"], self.type.keyType).text(), F.lit(":"), Value(p["value"], self.type.valueType).text())), " "), F.lit("]"))
        elif self.kind == "record":
            c = F.concat(F.lit("{"), F.concat_ws(" ", *[self.part(n).text() for n in self.type.fieldNames()]), F.lit("}"))
        return F.coalesce(c.cast("string"), F.lit(""))

    def true(self) -> Column:
        """Whether a value is set: not zero, empty or null; a record always is."""
        if self.truth is not None:
            return self.truth
        c = {"text": lambda: self.col != "", "bool": lambda: self.col, "int": lambda: self.col != 0, "float": lambda: self.col != 0, "list": lambda: F.size(self.col) > 0, "map": lambda: F.size(self.col) > 0, "record": lambda: self.col.isNotNull(), "time": lambda: self.col.isNotNull(), "none": lambda: F.lit(False)}
        if self.kind == "any":  # its type is only known when it is resolved
            s, kind = self.col.cast("string"), F.typeof(self.col)
            return F.coalesce(F.when(kind == "string", s != "").when(kind == "boolean", s == "true").when(kind.startswith("array") | kind.startswith("map"), ~s.isin("[]", "{}")).when(kind.startswith("struct"), self.col.isNotNull()).otherwise(s.try_cast("double") != 0), F.lit(False))
        return F.coalesce(c[self.kind](), F.lit(False))


def float_text(v: Column) -> Column:
    """The shortest digits that give the number back; with an exponent below 1e-4 and from 1e6 on."""
    s = F.abs(v).cast("string")
    mantissa = F.regexp_extract(s, r"^([0-9.]+)", 1)
    digits = F.regexp_replace(F.regexp_replace(F.replace(mantissa, F.lit(".")), "^0+", ""), "0+$", "")
    power = F.regexp_extract(s, "E(-?[0-9]+)$", 1).try_cast("int")
    whole = F.length(F.regexp_extract(s, "^([0-9]+)", 1)) - 1
    exponent = F.coalesce(power, whole)
    tail = F.substr(digits, F.lit(2))
    scientific = F.concat(F.substring(digits, 1, 1), F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(""), F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.format_string("%02d", F.abs(exponent)))
    plain = F.when(power == -4, F.concat(F.lit("0.000"), digits)).otherwise(F.regexp_replace(s, r"\.0$", ""))
    out = F.when((exponent < -4) | (exponent >= 6), scientific).otherwise(plain)
    signed = F.concat(F.when((v < 0) | (v.cast("string") == "-0.0"), "-").otherwise(""), out)
    return F.when(F.isnan(v), "NaN").when(F.abs(v) == float("inf"), F.when(v > 0, "+Inf").otherwise("-Inf")).otherwise(signed)


def _literal(x) -> Value:
    kind = T.BooleanType() if isinstance(x, bool) else T.LongType() if isinstance(x, int) else T.DoubleType() if isinstance(x, float) else T.StringType()
    return Value(F.lit(x).cast(kind), kind, plain=x)


def compile_template(text: str, field, frame: DataFrame | None = None) -> Column:
    """``field(path)`` gives the column of a dotted path, e.g. field("Stat.Go.Lines"), or (column, how it is printed).

    ``frame``: the rows that the columns belong to (by default ``field.frame``), from which their
    types are known; without it they are those that can be told from the columns alone.
    """
    return _Compiler(field, frame if frame is not None else getattr(field, "frame", None)).run(text)


class _Compiler:
    def __init__(self, field, frame):
        self.field = field
        self.frame = frame if frame is not None else SparkSession.getActiveSession().range(1)
        self.known: dict[str, Value] = {}

    def run(self, text: str) -> Column:
        parts = _split(text)
        out, at, _ = self.block(parts, 0, None, {})
        if at != len(parts):
            raise TemplateError("an end has no beginning")
        return out

    # -- values

    def typed(self, col: Column) -> Value:
        try:
            kind = self.frame.select(col).schema[0].dataType
        except AnalysisException:
            kind = None
        return Value(col, kind)

    def root(self, path: str) -> Value:
        if path not in self.known:
            got = self.field(path)
            col, shown = got if isinstance(got, tuple) else (got, None)
            self.known[path] = replace(self.typed(col), shown=shown)
        return self.known[path]

    def operand(self, a, dot, env) -> Value:
        if isinstance(a, Value):
            return a
        if a[0] in "\"`":
            return _literal(_plain(a))
        if a[0] == "'":
            return _literal(ord(_plain('"' + a[1:-1] + '"')))
        if a[0] == "$":
            name, _, path = a[1:].partition(".")
            if not name:
                return self.root(path)
            if name not in env:
                raise TemplateError(f"undefined variable ${name}")
            return env[name].part(path)
        if a[0] == ".":
            return self.root(a[1:]) if dot is None else dot.part(a[1:])
        if a in ("true", "false"):
            return _literal(a == "true")
        if a == "nil":
            return Value(F.lit(None), T.NullType())
        try:
            return _literal(int(a, 0) if re.fullmatch(r"-?(0[xX][0-9a-fA-F]+|[0-9]+)", a) else float(a))
        except ValueError:
            raise TemplateError(f"unknown function {a!r}") from None

    # -- actions

    def block(self, parts, at, dot, env) -> tuple[Column, int, dict]:
        """Text of the parts from ``at`` to the ``else`` or ``end`` that closes them, where that is, and the variables then."""
        out, env = [F.lit("")], dict(env)
        while at < len(parts):
            kind, body = parts[at][0], parts[at][1]
            if kind == "text":
                out.append(F.lit(body))
            elif body and not body.startswith("/*"):
                word, _, rest = body.partition(" ")
                if word in ("end", "else"):
                    break
                if word in ("if", "with", "range"):
                    text, at, env = self.branch(word, rest, parts, at + 1, dot, env)
                    out.append(text)
                    continue
                name, sign, value = self.declared(body, dot, env)
                if sign == "=" and name not in env:
                    raise TemplateError(f"undefined variable ${name}")
                if sign:
                    env[name] = value
                else:
                    out.append(value.text())
            at += 1
        return F.concat(*out), at, env

    def declared(self, body, dot, env) -> tuple[str, str, Value]:
        """(name, := or =, value) of an assignment, or ("", "", value) of a plain pipeline."""
        tokens = _tokens(body)
        if len(tokens) > 2 and tokens[0][0] == "$" and tokens[1] in (":=", "="):
            return tokens[0][1:], tokens[1], self.pipeline(tokens[2:], dot, env)
        return "", "", self.pipeline(tokens, dot, env)

    def branch(self, word, rest, parts, at, dot, env):
        """An ``if``, ``with`` or ``range`` to behind its end."""
        if word == "range":
            return self.range(rest, parts, at, dot, env)
        name, _, value = self.declared(rest, dot, env)
        inner = env | ({name: value} if name else {})
        yes, at, then = self.block(parts, at, value if word == "with" else dot, inner)
        no, otherwise = F.lit(""), inner
        if at < len(parts) and parts[at][1].partition(" ")[0] == "else":
            following = parts[at][1].partition(" ")[2].strip()
            if following:
                again, _, more = following.partition(" ")
                if again not in ("if", "with"):
                    raise TemplateError(f"unexpected {following!r} after else")
                no, at, otherwise = self.branch(again, more, parts, at + 1, dot, inner)
                return self.joined(value, yes, no, env, then, otherwise, at)
            no, at, otherwise = self.block(parts, at + 1, dot, inner)
        at = self.closed(word, parts, at)
        return self.joined(value, yes, no, env, then, otherwise, at)

    def closed(self, word, parts, at) -> int:
        if at >= len(parts) or parts[at][1] != "end":
            raise TemplateError(f"{word} has no end")
        return at + 1

    def joined(self, value, yes, no, env, then, otherwise, at):
        """Both ways' text, and the variables of before with what either way has assigned to them."""
        test, out = value.true(), dict(env)
        for name in env:
            a, b = then.get(name), otherwise.get(name)
            if a is not b:
                if a.kind != b.kind:
                    raise TemplateError(f"${name} is of kind {a.kind} or {b.kind}")
                out[name] = Value(F.when(test, a.col).otherwise(b.col), a.type, F.when(test, a.text()).otherwise(b.text()) if a.shown is not None or b.shown is not None else None)
        return F.when(test, yes).otherwise(no), at, out

    def range(self, rest, parts, at, dot, env):
        tokens, names = _tokens(rest), []
        if ":=" in tokens:
            k = tokens.index(":=")
            names, tokens = [t[1:] for t in tokens[:k] if t != ","], tokens[k + 1 :]
        value = self.pipeline(tokens, dot, env)
        if value.kind == "map":
            entries, element = F.array_sort(F.map_entries(value.col)), value.type.valueType
            pick = lambda x, i: (Value(x["key"], value.type.keyType), Value(x["value"], element))
        elif value.kind == "int":
            top = value.col.cast("bigint")
            entries = F.when(top > 0, F.sequence(F.lit(0).cast("bigint"), top - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))
            pick = lambda x, i: (Value(x, T.LongType()), Value(x, T.LongType()))
        elif value.kind in ("list", "any"):
            entries = value.col
            pick = lambda x, i: (Value(i, T.IntegerType()), Value(x, value.type.elementType if value.type else None))
        else:
            raise TemplateError(f"cannot range over a value of kind {value.kind}")
        ends = {}

        def each(x, i):
            key, item = pick(x, i)
            inner = dict(env)
            if names:
                inner |= dict(zip(names, (key, item))) if len(names) > 1 else {names[0]: item if value.kind != "int" else key}
            text, ends["at"], then = self.block(parts, at, item, inner)
            if any(then[n] is not env[n] for n in env if n not in names):
                raise TemplateError("a variable from outside is assigned in a range")
            return text

        out = F.coalesce(F.array_join(F.transform(entries, each), ""), F.lit(""))
        at = ends["at"]
        if at < len(parts) and parts[at][1] == "else":
            no, at, _ = self.block(parts, at + 1, dot, env)
            out = F.when(F.coalesce(F.size(entries) > 0, F.lit(False)), out).otherwise(no)
        return out, self.closed("range", parts, at), env

    # -- pipelines

    def pipeline(self, tokens, dot, env) -> Value:
        value, at = self.pipe(tokens, 0, dot, env)
        if at != len(tokens):
            raise TemplateError(f"unexpected {tokens[at]!r}")
        return value

    def pipe(self, tokens, at, dot, env):
        value = None
        while True:
            args = []
            while at < len(tokens) and tokens[at] not in ("|", ")"):
                if tokens[at] == "(":
                    inner, at = self.pipe(tokens, at + 1, dot, env)
                    if at >= len(tokens) or tokens[at] != ")":
                        raise TemplateError("a parenthesis is not closed")
                    if at + 1 < len(tokens) and tokens[at + 1].startswith(_OF):
                        at += 1
                        inner = inner.part(tokens[at].removeprefix(_OF))
                    args.append(inner)
                else:
                    args.append(tokens[at])
                at += 1
            if not args:
                raise TemplateError("an empty command")
            value = self.command(args, value, dot, env)
            if at < len(tokens) and tokens[at] == "|":
                at += 1
                continue
            return value, at

    def command(self, args, piped, dot, env) -> Value:
        head, rest = args[0], args[1:]
        if isinstance(head, Value) or not (head[0].isalpha() and head not in ("true", "false", "nil")):
            if rest or piped is not None:
                raise TemplateError(f"{head!r} takes no arguments")
            return self.operand(head, dot, env)
        values = [self.operand(a, dot, env) for a in rest] + ([piped] if piped is not None else [])
        if head in NUMERIC:
            kind = T.LongType() if head == "int" else T.DoubleType()
            return Value(NUMERIC[head](*[v.col for v in values]), kind)
        rule = _RULES.get(head)
        if rule is None:
            raise TemplateError(f"unknown function {head!r}")
        return rule(*values)


# -- functions of values


def _need(values, least: int, name: str) -> None:
    if len(values) < least:
        raise TemplateError(f"{name} needs {least} arguments")


def _and_or(name: str):
    """The first value that decides, else the last; printed as itself, or only asked for its truth."""

    def rule(*values: Value) -> Value:
        _need(values, 1, name)

        def two(rest: Value, v: Value) -> Value:
            test = v.true() if name == "or" else ~v.true()
            truth = (v.true() | rest.true()) if name == "or" else (v.true() & rest.true())
            if v.kind == rest.kind != "any":
                return Value(F.when(test, v.col).otherwise(rest.col), v.type, F.when(test, v.text()).otherwise(rest.text()), truth=truth)
            shown = F.when(test, v.text()).otherwise(rest.text())
            return Value(shown, T.StringType(), shown, truth=truth)

        return reduce(two, reversed(values[:-1]), values[-1])

    return rule


def _ordered(a: Value, b: Value) -> tuple[Column, Column]:
    """Both as columns that compare like the values; kinds must be the same."""
    kinds = {a.kind, b.kind} - {"any"}
    if not kinds:
        return a.col, b.col
    if len(kinds) > 1:
        raise TemplateError(f"values of kinds {a.kind} and {b.kind} cannot be compared")
    kind = kinds.pop()
    if kind not in ("text", "int", "float", "bool", "time"):
        raise TemplateError(f"a value of kind {kind} cannot be compared")
    name = {"text": "string", "int": "bigint", "float": "double", "bool": "boolean", "time": "timestamp"}[kind]
    return tuple(v.col if v.kind != "any" else v.col.try_cast(name) for v in (a, b))


def _flag(c: Column) -> Value:
    return Value(F.coalesce(c, F.lit(False)), T.BooleanType())


def _eq(*values: Value) -> Value:
    _need(values, 2, "eq")
    pairs = [_ordered(values[0], v) for v in values[1:]]
    return _flag(reduce(lambda x, y: x | y, [a.eqNullSafe(b) & ~(F.isnan(a) if values[0].kind == "float" else F.lit(False)) for a, b in pairs]))


def _compare(name: str, test):
    def rule(*values: Value) -> Value:
        if len(values) != 2:
            raise TemplateError(f"{name} needs 2 arguments")
        if "bool" in (values[0].kind, values[1].kind):
            raise TemplateError("booleans have no order")
        a, b = _ordered(*values)
        out = test(a, b)
        if values[0].kind == "float":  # nothing is less or greater than NaN
            out = out & ~F.isnan(a) & ~F.isnan(b)
        return _flag(out)

    return rule


def _ne(*values: Value) -> Value:
    if len(values) != 2:
        raise TemplateError("ne needs 2 arguments")
    return _flag(~_eq(*values).col)


def _not(*values: Value) -> Value:
    _need(values, 1, "not")
    return _flag(~values[0].true())


def _len(*values: Value) -> Value:
    _need(values, 1, "len")
    v = values[0]
    if v.kind not in ("text", "list", "map", "any"):
        raise TemplateError(f"a value of kind {v.kind} has no length")
    n = F.octet_length(v.col) if v.kind == "text" else F.size(v.col)
    return Value(F.coalesce(F.greatest(n, F.lit(0)), F.lit(0)).cast("bigint"), T.LongType())


def _index(*values: Value) -> Value:
    """Elements of lists from 0, which must be there; of maps by key, nothing if absent; bytes of texts."""
    _need(values, 1, "index")
    out = values[0]
    for i in values[1:]:
        if out.kind == "map":
            out = Value(F.try_element_at(out.col, i.col.cast(out.type.keyType)), out.type.valueType)
        elif out.kind in ("list", "any"):
            if i.kind not in ("int", "any"):
                raise TemplateError("a list is indexed by an integer")
            out = Value(F.element_at(out.col, (F.when(i.col < 0, F.lit(1 << 30)).otherwise(i.col) + 1).cast("int")), out.type.elementType if out.type else None)
        elif out.kind == "text":
            out = Value(F.conv(F.hex(F.substr(out.col.cast("binary"), i.col.cast("int") + 1, F.lit(1))), 16, 10).cast("bigint"), T.LongType())
        else:
            raise TemplateError(f"a value of kind {out.kind} cannot be indexed")
    return out


def _slice(*values: Value) -> Value:
    """A part of a text (in bytes) or list, from one place to another."""
    _need(values, 1, "slice")
    v, cuts = values[0], [i.col.cast("int") for i in values[1:]]
    if v.kind not in ("text", "list") or len(cuts) > 2:
        raise TemplateError("slice takes a text or list and up to two places")
    size = F.octet_length(v.col) if v.kind == "text" else F.size(v.col)
    first, last = cuts[0] if cuts else F.lit(0), cuts[1] if len(cuts) > 1 else size
    bad = (first < 0) | (last < first) | (last > size)
    if v.kind == "text":
        part = F.decode(F.substr(v.col.cast("binary"), first + 1, last - first), "UTF-8")
    else:
        part = F.slice(v.col, first + 1, last - first)
    return Value(F.when(bad, F.raise_error(F.lit("slice out of range"))).otherwise(part), v.type)


def _print(*values: Value) -> Value:
    """Values one after another, with a space between two that are no texts."""
    out = []
    for k, v in enumerate(values):
        if k and v.kind != "text" and values[k - 1].kind != "text":
            out.append(F.lit(" "))
        out.append(v.text())
    return Value(F.concat(F.lit(""), *out), T.StringType())


def _println(*values: Value) -> Value:
    return Value(F.concat(F.concat_ws(" ", *[v.text() for v in values]), F.lit("\n")), T.StringType())


def _printf(*values: Value) -> Value:
    _need(values, 1, "printf")
    if not isinstance(values[0].plain, str):
        raise TemplateError("printf needs a literal format")
    rest, cells = list(values[1:]), []

    def one(m):
        flags, verb = m.group(1), m.group(2)
        if verb == "%":
            return "%%"
        if not rest:
            raise TemplateError(f"printf has no value for %{flags}{verb}")
        v = rest.pop(0)
        if verb in "dxXco":
            cells.append(v.col.cast("bigint") if verb != "c" else v.col.cast("int"))
            return f"%{flags}{verb}"
        if verb in "feEgG" and not (verb in "gG" and "." not in flags):
            digits = re.search(r"\.(\d+)", flags)
            number = S.to_float(v.col)
            cells.append(F.bround(number, int(digits.group(1))) if digits and verb == "f" else number)
            return f"%{flags}{verb}"
        if verb not in "svqtgG":
            raise TemplateError(f"unknown verb %{verb}")
        shown = v.text()
        if verb == "q":
            shown = F.concat(F.lit('"'), F.replace(F.replace(shown, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        cells.append(shown)
        return "%" + flags.translate({ord(c): None for c in "+#0 "} if not re.search(r"[1-9]", flags) else {ord(c): None for c in "+#"}) + "s"

    pattern = re.sub(r"%([-+ 0#]*[0-9]*(?:\.[0-9]+)?)([a-zA-Z%])", one, values[0].plain)
    return Value(F.format_string(pattern, *cells) if cells else F.lit(pattern.replace("%%", "%")), T.StringType())


def _html(*values: Value) -> Value:
    text = _print(*values).col
    for a, b in (("&", "&amp;"), ("'", "&#39;"), ('"', "&#34;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return Value(text, T.StringType())


def _urlquery(*values: Value) -> Value:
    return Value(F.replace(F.url_encode(_print(*values).col), F.lit("*"), F.lit("%2A")), T.StringType())


def _renaming(name: str):
    def rule(*values: Value) -> Value:
        _need(values, 2, name)
        texts = [v.plain for v in values[:-1]]
        if not all(isinstance(t, str) for t in texts):
            raise TemplateError(f"{name} needs literal prefixes")
        c = values[-1].col
        return Value(S.rel(texts[0], c) if name == "rel" else S.rename(c, *texts), T.StringType())

    return rule


NUMERIC = {"add": S.add, "sub": S.sub, "mul": S.mul, "div": S.div, "float": S.to_float, "int": S.to_int, "round": S.round_half_away, "log": S.log, "log2": S.log2, "log10": S.log10}
_RULES = {
    "and": _and_or("and"), "or": _and_or("or"), "not": _not,
    "eq": _eq, "ne": _ne, "lt": _compare("lt", lambda a, b: a < b), "le": _compare("le", lambda a, b: a <= b), "gt": _compare("gt", lambda a, b: a > b), "ge": _compare("ge", lambda a, b: a >= b),
    "len": _len, "index": _index, "slice": _slice, "print": _print, "println": _println, "printf": _printf, "html": _html, "urlquery": _urlquery,
    "rel": _renaming("rel"), "rename": _renaming("rename"), "json": lambda *v: Value(S.json(v[0].col), T.StringType()),
}


# -- reading


def _split(text):
    """("text", it) and ("action", body, whether it trims behind) in order."""
    out, at = [], 0
    for m in re.finditer(r"\{\{(-\s)?(.*?)(\s-)?\}\}", text, re.S):
        lead = text[at : m.start()]
        out.append(("text", lead.rstrip() if m.group(1) else lead))
        out.append(("action", m.group(2).strip(), bool(m.group(3))))
        at = m.end()
    out.append(("text", text[at:]))
    for k, part in enumerate(out):
        if part[0] == "action" and part[2]:
            out[k + 1] = ("text", out[k + 1][1].lstrip())
    return [p for p in out if p[0] == "action" or p[1]]


def _tokens(body: str) -> list[str]:
    out, at, body = [], 0, body.strip()
    while at < len(body):
        m = _TOKEN.match(body, at)
        if not m:
            raise TemplateError(f"cannot read {body[at:]!r}")
        field = m.group(1).startswith(".") and m.group(1) != "." and out and out[-1] == ")" and m.start(1) == at
        out.append(_OF + m.group(1) if field else m.group(1))
        at = m.end()
    if not out:
        raise TemplateError("an empty command")
    return out


def _plain(a: str) -> str:
    if a[0] == "`":
        return a[1:-1]
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m.group(1), m.group(1)), a[1:-1])
