"""Expression trees to package sets: plans stay lazy but for the recursive operators."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import graph_ops as ops
from ..operators.sets import PackageSet, union_all
from ..plans.lineage import materialise
from ..sources.catalog import Catalog, Context
from .expr import Assign, Call, ExprError, Name, Select, Sequence, parse, simplify

UNION, SUBTRACT, INTERSECT = ("", "+", "add", "or"), ("-", "subtract", "exclude"), ("shared", "intersect")

SELECTORS = {"all": ops.closure, "import": ops.imports, "imp": ops.imports, "mod": ops.modules, "module": ops.modules, "source": ops.sources, "main": ops.mains}


class Evaluator:
    def __init__(self, catalog: Catalog, context: Context = Context(), default_pattern: str = "./...", compat_mod: bool = False):
        self.catalog, self.context, self.default, self.compat_mod = replace(catalog, loaded=[]), context, default_pattern, compat_mod
        self.variables: dict[str, PackageSet] = {}
        self.memo: dict[tuple, PackageSet] = {}

    def run(self, text: str) -> PackageSet:
        """Value of the last statement."""
        tree = parse(text)
        return self.value(simplify(tree if tree is not None else Name(self.default)), self.context)

    def value(self, node, context: Context) -> PackageSet:
        key = (str(node), context)
        if isinstance(node, (Assign, Sequence)) or key not in self.memo:
            out = self._value(node, context)
            if not isinstance(node, (Assign, Sequence)):
                self.memo[key] = out
            return out
        return self.memo[key]

    def _value(self, node, context):
        if isinstance(node, Sequence):
            for item in node.items:
                out = self.value(item, context)
            return out
        if isinstance(node, Assign):
            if node.name in self.variables:
                raise ExprError(f"{node.name} is assigned already")
            got = self.value(node.value, context)
            self.variables[node.name] = got = got.with_(materialise(got.members, "variable"))
            self.memo.clear()
            return got
        if isinstance(node, Name):
            return self.group([node], context)
        if isinstance(node, Select):
            return self.select(node, context)
        return self.call(node, context)

    def values(self, nodes, context) -> list[PackageSet]:
        """All arguments; the errors of several are reported together."""
        out, errors = [], []
        for n in nodes:
            try:
                out.append(self.value(n, context))
            except ExprError as e:
                errors.append(e)
        if len(errors) == 1:
            raise errors[0]
        if errors:
            raise ExprError("[" + " ".join(map(str, errors)) + "]")
        return out

    def load(self, patterns, context, tests=None) -> PackageSet:
        rows = self.catalog.load(patterns, context, tests)
        return PackageSet(rows.select("id", "variant"), self.catalog, rows)

    def group(self, names: list[Name], context) -> PackageSet:
        """Bare names: variables, and all patterns in one load."""
        sets = [self.variables[n.text] for n in names if n.text in self.variables]
        patterns = [n.text for n in names if n.text not in self.variables]
        return union_all(sets + ([self.load(patterns, context)] if patterns else []))

    def names(self, node) -> list[Name]:
        """The patterns of a union of nothing else, which are one load; empty for other expressions."""
        if isinstance(node, Name):
            return [] if node.text in self.variables else [node]
        if not isinstance(node, Call) or node.name.lower() not in UNION:
            return []
        parts = [self.names(a) for a in node.args]
        return [n for part in parts for n in part] if all(parts) else []

    def call(self, node: Call, context) -> PackageSet:
        name = node.name.lower()
        if "=" in name:
            if len(node.args) != 1:
                raise ExprError(f"{node.name} takes one argument")
            key, _, value = node.name.rpartition("=")
            return self.value(node.args[0], context.set(key, value))
        if not node.args:
            raise ExprError(f"{node.name} needs arguments")
        if name == "" and all(isinstance(a, Name) for a in node.args):
            return self.group(list(node.args), context)
        known = {*UNION, *SUBTRACT, *INTERSECT, "xor", "reach", "incoming", "transitive", "deadcode"}
        if name not in known:
            raise ExprError(f"unknown function {node.name!r}")
        names = self.names(node)
        if name in UNION and names:
            return self.group(names, context)
        args = self.values(node.args, context)
        if name in UNION:
            return union_all(args)
        if name in ("reach", "incoming"):
            if len(args) != 2:
                raise ExprError(f"{name} takes two arguments")
            return (ops.reach if name == "reach" else ops.incoming)(*args)
        if name in ("transitive", "deadcode"):
            if len(args) != 1:
                raise ExprError(f"{name} takes one argument")
            return (ops.transitive if name == "transitive" else ops.deadcode)(args[0])
        out = args[0]
        for other in args[1:]:
            out = out.subtract(other) if name in SUBTRACT else out.intersect(other) if name in INTERSECT else out.xor(other)
        return out

    def select(self, node: Select, context) -> PackageSet:
        sign = node.selector[0] if node.selector[0] in "+-" else ""
        name = node.selector[len(sign) :].lower()
        if name == "test":
            return self.test(node.inner, sign, context)
        inner = self.value(node.inner, context)
        if name == "nosource":
            found = inner.subtract(ops.sources(inner))
        elif name in SELECTORS:
            found = SELECTORS[name](inner)
        else:
            raise ExprError(f"unknown selector {node.selector!r}")
        if self.compat_mod and name in ("mod", "module"):
            return found
        return inner.union(found) if sign == "+" else inner.subtract(found) if sign == "-" else found

    def test(self, inner, sign, context) -> PackageSet:
        if isinstance(inner, Name):  # a bare name is loaded again
            if sign == "-":
                return self.load([inner.text], context, tests=False)
            with_tests = self.load([inner.text], context, tests=True)
            return with_tests if sign == "+" else ops.tests(with_tests)
        x = self.value(inner, context)
        variant = self.catalog.variant(context)
        again = self.catalog.packages.where(F.col("variant") == variant).join(x.ids(), "id", "left_semi").select("id", "variant")
        found = ops.tests(PackageSet(again, self.catalog))
        return x.union(found) if sign == "+" else x.subtract(found) if sign == "-" else found
