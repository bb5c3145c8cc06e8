"""The analysed language's syntax, as far as statistics of a file need it: declarations, nodes of its syntax tree, errors.

A file is cut into tokens by one pattern; which sort each is makes its shape, on which all counts
depend.  Names, values and places matter to errors only, which are worked out behind.  The tree is
walked and counted while it is read and never held: each rule adds the nodes that stand for it.  As
counts do not depend on how operators bind, a chain of them is one loop.  After an error reading goes
on at the next line that begins a declaration.
"""

from __future__ import annotations

import re
from itertools import islice
from typing import NamedTuple

#: A token and the blanks before it; a line's end takes the blanks behind it along, what fits nothing else is one character.
_TOKEN = re.compile(
    r"""[ \t\r]*([^\W\d]\w*|\n[ \t\r]*|//[^\n]*|/\*.*?\*/
    |0[xX][\da-fA-F_]*(?:\.[\da-fA-F_]*)?(?:[pP][+-]?[\d_]+)?i?|0[bBoO][\d_]+i?|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?i?|`[^`]*`|"(?:[^"\\\n]|\\[^\n])*"|'(?:[^'\\\n]|\\[^\n])+'
    |<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|.)""",
    re.S | re.X,
)
#: Words of the language.
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_MARKS = "<<= >>= &^= ... && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^ - + * / % & | ^ < > = ! ( ) [ ] { } , ; . : ~".split()
#: Sorts of tokens that are no word or mark of the language; literals and comments add a line end for each they hold.
_NAME, _LITERAL, _LINE, _INDENTED, _COMMENT, _BLOCK, _ILLEGAL, _END = "a", "0", "\n", "\n ", "//", "/*", "?", ""
#: What a line may end with for its end to end the statement.
_ENDERS = frozenset((_NAME, _LITERAL, "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"))
_BINARY = frozenset("|| && == != < <= > >= + - | ^ * / % << >> & &^".split())
_ASSIGN = frozenset(":= = += -= |= ^= *= /= %= <<= >>= &= &^=".split())
_UNARY = frozenset("+ - ! ^ & ~ <- *".split())
_OPEN, _CLOSE = frozenset("([{"), frozenset(")]}")
#: What continues an operand.
_BEHIND = frozenset(". [ ( {".split())
_DECLARATIONS = {"func": "func", "type": "type", "const": "const", "var": "var", "import": "other"}
DECLS, TOKENS = ("func", "type", "const", "var", "other"), ("code", "comment", "basic")
#: Errors of a file that are listed.
MAX_ERRORS = 10
#: Tokens whose sorts a worker keeps, their most characters, tokens of the shapes it keeps, and most tokens of one.
_SORTS, _LONGEST, _KEPT, _LARGEST = 100_000, 64, 1_000_000, 4_096


class _Broken(Exception):
    pass


class _Sorts(dict):
    """The sort of each token's text; frequent texts are kept."""

    def __missing__(self, text: str) -> str:
        first = text[0]
        if first == "_" or first.isalnum() and not first.isdecimal():
            sort = _NAME
        elif first == "\n":
            sort = _INDENTED
        elif first.isdecimal() or len(text) > 1 and first != "/":
            sort = _LITERAL + "\n" * text.count("\n")
        elif len(text) > 1:
            sort = _COMMENT if text[1] == "/" else _BLOCK + "\n" * text.count("\n")
        else:
            sort = _ILLEGAL
        if len(text) <= _LONGEST:
            if len(self) >= _SORTS:
                self.clear()
                self.update(_FIXED)
            self[text] = sort
        return sort


_FIXED = {t: t for t in (*KEYWORDS, *_MARKS, _LINE)}
_sorts = _Sorts(_FIXED)


class _Reader:
    """Tokens of a shape: their sorts, lines and places in it, whether a comment group leads each and whether one ends its line."""

    def __init__(self, shape: tuple[str, ...]):
        self.shape, self.faults = shape, []
        self.sort, self.line, self.at, self.lead, self.trail = [], [], [], [], []
        self.here = 0
        self._tokens()

    def fault(self, line: int, at: int, message: str) -> None:
        if not self.faults or self.faults[-1][0] != line:  # one a line
            self.faults.append((line, at, message))

    def _comments(self, sort: str, line: int, comments: list) -> bool:
        """Marks the last token if a comment group ends its line; whether one leads the token to come."""
        k = 0
        if self.line and comments[0][0] == self.line[-1]:
            end = comments[0][1]
            k = 1
            while k < len(comments) and comments[k][0] <= end:
                end, k = comments[k][1], k + 1
            if (comments[k][0] if k < len(comments) else line) != end or sort == ";" or sort == _END:
                self.trail[-1] = True
        end = -1
        while k < len(comments):
            end, k = comments[k][1], k + 1
            while k < len(comments) and comments[k][0] <= end + 1:
                end, k = comments[k][1], k + 1
        return end + 1 == line

    def _tokens(self) -> None:
        sorts, lines, places, lead, trail = self.sort, self.line, self.at, self.lead, self.trail
        line, ends, comments = 1, False, []
        for at, sort in enumerate(self.shape):
            more = 0
            if sort not in _FIXED:
                if sort == _ILLEGAL:
                    self.fault(line, at, "")
                    ends = False
                    continue
                if sort != _NAME and sort != _INDENTED:
                    more = sort.count("\n")
                    if sort[0] == "/":
                        comments.append((line, line + more))
                        if not more:
                            continue
                        sort = _LINE
                    else:
                        sort = _LITERAL
            if sort == _LINE or sort == _INDENTED:
                if ends:
                    if comments and comments[0][0] == lines[-1]:
                        trail[-1] = True
                        comments = [c for c in comments if c[0] > comments[0][1]]
                    sorts.append(_LINE)
                    lines.append(line)
                    places.append(at)
                    lead.append(False)
                    trail.append(False)
                    ends = False
                line += more or 1
                continue
            led = False
            if comments:
                led, comments = self._comments(sort, line, comments), []
            sorts.append(sort)
            lines.append(line)
            places.append(at)
            lead.append(led)
            trail.append(False)
            ends = sort in _ENDERS
            line += more
        at = len(self.shape)
        if ends:
            sorts.append(_LINE)
            lines.append(line)
            places.append(at)
            lead.append(False)
            trail.append(False)
        led = self._comments(_END, line, comments) if comments else False
        sorts.append(_END)
        lines.append(line)
        places.append(at)
        lead.append(led)
        trail.append(False)


class _Shape(_Reader):
    """``decls`` and ``nodes`` of a shape, and its faults (line, place, message)."""

    def __init__(self, shape: tuple[str, ...]):
        super().__init__(shape)
        self.decls = dict.fromkeys(DECLS, 0)
        self.code = self.comment = self.basic = 0
        self.bare = 0  # in a header, a brace behind a name begins the block
        self._file()

    # -- tokens

    def see(self, *sorts: str) -> bool:
        return self.sort[self.here] in sorts

    def eat(self, sort: str) -> bool:
        if self.sort[self.here] == sort:
            self.here += 1
            return True
        return False

    def need(self, sort: str) -> None:
        if self.sort[self.here] != sort:
            self.fail(f"expected {sort!r}")
        self.here += 1

    def fail(self, message: str):
        """``message`` and what stands here instead, which only the file's text tells."""
        k = self.here
        found = {_END: "'EOF'", _LINE: "newline"}.get(self.sort[k], "%")
        self.fault(self.line[k], self.at[k], f"{message}, found {found}")
        raise _Broken

    def add(self, n: int = 1) -> None:
        self.code += n

    def name(self) -> None:
        if self.sort[self.here] != _NAME:
            self.fail("expected a name")
        self.here += 1
        self.code += 1

    def names(self) -> None:
        self.name()
        while self.eat(","):
            self.name()

    def led(self) -> None:
        self.comment += self.lead[self.here]

    def finish(self, *closers: str) -> bool:
        """The end of a statement, which a closing bracket may stand for; whether a comment follows on its line."""
        trailed, sort = self.trail[self.here - 1], self.sort[self.here]
        if sort == ";" or sort == _LINE:
            trailed = trailed or self.trail[self.here]
            self.here += 1
        elif sort not in closers and sort != _END:
            self.fail("expected the end of the statement")
        return trailed

    def matching(self, at: int) -> int:
        """The token behind the bracket that closes the one at ``at``."""
        depth = 0
        for k in range(at, len(self.sort)):
            sort = self.sort[k]
            if sort in _OPEN:
                depth += 1
            elif sort in _CLOSE:
                depth -= 1
                if not depth:
                    return k + 1
        return len(self.sort) - 1

    def list_of(self, item, close: str) -> None:
        while self.sort[self.here] != close:
            item()
            if not self.eat(","):
                break
        self.need(close)

    # -- declarations

    def _file(self) -> None:
        self.add()
        self.led()
        try:
            self.need("package")
            self.name()
            self.finish()
        except _Broken:
            return
        while self.sort[self.here] != _END and len(self.faults) < MAX_ERRORS:
            begin = self.here
            try:
                self._top()
            except (_Broken, RecursionError) as e:
                if isinstance(e, RecursionError):
                    self.fault(self.line[self.here], self.at[self.here], "nested too deeply")
                self._resume(begin + 1)

    def _resume(self, first: int) -> None:
        """On to the next line, from token ``first`` on, that begins with a declaration's word."""
        self.bare = 0
        self.here = max(self.here, min(first, len(self.at) - 1)) - 1
        while self.here < 0 or self.sort[self.here] != _END:
            self.here += 1
            if self.sort[self.here] in _DECLARATIONS and self.shape[self.at[self.here] - 1] == _LINE:
                return

    def _top(self) -> None:
        word = self.sort[self.here]
        if word == ";" or word == _LINE:
            self.here += 1
            return
        if word not in _DECLARATIONS:
            self.fail("expected a declaration")
        if word == "func":
            self.led()
            self.here += 1
            self.add()
            if self.see("("):
                self.parameters()
            self.name()
            if self.see("["):
                self.add()
                self.here += 1
                self.entries("]")
            self.signature()
            if self.see("{"):
                self.block()
            self.finish()
        else:
            self.general()
            self.finish()
        self.decls[_DECLARATIONS[word]] += 1

    def general(self) -> None:
        word = self.sort[self.here]
        self.led()
        self.here += 1
        self.add()
        spec = {"import": self._import, "type": self._type, "const": self._value, "var": self._value}[word]
        if self.eat("("):
            while not self.see(")"):
                self.led()
                spec()
                self.comment += self.finish(")")
            self.need(")")
        else:
            spec()
            self.comment += self.trail[self.here - 1]

    def _import(self) -> None:
        self.add()
        if self.eat("."):
            self.add()
        elif self.sort[self.here] == _NAME:
            self.name()
        if self.sort[self.here] != _LITERAL:
            self.fail("expected an import path")
        self.literal()

    def _value(self) -> None:
        self.add()
        self.names()
        if not self.see("=", ";", _LINE, ")", _END):
            self.type()
        if self.eat("="):
            self.expressions()

    def _type(self) -> None:
        self.add()
        self.name()
        if self.see("[") and self._type_parameters():
            self.add()
            self.here += 1
            self.entries("]")
        self.eat("=")
        self.type()

    def _type_parameters(self) -> bool:
        """Whether a bracket behind a type's name holds parameters and not an array's length."""
        k = self.here + 1
        if self.sort[k] != _NAME or self.sort[k + 1] == "]":
            return False
        return self.sort[k + 1] in (_NAME, ",", "[", "~", "interface", "func", "map", "chan", "struct")

    # -- types

    def literal(self) -> None:
        self.here += 1
        self.basic += 1

    def type(self) -> None:
        if not self.try_type():
            self.fail("expected a type")

    def try_type(self) -> bool:
        sort = self.sort[self.here]
        if sort == _NAME:
            self.name()
            if self.eat("."):
                self.add()
                self.name()
            if self.see("["):
                self.here += 1
                self.add()
                self.list_of(self.type, "]")
            return True
        if sort not in ("(", "[", "*", "<-", "func", "struct", "interface", "map", "chan"):
            return False
        self.here += 1
        self.add()
        if sort == "(":
            self.type()
            self.need(")")
        elif sort == "[":
            if self.eat("..."):
                self.add()
            elif not self.see("]"):
                self.inside(self.expression)
            self.need("]")
            self.type()
        elif sort == "*":
            self.type()
        elif sort in ("<-", "chan"):
            if sort == "<-":
                self.need("chan")
            else:
                self.eat("<-")
            self.type()
        elif sort == "map":
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif sort == "func":
            self.add(-1)
            self.signature()
        else:
            self.members(self._field if sort == "struct" else self._element)
        return True

    def members(self, member) -> None:
        """The list of fields or methods in braces."""
        self.need("{")
        self.add()
        while not self.see("}"):
            self.led()
            self.add()
            member()
            self.comment += self.finish("}")
        self.need("}")

    def _field(self) -> None:
        k = self.here
        if self.sort[k] == _NAME and self.sort[k + 1] not in (".", ";", _LINE, "}", _LITERAL) and not (self.sort[k + 1] == "[" and self._instance(k + 1)):
            self.names()
        self.type()
        if self.sort[self.here] == _LITERAL:
            self.literal()

    def _element(self) -> None:
        if self.sort[self.here] == _NAME and self.sort[self.here + 1] == "(":
            self.name()
            self.signature()
        else:
            self.constraint()

    def constraint(self) -> None:
        """Types joined by bars, some with a tilde."""
        while True:
            if self.eat("~"):
                self.add()
            self.type()
            if not self.eat("|"):
                return
            self.add()

    def _instance(self, at: int) -> bool:
        """Whether the bracket behind a name holds a generic type's arguments: no type follows it."""
        if self.sort[at + 1] == "]":
            return False
        return self.sort[self.matching(at)] in (",", ")", "]", ";", _LINE, "}", "{", _LITERAL, _END)

    def signature(self) -> None:
        self.add()
        if not self.see("("):
            self.fail("expected '('")
        self.parameters()
        if self.see("("):
            self.parameters()
        else:
            held = self.code
            if self.try_type():
                self.add(2)  # a list of one field
            else:
                self.code = held

    def parameters(self) -> None:
        self.need("(")
        self.add()
        self.entries(")")

    def entries(self, close: str) -> None:
        """Parameters: a field per type where some are named, else one per entry."""
        bare, typed = 0, 0

        def entry():
            nonlocal bare, typed
            k = self.here
            if self.sort[k] == _NAME and (following := self.sort[k + 1]) not in (",", ".", close) and not (following == "[" and self._instance(k + 1)) and not (close == "]" and following == "|"):
                self.name()
                typed += 1
            else:
                bare += 1
            if self.eat("..."):
                self.add()
                self.type()
            elif close == "]":
                self.constraint()
            else:
                self.type()

        self.inside(lambda: self.list_of(entry, close))
        self.add(typed or bare)

    # -- expressions

    def inside(self, rule) -> None:
        """Within brackets braces are literals again."""
        held, self.bare = self.bare, 0
        rule()
        self.bare = held

    def expressions(self) -> int:
        self.expression()
        n = 1
        while self.eat(","):
            self.expression()
            n += 1
        return n

    def expression(self) -> None:
        sorts = self.sort
        while True:
            sort = sorts[self.here]
            while sort in _UNARY and not (sort == "<-" and sorts[self.here + 1] == "chan"):
                self.here += 1
                self.code += 1
                sort = sorts[self.here]
            if sort == _NAME and sorts[self.here + 1] not in _BEHIND:
                self.here += 1
                self.code += 1
            else:
                self.primary()
            if sorts[self.here] not in _BINARY:
                return
            self.here += 1
            self.code += 1

    def primary(self) -> None:
        sort = self.sort[self.here]
        literal = False  # may stand before a brace
        if sort == _LITERAL:
            self.literal()
        elif sort == _NAME:
            self.name()
            literal = True
        elif sort == "(":
            self.here += 1
            self.add()
            self.inside(self.expression)
            self.need(")")
        elif sort == "func":
            self.here += 1
            self.signature()
            if self.see("{"):
                self.add()
                self.inside(self.block)
        else:
            if not self.try_type():
                self.fail("expected an operand")
            literal = sort in ("[", "map", "struct")
        fresh = literal and sort != _NAME  # a written-out type opens its literal in headers too
        while self.sort[self.here] in _BEHIND:
            if self.eat("."):
                self.add()
                if self.eat("("):
                    literal = False
                    if not self.eat("type"):
                        self.type()
                    self.need(")")
                else:
                    self.name()
            elif self.see("["):
                self.here += 1
                self.add()
                self.inside(self._index)
            elif self.see("("):
                self.here += 1
                self.add()
                literal = fresh = False
                self.inside(lambda: self.list_of(self._argument, ")"))
            elif self.see("{") and literal and (not self.bare or fresh):
                self.add()
                self.inside(self._composite)
                literal = fresh = False
            else:
                return

    def _argument(self) -> None:
        self.expression()
        self.eat("...")

    def _index(self) -> None:
        if not self.see(":"):
            self.expression()
            while self.eat(","):
                if not self.see("]"):
                    self.expression()
        while self.eat(":"):
            if not self.see(":", "]"):
                self.expression()
        self.need("]")

    def _composite(self) -> None:
        self.need("{")
        self.list_of(self._item, "}")

    def _item(self) -> None:
        self._item_part()
        if self.eat(":"):
            self.add()
            self._item_part()

    def _item_part(self) -> None:
        if self.see("{"):
            self.add()
            self._composite()
        else:
            self.expression()

    # -- statements

    def block(self) -> None:
        self.need("{")
        self.add()
        self.statements("}")
        self.need("}")

    def statements(self, *closers: str) -> None:
        while self.sort[self.here] not in closers:
            if self.sort[self.here] == _END:
                self.fail("expected '}'")
            self.statement()

    def statement(self) -> None:
        sort = self.sort[self.here]
        if sort == ";" or sort == _LINE:
            self.here += 1
            self.add()
            return
        if sort == "{":
            self.block()
            self.finish("}", "case", "default")
            return
        rule = _STATEMENTS.get(sort)
        if rule:
            self.add()
            rule(self)
            self.finish("}", "case", "default")
            return
        if sort == _NAME and self.sort[self.here + 1] == ":":
            self.add()
            self.name()
            self.here += 1
            if self.see("}"):
                self.add()  # an empty statement
            else:
                self.statement()
            return
        self.simple()
        self.finish("}", "case", "default")

    def _declared(self) -> None:
        self.general()

    def _return(self) -> None:
        self.here += 1
        if not self.see(";", _LINE, "}"):
            self.expressions()

    def _call(self) -> None:
        self.here += 1
        self.expression()

    def _branch(self) -> None:
        self.here += 1
        if self.sort[self.here] == _NAME:
            self.name()

    def simple(self) -> str:
        """A simple statement: "range", "expression" (which is counted as a statement) or "other"."""
        if self.see("range"):
            self.here += 1
            self.expression()
            return "range"
        self.expressions()
        mark = self.sort[self.here]
        if mark in _ASSIGN:
            self.here += 1
            if self.eat("range"):
                self.expression()
                return "range"
            self.add()
            self.expressions()
            return "other"
        self.add()
        if mark == "<-":
            self.here += 1
            self.expression()
        elif mark in ("++", "--"):
            self.here += 1
        else:
            return "expression"
        return "other"

    def _header(self, rule):
        held, self.bare = self.bare, 1
        out = rule()
        self.bare = held
        return out

    def _condition(self) -> str:
        """[simple ;] [simple]: what the last one is; an expression there is no statement."""
        last = ""
        if not self.see(";", "{", _LINE):
            last = self.simple()
        if self.see(";", _LINE) and last != "range":
            self.here += 1
            last = ""
            if not self.see("{"):
                last = self.simple()
        if last == "expression":
            self.add(-1)
        return last

    def _if(self) -> None:
        self.here += 1
        if self._header(self._condition) != "expression":
            self.fail("expected a condition")
        self.inside(self.block)
        if self.eat("else"):
            if self.see("if"):
                self.add()
                self._if()
            elif self.see("{"):
                self.inside(self.block)
            else:
                self.fail("expected if statement or block")

    def _for(self) -> None:
        self.here += 1

        def header():
            if self.see("{"):
                return
            last = "" if self.see(";") else self.simple()
            if last == "range":
                return
            if not self.see(";", _LINE):
                if last == "expression":
                    self.add(-1)
                return
            self.here += 1
            if not self.see(";", _LINE, "{"):
                if self.simple() == "expression":
                    self.add(-1)
            if not self.see("{"):
                self.need(";")
            if not self.see("{"):
                self.simple()

        self._header(header)
        self.inside(self.block)

    def _switch(self) -> None:
        self.here += 1

        def header():
            if not self.see("{"):
                last = self._condition()
                # a type switch keeps its statement
                if last == "expression" and self.sort[self.here - 4 : self.here] == [".", "(", "type", ")"]:
                    self.add()

        self._header(header)
        self.inside(lambda: self._clauses(self._case))

    def _select(self) -> None:
        self.here += 1
        self.inside(lambda: self._clauses(self._communication))

    def _clauses(self, rule) -> None:
        self.need("{")
        self.add()
        while not self.see("}"):
            self.add()
            if not self.eat("default"):
                self.need("case")
                rule()
            self.need(":")
            self.statements("case", "default", "}")
        self.need("}")

    def _case(self) -> None:
        self.expressions()

    def _communication(self) -> None:
        self.simple()


_STATEMENTS = {"var": _Shape.general, "const": _Shape.general, "type": _Shape.general, "return": _Shape._return, "go": _Shape._call, "defer": _Shape._call, "if": _Shape._if, "for": _Shape._for, "switch": _Shape._switch, "select": _Shape._select, **dict.fromkeys(("break", "continue", "goto", "fallthrough"), _Shape._branch)}


class Counts(NamedTuple):
    """What a shape counts, in the order of DECLS and TOKENS, and its faults (line, place, message)."""

    numbers: tuple[int, ...]
    faults: tuple[tuple[int, int, str], ...]


class _Shapes(dict):
    """Counts of shapes; a worker keeps those of its last files, as copies and versions of a file often differ in names and values only."""

    held = 0

    def __missing__(self, shape: tuple[str, ...]) -> Counts:
        s = _Shape(shape)
        out = Counts((*s.decls.values(), s.code, s.comment, s.basic), tuple(s.faults))
        if len(shape) <= _LARGEST:
            if self.held + len(shape) > _KEPT:
                self.clear()
                self.held = 0
            self[shape], self.held = out, self.held + len(shape)
        return out


_shapes = _Shapes()


class Syntax:
    """What a file counts, in the order of DECLS and TOKENS, and its errors (line, column in bytes, message)."""

    __slots__ = ("numbers", "errors")

    def __init__(self, source: str):
        start = 1 if source[:1] == "\ufeff" else 0
        tokens = _TOKEN.findall(source, start, len(source.rstrip(" \t\r")))
        shape = tuple(map(_sorts.__getitem__, tokens))
        self.numbers, faults = _shapes[shape]
        self.errors = [self._error(source, start, tokens, shape, *f) for f in faults] if faults else []

    @property
    def decls(self) -> dict[str, int]:
        return dict(zip(DECLS, self.numbers))

    @property
    def nodes(self) -> dict[str, int]:
        return dict(zip(TOKENS, self.numbers[len(DECLS) :]))

    @staticmethod
    def _error(source: str, start: int, tokens: list[str], shape: tuple[str, ...], line: int, place: int, message: str) -> tuple[int, int, str]:
        """The fault with what its token reads and where that stands."""
        text, at = "", len(source)
        if place < len(tokens):
            text, first = tokens[place], place
            while first and "\n" not in shape[first - 1]:
                first -= 1
            if first and shape[first - 1] in (_LINE, _INDENTED):  # from the end of the line before
                first, start = first - 1, -1
                for _ in range(line - 1):
                    start = source.index("\n", start + 1)
            else:
                first = 0
            at = next(islice(_TOKEN.finditer(source, start, len(source.rstrip(" \t\r"))), place - first, None)).start(1)
        if not message:
            message = "literal or comment not terminated" if text in "\"'`/" else f"illegal character {text!r}"
        elif message.endswith("%"):
            message = message[:-1] + repr(text)
        return line, len(source[source.rfind("\n", 0, at) + 1 : at].encode()) + 1, message
