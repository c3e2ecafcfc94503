"""The predicate language: boolean expressions over one node or one edge, compiled to Columns.

    predicate  := options '|' chain | chain | options '|'        (the last one: true)
    chain      := values joined by 'or' over values joined by 'and'
    value      := 'not' value | operand [('=' | '!=') value]
    operand    := (integer | 'text' | "text" | name | '(' chain ')') { '.' name | '(' chain, ... ')' }
    options    := { '*' | '[]' | '?' | '(?P<name>)' }

A predicate whose operands have the wrong types is false as a whole, not an error; that is decided
when it is compiled. Unknown names, and results that aren't boolean, are errors. Every comparison
is two-valued: where a column is null, it is false, and its negation true.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

STRING, INTEGER, BOOLEAN = "string", "integer", "boolean"
METHOD = (("className", STRING), ("name", STRING))
#: Name -> parameter types and result type of the functions; the constants below.
FUNCTIONS = {"is": ((STRING,), BOOLEAN), "method": ((), METHOD), "name": ((), STRING)}
CONSTANTS = {"five": (INTEGER, 5), "true": (BOOLEAN, True), "false": (BOOLEAN, False)}

TOKEN = re.compile(r"""\s*(?:(?P<int>-?[0-9]+)|"(?P<dq>[^"]+)"|'(?P<sq>[^']+)'|(?P<id>[A-Za-z_][A-Za-z0-9_]*)|(?P<op>\[\]|!=|[=.(),|*?<>]))""")


class PredicateError(ValueError):
    """The text is no predicate, or one that can never be evaluated."""


@dataclass(frozen=True)
class Node:
    def __str__(self) -> str:
        raise NotImplementedError


@dataclass(frozen=True)
class Literal(Node):
    value: int | str

    def __str__(self) -> str:
        if isinstance(self.value, int):
            return str(self.value)
        return f"'{self.value}'" if "'" not in self.value else f'"{self.value}"'


@dataclass(frozen=True)
class Name(Node):
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Field(Node):
    base: Node
    name: str

    def __str__(self) -> str:
        return f"{group(self.base)}.{self.name}"


@dataclass(frozen=True)
class Call(Node):
    base: Node
    args: tuple[Node, ...]

    def __str__(self) -> str:
        return f"{group(self.base)}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Equals(Node):
    left: Node
    right: Node

    def __str__(self) -> str:
        return f"{group(self.left)} = {self.right if isinstance(self.right, Equals | Not) else group(self.right)}"


@dataclass(frozen=True)
class Not(Node):
    value: Node

    def __str__(self) -> str:
        return f"not {self.value if isinstance(self.value, Not | Equals) else group(self.value)}"


@dataclass(frozen=True)
class And(Node):
    left: Node
    right: Node

    def __str__(self) -> str:
        right = f"({self.right})" if isinstance(self.right, And | Or) else str(self.right)
        return f"{f'({self.left})' if isinstance(self.left, Or) else self.left} and {right}"


@dataclass(frozen=True)
class Or(Node):
    left: Node
    right: Node

    def __str__(self) -> str:
        return f"{self.left} or {f'({self.right})' if isinstance(self.right, Or) else self.right}"


def group(x: Node) -> str:
    return str(x) if isinstance(x, Literal | Name | Field | Call) else f"({x})"


TRUE = Name("true")


@dataclass(frozen=True)
class Options:
    """kleene (*) for edges; repeated ([]), optional (?) and capture ((?P<name>)) for vertices."""

    kleene: bool = False
    repeated: bool = False
    optional: bool = False
    capture: str | None = None

    def __str__(self) -> str:
        return "*" * self.kleene + "[]" * self.repeated + "?" * self.optional + (f"(?P<{self.capture}>)" if self.capture else "")


@dataclass(frozen=True)
class Predicate:
    body: Node = TRUE
    options: Options = field(default_factory=Options)

    def __str__(self) -> str:
        return f"{self.options}|{self.body}" if str(self.options) else str(self.body)


class Parser:
    def __init__(self, text: str):
        self.text, self.at, self.tokens = text, 0, []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m or m.end() == at:
                if text[at:].strip():
                    raise PredicateError(f"{text!r}: what is {text[at:].strip()[:10]!r}?")
                break
            kind = m.lastgroup
            self.tokens.append((kind if kind not in ("dq", "sq") else "str", m[kind]))
            at = m.end()

    def peek(self, value: str | None = None, ahead: int = 0):
        token = self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else (None, None)
        if value is None:
            return token
        return token[1] == value and token[0] in ("op", "id")

    def take(self, value: str | None = None):
        token = self.peek()
        if token[0] is None or value is not None and not self.peek(value):
            raise PredicateError(f"{self.text!r}: {value or 'something'!r} is missing")
        self.at += 1
        return token[1]

    def parse(self) -> Predicate:
        options, found, start = {}, False, self.at
        while True:
            if self.peek("*"):
                self.take()
                options["kleene"] = True
            elif self.peek("[]"):
                self.take()
                options["repeated"] = True
            elif self.peek("?"):
                self.take()
                options["optional"] = True
            elif self.peek("(") and self.peek("?", 1):
                self.at += 2
                if not self.peek("P"):
                    raise PredicateError(f"{self.text!r}: a capture is (?P<name>)")
                self.take(), self.take("<")
                if self.peek()[0] != "id":
                    raise PredicateError(f"{self.text!r}: the capture has no name")
                options["capture"] = self.take()
                self.take(">"), self.take(")")
            else:
                break
            found = True
        if found:
            self.take("|")
            if self.peek()[0] is None:
                return Predicate(TRUE, Options(**options))
        elif start == len(self.tokens):
            raise PredicateError("an empty predicate")
        body = self.either()
        if self.peek()[0] is not None:
            raise PredicateError(f"{self.text!r}: {self.peek()[1]!r} is left over")
        return Predicate(body, Options(**options))

    def either(self) -> Node:
        left = self.both()
        while self.peek("or"):
            self.take()
            left = Or(left, self.both())
        return left

    def both(self) -> Node:
        left = self.value()
        while self.peek("and"):
            self.take()
            left = And(left, self.value())
        return left

    def value(self) -> Node:
        if self.peek("not"):
            self.take()
            return Not(self.value())
        left = self.operand()
        if self.peek("="):
            self.take()
            return Equals(left, self.value())
        if self.peek("!="):
            self.take()
            return Not(Equals(left, self.value()))
        return left

    def operand(self) -> Node:
        kind, text = self.peek()
        if kind == "int":
            out: Node = Literal(int(self.take()))
        elif kind == "str":
            out = Literal(self.take())
        elif self.peek("("):
            self.take()
            out = self.either()
            self.take(")")
        elif kind == "id" and text not in ("and", "or", "not"):
            out = Name(self.take())
        else:
            raise PredicateError(f"{self.text!r}: a value is missing")
        while True:
            if self.peek("."):
                self.take()
                if self.peek()[0] != "id":
                    raise PredicateError(f"{self.text!r}: a field has a name")
                out = Field(out, self.take())
            elif self.peek("("):
                self.take()
                args = []
                while not self.peek(")"):
                    args.append(self.either())
                    if not self.peek(")"):
                        self.take(",")
                self.take(")")
                out = Call(out, tuple(args))
            else:
                return out


def parse(text: str) -> Predicate:
    return Parser(text).parse()


class Mismatch(Exception):
    """Operands of the wrong types: the whole predicate is false."""


def type_of(x: Node):
    """The type of an expression; Mismatch if it has none, PredicateError for unknown names."""
    match x:
        case Literal(value):
            return INTEGER if isinstance(value, int) else STRING
        case Name(name):
            if name in CONSTANTS:
                return CONSTANTS[name][0]
            if name in FUNCTIONS:
                return ("function", *FUNCTIONS[name])
            raise PredicateError(f"{name} isn't known")
        case Field(base, name):
            kind = type_of(base)
            fields = dict(kind) if isinstance(kind, tuple) and kind[0] != "function" else {}
            if name not in fields:
                raise Mismatch
            return fields[name]
        case Call(base, args):
            kind, given = type_of(base), tuple(map(type_of, args))
            if not isinstance(kind, tuple) or kind[0] != "function" or kind[1] != given:
                raise Mismatch
            return kind[2]
        case Equals(left, right):
            if type_of(left) != type_of(right):
                raise Mismatch
            return BOOLEAN
        case Not(value):
            if type_of(value) != BOOLEAN:
                raise Mismatch
            return BOOLEAN
        case And(left, right) | Or(left, right):
            if (type_of(left), type_of(right)) != (BOOLEAN, BOOLEAN):
                raise Mismatch
            return BOOLEAN
    raise PredicateError(f"{x} is no expression")


class Target:
    """What a predicate is about: how its functions read the row."""

    def is_(self, name: str) -> Column:
        raise NotImplementedError

    def method(self, name: str) -> Column:
        raise NotImplementedError

    def label(self) -> Column:
        raise NotImplementedError


@dataclass
class NodeTarget(Target):
    """A row of ``nodes``. ``known``: with a set of type names, testing for any other one is an error."""

    known: frozenset[str] | None = None

    def is_(self, name: str) -> Column:
        if self.known is not None and name not in self.known:
            raise PredicateError(f"no node has the type {name}")
        return F.coalesce(F.array_contains("types", name), F.lit(False))

    def method(self, name: str) -> Column:
        return F.col({"className": "method_class", "name": "method_name"}[name])

    def label(self) -> Column:
        raise PredicateError("name() is for edges")


class EdgeTarget(Target):
    """A row of ``edges``."""

    def is_(self, name: str) -> Column:
        if name in ("DATA", "CONTROL", "ASSOCIATED"):
            return F.coalesce(F.col("etype") == name, F.lit(False))
        return F.coalesce((F.col("etype") == "EXTRA") & (F.col("eclass") == name), F.lit(False))

    def method(self, name: str) -> Column:
        raise PredicateError("method() is for nodes")

    def label(self) -> Column:
        return F.col("label")


def compile_node(x: Node, target: Target) -> Column:
    match x:
        case Literal(value):
            return F.lit(value).cast("long") if isinstance(value, int) else F.lit(value)
        case Name(name):
            return F.lit(CONSTANTS[name][1])
        case Field(Call(Name("method"), ()), name):
            return target.method(name)
        case Call(Name("is"), (arg,)):
            if not isinstance(arg, Literal):
                raise PredicateError("is() takes a literal")
            return target.is_(arg.value)
        case Call(Name("name"), ()):
            return target.label()
        case Equals(left, right):
            if type_of(left) == METHOD:
                same = [target.method(f).eqNullSafe(target.method(f)) & target.method(f).isNotNull() for f, _ in METHOD]
                return same[0] & same[1]
            return F.coalesce(compile_node(left, target) == compile_node(right, target), F.lit(False))
        case Not(value):
            return ~compile_node(value, target)
        case And(left, right):
            return compile_node(left, target) & compile_node(right, target)
        case Or(left, right):
            return compile_node(left, target) | compile_node(right, target)
    raise PredicateError(f"{x} has no value of its own")


def to_column(predicate: Predicate | str, target: Target) -> Column:
    """The boolean Column of a predicate for rows of ``target``."""
    body = (parse(predicate) if isinstance(predicate, str) else predicate).body
    try:
        kind = type_of(body)
    except Mismatch:
        return F.lit(False)
    if kind != BOOLEAN:
        raise PredicateError(f"{body} isn't boolean")
    return compile_node(body, target)


def always(predicate: Predicate) -> bool:
    """Whether it is plainly true for every row."""
    match predicate.body:
        case Name("true"):
            return True
        case Equals(Literal(a), Literal(b)):
            return type(a) is type(b) and a == b
    return False
