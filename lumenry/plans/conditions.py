"""The condition language: text to a syntax tree to Spark columns.

``{a > 1, b in ['x', 'y']}; {c match ['^z']}``: braces are groups, commas and AND/OR join conditions, groups are tried in
order and the first that holds gives its index, or -1. Values are compared strictly by type and never yield SQL's unknown:
every leaf is true or false. The tree compiles to columns over typed columns (a missing key is a null) or over the maps of
the point model, so Catalyst folds, pushes and prunes it.
"""

from __future__ import annotations

import math
import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ConditionError(ValueError):
    """A condition text that can't be read."""


@dataclass(frozen=True)
class Name:
    name: str
    dotted: bool = False


@dataclass(frozen=True)
class Literal:
    kind: str  # int, float, string, bool or nil
    value: object


@dataclass(frozen=True)
class Pattern:
    pattern: str


@dataclass(frozen=True)
class Items:
    items: tuple


@dataclass(frozen=True)
class Call:
    name: str
    arguments: tuple


@dataclass(frozen=True)
class Group:
    inner: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)|(?P<number>0[xX][0-9a-fA-F]+|(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)(?![A-Za-z_])
    |(?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<quoted>`[^`]*`)|(?P<word>[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff]*)
    |(?P<op>&&|\|\||!=|>=|<=|==|[=<>(){}\[\],;.+\-*/%^])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "\\": "\\", "'": "'", '"': '"'}
_WORDS = {"and", "or", "in", "notin", "not_in", "match", "notmatch", "not_match", "nil", "null", "true", "false", "inf", "nan", "re", "identifier"}
_ORDER = {"or": 1, "and": 2, "=": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "in": 3, "notin": 3, "match": 3, "notmatch": 3, "+": 4, "-": 4, "*": 5, "/": 5, "%": 5, "^": 6}
_SAME = {"&&": "and", "||": "or", "==": "=", "not_in": "notin", "not_match": "notmatch"}


def _unquote(text: str) -> str:
    def one(m: re.Match) -> str:
        x = m[1]
        if x[0] in "xuU":
            return chr(int(x[1:], 16))
        if x[0] in "01234567":
            return chr(int(x, 8))
        if x not in _ESCAPES:
            raise ConditionError(f"unknown escape \\{x}")
        return _ESCAPES[x]

    return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.)", one, text[1:-1], flags=re.S)


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ConditionError(f"unexpected {text[at : at + 12]!r} at {at}")
        at = m.end()
        kind = m.lastgroup
        if kind == "space":
            continue
        value = m[0]
        if kind == "word" and value.lower() in _WORDS:
            kind, value = "op", _SAME.get(value.lower(), value.lower())
        elif kind == "op":
            value = _SAME.get(value, value)
        out.append((kind, value))
    return [*out, ("end", "")]


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens, self.at = tokenize(text), 0

    def peek(self, *ops: str) -> bool:
        kind, value = self.tokens[self.at]
        return kind == "op" and value in ops

    def take(self, *ops: str) -> str:
        kind, value = self.tokens[self.at]
        if ops and not (kind == "op" and value in ops):
            raise ConditionError(f"expected {' or '.join(ops)}, found {value or 'the end'!r}")
        self.at += 1
        return value

    def groups(self) -> list[list | None]:
        out: list[list | None] = []
        if self.peek(";"):
            out.append(None)  # a leading separator is an empty first condition
        while self.tokens[self.at][0] != "end":
            if self.peek(";"):
                self.take()
                continue
            if out and out[-1] is not None and self.tokens[self.at - 1][1] != ";":
                raise ConditionError("groups are separated by ;")
            self.take("{")
            conditions = []
            while not self.peek("}"):
                conditions.append(self.expression(1))
                if not self.peek("}"):
                    self.take(",")
            self.take("}")
            out.append(conditions)
        return out

    def expression(self, least: int):
        left = self.operand()
        while True:
            kind, op = self.tokens[self.at]
            if kind != "op" or _ORDER.get(op, 0) < least:
                return left
            self.take()
            if op in ("in", "notin", "match", "notmatch"):
                right = self.items()
                if op.endswith("match"):
                    right = Items(tuple(Pattern(x.value) for x in right.items if isinstance(x, Literal) and x.kind == "string" and usable(x.value)))
            else:
                right = self.expression(_ORDER[op] + (op != "^"))
            if op in ("/", "%") and isinstance(right, Literal) and right.value == 0 and right.kind in ("int", "float"):
                raise ConditionError("division by zero")
            left = Binary(op, left, right)

    def items(self) -> Items:
        self.take("[")
        out = []
        while not self.peek("]"):
            out.append(self.operand())
            if not self.peek("]"):
                self.take(",")
        self.take("]")
        return Items(tuple(out))

    def operand(self):
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return _number(value)
        if kind == "string":
            return Literal("string", _unquote(value))
        if kind == "quoted":
            return self._dotted(Name(value[1:-1]))
        if kind == "word":
            return self._call(value) if self.peek("(") else self._dotted(Name(value))
        if kind == "op":
            if value in ("nil", "null"):
                return Literal("nil", None)
            if value in ("true", "false"):
                return Literal("bool", value == "true")
            if value in ("inf", "nan"):
                return Literal("float", float(value))
            if value in ("+", "-"):
                inner = self.operand()
                if not isinstance(inner, Literal) or inner.kind not in ("int", "float"):
                    raise ConditionError("a sign stands before a number")
                return Literal(inner.kind, -inner.value if value == "-" else inner.value)
            if value == "(":
                inner = self.expression(1)
                self.take(")")
                return Group(inner)
            if value in ("re", "identifier"):
                self.take("(")
                kind, text = self.tokens[self.at]
                if kind not in ("string", "quoted"):
                    raise ConditionError(f"{value}() takes a string")
                self.at += 1
                self.take(")")
                text = _unquote(text) if kind == "string" else text[1:-1]
                if value == "identifier":
                    return Name(text)
                if not usable(text):
                    raise ConditionError(f"not a pattern: {text!r}")
                return Pattern(text)
            if value == "[":
                self.at -= 1
                return self.items()
        raise ConditionError(f"unexpected {value or 'end'!r}")

    def _dotted(self, name: Name) -> Name:
        while self.peek("."):
            self.take()
            _, value = self.tokens[self.at]
            self.at += 1
            name = Name(f"{name.name}.{value.strip('`')}", True)
        return name

    def _call(self, name: str) -> Call:
        self.take("(")
        arguments = []
        while not self.peek(")"):
            arguments.append(self.expression(1))
            if not self.peek(")"):
                self.take(",")
        self.take(")")
        call = Call(name, tuple(arguments))
        while self.peek("."):
            self.take()
            _, value = self.tokens[self.at]
            self.at += 1
            call = Call(value, (call, *self._call(value).arguments))
        return call


def _number(text: str) -> Literal:
    low = text.lower()
    if low.startswith("0x"):
        return Literal("int", int(low, 16))
    if re.fullmatch(r"0[0-7]+", text):
        return Literal("int", int(text, 8))
    if re.fullmatch(r"\d+", text) and int(text) < 1 << 63:
        return Literal("int", int(text))
    return Literal("float", float(text))


def _compiles(pattern: str) -> bool:
    """Whether the engine that will run the pattern reads it: the JVM's, or Python's where no session is there yet."""
    context = SparkContext._active_spark_context
    if context is None or context._jvm is None:
        try:
            re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", pattern).replace("\\z", "\\Z"))
        except re.error:
            return False
        return True
    try:
        context._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JError, PySparkException):
        return False
    return True


def usable(pattern: str) -> bool:
    """Whether both Java and linear-time engines read the pattern alike: no look-around, no back-references."""
    if not _compiles(pattern) or re.search(r"\(\?<?[=!]|\\[1-9]", pattern):
        warnings.warn(f"pattern left out: {pattern!r}", stacklevel=3)
        return False
    return True


@dataclass
class Ref:
    """A key's value: whether it's missing, and its column as a kind, null or None if it has another kind."""

    missing: Column
    typed: Callable[[str], Column | None]


Resolver = Callable[[str], Ref]


def kind_of(data_type: T.DataType) -> str | None:
    if isinstance(data_type, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return "int"
    if isinstance(data_type, T.FloatType | T.DoubleType):
        return "float"
    if isinstance(data_type, T.StringType):
        return "string"
    return "bool" if isinstance(data_type, T.BooleanType) else None


def wide(schema: T.StructType) -> Resolver:
    """Keys are columns of ``schema``; a key without a column is always missing."""
    kinds = {f.name: kind_of(f.dataType) for f in schema.fields}

    def resolve(name: str) -> Ref:
        if name not in kinds:
            return Ref(F.lit(True), lambda kind: None)
        column = F.col(f"`{name}`")
        return Ref(column.isNull(), lambda kind: column if kinds[name] == kind else None)

    return resolve


def mapped(tags: str = "tags", fields: str = "fields") -> Resolver:
    """Keys are entries of the point model's maps; tags are strings."""

    def resolve(name: str) -> Ref:
        tag, value = F.try_element_at(F.col(tags), F.lit(name)), F.try_element_at(F.col(fields), F.lit(name))
        member = {"int": "i", "float": "f", "bool": "b"}
        typed = lambda kind: F.coalesce(tag, value["s"]) if kind == "string" else value[member[kind]]
        return Ref(tag.isNull() & value.isNull(), typed)

    return resolve


def _both(value: Column, test: Column) -> Column:
    """A test of a value that is there: false, not unknown, where it isn't; unlike a coalesce, both halves can be pushed down."""
    return value.isNotNull() & test


def _equal(column: Column | None, literal: Literal) -> Column:
    if column is None or literal.kind == "nil":
        return F.lit(False)
    if literal.kind == "float" and math.isfinite(literal.value):
        near = (column >= literal.value - 2e-9) & (column <= literal.value + 2e-9)  # a range that scans can skip by
        return _both(column, near & (F.abs(column - F.lit(literal.value)) <= 1e-9))
    if literal.kind == "float":
        return F.lit(False)
    return _both(column, column == F.lit(literal.value))


def _compare(op: str, ref: Ref, literal: Literal) -> Column:
    if literal.kind == "nil":
        return ref.missing if op == "=" else ~ref.missing if op == "!=" else F.lit(False)
    value = ref.typed(literal.kind)
    if op == "=":
        return _equal(value, literal)
    if op == "!=":
        return ref.missing if value is None else _both(value, value != F.lit(literal.value)) | ref.missing
    if value is None or literal.kind == "bool":
        return F.lit(False)
    other = F.lit(literal.value)
    return _both(value, {"<": value < other, "<=": value <= other, ">": value > other, ">=": value >= other}[op])


def _constant(op: str, a: Literal, b: object) -> bool:
    def same(x: Literal, y: object) -> bool:
        if not isinstance(y, Literal) or x.kind != y.kind:
            return False
        return abs(x.value - y.value) <= 1e-9 if x.kind == "float" else x.value == y.value

    if op == "in":
        return any(same(a, x) for x in b.items)
    if op == "notin":
        return not any(same(a, x) for x in b.items)
    if op == "=" and isinstance(b, Pattern):
        return a.kind == "string" and re.search(b.pattern, a.value) is not None
    if op in ("match", "notmatch"):
        hits = [re.search(x.pattern, a.value) is not None for x in b.items] if a.kind == "string" else []
        return any(hits) if op == "match" else any(not h for h in hits)
    if not isinstance(b, Literal):
        return op == "!=" and isinstance(b, Pattern) and a.kind == "string"
    if a.kind != b.kind:
        return a.kind == "nil" and op == "!="
    if op in ("=", "!="):
        return same(a, b) if op == "=" else a.value != b.value
    if a.kind in ("bool", "nil"):
        return False
    x, y = a.value, b.value
    if a.kind == "string":
        x, y = x.encode(), y.encode()
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def compile_expression(node: object, resolve: Resolver) -> Column:
    """A column that is true or false, never null."""
    if isinstance(node, Group):
        return compile_expression(node.inner, resolve)
    if not isinstance(node, Binary) or node.op in "+-*/%^":
        return F.lit(False)
    if node.op in ("and", "or"):
        a, b = compile_expression(node.left, resolve), compile_expression(node.right, resolve)
        return a & b if node.op == "and" else a | b
    left, right, op = node.left, node.right, node.op
    if isinstance(left, Literal):
        return F.lit(_constant(op, left, right))
    if not isinstance(left, Name):
        return F.lit(False)
    if left.dotted:
        warnings.warn(f"{left.name} is not a key; write `{left.name}` in back quotes", stacklevel=2)
        return F.lit(False)
    ref = resolve(left.name)
    if op in ("in", "notin"):
        items = [x for x in right.items if isinstance(x, Literal)]
        found = reduce(lambda a, b: a | b, (_equal(ref.typed(x.kind), x) for x in items if x.kind != "nil"), F.lit(False))
        if op == "in":  # of a missing key, the first item decides
            return found | ref.missing if items and items[0].kind == "nil" else found
        return ~found & ~ref.missing if any(x.kind == "nil" for x in items) else ~found
    if op in ("match", "notmatch"):
        value = ref.typed("string")
        if value is None:
            return F.lit(False)
        tests = [F.rlike(value, F.lit(x.pattern)) for x in right.items]
        hits = [_both(value, t if op == "match" else ~t) for t in tests]
        return reduce(lambda a, b: a | b, hits, F.lit(False))
    if isinstance(right, Pattern):
        value = ref.typed("string")
        if op == "=":
            return F.lit(False) if value is None else _both(value, F.rlike(value, F.lit(right.pattern)))
        return (ref.missing if value is None else value.isNotNull() | ref.missing) if op == "!=" else F.lit(False)
    return _compare(op, ref, right) if isinstance(right, Literal) else F.lit(False)


@dataclass
class Conditions:
    """Groups of conditions in order; None stands for an empty first group, which makes nothing hold."""

    groups: list[list | None]
    text: str = field(default="", compare=False)

    def group(self, k: int, resolve: Resolver) -> Column:
        """A bare parenthesised condition in a list doesn't count as a condition and is false; an empty list holds."""
        parts = (compile_expression(c, resolve) if isinstance(c, Binary) else F.lit(False) for c in self.groups[k] or ())
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def index(self, resolve: Resolver) -> Column:
        """The first group that holds, or -1."""
        if not self.groups or self.groups[0] is None:
            return F.lit(-1)
        out = F.when(self.group(0, resolve), 0)
        for k in range(1, len(self.groups)):
            out = out.when(self.group(k, resolve), k)
        return out.otherwise(-1)

    def matches(self, resolve: Resolver) -> Column:
        if not self.groups or self.groups[0] is None:
            return F.lit(False)
        return reduce(lambda a, b: a | b, (self.group(k, resolve) for k in range(len(self.groups))))


def parse(text: str) -> Conditions:
    return Conditions(_Parser(text).groups(), text)


def where(df, text: str):
    """Rows of a typed DataFrame for which a condition text holds."""
    return df.filter(parse(text).matches(wide(df.schema)))
