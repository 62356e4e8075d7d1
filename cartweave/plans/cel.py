"""Boolean CEL expressions over elements, compiled to one Catalyst expression.

An error of a sub-expression is SQL NULL, which makes ``&&`` and ``||`` absorb errors as CEL has it; at the top an error drops the row.
CEL's own ``null``, which absent metadata have, is a value: it equals only itself. Which expressions can be null is known at
compile time, so each carries a condition for it besides its column. A mistake that no row can mend (an unknown name, a result that
isn't boolean) raises at once.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartweave.errors import FilterSyntaxError

# Syntax

_TOKEN = re.compile(
    r"""\s*(?:(?P<comment>//[^\n]*)|(?P<float>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\.\d+(?:[eE][+-]?\d+)?)|(?P<uint>0x[0-9a-fA-F]+[uU]|\d+[uU])|(?P<int>0x[0-9a-fA-F]+|\d+)
    |(?P<string>[rR]?(?:\"\"\"(?:\\.|[^\\])*?\"\"\"|'''(?:\\.|[^\\])*?'''|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'))
    |(?P<name>[A-Za-z_]\w*)|(?P<op>&&|\|\||[<>=!]=|[-+*/%<>!?:.,()\[\]{}]))""",
    re.X | re.S,
)
_ESCAPES = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\", "'": "'", '"': '"', "`": "`", "?": "?"}
_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|([0-3][0-7]{2})|(.))", re.S)
_RESERVED = {"as", "break", "const", "continue", "else", "for", "function", "if", "import", "let", "loop", "package", "namespace", "return", "var", "void", "while"}


def _unquoted(token: str) -> str:
    raw = token[0] in "rR"
    token = token[1:] if raw else token
    size = 3 if token[:3] in ('"""', "'''") else 1
    body = token[size:-size]
    if raw:
        return body

    def one(m: re.Match) -> str:
        for i in (1, 2, 3):
            if m[i]:
                return chr(int(m[i], 16))
        if m[4]:
            return chr(int(m[4], 8))
        if m[5] not in _ESCAPES:
            raise FilterSyntaxError(f"CEL: unknown escape \\{m[5]}")
        return _ESCAPES[m[5]]

    return _ESCAPE.sub(one, body)


@dataclass(frozen=True)
class Node:
    kind: str
    value: object = None
    parts: tuple = ()


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise FilterSyntaxError(f"CEL: can't read {text[at : at + 20]!r}")
            at = m.end()
            if m.lastgroup != "comment":
                self.tokens.append((m.lastgroup, m[m.lastgroup]))
        self.tokens.append(("end", ""))
        self.at = 0

    def op(self, *ops: str) -> str | None:
        kind, value = self.tokens[self.at]
        if kind == "op" and value in ops:
            self.at += 1
            return value
        return None

    def need(self, op: str) -> None:
        if not self.op(op):
            raise FilterSyntaxError(f"CEL: {op!r} expected before {self.tokens[self.at][1]!r}")

    def whole(self) -> Node:
        out = self.ternary()
        if self.tokens[self.at][0] != "end":
            raise FilterSyntaxError(f"CEL: {self.tokens[self.at][1]!r} not expected")
        return out

    def ternary(self) -> Node:
        test = self.chain(("||",), lambda: self.chain(("&&",), self.relation))
        if self.op("?"):
            yes = self.chain(("||",), lambda: self.chain(("&&",), self.relation))
            self.need(":")
            return Node("if", None, (test, yes, self.ternary()))
        return test

    def chain(self, ops: tuple, below: Callable[[], Node]) -> Node:
        out = below()
        while op := self.op(*ops):
            out = Node("op", op, (out, below()))
        return out

    def relation(self) -> Node:
        out = self.sum()
        while True:
            if self.tokens[self.at] == ("name", "in"):
                self.at += 1
                out = Node("op", "in", (out, self.sum()))
            elif op := self.op("<", "<=", ">", ">=", "==", "!="):
                out = Node("op", op, (out, self.sum()))
            else:
                return out

    def sum(self) -> Node:
        return self.chain(("+", "-"), lambda: self.chain(("*", "/", "%"), self.unary))

    def unary(self) -> Node:
        if op := self.op("!", "-"):
            kind, value = self.tokens[self.at]
            if op == "-" and kind in ("int", "float"):  # the least integer has no positive
                self.tokens[self.at] = (kind, f"-{value}")
                return self.member()
            return Node("not" if op == "!" else "minus", None, (self.unary(),))
        return self.member()

    def member(self) -> Node:
        out = self.primary()
        while True:
            if self.op("."):
                kind, name = self.tokens[self.at]
                if kind != "name":
                    raise FilterSyntaxError("CEL: a name expected after '.'")
                self.at += 1
                out = Node("call", name, (out, *self.arguments(")"))) if self.op("(") else Node("field", name, (out,))
            elif self.op("["):
                out = Node("index", None, (out, self.ternary()))
                self.need("]")
            else:
                return out

    def arguments(self, close: str) -> list[Node]:
        out = []
        while not self.op(close):
            out.append(self.ternary())
            if not self.op(","):
                self.need(close)
                break
        return out

    def primary(self) -> Node:
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "int":
            n = int(value, 16 if "0x" in value else 10)
            if not -(2**63) <= n < 2**63:
                raise FilterSyntaxError(f"CEL: {value} is no 64-bit integer")
            return Node("int", n)
        if kind == "uint":
            n = int(value[:-1], 16 if value.startswith("0x") else 10)
            if n >= 2**64:
                raise FilterSyntaxError(f"CEL: {value} is no 64-bit unsigned integer")
            return Node("uint", n)
        if kind == "float":
            return Node("double", float(value))
        if kind == "string":
            return Node("string", _unquoted(value))
        if kind == "name":
            if value in ("true", "false"):
                return Node("bool", value == "true")
            if value == "null":
                return Node("null")
            if value in _RESERVED:
                raise FilterSyntaxError(f"CEL: {value} is a reserved word")
            return Node("function", value, tuple(self.arguments(")"))) if self.op("(") else Node("name", value)
        if (kind, value) == ("op", "("):
            out = self.ternary()
            self.need(")")
            return out
        if (kind, value) == ("op", "["):
            return Node("list", None, tuple(self.arguments("]")))
        if (kind, value) == ("op", "{"):
            pairs = []
            while not self.op("}"):
                k = self.ternary()
                self.need(":")
                pairs.append((k, self.ternary()))
                if not self.op(","):
                    self.need("}")
                    break
            return Node("map", None, tuple(pairs))
        if (kind, value) == ("op", "."):
            return self.primary()
        raise FilterSyntaxError(f"CEL: {value or 'the end'!r} not expected")


def parse(text: str) -> Node:
    if not text.strip():
        raise FilterSyntaxError("CEL: empty expression")
    return _Parser(text).whole()


# Compilation

NUMBERS = ("int", "uint", "double")


@dataclass
class Value:
    """type: int, uint, double, string, bool, null, list, map, timestamp, duration or type. The column is NULL for errors and null."""

    type: str
    column: Column
    null: Column | None = None  #: where the value is CEL's null
    of: str | None = None  #: of a list's elements, a map's values
    parts: list[Value] | None = None  #: of a list literal
    literal: object = field(default=None)


_SQL = {"int": "bigint", "uint": "decimal(20,0)", "double": "double", "string": "string", "bool": "boolean", "null": "string", "timestamp": "timestamp", "duration": "bigint", "type": "string"}
VARIABLES = {"changeset": ("int", "bigint"), "user": ("string", "string"), "uid": ("int", "bigint"), "timestamp": ("string", "string"), "visible": ("bool", "boolean")}
TYPE_NAMES = {"int": "int", "uint": "uint", "double": "double", "string": "string", "bool": "bool", "list": "list", "map": "map", "null_type": "null_type", "bytes": "bytes"}
_DURATION = re.compile(r"([+-]?)((?:\d+(?:\.\d+)?(?:h|ms|us|ns|m|s))+)")
_UNITS = {"h": 3.6e9, "m": 6e7, "s": 1e6, "ms": 1e3, "us": 1.0, "ns": 1e-3}


def _error(type_: str = "bool") -> Value:
    return Value(type_, F.lit(None).cast(_SQL.get(type_, "string")))


def _bool(c: Column) -> Value:
    return Value("bool", c)


def _call(name: str, *args: Column) -> Column:
    return F.call_function(name, *args)


def _equal(a: Value, b: Value) -> Column:
    """True or false for any two values, NULL if one is an error."""
    no = F.lit(False)
    na, nb = a.null if a.null is not None else no, b.null if b.null is not None else no
    if a.type in NUMBERS and b.type in NUMBERS or a.type == b.type and a.type not in ("list", "map", "null"):
        same = a.column == b.column
    elif a.type == b.type == "list":
        same = a.column == b.column if a.of == b.of else F.when(a.column.isNotNull() & b.column.isNotNull(), (F.size(a.column) == 0) & (F.size(b.column) == 0))
    elif a.type == b.type == "map":
        if a.of != b.of:
            same = F.when(a.column.isNotNull() & b.column.isNotNull(), (F.size(a.column) == 0) & (F.size(b.column) == 0))
        else:
            same = (F.size(a.column) == F.size(b.column)) & F.forall(F.map_keys(a.column), lambda k: F.coalesce(a.column[k] == b.column[k], F.lit(False)))
    else:  # of different types: never equal
        same = F.when(a.column.isNotNull() & b.column.isNotNull(), no)
    if a.null is None and b.null is None:
        return same
    return F.when(na & nb, True).when(na & b.column.isNotNull(), False).when(nb & a.column.isNotNull(), False).otherwise(same)


def _either(test: Column, a: Value, b: Value) -> Value:
    null = None
    if a.null is not None or b.null is not None:
        null = F.when(test, a.null if a.null is not None else F.lit(False)).when(~test, b.null if b.null is not None else F.lit(False)).otherwise(F.lit(False))
    if "null" in (a.type, b.type):
        kind = b if a.type == "null" else a
        cast = lambda v: F.lit(None).cast(_SQL.get(kind.type, "string")) if v.type == "null" else v.column
        return Value(kind.type, F.when(test, cast(a)).when(~test, cast(b)), null, kind.of)
    if a.type != b.type:
        raise FilterSyntaxError(f"CEL: the branches of ?: are {a.type} and {b.type}")
    return Value(a.type, F.when(test, a.column).when(~test, b.column), null, a.of)


class Compiler:
    def __init__(self, scope: dict[str, Value] | None = None):
        self.scope = scope or {}

    def compile(self, n: Node) -> Value:
        return getattr(self, f"_{n.kind}")(n)

    # Literals and names

    def _int(self, n):
        return Value("int", F.lit(n.value).cast("bigint"), literal=n.value)

    def _uint(self, n):
        return Value("uint", F.lit(str(n.value)).cast("decimal(20,0)"), literal=n.value)

    def _double(self, n):
        return Value("double", F.lit(n.value).cast("double"), literal=n.value)

    def _string(self, n):
        return Value("string", F.lit(n.value), literal=n.value)

    def _bool(self, n):
        return Value("bool", F.lit(n.value), literal=n.value)

    def _null(self, n):
        return Value("null", F.lit(None).cast("string"), F.lit(True))

    def _list(self, n):
        parts = [self.compile(p) for p in n.parts]
        kinds = {p.type for p in parts}
        if len(kinds) == 1 and "null" not in kinds and not kinds & {"list", "map"}:
            kind = kinds.pop()
            good = F.lit(True)
            for p in parts:
                good = good & p.column.isNotNull()
            return Value("list", F.when(good, F.array(*(p.column for p in parts))), of=kind, parts=parts)
        if not parts:
            return Value("list", F.expr("cast(array() as array<string>)"), of="string", parts=[])
        return Value("list", F.array(*(p.column.cast("string") for p in parts)), of="mixed", parts=parts)

    def _map(self, n):
        pairs = [(self.compile(k), self.compile(v)) for k, v in n.parts]
        if not pairs:
            return Value("map", F.expr("cast(map() as map<string,string>)"), of="string")
        if {k.type for k, _ in pairs} != {"string"} or len({v.type for _, v in pairs}) != 1:
            raise FilterSyntaxError("CEL: a map needs strings as keys and values of one type")
        good = F.lit(True)
        for pair in pairs:
            for p in pair:
                good = good & p.column.isNotNull()
        if len({k.literal for k, _ in pairs}) < len(pairs) or any(k.literal is None for k, _ in pairs):
            raise FilterSyntaxError("CEL: the keys of a map must be different literals")
        return Value("map", F.when(good, F.create_map(*(c.column for p in pairs for c in p))), of=pairs[0][1].type)

    def _name(self, n):
        if n.value in self.scope:
            return self.scope[n.value]
        if n.value == "tags":
            return Value("map", F.col("tags"), of="string")
        if n.value == "id":
            return Value("int", F.col("id"))
        if n.value == "type":
            return Value("string", F.col("type"))
        if n.value in VARIABLES:
            kind, sql = VARIABLES[n.value]
            return Value(kind, F.col(n.value).cast(sql), F.col(n.value).isNull())
        if n.value in TYPE_NAMES:
            return Value("type", F.lit(n.value))
        raise FilterSyntaxError(f"CEL: unknown name {n.value}")

    # Operators

    def _if(self, n):
        test, yes, no = map(self.compile, n.parts)
        return _either(test.column, yes, no) if test.type == "bool" else _error(yes.type)

    def _not(self, n):
        a = self.compile(n.parts[0])
        return _bool(~a.column) if a.type == "bool" else _error()

    def _minus(self, n):
        a = self.compile(n.parts[0])
        if a.type == "double":
            return Value("double", -a.column)
        return Value("int", _call("try_subtract", F.lit(0).cast("bigint"), a.column)) if a.type == "int" else _error("int")

    def _op(self, n):
        a, b = map(self.compile, n.parts)
        op = n.value
        if op in ("&&", "||"):
            x, y = (v.column if v.type == "bool" else F.lit(None).cast("boolean") for v in (a, b))
            return _bool(x & y if op == "&&" else x | y)
        if op in ("==", "!="):
            same = _equal(a, b)
            return _bool(same if op == "==" else ~same)
        if op == "in":
            return self._within(a, b)
        if op in ("<", "<=", ">", ">="):
            if a.type in NUMBERS and b.type in NUMBERS or a.type == b.type and a.type in ("string", "bool", "timestamp", "duration"):
                x, y = a.column, b.column
                return _bool({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op])
            return _error()
        return self._arithmetic(op, a, b)

    def _arithmetic(self, op: str, a: Value, b: Value) -> Value:
        x, y = a.column, b.column
        if op == "+" and a.type == b.type == "string":
            return Value("string", F.concat(x, y))
        if op == "+" and a.type == b.type == "list" and a.of == b.of != "mixed":
            return Value("list", F.concat(x, y), of=a.of)
        if a.type in ("timestamp", "duration") or b.type in ("timestamp", "duration"):
            return self._times(op, a, b)
        if a.type != b.type or a.type not in NUMBERS:
            return _error(a.type if a.type in NUMBERS else "int")
        name = {"+": "try_add", "-": "try_subtract", "*": "try_multiply"}.get(op)
        if a.type == "double":
            if op == "/":
                by_zero = F.when(x.isNull() | F.isnan(x) | (x == 0), F.when(x.isNotNull(), F.lit(float("nan")))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
                return Value("double", F.when(y == 0, by_zero).when(y.isNotNull(), _call("try_divide", x, y)))
            return Value("double", _call(name, x, y)) if name else _error("double")
        if a.type == "uint":
            if op in "/%":
                out = F.when(y != 0, F.floor(x / y) if op == "/" else x % y).cast("decimal(20,0)")
            else:
                out = {"+": x + y, "-": x - y, "*": x * y}[op]
            return Value("uint", F.when((out >= 0) & (out <= F.lit(str(2**64 - 1)).cast("decimal(20,0)")), out.cast("decimal(20,0)")))
        if name:
            return Value("int", _call(name, x, y))
        # Division is towards zero, the remainder has the sign of the first; by zero, or of the least number by -1, is an error.
        bad = (y == 0) | ((x == F.lit(-(2**63))) & (y == -1)) if op == "/" else y == 0
        safe = F.when(~bad, y).otherwise(F.lit(1).cast("bigint"))
        return Value("int", F.when(~bad, _call("div", x, safe) if op == "/" else x % safe))

    def _times(self, op: str, a: Value, b: Value) -> Value:
        micros = lambda v: F.unix_micros(v.column) if v.type == "timestamp" else v.column
        kinds = (a.type, op, b.type)
        if kinds in (("timestamp", "+", "duration"), ("duration", "+", "timestamp"), ("timestamp", "-", "duration")):
            return Value("timestamp", F.timestamp_micros(_call("try_add" if op == "+" else "try_subtract", micros(a), micros(b))))
        if kinds in (("timestamp", "-", "timestamp"), ("duration", "+", "duration"), ("duration", "-", "duration")):
            return Value("duration", _call("try_add" if op == "+" else "try_subtract", micros(a), micros(b)))
        return _error("duration")

    def _within(self, a: Value, b: Value) -> Value:
        if b.type == "map":
            if a.type != "string":
                return _bool(F.when(a.column.isNotNull(), False)) if a.null is None else _error()
            return _bool(F.map_contains_key(b.column, a.column))
        if b.type != "list":
            return _error()
        if b.parts is not None:
            out = F.lit(False)
            for p in b.parts:
                out = out | _equal(a, p)
            return _bool(F.when(a.column.isNull() & ~(a.null if a.null is not None else F.lit(False)), None).otherwise(out))
        if a.type == b.of or a.type in NUMBERS and b.of in NUMBERS:
            return _bool(F.exists(b.column, lambda e: e == a.column))
        return _bool(F.when(a.column.isNotNull() & b.column.isNotNull(), False))

    # Members, functions and macros

    def _field(self, n):
        a = self.compile(n.parts[0])
        return Value(a.of, a.column[F.lit(n.value)]) if a.type == "map" else _error("string")

    def _index(self, n):
        a, b = map(self.compile, n.parts)
        if a.type == "map" and b.type == "string":
            return Value(a.of, a.column[b.column])
        if a.type == "list" and b.type == "int" and a.of != "mixed":
            return Value(a.of, F.when(b.column.between(0, 2**31 - 1), F.get(a.column, b.column.cast("int"))))
        return _error(a.of if a.of in _SQL else "string")

    def _function(self, n):
        if n.value == "has":
            if len(n.parts) != 1 or n.parts[0].kind != "field":
                raise FilterSyntaxError("CEL: has() takes a field, as in has(tags.name)")
            a = self.compile(n.parts[0].parts[0])
            return _bool(F.map_contains_key(a.column, F.lit(n.parts[0].value))) if a.type == "map" else _error()
        args = [self.compile(p) for p in n.parts]
        if n.value in ("contains", "startsWith", "endsWith", "matches") and len(args) == 2:
            return self._on_string(n.value, *args)
        if len(args) != 1:
            raise FilterSyntaxError(f"CEL: unknown function {n.value} of {len(args)} arguments")
        a = args[0]
        if n.value == "size":
            return Value("int", F.length(a.column).cast("bigint")) if a.type == "string" else Value("int", F.when(a.column.isNotNull(), F.size(a.column)).cast("bigint")) if a.type in ("list", "map") else _error("int")
        if n.value == "dyn":
            return a
        if n.value == "type":
            name = {"null": "null_type", "timestamp": "google.protobuf.Timestamp", "duration": "google.protobuf.Duration"}.get(a.type, a.type)
            if a.null is None:
                return Value("type", F.when(a.column.isNotNull(), name))
            return Value("type", F.when(a.null, "null_type").when(a.column.isNotNull(), name))
        if n.value in ("int", "uint", "double", "string", "bool", "timestamp", "duration"):
            return self._converted(n.value, a)
        raise FilterSyntaxError(f"CEL: unknown function {n.value}")

    def _converted(self, to: str, a: Value) -> Value:
        c = a.column
        if a.type == to:
            return Value(to, c)
        if a.type == "string":
            if to in ("int", "uint"):
                ok = c.rlike(r"\A[+-]?[0-9]+\z" if to == "int" else r"\A\+?[0-9]+\z")
                out = F.when(ok, c).try_cast("bigint" if to == "int" else "decimal(20,0)")
                return Value(to, out if to == "int" else F.when(out <= F.lit(str(2**64 - 1)).cast("decimal(20,0)"), out))
            if to == "double":
                return Value(to, F.when(c.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z|\A[+-]?(NaN|Infinity|Inf|inf)\z"), c).try_cast("double"))
            if to == "bool":
                return Value(to, F.when(c.isin("1", "t", "true", "TRUE", "True", "T"), True).when(c.isin("0", "f", "false", "FALSE", "False", "F"), False))
            if to == "timestamp":
                return Value(to, F.when(c.rlike(r"\A\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)\z"), c).try_cast("timestamp"))
            if to == "duration":
                if a.literal is None:
                    raise FilterSyntaxError("CEL: duration() takes a literal")
                m = _DURATION.fullmatch(str(a.literal))
                if not m:
                    return _error("duration")
                total = sum(float(x) * _UNITS[u] for x, u in re.findall(r"(\d+(?:\.\d+)?)(h|ms|us|ns|m|s)", m[2]))
                return Value(to, F.lit(round(-total if m[1] == "-" else total)).cast("bigint"))
        if a.type in NUMBERS:
            if to == "double":
                return Value(to, c.cast("double"))
            if to == "string" and a.type != "double":
                return Value(to, c.cast("string"))
            if to == "string":
                return Value(to, F.regexp_replace(c.cast("string"), r"\.0\z", ""))
            if to == "int":
                if a.type == "double":
                    return Value(to, F.when((c > -9.3e18) & (c < 9.3e18), F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))).try_cast("bigint"))
                return Value(to, c.try_cast("bigint"))
            if to == "uint":
                return Value(to, F.when((c >= 0) & (c < 1.8446744073709552e19), F.floor(c)).try_cast("decimal(20,0)"))
        if to == "string" and a.type in ("bool", "timestamp"):
            return Value(to, c.cast("string") if a.type == "bool" else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        if to == "int" and a.type == "timestamp":
            return Value(to, F.unix_seconds(c))
        return _error(to)

    def _on_string(self, name: str, a: Value, b: Value) -> Value:
        if a.type != "string" or b.type != "string":
            return _error()
        if name == "matches":
            if b.literal is not None:
                try:
                    re.compile(re.sub(r"\(\?P?<(\w+)>", r"(?P<\1>", str(b.literal)))
                except re.error as e:
                    raise FilterSyntaxError(f"CEL: {e} in the pattern {b.literal!r}") from e
            return _bool(_call("rlike", a.column, b.column))
        return _bool({"contains": F.contains, "startsWith": F.startswith, "endsWith": F.endswith}[name](a.column, b.column))

    def _call(self, n):
        name, first = n.value, n.parts[0]
        if name in ("all", "exists", "exists_one", "map", "filter") and len(n.parts) == 3:
            return self._macro(name, self.compile(first), *n.parts[1:])
        args = [self.compile(p) for p in n.parts]
        if name in ("contains", "startsWith", "endsWith", "matches") and len(args) == 2:
            return self._on_string(name, *args)
        if name == "size" and len(args) == 1:
            return self._function(Node("function", "size", (first,)))
        if name in _PARTS and len(args) == 1 and args[0].type == "timestamp":
            return Value("int", _PARTS[name](args[0].column).cast("bigint"))
        if name in _LENGTHS and len(args) == 1 and args[0].type == "duration":
            return Value("int", _call("div", args[0].column, F.lit(_LENGTHS[name])))
        if name in _PARTS or name in _LENGTHS:
            return _error("int")
        raise FilterSyntaxError(f"CEL: unknown method {name} of {len(args) - 1} arguments")

    def _macro(self, name: str, a: Value, variable: Node, body: Node) -> Value:
        if variable.kind != "name":
            raise FilterSyntaxError(f"CEL: {name}() takes a name first")
        if a.type not in ("list", "map") or a.of == "mixed":
            return _error("bool" if name in ("all", "exists", "exists_one") else "list")
        items, of = (F.map_keys(a.column), "string") if a.type == "map" else (a.column, a.of)
        inner = lambda e: Compiler(self.scope | {variable.value: Value(of, e)}).compile(body)
        kind: list[Value] = []

        def test(e: Column) -> Column:
            kind.append(v := inner(e))
            if name != "map" and v.type != "bool":
                return F.lit(None).cast("boolean")
            return v.column

        if name == "all":
            return _bool(F.forall(items, test))
        if name == "exists":
            return _bool(F.exists(items, test))
        if name == "map":
            out = F.transform(items, test)
            return Value("list", F.when(~F.coalesce(F.exists(out, lambda e: e.isNull()), F.lit(False)), out), of=kind[0].type if kind[0].type in _SQL else "mixed")
        fails = F.coalesce(F.exists(items, lambda e: test(e).isNull()), F.lit(False))
        found = F.when(~fails, F.filter(items, test))
        return Value("list", found, of=of) if name == "filter" else _bool(F.when(found.isNotNull(), F.size(found) == 1))


_PARTS = {
    "getFullYear": F.year, "getMonth": lambda c: F.month(c) - 1, "getDayOfMonth": lambda c: F.dayofmonth(c) - 1, "getDate": F.dayofmonth, "getDayOfWeek": lambda c: F.dayofweek(c) - 1,
    "getDayOfYear": lambda c: F.dayofyear(c) - 1, "getHours": F.hour, "getMinutes": F.minute, "getSeconds": F.second, "getMilliseconds": lambda c: F.pmod(F.unix_millis(c), F.lit(1000)),
}
_LENGTHS = {"getHours": 3_600_000_000, "getMinutes": 60_000_000, "getSeconds": 1_000_000, "getMilliseconds": 1_000}


def compile_condition(text: str) -> Column:
    """Whether the expression is true; NULL where it is an error or null. For ``where``, which drops both, and can give it to scans."""
    value = Compiler().compile(parse(text))
    if value.type != "bool":
        raise FilterSyntaxError(f"CEL: the expression gives {value.type}, not bool")
    return value.column


def compile_expression(text: str) -> Column:
    """A column that is true where the expression is true, and false where it is false, an error, or null."""
    return F.coalesce(compile_condition(text), F.lit(False))


def apply(text: str, elements: DataFrame) -> DataFrame:
    return elements.where(compile_condition(text))
