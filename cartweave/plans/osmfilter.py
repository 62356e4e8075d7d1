"""OSMFilter programs: text to statements, statements to DataFrame steps.

A program that only selects, commits and drops is one expression over the original columns, so that scans can use it. Any other is a
chain of projections that carry, for each tag key the program names, its present value, and a status; what a selector says
on entry of its block is kept in a column. A non-deterministic column before the closing filter keeps the optimizer from
substituting the chain into filters, which would grow exponentially with the number of statements.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartweave.errors import FilterSyntaxError
from cartweave.functions import tags as G

LANGUAGE_VERSION = "0.2.0"
CONTINUE, COMMITTED, DROPPED = 0, 1, 2
SHORT = 256  #: a program of selectors that needs up to so many tests as one condition becomes one


@dataclass(frozen=True)
class Set:
    key: str
    value: str


@dataclass(frozen=True)
class Rename:
    old: str
    new: str


@dataclass(frozen=True)
class Keep:
    keys: tuple[str, ...]


@dataclass(frozen=True)
class Delete:
    keys: tuple[str, ...]


@dataclass(frozen=True)
class Commit:
    pass


@dataclass(frozen=True)
class Drop:
    pass


@dataclass(frozen=True)
class TypeIs:
    types: tuple[str, ...]


@dataclass(frozen=True)
class Has:
    key: str


@dataclass(frozen=True)
class Equals:
    key: str
    value: str


@dataclass(frozen=True)
class Block:
    selector: TypeIs | Has | Equals
    body: tuple


@dataclass(frozen=True)
class Program:
    version: str
    body: tuple


_HEADER = re.compile(r"OSMFilter v?([0-9]+\.[0-9]+\.[0-9]+)(?:\r\n|\n|\r){2}")
_NEWLINE = re.compile(r"\r\n|\n|\r")
_STRING = re.compile(r'"((?:[^"\\]|\\["\\/bfnrt]|\\u[0-9A-Fa-f]{4})*)"', re.S)
_COMMENT = re.compile(r"#[^\r\n]*")
_TRAILING = re.compile(r" +#[^\r\n]*")
_TYPE = re.compile(r"node|way|relation")
_ESCAPE = re.compile(r'\\(?:u([0-9A-Fa-f]{4})|(["\\/bfnrt]))')
_SHORT = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


class _Parser:
    def __init__(self, text: str, decode: bool):
        self.text, self.at, self.decode, self.furthest = text, 0, decode, 0

    def take(self, pattern: re.Pattern) -> re.Match | None:
        m = pattern.match(self.text, self.at)
        if m:
            self.at = m.end()
            self.furthest = max(self.furthest, self.at)
        return m

    def word(self, word: str) -> bool:
        if self.text.startswith(word, self.at):
            self.at += len(word)
            self.furthest = max(self.furthest, self.at)
            return True
        return False

    def string(self) -> str | None:
        m = self.take(_STRING)
        if m is None:
            return None
        raw = m[1]
        return _ESCAPE.sub(lambda e: chr(int(e[1], 16)) if e[1] else _SHORT.get(e[2], e[2]), raw) if self.decode else raw

    def strings(self) -> tuple[str, ...] | None:
        return self.listed(self.string)

    def listed(self, one) -> tuple | None:
        first = one()
        if first is None:
            return None
        out = [first]
        while True:
            start = self.at
            if not self.word(", ") or (x := one()) is None:
                self.at = start
                return tuple(out)
            out.append(x)

    def pair(self) -> tuple[str, str] | None:
        a = self.string()
        if a is None or not self.word(" ") or (b := self.string()) is None:
            return None
        return a, b

    def modifier(self):
        start = self.at
        for word, read, make in (("SET ", self.pair, lambda p: Set(*p)), ("RENAME ", self.pair, lambda p: Rename(*p)), ("KEEP ", self.strings, Keep), ("DELETE ", self.strings, Delete)):
            if self.word(word):
                if (got := read()) is not None:
                    return make(got)
                self.at = start
        if self.word("COMMIT"):
            return Commit()
        return Drop() if self.word("DROP") else None

    def selector(self):
        start = self.at
        one_type = lambda: m[0] if (m := self.take(_TYPE)) else None
        for word, read, make in (("TYPE ", lambda: self.listed(one_type), TypeIs), ("HAS ", self.string, Has), ("EQUALS ", self.pair, lambda p: Equals(*p))):
            if self.word(word):
                if (got := read()) is not None:
                    return make(got)
                self.at = start
        return None

    def statement(self, level: int) -> list | None:
        """A list of no statement (a comment) or one; None if there is none here."""
        start = self.at
        if self.take(_COMMENT):
            got = []
        elif (m := self.modifier()) is not None:
            got = [m]
        elif (s := self.selector()) is not None:
            self.take(_TRAILING)
            if not self.take(_NEWLINE) or (body := self.block(level + 1)) is None:
                self.at = start
                return None
            got = [Block(s, tuple(body))]
        else:
            return None
        self.take(_TRAILING)
        return got

    def block(self, level: int) -> list | None:
        indent = "\t" * level
        if not self.word(indent) or (got := self.statement(level)) is None:
            return None
        out = list(got)
        while True:
            start = self.at
            if not self.take(_NEWLINE) or not self.word(indent) or (got := self.statement(level)) is None:
                self.at = start
                return out
            out += got

    def program(self) -> Program:
        header = self.take(_HEADER)
        if not header:
            raise FilterSyntaxError("no OSMFilter header: 'OSMFilter vX.Y.Z' and an empty line")
        out, some = [], False
        while self.at < len(self.text):
            got = self.statement(0)
            if got is None and not self.take(_NEWLINE):
                where = self.text.count("\n", 0, self.furthest) + 1
                raise FilterSyntaxError(f"OSMFilter: line {where}: can't read {self.text[self.furthest : self.furthest + 40]!r}")
            out += got or []
            some = True
        if not some:
            raise FilterSyntaxError("OSMFilter: nothing follows the header")
        return Program(header[1], tuple(out))


def parse(text: str, decode_escapes: bool = False) -> Program:
    """The program of a text. Escapes in strings stay as they are written unless ``decode_escapes``."""
    program = _Parser(text, decode_escapes).program()
    if program.version != LANGUAGE_VERSION:
        warnings.warn(f"the filter is for OSMFilter {program.version}, this is {LANGUAGE_VERSION}", stacklevel=2)
    return program


def reachable(body: Sequence) -> tuple:
    """Without what follows a COMMIT or DROP of the same block, and without blocks that do nothing."""
    out = []
    for s in body:
        if isinstance(s, Block):
            inner = reachable(s.body)
            if inner:
                out.append(Block(s.selector, inner))
            continue
        out.append(s)
        if isinstance(s, Commit | Drop):
            break
    return tuple(out)


def walk(body: Sequence) -> Iterator:
    for s in body:
        yield s
        if isinstance(s, Block):
            yield from walk(s.body)


# Reference semantics, a row at a time: for tests, and for programs that are too long for a plan.


def evaluate(program: Program, kind: str, tags: dict[str, str]) -> tuple[bool, dict[str, str]]:
    """Whether the row stays, and its tags."""
    tags = dict(tags)

    def test(s) -> bool:
        if isinstance(s, TypeIs):
            return kind in s.types
        return s.key in tags if isinstance(s, Has) else tags.get(s.key) == s.value

    def run(body) -> int:
        for s in body:
            match s:
                case Set(k, v):
                    tags[k] = v
                case Rename(a, b):
                    if a in tags:
                        tags[b] = tags.pop(a)
                case Keep(keys):
                    for k in [k for k in tags if k not in keys]:
                        del tags[k]
                case Delete(keys):
                    for k in keys:
                        tags.pop(k, None)
                case Commit():
                    return COMMITTED
                case Drop():
                    return DROPPED
                case Block(selector, inner):
                    if test(selector) and (status := run(inner)):
                        return status
        return CONTINUE

    return run(program.body) != DROPPED, tags


# Compilation


def _decision(body: Sequence) -> Column:
    """The first decision that is reached in a program without modifiers, else null."""
    parts = []
    for s in body:
        if isinstance(s, Block):
            parts.append(F.when(_on_tags(s.selector), _decision(s.body)))
        else:
            parts.append(F.lit(COMMITTED if isinstance(s, Commit) else DROPPED))
    return F.coalesce(*parts) if parts else F.lit(None).cast("int")


def _kept(body: tuple, limit: int) -> Column | bool | None:
    """The same as a condition of selectors alone, of which scans can use parts; None if it would be longer than the limit."""
    if not body:
        return True
    first, rest = body[0], body[1:]
    if isinstance(first, Commit | Drop):
        return isinstance(first, Commit)
    if limit <= 0:
        return None
    yes, no = _kept((*first.body, *rest), limit // 2), _kept(rest, limit // 2)
    if yes is None or no is None:
        return None
    if isinstance(yes, bool) and isinstance(no, bool) and yes == no:
        return yes
    test = _on_tags(first.selector)
    some = lambda own, other: own & other if not isinstance(other, bool) else own if other else None
    parts = [p for p in (some(test, yes), some(~test, no)) if p is not None]
    return parts[0] if len(parts) == 1 else parts[0] | parts[1]


def _on_tags(s) -> Column:
    if isinstance(s, TypeIs):
        return F.col("type").isin(*s.types)
    return G.has_tag(F.col("tags"), s.key) if isinstance(s, Has) else G.tag_equals(F.col("tags"), s.key, s.value)


def apply(program: Program, elements: DataFrame) -> DataFrame:
    """The elements that the program keeps, with the tags that it leaves; other columns pass."""
    body = reachable(program.body)
    if all(isinstance(s, Block | Commit | Drop) for s in walk(body)):
        if not any(isinstance(s, Drop) for s in walk(body)):
            return elements
        kept = _kept(body, SHORT)
        if kept is None:
            return elements.where(F.coalesce(_decision(body), F.lit(COMMITTED)) != DROPPED)
        return elements.where(kept if isinstance(kept, Column) else F.lit(kept))
    return _chain(body, elements)


def _keys(body: Sequence) -> list[str]:
    out: dict[str, None] = {}
    for s in walk(body):
        s = s.selector if isinstance(s, Block) else s
        match s:
            case Set(k, _) | Has(k) | Equals(k, _):
                out[k] = None
            case Rename(a, b):
                out[a] = out[b] = None
            case Keep(keys) | Delete(keys):
                out.update(dict.fromkeys(keys))
    return list(out)


def _chain(body: Sequence, elements: DataFrame) -> DataFrame:
    columns, keys = elements.columns, _keys(body)
    name = {k: f"__tag{i}" for i, k in enumerate(keys)}
    frame = elements.withColumns({**{n: F.col("tags")[F.lit(k)] for k, n in name.items()}, "__rest": F.lit(True), "__status": F.lit(CONTINUE)})
    blocks = 0
    null = F.lit(None).cast("string")

    def test(s) -> Column:
        if isinstance(s, TypeIs):
            return F.col("type").isin(*s.types)
        value = F.col(name[s.key])
        return value.isNotNull() if isinstance(s, Has) else value.eqNullSafe(F.lit(s.value))

    def run(body, guard: Column) -> None:
        nonlocal frame, blocks
        for s in body:
            on = guard & (F.col("__status") == CONTINUE)
            change: dict[str, Column] = {}
            match s:
                case Set(k, v):
                    change[name[k]] = F.lit(v)
                case Rename(a, b) if a != b:
                    has = F.col(name[a]).isNotNull()
                    change[name[b]] = F.when(has, F.col(name[a])).otherwise(F.col(name[b]))
                    change[name[a]] = null
                case Keep(kept):
                    change = {n: null for k, n in name.items() if k not in kept} | {"__rest": F.lit(False)}
                case Delete(gone):
                    change = {name[k]: null for k in gone}
                case Commit():
                    change["__status"] = F.lit(COMMITTED)
                case Drop():
                    change["__status"] = F.lit(DROPPED)
                case Block(selector, inner):
                    blocks += 1
                    entered = f"__in{blocks}"
                    frame = frame.withColumn(entered, on & test(selector))
                    run(inner, F.col(entered))
                    continue
            if change:
                frame = frame.withColumns({n: F.when(on, c).otherwise(F.col(n)) for n, c in change.items()})

    run(body, F.lit(True))
    # The barrier: without it later filters would be pushed into the chain, with every step substituted into the next.
    frame = frame.withColumn("__barrier", F.rand(0)).where((F.col("__status") != DROPPED) & (F.col("__barrier") >= 0))
    rest = F.map_filter("tags", lambda k, _: F.col("__rest") & ~k.isin(*keys)) if keys else F.map_filter("tags", lambda k, _: F.col("__rest"))
    if keys:
        pairs = [x for k, n in name.items() for x in (F.lit(k), F.col(n))]
        rest = F.map_concat(rest, F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()))
    return frame.withColumn("tags", rest).select(*(F.col(f"`{c}`") for c in columns))


def apply_by_rows(program: Program, elements: DataFrame) -> DataFrame:
    """The same by the interpreter over Arrow batches: for programs of hundreds of statements, whose plans are slow to make."""
    import pyarrow as pa

    body = Program(program.version, reachable(program.body))

    def run(batches):
        for b in batches:
            kept, tags = [], []
            for i, (kind, pairs) in enumerate(zip(b.column("type").to_pylist(), b.column("tags").to_pylist(), strict=True)):
                ok, new = evaluate(body, kind, dict(pairs))
                if ok:
                    kept.append(i)
                    tags.append(list(new.items()))
            out = b.take(pa.array(kept, pa.int64()))
            columns = [pa.array(tags, b.schema.field("tags").type) if c == "tags" else out.column(c) for c in b.schema.names]
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return elements.mapInArrow(run, elements.schema)
