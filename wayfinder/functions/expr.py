"""Expressions: their text, their type against a scope, and their Spark columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from .values import coerce, comparable, kind_of, literal_text, parse_timestamp


@dataclass(frozen=True)
class Expr:
    pass


@dataclass(frozen=True)
class Lit(Expr):
    value: object


@dataclass(frozen=True)
class Param(Expr):
    n: int


@dataclass(frozen=True)
class Col(Expr):
    qual: str
    name: str


@dataclass(frozen=True)
class Outer(Expr):
    qual: str
    name: str


@dataclass(frozen=True)
class Cmp(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class And(Expr):
    terms: tuple[Expr, ...]


@dataclass(frozen=True)
class Or(Expr):
    terms: tuple[Expr, ...]


@dataclass(frozen=True)
class Not(Expr):
    x: Expr


@dataclass(frozen=True)
class In(Expr):
    x: Expr
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class IsNull(Expr):
    x: Expr
    negate: bool = False


@dataclass(frozen=True)
class Arith(Expr):
    op: str
    left: Expr
    right: Expr


FLIP = {"=": "=", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


def children(e: Expr) -> tuple[Expr, ...]:
    match e:
        case Cmp(_, a, b) | Arith(_, a, b):
            return (a, b)
        case And(t) | Or(t):
            return t
        case Not(x) | IsNull(x, _):
            return (x,)
        case In(x, items):
            return (x, *items)
    return ()


def walk(e: Expr) -> Iterator[Expr]:
    yield e
    for c in children(e):
        yield from walk(c)


def columns_of(e: Expr) -> set[tuple[str, str]]:
    return {(x.qual, x.name) for x in walk(e) if isinstance(x, Col)}


def bindable(e: Expr) -> bool:
    """Known before a row is read: literals, parameters, outer references and arithmetic over them."""
    return all(isinstance(x, (Lit, Param, Outer, Arith)) for x in walk(e))


def conjuncts(e: Expr) -> list[Expr]:
    return [c for t in e.terms for c in conjuncts(t)] if isinstance(e, And) else [e]


def text(e: Expr) -> str:
    def inner(x: Expr) -> str:
        return f"({text(x)})" if isinstance(x, (Cmp, And, Or, Not, In, IsNull, Arith)) else text(x)

    match e:
        case Lit(v):
            return literal_text(v)
        case Param(n):
            return f"${n}"
        case Col(q, n):
            return f"{q}.{n}" if q else n
        case Outer(q, n):
            return f"$.{q}.{n}" if q else f"$.{n}"
        case Cmp(op, a, b) | Arith(op, a, b):
            return f"{inner(a)} {op} {inner(b)}"
        case And(t):
            return " AND ".join(map(inner, t))
        case Or(t):
            return " OR ".join(map(inner, t))
        case Not(x):
            return f"NOT {inner(x)}"
        case In(x, items):
            return f"{inner(x)} IN ({', '.join(map(text, items))})"
        case IsNull(x, negate):
            return f"{inner(x)} IS {'NOT ' * negate}NULL"
    raise TypeError(e)


Scope = Callable[[Expr], tuple[str, Column]]


class Compiler:
    """Typed translation to Spark columns; `resolve` gives type and column of a Col or Outer."""

    def __init__(self, resolve: Scope, params: tuple = ()):
        self.resolve, self.params = resolve, params

    def value(self, e: Expr) -> object:
        if isinstance(e, Lit):
            return e.value
        if e.n > len(self.params) or e.n < 1:
            raise QueryError(f"missing parameter ${e.n}")
        return self.params[e.n - 1]

    def boolean(self, e: Expr) -> Column:
        kind, c = self.typed(e)
        if kind not in ("bool", "null"):
            raise QueryError(f"not a condition: {text(e)}")
        return c.cast("boolean")

    def column(self, e: Expr) -> Column:
        return self.typed(e)[1]

    def as_type(self, e: Expr, type_: str) -> Column:
        """For keys and stored values: only what the column's type takes."""
        if isinstance(e, (Lit, Param)):
            return literal(coerce(self.value(e), type_), type_)
        kind, c = self.typed(e)
        if kind not in (type_, "null") and (kind, type_) not in (("int", "float"), ("string", "timestamp")):
            raise QueryError(f"cannot use {kind} as {type_}")
        return c if kind == type_ else F.try_to_timestamp(c).cast("timestamp_ntz") if kind == "string" else c.cast({"float": "double", "int": "bigint", "string": "string", "bool": "boolean", "bytes": "binary", "timestamp": "timestamp_ntz"}[type_])

    def typed(self, e: Expr) -> tuple[str, Column]:
        match e:
            case Lit() | Param():
                v = self.value(e)
                return kind_of(v), literal(v, kind_of(v))
            case Col() | Outer():
                return self.resolve(e)
            case Cmp(op, a, b):
                (ka, ca), (kb, cb) = self.pair(a, b)
                if not comparable(ka, kb):
                    raise QueryError(f"cannot compare {ka} with {kb}: {text(e)}")
                return "bool", {"=": ca == cb, "<>": ca != cb, "<": ca < cb, "<=": ca <= cb, ">": ca > cb, ">=": ca >= cb}[op]
            case And(terms) | Or(terms):
                out = None
                for t in terms:
                    c = self.boolean(t)
                    out = c if out is None else out & c if isinstance(e, And) else out | c
                return "bool", F.lit(isinstance(e, And)) if out is None else out
            case Not(x):
                return "bool", ~self.boolean(x)
            case In(x, items):
                if not items:
                    return "bool", F.lit(False)
                cols = [self.pair(x, i) for i in items]
                for (ka, _), (kb, _) in cols:
                    if not comparable(ka, kb):
                        raise QueryError(f"cannot compare {ka} with {kb}: {text(e)}")
                return "bool", cols[0][0][1].isin(*[c for _, (_, c) in cols])
            case IsNull(x, negate):
                c = self.column(x)
                return "bool", c.isNotNull() if negate else c.isNull()
            case Arith(op, a, b):
                (ka, ca), (kb, cb) = self.typed(a), self.typed(b)
                if not {ka, kb} <= {"int", "float", "null"}:
                    raise QueryError(f"cannot calculate with {ka} and {kb}: {text(e)}")
                if "null" in (ka, kb):
                    return "null", F.lit(None).cast("bigint")
                kind = "int" if ka == kb == "int" else "float"
                ca, cb = (c.cast("bigint" if kind == "int" else "double") for c in (ca, cb))
                if op == "/" and kind == "int":
                    return kind, F.call_function("div", ca, cb)
                return kind, {"+": ca + cb, "-": ca - cb, "*": ca * cb, "/": ca / cb, "%": ca % cb}[op]
        raise TypeError(e)

    def pair(self, a: Expr, b: Expr) -> tuple[tuple[str, Column], tuple[str, Column]]:
        """Both sides, a string next to a timestamp as a timestamp."""
        left, right = self.typed(a), self.typed(b)
        for me, other, e in ((left, right, a), (right, left, b)):
            if me[0] == "string" and other[0] == "timestamp":
                c = literal(parse_timestamp(self.value(e)), "timestamp") if isinstance(e, (Lit, Param)) else F.try_to_timestamp(me[1]).cast("timestamp_ntz")
                return (("timestamp", c), right) if me is left else (left, ("timestamp", c))
        return left, right


def literal(v: object, type_: str) -> Column:
    if v is None:
        return F.lit(None)
    if type_ == "timestamp":
        return F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(v).cast("bigint") if type_ == "int" else F.lit(float(v)) if type_ == "float" else F.lit(v)
