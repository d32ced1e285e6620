"""Short names for building plans by hand: build.Eq(build.C("o", "id"), build.I(5))."""

from __future__ import annotations

from datetime import datetime

from ..functions.expr import And, Arith, Cmp, Col, Expr, Lit, Or, Outer, Param


def C(qual: str, name: str) -> Col:
    """A column of this row."""
    return Col(qual, name)


def O(qual: str, name: str) -> Outer:  # noqa: E743
    """A column of the row around a nested plan."""
    return Outer(qual, name)


def P(n: int) -> Param:
    """The n-th parameter, from 1."""
    return Param(n)


def V(value: bool | int | float | str | bytes | datetime | None) -> Lit:
    """Any value."""
    return Lit(value)


def I(value: int) -> Lit:  # noqa: E743
    return Lit(int(value))


def F(value: float) -> Lit:
    return Lit(float(value))


def S(value: str) -> Lit:
    return Lit(str(value))


def _comparison(op: str, doc: str):
    def make(left: Expr, right: Expr) -> Cmp:
        return Cmp(op, left, right)

    make.__doc__ = doc
    return make


Eq = _comparison("=", "equal")
Ne = _comparison("<>", "not equal")
Lt = _comparison("<", "less")
Le = _comparison("<=", "less or equal")
Gt = _comparison(">", "greater")
Ge = _comparison(">=", "greater or equal")


def AndOf(*terms: Expr) -> And:
    return And(terms)


def OrOf(*terms: Expr) -> Or:
    return Or(terms)


def Add(left: Expr, right: Expr) -> Arith:
    return Arith("+", left, right)


def Exprs(*exprs: Expr) -> tuple[Expr, ...]:
    """A key, or the values of a row."""
    return exprs


def As(name: str, e: Expr) -> tuple[str, Expr]:
    """A named expression of a projection."""
    return name, e
