"""Plan nodes and their text."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from ..functions.expr import Expr, text


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Get(Node):
    rel: str
    alias: str
    path: str
    key: tuple[Expr, ...]
    cols: tuple[str, ...] = ()


@dataclass(frozen=True)
class GetMany(Node):
    rel: str
    alias: str
    path: str
    keys: tuple[tuple[Expr, ...], ...]
    cols: tuple[str, ...] = ()


@dataclass(frozen=True)
class Scan(Node):
    rel: str
    alias: str
    path: str = "primary"
    eq: tuple[Expr, ...] = ()
    lo: tuple[Expr, bool] | None = None  # bound, inclusive
    hi: tuple[Expr, bool] | None = None
    reverse: bool = False
    limit: int | None = None
    cols: tuple[str, ...] = ()


@dataclass(frozen=True)
class Filter(Node):
    input: Node
    pred: Expr


@dataclass(frozen=True)
class Project(Node):
    input: Node
    exprs: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class Lookup(Node):
    input: Node
    rel: str
    alias: str
    path: str
    key: tuple[Expr, ...]
    many: bool = False
    optional: bool = False
    reverse: bool = False
    limit: int | None = None
    cols: tuple[str, ...] = ()


@dataclass(frozen=True)
class Field:
    name: str
    plan: Node
    one: bool = False
    batched: bool = False


@dataclass(frozen=True)
class Map(Node):
    input: Node
    fields: tuple[Field, ...]


@dataclass(frozen=True)
class Sort(Node):
    input: Node
    keys: tuple[tuple[str, str, bool], ...]  # qualifier, column, descending


@dataclass(frozen=True)
class Limit(Node):
    input: Node
    n: int


@dataclass(frozen=True)
class Insert(Node):
    rel: str
    alias: str
    cols: tuple[str, ...] = ()
    rows: tuple[tuple[Expr, ...], ...] = ()
    input: Node | None = None
    conflict: str = ""  # "", "nothing" or "update"
    set: tuple[tuple[str, Expr], ...] = ()
    returning: tuple[tuple[str, Expr], ...] = ()


@dataclass(frozen=True)
class Update(Node):
    rel: str
    alias: str
    input: Node
    set: tuple[tuple[str, Expr], ...]
    returning: tuple[tuple[str, Expr], ...] = ()


@dataclass(frozen=True)
class Delete(Node):
    rel: str
    alias: str
    input: Node
    returning: tuple[tuple[str, Expr], ...] = ()


def is_one(n: Node) -> bool:
    """At most one row."""
    match n:
        case Get():
            return True
        case Filter(i, _) | Project(i, _) | Map(i, _) | Sort(i, _) | Limit(i, _):
            return is_one(i)
        case Lookup():
            return not n.many and is_one(n.input)
    return False


def _list(items) -> str:
    return f"[{', '.join(items)}]"


def _named(exprs) -> str:
    return _list(text(e) if text(e) == n or text(e).endswith("." + n) else f"{n}: {text(e)}" for n, e in exprs)


def _alias(n) -> str:
    return f"{n.rel} {n.alias}" if n.alias and n.alias != n.rel else n.rel


def _keys(items) -> str:
    return _list(map(text, items))


def explain(n: Node, depth: int = 0) -> str:
    pad = "  " * depth
    tail, below = "", []
    match n:
        case Get():
            head = f"Get {_alias(n)} via {n.path} key={_keys(n.key)}"
        case GetMany():
            head = f"GetMany {_alias(n)} via {n.path} keys={_list(map(_keys, n.keys))}"
        case Scan():
            head = f"Scan {_alias(n)} via {n.path}"
            tail = f" eq={_keys(n.eq)}" * bool(n.eq)
            tail += f" lo>{'=' * n.lo[1]}{text(n.lo[0])}" if n.lo else ""
            tail += f" hi<{'=' * n.hi[1]}{text(n.hi[0])}" if n.hi else ""
            tail += " reverse" * n.reverse + (f" limit={n.limit}" if n.limit is not None else "")
        case Filter(i, p):
            head, below = f"Filter {text(p)}", [i]
        case Project(i, e):
            head, below = f"Project {_named(e)}", [i]
        case Lookup():
            head = f"Lookup {_alias(n)} via {n.path} key={_keys(n.key)} {'many' if n.many else 'one'}{' optional' * n.optional}{' reverse' * n.reverse}"
            tail = f" limit={n.limit}" if n.limit is not None else ""
            below = [n.input]
        case Map(i, fields):
            out = f"{pad}Map\n" + explain(i, depth + 1)
            for f in fields:
                out += f"{pad}  field {f.name} ({'one' if f.one else 'many'}{', batched' * f.batched})\n" + explain(f.plan, depth + 2)
            return out
        case Sort(i, keys):
            head, below = f"Sort {_list((f'{q}.{c}' if q else c) + ' desc' * d for q, c, d in keys)}", [i]
        case Limit(i, k):
            head, below = f"Limit {k}", [i]
        case Insert():
            head = f"Insert {_alias(n)}" + f" cols={_list(n.cols)}" * bool(n.cols) + (f" values={', '.join(map(_keys, n.rows))}" if n.rows else "")
            assigned = _list(f"{c} = {text(e)}" for c, e in n.set)
            head += {"": "", "nothing": " on-conflict=nothing", "update": f" on-conflict=update {assigned}"}[n.conflict]
            below = [n.input] if n.input else []
        case Update():
            head, below = f"Update {_alias(n)} set {_list(f'{c} = {text(e)}' for c, e in n.set)}", [n.input]
        case Delete():
            head, below = f"Delete {_alias(n)}", [n.input]
        case _:
            raise TypeError(n)
    if isinstance(n, (Get, GetMany, Scan, Lookup)) and n.cols:
        tail += f" cols={_list(n.cols)}"
    if isinstance(n, (Insert, Update, Delete)) and n.returning:
        tail += f" returning {_named(n.returning)}"
    return f"{pad}{head}{tail}\n" + "".join(explain(b, depth + 1) for b in below)


__all__ = ["Delete", "Field", "Filter", "Get", "GetMany", "Insert", "Limit", "Lookup", "Map", "Node", "Project", "Scan", "Sort", "Update", "explain", "field", "is_one", "replace"]
