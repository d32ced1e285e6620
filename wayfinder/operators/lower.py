"""Plans as DataFrames.

Access paths decide what is legal and in which order rows come; how data is read, joined and sorted is
Catalyst's choice: keys and bounds become predicates that reach the scan, Lookups equality joins, nested
fields one grouped aggregate by the parent's key columns, limits a top-k under a total order.

A nested plan that names its outer row only where a key equals it is grouped by that key. Any other (an outer
reference in a filter, a bound or an expression, a limit below another step) is run over the distinct values of
the outer columns that it names: they are joined to the relation that it reads and go with its rows, and limits
count for each of them. Below a limit whose outer references bind only the keys and bounds of the read, that join meets
no more rows than the limit lets through: rows are numbered once for each key, and a bound is a place among them.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.expr import And, Cmp, Col, Compiler, Expr, Lit, Outer, Param, conjuncts, text, walk
from ..functions.values import coerce
from ..plans.nodes import Field, Filter, Get, GetMany, Limit, Lookup, Map, Node, Project, Scan, Sort, is_one
from ..plans.policy import outers
from ..sources.catalog import SPARK_TYPES, Catalog, Relation

Order = list[tuple[str, bool]]  # internal column, descending

#: A longer list of keys becomes a table that is joined; up to BROADCAST_KEYS of them it is broadcast.
KEYS_IN_PREDICATE, BROADCAST_KEYS = 50, 100_000


class RowByRow(Exception):
    """A nested plan that uses its outer row for more than key equalities."""


def internal(alias: str, col: str) -> str:
    return f"{alias}__{col}"


@dataclass
class Frame:
    df: DataFrame
    types: dict[tuple[str, str], str]  # (alias, column) -> kind
    order: Order  # a total order of the rows
    key: list[str]  # internal columns that tell rows apart
    names: list[tuple[str, str]] = field(default_factory=list)  # output name, internal column, of a projection
    narrow: bool = False  # keys, bounds, filters or limits leave out part of the relation
    outer: dict[tuple[str, str], tuple[str, str]] = field(default_factory=dict)  # outer columns that go with the rows: kind, internal column

    @property
    def per(self) -> list[str]:
        """The columns that tell for which outer values a row stands."""
        return [c for _, c in self.outer.values()]

    def resolve(self, e: Expr) -> tuple[str, Column]:
        if isinstance(e, Outer):
            if (e.qual, e.name) not in self.outer:
                raise QueryError(f"outer reference {text(e)} outside a nested plan")
            kind, c = self.outer[e.qual, e.name]
            return kind, F.col(c)
        hits = [k for k in self.types if k[1] == e.name and e.qual in ("", k[0])]
        if not hits:
            raise QueryError(f"unknown column {text(e)}")
        if len(hits) > 1:
            raise QueryError(f"ambiguous column {e.name}")
        return self.types[hits[0]], F.col(f"`{internal(*hits[0])}`")


@dataclass
class Within:
    """The read of a nested plan, of rows that an outer row reaches: keys are those rows' values of the columns."""

    scan: Scan
    columns: list[str]
    keys: DataFrame


def sort_columns(order: Order) -> list[Column]:
    return [F.col(f"`{c}`").desc() if d else F.col(f"`{c}`").asc() for c, d in order]


class Lowering:
    def __init__(self, catalog: Catalog, tables, params: tuple = ()):
        self.catalog, self.tables, self.params = catalog, tables, params
        self.n = 0
        #: what the next relation read is joined to: distinct outer values, and their columns
        self.around: tuple[DataFrame, dict[tuple[str, str], tuple[str, str]]] | None = None

    def compiler(self, f: Frame) -> Compiler:
        return Compiler(f.resolve, self.params)

    def fresh(self, name: str) -> str:
        self.n += 1
        return f"__{name}{self.n}"

    def read(self, rel: Relation, alias: str) -> Frame:
        df = self.tables.frame(rel.name)
        df = df.select(*[F.col(f"`{c}`").alias(internal(alias, c)) for c in rel.names])
        return Frame(df, {(alias, c.name): c.type for c in rel.columns}, [], [internal(alias, c) for c in rel.primary.key])

    def path_order(self, rel: Relation, alias: str, path: str, bound: int, reverse: bool) -> Order:
        cols = list(rel.path(path).key[bound:])
        cols += [c for c in rel.primary.key if c not in cols]
        return [(internal(alias, c), reverse) for c in cols]

    def run(self, n: Node, ordered: bool = True) -> DataFrame:
        """The result; ordered: its rows in the order that the query asks for."""
        f = self.lower(n)
        if ordered and f.order:
            f.df = f.df.orderBy(*sort_columns(f.order))
        return self.output(f)

    def output(self, f: Frame) -> DataFrame:
        return f.df.select(*self.labelled(f))

    def labelled(self, f: Frame) -> list[Column]:
        """The columns of the result; those of one name carry their table's, too."""
        names = f.names or [(c, internal(a, c)) for a, c in f.types]
        seen: dict[str, int] = {}
        for name, _ in names:
            seen[name] = seen.get(name, 0) + 1
        out, used = [], set()
        for name, col in names:
            label = name if seen[name] == 1 else col.replace("__", ".", 1)
            while label in used:
                label += "_"
            used.add(label)
            out.append(F.col(f"`{col}`").alias(label))
        return out

    def lower(self, n: Node) -> Frame:
        match n:
            case Scan(limit=int(k)) if self.around:
                return self.first_of_each(replace(n, limit=None), k)
            case Get() | GetMany() | Scan():
                return self.access(n)
            case Filter(i, p):
                f = self.lower(i)
                f.df, f.narrow = f.df.where(self.compiler(f).boolean(p)), True
                return f
            case Within():
                f = self.access(n.scan)
                f.df, f.narrow = self.reached(f.df, n.columns, n.keys), True
                return f
            case Lookup():
                return self.lookup(n)
            case Limit(i, k):
                return self.first_of_each(i, k) if self.around else self.first_rows(self.lower(i), k)
            case Map(i, fields):
                f = self.lower(i)
                plain = f.df
                for x in fields:
                    self.nest(f, x, plain)
                return f
            case Project(i, exprs):
                f = self.lower(i)
                c = self.compiler(f)
                # sort columns stay until the end
                done = [(name, self.fresh("p"), c.column(e)) for name, e in exprs]
                f.df = f.df.select("*", *[col.alias(k) for _, k, col in done])
                plain = {k: internal(*next(t for t in f.types if t[1] == e.name and e.qual in ("", t[0]))) for (_, k, _), (_, e) in zip(done, exprs) if isinstance(e, Col)}
                f.names = [(name, plain.get(k, k)) for name, k, _ in done]
                return f
            case Sort():
                raise QueryError("a sort that no access path provides")
        raise TypeError(n)

    def first_rows(self, f: Frame, k: int) -> Frame:
        """The first k rows, of each outer value where there are any."""
        if f.per:
            rank = self.fresh("rank")
            w = Window.partitionBy(*f.per).orderBy(*sort_columns(f.order))
            f.df = f.df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k).drop(rank)
        else:
            f.df = f.df.orderBy(*sort_columns(f.order)).limit(k)
        f.narrow = True
        return f

    def first_of_each(self, n: Node, limit: int) -> Frame:
        """The first rows of a nested plan for each of the outer values that its read is to be joined to."""
        match n:
            case Project() | Map() | Lookup(many=False, optional=True):  # as many rows above as below
                return self.lower(replace(n, input=Limit(n.input, limit)))
            case Limit(i, k):
                return self.first_of_each(i, min(k, limit))
            case Scan(limit=int(k)):
                return self.first_of_each(replace(n, limit=None), min(k, limit))
        scan = leaf(n)
        if not isinstance(scan, Scan) or limited(n):
            return self.first_rows(self.lower(n), limit)
        # in the order of the rows, a bound tells where they begin or where they end
        ends = [(last, *b) for last, b in ((scan.reverse, scan.lo), (not scan.reverse, scan.hi)) if b and has_outer(b[0])]
        free = replace(scan, eq=tuple(None if has_outer(e) else e for e in scan.eq), lo=None if scan.lo and has_outer(scan.lo[0]) else scan.lo, hi=None if scan.hi and has_outer(scan.hi[0]) else scan.hi)
        if outers(upon(n, free)):
            return self.first_rows(self.lower(n), limit)

        (keys, held), self.around = self.around, None
        c = self.compiler(Frame(keys, {}, [], [], outer=held))
        rel, alias = self.catalog.relation(scan.rel), scan.alias or scan.rel
        key = [rel.column(x) for x in rel.path(scan.path).key]
        links = {internal(alias, x.name): c.as_type(e, x.type) for x, e in zip(key, scan.eq) if has_outer(e)}
        names = [self.fresh("k") for _ in links]
        keys = keys.select("*", *[v.alias(k) for k, v in zip(names, links.values())])
        by = [F.col(f"`{x}`") for x in links]
        f = self.lower(upon(n, Within(free, list(links), keys.select(*names).distinct()) if links else free))
        on = reduce(and_, [F.col(k) == x for k, x in zip(names, by)], F.lit(True))
        rank, start, stop = self.fresh("rank"), self.fresh("start"), self.fresh("stop")
        if ends:
            end = key[len(scan.eq)]
            f.df = f.df.where(F.col(f"`{internal(alias, end.name)}`").isNotNull())
            marks = f.df.select(*[x.alias(k) for k, x in zip(names, by)], F.col(f"`{internal(alias, end.name)}`").alias(self.fresh("v")))
            keys = keys.withColumn(start, F.lit(0).cast("bigint"))
            for last, e, inclusive in ends:
                keys = self.placed(keys, marks, c.as_type(e, end.type), scan.reverse, last == inclusive, stop if last else start, None if last or len(ends) == 2 else stop)
            n_rows = F.least(F.lit(limit).cast("bigint"), F.col(stop) - F.col(start))
            keys = keys.where(n_rows > 0).withColumn(stop, F.explode(F.sequence(F.col(start) + 1, F.col(start) + n_rows)))
            f.df, on = self.ranked(f, by, rank), on & (F.col(stop) == F.col(rank))
        elif links:
            f.df = self.ranked(f, by, rank).where(F.col(rank) <= limit)
        else:
            f = self.first_rows(f, limit)
        f.df, f.outer, f.narrow = keys.join(f.df, on).drop(*names, rank, start, stop), held, True
        f.key = [*f.per, *f.key]
        return f

    def ranked(self, f: Frame, by: list[Column], rank: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*sort_columns(f.order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return f.df.withColumn(rank, F.count(F.lit(1)).over(w))

    def placed(self, keys: DataFrame, marks: DataFrame, value: Column, down: bool, after: bool, place: str, total: str | None) -> DataFrame:
        """The keys with the number of marks before their value, those that equal it counted if after, and with the total
        number. Marks hold columns that the keys hold too, which must agree, and a value. Keys without a value go."""
        *by, v = marks.columns
        turn = self.fresh("turn")
        keys = keys.drop(place).select("*", value.alias(v), F.lit(2 if after else 0).alias(turn)).where(F.col(v).isNotNull())
        w = Window.partitionBy(*by).orderBy(*sort_columns([(v, down), (turn, False)]))
        counts = {place: Window.currentRow} | ({total: Window.unboundedFollowing} if total else {})
        both = keys.unionByName(marks.withColumn(turn, F.lit(1)), allowMissingColumns=True)
        both = both.select("*", *[F.count(F.when(F.col(turn) == 1, 1)).over(w.rowsBetween(Window.unboundedPreceding, to)).alias(c) for c, to in counts.items()])
        return both.where(F.col(turn) != 1).drop(v, turn)

    def access(self, n: Get | GetMany | Scan) -> Frame:
        rel = self.catalog.relation(n.rel)
        alias = n.alias or n.rel
        f = self.read(rel, alias)
        if self.around:
            # the predicates below make it a join on keys and bounds
            (keys, f.outer), self.around = self.around, None
            f.df, f.key = keys.crossJoin(f.df), [*f.per, *f.key]
        key = rel.path(n.path).key
        c = self.compiler(f)

        def at(i: int) -> Column:
            return F.col(f"`{internal(alias, key[i])}`")

        def bound(e: Expr, i: int) -> Column:
            return c.as_type(e, rel.column(key[i]).type)

        match n:
            case Get():
                for i, e in enumerate(n.key):
                    f.df = f.df.where(at(i) == bound(e, i))
                f.order = self.path_order(rel, alias, n.path, len(n.key), False)
            case GetMany():
                if any(len(k) != len(key) for k in n.keys):
                    raise QueryError(f"the keys of {rel.name}.{n.path} have {len(key)} columns each")
                f.order = self.path_order(rel, alias, n.path, 0, False)
                place = self.fresh("place")
                if len(n.keys) > KEYS_IN_PREDICATE and all(isinstance(e, (Lit, Param)) for k in n.keys for e in k):
                    f.df = self.listed(f.df, n, rel, [internal(alias, k) for k in key], place)
                else:
                    hits = [reduce(and_, [at(i) == bound(e, i) for i, e in enumerate(k)]) for k in n.keys]
                    # one column: a list of values reaches the scan as it is
                    f.df = f.df.where(at(0).isin(*[bound(k[0], 0) for k in n.keys]) if len(key) == 1 else reduce(or_, hits, F.lit(False)))
                    if len(n.keys) > 1:
                        f.df = f.df.withColumn(place, F.coalesce(*[F.when(hit, F.lit(i)) for i, hit in enumerate(hits)]))
                if len(n.keys) > 1:  # a limit above takes rows in the order of the list
                    f.order = [(place, False), *f.order]
            case Scan():
                for i, e in enumerate(n.eq):
                    if e is not None:  # first_of_each joins its value
                        f.df = f.df.where(at(i) == bound(e, i))
                i = len(n.eq)
                if n.lo:
                    b = bound(n.lo[0], i)
                    f.df = f.df.where(at(i) >= b if n.lo[1] else at(i) > b)
                if n.hi:
                    b = bound(n.hi[0], i)
                    f.df = f.df.where(at(i) <= b if n.hi[1] else at(i) < b)
                f.order = self.path_order(rel, alias, n.path, i, n.reverse)
                if n.limit is not None:
                    self.first_rows(f, n.limit)
        f.narrow = not isinstance(n, Scan) or bool(n.eq or n.lo or n.hi or n.limit is not None)
        return f

    def listed(self, df: DataFrame, n: GetMany, rel: Relation, columns: list[str], place: str) -> DataFrame:
        """The rows whose key is in the list, with the place of its first mention; the list becomes a table."""
        kinds = [rel.column(c).type for c in rel.path(n.path).key]
        first: dict[tuple, int] = {}
        compiler = Compiler(lambda e: (_ for _ in ()).throw(QueryError("a key takes values")), self.params)
        for i, k in enumerate(n.keys):
            first.setdefault(tuple(coerce(compiler.value(e), t) for e, t in zip(k, kinds)), i)
        names = [self.fresh("key") for _ in columns]
        ddl = ", ".join([f"{c} {SPARK_TYPES[t]}" for c, t in zip(names, kinds)] + [f"{place} int"])
        keys = df.sparkSession.createDataFrame([(*k, i) for k, i in first.items()], ddl)
        on = reduce(and_, [F.col(f"`{c}`") == F.col(k) for c, k in zip(columns, names)])
        return df.join(F.broadcast(keys) if len(first) <= BROADCAST_KEYS else keys, on).drop(*names)

    def keys_of(self, f: Frame, exprs: list[Expr], cols: list[Column], df: DataFrame) -> DataFrame:
        """The distinct values of cols (for the expressions, of the frame's rows df)."""
        keys = df.select(*[c.alias(self.fresh("o")) for c in cols])
        plain = {internal(*t) for e in exprs if isinstance(e, (Col, Outer)) for t in f.types if t[1] == e.name and e.qual in ("", t[0])}
        return keys if f.key and plain.issuperset(f.key) else keys.distinct()

    def reached(self, df: DataFrame, columns: list[str], keys: DataFrame) -> DataFrame:
        """The rows that the keys reach, so that what follows ranks and groups no others."""
        new = [self.fresh("r") for _ in columns]
        cond = None
        for c, k in zip(columns, new):
            one = F.col(f"`{c}`") == F.col(k)
            cond = one if cond is None else cond & one
        return df.join(keys.toDF(*new), cond, "left_semi")

    def lookup(self, n: Lookup) -> Frame:
        f = self.lower(n.input)
        rel = self.catalog.relation(n.rel)
        alias = n.alias or n.rel
        t = self.read(rel, alias)
        c = self.compiler(f)
        path = rel.path(n.path)
        keys = []
        left = f.df
        for e, col in zip(n.key, path.key):
            k = self.fresh("k")
            left = left.withColumn(k, c.as_type(e, rel.column(col).type))
            keys.append((k, internal(alias, col)))
        cond = None
        for k, col in keys:
            one = F.col(k) == F.col(f"`{col}`")
            cond = one if cond is None else cond & one
        order = self.path_order(rel, alias, n.path, len(n.key), n.reverse)
        right = t.df
        if n.many and n.limit is not None:
            # the first rows of each key; the input has one row, or shares what its keys reach
            w = Window.partitionBy(*[F.col(f"`{col}`") for _, col in keys]).orderBy(*sort_columns(order))
            rank = self.fresh("rank")
            if f.narrow:
                right = self.reached(right, [col for _, col in keys], self.keys_of(f, list(n.key), [F.col(k) for k, _ in keys], left))
            right = right.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n.limit).drop(rank)
        df = left.join(right, cond, "left" if n.optional else "inner").drop(*[k for k, _ in keys])
        return Frame(df, f.types | t.types, f.order + order if n.many else f.order, f.key + t.key if n.many else f.key, narrow=f.narrow, outer=f.outer)

    def nest(self, f: Frame, x: Field, plain: DataFrame) -> None:
        """Add a list of records, or one record or NULL, of the rows that the outer row reaches; plain: the outer rows
        without other fields, so that what a field reads does not run those before it again."""
        try:
            inner, pairs, limit = self.linked(f, x, plain)
        except RowByRow:
            inner, pairs, limit = self.correlated(f, x, plain), [], None
            pairs = [(c, f.resolve(Col(*o))[1]) for o, (_, c) in inner.outer.items()]
        by = [F.col(k) for k, _ in pairs]
        record = F.struct(*self.labelled(inner))
        rank = self.fresh("rank")
        turns = {d for _, d in inner.order}
        if limit is not None or len(turns) > 1:
            inner.df = inner.df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*sort_columns(inner.order))))
            inner.df, place, down = inner.df if limit is None else inner.df.where(F.col(rank) <= limit), [F.col(rank)], False
        else:  # one direction: arrays sort as the rows would
            place, down = [F.col(f"`{c}`") for c, _ in inner.order], turns == {True}
        out = self.fresh("nested")
        if x.one:
            grouped = inner.df.select(*by, record.alias(out))
        else:
            item = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(place)], record.alias("record"))
            grouped = inner.df.groupBy(*by).agg(F.sort_array(F.collect_list(item), not down).alias(out))
            grouped = grouped.withColumn(out, F.transform(out, lambda s: s["record"]))
        # no pairs: one row, the same for every outer row
        cond = reduce(and_, [outer.eqNullSafe(F.col(k)) if inner.outer else outer == F.col(k) for k, outer in pairs], F.lit(True))
        f.df = f.df.join(grouped if pairs else F.broadcast(grouped), cond, "left").drop(*[k for k, _ in pairs])
        col = internal("", x.name)
        empty = F.array().cast(grouped.schema[out].dataType) if not x.one else None
        f.df = f.df.withColumn(col, F.col(out) if x.one else F.coalesce(F.col(out), empty)).drop(out)
        f.types[("", x.name)] = "nested"

    def linked(self, f: Frame, x: Field, plain: DataFrame) -> tuple[Frame, list[tuple[str, Column]], int | None]:
        """The nested plan without its key equalities to the outer row, those, and the limit that holds for each key."""
        child, links = self.unlink(x.plan)
        if not links and not outers(child):  # the same for every outer row, limits and all
            return self.lower(Limit(x.plan, 1) if x.one and not is_one(x.plan) else x.plan), [], None
        child, limit = without_limit(child)
        if outers(child) or limited(child):
            raise RowByRow
        if x.one and not is_one(x.plan) and not self.one_each(child, links):
            limit = 1 if limit is None else min(limit, 1)
        # one record without lists of its own needs the join below only
        if f.narrow and not (x.one and limit is None and not has_fields(child)):
            child = self.within(f, child, links, plain)
        inner = self.lower(child)
        pairs = []
        for e, outer in links:
            k = self.fresh("k")
            inner.df = inner.df.withColumn(k, self.compiler(inner).column(e))
            pairs.append((k, f.resolve(Col(outer.qual, outer.name))[1]))
        return inner, pairs, limit

    def one_each(self, child: Node, links: list[tuple[Expr, Outer]]) -> bool:
        """Whether the links bind a unique key of the one relation that is read."""
        while not isinstance(child, Scan):
            if isinstance(child, Lookup):
                return False
            child = child.input
        rel, alias = self.catalog.relation(child.rel), child.alias or child.rel
        bound = {e.name for e, _ in links if isinstance(e, Col) and e.qual in ("", alias)}
        return any(p.unique and set(p.key) <= bound for p in rel.paths)

    def correlated(self, f: Frame, x: Field, plain: DataFrame) -> Frame:
        """The nested plan over the distinct values of the outer columns that it names, which go with its rows."""
        held = {o: (f.resolve(Col(*o))[0], self.fresh("o")) for o in sorted(outers(x.plan))}
        keys = plain.select(*[f.resolve(Col(*o))[1].alias(c) for o, (_, c) in held.items()]).distinct()
        self.around = (keys, held) if held else None
        return self.lower(Limit(x.plan, 1) if x.one and not is_one(x.plan) else x.plan)

    def within(self, f: Frame, child: Node, links: list[tuple[Expr, Outer]], plain: DataFrame) -> Node | Within:
        """The nested plan over what the outer rows reach of the relation that it reads."""
        scan = leaf(child)
        alias = scan.alias or scan.rel
        mine = [(internal(alias, e.name), o, f.resolve(Col(o.qual, o.name))[1]) for e, o in links if isinstance(e, Col) and e.qual == alias]
        if not mine:
            return child
        return upon(child, Within(scan, [c for c, _, _ in mine], self.keys_of(f, [o for _, o, _ in mine], [c for _, _, c in mine], plain)))

    def unlink(self, n: Node) -> tuple[Node, list[tuple[Expr, Outer]]]:
        """The plan without its key equalities to the outer row, and those."""
        match n:
            case Get() | Scan():
                rel = self.catalog.relation(n.rel)
                alias = n.alias or n.rel
                key = rel.path(n.path).key
                eq = n.key if isinstance(n, Get) else n.eq
                links = [(Col(alias, key[i]), e) for i, e in enumerate(eq) if isinstance(e, Outer)]
                rest = [Cmp("=", Col(alias, key[i]), e) for i, e in enumerate(eq) if not isinstance(e, Outer)]
                if isinstance(n, Get):
                    out: Node = Scan(n.rel, n.alias, n.path, cols=n.cols)
                    ranges = []
                else:
                    col = Col(alias, key[len(eq)]) if len(eq) < len(key) else None
                    ranges = [Cmp((">=" if b[1] else ">") if lo else ("<=" if b[1] else "<"), col, b[0]) for lo, b in ((True, n.lo), (False, n.hi)) if b]
                    out = replace(n, eq=(), lo=None, hi=None)
                if any(isinstance(x, Outer) for p in (*rest, *ranges) for x in walk(p)):
                    raise RowByRow
                return self._limit_last(out, [*rest, *ranges]), links
            case Filter(i, p):
                inner, links = self.unlink(i)
                mine = [c for c in conjuncts(p) if isinstance(c, Cmp) and c.op == "=" and isinstance(c.right, Outer)]
                stay = [c for c in conjuncts(p) if c not in mine]
                return (Filter(inner, And(tuple(stay))) if stay else inner), links + [(c.left, c.right) for c in mine]
            case Project() | Map() | Limit() | Lookup():
                inner, links = self.unlink(n.input)
                return replace(n, input=inner), links
        raise RowByRow

    @staticmethod
    def _limit_last(n: Scan, preds: list[Expr]) -> Node:
        if n.limit is None:
            return Filter(n, And(tuple(preds))) if preds else n
        inner: Node = replace(n, limit=None)
        return Limit(Filter(inner, And(tuple(preds))) if preds else inner, n.limit)


def has_outer(e: Expr) -> bool:
    return any(isinstance(x, Outer) for x in walk(e))


def leaf(n: Node) -> Node:
    """What a chain of steps reads."""
    return leaf(n.input) if hasattr(n, "input") else n


def upon(n: Node, read: Node | Within) -> Node | Within:
    """The same chain of steps over another read."""
    return replace(n, input=upon(n.input, read)) if hasattr(n, "input") else read


def has_fields(n: Node) -> bool:
    return isinstance(n, Map) or (not isinstance(n, Scan) and has_fields(n.input))


def limited(n: Node) -> bool:
    """Whether a limit is left in the plan; it would count the rows of all outer rows together."""
    return n.limit is not None if isinstance(n, Scan) else isinstance(n, Limit) or limited(n.input)


def without_limit(n: Node) -> tuple[Node, int | None]:
    """A nested plan without its limit, which then holds for each outer row."""
    match n:
        case Limit(i, k):
            inner, more = without_limit(i)
            return inner, k if more is None else min(k, more)
        case Project(i, _) | Map(i, _):
            inner, k = without_limit(i)
            return replace(n, input=inner), k
    return n, None
