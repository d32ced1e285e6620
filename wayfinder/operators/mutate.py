"""Inserts, updates and deletes as change sets over an immutable snapshot.

A change set is the image of every row that changes: the new one, or the old one of a delete. Images are computed
once, into files of their own; the constraints are checked on them and on the rows that share a key with
them, and the files that hold rows with their keys are written anew without those. What is not touched is neither
read nor grouped, but for a scan of key columns where a unique key is new.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..errors import DuplicateKey, QueryError
from ..functions.expr import Compiler
from ..plans.nodes import Delete, Insert, Node, Update
from ..sources.catalog import SPARK_TYPES, Catalog, Relation
from ..sources.store import DataFile
from .lower import Frame, Lowering, internal, sort_columns

#: So many changed keys at most go into predicates, by which the scan skips row groups; more only meet it in a join.
KEYS_IN_PREDICATE = 200
POSITION = "__pos"




class Keys:
    """A set of keys that rows are held against: values in a predicate while they are few, else a table to join."""

    def __init__(self, df: DataFrame, columns: tuple[str, ...], few: list[Row] | None):
        self.columns, self.table = list(columns), df.select(*[f"`{c}`" for c in columns]).na.drop()
        self.values = None if few is None else list(dict.fromkeys(k for r in few if None not in (k := tuple(r[c] for c in columns))))

    def predicate(self) -> Column:
        cols = [F.col(f"`{c}`") for c in self.columns]
        if len(cols) == 1:
            return cols[0].isin(*[F.lit(k[0]) for k in self.values]) if self.values else F.lit(False)
        return reduce(or_, [reduce(and_, [c == F.lit(v) for c, v in zip(cols, k)]) for k in self.values], F.lit(False))

    def met_in(self, df: DataFrame) -> DataFrame:
        """The rows of df that have one of the keys."""
        return df.join(self.table, self.columns, "left_semi") if self.values is None else df.where(self.predicate())

    def missed_in(self, df: DataFrame) -> DataFrame:
        """The rows of df that have none of them; no row has a null in these columns."""
        return df.join(self.table, self.columns, "left_anti") if self.values is None else df.where(~self.predicate())


def few_rows(df: DataFrame, rel: Relation, columns: list[str], more: list[Column] | None = None) -> list[Row] | None:
    """Those columns of all rows where there are at most KEYS_IN_PREDICATE and equality of their values is plain."""
    if any(rel.column(c).type not in ("int", "string", "bool", "timestamp") for c in columns):
        return None
    got = df.select(*[f"`{c}`" for c in columns], *(more or [])).limit(KEYS_IN_PREDICATE + 1).collect()
    return got if len(got) <= KEYS_IN_PREDICATE else None


class Images:
    """The rows of a change, in files that no snapshot lists yet."""

    def __init__(self, rel: Relation, files: list[DataFile], df: DataFrame):
        self.rel, self.files, self.df = rel, files, df
        columns = list(dict.fromkeys(c for p in rel.paths if p.unique for c in p.key))
        self.must = [c.name for c in rel.columns if not c.nullable]
        self.few = few_rows(df, rel, columns, [F.col(f"`{c}`").isNull().alias(f"null {c}") for c in self.must])
        self.n = df.count() if self.few is None else len(self.few)

    def keys(self, columns: tuple[str, ...]) -> Keys:
        return Keys(self.df, columns, self.few)

    def check_rows(self) -> None:
        """NOT NULL."""
        rows = self.few
        if rows is None:
            rows = self.df.agg(F.lit(0).alias("one"), *[F.max(F.col(f"`{c}`").isNull()).alias(f"null {c}") for c in self.must]).collect()
        for r in rows:
            for c in self.must:
                if r[f"null {c}"]:
                    raise QueryError(f"{self.rel.name}.{c} must not be NULL")

    def check_keys(self, before: DataFrame, fresh: bool, changed: set[str]) -> None:
        """Uniqueness, against each other and against the rows before; fresh: no row of before is replaced."""
        for p in self.rel.paths:
            if not p.unique or not changed & set(p.key):
                continue
            keys = self.keys(p.key)
            if self.few is not None:
                whole = [k for r in self.few if None not in (k := tuple(r[c] for c in p.key))]
                twice = len(set(whole)) < len(whole)
            else:
                twice = bool(keys.table.groupBy(*keys.columns).count().where("count > 1").limit(1).count())
            # a changed row keeps its primary key, so only its other keys can meet another row's
            if not twice and (fresh or p is not self.rel.primary):
                others = keys.met_in(before)
                twice = not (others if fresh else self.keys(self.rel.primary.key).missed_in(others)).isEmpty()
            if twice:
                raise DuplicateKey(f"duplicate key in {self.rel.name}.{p.name}")


class Mutation:
    """One change against the last snapshot of the tables; run() publishes it."""

    def __init__(self, catalog: Catalog, tables, params: tuple):
        self.catalog, self.tables, self.params = catalog, tables, params

    def run(self, n: Insert | Update | Delete) -> Images:
        rel = self.catalog.relation(n.rel)
        version, files = self.tables.snapshot(rel.name)
        before = self.tables.read(rel.name, files)
        rows = self.inserted(n, rel, before) if isinstance(n, Insert) else self.touched(n, rel)
        made = self.tables.write(rel.name, rows)
        df = self.tables.read(rel.name, made, f", {POSITION} bigint")
        images = Images(rel, made, df)
        fresh = isinstance(n, Insert) and n.conflict != "update"
        changed = set(rel.names) if isinstance(n, Insert) else {c for c, _ in n.set} if isinstance(n, Update) else set()
        if not isinstance(n, Delete):
            images.check_rows()
            images.check_keys(before, fresh, changed)
        if images.n:
            self.tables.publish(version, rel.name, self.after(images, files, fresh, isinstance(n, Delete)))
        return images

    def after(self, images: Images, files: list[DataFile], fresh: bool, delete: bool) -> list[DataFile]:
        """The table's files once the images stand in it."""
        name, keys = images.rel.name, images.keys(images.rel.primary.key)
        hit = [] if fresh else self.tables.holding(name, files, keys.met_in)
        old = list(dict.fromkeys([*hit, *self.tables.small(files)]))
        rest: list[DataFile] = []
        if old:
            rows = self.tables.read(name, old)
            rest = self.tables.write(name, keys.missed_in(rows).select(*images.rel.names) if hit else rows, old)
        gone = set(old)
        return [f for f in files if f not in gone] + rest + ([] if delete else images.files)

    def typed(self, rel: Relation, values: dict[str, Column]) -> list[Column]:
        return [values[c.name].cast(SPARK_TYPES[c.type]).alias(c.name) for c in rel.columns]

    def touched(self, n: Update | Delete, rel: Relation) -> DataFrame:
        f = Lowering(self.catalog, self.tables, self.params).lower(n.input)
        alias = n.alias or n.rel
        # a row that the read side reaches twice changes once, as its first match has it
        pk = [F.col(f"`{internal(alias, c)}`") for c in rel.primary.key]
        if len(f.key) > len(pk):
            f.df = f.df.withColumn("__nth", F.row_number().over(Window.partitionBy(*pk).orderBy(*sort_columns(f.order)))).where("__nth = 1")
        new = {c: F.col(f"`{internal(alias, c)}`") for c in rel.names}
        if isinstance(n, Update):
            comp = Compiler(f.resolve, self.params)
            for c, e in n.set:
                if c in rel.primary.key:
                    raise QueryError("primary key columns cannot be changed")
                new[c] = comp.as_type(e, rel.column(c).type)
        # only RETURNING shows an order
        if n.returning and f.order:
            f.df = f.df.orderBy(*sort_columns(f.order))
        return f.df.select(*self.typed(rel, new), F.monotonically_increasing_id().alias(POSITION))

    def proposed(self, n: Insert, rel: Relation) -> DataFrame:
        """The rows to insert, with their place."""
        cols = list(n.cols) or rel.names
        if n.input is not None:
            return self._from_plan(n.input, cols, rel)
        comp = Compiler(lambda e: (_ for _ in ()).throw(QueryError("VALUES takes no columns")), self.params)
        rows = []
        for pos, row in enumerate(n.rows):
            if len(row) != len(cols):
                raise QueryError("VALUES do not match the columns")
            given = dict(zip(cols, row))
            values = {c.name: comp.as_type(given[c.name], c.type) if c.name in given else F.lit(None) for c in rel.columns}
            rows.append(F.struct(F.lit(pos).cast("bigint").alias(POSITION), *self.typed(rel, values)))
        return self.tables.spark.range(1).select(F.inline(F.array(*rows)))

    def _from_plan(self, plan: Node, cols: list[str], rel: Relation) -> DataFrame:
        df = Lowering(self.catalog, self.tables, self.params).run(plan)
        if len(df.columns) != len(cols):
            raise QueryError("the input does not match the columns")
        df = df.toDF(*cols)
        values = {c.name: F.col(f"`{c.name}`") if c.name in cols else F.lit(None) for c in rel.columns}
        # written once, so that its rows and their places are the same wherever they are read
        made = self.tables.write(rel.name, df.select(F.monotonically_increasing_id().alias(POSITION), *self.typed(rel, values)))
        return self.tables.read(rel.name, made, f", {POSITION} bigint").select(POSITION, *rel.names)

    def inserted(self, n: Insert, rel: Relation, before: DataFrame) -> DataFrame:
        pk = list(rel.primary.key)
        new = self.proposed(n, rel)
        if not n.conflict:
            return new
        # what the new rows meet; the side that grows with the table is read for it only
        met = Keys(new, rel.primary.key, few_rows(new, rel, pk) if n.input is None else None).met_in(before)
        if n.conflict == "nothing":
            first = F.row_number().over(Window.partitionBy(*pk).orderBy(POSITION))
            return new.withColumn("__nth", first).where("__nth = 1").drop("__nth").join(met.select(*pk), pk, "left_anti").select(POSITION, *rel.names)
        alias = n.alias or n.rel
        left = new.select(POSITION, *[F.col(f"`{c}`").alias(internal("excluded", c)) for c in rel.names])
        right = met.select(*[F.col(f"`{c}`").alias(internal(alias, c)) for c in rel.names])
        on = reduce(and_, [F.col(f"`{internal('excluded', c)}`") == F.col(f"`{internal(alias, c)}`") for c in pk])
        both = left.join(right, on, "left")
        types = {(a, c.name): c.type for a in (alias, "excluded") for c in rel.columns}
        comp = Compiler(Frame(both, types, [], []).resolve, self.params)
        found = F.col(f"`{internal(alias, pk[0])}`").isNotNull()
        assigned = {c: comp.as_type(e, rel.column(c).type) for c, e in n.set}
        kept = {c: assigned.get(c, F.col(f"`{internal(alias, c)}`")) for c in rel.names}
        values = {c: F.when(found, kept[c]).otherwise(F.col(f"`{internal('excluded', c)}`")) for c in rel.names}
        return both.select(POSITION, *self.typed(rel, values))


def returned(catalog: Catalog, n: Insert | Update | Delete, images: Images, params: tuple) -> DataFrame | None:
    """The rows of RETURNING, in the order in which they were changed."""
    if not n.returning:
        return None
    alias = n.alias or n.rel
    df = images.df.orderBy(POSITION).select(*[F.col(f"`{c}`").alias(internal(alias, c)) for c in images.rel.names])
    comp = Compiler(Frame(df, {(alias, c.name): c.type for c in images.rel.columns}, [], []).resolve, params)
    return df.select(*[comp.column(e).alias(name) for name, e in n.returning])


__all__ = ["Images", "Mutation", "returned"]
