"""Relations, access paths and relationships, read from JSON or YAML definitions and checked."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from ..errors import QueryError

TYPES = ("bool", "int", "float", "string", "bytes", "timestamp")
SPARK_TYPES = {"bool": "boolean", "int": "bigint", "float": "double", "string": "string", "bytes": "binary", "timestamp": "timestamp_ntz"}
KINDS = ("one_to_one", "one_to_many", "many_to_one")


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = False


@dataclass(frozen=True)
class AccessPath:
    name: str
    partition: tuple[str, ...]
    sort: tuple[str, ...] = ()
    unique: bool = False
    id: int = 0

    @property
    def key(self) -> tuple[str, ...]:
        return self.partition + self.sort


@dataclass(frozen=True)
class Relationship:
    name: str
    source: str
    columns: tuple[str, ...]
    target: str
    path: str
    kind: str


@dataclass
class Relation:
    name: str
    columns: list[Column]
    paths: list[AccessPath]
    relationships: dict[str, Relationship] = field(default_factory=dict)
    id: int = 0

    @property
    def primary(self) -> AccessPath:
        return self.paths[0]

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    def path(self, name: str) -> AccessPath:
        for p in self.paths:
            if p.name == name:
                return p
        raise QueryError(f"unknown path {self.name}.{name}")

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def ddl(self) -> str:
        return ", ".join(f"`{c.name}` {SPARK_TYPES.get(c.type, c.type)}" for c in self.columns)


class Catalog:
    """An immutable set of relations."""

    def __init__(self, relations: list[Relation]):
        self.relations = {r.name: r for r in relations}

    def relation(self, name: str) -> Relation:
        if name not in self.relations:
            raise QueryError(f"unknown table {name}")
        return self.relations[name]

    def signature(self) -> dict:
        """What a stored snapshot depends on."""
        return {r.name: {"columns": [[c.name, c.type, c.nullable] for c in r.columns], "paths": [[p.name, list(p.partition), list(p.sort), p.unique] for p in r.paths]} for r in self.relations.values()}

    def check_binding(self, stored: dict) -> None:
        """Only new relations may be added to what a snapshot directory was made with."""
        mine = self.signature()
        for name, want in stored.items():
            if mine.get(name) != want:
                raise QueryError(f"relation {name} differs from the stored catalog")


def _number(what: str, spec: dict, at: int, taken: list[int]) -> int:
    """The id that a definition gives, else its place from 1."""
    given = spec.get("id") or 0
    if not isinstance(given, int) or given < 0:
        raise QueryError(f"{what}: an id is a positive number")
    out = given or at
    if out in taken:
        raise QueryError(f"{what}: id {out} is taken")
    return out


def _path(rel: str, columns: dict[str, Column], name: str, spec: dict, unique: bool, others: list[AccessPath]) -> AccessPath:
    partition, sort = tuple(spec.get("partition") or ()), tuple(spec.get("sort") or ())
    if not partition + sort:
        raise QueryError(f"path {rel}.{name} has no columns")
    for c in partition + sort:
        if c not in columns:
            raise QueryError(f"path {rel}.{name}: unknown column {c}")
    if len(set(partition + sort)) < len(partition + sort):
        raise QueryError(f"path {rel}.{name} lists a column twice")
    return AccessPath(name, partition, sort, unique, _number(f"path {rel}.{name}", spec, len(others) + 1, [p.id for p in others]))


def build(spec: dict) -> Catalog:
    """A catalog from its definition: relations with columns, primary, paths and relationships."""
    out: list[Relation] = []
    for r in spec.get("relations") or []:
        name = r.get("name")
        if not name:
            raise QueryError("a relation needs a name")
        if any(x.name == name for x in out):
            raise QueryError(f"duplicate relation {name}")
        columns: dict[str, Column] = {}
        for c in r.get("columns") or []:
            if not c.get("name") or c["name"] in columns:
                raise QueryError(f"{name}: missing or duplicate column name")
            if c.get("type") not in TYPES and not c.get("opaque"):
                raise QueryError(f"{name}.{c['name']}: unknown type {c.get('type')}")
            columns[c["name"]] = Column(c["name"], c["type"], bool(c.get("nullable", False)))
        primary = r.get("primary") or {}
        if not (primary.get("partition") or primary.get("sort")):
            raise QueryError(f"{name} has no primary key")
        paths = [_path(name, columns, "primary", primary, True, [])]
        if any(columns[c].nullable for c in paths[0].key):
            raise QueryError(f"{name}: nullable primary key")
        for p in r.get("paths") or []:
            if not p.get("name") or any(x.name == p["name"] for x in paths):
                raise QueryError(f"{name}: missing or duplicate path name")
            paths.append(_path(name, columns, p["name"], p, bool(p.get("unique", False)), paths))
        out.append(Relation(name, list(columns.values()), paths, id=_number(name, r, len(out) + 1, [x.id for x in out])))
    catalog = Catalog(out)
    for s in spec.get("relationships") or []:
        source, target = catalog.relation(s.get("from", "")), catalog.relation(s.get("to", ""))
        path, cols = target.path(s.get("path") or "primary"), tuple(s.get("from_cols") or s.get("columns") or ())
        if s.get("kind") not in KINDS:
            raise QueryError(f"relationship {s.get('name')}: unknown kind {s.get('kind')}")
        if any(source.column(c) is None for c in cols):
            raise QueryError(f"relationship {s.get('name')}: unknown column")
        if not len(path.partition) <= len(cols) <= len(path.key) or not cols:
            raise QueryError(f"relationship {s.get('name')} must cover the partition of {target.name}.{path.name}")
        if s["kind"] != "one_to_many" and not (path.unique and len(cols) == len(path.key)):
            raise QueryError(f"relationship {s.get('name')} must bind a full unique path")
        if source.column(s["name"]) or s["name"] in source.relationships:
            raise QueryError(f"relationship {s['name']} collides with a name of {source.name}")
        source.relationships[s["name"]] = Relationship(s["name"], source.name, cols, target.name, path.name, s["kind"])
    return catalog


def load(path: str) -> Catalog:
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml

        return build(yaml.safe_load(text))
    return build(json.loads(text))
