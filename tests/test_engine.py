"""The engine on small tables of its own: a network of sensors at sites, their readings, and alarms."""

import json
import random
from io import StringIO

import pytest

from wayfinder import cli
from wayfinder.errors import Conflict, DuplicateKey, FullScanRefused, NotSupported, OrderRefused, QueryError, RunError, SyntaxFault
from wayfinder.functions.values import parse_timestamp
from wayfinder.operators.lower import Lowering
from wayfinder.plans import build as b
from wayfinder.plans import nodes
from wayfinder.plans.graphql import Document, GraphQL, schema_text
from wayfinder.plans.sql import complete
from wayfinder.plans.validate import validate
from wayfinder.session import Session
from wayfinder.sources import store as store_module
from wayfinder.sources.catalog import build, load
from wayfinder.sources.store import MemoryStore, SnapshotStore


def relation(name, columns, primary, *paths):
    parts = [c.split() for c in columns.split(", ")]
    return {
        "name": name,
        "columns": [{"name": c[0], "type": c[1], "nullable": len(c) > 2} for c in parts],
        "primary": key(primary),
        "paths": [{"name": n, "unique": u, **key(k)} for n, k, u in paths],
    }


def key(text):
    partition, _, sort = text.partition("|")
    return {"partition": partition.split(), "sort": sort.split()}


NET = {
    "relations": [
        relation("site", "code string, title string, lead string null", "code", ("by_title", "title", True)),
        relation("sensor", "serial int, site string, slot int, model string, top float null", "serial", ("by_place", "site | slot", True), ("by_model", "model | top", False)),
        relation("reading", "serial int, at timestamp, kind string, value float, note string null", "serial | at kind", ("by_kind", "kind | at", False)),
        relation("alarm", "id int, raised timestamp, serial int null", "id", ("by_time", "| raised", False)),
    ],
    "relationships": [
        {"name": "sensors", "from": "site", "from_cols": ["code"], "to": "sensor", "path": "by_place", "kind": "one_to_many"},
        {"name": "home", "from": "sensor", "columns": ["site"], "to": "site", "kind": "many_to_one"},
        {"name": "readings", "from": "sensor", "columns": ["serial"], "to": "reading", "kind": "one_to_many"},
        {"name": "sensor", "from": "reading", "columns": ["serial"], "to": "sensor", "kind": "many_to_one"},
    ],
}
ROWS = """
INSERT INTO site VALUES ('N', 'north', 'ida'), ('S', 'south', NULL), ('W', 'west', 'ida');
INSERT INTO sensor VALUES (1, 'N', 1, 'frost', 2.5), (2, 'N', 2, 'rain', NULL), (3, 'S', 1, 'frost', 9), (4, 'X', 7, 'wind', 1);
INSERT INTO reading VALUES (1, '2024-03-01', 'cold', -2, NULL), (1, '2024-03-02', 'cold', 3, 'mild'), (1, '2024-03-02', 'wet', 40, NULL),
    (3, '2024-03-01', 'cold', 8, NULL), (3, '2024-03-05', 'cold', 11, 'hot'), (9, '2024-03-04', 'wet', 1, NULL);
INSERT INTO alarm VALUES (70, '2024-03-03', 1), (71, '2024-03-01', 3), (72, '2024-03-02', NULL);
"""


@pytest.fixture
def net(spark):
    catalog = build(NET)
    s = Session(spark, catalog, MemoryStore(spark, catalog))
    s.script(ROWS)
    return s


@pytest.fixture(scope="module")
def still(spark):
    """Tables that no test changes, full scans allowed."""
    catalog = build(NET)
    s = Session(spark, catalog, MemoryStore(spark, catalog), True)
    s.script(ROWS)
    return s


@pytest.fixture(scope="module")
def strict(still):
    return Session(still.spark, still.catalog, still.tables)


def rows(df):
    return [tuple(r) for r in df.collect()]


PLANS = {
    "a whole unique key is a Get": (
        "SELECT lead FROM site WHERE title = 'west' AND lead = 'ida'",
        'Project [site.lead]\n  Filter site.lead = "ida"\n    Get site via by_title key=["west"] cols=[lead]\n',
    ),
    "the primary key wins over another unique one": ("SELECT title FROM site WHERE title = 'west' AND code = 'W'", 'Project [site.title]\n  Filter site.title = "west"\n    Get site via primary key=["W"] cols=[title]\n'),
    "a prefix with a range on the next column": (
        "SELECT value FROM reading WHERE serial = ? AND at >= '2024-03-02' AND value > 0",
        'Project [reading.value]\n  Filter reading.value > 0\n    Scan reading via primary eq=[$1] lo>="2024-03-02" cols=[value]\n',
    ),
    "a list of keys": ("SELECT model FROM sensor WHERE serial IN (4, 2)", "Project [sensor.model]\n  GetMany sensor via primary keys=[[4], [2]] cols=[model]\n"),
    "a sort-only path bounds without a key": ("SELECT id FROM alarm WHERE raised < '2024-03-03' ORDER BY raised DESC", 'Project [alarm.id]\n  Scan alarm via by_time hi<"2024-03-03" reverse cols=[id]\n'),
    "a limit reaches the scan below a projection": ("SELECT slot + 1 AS next FROM sensor WHERE site = 'N' LIMIT 1", 'Project [next: sensor.slot + 1]\n  Scan sensor via by_place eq=["N"] limit=1 cols=[slot]\n'),
    "a join by a composite key is to one": (
        "SELECT r.value, s.model FROM alarm r0 JOIN sensor s ON s.serial = r0.serial JOIN reading r ON r.serial = s.serial AND r.at = r0.raised AND r.kind = 'cold' WHERE r0.id = 70",
        'Project [r.value, s.model]\n  Lookup reading r via primary key=[s.serial, r0.raised, "cold"] one cols=[value]\n    Lookup sensor s via primary key=[r0.serial] one cols=[serial, model]\n      Get alarm r0 via primary key=[70] cols=[raised, serial]\n',
    ),
    "a left join keeps its input": (
        "SELECT a.id, s.model FROM alarm a LEFT JOIN sensor s ON a.serial = s.serial WHERE a.id IN (70, 72)",
        "Project [a.id, s.model]\n  Lookup sensor s via primary key=[a.serial] one optional cols=[model]\n    GetMany alarm a via primary keys=[[70], [72]] cols=[id, serial]\n",
    ),
    "what no key takes stays above the join": (
        "SELECT s.serial FROM site p JOIN sensor s ON s.site = p.code AND s.top > s.slot WHERE p.title = 'north'",
        'Project [s.serial]\n  Filter s.top > s.slot\n    Lookup sensor s via by_place key=[p.code] many cols=[serial, slot, top]\n      Get site p via by_title key=["north"] cols=[code]\n',
    ),
    "a change reads by path": ("DELETE FROM reading WHERE kind = 'wet' RETURNING serial", 'Delete reading returning [reading.serial]\n  Scan reading via by_kind eq=["wet"]\n'),
    "an upsert": (
        "INSERT INTO site (code, title) VALUES ('E', 'east') ON CONFLICT (code) DO UPDATE SET title = excluded.title",
        'Insert site cols=[code, title] values=["E", "east"] on-conflict=update [title = excluded.title]\n',
    ),
}


@pytest.mark.parametrize("name", PLANS)
def test_plan_text(strict, name):
    statement, plan = PLANS[name]
    assert strict.compile(statement).text == plan
    assert "\n".join(r.plan for r in strict.sql("EXPLAIN " + statement).collect()) + "\n" == plan


REFUSED = [
    ("SELECT model FROM sensor WHERE top > 1", FullScanRefused),
    ("SELECT model FROM sensor WHERE slot = 1", FullScanRefused),
    ("SELECT kind FROM reading WHERE at > '2024-03-01'", FullScanRefused),
    ("SELECT code FROM site WHERE code > 'A'", None),
    ("SELECT model FROM sensor WHERE serial = 'one'", FullScanRefused),
    ("SELECT code FROM site LIMIT 0", FullScanRefused),
    ("SELECT serial FROM sensor WHERE site = 'N' ORDER BY top", OrderRefused),
    ("SELECT serial FROM sensor WHERE site = 'N' ORDER BY slot DESC, serial", None),
    ("SELECT serial FROM sensor WHERE model = 'frost' ORDER BY top, serial", OrderRefused),
    ("SELECT serial FROM sensor WHERE serial IN (1, 2) ORDER BY top", OrderRefused),
    ("SELECT DISTINCT model FROM sensor", NotSupported),
    ("SELECT max(top) FROM sensor WHERE serial = 1", NotSupported),
    ("SELECT model FROM sensor WHERE serial = 1 GROUP BY model", NotSupported),
    ("SELECT model FROM sensor WHERE model LIKE 'f%'", NotSupported),
    ("SELECT CASE WHEN top > 1 THEN 1 END FROM sensor", NotSupported),
    ("SELECT model FROM sensor WHERE serial = 1 OFFSET 3", NotSupported),
    ("SELECT model FROM (SELECT 1) x", NotSupported),
    ("SELECT 1 FROM site a, sensor c", NotSupported),
    ("SELECT a.code FROM site a CROSS JOIN sensor c", NotSupported),
    ("SELECT a.code FROM site a JOIN sensor c ON c.slot = 1 WHERE a.code = 'N'", NotSupported),
    ("SELECT a.code FROM site a LEFT JOIN sensor c ON c.site = a.code AND c.top > 1 WHERE a.code = 'N'", NotSupported),
    ("SELECT a.code FROM site a JOIN site a ON a.code = a.code", QueryError),
    ("WITH q AS (SELECT 1) SELECT 1 FROM q", NotSupported),
    ("SELECT code FROM site WHERE code = 'N' UNION SELECT code FROM site", NotSupported),
    ("UPDATE sensor SET serial = 8 WHERE serial = 1", QueryError),
    ("UPDATE sensor SET top = 1, top = 2 WHERE serial = 1", QueryError),
    ("INSERT INTO site (code, code) VALUES ('a', 'b')", QueryError),
    ("INSERT INTO site VALUES ('a')", QueryError),
    ("INSERT INTO site VALUES ('a', 'b', NULL) ON CONFLICT (title) DO NOTHING", NotSupported),
    ("SELECT height FROM sensor WHERE serial = 1", QueryError),
    ("SELECT serial FROM sensor s JOIN reading r ON r.serial = s.serial WHERE s.serial = 1", QueryError),
    ("SELECT x.serial FROM sensor s WHERE serial = 1", QueryError),
    ("SELECT serial FROM probe", QueryError),
    ("SELECT serial FROM sensor WHERE serial = ? OR serial = $2", SyntaxFault),
    ("SELECT serial FROM sensor WHERE model = 'frost", SyntaxFault),
    ("SELECT serial, FROM sensor", SyntaxFault),
    ("EXPLAIN EXPLAIN SELECT serial FROM sensor", SyntaxFault),
]


@pytest.mark.parametrize("statement,error", REFUSED)
def test_refusals(strict, statement, error):
    if error is None and "code >" not in statement:
        strict.compile(statement)
        return
    with pytest.raises(error or FullScanRefused):
        strict.compile(statement)


def test_errors_of_types_and_of_running(still):
    for statement in ("SELECT serial FROM sensor WHERE serial = 1 AND model = 3", "SELECT model * 2 AS x FROM sensor WHERE serial = 1", "SELECT serial FROM sensor WHERE serial = 1 AND top", "SELECT serial FROM sensor WHERE serial = $1"):
        with pytest.raises(QueryError):
            still.sql(statement)
    got = still.graphql("{ sensor_by_pk(serial: 1) { serial } }")
    assert got == {"data": {"sensor_by_pk": {"serial": 1}}}
    with pytest.raises(RunError):
        list(cli.show(still.execute(still.compile("SELECT serial / 0 AS x FROM sensor"))))
    with pytest.raises(RunError):
        still.script("UPDATE sensor SET slot = slot / 0")
    out = StringIO()
    cli.shell(still, ["SELECT serial % 0 AS x FROM sensor;\n", "SELECT 9223372036854775807 + serial AS x FROM sensor;\n", "SELECT code FROM site WHERE code = 'W';\n"], out)
    lines = out.getvalue().splitlines()
    assert [x.startswith("error: ") for x in lines if not x.startswith(("x", "-"))] == [True, True, False, False, False]


def test_reads(still):
    assert rows(still.sql("SELECT at, kind FROM reading WHERE serial = 1 ORDER BY at DESC LIMIT 2")) == rows(still.sql("SELECT at, kind FROM reading WHERE serial = 1 AND at = '2024-03-02' ORDER BY kind DESC"))
    assert rows(still.sql("SELECT s.model, r.value FROM site p JOIN sensor s ON s.site = p.code JOIN reading r ON r.serial = s.serial WHERE p.code = 'N' LIMIT 2")) == [("frost", -2.0), ("frost", 3.0)]
    assert sorted(rows(still.sql("SELECT code FROM site WHERE lead = NULL OR NOT (lead <> 'ida')"))) == [("N",), ("W",)]
    assert rows(still.sql("SELECT id FROM alarm WHERE raised > '2024-03-01T23:00:00+00:00' ORDER BY raised")) == [(72,), (70,)]
    assert rows(still.sql("SELECT a.id, s.model FROM alarm a LEFT JOIN sensor s ON s.serial = a.serial WHERE a.id IN (72, 71) LIMIT 5")) == [(72, None), (71, "frost")]


def get_many(*keys):
    return nodes.Project(nodes.GetMany("reading", "r", "primary", tuple(tuple(map(b.V, k)) for k in keys)), (b.As("value", b.C("r", "value")),))


def test_get_many_takes_whole_keys_in_the_order_of_the_list(still, monkeypatch):
    day = parse_timestamp("2024-03-02")
    listed = ((3, parse_timestamp("2024-03-05"), "cold"), (1, day, "wet"), (1, day, "cold"), (1, day, "dry"), (1, day, "wet"))
    want = [(11.0,), (40.0,), (3.0,)]
    assert rows(still.run(nodes.Limit(get_many(*listed), 9)).df) == want
    monkeypatch.setattr("wayfinder.operators.lower.KEYS_IN_PREDICATE", 2)
    assert rows(still.run(nodes.Limit(get_many(*listed), 9)).df) == want
    monkeypatch.setattr("wayfinder.operators.lower.BROADCAST_KEYS", 1)
    assert rows(still.run(nodes.Limit(get_many(*listed), 2)).df) == want[:2]
    for bad in ((1,), (1, day), (1, day, "cold", 2)):
        with pytest.raises(QueryError):
            still.run(get_many(bad))


BAD_PLANS = [
    nodes.Get("sensor", "", "by_model", (b.S("rain"),)),
    nodes.Get("sensor", "", "by_place", (b.S("N"),)),
    nodes.Get("sensor", "", "nowhere", (b.I(1),)),
    nodes.Get("nothing", "", "primary", (b.I(1),)),
    nodes.Get("sensor", "", "primary", (b.I(1),), ("height",)),
    nodes.GetMany("sensor", "", "primary", ((b.I(1),), (b.I(1), b.I(2)))),
    nodes.Scan("sensor", "", "by_place", (), (b.I(1), True)),
    nodes.Scan("sensor", "", "by_place", (b.S("N"), b.I(1)), (b.I(1), True)),
    nodes.Scan("sensor", "", "primary", limit=-1),
    nodes.Limit(nodes.Scan("site", ""), -1),
    nodes.Sort(nodes.Scan("site", ""), ()),
    nodes.Filter(None, b.Eq(b.I(1), b.I(1))),
    nodes.Lookup(nodes.Scan("site", "p"), "sensor", "s", "by_place", ()),
    nodes.Lookup(nodes.Scan("site", "p"), "sensor", "s", "by_place", (b.C("p", "code"),)),
    nodes.Lookup(nodes.Scan("site", "p"), "reading", "s", "primary", (b.I(1), b.V(None), b.S("x"), b.I(2)), many=True),
    nodes.Map(nodes.Scan("site", "p"), (nodes.Field("x", nodes.Scan("alarm", "a")), nodes.Field("x", nodes.Scan("alarm", "a")))),
    nodes.Map(nodes.Scan("site", "p"), (nodes.Field("x", nodes.Scan("alarm", "a", limit=2), batched=True),)),
    nodes.Insert("site", "site"),
    nodes.Insert("site", "site", rows=((b.S("E"), b.S("east"), b.V(None)),), conflict="nothing", set=(("title", b.S("x")),)),
    nodes.Update("site", "site", None, ()),
    nodes.Delete("site", "site", nodes.Delete("site", "site", nodes.Scan("site", ""))),
]


@pytest.mark.parametrize("plan", BAD_PLANS, ids=lambda p: type(p).__name__)
def test_plans_without_meaning_are_refused(still, plan):
    with pytest.raises(QueryError):
        validate(still.catalog, plan)
    with pytest.raises(QueryError):
        still.run(plan)


def test_builder_helpers():
    from wayfinder.functions.expr import text

    e = b.AndOf(b.Ne(b.C("s", "top"), b.F(2)), b.OrOf(b.Lt(b.C("", "slot"), b.P(1)), b.Ge(b.Add(b.C("", "slot"), b.I(1)), b.O("p", "n"))))
    assert text(e) == "(s.top <> 2) AND ((slot < $1) OR ((slot + 1) >= $.p.n))"
    assert b.Exprs(b.S("a"), b.V(None)) == (b.V("a"), b.V(None)) and text(b.Gt(b.I(1), b.V(True))) == "1 > true" and text(b.Le(b.I(1), b.I(2))) == "1 <= 2" and b.As("x", b.I(1)) == ("x", b.I(1))


def each_outer_row(session, outer, field):
    """What a nested field holds, one outer row at a time: outer references become values."""
    from dataclasses import fields, is_dataclass, replace

    def put(x, row):
        if type(x).__name__ == "Outer":
            return b.V(row[f"{x.qual}__{x.name}"]) if f"{x.qual}__{x.name}" in row else x
        if isinstance(x, tuple):
            return tuple(put(i, row) for i in x)
        return replace(x, **{f.name: put(getattr(x, f.name), row) for f in fields(x)}) if is_dataclass(x) else x

    low = Lowering(session.catalog, session.tables)
    got = []
    for row in low.lower(outer).df.orderBy("s__serial").collect():
        inner = [r.asDict(True) for r in Lowering(session.catalog, session.tables).run(put(field.plan, row.asDict())).collect()]
        got.append((inner[0] if inner else None) if field.one else inner)
    return got


SENSORS = nodes.Scan("sensor", "s", "primary")
OF_SENSOR = nodes.Scan("reading", "r", "primary", (b.O("s", "serial"),))
NESTED = {
    "key": nodes.Field("x", OF_SENSOR),
    "key reversed with a limit": nodes.Field("x", nodes.Scan("reading", "r", "primary", (b.O("s", "serial"),), reverse=True, limit=1)),
    "outer in a filter": nodes.Field("x", nodes.Filter(OF_SENSOR, b.Gt(b.C("r", "value"), b.O("s", "top")))),
    "outer in a filter alone": nodes.Field("x", nodes.Filter(nodes.Scan("reading", "r"), b.OrOf(b.Eq(b.C("r", "serial"), b.O("s", "serial")), b.Lt(b.C("r", "value"), b.O("s", "top"))))),
    "outer in a bound": nodes.Field("x", nodes.Scan("sensor", "o", "by_place", (b.O("s", "site"),), (b.O("s", "slot"), True))),
    "outer in an expression": nodes.Field("x", nodes.Project(OF_SENSOR, (b.As("d", b.Add(b.C("r", "value"), b.O("s", "top"))),))),
    "a limit below a filter": nodes.Field("x", nodes.Filter(nodes.Limit(OF_SENSOR, 1), b.Gt(b.C("r", "value"), b.I(0)))),
    "a limit below a lookup": nodes.Field("x", nodes.Lookup(nodes.Limit(OF_SENSOR, 2), "sensor", "o", "primary", (b.C("r", "serial"),))),
    "a limit of a scan below a lookup to many": nodes.Field("x", nodes.Lookup(nodes.Scan("reading", "r", "primary", (b.O("s", "serial"),), limit=2), "reading", "q", "primary", (b.C("r", "serial"),), many=True)),
    "outer in the key of a lookup": nodes.Field("x", nodes.Lookup(nodes.Scan("site", "p", "primary", (b.O("s", "site"),)), "sensor", "o", "by_place", (b.C("p", "code"), b.O("s", "slot")))),
    "a list of outer keys": nodes.Field("x", nodes.GetMany("sensor", "o", "primary", ((b.O("s", "slot"),), (b.O("s", "serial"),)))),
    "no outer reference": nodes.Field("x", nodes.Limit(nodes.Scan("alarm", "a", "by_time"), 2)),
    "one of several": nodes.Field("x", OF_SENSOR, True),
    "one by an outer filter": nodes.Field("x", nodes.Filter(nodes.Scan("reading", "r", "by_kind", (b.S("cold"),)), b.Gt(b.C("r", "value"), b.O("s", "top"))), True),
    "nested in an outer filter": nodes.Field("x", nodes.Map(nodes.Filter(nodes.Scan("site", "p"), b.Eq(b.O("s", "site"), b.C("p", "code"))), (nodes.Field("y", nodes.Limit(nodes.Scan("sensor", "o", "by_place", (b.O("p", "code"),)), 1)),))),
}


@pytest.mark.parametrize("name", NESTED)
@pytest.mark.parametrize("narrow", [False, True])
def test_nested_plans_equal_a_run_for_each_outer_row(still, name, narrow):
    outer = nodes.Filter(SENSORS, b.Ne(b.C("s", "serial"), b.I(3))) if narrow else SENSORS
    got = still.run(nodes.Map(outer, (NESTED[name],))).df.collect()
    assert [r.asDict(True)["x"] for r in got] == each_outer_row(still, outer, NESTED[name])


def test_nested_reads_reach_only_their_parents(still):
    outer = nodes.Scan("sensor", "s", "by_place", (b.S("N"),))
    df = Lowering(still.catalog, still.tables).run(nodes.Map(outer, (nodes.Field("x", OF_SENSOR),)))
    assert "LeftSemi" in df._jdf.queryExecution().optimizedPlan().toString()
    assert [len(r.x) for r in df.collect()] == [3, 0]


STEP = relation("step", "serial int, lane string null, at float null", "serial", ("by_lane", "lane | at", False), ("by_at", "| at", False))


class Steps:
    def __init__(self, spark, data):
        self.df = spark.createDataFrame(data, "serial bigint, lane string, at double").repartition(3).localCheckpoint()

    def frame(self, name):
        return self.df


def steps(spark, data):
    return Session(spark, build({"relations": [STEP], "relationships": []}), Steps(spark, data), True)


OF_LANE = {"path": "by_lane", "eq": (b.O("s", "lane"),)}
AT, LATER = b.O("s", "at"), b.Add(b.O("s", "at"), b.F(2))
BOUNDS = {
    "gt": {"lo": (AT, False)}, "ge": {"lo": (AT, True)}, "lt": {"hi": (AT, False)}, "le": {"hi": (AT, True)},
    "gt_le": {"lo": (AT, False), "hi": (LATER, True)}, "ge_lt": {"lo": (AT, True), "hi": (LATER, False)}, "none_between": {"lo": (LATER, True), "hi": (AT, True)}, "fixed_lo": {"lo": (b.F(1), True), "hi": (AT, True)},
}


def first_steps(data, row, of_lane, bounds, reverse, k):
    """The first k steps that a row reaches; NaN is the largest value."""
    import math

    def of(v):
        return math.inf if v is not None and math.isnan(v) else v

    at = of(row[2])
    value = {AT: at, LATER: None if at is None else at + 2, b.F(1): 1.0}
    got = [r for r in data if not of_lane or row[1] is not None and r[1] == row[1]]
    for side, (e, inclusive) in bounds.items():
        x = value[e]
        got = [r for r in got if None not in (x, r[2]) and (inclusive and of(r[2]) == x or (of(r[2]) > x if side == "lo" else of(r[2]) < x))]
    return [r[0] for r in sorted(got, key=lambda r: (r[2] is not None, of(r[2] or 0.0), r[0]), reverse=reverse)[:k]]


@pytest.mark.parametrize("of_lane", [True, False])
@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("part", [0, 1, 2, 3])
def test_limits_within_outer_bounds_equal_brute_force(spark, part, of_lane, reverse):
    rng = random.Random(5)
    values = [None, float("nan"), -0.0, 0.0, -1.5, *[x / 2 for x in range(12)]]
    data = [(i, rng.choice(["a", "b", "c", None]), rng.choice(values)) for i in range(90)] + [(90, "alone", 1.0)]
    limits = dict(zip(BOUNDS, (2, 3, 1, 2, 50, 2, 2, 0)))
    scan = {n: nodes.Scan("step", "d", reverse=reverse, **(OF_LANE if of_lane else {"path": "by_at"}), **BOUNDS[n]) for n in list(BOUNDS)[part::4]}
    fields = tuple(nodes.Field(n, nodes.Project(nodes.Limit(x, limits[n]), (("serial", b.C("d", "serial")),))) for n, x in scan.items())
    got = steps(spark, data).run(nodes.Map(nodes.Scan("step", "s", "by_at"), fields)).df.collect()
    assert len(got) == len(data)
    for r in got:
        row = next(x for x in data if x[0] == r["serial"])
        for n in scan:
            assert [i.serial for i in r[n]] == first_steps(data, row, of_lane, BOUNDS[n], reverse, limits[n]), (n, row)


def over_limit(step):
    return step(nodes.Scan("step", "d", **OF_LANE, lo=(AT, False), limit=3))


STEPS = {
    "an expression": nodes.Field("x", over_limit(lambda d: nodes.Project(d, (b.As("serial", b.C("d", "serial")), b.As("by", b.Add(b.C("d", "at"), AT)))))),
    "a limit of an expression": nodes.Field("x", nodes.Limit(nodes.Project(nodes.Scan("step", "d", **OF_LANE, lo=(AT, False)), (b.As("by", b.Add(b.C("d", "at"), AT)),)), 2)),
    "a filter above": nodes.Field("x", over_limit(lambda d: nodes.Filter(d, b.Gt(b.C("d", "serial"), b.O("s", "serial"))))),
    "a filter below": nodes.Field("x", nodes.Limit(nodes.Filter(nodes.Scan("step", "d", **OF_LANE, lo=(AT, False)), b.Gt(b.C("d", "serial"), b.I(4))), 1)),
    "an outer filter below": nodes.Field("x", nodes.Limit(nodes.Filter(nodes.Scan("step", "d", **OF_LANE, lo=(AT, False)), b.Gt(b.C("d", "serial"), b.O("s", "serial"))), 1)),
    "a limit of a limit": nodes.Field("x", nodes.Limit(over_limit(lambda d: d), 2)),
    "a lookup below": nodes.Field("x", nodes.Limit(nodes.Lookup(nodes.Scan("step", "d", **OF_LANE, lo=(AT, False)), "step", "e", "by_lane", (b.C("d", "lane"),), many=True, reverse=True), 4)),
    "a left lookup below": nodes.Field("x", nodes.Limit(nodes.Lookup(nodes.Scan("step", "d", **OF_LANE, hi=(AT, False), reverse=True), "step", "e", "primary", (b.Add(b.C("d", "serial"), b.O("s", "serial")),), optional=True), 2)),
    "lists of its own": nodes.Field("x", nodes.Limit(nodes.Map(nodes.Scan("step", "d", **OF_LANE, lo=(AT, False)), (nodes.Field("y", nodes.Limit(nodes.Scan("step", "e", "by_at", lo=(b.O("d", "at"), True)), 1)),)), 2)),
    "one": nodes.Field("x", nodes.Scan("step", "d", **OF_LANE, lo=(AT, False)), True),
    "keys only": nodes.Field("x", nodes.Filter(nodes.Scan("step", "d", **OF_LANE, limit=2), b.Gt(b.C("d", "serial"), b.O("s", "serial")))),
    "the same for all": nodes.Field("x", nodes.Filter(nodes.Scan("step", "d", "by_at", lo=(b.F(1), False), limit=2), b.Gt(b.C("d", "serial"), b.O("s", "serial")))),
}


@pytest.mark.parametrize("name", STEPS)
def test_steps_around_limits_within_outer_bounds(spark, name):
    data = [(i, "ab"[i % 2], float(x)) for i, x in enumerate([3, 3, 1, 2, 1, 0, 2, 5])] + [(8, None, 1.0), (9, "a", None)]
    s = steps(spark, data)
    got = s.run(nodes.Map(nodes.Scan("step", "s", "primary"), (STEPS[name],))).df.collect()
    assert [r.asDict(True)["x"] for r in got] == each_outer_row(s, nodes.Scan("step", "s", "primary"), STEPS[name])


def test_limits_within_outer_bounds_do_not_pair_all_rows(spark):
    n = 1500
    s = steps(spark, [(i, "a", float(i * 7 % n)) for i in range(n)])
    inner = nodes.Limit(nodes.Scan("step", "d", **OF_LANE, lo=(AT, False)), 2)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = s.run(nodes.Map(nodes.Scan("step", "s", "by_at"), (nodes.Field("x", inner), nodes.Field("y", inner.input, True)))).df
        assert sorted(len(r.x) for r in df.collect()) == [0, 1] + [2] * (n - 2)
        plans, made = [df._jdf.queryExecution().executedPlan()], []
        while plans:
            p = plans.pop()
            plans += [p.children().apply(i) for i in range(p.children().size())]
            rows_out = p.metrics().get("numOutputRows")
            made += [rows_out.get().value()] if rows_out.isDefined() else []
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert n <= max(made) <= 3 * n


def same_rows(a, c):
    assert sorted(map(repr, rows(a))) == sorted(map(repr, rows(c)))


EQUIVALENT = [
    "SELECT serial, model FROM sensor WHERE serial = 3 AND model = 'frost'",
    "SELECT serial FROM sensor WHERE site = 'N' AND slot > 1",
    "SELECT serial FROM sensor WHERE serial IN (1, 3, 3, 8) AND top > 2",
    "SELECT id FROM alarm WHERE raised >= '2024-03-02' AND raised < '2024-03-03'",
    "SELECT r.value FROM sensor s JOIN reading r ON r.serial = s.serial WHERE s.model = 'frost' AND r.kind = 'cold'",
    "SELECT a.id, s.model FROM alarm a LEFT JOIN sensor s ON s.serial = a.serial WHERE s.model IS NULL OR a.id > 70",
]


@pytest.mark.parametrize("statement", EQUIVALENT)
def test_chosen_paths_give_the_rows_of_plain_scans(still, statement):
    c = still.compile(statement)
    assert c.text != nodes.explain(c.logical)
    same_rows(still.run(c.plan).df, still.run(c.logical).df)


def test_batched_fields_and_flat_joins_agree(still):
    one, other = (still.run(nodes.Map(SENSORS, (nodes.Field("x", OF_SENSOR, batched=f),))).df for f in (False, True))
    assert rows(one) == rows(other)
    flat = rows(still.sql("SELECT s.serial, r.value FROM sensor s JOIN reading r ON r.serial = s.serial"))
    assert sorted(flat) == sorted((r.serial, x.value) for r in one.collect() for x in r.x)


def test_changes(net):
    for statement, error in (
        ("INSERT INTO site VALUES ('N', 'new', NULL)", DuplicateKey),
        ("INSERT INTO site VALUES ('E', 'north', NULL)", DuplicateKey),
        ("INSERT INTO sensor VALUES (8, 'E', 1, 'a', 1), (9, 'E', 1, 'a', 1)", DuplicateKey),
        ("INSERT INTO site VALUES ('E', 'e', NULL), ('E', 'f', NULL) ON CONFLICT (code) DO UPDATE SET lead = 'x'", DuplicateKey),
        ("UPDATE sensor SET slot = 2 WHERE serial = 1", DuplicateKey),
        ("INSERT INTO site (code) VALUES ('E')", QueryError),
        ("UPDATE site SET title = NULL WHERE code = 'N'", QueryError),
    ):
        with pytest.raises(error):
            net.sql(statement)
    assert net.tables.version() == 4
    assert rows(net.sql("UPDATE sensor SET top = top * 2 WHERE site = 'N' RETURNING serial, top")) == [(1, 5.0), (2, None)]
    assert rows(net.sql("INSERT INTO site VALUES ('Z', 'z', NULL), ('A', 'a', NULL) RETURNING code")) == [("Z",), ("A",)]
    assert rows(net.sql("DELETE FROM alarm WHERE raised < '2024-03-03' RETURNING id")) == [(71,), (72,)]
    done = net.execute(net.compile("INSERT INTO site VALUES ('N', 'no', NULL), ('E', 'east', NULL), ('E', 'again', NULL) ON CONFLICT DO NOTHING"))
    assert done.rows_affected == 1 and done.df is None
    assert rows(net.sql("SELECT code, title FROM site WHERE code IN ('N', 'E') LIMIT 9")) == [("N", "north"), ("E", "east")]
    net.sql("INSERT INTO site VALUES ('N', 'x', 'bo'), ('Q', 'queue', 'bo') ON CONFLICT (code) DO UPDATE SET lead = excluded.lead")
    assert rows(net.sql("SELECT title, lead FROM site WHERE code IN ('N', 'Q') LIMIT 9")) == [("north", "bo"), ("queue", "bo")]
    # two unique values change places in one statement
    net.sql("UPDATE sensor SET slot = 3 - slot WHERE site = 'N'")
    assert rows(net.sql("SELECT serial FROM sensor WHERE site = 'N' ORDER BY slot")) == [(2,), (1,)]
    assert net.execute(net.compile("DELETE FROM alarm WHERE id = 999")).rows_affected == 0


def test_a_point_change_groups_nothing_and_leaves_other_files(net, monkeypatch):
    monkeypatch.setattr(store_module, "MOST_SMALL", 0)
    monkeypatch.setattr(store_module, "SMALL_BYTES", 0)
    net.script("INSERT INTO alarm VALUES (80, '2024-04-01', 1); INSERT INTO alarm VALUES (81, '2024-04-02', 1);")
    before = net.tables.snapshot("alarm")[1]
    seen = []
    real = net.tables.read
    monkeypatch.setattr(net.tables, "read", lambda name, files, more="": seen.append([f.path for f in files]) or real(name, files, more))
    net.sql("UPDATE alarm SET serial = 2 WHERE id = 80")
    after = net.tables.snapshot("alarm")[1]
    assert len(before) == 3 and len(set(before) & set(after)) == 2
    net.sql("DELETE FROM alarm WHERE id = 81")
    assert len(set(net.tables.snapshot("alarm")[1]) & set(after)) == len(after) - 1
    assert [r[0] for r in rows(net.sql("SELECT id FROM alarm WHERE raised >= '2024-01-01' ORDER BY raised"))] == [71, 72, 70, 80]


def test_conflicts_are_retried(net, monkeypatch):
    real, tries = net.tables.publish, []

    def busy(version, name, files):
        tries.append(version)
        if len(tries) < 3:
            raise Conflict
        real(version, name, files)

    monkeypatch.setattr(net.tables, "publish", busy)
    net.sql("DELETE FROM alarm WHERE id = 70")
    assert len(tries) == 3
    monkeypatch.setattr(net.tables, "publish", lambda *a: (_ for _ in ()).throw(Conflict()))
    with pytest.raises(Conflict):
        net.sql("DELETE FROM alarm WHERE id = 71")


def test_snapshots_persist_bind_and_conflict(spark, tmp_path):
    catalog = build(NET)
    one = SnapshotStore(spark, catalog, str(tmp_path))
    Session(spark, catalog, one).script(ROWS)
    again = Session(spark, catalog, SnapshotStore(spark, catalog, f"file://{tmp_path}"))
    assert rows(again.sql("SELECT title FROM site WHERE code = 'S'")) == [("south",)]
    version, files = one.snapshot("site")
    old = one.frame("site")
    again.sql("DELETE FROM site WHERE code = 'S'")
    with pytest.raises(Conflict):
        one.publish(version, "site", files)
    assert old.count() == 3 and one.frame("site").count() == 2
    one.vacuum()
    assert one.frame("site").count() == 2 and one.frame("sensor").count() == 4 and len(one.versions()) == 1
    SnapshotStore(spark, build({"relations": [*NET["relations"], relation("extra", "id int", "id")]}), str(tmp_path))
    with pytest.raises(QueryError):
        SnapshotStore(spark, build({"relations": NET["relations"][:2]}), str(tmp_path))


@pytest.mark.parametrize("kind", [MemoryStore, SnapshotStore])
def test_random_changes_equal_a_plain_model(spark, tmp_path, kind):
    catalog = build({"relations": [relation("t", "id int, u string null, n int", "id", ("by_u", "u", True))]})
    s = Session(spark, catalog, MemoryStore(spark, catalog) if kind is MemoryStore else SnapshotStore(spark, catalog, str(tmp_path)))
    model, r = {}, random.Random(5)
    for step in range(24):
        i, u = r.randrange(6), r.choice([None, "a", "b", "c"])
        quoted = "NULL" if u is None else f"'{u}'"
        taken = {v[0]: k for k, v in model.items() if v[0] is not None}
        kind_of_change = r.choice(["insert", "nothing", "upsert", "update", "delete"])
        new = dict(model)
        if kind_of_change == "delete":
            statement = f"DELETE FROM t WHERE id = {i}"
            new.pop(i, None)
        elif kind_of_change == "update":
            statement = f"UPDATE t SET u = {quoted}, n = {step} WHERE id = {i}"
            fails = i in model and taken.get(u, i) != i
            if i in model:
                new[i] = (u, step)
        else:
            tail = {"insert": "", "nothing": " ON CONFLICT DO NOTHING", "upsert": f" ON CONFLICT (id) DO UPDATE SET u = excluded.u, n = t.n + 1"}[kind_of_change]
            statement = f"INSERT INTO t VALUES ({i}, {quoted}, {step}){tail}"
            writes = i not in model or kind_of_change == "upsert"
            fails = (kind_of_change == "insert" and i in model) or (writes and taken.get(u, i) != i)
            if writes:
                new[i] = (u, model[i][1] + 1 if i in model else step)
        if kind_of_change != "delete" and fails:
            with pytest.raises(DuplicateKey):
                s.sql(statement)
        else:
            s.sql(statement)
            model = new
        if step % 8 == 7:
            assert {x.id: (x.u, x.n) for x in s.tables.frame("t").collect()} == model, step
    assert len(s.tables.snapshot("t")[1]) <= store_module.MOST_SMALL + 1


@pytest.mark.parametrize(
    "change",
    [
        {"columns": [{"name": "id", "type": "blob"}]},
        {"columns": [{"name": "id", "type": "int", "nullable": True}]},
        {"columns": [{"name": "id", "type": "int"}, {"name": "id", "type": "int"}]},
        {"primary": {}},
        {"paths": [{"name": "p", "partition": ["nope"]}]},
        {"paths": [{"name": "p", "partition": ["id", "id"]}]},
        {"paths": [{"name": "primary", "partition": ["id"]}]},
        {"paths": [{"name": "p", "partition": ["id"], "id": 1}]},
        {"id": -2},
        {"name": ""},
    ],
)
def test_catalog_errors(change):
    good = relation("t", "id int", "id")
    build({"relations": [good]})
    with pytest.raises(QueryError):
        build({"relations": [good | change]})


def test_catalog_files(tmp_path):
    (tmp_path / "net.json").write_text(json.dumps(NET))
    catalog = load(str(tmp_path / "net.json"))
    numbered = build({"relations": [relation("a", "id int", "id") | {"id": 7}, relation("b", "id int", "id", ("p", "id", False))]})
    assert [r.id for r in numbered.relations.values()] == [7, 2] and [p.id for p in numbered.relation("b").paths] == [1, 2]
    with pytest.raises(QueryError):
        build({"relations": [relation("a", "id int", "id") | {"id": 2}, relation("b", "id int", "id")]})
    assert catalog.relation("site").relationships["sensors"].columns == ("code",) and catalog.relation("alarm").path("by_time").partition == ()


def test_graphql_reads(still):
    got = still.graphql(
        """query Q($n: Int = 1, $hide: Boolean!) { site_by_pk(code: "N") { title sensors(order_by: {slot: desc}, limit: $n) { ...f readings { value } } }
        sensor(where: {site: {_eq: "S"}}) { serial @skip(if: $hide) home { title __typename } } } fragment f on Sensor { id: serial model @include(if: $hide) }""",
        {"hide": True},
    )
    assert got == {"data": {"site_by_pk": {"title": "north", "sensors": [{"id": 2, "model": "rain", "readings": []}]}, "sensor": [{"home": {"title": "south", "__typename": "Site"}}]}}
    assert still.graphql('{ site_by_title(title: "no") { code } }') == {"data": {"site_by_title": None}}
    assert still.graphql('{ reading(where: {_and: {kind: {_eq: "wet"}}, value: {_gt: 5}}) { at note } }') == {"data": {"reading": [{"at": "2024-03-02T00:00:00Z", "note": None}]}}


WRONG_QUERIES = [
    "{ probe { id } }",
    '{ sensor_by_pk(serial: "x") { serial } }',
    "{ sensor { serial } }",
    "{ sensor_by_pk(serial: 1) { height } }",
    "{ sensor_by_pk(serial: 1) { home } }",
    "{ sensor_by_pk(serial: 1) { model { x } } }",
    "{ sensor_by_pk(serial: 1) { model @upper } }",
    "{ sensor_by_pk(serial: 1) { model @skip(if: 1) } }",
    "{ sensor_by_pk(serial: 1) { ...f } } fragment f on Sensor { ...f }",
    "{ sensor_by_pk(serial: 1) { ...g } }",
    "{ sensor_by_pk(serial: 1) { serial } } fragment f on Sensor { serial }",
    "{ sensor_by_pk(serial: $n) { serial } }",
    "query Q($n: Int) { sensor_by_pk(serial: 1) { serial } }",
    "query Q($n: Whole) { sensor_by_pk(serial: $n) { serial } }",
    "query Q($n: Int!) { sensor_by_pk(serial: $n) { serial } }",
    "{ sensor(where: {site: {_like: 1}}) { serial } }",
    '{ sensor(where: {site: "N"}) { serial } }',
    '{ sensor(where: {site: {_eq: "N"}}, limit: true) { serial } }',
    '{ sensor(where: {site: {_eq: "N"}}, offset: 1) { serial } }',
    "subscription { sensor { serial } }",
    "{ __schema { types { name } } }",
    "mutation { insert_site(objects: [{code: \"E\"}]) { affected_rows } }",
    "mutation { update_site(where: {code: {_eq: \"N\"}}, _set: {code: \"M\"}) { affected_rows } }",
]


@pytest.mark.parametrize("query", WRONG_QUERIES)
def test_graphql_refusals(strict, query):
    got = strict.graphql(query)
    assert got["data"] is None and got["errors"][0]["message"]


@pytest.mark.parametrize("full", [False, True])
@pytest.mark.parametrize(
    "query,variables",
    [
        ('mutation { delete_site(where: {code: {_eq: $c}}) { affected_rows } }', {}),
        ('mutation D($d: String) { delete_site(where: {code: {_eq: $c}}) { affected_rows } }', {"c": "N"}),
        ('mutation D($c: String) { delete_site(where: {code: {_eq: $c}}) { affected_rows } }', {}),
        ('mutation D($c: String) { update_site(where: {code: {_eq: $c}}, _set: {lead: "x"}) { affected_rows } }', {}),
        ('mutation D($w: site_bool_exp) { delete_site(where: $w) { affected_rows } }', {}),
        ('mutation { delete_site(where: {code: {_eq: "N"}} @all) { affected_rows } }', {}),
        ('mutation { delete_site(where: {code: {_eq: "N"}}) @all { affected_rows } }', {}),
        ('mutation { delete_site { affected_rows } }', {}),
    ],
)
def test_a_mistyped_change_changes_nothing(still, query, variables, full):
    version = still.tables.version()
    got = Session(still.spark, still.catalog, still.tables, full).graphql(query, variables)
    assert got["data"] is None and still.tables.version() == version


def test_graphql_changes_and_http(net):
    q = 'mutation { insert_site(objects: [{code: "E", title: "east"}]) { affected_rows returning { code at: title } } update_site(where: {code: {_eq: "E"}}, _set: {lead: "bo"}) { affected_rows } }'
    assert cli.answer(net, "GET", "/graphql?query=mutation%20%7Bx%7D", b"")[0] == 405
    status, _, body = cli.answer(net, "POST", "/graphql", json.dumps({"query": q}).encode())
    assert status == 200 and json.loads(body)["data"] == {"insert_site": {"affected_rows": 1, "returning": [{"code": "E", "at": "east"}]}, "update_site": {"affected_rows": 1}}
    again = net.graphql(q)
    assert again["data"] is None and again["errors"][0]["path"] == ["insert_site"]
    assert cli.answer(net, "POST", "/graphql", b"{}")[0] == 400
    assert "type Sensor" in cli.answer(net, "GET", "/graphql/schema", b"")[2] and "insert_alarm" in schema_text(net.catalog)
    assert net.graphql("mutation M($w: site_bool_exp) { delete_site(where: $w) { affected_rows } }", {"w": {"code": {"_in": ["E", "W"]}}}) == {"data": {"delete_site": {"affected_rows": 2}}}


def test_graphql_plans_equal_sql_plans(strict):
    g = GraphQL(strict)
    for gql, statement in (
        ('{ sensor(where: {site: {_eq: "N"}}, order_by: {slot: desc}, limit: 3) { serial top } }', "SELECT serial, top FROM sensor WHERE site = 'N' ORDER BY slot DESC LIMIT 3"),
        ("{ alarm(where: {id: {_in: [70, 71]}}) { raised } }", "SELECT raised FROM alarm WHERE id IN (70, 71)"),
    ):
        g.doc, g.vars = Document(gql), {}
        (s,) = g.doc.operations[0].selections
        assert nodes.explain(g.list(strict.catalog.relation(s.name), s)) == strict.compile(statement).text


def test_shell(net):
    out = StringIO()
    cli.shell(net, ["\\d\n", "SELECT title\n", "FROM site WHERE code = 'W';\n", "SELECT * FROM site;\n", "DELETE FROM alarm WHERE id = 70;\n", "\\q\n", "x;\n"], out)
    assert out.getvalue() == "site\nsensor\nreading\nalarm\ntitle\n-----\nwest\n(1 row)\nerror: full scan of site\nOK, 1 rows affected\n"
    assert complete("SELECT ';' ;") and not complete("SELECT ';'") and not complete("SELECT 1 -- ;")


def test_timestamps():
    assert parse_timestamp("2024-03-02T03:04:05+02:00").isoformat() == "2024-03-02T01:04:05"
    assert parse_timestamp("2024-03-02 03:04:05.1234567").microsecond == 123456
    with pytest.raises(QueryError):
        parse_timestamp("2024")
