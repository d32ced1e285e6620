"""The registered queries over the warehouse tables, each through a front end, with the same in ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.expr import And, Arith, Cmp, Col, Lit, Outer
from ..plans import nodes
from ..plans.graphql import GraphQL
from ..session import Session
from ..sources.store import MemoryStore
from ..sources.warehouse import ParquetTables, warehouse_catalog
from .rules import RULES

FLAGSHIP = "SELECT c.c_name, o.o_orderkey, o.o_totalprice FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_custkey = 7 ORDER BY o.o_orderdate DESC LIMIT 5"


def reader(spark: SparkSession, sf_dir: str, full: bool = False) -> Session:
    return Session(spark, warehouse_catalog(), ParquetTables(spark, sf_dir), full)


# name: (statement, parameters, full scan allowed, oracle; None: the statement itself is ANSI SQL)
SQL: dict[str, tuple[str, tuple, bool, str | None]] = {
    "flagship": (FLAGSHIP, (), False, FLAGSHIP.replace("DESC LIMIT", "DESC, o.o_orderkey DESC LIMIT")),
    "get_pk": ("SELECT * FROM customer WHERE c_custkey = 42", (), False, None),
    "get_unique": ("SELECT c_custkey, c_acctbal FROM customer WHERE c_name = 'Customer#000000042'", (), False, None),
    "get_composite": ("SELECT value, event_type FROM events WHERE user_id = 7 AND ts = '1999-01-01 00:00:00'", (), False, "SELECT value, event_type FROM events WHERE user_id = 7 AND ts = TIMESTAMP '1999-01-01 00:00:00'"),
    "get_many": ("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (9, 3, 5, 100000000)", (), False, None),
    "scan_full": ("SELECT n_nationkey, n_name FROM nation", (), True, None),
    "scan_full_large": ("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders", (), True, None),
    "scan_prefix": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 11", (), False, None),
    "scan_range_lo": ("SELECT o_orderkey FROM orders WHERE o_custkey = 11 AND o_orderdate >= '1996-01-01'", (), False, "SELECT o_orderkey FROM orders WHERE o_custkey = 11 AND o_orderdate >= TIMESTAMP '1996-01-01'"),
    "scan_range_hi": ("SELECT o_orderkey FROM orders WHERE o_custkey = 11 AND o_orderdate < '1996-01-01'", (), False, "SELECT o_orderkey FROM orders WHERE o_custkey = 11 AND o_orderdate < TIMESTAMP '1996-01-01'"),
    "scan_range_both": ("SELECT p_partkey, p_size FROM part WHERE p_brand = 'Brand#11' AND p_size > 10 AND p_size <= 30", (), False, None),
    "scan_range_empty": ("SELECT o_orderkey FROM orders WHERE o_custkey = 11 AND o_orderdate > '1998-01-01' AND o_orderdate < '1997-01-01'", (), False, "SELECT o_orderkey FROM orders WHERE false"),
    "scan_range_only": ("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= '1997-06-01' AND o_orderdate < '1997-07-01'", (), False, "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01' AND o_orderdate < TIMESTAMP '1997-07-01'"),
    "scan_reverse": ("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC LIMIT 20", (), False, "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20"),
    "scan_limit": ("SELECT c_custkey FROM customer LIMIT 10", (), False, "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10"),
    "project_expr": ("SELECT o_orderkey AS k, o_totalprice * 2 AS twice, o_orderkey + 1 AS nxt FROM orders WHERE o_custkey = 4", (), False, None),
    "select_star": ("SELECT r.*, n.n_name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey WHERE n.n_nationkey = 3", (), False, None),
    "filter_cmp": ("SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND c_nationkey <> 3 AND c_mktsegment >= 'C'", (), True, None),
    "filter_3vl": ("SELECT c.c_custkey FROM customer c LEFT JOIN events e ON e.user_id = c.c_custkey WHERE e.value > 50 OR e.value IS NULL AND c.c_acctbal < 0", (), True, None),
    "filter_not": ("SELECT c_custkey FROM customer WHERE NOT (c_acctbal > 0 OR c_nationkey = 5)", (), True, None),
    "filter_in": ("SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2, NULL)", (), True, None),
    "filter_not_in": ("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (1, 2, 3)", (), True, None),
    "filter_between": ("SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 9", (), True, None),
    "filter_is_null": ("SELECT c.c_custkey FROM customer c LEFT JOIN events e ON e.user_id = c.c_custkey WHERE e.event_id IS NULL", (), True, None),
    "filter_ts_string": ("SELECT o_orderkey FROM orders WHERE '1995-03-15T00:00:00+02:00' < o_orderdate AND o_orderdate <= '1995-03-20'", (), True, "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1995-03-14 22:00:00' AND o_orderdate <= TIMESTAMP '1995-03-20'"),
    "param_dollar": ("SELECT o_orderkey FROM orders WHERE o_custkey = $1 AND o_totalprice > $2", (11, 1000.0), False, "SELECT o_orderkey FROM orders WHERE o_custkey = 11 AND o_totalprice > 1000.0"),
    "param_qmark": ("SELECT c_name FROM customer WHERE c_custkey = ?", (5,), False, "SELECT c_name FROM customer WHERE c_custkey = 5"),
    "lookup_one": ("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey", (), True, None),
    "lookup_one_left": ("SELECT e.event_id, c.c_name FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id WHERE e.event_type = 'click'", (), False, None),
    "lookup_many": ("SELECT c.c_custkey, o.o_orderkey FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_nationkey = 3", (), False, None),
    "lookup_many_left": ("SELECT o.o_orderkey, l.l_partkey, l.l_quantity FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'P'", (), False, None),
    "lookup_chain3": ("SELECT n.n_name, c.c_custkey, o.o_orderkey FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey WHERE n.n_name = 'NATION_3'", (), False, None),
    "lookup_null_key": ("SELECT c.c_custkey, e.event_id, x.c_name FROM customer c LEFT JOIN events e ON e.user_id = c.c_custkey LEFT JOIN customer x ON x.c_custkey = e.user_id WHERE c.c_nationkey = 2", (), False, None),
    "join_residual": ("SELECT c.c_custkey, o.o_orderkey FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 200000 WHERE c.c_nationkey = 3", (), False, None),
    "join_composite": ("SELECT l.l_orderkey, l.l_linenumber, m.l_partkey FROM lineitem l JOIN lineitem m ON m.l_orderkey = l.l_orderkey AND m.l_linenumber = l.l_linenumber WHERE l.l_orderkey = 5", (), False, None),
    "join_computed_key": ("SELECT c.c_custkey, d.c_name FROM customer c JOIN customer d ON d.c_custkey = c.c_custkey + 1 WHERE c.c_nationkey = 4", (), False, None),
    "join_const_key": ("SELECT c.c_custkey, r.r_name FROM customer c JOIN region r ON r.r_regionkey = 1 WHERE c.c_nationkey = 4", (), False, None),
    "join_self": ("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON b.n_regionkey = a.n_regionkey WHERE a.n_nationkey = 1", (), False, None),
    "join_unique_secondary": ("SELECT c.c_custkey, o.o_orderkey FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_name = 'Customer#000000011'", (), False, None),
    "anti_join_idiom": ("SELECT o.o_orderkey FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE l.l_orderkey IS NULL", (), True, None),
    "order_multi": ("SELECT o_orderstatus, o_orderdate, o_orderkey FROM orders ORDER BY o_orderstatus, o_orderdate LIMIT 25", (), False, "SELECT o_orderstatus, o_orderdate, o_orderkey FROM orders ORDER BY o_orderstatus, o_orderdate, o_orderkey LIMIT 25"),
    "order_eq_free": ("SELECT o_orderkey FROM orders WHERE o_custkey = 11 ORDER BY o_custkey, o_orderdate LIMIT 3", (), False, "SELECT o_orderkey FROM orders WHERE o_custkey = 11 ORDER BY o_orderdate, o_orderkey LIMIT 3"),
    "order_moot": ("SELECT c_name FROM customer WHERE c_custkey = 5 ORDER BY c_acctbal", (), False, None),
    "order_alias": ("SELECT o_orderdate AS d, o_orderkey FROM orders WHERE o_custkey = 11 ORDER BY d LIMIT 4", (), False, "SELECT o_orderdate AS d, o_orderkey FROM orders WHERE o_custkey = 11 ORDER BY o_orderdate, o_orderkey LIMIT 4"),
    "order_outer": ("SELECT o.o_orderkey, c.c_name FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus = 'O' ORDER BY o.o_orderdate LIMIT 10", (), False, "SELECT o.o_orderkey, c.c_name FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus = 'O' ORDER BY o.o_orderdate, o.o_orderkey LIMIT 10"),
    "order_target": (FLAGSHIP.replace("DESC LIMIT 5", "LIMIT 3"), (), False, FLAGSHIP.replace("DESC LIMIT 5", ", o.o_orderkey LIMIT 3")),
    "topk": ("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC LIMIT 10", (), False, "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 10"),
    "limit_no_order": ("SELECT o_orderkey FROM orders WHERE o_custkey = 11 LIMIT 2", (), False, "SELECT o_orderkey FROM orders WHERE o_custkey = 11 ORDER BY o_orderdate, o_orderkey LIMIT 2"),
    "limit_zero": ("SELECT o_orderkey FROM orders WHERE o_custkey = 11 LIMIT 0", (), False, None),
    "arith_add_sub_mul": ("SELECT l_linenumber + l_partkey AS a, l_suppkey - 3 AS b, l_quantity * l_discount AS c FROM lineitem WHERE l_orderkey = 5", (), False, None),
    "arith_div_int": ("SELECT o_orderkey / 7 AS q FROM orders WHERE o_custkey = 11", (), False, "SELECT o_orderkey // 7 AS q FROM orders WHERE o_custkey = 11"),
    "arith_div_float": ("SELECT o_totalprice / 7 AS q FROM orders WHERE o_custkey = 11", (), False, None),
    "arith_mod": ("SELECT o_orderkey % 7 AS r, (0 - o_orderkey) % 7 AS s FROM orders WHERE o_custkey = 11", (), False, None),
    "arith_neg": ("SELECT -o_orderkey AS n, -o_totalprice AS m FROM orders WHERE o_custkey = 11", (), False, None),
}

# name: (query, oracle), over the nested front end
GRAPHQL: dict[str, tuple[str, str]] = {
    "gql_list": ("{ orders(where: {o_custkey: {_eq: 11}}) { o_orderkey o_totalprice } }", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 11"),
    "gql_by_pk": ("{ customer_by_pk(c_custkey: 5) { c_name c_acctbal } }", "SELECT c_name, c_acctbal FROM customer WHERE c_custkey = 5"),
    "gql_by_unique": ('{ nation_by_name(n_name: "NATION_3") { n_nationkey } }', "SELECT n_nationkey FROM nation WHERE n_name = 'NATION_3'"),
    "gql_where_ops": ("{ part(where: {p_brand: {_eq: \"Brand#11\"}, p_size: {_gte: 5, _lt: 20, _neq: 7}}) { p_partkey } }", "SELECT p_partkey FROM part WHERE p_brand = 'Brand#11' AND p_size >= 5 AND p_size < 20 AND p_size <> 7"),
    "gql_where_bool": ("{ customer(where: {c_nationkey: {_eq: 3}, _or: [{c_acctbal: {_gt: 5000}}, {_not: {c_mktsegment: {_in: [\"BUILDING\", \"MACHINERY\"]}}}]}) { c_custkey } }", "SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND (c_acctbal > 5000 OR c_mktsegment NOT IN ('BUILDING', 'MACHINERY'))"),
    "gql_order": ("{ orders(where: {o_custkey: {_eq: 11}}, order_by: {o_orderdate: desc}, limit: 3) { o_orderkey } }", "SELECT o_orderkey FROM orders WHERE o_custkey = 11 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 3"),
    "gql_nested_many": ("{ customer(where: {c_nationkey: {_eq: 3}}) { c_custkey orders { o_orderkey } } }", "SELECT c_custkey, coalesce((SELECT list({'o_orderkey': o_orderkey} ORDER BY o_orderdate, o_orderkey) FROM orders WHERE o_custkey = c_custkey), []) AS orders FROM customer WHERE c_nationkey = 3"),
    "gql_nested_one": ("{ orders(where: {o_custkey: {_eq: 11}}) { o_orderkey customer { c_name } } }", "SELECT o_orderkey, {'c_name': c_name} AS customer FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey = 11"),
    "map_nested3": ("{ nation(where: {n_regionkey: {_eq: 1}}) { n_name customers(limit: 2) { c_custkey orders(limit: 1) { o_orderkey } } } }", """
        SELECT n_name, coalesce((SELECT list({'c_custkey': c_custkey, 'orders': os} ORDER BY c_acctbal, c_custkey) FROM (
            SELECT c_custkey, c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS r,
                   coalesce((SELECT list({'o_orderkey': o_orderkey}) FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1 AND o_custkey = c_custkey), []) AS os
            FROM customer) c WHERE r <= 2 AND c_nationkey = n_nationkey), []) AS customers
        FROM nation WHERE n_regionkey = 1"""),
    "map_limit": ("{ customer(where: {c_nationkey: {_eq: 3}}) { c_custkey orders(order_by: {o_orderdate: desc}, limit: 2) { o_orderkey } } }", """
        SELECT c_custkey, coalesce((SELECT list({'o_orderkey': o_orderkey} ORDER BY k) FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k <= 2 AND o_custkey = c_custkey), []) AS orders
        FROM customer WHERE c_nationkey = 3"""),
    "map_filter": ("{ customer(where: {c_nationkey: {_eq: 3}}) { c_custkey orders(where: {o_totalprice: {_gt: 250000}}) { o_orderkey } } }", "SELECT c_custkey, coalesce((SELECT list({'o_orderkey': o_orderkey} ORDER BY o_orderdate, o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000), []) AS orders FROM customer WHERE c_nationkey = 3"),
    "map_root_order": ("{ customer(where: {c_nationkey: {_eq: 3}}, order_by: {c_acctbal: desc}, limit: 4) { c_custkey nation { n_name } } }", "SELECT c_custkey, {'n_name': n_name} AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey = 3 ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 4"),
}

_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
_AS_INT = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM ({}) x"

# name: (statement, oracle of nation afterwards; or of RETURNING)
CHANGES: dict[str, tuple[str, str]] = {
    "insert_rows": ("INSERT INTO nation (n_nationkey, n_name, n_regionkey) VALUES (100, 'X', 1), (101, 'Y', 2)", _AS_INT.format(_NATION + " UNION ALL VALUES (100, 'X', 1), (101, 'Y', 2)")),
    "insert_do_nothing": ("INSERT INTO nation VALUES (1, 'X', 1), (100, 'Y', 2), (100, 'Z', 3) ON CONFLICT DO NOTHING", _AS_INT.format(_NATION + " UNION ALL VALUES (100, 'Y', 2)")),
    "upsert": ("INSERT INTO nation VALUES (1, 'X', 4), (100, 'Y', 2) ON CONFLICT (n_nationkey) DO UPDATE SET n_name = excluded.n_name, n_regionkey = nation.n_regionkey + 10", _AS_INT.format("SELECT n_nationkey, CASE WHEN n_nationkey = 1 THEN 'X' ELSE n_name END AS n_name, CASE WHEN n_nationkey = 1 THEN n_regionkey + 10 ELSE n_regionkey END AS n_regionkey FROM nation UNION ALL VALUES (100, 'Y', 2)")),
    "update_where": ("UPDATE nation SET n_regionkey = n_regionkey + 1 WHERE n_regionkey = 2", _AS_INT.format("SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 2 THEN 3 ELSE n_regionkey END AS n_regionkey FROM nation")),
    "delete_where": ("DELETE FROM nation WHERE n_regionkey = 2", _AS_INT.format(_NATION + " WHERE n_regionkey <> 2")),
    "insert_returning": ("INSERT INTO nation VALUES (100, 'X', 1) RETURNING n_nationkey, n_regionkey + 1 AS r", "SELECT CAST(100 AS BIGINT) AS n_nationkey, CAST(2 AS BIGINT) AS r"),
    "update_returning": ("UPDATE nation SET n_name = 'Q' WHERE n_nationkey = 3 RETURNING *", _AS_INT.format("SELECT n_nationkey, 'Q' AS n_name, n_regionkey FROM nation WHERE n_nationkey = 3")),
    "delete_returning": ("DELETE FROM nation WHERE n_nationkey = 3 RETURNING n_name", "SELECT n_name FROM nation WHERE n_nationkey = 3"),
    "gql_insert": ('mutation { insert_nation(objects: [{n_nationkey: 100, n_name: "X", n_regionkey: 1}]) { affected_rows } }', _AS_INT.format(_NATION + " UNION ALL VALUES (100, 'X', 1)")),
    "gql_update": ('mutation { update_nation(where: {n_nationkey: {_eq: 3}}, _set: {n_name: "Q"}) { affected_rows } }', _AS_INT.format("SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'Q' ELSE n_name END AS n_name, n_regionkey FROM nation")),
    "gql_delete": ("mutation { delete_nation(where: {n_regionkey: {_eq: 2}}) { affected_rows } }", _AS_INT.format(_NATION + " WHERE n_regionkey <> 2")),
}


# name: (statements, oracle of orders afterwards): changes of a few rows of a large table
LARGE_CHANGES: dict[str, tuple[str, str]] = {
    "update_large": (
        "UPDATE orders SET o_totalprice = o_totalprice * 2, o_orderstatus = 'X' WHERE o_custkey = 11",
        "SELECT o_orderkey, o_custkey, CASE WHEN o_custkey = 11 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_custkey = 11 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders",
    ),
    "delete_large": (
        "DELETE FROM orders WHERE o_orderdate >= '1997-06-01' AND o_orderdate < '1997-07-01'",
        "SELECT * FROM orders WHERE NOT (o_orderdate >= TIMESTAMP '1997-06-01' AND o_orderdate < TIMESTAMP '1997-07-01')",
    ),
    "upsert_large": (
        "INSERT INTO orders VALUES (5, 1, 'Z', 1.5, '2001-01-01', 'none'), (-5, 1, 'Z', 2.5, '2001-01-02', 'none') ON CONFLICT (o_orderkey) DO UPDATE SET o_orderstatus = excluded.o_orderstatus",
        """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey = 5 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders
        UNION ALL SELECT CAST(-5 AS BIGINT), CAST(1 AS BIGINT), 'Z', 2.5, TIMESTAMP '2001-01-02', 'none' UNION ALL SELECT CAST(5 AS BIGINT), CAST(1 AS BIGINT), 'Z', 1.5, TIMESTAMP '2001-01-01', 'none' WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = 5)""",
    ),
    "change_after_change": (
        "UPDATE orders SET o_custkey = 12 WHERE o_custkey = 11; INSERT INTO orders VALUES (-6, 11, 'N', 1, '2001-01-01', 'none'); UPDATE orders SET o_totalprice = 0 WHERE o_custkey = 11; DELETE FROM orders WHERE o_custkey = 12",
        "SELECT * FROM orders WHERE o_custkey NOT IN (11, 12) UNION ALL SELECT CAST(-6 AS BIGINT), CAST(11 AS BIGINT), 'N', 0.0, TIMESTAMP '2001-01-01', 'none'",
    ),
}

# name: a statement that must fail and leave nation as it is
FAILED_CHANGES: dict[str, str] = {
    "insert_all_or_nothing": "INSERT INTO nation VALUES (100, 'X', 1), (101, 'Y', 1), (3, 'Z', 1)",
    "insert_duplicate_unique": "INSERT INTO nation VALUES (100, 'NATION_3', 1)",
    "insert_not_null": "INSERT INTO nation (n_nationkey, n_name) VALUES (100, 'X')",
    "update_duplicate_unique": "UPDATE nation SET n_name = 'NATION_3' WHERE n_nationkey = 4",
    "update_primary_key": "UPDATE nation SET n_nationkey = 100 WHERE n_nationkey = 4",
    "upsert_twice": "INSERT INTO nation VALUES (3, 'X', 1), (3, 'Y', 1) ON CONFLICT (n_nationkey) DO UPDATE SET n_regionkey = 7",
}


def writer(spark: SparkSession, sf_dir: str) -> Session:
    """A session that can change its own copy of the tables; one is copied when it first changes."""
    catalog = warehouse_catalog()
    files = ParquetTables(spark, sf_dir)
    frames = {n: files.frame(n) for n in ("region", "customer", "orders")} | {"nation": files.frame("nation").select(F.col("n_nationkey").cast("long"), "n_name", F.col("n_regionkey").cast("long"))}
    return Session(spark, catalog, MemoryStore(spark, catalog, frames))


def change_query(text: str, table: str = "nation") -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = writer(spark, sf_dir)
        if text.startswith("mutation"):
            out = s.graphql(text)
            if "errors" in out:
                raise RuntimeError(out["errors"])
            return s.tables.frame(table)
        got = s.script(text)[-1]
        return got.df if "RETURNING" in text else s.tables.frame(table)

    return run


def failed_change(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = writer(spark, sf_dir)
        try:
            s.script(text)
        except QueryError:
            return s.tables.frame("nation")
        raise RuntimeError(f"accepted: {text}")

    return run


def rows_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each of some statements changed; changes to the same value count, skipped rows do not."""
    s = writer(spark, sf_dir)
    done = s.script("UPDATE nation SET n_regionkey = n_regionkey WHERE n_regionkey = 1; INSERT INTO nation VALUES (3, 'X', 1), (100, 'Y', 1) ON CONFLICT DO NOTHING; DELETE FROM nation WHERE n_nationkey = 999")
    return spark.createDataFrame([(i, r.rows_affected) for i, r in enumerate(done)], "statement long, n long")


def lookup_limit_per_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reader(spark, sf_dir)
    plan = nodes.Project(
        nodes.Lookup(nodes.Scan("customer", "c", "by_nation", (Lit(3),)), "orders", "o", "by_cust", (Col("c", "c_custkey"),), True, False, True, 2),
        (("c_custkey", Col("c", "c_custkey")), ("o_orderkey", Col("o", "o_orderkey"))),
    )
    return s.run(plan).df


def insert_from_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = writer(spark, sf_dir)
    shifted = nodes.Project(nodes.Scan("region", "r"), (("k", Arith("+", Col("r", "r_regionkey"), Lit(500))), ("n", Col("r", "r_name")), ("g", Col("r", "r_regionkey"))))
    s.run(nodes.Insert("nation", "nation", ("n_nationkey", "n_name", "n_regionkey"), (), shifted))
    return s.tables.frame("nation")


def update_from_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = writer(spark, sf_dir)
    source = nodes.Lookup(nodes.Scan("region", "r", "primary", (Lit(1),)), "nation", "n", "by_region", (Col("r", "r_regionkey"),), True)
    s.run(nodes.Update("nation", "n", source, (("n_regionkey", Arith("+", Col("r", "r_regionkey"), Lit(8))),)))
    return s.tables.frame("nation")


def map_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record or NULL: customers with the event of a fixed time, if they have one."""
    s = reader(spark, sf_dir)
    inner = nodes.Project(nodes.Filter(nodes.Scan("customer", "x"), And((Cmp("=", Col("x", "c_custkey"), Outer("e", "user_id")), Cmp(">", Col("x", "c_acctbal"), Lit(0.0))))), (("c_name", Col("x", "c_name")),))
    plan = nodes.Project(nodes.Map(nodes.Scan("events", "e", "by_type", (Lit("click"),)), (nodes.Field("who", inner, True),)), (("event_id", Col("e", "event_id")), ("who", Col("", "who"))))
    return s.run(plan).df


def get_many_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by whole (user_id, ts) keys, among them one that puts one event's user with another's time."""
    s = reader(spark, sf_dir)
    keys = [(r.user_id, r.ts) for r in s.sql("SELECT event_id, user_id, ts FROM events WHERE event_id IN (1, 2, 3) LIMIT 3").collect()]
    listed = tuple((Lit(u), Lit(t)) for u, t in [*keys, (keys[0][0], keys[1][1])])
    return s.run(nodes.Project(nodes.GetMany("events", "e", "by_user", listed), (("event_id", Col("e", "event_id")), ("value", Col("e", "value"))))).df


CUSTOMERS = nodes.Scan("customer", "c", "by_nation", (Lit(3),))
ORDERS_OF = nodes.Scan("orders", "o", "by_cust", (Outer("c", "c_custkey"),))
ORDER_KEY = (("o_orderkey", Col("o", "o_orderkey")),)


def nested(inner: nodes.Node, one: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    plan = nodes.Project(nodes.Map(CUSTOMERS, (nodes.Field("x", inner, one),)), (("c_custkey", Col("c", "c_custkey")), ("x", Col("", "x"))))
    return lambda spark, sf_dir: reader(spark, sf_dir).run(plan).df


map_outer_filter = nested(nodes.Project(nodes.Filter(ORDERS_OF, Cmp(">", Col("o", "o_totalprice"), Arith("*", Outer("c", "c_acctbal"), Lit(20)))), ORDER_KEY))
map_limit_filter = nested(nodes.Project(nodes.Filter(nodes.Limit(ORDERS_OF, 2), Cmp(">", Col("o", "o_totalprice"), Lit(100000))), ORDER_KEY))
map_outer_bound = nested(nodes.Project(nodes.Limit(nodes.Scan("customer", "d", "by_nation", (Outer("c", "c_nationkey"),), (Outer("c", "c_acctbal"), False)), 2), (("c_custkey", Col("d", "c_custkey")),)))
map_first = nested(nodes.Project(ORDERS_OF, ORDER_KEY), True)

_LIST_OF_ORDERS = "SELECT c_custkey, coalesce((SELECT list({{'o_orderkey': o_orderkey}} ORDER BY o_orderdate, o_orderkey) FROM {} WHERE o_custkey = c_custkey AND {}), []) AS x FROM customer WHERE c_nationkey = 3"
_RANKED_ORDERS = "(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders)"

PLANS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "lookup_limit_per_row": (lookup_limit_per_row, "SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 3) x WHERE k <= 2"),
    "rows_affected": (rows_affected, "SELECT CAST(statement AS BIGINT) AS statement, CAST(n AS BIGINT) AS n FROM (SELECT 0 AS statement, count(*) AS n FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 1, 1 UNION ALL SELECT 2, 0) x"),
    "get_many_composite": (get_many_composite, "SELECT event_id, value FROM events WHERE event_id IN (1, 2, 3)"),
    "map_outer_filter": (map_outer_filter, _LIST_OF_ORDERS.format("orders", "o_totalprice > c_acctbal * 20")),
    "map_limit_filter": (map_limit_filter, _LIST_OF_ORDERS.format(_RANKED_ORDERS, "k <= 2 AND o_totalprice > 100000")),
    "map_outer_bound": (map_outer_bound, """
        SELECT c.c_custkey, coalesce(list({'c_custkey': d.c_custkey} ORDER BY d.c_acctbal, d.c_custkey) FILTER (WHERE d.k IS NOT NULL), []) AS x FROM customer c LEFT JOIN (
            SELECT a.c_custkey AS outer_key, b.c_custkey, b.c_acctbal, row_number() OVER (PARTITION BY a.c_custkey ORDER BY b.c_acctbal, b.c_custkey) AS k
            FROM customer a JOIN customer b ON b.c_nationkey = a.c_nationkey AND b.c_acctbal > a.c_acctbal WHERE a.c_nationkey = 3) d ON d.outer_key = c.c_custkey AND d.k <= 2
        WHERE c.c_nationkey = 3 GROUP BY c.c_custkey"""),
    "map_first": (map_first, f"SELECT c_custkey, CASE WHEN o_orderkey IS NULL THEN NULL ELSE {{'o_orderkey': o_orderkey}} END AS x FROM customer LEFT JOIN {_RANKED_ORDERS} ON o_custkey = c_custkey AND k = 1 WHERE c_nationkey = 3"),
    "insert_from_plan": (insert_from_plan, _AS_INT.format(_NATION + " UNION ALL SELECT r_regionkey + 500, r_name, r_regionkey FROM region")),
    "update_from_lookup": (update_from_lookup, _AS_INT.format("SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 1 THEN 9 ELSE n_regionkey END AS n_regionkey FROM nation")),
    "map_one": (map_one, "SELECT event_id, CASE WHEN c_custkey IS NULL THEN NULL ELSE {'c_name': c_name} END AS who FROM events LEFT JOIN customer ON c_custkey = user_id AND c_acctbal > 0 WHERE event_type = 'click'"),
}


def sql_query(text: str, params: tuple, full: bool) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: reader(spark, sf_dir, full).sql(text, *params)


def explain_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader(spark, sf_dir).sql("EXPLAIN " + FLAGSHIP)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {n: sql_query(t, p, full) for n, (t, p, full, _) in SQL.items()}
    out |= {n: (lambda spark, sf_dir, t=t: GraphQL(reader(spark, sf_dir)).frame(t)) for n, (t, _) in GRAPHQL.items()}
    out |= {n: change_query(t) for n, (t, _) in CHANGES.items()}
    out |= {n: change_query(t, "orders") for n, (t, _) in LARGE_CHANGES.items()}
    out |= {n: failed_change(t) for n, t in FAILED_CHANGES.items()}
    return out | {n: f for n, (f, _) in (PLANS | RULES).items()} | {"explain_flagship": explain_query}


def oracle_sql() -> dict[str, str]:
    out = {n: o or t for n, (t, _, _, o) in SQL.items()}
    out |= {n: o for d in (GRAPHQL, CHANGES, LARGE_CHANGES, PLANS, RULES) for n, (_, o) in d.items()}
    out |= {n: _AS_INT.format(_NATION) for n in FAILED_CHANGES}
    lines = ["Project [c.c_name, o.o_orderkey, o.o_totalprice]", "  Lookup orders o via by_cust key=[c.c_custkey] many reverse limit=5 cols=[o_orderkey, o_totalprice]", "    Get customer c via primary key=[7] cols=[c_custkey, c_name]"]
    return out | {"explain_flagship": "SELECT * FROM (VALUES " + ", ".join(f"('{x}')" for x in lines) + ") AS t(plan)"}
