"""The synthetic warehouse tables as a catalog, and tables over Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .catalog import Catalog, build

# name: columns | primary | secondary paths (name, partition, sort, unique)
_TABLES = {
    "region": ("r_regionkey int, r_name string", ("r_regionkey", ""), [("by_name", "r_name", "", True)]),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", ("n_nationkey", ""), [("by_name", "n_name", "", True), ("by_region", "n_regionkey", "n_name", False)]),
    "customer": ("c_custkey int, c_name string, c_nationkey int, c_acctbal float, c_mktsegment string", ("c_custkey", ""), [("by_name", "c_name", "", True), ("by_nation", "c_nationkey", "c_acctbal", False), ("by_segment", "c_mktsegment", "c_acctbal", False)]),
    "supplier": ("s_suppkey int, s_name string, s_nationkey int, s_acctbal float", ("s_suppkey", ""), [("by_name", "s_name", "", True), ("by_nation", "s_nationkey", "s_acctbal", False)]),
    "part": ("p_partkey int, p_name string, p_brand string, p_type string, p_size int, p_retailprice float", ("p_partkey", ""), [("by_brand", "p_brand", "p_size", False)]),
    "orders": ("o_orderkey int, o_custkey int, o_orderstatus string, o_totalprice float, o_orderdate timestamp, o_orderpriority string", ("o_orderkey", ""), [("by_cust", "o_custkey", "o_orderdate", False), ("by_status", "o_orderstatus", "o_orderdate", False), ("by_date", "", "o_orderdate", False)]),
    "lineitem": ("l_orderkey int, l_partkey int, l_suppkey int, l_linenumber int, l_quantity float, l_extendedprice float, l_discount float, l_tax float, l_returnflag string, l_linestatus string, l_shipdate timestamp", ("l_orderkey", "l_linenumber l_partkey l_suppkey l_shipdate"), [("by_part", "l_partkey", "l_shipdate", False), ("by_supp", "l_suppkey", "l_shipdate", False)]),
    "events": ("event_id int, ts timestamp, user_id int, event_type string, value float, props string", ("event_id", ""), [("by_user", "user_id", "ts", True), ("by_type", "event_type", "ts", False)]),
}
_RELATIONSHIPS = [
    ("nations", "region", "r_regionkey", "nation", "by_region", "one_to_many"),
    ("region", "nation", "n_regionkey", "region", "primary", "many_to_one"),
    ("customers", "nation", "n_nationkey", "customer", "by_nation", "one_to_many"),
    ("nation", "customer", "c_nationkey", "nation", "primary", "many_to_one"),
    ("orders", "customer", "c_custkey", "orders", "by_cust", "one_to_many"),
    ("events", "customer", "c_custkey", "events", "by_user", "one_to_many"),
    ("customer", "orders", "o_custkey", "customer", "primary", "many_to_one"),
    ("lines", "orders", "o_orderkey", "lineitem", "primary", "one_to_many"),
    ("order", "lineitem", "l_orderkey", "orders", "primary", "many_to_one"),
    ("part", "lineitem", "l_partkey", "part", "primary", "many_to_one"),
    ("supplier", "lineitem", "l_suppkey", "supplier", "primary", "many_to_one"),
]


def warehouse_catalog() -> Catalog:
    relations = [
        {
            "name": name,
            "columns": [dict(zip(("name", "type"), c.split())) for c in columns.split(", ")],
            "primary": {"partition": primary[0].split(), "sort": primary[1].split()},
            "paths": [{"name": n, "partition": p.split(), "sort": s.split(), "unique": u} for n, p, s, u in paths],
        }
        for name, (columns, primary, paths) in _TABLES.items()
    ]
    links = [dict(zip(("name", "from", "columns", "to", "path", "kind"), (n, f, [c], t, p, k))) for n, f, c, t, p, k in _RELATIONSHIPS]
    return build({"relations": relations, "relationships": links})


class ParquetTables:
    """Read-only tables, a Parquet file or folder each; Catalyst prunes and pushes down into the scans."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._frames: dict[str, DataFrame] = {}

    def frame(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self._frames[name]
