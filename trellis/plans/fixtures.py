"""Relations over the star-schema tables, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from ..sources.relation import Relation

_GEO = "JOIN nation ON {key}=n_nationkey JOIN region ON n_regionkey=r_regionkey"
RELATIONS: dict[str, tuple[list[str], str]] = {
    "nation_region": (["n_nationkey", "n_name", "n_regionkey", "r_name"], "SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey=r_regionkey"),
    "supp_geo": (["s_suppkey", "s_nationkey", "n_name", "n_regionkey", "r_name"], f"SELECT s_suppkey, s_nationkey, n_name, n_regionkey, r_name FROM supplier {_GEO.format(key='s_nationkey')}"),
    "cust_geo": (["c_mktsegment", "c_nationkey", "n_name", "n_regionkey", "r_name"], f"SELECT c_mktsegment, c_nationkey, n_name, n_regionkey, r_name FROM customer {_GEO.format(key='c_nationkey')}"),
    "orders_dim": (["o_orderstatus", "o_orderpriority", "y", "m", "qt"], "SELECT o_orderstatus, o_orderpriority, year(o_orderdate) AS y, month(o_orderdate) AS m, quarter(o_orderdate) AS qt FROM orders"),
    "part_dim": (["p_brand", "p_type", "p_size", "p_retailprice"], "SELECT p_brand, p_type, p_size, p_retailprice FROM part"),
    "line_flags": (["l_returnflag", "l_linestatus", "l_linenumber", "qty", "l_discount", "l_tax"], "SELECT l_returnflag, l_linestatus, l_linenumber, CAST(l_quantity AS INT) AS qty, l_discount, l_tax FROM lineitem"),
}
#: Cluster sets (masks) to judge.
DECOMPOSITIONS: dict[str, tuple[str, list[int]]] = {
    "supp_geo": ("supp_geo", [0b00011, 0b01110, 0b11000]),
    "cust_geo": ("cust_geo", [0b00011, 0b01110, 0b11000]),
    "orders_exact": ("orders_dim", [0b01111, 0b11000]),
    "orders_lossy": ("orders_dim", [0b01010, 0b01001, 0b01100, 0b11000]),
    "line_cyclic": ("line_flags", [0b000011, 0b000110, 0b000101, 0b110000, 0b111000]),
}


#: Relations of the query that ran last; the next one gives back what they kept in memory.
_LAST: list[Relation] = []


def release() -> None:
    while _LAST:
        _LAST.pop().release()


def relation(spark: SparkSession, sf_dir: str, name: str) -> Relation:
    columns, sql = RELATIONS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in re.findall(r"(?:FROM|JOIN) (\w+)", sql)}
    marked = re.sub(r"(FROM|JOIN) (\w+)", r"\1 {\2}", sql)
    _LAST.append(Relation.of(spark.sql(marked, **tables), columns, name))
    return _LAST[-1]


def arity(name: str) -> int:
    return len(RELATIONS[name][0])
