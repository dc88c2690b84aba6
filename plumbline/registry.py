"""Where queries and their oracle SQL are registered."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
class Once(dict):
    """A name is registered once."""

    def __setitem__(self, name: str, value) -> None:
        if name in self:
            raise ValueError(f"{name} is registered twice")
        super().__setitem__(name, value)


QUERIES: dict[str, Query] = Once()
ORACLES: dict[str, str] = {}

#: The business model over the driver's tables, in SQL that both engines read: a tier by balance, P as the cancelled status.
MODEL = {
    "cust": """SELECT c.c_custkey AS customer_id, c.c_name AS full_name, c.c_mktsegment AS segment, r.r_name AS region, n.n_name AS nation, c.c_acctbal AS credit_limit,
      CASE WHEN c.c_acctbal >= 7500 THEN 'A' WHEN c.c_acctbal >= 5000 THEN 'B' WHEN c.c_acctbal >= 2500 THEN 'C' ELSE 'D' END AS tier
      FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "ord": "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date, o_orderstatus AS status, o_totalprice AS amount, o_orderpriority AS priority FROM orders",
    "item": "SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product_id, l_suppkey AS supplier_id, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_shipdate AS ship_date, l_returnflag AS flag FROM lineitem",
    "prod": "SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS category, p_type AS kind, p_size AS min_stock, p_retailprice AS unit_price FROM part",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_model(sql: str) -> str:
    """sql with the model's tables that it names put in front as common table expressions."""
    used = [n for n in MODEL if re.search(rf"\b(FROM|JOIN)\s+{n}\b", sql, re.I)]
    if not used:
        return sql
    ctes = ",\n".join(f"{n} AS ({MODEL[n]})" for n in used)
    if m := re.match(r"\s*WITH(\s+RECURSIVE)?\s", sql, re.I):
        return f"WITH{m[1] or ''} {ctes},\n{sql[m.end():]}"
    return f"WITH {ctes}\n{sql}"


def exact(x: str) -> str:
    """SQL of a double as the decimal that it is written as; null where 18 digits before the point and 10 behind it do not hold it."""
    return f"try_cast({x} AS DECIMAL(28,10))"


def exact_sum(x: str) -> str:
    """SQL of the sum of doubles, rounded once at its end, so that the order of rows does not change it.

    A group with a value that exact() does not hold as it is has the plain sum.
    """
    return f"CASE WHEN bool_and(coalesce(CAST({exact(x)} AS DOUBLE) = {x}, {x} IS NULL)) THEN CAST(sum({exact(x)}) AS DOUBLE) ELSE sum({x}) END"


def views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Temporary views of the tables that sql names."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            table(spark, sf_dir, name).createOrReplaceTempView(name)


def run_sql(spark: SparkSession, sf_dir: str, sql: str, **options) -> DataFrame:
    text = with_model(sql)
    views(spark, sf_dir, text)
    return spark.sql(text, **options)


def sql_query(name: str, sql: str, oracle: str | None = None) -> None:
    """Registers a query given as Spark SQL; oracle: the DuckDB form, where it differs."""
    QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, sql)
    ORACLES[name] = with_model(oracle or sql)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (spark, sf_dir) -> DataFrame; oracle: its DuckDB SQL, if there is one."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = with_model(oracle)
        return f

    return add
