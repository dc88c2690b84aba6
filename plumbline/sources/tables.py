"""Tables that are made, filled, emptied and copied: DDL from a model, seeds, explicit keys, results of procedures."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.procedures import Procedure, parse, rows_of
from ..registry import query, run_sql, table, views
from ..storage import new_path, table_name
from .queries import copy_table, union

#: A model's types in Spark.
TYPES = {"int": "INT", "bigint": "BIGINT", "numeric": "DECIMAL", "varchar": "STRING", "nvarchar": "STRING", "bool": "BOOLEAN", "datetime": "TIMESTAMP_NTZ", "float": "DOUBLE", "char": "STRING", "text": "STRING"}


@dataclass
class Field:
    name: str
    kind: str
    null: bool = True
    default: str | None = None


@dataclass
class Model:
    """A table's description. Spark's Parquet tables hold no keys; those become table properties, and ``orphans`` and ``repeats`` check them."""

    name: str
    fields: list[Field]
    key: list[str]
    unique: list[list[str]] = field(default_factory=list)
    #: column, table and column that it refers to
    foreign: list[tuple[str, str, str]] = field(default_factory=list)


def spark_type(kind: str) -> str:
    name, _, size = kind.partition("(")
    out = TYPES[name.strip().lower()]
    return f"{out}({size}" if out == "DECIMAL" and size else out


def ddl(model: Model, name: str | None = None) -> str:
    """CREATE TABLE of a model; its keys as properties."""
    columns = [f"{f.name} {spark_type(f.kind)}{'' if f.null else ' NOT NULL'}{f' DEFAULT {f.default}' if f.default else ''}" for f in model.fields]
    keys = {"key": ",".join(model.key), "unique": ";".join(",".join(u) for u in model.unique), "foreign": ";".join(f"{c}>{t}.{k}" for c, t, k in model.foreign)}
    properties = ", ".join(f"'model.{k}' = '{v}'" for k, v in keys.items() if v)
    return f"CREATE TABLE {name or model.name} ({', '.join(columns)}) USING parquet" + (f" TBLPROPERTIES ({properties})" if properties else "")


def in_order(models: list[Model]) -> list[Model]:
    """Models so that each comes after those that it refers to."""
    out: list[Model] = []
    left = list(models)
    while left:
        ready = [m for m in left if all(t == m.name or t not in {x.name for x in left} for _, t, _ in m.foreign)]
        if not ready:
            raise ValueError("foreign keys in a circle: " + ", ".join(m.name for m in left))
        out += ready
        left = [m for m in left if m not in ready]
    return out


def repeats(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).count().where("count > 1")


def orphans(df: DataFrame, column: str, other: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).join(other.select(F.col(key).alias(column)).distinct(), column, "left_anti")


CUSTOMERS = Model("customers", [Field("id", "bigint", False), Field("code", "varchar(20)", False), Field("name", "nvarchar(200)", False), Field("is_active", "bool", True, "true"), Field("balance", "numeric(12,2)")], ["id"], [["code"]])
ORDERS = Model("orders_made", [Field("id", "bigint", False), Field("customer_id", "bigint"), Field("status", "varchar(20)", True, "'PENDING'"), Field("total_amount", "numeric(12,2)")], ["id"], [], [("customer_id", "customers", "id")])


def seed(spark: SparkSession, rows: dict[str, DataFrame], models: list[Model], names: dict[str, str]) -> None:
    """Makes the tables of models anew under these names, with rows as they are, explicit ids included. Those that others refer to come first, and go last."""
    ordered = in_order(models)
    for m in reversed(ordered):
        spark.sql(f"DROP TABLE IF EXISTS {names[m.name]}")
    for m in ordered:
        spark.sql(ddl(m, names[m.name]))
        given = rows[m.name]
        columns = [F.col(f.name) if f.name in given.columns else F.expr(f.default or "NULL").alias(f.name) for f in m.fields]
        given.select(*[c.cast(spark_type(f.kind)).alias(f.name) for c, f in zip(columns, m.fields)]).write.insertInto(names[m.name])


def _seeded(spark, sf: str, names: dict[str, str]) -> None:
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("C"), "c_custkey").alias("code"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").alias("total_amount"))
    seed(spark, {"customers": customers, "orders_made": orders}, [ORDERS, CUSTOMERS], names)


@query("seed_reset", "SELECT CAST(o.o_custkey % 10 AS BIGINT) AS bucket, 'PENDING' AS status, true AS is_active, CAST(count(*) AS BIGINT) AS orders, CAST(count(DISTINCT c_custkey) AS BIGINT) AS customers, CAST(sum(CAST(o_totalprice AS DECIMAL(12, 2))) AS DECIMAL(22, 2)) AS total FROM orders o JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def seed_reset(spark, sf):
    """Tables from models, filled with explicit ids and defaults, emptied, and filled again."""
    names = {m.name: table_name(spark, m.name) for m in (ORDERS, CUSTOMERS)}
    _seeded(spark, sf, names)
    _seeded(spark, sf, names)
    joined = spark.table(names["orders_made"]).alias("o").join(spark.table(names["customers"]).alias("c"), F.col("o.customer_id") == F.col("c.id"))
    return joined.groupBy((F.col("customer_id") % 10).alias("bucket"), F.col("o.status").alias("status"), "is_active").agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("customer_id").alias("customers"), F.sum("total_amount").alias("total"))


@query("table_truncate", "SELECT 'before' AS moment, CAST(count(*) AS BIGINT) AS n FROM nation UNION ALL SELECT 'after', CAST(0 AS BIGINT) UNION ALL SELECT 'refilled', CAST(count(*) AS BIGINT) FROM nation WHERE n_nationkey > 20")
def table_truncate(spark, sf):
    """TRUNCATE, and explicit keys put in afterwards as IDENTITY_INSERT allows."""
    name = table_name(spark, "nation")
    table(spark, sf, "nation").write.format("parquet").saveAsTable(name)
    count = lambda moment: spark.table(name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(moment).alias("moment"), "n").collect()
    seen = count("before")
    spark.sql(f"TRUNCATE TABLE {name}")
    seen += count("after")
    table(spark, sf, "nation").where("n_nationkey > 20").write.insertInto(name)
    return spark.createDataFrame([*seen, *count("refilled")], "moment string, n long")


def insert_exec(spark: SparkSession, target: str, procedure: Procedure, values: dict[str, str] | None = None) -> None:
    """INSERT ... EXEC: the procedure's result, written to the table by position."""
    with rows_of(spark, procedure, values) as rows:
        rows.write.insertInto(target)


@query("insert_exec", "SELECT o_orderstatus AS status, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus UNION ALL SELECT o_orderstatus, CAST(count(*) AS BIGINT) FROM orders WHERE o_totalprice > 300000 GROUP BY o_orderstatus")
def insert_exec_query(spark, sf):
    name = table_name(spark, "report")
    spark.sql(f"CREATE TABLE {name} (status STRING, n BIGINT) USING parquet")
    report = parse("CREATE PROCEDURE StatusReport @low FLOAT AS BEGIN SELECT o_orderstatus, COUNT(*) AS n FROM dbo.orders WHERE o_totalprice > @low GROUP BY o_orderstatus; END")
    views(spark, sf, "orders")
    for low in ("100000D", "300000D"):
        insert_exec(spark, name, report, {"low": low})
    return spark.table(name)


def object_id(spark: SparkSession, name: str) -> int | None:
    """A number that stands for a table or view, null if there is none: OBJECT_ID('dbo.t') IS NULL asks whether it exists."""
    plain = name.replace("[", "").replace("]", "").removeprefix("dbo.")
    return zlib.crc32(plain.lower().encode()) if spark.catalog.tableExists(plain) else None


@query("object_exists", "SELECT 'region' AS name, true AS there, 'default' AS db UNION ALL SELECT 'no_such_table', false, 'default'")
def object_exists(spark, sf):
    """OBJECT_ID and DB_NAME."""
    views(spark, sf, "region")
    rows = [(n, object_id(spark, f"dbo.[{n}]") is not None) for n in ("region", "no_such_table")]
    return spark.createDataFrame(rows, "name string, there boolean").withColumn("db", F.current_database())


@query("migrate_copy", """SELECT 'customer' AS table_name, CAST(count(*) AS BIGINT) AS source_rows, CAST(count(*) AS BIGINT) AS target_rows, CAST(0 AS BIGINT) AS only_source, CAST(0 AS BIGINT) AS only_target, true AS ok FROM customer
 UNION ALL SELECT 'nation', CAST(count(*) AS BIGINT), CAST(count(*) AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), true FROM nation
 UNION ALL SELECT 'region', CAST(count(*) AS BIGINT), CAST(count(*) FILTER (r_regionkey <> 3) AS BIGINT), CAST(count(*) FILTER (r_regionkey = 3) AS BIGINT), CAST(0 AS BIGINT), false FROM region""")
def migrate_copy(spark, sf):
    """Tables copied in the order of their keys, and each copy compared with its source as multisets; the copy of region lacks a row on purpose."""
    from ..operators.diff import strict

    parts = []
    for t in ("region", "nation", "customer"):
        source = table(spark, sf, t)
        given = source.where("r_regionkey <> 3") if t == "region" else source
        target = copy_table(given, new_path(spark, f"copy-{t}"), drop_empty=False)
        counts = source.agg(F.count(F.lit(1)).alias("source_rows")).crossJoin(target.agg(F.count(F.lit(1)).alias("target_rows")))
        both = strict(source, target)
        parts.append(counts.crossJoin(both).select(F.lit(t).alias("table_name"), "source_rows", "target_rows", "only_source", "only_target", F.col("equal").alias("ok")))
    return union(parts)


@query("select_into", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING'")
def select_into(spark, sf):
    """SELECT ... INTO: a new table from a query."""
    name = table_name(spark, "chosen")
    views(spark, sf, "customer")
    spark.sql(f"CREATE TABLE {name} USING parquet AS SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING'")
    return spark.table(name)


@query("insert_select", "SELECT region, CAST(count(*) AS BIGINT) AS customers, round(sum(credit_limit), 2) AS credit FROM cust GROUP BY region")
def insert_select(spark, sf):
    """INSERT ... SELECT into a summary table that is there."""
    name = table_name(spark, "summary")
    spark.sql(f"CREATE TABLE {name} (region STRING, customers BIGINT, credit DOUBLE) USING parquet")
    run_sql(spark, sf, "SELECT region, CAST(count(*) AS BIGINT) AS customers, round(sum(credit_limit), 2) AS credit FROM cust GROUP BY region").write.insertInto(name)
    return spark.table(name)
