"""Scans, catalog queries, copies and document output."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import TABLES, query, run_sql, sql_query, table

BUSINESS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def union(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


@query("scan_all", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_all(spark, sf):
    return table(spark, sf, "nation")


@query("table_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS n FROM {t}" for t in BUSINESS))
def table_row_counts(spark, sf):
    return union([table(spark, sf, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n") for t in BUSINESS])


#: What the model expects of the tables: name and columns.
EXPECTED = {"customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], "inventory": ["product_id", "quantity"]}


def describe(spark, sf_dir: str, tables) -> DataFrame:
    """table_name, column_name, ordinal and data_type, from the files' schemas: no data is read."""
    rows = [(t, f.name, i + 1, f.dataType.simpleString()) for t in tables for i, f in enumerate(table(spark, sf_dir, t).schema)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal long, data_type string")


@query("catalog_tables", " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, CAST(row_number() OVER () AS BIGINT) AS ordinal FROM (DESCRIBE {t})" for t in BUSINESS))
def catalog_tables(spark, sf):
    return describe(spark, sf, BUSINESS).drop("data_type")


@query("validate_schema", "WITH want(t, c) AS (VALUES " + ", ".join(f"('{t}', '{c}')" for t, cs in EXPECTED.items() for c in cs) + "), have AS (" + " UNION ALL ".join(f"SELECT '{t}' AS t, column_name AS c FROM (DESCRIBE {t})" for t in EXPECTED if t in TABLES)
       + ") SELECT w.t AS table_name, count(h.c) > 0 AS present, CAST(count(*) FILTER (h.c IS NULL) AS BIGINT) AS missing_columns FROM want w LEFT JOIN have h ON h.t = w.t AND h.c = w.c GROUP BY w.t")
def validate_schema(spark, sf):
    """Which expected tables and columns are there."""
    want = spark.createDataFrame([(t, c) for t, cs in EXPECTED.items() for c in cs], "table_name string, column_name string")
    have = describe(spark, sf, [t for t in EXPECTED if t in TABLES]).withColumn("there", F.lit(True))
    joined = want.join(have, ["table_name", "column_name"], "left")
    return joined.groupBy("table_name").agg(F.count_if(F.col("there").isNotNull()).alias("n"), F.count_if(F.col("there").isNull()).alias("missing_columns")).select("table_name", (F.col("n") > 0).alias("present"), "missing_columns")


def select(df: DataFrame, columns: list[str] | None = None, where: dict | None = None, order_by: list[str] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A query from parts: equality and null predicates, order, page."""
    for c, v in (where or {}).items():
        df = df.where(F.col(c).isNull() if v is None else F.col(c) == v)
    if order_by:
        df = df.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order_by])
    if offset:
        df = df.offset(offset)
    if limit is not None:
        df = df.limit(limit)
    return df.select(*columns) if columns else df


@query("builder_select", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH'")
def builder_select(spark, sf):
    return select(table(spark, sf, "orders"), ["o_orderkey", "o_totalprice"], {"o_orderstatus": "O", "o_orderpriority": "2-HIGH"})


sql_query("batch_values", "SELECT id, name, coalesce(price, 9.5D) AS price, coalesce(active, true) AS active FROM VALUES (1, 'a', 1.5D, true), (2, 'b', NULL, false), (3, 'c', 2.5D, NULL) AS v(id, name, price, active)",
          "SELECT id, name, coalesce(price, 9.5)::DOUBLE AS price, coalesce(active, true) AS active FROM (VALUES (1, 'a', 1.5, true), (2, 'b', NULL, false), (3, 'c', 2.5, NULL)) v(id, name, price, active)")


def copy_table(source: DataFrame, path: str, mode: str = "overwrite", drop_empty: bool = True) -> DataFrame:
    """Copies a table as Parquet; columns that are null in every row are left out, as a row-wise copy skips them."""
    if drop_empty:
        filled = source.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in source.columns]).first()
        source = source.select(*[c for c in source.columns if filled is None or filled[c] is not False])
    source.write.mode(mode).parquet(path)
    return source.sparkSession.read.parquet(path)


@query("for_xml_path", "SELECT r_name, '<nations>' || string_agg('<nation><id>' || n_nationkey || '</id><name>' || n_name || '</name></nation>', '' ORDER BY n_nationkey) || '</nations>' AS xml FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def for_xml_path(spark, sf):
    """FOR XML PATH('nation'), ROOT('nations'): elements by column, text escaped."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    element = F.concat(F.lit("<nation><id>"), F.col("n_nationkey").cast("string"), F.lit("</id><name>"), escape(F.col("n_name")), F.lit("</name></nation>"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", element.alias("e")))), lambda s: s["e"])
    return nation.groupBy("r_name").agg(F.concat(F.lit("<nations>"), F.array_join(rows, ""), F.lit("</nations>")).alias("xml"))


@query("for_json_path", """SELECT c_custkey, '{"id":' || c_custkey || ',"place":{"nation":"' || n_name || '","region":"' || r_name || '"}}' AS doc FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def for_json_path(spark, sf):
    """FOR JSON PATH: dotted aliases become nested objects."""
    df = run_sql(spark, sf, "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
    return df.select("c_custkey", F.to_json(F.struct(F.col("c_custkey").alias("id"), F.struct(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).alias("place"))).alias("doc"))


def read_csv(spark, path: str, schema: str, sep: str = ",", header: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """BULK INSERT: a delimited file with a given schema; nothing is inferred."""
    return spark.read.csv(path, schema=schema, sep=sep, header=header, encoding=encoding)


def read_jdbc(spark, url: str, dbtable: str, column: str, lower: int, upper: int, parts: int, **options) -> DataFrame:
    """A table of another database, read in parts by a numeric column."""
    return spark.read.format("jdbc").options(url=url, dbtable=dbtable, partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=parts, **options).load()


@query("pivot_dynamic", "SELECT region, CAST(count(*) FILTER (segment = 'AUTOMOBILE') AS BIGINT) AS AUTOMOBILE, CAST(count(*) FILTER (segment = 'BUILDING') AS BIGINT) AS BUILDING, CAST(count(*) FILTER (segment = 'FURNITURE') AS BIGINT) AS FURNITURE, CAST(count(*) FILTER (segment = 'HOUSEHOLD') AS BIGINT) AS HOUSEHOLD, CAST(count(*) FILTER (segment = 'MACHINERY') AS BIGINT) AS MACHINERY FROM cust GROUP BY region")
def pivot_dynamic(spark, sf):
    """The columns come from the data, in order."""
    return run_sql(spark, sf, "SELECT region, segment FROM cust").groupBy("region").pivot("segment").count().na.fill(0)
