"""Global ranks without a single-task sort, and pages with their total."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import query, run_sql


def global_rank(df: DataFrame, key: str, ties: list[str], descending: bool = False, buckets: int = 64, name: str = "rank") -> DataFrame:
    """df with each row's place (from 1) by a numeric key and then the tie-breakers.

    Rows fall into buckets between approximate quantiles of the key, a function of the value alone. Exact counts of the
    buckets before it plus the row number within its bucket are a row's rank. Nulls come last.
    """
    cuts = sorted(set(df.approxQuantile(key, [i / buckets for i in range(1, buckets)], 0.01)))  # at most buckets numbers
    sign = -1 if descending else 1
    bounds = F.array(*[F.lit(sign * c) for c in cuts]) if cuts else F.expr("cast(array() as array<double>)")
    bucket = F.when(F.col(key).isNull(), F.lit(len(cuts) + 1)).otherwise(F.size(F.filter(bounds, lambda b: b < sign * F.col(key).cast("double"))))
    placed = df.withColumn("_bucket", bucket)
    per = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = per.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row a bucket
    order = F.desc_nulls_last(key) if descending else F.asc_nulls_last(key)
    nth = F.row_number().over(Window.partitionBy("_bucket").orderBy(order, *ties))
    return placed.withColumn("_nth", nth).join(F.broadcast(before), "_bucket").withColumn(name, F.col("_before") + F.col("_nth")).drop("_bucket", "_before", "_nth")


def top_percent(df: DataFrame, percent: float, key: str, ties: list[str]) -> DataFrame:
    """The first percent of the rows by descending key, rounded up."""
    n = math.ceil(df.count() * percent / 100)
    return global_rank(df, key, ties, descending=True, name="_rank").where(F.col("_rank") <= n).drop("_rank")


def page(df: DataFrame, order: list, number: int, size: int, total: str = "total") -> DataFrame:
    """One page with the count of all rows: the count is one aggregate, the page a top-k that keeps number * size rows a task."""
    count = df.agg(F.count(F.lit(1)).alias(total))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(count))


@query("top_percent", "SELECT order_id, amount FROM (SELECT order_id, amount, row_number() OVER (ORDER BY amount DESC, order_id) AS nth, count(*) OVER () AS n FROM ord) x WHERE nth <= ceil(n * 0.05)")
def top_percent_query(spark, sf):
    return top_percent(run_sql(spark, sf, "SELECT order_id, amount FROM ord"), 5, "amount", ["order_id"])


@query("page_with_total", "SELECT order_id, amount, CAST(count(*) OVER () AS BIGINT) AS total_rows FROM ord ORDER BY amount DESC, order_id LIMIT 20 OFFSET 40")
def page_with_total(spark, sf):
    return page(run_sql(spark, sf, "SELECT order_id, amount FROM ord"), [F.desc("amount"), "order_id"], 3, 20, "total_rows")


@query("repo_list_page", "SELECT customer_id, full_name, CAST(count(*) OVER () AS BIGINT) AS total FROM cust ORDER BY customer_id LIMIT 25 OFFSET 50")
def repo_list_page(spark, sf):
    return page(run_sql(spark, sf, "SELECT customer_id, full_name FROM cust"), ["customer_id"], 3, 25)


@query("global_rank", "SELECT order_id, row_number() OVER (ORDER BY amount, order_id) AS place FROM ord")
def global_rank_query(spark, sf):
    return global_rank(run_sql(spark, sf, "SELECT order_id, amount FROM ord"), "amount", ["order_id"], name="place").select("order_id", "place")


def global_ntile(df: DataFrame, tiles: int, key: str, ties: list[str], descending: bool = False, name: str = "tile") -> DataFrame:
    """df with the tile (from 1) of each row under a global order: from its rank and the count of rows, the first tiles one larger where it does not divide."""
    n = df.agg(F.count(F.lit(1)).alias("_all"))
    ranked = global_rank(df, key, ties, descending, name="_rank").crossJoin(F.broadcast(n))  # n is one row
    q, rest, r = F.floor(F.col("_all") / tiles), F.col("_all") % tiles, F.col("_rank")
    tile = F.when(r <= rest * (q + 1), F.ceil(r / (q + 1))).otherwise(rest + F.ceil((r - rest * (q + 1)) / q))
    return ranked.withColumn(name, tile.cast("bigint")).drop("_rank", "_all")


@query("win_over_agg", "SELECT customer_id, CAST(ntile(4) OVER (ORDER BY round(sum(amount), 2) DESC, customer_id) AS BIGINT) AS spend_quartile FROM ord GROUP BY customer_id")
def win_over_agg(spark, sf):
    """NTILE over an aggregate, without a window over all rows."""
    spent = run_sql(spark, sf, "SELECT customer_id, round(sum(amount), 2) AS spent FROM ord GROUP BY customer_id")
    return global_ntile(spent, 4, "spent", ["customer_id"], descending=True, name="spend_quartile").select("customer_id", "spend_quartile")
