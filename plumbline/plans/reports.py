"""Reports, views, table functions and procedures of the business model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import MODEL, query, run_sql, sql_query, table
from ..storage import saved

# --- reports ---


@query("report_sales", """SELECT c.c_mktsegment AS segment, CAST(count(DISTINCT o.o_orderkey) AS BIGINT) AS order_count, sum(l.l_quantity) AS total_quantity, round(sum(l.l_quantity * l.l_extendedprice), 2) AS total_sales
 FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus <> 'P' AND o.o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o.o_orderdate < TIMESTAMP '2000-01-01 00:00:00' GROUP BY c.c_mktsegment""")
def report_sales(spark, sf):
    """Orders, items and sales by segment between two dates.

    Lines are summed per order before the joins: the count of orders is then a plain count, and each join moves a
    row an order.
    """
    day = lambda s: F.expr(f"TIMESTAMP_NTZ '{s} 00:00:00'")
    orders = table(spark, sf, "orders").where((F.col("o_orderstatus") != "P") & (F.col("o_orderdate") >= day("1996-01-01")) & (F.col("o_orderdate") < day("2000-01-01"))).select("o_orderkey", "o_custkey")
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.sum(F.col("l_quantity") * F.col("l_extendedprice")).alias("s"))
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("order_count"), F.sum("q").alias("total_quantity"), F.round(F.sum("s"), 2).alias("total_sales"))


#: Stock of a part: what its size says less what was returned, by the brand as warehouse.
STOCK = "SELECT p.p_partkey AS product_id, p.p_name AS product_name, p.p_brand AS warehouse, CAST(p.p_size AS BIGINT) AS min_quantity, coalesce(l.q, 0) AS quantity FROM part p LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey) l ON p.p_partkey = l.l_partkey"
sql_query("report_inventory", f"SELECT warehouse, CAST(count(DISTINCT product_id) AS BIGINT) AS products, sum(quantity) AS total, round(avg(quantity), 6) AS average, min(quantity) AS lo, max(quantity) AS hi FROM ({STOCK}) s GROUP BY warehouse")
sql_query("report_customer_orders", "SELECT c.customer_id, c.full_name, CAST(count(o.order_id) AS BIGINT) AS order_count, round(coalesce(sum(o.amount), 0), 2) AS total_spent, max(o.order_date) AS last_order FROM cust c LEFT JOIN ord o ON c.customer_id = o.customer_id GROUP BY c.customer_id, c.full_name")
sql_query("customer_order_report", "SELECT c.customer_id, round(coalesce(sum(CASE WHEN o.status = 'P' THEN o.amount END), 0), 2) AS cancelled_total, coalesce(max(CASE WHEN o.status = 'P' THEN o.priority END), 'none') AS cancelled_priority FROM cust c LEFT JOIN ord o ON c.customer_id = o.customer_id GROUP BY c.customer_id")
sql_query("report_low_stock", f"SELECT product_id, product_name, quantity, min_quantity, min_quantity - quantity AS shortage FROM ({STOCK}) s WHERE quantity < min_quantity")
sql_query("orders_by_customer", "SELECT c.customer_id, o.order_id, o.order_date, o.status, o.amount FROM cust c JOIN ord o ON c.customer_id = o.customer_id WHERE c.tier = 'A'")
sql_query("find_by_customer", "SELECT order_id, order_date, status FROM ord WHERE customer_id = 42 ORDER BY order_date DESC, order_id")
sql_query("showcase_case_tier", "SELECT tier, CAST(count(*) AS BIGINT) AS n, round(avg(total), 6) AS avg_total FROM (SELECT customer_id, sum(amount) AS total, CASE WHEN sum(amount) >= 3000000 THEN 'platinum' WHEN sum(amount) >= 2000000 THEN 'gold' WHEN sum(amount) >= 1000000 THEN 'silver' ELSE 'basic' END AS tier FROM ord GROUP BY customer_id) s GROUP BY tier")


def stock_query(stock: DataFrame, warehouse: str | None = None, name_part: str | None = None, low_only: bool = False, product_id: int | None = None, cap: int | None = None) -> DataFrame:
    """Stock with the filters that are given; without one, at most cap rows if that is set."""
    out, free = stock, True
    for given, condition in ((warehouse, F.col("warehouse") == warehouse), (name_part, F.contains("product_name", F.lit(name_part or ""))), (product_id, F.col("product_id") == product_id)):
        if given is not None:
            out, free = out.where(condition), False
    if low_only:
        out, free = out.where("quantity < min_quantity"), False
    return out.orderBy("product_id").limit(cap) if free and cap else out


@query("dynamic_stock_query", f"SELECT product_id, product_name, quantity FROM ({STOCK}) s WHERE warehouse = 'Brand#4' AND product_name LIKE '%blue%' UNION ALL SELECT product_id, product_name, quantity FROM ({STOCK}) s WHERE quantity < min_quantity AND product_name LIKE '%ring%'")
def dynamic_stock_query(spark, sf):
    stock = run_sql(spark, sf, STOCK)
    return stock_query(stock, "Brand#4", "blue").unionByName(stock_query(stock, name_part="ring", low_only=True)).select("product_id", "product_name", "quantity")


@query("param_query", "SELECT order_id, amount FROM ord WHERE status = 'O' AND amount > 450000 AND order_date >= TIMESTAMP '1997-01-01 00:00:00'")
def param_query(spark, sf):
    return run_sql(spark, sf, "SELECT order_id, amount FROM ord WHERE status = :s AND amount > :low AND order_date >= CAST(:since AS TIMESTAMP_NTZ)", args={"s": "O", "low": 450000, "since": "1997-01-01"})


@query("dynamic_sql", "SELECT status, CAST(count(*) AS BIGINT) AS n FROM ord WHERE amount > 250000 GROUP BY status")
def dynamic_sql(spark, sf):
    """A statement put together from checked names, its values passed as parameters."""
    column = {"status": "status", "priority": "priority"}["status"]
    return run_sql(spark, sf, f"SELECT {column}, count(*) AS n FROM ord WHERE amount > ? GROUP BY {column}", args=[250000])


# --- views ---
sql_query("view_order_summary", "SELECT o.order_id, c.full_name, c.region, o.status, o.amount, coalesce(i.lines, 0) AS item_count, coalesce(i.q, 0) AS total_quantity FROM ord o JOIN cust c ON o.customer_id = c.customer_id LEFT JOIN (SELECT order_id, CAST(count(*) AS BIGINT) AS lines, sum(quantity) AS q FROM item GROUP BY order_id) i ON i.order_id = o.order_id")
sql_query("view_sales_by_region", "SELECT c.region, CAST(count(DISTINCT c.customer_id) AS BIGINT) AS customers, CAST(count(*) AS BIGINT) AS orders, round(sum(o.amount), 2) AS sales, round(avg(o.amount), 6) AS avg_order FROM cust c JOIN ord o ON c.customer_id = o.customer_id WHERE o.status NOT IN ('P') GROUP BY c.region")
sql_query("view_product_sales", "SELECT p.product_id, p.category, coalesce(sum(i.quantity), 0) AS sold, CAST(count(DISTINCT i.order_id) AS BIGINT) AS orders, round(coalesce(sum(i.price * (1 - i.discount)), 0), 5) AS revenue FROM prod p LEFT JOIN item i ON p.product_id = i.product_id GROUP BY p.product_id, p.category")
sql_query("view_customer_summary", "SELECT c.customer_id, c.tier, CAST(count(o.order_id) AS BIGINT) AS orders, round(coalesce(sum(o.amount), 0), 2) AS spent, min(o.order_date) AS first_order, max(o.order_date) AS last_order, CASE WHEN count(o.order_id) = 0 THEN 'none' WHEN coalesce(sum(o.amount), 0) > 2500000 THEN 'vip' ELSE 'normal' END AS level FROM cust c LEFT JOIN ord o ON c.customer_id = o.customer_id AND o.status NOT IN ('P') GROUP BY c.customer_id, c.tier")
sql_query("view_daily_sales", "SELECT CAST(order_date AS DATE) AS day, CAST(count(*) AS BIGINT) AS orders, CAST(count(DISTINCT customer_id) AS BIGINT) AS customers, round(sum(amount), 2) AS sales FROM ord WHERE status NOT IN ('P') GROUP BY CAST(order_date AS DATE)")
sql_query("view_inventory_status", f"SELECT product_id, quantity, CASE WHEN quantity = 0 THEN 'out' WHEN quantity < min_quantity THEN 'low' WHEN quantity > 5 * min_quantity THEN 'over' ELSE 'ok' END AS stock_status FROM ({STOCK}) s")


@query("view_materialized", "SELECT status, CAST(count(*) AS BIGINT) AS n, round(sum(amount), 2) AS total FROM ord GROUP BY status")
def view_materialized(spark, sf):
    """An indexed view: the aggregate written once, and read as a table from then on."""
    return saved(run_sql(spark, sf, "SELECT status, count(*) AS n, round(sum(amount), 2) AS total FROM ord GROUP BY status"), "view")


sql_query("computed_margin", "SELECT order_id, line_no, round(quantity * price, 3) AS subtotal, round(quantity * price * discount, 5) AS rebate, CASE WHEN discount > 0.05 THEN 'promo' ELSE 'list' END AS price_kind FROM item")

# --- scalar and table functions in SQL ---
SCALARS = {
    "status_label": ("s STRING", "STRING", "CASE s WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' WHEN 'P' THEN 'cancelled' ELSE 'unknown' END"),
    "discount_rate": ("amount DOUBLE", "DOUBLE", "CASE WHEN amount >= 300000 THEN 0.15D WHEN amount >= 150000 THEN 0.1D WHEN amount >= 50000 THEN 0.05D ELSE 0D END"),
}


def define_scalars(spark) -> None:
    for name, (args, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")


@query("udf_status", "SELECT order_id, CASE status WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' WHEN 'P' THEN 'cancelled' ELSE 'unknown' END AS label FROM ord")
def udf_status(spark, sf):
    define_scalars(spark)
    return run_sql(spark, sf, "SELECT order_id, status_label(status) AS label FROM ord")


@query("udf_discount", "SELECT order_id, CAST(CASE WHEN amount >= 300000 THEN 0.15 WHEN amount >= 150000 THEN 0.1 WHEN amount >= 50000 THEN 0.05 ELSE 0 END AS DOUBLE) AS rate FROM ord")
def udf_discount(spark, sf):
    define_scalars(spark)
    return run_sql(spark, sf, "SELECT order_id, discount_rate(amount) AS rate FROM ord")


@query("udf_level", "SELECT c.customer_id, CASE WHEN t.total >= 3000000 THEN 'gold' WHEN t.total >= 1500000 THEN 'silver' ELSE 'basic' END AS level FROM cust c LEFT JOIN (SELECT customer_id, sum(amount) AS total FROM ord WHERE status NOT IN ('P') GROUP BY customer_id) t ON c.customer_id = t.customer_id")
def udf_level(spark, sf):
    """A scalar function that queries a table, as one join instead of a query a row."""
    totals = run_sql(spark, sf, "SELECT customer_id, sum(amount) AS total FROM ord WHERE status NOT IN ('P') GROUP BY customer_id")
    level = F.when(F.col("total") >= 3000000, "gold").when(F.col("total") >= 1500000, "silver").otherwise("basic")
    return run_sql(spark, sf, "SELECT customer_id FROM cust").join(totals, "customer_id", "left").select("customer_id", level.alias("level"))


def customer_orders(orders: DataFrame, keys: DataFrame) -> DataFrame:
    """Inline table function: the orders of each of the given customers."""
    return orders.join(keys, "customer_id", "left_semi").select("customer_id", "order_id", "amount")


@query("tvf_customer_orders", "SELECT o.customer_id, o.order_id, o.amount FROM ord o JOIN cust c ON o.customer_id = c.customer_id WHERE c.tier = 'D' AND c.region = 'EUROPE'")
def tvf_customer_orders(spark, sf):
    return customer_orders(run_sql(spark, sf, MODEL["ord"]), run_sql(spark, sf, "SELECT customer_id FROM cust WHERE tier = 'D' AND region = 'EUROPE'"))


def product_sales(spark, sf, category: str | None) -> DataFrame:
    return run_sql(spark, sf, "SELECT p.product_id, p.category, sum(i.quantity) AS sold FROM prod p JOIN item i ON p.product_id = i.product_id WHERE :category IS NULL OR p.category = :category GROUP BY p.product_id, p.category", args={"category": category})


@query("tvf_product_sales", "SELECT p.product_id, p.category, sum(i.quantity) AS sold, 'all' AS asked FROM prod p JOIN item i ON p.product_id = i.product_id GROUP BY p.product_id, p.category UNION ALL SELECT p.product_id, p.category, sum(i.quantity), 'Brand#4' FROM prod p JOIN item i ON p.product_id = i.product_id WHERE p.category = 'Brand#4' GROUP BY p.product_id, p.category")
def tvf_product_sales(spark, sf):
    return product_sales(spark, sf, None).withColumn("asked", F.lit("all")).unionByName(product_sales(spark, sf, "Brand#4").withColumn("asked", F.lit("Brand#4")))


def top_customers(spark, sf, n: int, region: str | None) -> DataFrame:
    totals = run_sql(spark, sf, "SELECT c.customer_id, c.region, round(sum(o.amount), 2) AS spent FROM cust c JOIN ord o ON c.customer_id = o.customer_id GROUP BY c.customer_id, c.region")
    return (totals if region is None else totals.where(F.col("region") == region)).orderBy(F.desc("spent"), "customer_id").limit(n)


@query("tvf_top_customers", "(SELECT c.customer_id, c.region, round(sum(o.amount), 2) AS spent FROM cust c JOIN ord o ON c.customer_id = o.customer_id WHERE c.region = 'ASIA' GROUP BY c.customer_id, c.region ORDER BY spent DESC, customer_id LIMIT 10)")
def tvf_top_customers(spark, sf):
    return top_customers(spark, sf, 10, "ASIA")


@query("tvf_monthly_report", "SELECT year(order_date) AS y, month(order_date) AS m, CAST(count(*) AS BIGINT) AS orders, round(sum(amount), 2) AS sales, round(sum(sum(amount)) OVER (PARTITION BY year(order_date) ORDER BY month(order_date)), 2) AS year_to_date FROM ord GROUP BY year(order_date), month(order_date)")
def tvf_monthly_report(spark, sf):
    """Multi-statement table function: months, then running totals within the year."""
    months = run_sql(spark, sf, "SELECT CAST(year(order_date) AS BIGINT) AS y, CAST(month(order_date) AS BIGINT) AS m, count(*) AS orders, sum(amount) AS s FROM ord GROUP BY 1, 2")
    return months.select("y", "m", "orders", F.round("s", 2).alias("sales"), F.round(F.sum("s").over(Window.partitionBy("y").orderBy("m")), 2).alias("year_to_date"))


# --- procedures ---
@query("proc_cancel_order", "SELECT 'order' AS what, o_orderkey AS id, CAST(NULL AS BIGINT) AS part, 'P' AS status, CAST(NULL AS DOUBLE) AS delta FROM orders WHERE o_orderstatus = 'O' AND o_totalprice < 20000 UNION ALL SELECT 'stock', l_orderkey, l_partkey, NULL, sum(l_quantity) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice < 20000) GROUP BY l_orderkey, l_partkey")
def proc_cancel_order(spark, sf):
    """Cancels open small orders: their new status and the stock they give back, as sets instead of a cursor."""
    hit = table(spark, sf, "orders").where("o_orderstatus = 'O' and o_totalprice < 20000").select("o_orderkey")
    orders = hit.select(F.lit("order").alias("what"), F.col("o_orderkey").alias("id"), F.lit(None).cast("bigint").alias("part"), F.lit("P").alias("status"), F.lit(None).cast("double").alias("delta"))
    back = table(spark, sf, "lineitem").join(hit, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("delta"))
    return orders.unionByName(back.select(F.lit("stock").alias("what"), F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("part"), F.lit(None).cast("string").alias("status"), "delta"))


@query("proc_customer_orders", "SELECT order_id, order_date, amount, CAST(count(*) OVER () AS BIGINT) AS total FROM ord WHERE customer_id = 7 ORDER BY order_date DESC, order_id LIMIT 5 OFFSET 0")
def proc_customer_orders(spark, sf, customer: int = 7, page: int = 1, size: int = 5):
    return run_sql(spark, sf, "SELECT order_id, order_date, amount, count(*) OVER () AS total FROM ord WHERE customer_id = :c ORDER BY order_date DESC, order_id LIMIT :n OFFSET :skip", args={"c": customer, "n": size, "skip": (page - 1) * size})


sql_query("cursor_absolute", "SELECT customer_id, order_id, CAST(pos AS BIGINT) AS pos FROM (SELECT customer_id, order_id, row_number() OVER (PARTITION BY customer_id ORDER BY order_date, order_id) AS pos, count(*) OVER (PARTITION BY customer_id) AS n FROM ord) x WHERE pos IN (1, 3) OR pos = n")


@query("script_while", "SELECT CAST(sum(range) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS steps FROM range(1, 11)")
def script_while(spark, sf):
    return spark.sql("BEGIN DECLARE i BIGINT = 0; DECLARE total BIGINT = 0; WHILE i < 10 DO SET i = i + 1; SET total = total + i; END WHILE; SELECT total AS total, i AS steps; END")


@query("script_handler", "SELECT 'DIVIDE_BY_ZERO' AS caught, CAST(-1 AS INT) AS result")
def script_handler(spark, sf):
    return spark.sql("BEGIN DECLARE r INT = 0; DECLARE caught STRING = 'none'; BEGIN DECLARE EXIT HANDLER FOR DIVIDE_BY_ZERO BEGIN SET caught = 'DIVIDE_BY_ZERO'; SET r = -1; END; SET r = 1 / 0; END; SELECT caught AS caught, r AS result; END")
