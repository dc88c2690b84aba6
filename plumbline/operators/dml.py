"""UPDATE, DELETE and MERGE as DataFrames: the new table, or what changed, is computed and then written once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query, table

OLD, NEW = "deleted_", "inserted_"


def update(df: DataFrame, sets: dict[str, Column], where: Column | None = None) -> DataFrame:
    """df with the columns of sets replaced where the condition holds (not where it is null)."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in sets.items()})


def update_from(df: DataFrame, source: DataFrame, on: list[str], sets: dict[str, Column], where: Column | None = None) -> DataFrame:
    """UPDATE ... FROM: rows of df that find their key in source (unique there) are updated; sets may use its columns."""
    marked = source.withColumn("_hit", F.lit(True))
    joined = df.join(marked, on, "left")
    hit = F.col("_hit").isNotNull() if where is None else F.col("_hit").isNotNull() & F.coalesce(where, F.lit(False))
    return update(joined, sets, hit).select(*df.columns)


def update_output(df: DataFrame, sets: dict[str, Column], where: Column, key: list[str]) -> DataFrame:
    """OUTPUT of an update: the key, old and new values of the rows it touches."""
    return df.where(where).select(*key, *[F.col(c).alias(OLD + c) for c in sets], *[v.cast(df.schema[c].dataType).alias(NEW + c) for c, v in sets.items()])


def delete(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def delete_from(df: DataFrame, source: DataFrame, on: list[str]) -> DataFrame:
    """DELETE ... FROM a join: an anti join, whatever the source's size."""
    return df.join(source, on, "left_anti")


@dataclass(frozen=True)
class When:
    """A clause of MERGE. side: matched, target (by source not matched) or source (by target not matched); action: update, delete or insert."""

    side: str
    action: str
    sets: dict[str, Column]
    where: Column | None = None


def merge_actions(target: DataFrame, source: DataFrame, on: list[str], whens: list[When]) -> DataFrame:
    """The full join with the first clause that holds for each row: _action, and the row's new values.

    Source columns other than the key are reached as s_<name>. The source's keys must be unique.
    """
    t = target.withColumn("_t", F.lit(True))
    s = source.select(*on, *[F.col(c).alias(f"s_{c}") for c in source.columns if c not in on], F.lit(True).alias("_s"))
    joined = t.join(s, on, "full")
    side = F.when(F.col("_t").isNotNull() & F.col("_s").isNotNull(), "matched").when(F.col("_t").isNotNull(), "target").otherwise("source")
    nth = F.lit(len(whens))
    for i in reversed(range(len(whens))):
        holds = (F.col("_side") == whens[i].side) & (F.lit(True) if whens[i].where is None else F.coalesce(whens[i].where, F.lit(False)))
        nth = F.when(holds, F.lit(i)).otherwise(nth)
    marked = joined.withColumn("_side", side).withColumn("_when", nth)
    action = F.coalesce(*[F.when(F.col("_when") == i, F.lit(w.action)) for i, w in enumerate(whens)], F.when(F.col("_side") == "source", F.lit("skip")).otherwise(F.lit("keep")))
    values = []
    for c in target.columns:
        value = F.col(c)
        for i, w in enumerate(whens):
            if c in w.sets:
                value = F.when(F.col("_when") == i, w.sets[c]).otherwise(value)
            elif w.action == "insert" and c not in on:
                value = F.when(F.col("_when") == i, F.lit(None)).otherwise(value)
        values.append(value.cast(target.schema[c].dataType).alias(c))
    old = [F.col(c).alias(OLD + c) for c in target.columns if c not in on]
    return marked.select(action.alias("_action"), *values, *old)


def merge(target: DataFrame, source: DataFrame, on: list[str], whens: list[When]) -> DataFrame:
    """The target after MERGE."""
    return merge_actions(target, source, on, whens).where(~F.col("_action").isin("delete", "skip")).select(*target.columns)


# --- queries ---
@query("dml_update_case", "SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN round(p_retailprice * 1.1, 3) WHEN p_size > 40 THEN p_retailprice * 2 ELSE p_retailprice END AS p_retailprice FROM part")
def dml_update_case(spark, sf):
    price = F.when(F.col("p_type").isin("ECONOMY", "PROMO"), F.round(F.col("p_retailprice") * 1.1, 3)).otherwise(F.col("p_retailprice") * 2)
    return update(table(spark, sf, "part"), {"p_retailprice": price}, F.col("p_type").isin("ECONOMY", "PROMO") | (F.col("p_size") > 40)).select("p_partkey", "p_retailprice")


@query("dml_update_join", "SELECT c.c_custkey, CASE WHEN o.n IS NOT NULL THEN o.total ELSE c.c_acctbal END AS c_acctbal FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey")
def dml_update_join(spark, sf):
    totals = table(spark, sf, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return update_from(table(spark, sf, "customer"), totals, ["c_custkey"], {"c_acctbal": F.col("total")}).select("c_custkey", "c_acctbal")


@query("dml_delete_join", "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'P')")
def dml_delete_join(spark, sf):
    cancelled = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return delete_from(table(spark, sf, "lineitem"), cancelled, ["l_orderkey"]).select("l_orderkey", "l_linenumber")


@query("dml_update_output", "SELECT p_partkey, p_retailprice AS deleted_p_retailprice, p_retailprice + 5 AS inserted_p_retailprice FROM part WHERE p_size < 10")
def dml_update_output(spark, sf):
    return update_output(table(spark, sf, "part"), {"p_retailprice": F.col("p_retailprice") + 5}, F.col("p_size") < 10, ["p_partkey"])


@query("dml_delete_output", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice < 50000")
def dml_delete_output(spark, sf):
    return table(spark, sf, "orders").where((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 50000)).select("o_orderkey", "o_custkey", "o_totalprice")


#: Stock per part from its lines, the source of the merges below.
SOLD = "SELECT l_partkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey"


def _sold(spark, sf):
    lines = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    return lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("q"))


def _stock(spark, sf):
    return table(spark, sf, "part").where("p_type <> 'SMALL'").select("p_partkey", F.col("p_size").cast("double").alias("stock"))


@query("merge_upsert", f"SELECT coalesce(t.p_partkey, s.l_partkey) AS p_partkey, CASE WHEN t.p_partkey IS NULL THEN s.q WHEN s.l_partkey IS NOT NULL THEN t.stock + s.q ELSE t.stock END AS stock, CASE WHEN t.p_partkey IS NULL THEN 'insert' WHEN s.l_partkey IS NOT NULL THEN 'update' ELSE 'keep' END AS action FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS stock FROM part WHERE p_type <> 'SMALL') t FULL JOIN ({SOLD}) s ON t.p_partkey = s.l_partkey")
def merge_upsert(spark, sf):
    whens = [When("matched", "update", {"stock": F.col("stock") + F.col("s_q")}), When("source", "insert", {"stock": F.col("s_q")})]
    return merge_actions(_stock(spark, sf), _sold(spark, sf), ["p_partkey"], whens).select("p_partkey", "stock", F.col("_action").alias("action"))


@query("merge_multi", f"SELECT coalesce(t.p_partkey, s.l_partkey) AS p_partkey, CASE WHEN t.p_partkey IS NULL THEN s.q WHEN s.l_partkey IS NULL THEN 0 WHEN s.q > 100 THEN s.q ELSE t.stock + s.q END AS stock FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS stock FROM part WHERE p_type <> 'SMALL') t FULL JOIN ({SOLD}) s ON t.p_partkey = s.l_partkey")
def merge_multi(spark, sf):
    whens = [
        When("matched", "update", {"stock": F.col("s_q")}, F.col("s_q") > 100), When("matched", "update", {"stock": F.col("stock") + F.col("s_q")}),
        When("source", "insert", {"stock": F.col("s_q")}), When("target", "update", {"stock": F.lit(0.0)}),
    ]
    return merge(_stock(spark, sf), _sold(spark, sf), ["p_partkey"], whens)


@query("merge_delete", f"SELECT t.p_partkey, t.stock FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS stock FROM part WHERE p_type <> 'SMALL') t LEFT JOIN ({SOLD}) s ON t.p_partkey = s.l_partkey WHERE s.q IS NULL OR s.q <= 60")
def merge_delete(spark, sf):
    return merge(_stock(spark, sf), _sold(spark, sf), ["p_partkey"], [When("matched", "delete", {}, F.col("s_q") > 60)])


@query("adjust_stock", "SELECT p_partkey, CAST(p_size AS DOUBLE) - coalesce(q, 0) AS quantity FROM part LEFT JOIN (SELECT l_partkey, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS q FROM lineitem GROUP BY l_partkey) d ON p_partkey = l_partkey")
def adjust_stock(spark, sf):
    """Deltas are summed first, then applied in one join."""
    delta = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum(F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))).alias("q"))
    return table(spark, sf, "part").join(delta, "p_partkey", "left").select("p_partkey", (F.col("p_size").cast("double") - F.coalesce("q", F.lit(0.0))).alias("quantity"))


@query("check_constraints", """SELECT 'quantity range' AS rule, CAST(count(*) FILTER (NOT (l_quantity BETWEEN 1 AND 9999)) AS BIGINT) AS violations FROM lineitem UNION ALL SELECT 'discount range', CAST(count(*) FILTER (NOT (l_discount BETWEEN 0 AND 0.09)) AS BIGINT) FROM lineitem
 UNION ALL SELECT 'line key unique', CAST(count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS BIGINT) FROM lineitem UNION ALL SELECT 'status values', CAST(count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS BIGINT) FROM orders""")
def check_constraints(spark, sf):
    """Rows against each rule; one pass over each table."""
    line, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    rules = line.agg(F.count_if(~F.col("l_quantity").between(1, 9999)).alias("quantity range"), F.count_if(~F.col("l_discount").between(0, 0.09)).alias("discount range"), (F.count(F.lit(1)) - F.count_distinct("l_orderkey", "l_linenumber")).alias("line key unique"))
    status = orders.agg(F.count_if(~F.col("o_orderstatus").isin("F", "O")).alias("status values"))
    parts = [df.unpivot([], df.columns, "rule", "violations") for df in (rules, status)]
    return parts[0].unionByName(parts[1])


@query("fk_orphans", "SELECT 'lineitem.l_orderkey' AS fk, CAST(count(*) AS BIGINT) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') UNION ALL SELECT 'orders.o_custkey', CAST(count(*) AS BIGINT) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def fk_orphans(spark, sf):
    live = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    a = table(spark, sf, "lineitem").join(live, "l_orderkey", "left_anti").agg(F.count(F.lit(1)).alias("orphans")).select(F.lit("lineitem.l_orderkey").alias("fk"), "orphans")
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    b = table(spark, sf, "orders").join(customers, "o_custkey", "left_anti").agg(F.count(F.lit(1)).alias("orphans")).select(F.lit("orders.o_custkey").alias("fk"), "orphans")
    return a.unionByName(b)


@query("trigger_audit", "SELECT o_orderkey, o_orderstatus AS old_status, CASE WHEN o_totalprice > 400000 THEN 'R' ELSE 'F' END AS new_status FROM orders WHERE o_orderstatus <> CASE WHEN o_totalprice > 400000 THEN 'R' ELSE 'F' END AND o_orderdate >= TIMESTAMP '1999-01-01 00:00:00'")
def trigger_audit(spark, sf):
    """AFTER UPDATE: audit rows from the difference of old and new values, unchanged rows left out."""
    new = F.when(F.col("o_totalprice") > 400000, "R").otherwise("F")
    out = update_output(table(spark, sf, "orders"), {"o_orderstatus": new}, F.col("o_orderdate") >= F.expr("TIMESTAMP_NTZ '1999-01-01 00:00:00'"), ["o_orderkey"])
    return out.where(f"{OLD}o_orderstatus <> {NEW}o_orderstatus").select("o_orderkey", F.col(OLD + "o_orderstatus").alias("old_status"), F.col(NEW + "o_orderstatus").alias("new_status"))


@query("trigger_stock_alert", "SELECT p_partkey, p_size - coalesce(q, 0) AS left_stock FROM part JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_partkey) d ON p_partkey = l_partkey WHERE p_size - q < 10 AND p_size >= 10")
def trigger_stock_alert(spark, sf):
    """AFTER UPDATE of stock: alerts for parts that fall below the least stock."""
    sold = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("q"))
    return table(spark, sf, "part").join(sold, "p_partkey").select("p_partkey", "p_size", (F.col("p_size") - F.col("q")).alias("left_stock")).where("left_stock < 10 and p_size >= 10").drop("p_size")


@query("soft_delete", "SELECT c_custkey, c_acctbal >= 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AS is_active FROM customer")
def soft_delete(spark, sf):
    """INSTEAD OF DELETE: rows stay, marked."""
    busy = table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("busy", F.lit(True))
    return table(spark, sf, "customer").join(busy, "c_custkey", "left").select("c_custkey", ((F.col("c_acctbal") >= 0) | F.col("busy").isNotNull()).alias("is_active"))


@query("fulltext_search", "SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'blue') AND NOT list_contains(string_split(lower(p_name), ' '), 'bolt')")
def fulltext_search(spark, sf):
    words = F.split(F.lower("p_name"), " ")
    return table(spark, sf, "part").where(F.array_contains(words, "blue") & ~F.array_contains(words, "bolt")).select("p_partkey", "p_name")
