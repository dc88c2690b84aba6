"""Comparing two results: one operator with named kinds of equality.

Rows are aligned by key, or by position under an explicit order, in one full join; nothing is collected. Counts are
exact. Which comparison applies to a column follows from the two types when the plan is built.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..registry import query, table
from .order import global_rank

MODES = ("strict", "text", "loose", "tolerance")
TRUE, FALSE = ("true", "1", "yes", "t", "y"), ("false", "0", "no", "f", "n")


def _is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def _as_number(c: Column, t: T.DataType) -> Column:
    return c.cast("double") if _is_number(t) else F.expr("cast(null as double)") if isinstance(t, T.BooleanType) else c.cast("string").try_cast("double")


def _as_bool(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.BooleanType):
        return c
    if _is_number(t):
        return c != 0
    low = F.lower(F.trim(c.cast("string")))
    return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)


def equal(a: Column, b: Column, ta: T.DataType, tb: T.DataType, mode: str = "strict", tolerance: float | None = None) -> Column:
    """Whether two values count as equal; never null. Two nulls are equal, one is not.

    strict: equal values. text: as strings, floats to 6 places. loose: numbers within 1e-4, booleans as numbers, strings
    trimmed. tolerance: numbers within the tolerance, without one whole numbers exactly and others within 0.005; booleans
    accept their spellings, strings ignore trailing blanks, numeric strings count as numbers.
    """
    if mode == "strict":
        return a.eqNullSafe(b)
    if mode == "text":
        show = lambda c, t: F.format_number(c, 6) if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)) else c.cast("string")
        return show(a, ta).eqNullSafe(show(b, tb))
    numbers = _is_number(ta) and _is_number(tb)
    if mode == "loose":
        if isinstance(ta, T.BooleanType) or isinstance(tb, T.BooleanType):
            a, b, numbers = a.cast("int"), b.cast("int"), True
        same = F.abs(a.cast("double") - b.cast("double")) < 1e-4 if numbers else F.trim(a.cast("string")) == F.trim(b.cast("string"))
    elif isinstance(ta, T.BooleanType) or isinstance(tb, T.BooleanType):
        same = F.coalesce(_as_bool(a, ta) == _as_bool(b, tb), F.lit(False))
    else:
        x, y = _as_number(a, ta), _as_number(b, tb)
        if tolerance is not None:
            near = F.abs(x - y) <= tolerance
        else:
            near = F.when((x == F.floor(x)) & (y == F.floor(y)), x == y).otherwise(F.abs(x - y) < 0.005)
        text = F.rtrim(a.cast("string")) == F.rtrim(b.cast("string"))
        same = near if numbers else F.when(x.isNotNull() & y.isNotNull(), near).otherwise(text)
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(F.coalesce(same, F.lit(False)))


def category(a: Column, b: Column, ta: T.DataType, tb: T.DataType) -> Column:
    """What kind of difference it is."""
    if isinstance(ta, T.BooleanType) or isinstance(tb, T.BooleanType):
        kind = "boolean"
    elif _is_number(ta) and _is_number(tb):
        kind = "precision"
    elif isinstance(ta, T.StringType) and isinstance(tb, T.StringType):
        kind = "collation"
    else:
        kind = "type_mapping" if type(ta) is not type(tb) else "value"
    return F.when(a.isNull() | b.isNull(), "nullability").otherwise(kind)


def by_position(df: DataFrame, key: str, ties: list[str], descending: bool = False) -> DataFrame:
    """df with row_index (from 0) under a total order by a number, nulls last, and what breaks its ties: ranked in buckets, never in one task."""
    return global_rank(df, key, ties, descending, name="row_index").withColumn("row_index", F.col("row_index") - 1)


def aligned(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full join by key; columns l_<name>, r_<name> and side (both, left, right)."""
    a = left.select(*keys, *[F.col(c).alias(f"l_{c}") for c in left.columns if c not in keys], F.lit(True).alias("_l"))
    b = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys], F.lit(True).alias("_r"))
    side = F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both")
    return a.join(b, keys, "full").withColumn("side", side).drop("_l", "_r")


def field_diffs(left: DataFrame, right: DataFrame, keys: list[str], mode: str = "tolerance", tolerance: dict[str, float] | None = None, ignore: tuple[str, ...] = (), check: tuple[str, ...] | None = None) -> DataFrame:
    """keys, field, source, target and category of every field that differs in rows both sides have."""
    common = [c for c in left.columns if c in right.columns and c not in keys and c not in ignore and (check is None or c in check)]
    both = left.select(*keys, *[F.col(c).alias(f"l_{c}") for c in common]).join(right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in common]), keys)
    found = []
    for c in common:
        a, b, ta, tb = F.col(f"l_{c}"), F.col(f"r_{c}"), left.schema[c].dataType, right.schema[c].dataType
        same = equal(a, b, ta, tb, mode, (tolerance or {}).get(c))
        found.append(F.when(~same, F.struct(F.lit(c).alias("field"), a.cast("string").alias("source"), b.cast("string").alias("target"), category(a, b, ta, tb).alias("category"))))
    return both.select(*keys, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("d")).select(*keys, "d.*")


def summary(left: DataFrame, right: DataFrame, keys: list[str], mode: str = "loose", tolerance: dict[str, float] | None = None) -> DataFrame:
    """One row: rows of both sides, rows only on one, rows that differ, differing values per column, status. One join, one pass."""
    common = [c for c in left.columns if c in right.columns and c not in keys]
    bad = {c: (F.col("side") == "both") & ~equal(F.col(f"l_{c}"), F.col(f"r_{c}"), left.schema[c].dataType, right.schema[c].dataType, mode, (tolerance or {}).get(c)) for c in common}
    rows = functools.reduce(lambda x, y: x | y, bad.values(), F.lit(False))
    out = aligned(left, right, keys).agg(
        F.count_if(F.col("side") != "right").alias("source_rows"), F.count_if(F.col("side") != "left").alias("target_rows"), F.count_if(F.col("side") == "left").alias("only_source"),
        F.count_if(F.col("side") == "right").alias("only_target"), F.count_if(rows).alias("rows_differ"), *[F.count_if(v).alias(f"diff_{c}") for c, v in bad.items()],
    )
    same = (F.col("only_source") + F.col("only_target") + F.col("rows_differ") == 0) & F.lit(sorted(left.columns) == sorted(right.columns))
    return out.withColumn("status", F.when(same, "MATCH").otherwise("DIFF"))


def strict(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: rows that only one side has, with repeats, and whether both are equal as multisets."""
    both = left.withColumn("_side", F.lit(1)).union(right.withColumn("_side", F.lit(-1)))
    n = both.groupBy(*left.columns).agg(F.sum("_side").alias("n")).where("n <> 0")
    counts = n.agg(F.coalesce(F.sum(F.greatest("n", F.lit(0))), F.lit(0)).alias("only_source"), F.coalesce(F.sum(F.greatest(-F.col("n"), F.lit(0))), F.lit(0)).alias("only_target"))
    return counts.withColumn("equal", (F.col("only_source") == 0) & (F.col("only_target") == 0))


def schema_diff(frames: dict[str, DataFrame], spark) -> DataFrame:
    """Per result the columns that others have and it lacks."""
    every = list(dict.fromkeys(c for df in frames.values() for c in df.columns))
    rows = [(n, len(df.columns), ",".join(sorted(c for c in every if c not in df.columns))) for n, df in frames.items()]
    return spark.createDataFrame(rows, "db string, n_columns long, missing string")


def shape_diff(left: DataFrame, right: DataFrame, spark) -> DataFrame:
    """Columns of both sides by name (case-insensitive) with their types."""
    a, b = ({f.name.lower(): f.dataType.simpleString() for f in df.schema} for df in (left, right))
    rows = [(c, a.get(c), b.get(c), "missing" if c not in b else "extra" if c not in a else "type" if a[c] != b[c] else "same") for c in sorted({*a, *b})]
    return spark.createDataFrame(rows, "field string, source_type string, target_type string, result string")


def consensus(frames: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """keys, field, how many results have the row, and distinct values, where results disagree. Any number of results."""
    fields = [c for c in next(iter(frames.values())).columns if c not in keys and all(c in df.columns for df in frames.values())]
    parts = [df.select(*keys, *[F.col(c).cast("string").alias(c) for c in fields]).unpivot(keys, fields, "field", "value") for df in frames.values()]
    every = functools.reduce(DataFrame.unionByName, parts)
    n = F.count_distinct(F.struct("value"))
    return every.groupBy(*keys, "field").agg(F.count(F.lit(1)).alias("results"), n.alias("variants")).where((F.col("results") < len(frames)) | (F.col("variants") > 1))


# --- queries: orders against a copy that differs in known ways ---
CHANGED = """SELECT o_orderkey, o_custkey, o_orderstatus, CASE o_orderkey % 97 WHEN 0 THEN o_totalprice + 0.004 WHEN 1 THEN o_totalprice + 0.01 WHEN 2 THEN NULL ELSE o_totalprice END AS o_totalprice,
 CASE WHEN o_orderkey % 97 = 3 THEN o_orderpriority || '  ' WHEN o_orderkey % 97 = 5 THEN lower(o_orderpriority) ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 97 <> 4"""
COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def _pair(spark, sf):
    left = table(spark, sf, "orders").select(*COLUMNS)
    k = F.col("o_orderkey") % 97
    right = left.where(k != 4).withColumns({
        "o_totalprice": F.when(k == 0, F.col("o_totalprice") + 0.004).when(k == 1, F.col("o_totalprice") + 0.01).when(k == 2, F.lit(None)).otherwise(F.col("o_totalprice")),
        "o_orderpriority": F.when(k == 3, F.concat("o_orderpriority", F.lit("  "))).when(k == 5, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")),
    })
    return left, right


_JOIN = f"(SELECT {', '.join(COLUMNS)} FROM orders) l FULL JOIN ({CHANGED}) r ON l.o_orderkey = r.o_orderkey"


@query("diff_strict", f"SELECT (SELECT CAST(count(*) AS BIGINT) FROM (SELECT {', '.join(COLUMNS)} FROM orders EXCEPT ALL {CHANGED})) AS only_source, (SELECT CAST(count(*) AS BIGINT) FROM ({CHANGED} EXCEPT ALL SELECT {', '.join(COLUMNS)} FROM orders)) AS only_target, false AS equal")
def diff_strict(spark, sf):
    return strict(*_pair(spark, sf))


_LEFT = f"SELECT {', '.join(COLUMNS)} FROM orders"
_RENAMED = f"SELECT * RENAME (o_totalprice AS price) FROM ({CHANGED}) c"


@query("diff_schema", f"""WITH a AS (SELECT column_name AS c FROM (DESCRIBE {_LEFT})), b AS (SELECT column_name AS c FROM (DESCRIBE {_RENAMED}))
 SELECT 'source' AS db, (SELECT CAST(count(*) AS BIGINT) FROM a) AS n_columns, (SELECT string_agg(c, ',' ORDER BY c) FROM b WHERE c NOT IN (SELECT c FROM a)) AS missing UNION ALL SELECT 'target', (SELECT CAST(count(*) AS BIGINT) FROM b), (SELECT string_agg(c, ',' ORDER BY c) FROM a WHERE c NOT IN (SELECT c FROM b))""")
def diff_schema(spark, sf):
    left, right = _pair(spark, sf)
    return schema_diff({"source": left, "target": right.withColumnRenamed("o_totalprice", "price")}, spark)


@query("diff_values_6dp", f"SELECT l.o_orderkey, 'o_totalprice' AS field FROM {_JOIN} WHERE l.o_orderkey IS NOT NULL AND r.o_orderkey IS NOT NULL AND format('{{:.6f}}', l.o_totalprice) IS DISTINCT FROM format('{{:.6f}}', r.o_totalprice) UNION ALL SELECT l.o_orderkey, 'o_orderpriority' FROM {_JOIN} WHERE l.o_orderkey IS NOT NULL AND r.o_orderkey IS NOT NULL AND l.o_orderpriority IS DISTINCT FROM r.o_orderpriority")
def diff_values_6dp(spark, sf):
    return field_diffs(*_pair(spark, sf), ["o_orderkey"], "text").select("o_orderkey", "field")


@query("diff_three_layer", f"""SELECT CAST(count(l.o_orderkey) AS BIGINT) AS source_rows, CAST(count(r.o_orderkey) AS BIGINT) AS target_rows, CAST(count(*) FILTER (r.o_orderkey IS NULL) AS BIGINT) AS only_source, CAST(0 AS BIGINT) AS only_target,
 CAST(count(*) FILTER (r.o_orderkey IS NOT NULL AND (p OR t)) AS BIGINT) AS rows_differ, CAST(0 AS BIGINT) AS diff_o_custkey, CAST(0 AS BIGINT) AS diff_o_orderstatus, CAST(count(*) FILTER (r.o_orderkey IS NOT NULL AND p) AS BIGINT) AS diff_o_totalprice, CAST(count(*) FILTER (r.o_orderkey IS NOT NULL AND t) AS BIGINT) AS diff_o_orderpriority, 'DIFF' AS status
 FROM (SELECT *, coalesce(abs(l_p - r_p) >= 1e-4, (l_p IS NULL) <> (r_p IS NULL)) AS p, trim(l_t) IS DISTINCT FROM trim(r_t) AS t FROM (SELECT l.o_orderkey AS lk, r.o_orderkey AS rk, l.o_totalprice AS l_p, r.o_totalprice AS r_p, l.o_orderpriority AS l_t, r.o_orderpriority AS r_t FROM {_JOIN}) j) x, LATERAL (SELECT x.lk AS o_orderkey) l, LATERAL (SELECT x.rk AS o_orderkey) r""")
def diff_three_layer(spark, sf):
    return summary(*_pair(spark, sf), ["o_orderkey"], "loose")


@query("diff_tolerance", f"SELECT l.o_orderkey, 'o_totalprice' AS field, CASE WHEN r.o_totalprice IS NULL THEN 'nullability' ELSE 'precision' END AS category FROM {_JOIN} WHERE l.o_orderkey IS NOT NULL AND r.o_orderkey IS NOT NULL AND (r.o_totalprice IS NULL OR abs(l.o_totalprice - r.o_totalprice) > 0.005) UNION ALL SELECT l.o_orderkey, 'o_orderpriority', 'collation' FROM {_JOIN} WHERE l.o_orderkey IS NOT NULL AND r.o_orderkey IS NOT NULL AND rtrim(l.o_orderpriority) <> rtrim(r.o_orderpriority)")
def diff_tolerance(spark, sf):
    return field_diffs(*_pair(spark, sf), ["o_orderkey"], "tolerance", {"o_totalprice": 0.005}).select("o_orderkey", "field", "category")


@query("diff_categories", f"SELECT category, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN r.o_totalprice IS NULL THEN 'nullability' ELSE 'precision' END AS category FROM {_JOIN} WHERE r.o_orderkey IS NOT NULL AND l.o_totalprice IS DISTINCT FROM r.o_totalprice UNION ALL SELECT 'collation' FROM {_JOIN} WHERE r.o_orderkey IS NOT NULL AND l.o_orderpriority <> r.o_orderpriority) x GROUP BY category")
def diff_categories(spark, sf):
    return field_diffs(*_pair(spark, sf), ["o_orderkey"], "strict").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


_TYPE = "CASE column_type WHEN 'VARCHAR' THEN 'string' ELSE lower(column_type) END"


@query("diff_shape", f"""WITH a AS (SELECT lower(column_name) AS c, {_TYPE} AS t FROM (DESCRIBE {_LEFT})), b AS (SELECT lower(column_name) AS c, {_TYPE} AS t FROM (DESCRIBE SELECT * REPLACE (CAST(o_custkey AS VARCHAR) AS o_custkey) RENAME (o_orderstatus AS state) FROM ({CHANGED}) x))
 SELECT coalesce(a.c, b.c) AS field, a.t AS source_type, b.t AS target_type, CASE WHEN b.c IS NULL THEN 'missing' WHEN a.c IS NULL THEN 'extra' WHEN a.t <> b.t THEN 'type' ELSE 'same' END AS result FROM a FULL JOIN b ON a.c = b.c""")
def diff_shape(spark, sf):
    left, right = _pair(spark, sf)
    return shape_diff(left, right.withColumnRenamed("o_orderstatus", "state").withColumn("o_custkey", F.col("o_custkey").cast("string")), spark)


@query("diff_consensus", f"""SELECT o_orderkey, field, CAST(count(*) AS BIGINT) AS results, CAST(count(DISTINCT coalesce(v, '<null>')) AS BIGINT) AS variants FROM (
 SELECT o_orderkey, 'o_orderstatus' AS field, o_orderstatus AS v FROM orders UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders
 UNION ALL SELECT o_orderkey, 'o_orderstatus', o_orderstatus FROM ({CHANGED}) a UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM ({CHANGED}) b
 UNION ALL SELECT o_orderkey, 'o_orderstatus', CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE o_orderstatus END FROM orders UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders) x GROUP BY o_orderkey, field HAVING count(*) < 3 OR count(DISTINCT coalesce(v, '<null>')) > 1""")
def diff_consensus(spark, sf):
    left, right = (df.select("o_orderkey", "o_orderstatus", "o_orderpriority") for df in _pair(spark, sf))
    third = left.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 101 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")))
    return consensus({"a": left, "b": right, "c": third}, ["o_orderkey"])


@query("diff_positional", f"SELECT CAST(a.row_index AS INT) AS row_index FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) - 1 AS row_index FROM orders) a JOIN (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) - 1 AS row_index FROM ({CHANGED}) c) b ON a.row_index = b.row_index WHERE a.o_orderkey <> b.o_orderkey")
def diff_positional(spark, sf):
    """Row i against row i, under a total order."""
    left, right = (df.select("o_orderkey", "o_totalprice") for df in _pair(spark, sf))
    placed = (by_position(df, "o_totalprice", ["o_orderkey"], descending=True) for df in (left, right))
    return field_diffs(*placed, ["row_index"], "strict", check=("o_orderkey",)).select(F.col("row_index").cast("int").alias("row_index"))


@query("verify_counts", f"SELECT 'orders' AS table_name, (SELECT CAST(count(*) AS BIGINT) FROM orders) AS source_rows, (SELECT CAST(count(*) AS BIGINT) FROM ({CHANGED}) c) AS target_rows, 'FAIL' AS status UNION ALL SELECT 'customer', CAST(count(*) AS BIGINT), CAST(count(*) AS BIGINT), 'PASS' FROM customer")
def verify_counts(spark, sf):
    left, right = _pair(spark, sf)
    customer = table(spark, sf, "customer")
    parts = [s.agg(F.count(F.lit(1)).alias("source_rows")).crossJoin(t.agg(F.count(F.lit(1)).alias("target_rows"))).withColumn("table_name", F.lit(n)) for n, s, t in (("orders", left, right), ("customer", customer, customer))]
    return parts[0].unionByName(parts[1]).select("table_name", "source_rows", "target_rows", F.when(F.col("source_rows") == F.col("target_rows"), "PASS").otherwise("FAIL").alias("status"))


_VERIFIED = f"v AS (SELECT (SELECT count(*) FROM orders) <> (SELECT count(*) FROM ({CHANGED}) c) AS n, EXISTS (SELECT 1 FROM {_JOIN} WHERE l.o_orderkey = r.o_orderkey AND (" + " OR ".join(f"l.{c} IS DISTINCT FROM r.{c}" for c in COLUMNS) + ")) AS d)"


@query("verify_structure", f"WITH a AS (SELECT list(column_name) AS x FROM (DESCRIBE {_LEFT})), b AS (SELECT list(column_name) AS x FROM (DESCRIBE {CHANGED})), {_VERIFIED} SELECT a.x = b.x AS structure_match, NOT n AND NOT d AS data_match, concat_ws(',', CASE WHEN a.x <> b.x THEN 'columns' END, CASE WHEN n THEN 'row_count' END, CASE WHEN d THEN 'values' END) AS issues FROM a, b, v")
def verify_structure(spark, sf):
    left, right = _pair(spark, sf)
    s = summary(left, right, ["o_orderkey"], "strict")
    structure = F.lit([f.name for f in left.schema] == [f.name for f in right.schema])
    rows, values = F.col("source_rows") != F.col("target_rows"), F.col("rows_differ") > 0
    issues = F.concat_ws(",", F.when(~structure, "columns"), F.when(rows, "row_count"), F.when(values, "values"))
    return s.select(structure.alias("structure_match"), (~rows & ~values).alias("data_match"), issues.alias("issues"))


def result_fields(left: DataFrame, right: DataFrame, left_ok: bool = True, right_ok: bool = True) -> DataFrame:
    """field, source, target of what differs between two results as wholes: success, row_count, columns, data (in how many rows)."""
    rows = left.agg(F.count(F.lit(1)).alias("a")).crossJoin(right.agg(F.count(F.lit(1)).alias("b")))
    names = [F.lit(",".join(df.columns)) for df in (left, right)]
    data = (F.lit(None).cast("long"),) * 2
    if [c.lower() for c in left.columns] == [c.lower() for c in right.columns]:
        rows = rows.crossJoin(strict(left, right))
        data = F.col("only_source"), F.col("only_target")
    fields = [("success", F.lit(left_ok), F.lit(right_ok)), ("row_count", F.col("a"), F.col("b")), ("columns", *names)]
    found = [F.when(x != y, F.struct(F.lit(n).alias("field"), x.cast("string").alias("source"), y.cast("string").alias("target"))) for n, x, y in fields]
    found.append(F.when(F.coalesce(data[0] + data[1] > 0, F.lit(True)), F.struct(F.lit("data").alias("field"), data[0].cast("string").alias("source"), data[1].cast("string").alias("target"))))
    return rows.select(F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("d")).select("d.*")


@query("diff_result_fields", f"""SELECT 'values' AS name, 'row_count' AS field, (SELECT CAST(count(*) AS VARCHAR) FROM orders) AS source, (SELECT CAST(count(*) AS VARCHAR) FROM ({CHANGED}) c) AS target
 UNION ALL SELECT 'values', 'data', (SELECT CAST(count(*) AS VARCHAR) FROM (SELECT {', '.join(COLUMNS)} FROM orders EXCEPT ALL {CHANGED})), (SELECT CAST(count(*) AS VARCHAR) FROM ({CHANGED} EXCEPT ALL SELECT {', '.join(COLUMNS)} FROM orders))
 UNION ALL SELECT 'names', 'success', 'true', 'false' UNION ALL SELECT 'names', 'columns', 'o_orderkey', 'k' UNION ALL SELECT 'names', 'data', NULL, NULL""")
def diff_result_fields(spark, sf):
    left, right = _pair(spark, sf)
    one = left.select("o_orderkey")
    names = result_fields(one, one.withColumnRenamed("o_orderkey", "k"), True, False)
    parts = [result_fields(left, right).select(F.lit("values").alias("name"), "*"), names.select(F.lit("names").alias("name"), "*"), result_fields(left, left).select(F.lit("same").alias("name"), "*")]
    return functools.reduce(DataFrame.unionByName, parts)
