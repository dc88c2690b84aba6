"""A query per group of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query, sql_query, table
from . import tsql


@query("fn_null", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'none') AS status, nullif(o_orderpriority, '5-LOW') AS priority, coalesce(nullif(o_totalprice, 0), -1) AS price FROM orders")
def fn_null(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", tsql.isnull(F.nullif("o_orderstatus", F.lit("P")), F.lit("none")).alias("status"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"), F.nvl(F.nullif("o_totalprice", F.lit(0.0)), F.lit(-1.0)).alias("price"))


@query("fn_len", "SELECT p_partkey, CAST(length(rtrim(p_name || '   ')) AS INT) AS n, CAST(octet_length(encode(p_type)) AS INT) AS bytes FROM part")
def fn_len(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tsql.len_(F.concat("p_name", F.lit("   "))).alias("n"), F.octet_length("p_type").alias("bytes"))


@query("fn_charindex", "SELECT p_partkey, CAST(instr(p_name, 'e') AS INT) AS first_e, CAST(CASE WHEN instr(substr(p_name, 4), 'e') > 0 THEN instr(substr(p_name, 4), 'e') + 3 ELSE 0 END AS INT) AS later_e FROM part")
def fn_charindex(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tsql.charindex("e", "p_name").alias("first_e"), tsql.charindex("e", "p_name", 4).alias("later_e"))


@query("fn_patindex", "SELECT p_partkey, CAST(CASE WHEN regexp_matches(p_brand, '[3-9]') THEN length(regexp_extract(p_brand, '^[^3-9]*')) + 1 ELSE 0 END AS INT) AS digit_at, CAST(CASE WHEN regexp_matches(p_name, '^b') THEN 1 ELSE 0 END AS INT) AS starts_b FROM part")
def fn_patindex(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tsql.patindex("%[3-9]%", "p_brand").alias("digit_at"), tsql.patindex("b%", "p_name").alias("starts_b"))


@query("fn_stuff", "SELECT p_partkey, CASE WHEN length(p_name) >= 3 THEN substr(p_name, 1, 2) || '##' || substr(p_name, 6) END AS stuffed, repeat(p_type, 2) AS twice, 'a' || repeat(' ', 3) || 'b' AS spaced FROM part")
def fn_stuff(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tsql.stuff("p_name", 3, 3, "##").alias("stuffed"), tsql.replicate("p_type", 2).alias("twice"), F.concat(F.lit("a"), F.repeat(F.lit(" "), 3), F.lit("b")).alias("spaced"))


@query("fn_concat", "SELECT o_orderkey, concat(nullif(o_orderstatus, 'F'), '-', o_orderpriority) AS joined, concat_ws('/', nullif(o_orderstatus, 'F'), o_orderpriority) AS listed FROM orders")
def fn_concat(spark, sf):
    status = F.nullif("o_orderstatus", F.lit("F"))
    return table(spark, sf, "orders").select("o_orderkey", tsql.concat(status, F.lit("-"), F.col("o_orderpriority")).alias("joined"), F.concat_ws("/", status, "o_orderpriority").alias("listed"))


sql_query("fn_string", "SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low, substring(p_name, 2, 3) AS mid, left(p_brand, 5) AS l, right(p_brand, 2) AS r, replace(p_name, ' ', '_') AS rep, ltrim(concat('  ', p_type)) AS lt, rtrim(concat(p_type, '  ')) AS rt, trim(concat(' ', p_type, ' ')) AS t, reverse(p_type) AS rev FROM part")


@query("fn_quotename", "SELECT n_nationkey, '[' || replace(n_name || ']', ']', ']]') || ']' AS quoted FROM nation")
def fn_quotename(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", tsql.quotename(F.concat("n_name", F.lit("]"))).alias("quoted"))


sql_query("fn_string_split", "SELECT p_partkey, word FROM part LATERAL VIEW explode(split(p_name, ' ')) w AS word", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")


@query("fn_isnumeric", r"SELECT c_custkey, CAST(regexp_full_match(substr(c_name, 10), '[+-]?([0-9]+\.?[0-9]*|[0-9]*\.?[0-9]+)') AS INT) AS tail_numeric, CAST(regexp_full_match(c_name, '[+-]?([0-9]+\.?[0-9]*|[0-9]*\.?[0-9]+)') AS INT) AS name_numeric FROM customer")
def fn_isnumeric(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", tsql.isnumeric(F.substring("c_name", 10, 100)).alias("tail_numeric"), tsql.isnumeric("c_name").alias("name_numeric"))


@query("fn_now")
def fn_now(spark, sf):
    """Clock functions differ from run to run: only the rows can be compared."""
    return table(spark, sf, "region").select("r_regionkey", F.current_timestamp().alias("now"), F.localtimestamp().alias("local_now"), F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).alias("utc_now"))


@query("fn_datepart", """SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofyear(o_orderdate) AS doy, dayofweek(o_orderdate) + 1 AS dw,
  CAST(floor((dayofyear(o_orderdate) + dayofweek(date_trunc('year', o_orderdate)) + 1 - 2) / 7) AS BIGINT) + 1 AS wk FROM orders""")
def fn_datepart(spark, sf):
    d = "o_orderdate"
    return table(spark, sf, "orders").select("o_orderkey", *[tsql.datepart(u, d).alias(n) for u, n in (("year", "y"), ("qq", "q"), ("month", "m"), ("dd", "d"), ("dy", "doy"), ("weekday", "dw"), ("week", "wk"))])


@query("fn_datename", "SELECT o_orderkey, monthname(o_orderdate) AS month_name, dayname(o_orderdate) AS day_name, CAST(year(o_orderdate) AS VARCHAR) AS year_name FROM orders")
def fn_datename(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", tsql.datename("month", "o_orderdate").alias("month_name"), tsql.datename("dw", "o_orderdate").alias("day_name"), tsql.datename("yy", "o_orderdate").alias("year_name"))


@query("fn_eomonth", "SELECT o_orderkey, last_day(o_orderdate) AS month_end, last_day(o_orderdate + INTERVAL 2 MONTH) AS later_end FROM orders")
def fn_eomonth(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", tsql.eomonth("o_orderdate").alias("month_end"), tsql.eomonth("o_orderdate", 2).alias("later_end"))


@query("fn_dateadd", "SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS plus_month, o_orderdate + INTERVAL 6 MONTH AS plus_2q, o_orderdate - INTERVAL 10 DAY AS minus_days, o_orderdate + INTERVAL 14 DAY AS plus_weeks, o_orderdate + INTERVAL 5 HOUR AS plus_hours FROM orders")
def fn_dateadd(spark, sf):
    d = "o_orderdate"
    return table(spark, sf, "orders").select("o_orderkey", *[tsql.dateadd(u, n, d).alias(a) for u, n, a in (("month", 1, "plus_month"), ("quarter", 2, "plus_2q"), ("day", -10, "minus_days"), ("wk", 2, "plus_weeks"), ("hour", 5, "plus_hours"))])


@query("fn_datediff_boundary", """SELECT event_id, date_diff('year', a, ts) AS years, date_diff('quarter', a, ts) AS quarters, date_diff('month', a, ts) AS months, date_diff('day', a, ts) AS days, date_diff('hour', a, ts) AS hours, date_diff('minute', a, ts) AS minutes,
  CAST(floor((date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) + 4) / 7) - floor((date_diff('day', DATE '1970-01-01', CAST(a AS DATE)) + 4) / 7) AS BIGINT) AS weeks FROM (SELECT *, TIMESTAMP '2023-12-30 23:45:10' AS a FROM events) e""")
def fn_datediff_boundary(spark, sf):
    a = F.expr("TIMESTAMP_NTZ '2023-12-30 23:45:10'")
    return table(spark, sf, "events").select("event_id", *[tsql.datediff(u, a, "ts").alias(u + "s") for u in ("year", "quarter", "month", "day", "hour", "minute", "week")])


@query("fn_datetrunc", "SELECT event_id, CAST(date_trunc('month', ts) AS TIMESTAMP) AS m, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h, CAST(CAST(ts AS DATE) - CAST(dayofweek(ts) AS INT) AS TIMESTAMP) AS w FROM events")
def fn_datetrunc(spark, sf):
    return table(spark, sf, "events").select("event_id", tsql.datetrunc("month", "ts").alias("m"), tsql.datetrunc("hour", "ts").alias("h"), tsql.datetrunc("week", "ts").alias("w"))


@query("fn_format", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS d, strftime(o_orderdate, '%A') AS day_name, format('{:,.2f}', o_totalprice) AS n, '$' || format('{:,.2f}', o_totalprice) AS c FROM orders")
def fn_format(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", tsql.format_("o_orderdate", "dd/MM/yyyy").alias("d"), tsql.format_("o_orderdate", "dddd").alias("day_name"), tsql.format_("o_totalprice", "N2").alias("n"), tsql.format_("o_totalprice", "C").alias("c"))


_STRF = {1: "%m/%d/%y", 23: "%Y-%m-%d", 101: "%m/%d/%Y", 103: "%d/%m/%Y", 104: "%d.%m.%Y", 108: "%H:%M:%S", 112: "%Y%m%d", 120: "%Y-%m-%d %H:%M:%S", 126: "%Y-%m-%dT%H:%M:%S.%g"}


@query("fn_convert_style", "SELECT event_id, " + ", ".join(f"strftime(ts, '{p}') AS s{k}" for k, p in _STRF.items()) + " FROM events")
def fn_convert_style(spark, sf):
    return table(spark, sf, "events").select("event_id", *[tsql.convert_style("ts", k).alias(f"s{k}") for k in _STRF])


sql_query("fn_try_cast", "SELECT c_custkey, try_cast(substring(c_name, 10, 20) AS BIGINT) AS id_part, try_cast(c_name AS INT) AS bad, try_cast(c_acctbal AS INT) AS whole, try_cast('2024-13-01' AS DATE) AS no_date FROM customer",
          "SELECT c_custkey, try_cast(substring(c_name, 10, 20) AS BIGINT) AS id_part, try_cast(c_name AS INT) AS bad, CAST(trunc(c_acctbal) AS INT) AS whole, try_cast('2024-13-01' AS DATE) AS no_date FROM customer")


@query("fn_newid")
def fn_newid(spark, sf):
    return table(spark, sf, "region").select("r_regionkey", F.uuid().alias("id"), F.hash(F.uuid()).alias("checksum"))


sql_query("surrogate_key", "SELECT n_name, m.top + row_number() OVER (ORDER BY n_name) AS new_id, (m.top + row_number() OVER (ORDER BY n_name) - 1) % 10 + 1 AS cycled FROM nation CROSS JOIN (SELECT max(n_nationkey) AS top FROM nation) m")
sql_query("fn_math", "SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05D) AS a, CAST(ceil(l_quantity / 3) AS BIGINT) AS c, CAST(floor(l_quantity / 3) AS BIGINT) AS f, greatest(l_quantity, 20D) AS g, least(l_quantity, 20D) AS l, sign(l_tax - 0.04D) AS s FROM lineitem",
          "SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05::DOUBLE) AS a, CAST(ceil(l_quantity / 3) AS BIGINT) AS c, CAST(floor(l_quantity / 3) AS BIGINT) AS f, greatest(l_quantity, 20::DOUBLE) AS g, least(l_quantity, 20::DOUBLE) AS l, CAST(sign(l_tax - 0.04::DOUBLE) AS DOUBLE) AS s FROM lineitem")
sql_query("fn_division", "SELECT p_partkey, CAST(p_size DIV 4 AS BIGINT) AS whole, p_size / 4 AS exact, try_divide(p_size, p_size - p_size) AS by_zero, CAST(floor(avg(p_size) OVER (PARTITION BY p_type)) AS BIGINT) AS int_avg FROM part",
          "SELECT p_partkey, CAST(p_size // 4 AS BIGINT) AS whole, p_size / 4 AS exact, CAST(NULL AS DOUBLE) AS by_zero, CAST(floor(avg(p_size) OVER (PARTITION BY p_type)) AS BIGINT) AS int_avg FROM part")
sql_query("fn_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, from_json(props, 'k INT').k AS k_typed, get_json_object(props, '$.none') IS NULL AS missing FROM events",
          "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS INT) AS k_typed, json_extract(props, '$.none') IS NULL AS missing FROM events")
sql_query("fn_series", "SELECT CAST(id AS BIGINT) AS n, (SELECT CAST(count(*) AS BIGINT) FROM part WHERE p_size = id) AS parts FROM range(1, 51)", "SELECT CAST(range AS BIGINT) AS n, (SELECT CAST(count(*) AS BIGINT) FROM part WHERE p_size = range) AS parts FROM range(1, 51)")
sql_query("fn_array_agg", "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names, CAST(size(collect_set(n_name)) AS BIGINT) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ',') AS names, CAST(len(list(DISTINCT n_name)) AS BIGINT) AS n FROM nation GROUP BY n_regionkey")
