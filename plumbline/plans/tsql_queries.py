"""T-SQL statements over the test tables, run through the front end."""

from __future__ import annotations

from ..registry import ORACLES, QUERIES, query, views
from ..storage import table_name
from .transpile import to_tsql, transpile


def tsql_query(name: str, sql: str, oracle: str | None = None, output: bool = False, exact: tuple[str, ...] = (), settled: bool = False, **parameters) -> None:
    """Registers a statement; output: the rows of its OUTPUT clause instead of the table afterwards; exact, settled: see transpile."""

    def run(spark, sf_dir):
        made = transpile(sql, exact, settled)
        text = made.output if output else made.sql
        views(spark, sf_dir, text)
        if made.check and spark.sql(made.check).first()[0]:
            raise ValueError("MERGE: a row of the target meets several source rows")
        return spark.sql(text, args={p: parameters[p] for p in made.parameters} or None)

    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


tsql_query("rewrite_top", "SELECT TOP 5 c_name, [c_acctbal] FROM dbo.customer WITH (NOLOCK) ORDER BY c_acctbal DESC, c_custkey", "SELECT c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5")
tsql_query("rewrite_top_percent", "SELECT TOP 2 PERCENT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS k, count(*) OVER () AS n FROM orders) x WHERE k <= ceil(n * 2 / 100.0)")
tsql_query("rewrite_top_with_ties", "SELECT TOP (3) WITH TIES p_partkey, p_size FROM part ORDER BY p_size DESC", "SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size DESC) AS k FROM part) x WHERE k <= 3")
tsql_query("rewrite_offset_fetch", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey OFFSET 20 ROWS FETCH NEXT 10 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10 OFFSET 20")
tsql_query("rewrite_fetch_first", "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey FETCH FIRST 7 ROWS ONLY", "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 7")
tsql_query("rewrite_isnull_len", "SELECT c_custkey, ISNULL(NULLIF(c_mktsegment, N'BUILDING'), N'no''ne') AS segment, LEN(c_name + '  ') AS n FROM customer", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'no''ne') AS segment, CAST(length(c_name) AS INT) AS n FROM customer")
tsql_query("rewrite_dateadd", "SELECT o_orderkey, DATEADD(day, 10, o_orderdate) AS d10, DATEADD(quarter, -1, o_orderdate) AS q, DATEADD(month, 1, o_orderdate) AS m FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 10 DAY AS d10, o_orderdate - INTERVAL 3 MONTH AS q, o_orderdate + INTERVAL 1 MONTH AS m FROM orders")
tsql_query("rewrite_datediff", "SELECT event_id, DATEDIFF(month, '2023-12-30', ts) AS m, DATEDIFF(day, '2023-12-30', ts) AS d, DATEDIFF(hour, '2023-12-30', ts) AS h FROM events", "SELECT event_id, CAST(date_diff('month', TIMESTAMP '2023-12-30', ts) AS INT) AS m, CAST(date_diff('day', TIMESTAMP '2023-12-30', ts) AS INT) AS d, date_diff('hour', TIMESTAMP '2023-12-30', ts) AS h FROM events")
tsql_query("rewrite_datepart", "SELECT o_orderkey, DATEPART(year, o_orderdate) AS y, DATEPART(weekday, o_orderdate) AS w, DATENAME(month, o_orderdate) AS mn, EOMONTH(o_orderdate) AS e FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(dayofweek(o_orderdate) + 1 AS INT) AS w, monthname(o_orderdate) AS mn, last_day(o_orderdate) AS e FROM orders")
tsql_query("rewrite_charindex", "SELECT p_partkey, CHARINDEX(N'e', p_name) AS pos, PATINDEX('%[0-9]%', p_brand) AS digit, STUFF(p_brand, 1, 5, 'B') AS short_name FROM part", "SELECT p_partkey, CAST(instr(p_name, 'e') AS INT) AS pos, CAST(length(regexp_extract(p_brand, '^[^0-9]*')) + 1 AS INT) AS digit, 'B' || substr(p_brand, 6) AS short_name FROM part")
tsql_query("rewrite_iif_choose", "SELECT o_orderkey, IIF(o_orderstatus = 'F', N'done', N'open') AS label, CHOOSE(DATEPART(quarter, o_orderdate), 'a', 'b', 'c', 'd') AS q FROM orders", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS label, ['a', 'b', 'c', 'd'][quarter(o_orderdate)] AS q FROM orders")
tsql_query("rewrite_format_convert", "SELECT o_orderkey, FORMAT(o_orderdate, 'yyyy-MM-dd') AS d, FORMAT(o_totalprice, 'N1') AS n, CONVERT(VARCHAR(10), o_orderdate, 103) AS british, CONVERT(INT, o_custkey) AS k, TRY_CAST(o_orderpriority AS INT) AS bad FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, format('{:,.1f}', o_totalprice) AS n, strftime(o_orderdate, '%d/%m/%Y') AS british, CAST(o_custkey AS INT) AS k, try_cast(o_orderpriority AS INT) AS bad FROM orders")
tsql_query("rewrite_concat", "SELECT n_nationkey, CONCAT(n_name, N' - ', NULLIF(n_regionkey, 0)) AS shown, n_name + '!' AS loud, QUOTENAME(n_name) AS quoted, REPLICATE('x', 3) AS xs FROM nation", "SELECT n_nationkey, concat(n_name, ' - ', nullif(n_regionkey, 0)) AS shown, n_name || '!' AS loud, '[' || n_name || ']' AS quoted, 'xxx' AS xs FROM nation")
tsql_query("rewrite_apply", "SELECT c.c_custkey, t.o_orderkey FROM customer c CROSS APPLY (SELECT TOP 1 o.o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey) t", "SELECT c.c_custkey, t.o_orderkey FROM customer c, LATERAL (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t")
tsql_query("rewrite_rollup", "SELECT ISNULL(o_orderstatus, 'all') AS s, COUNT(*) AS n FROM orders GROUP BY o_orderstatus WITH ROLLUP", "SELECT coalesce(o_orderstatus, 'all') AS s, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)")
tsql_query("rewrite_cte", "WITH spend AS (SELECT o_custkey, SUM(o_totalprice) AS s FROM dbo.orders GROUP BY o_custkey), big AS (SELECT * FROM spend WHERE s > 2000000) SELECT TOP 10 b.o_custkey, CAST(b.s AS DECIMAL(18, 0)) AS s FROM big b ORDER BY b.s DESC", "SELECT o_custkey, CAST(sum(o_totalprice) AS DECIMAL(18, 0)) AS s FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 2000000 ORDER BY sum(o_totalprice) DESC LIMIT 10", exact=("o_totalprice",), settled=True)
tsql_query("rewrite_recursive", "WITH n AS (SELECT 1 AS i UNION ALL SELECT i + 1 FROM n WHERE i < 20) SELECT i FROM n OPTION (MAXRECURSION 100)", "SELECT CAST(range AS INT) AS i FROM range(1, 21)")
tsql_query("rewrite_variables", "SELECT o_orderkey FROM orders WHERE o_orderstatus = @status AND o_totalprice > @low -- [not a name] 'nor a string", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 400000", status="O", low=400000)
tsql_query("rewrite_literals", "SELECT r_regionkey, 'TOP 5 [x] GETDATE() -- no' AS text FROM region /* ISNULL(a, b) */", "SELECT r_regionkey, 'TOP 5 [x] GETDATE() -- no' AS text FROM region")
tsql_query("rewrite_now", "SELECT r_regionkey, GETDATE() AS now_time, SYSDATETIME() AS s, GETUTCDATE() AS u, NEWID() AS id FROM region")
tsql_query("rewrite_update", "UPDATE dbo.part SET p_retailprice = p_retailprice + 5, p_type = N'CHANGED' WHERE p_size < 10", "SELECT p_partkey, p_name, p_brand, p_size, CASE WHEN p_size < 10 THEN p_retailprice + 5 ELSE p_retailprice END AS p_retailprice, CASE WHEN p_size < 10 THEN 'CHANGED' ELSE p_type END AS p_type FROM part")
tsql_query("rewrite_update_join", "UPDATE o SET o.o_orderstatus = 'X' FROM dbo.orders o INNER JOIN dbo.customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = N'BUILDING'", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority, CASE WHEN c_mktsegment = 'BUILDING' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
tsql_query("rewrite_delete_join", "DELETE o FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal < 0", "SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
tsql_query("rewrite_delete", "DELETE FROM [part] WHERE p_size > 25", "SELECT * FROM part WHERE p_size <= 25")
tsql_query("rewrite_for_json", "SELECT r_regionkey AS id, r_name AS name FROM region WHERE r_regionkey = 1 FOR JSON PATH", """SELECT '[{"id":' || r_regionkey || ',"name":"' || r_name || '"}]' AS json FROM region WHERE r_regionkey = 1""")
tsql_query("rewrite_string_split", "SELECT p.p_partkey, w.value FROM part p CROSS APPLY STRING_SPLIT(p.p_name, ' ') w WHERE w.value <> 'blue'", "SELECT p_partkey, value FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS value FROM part) x WHERE value <> 'blue'")
tsql_query("rewrite_json_value", "SELECT event_id, CAST(JSON_VALUE(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
tsql_query("rewrite_series", "SELECT s.value, COUNT(p.p_partkey) AS n FROM GENERATE_SERIES(1, 50) s LEFT JOIN part p ON p.p_size = s.value GROUP BY s.value", "SELECT CAST(range AS INT) AS value, count(p_partkey) AS n FROM range(1, 51) LEFT JOIN part ON p_size = range GROUP BY range")

_JOINS = "FROM dbo.part p INNER JOIN dbo.lineitem l ON l.l_partkey = p.p_partkey INNER JOIN dbo.supplier s ON s.s_suppkey = l.l_suppkey WHERE s.s_acctbal < 0 AND l.l_returnflag = 'R'"
_HIT = "p_partkey IN (SELECT l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal < 0 AND l_returnflag = 'R')"
tsql_query("rewrite_update_joins", f"UPDATE p SET p.p_retailprice += 1, p.p_type = l.l_returnflag {_JOINS}", f"SELECT p_partkey, p_name, p_brand, p_size, CASE WHEN {_HIT} THEN p_retailprice + 1 ELSE p_retailprice END AS p_retailprice, CASE WHEN {_HIT} THEN 'R' ELSE p_type END AS p_type FROM part")
tsql_query("rewrite_delete_joins", f"DELETE p {_JOINS}", f"SELECT * FROM part WHERE NOT ({_HIT})")
tsql_query("rewrite_update_output", "UPDATE part SET p_retailprice = p_retailprice * 2 OUTPUT inserted.p_partkey, deleted.p_retailprice AS was, inserted.p_retailprice AS now_price INTO @changed WHERE p_size = 1", "SELECT p_partkey, p_retailprice AS was, p_retailprice * 2 AS now_price FROM part WHERE p_size = 1", output=True)
tsql_query("rewrite_delete_output", f"DELETE p OUTPUT deleted.p_partkey, deleted.p_name {_JOINS}", f"SELECT p_partkey, p_name FROM part WHERE {_HIT}", output=True)
_MERGE = "MERGE INTO dbo.supplier AS t USING (SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM customer WHERE c_custkey % 3 = 0) AS s ON t.s_suppkey = s.k WHEN MATCHED AND s.bal < 0 THEN DELETE WHEN MATCHED THEN UPDATE SET t.s_acctbal = t.s_acctbal + s.bal WHEN NOT MATCHED AND s.bal > 9000 THEN INSERT (s_suppkey, s_name, s_acctbal) VALUES (s.k, s.name, s.bal) WHEN NOT MATCHED BY SOURCE AND t.s_acctbal < 0 THEN DELETE"
_MERGED = "supplier t FULL JOIN (SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM customer WHERE c_custkey % 3 = 0) s ON s_suppkey = k"
tsql_query("rewrite_merge", _MERGE, f"""SELECT coalesce(s_suppkey, k) AS s_suppkey, coalesce(s_name, name) AS s_name, s_nationkey, CASE WHEN s_suppkey IS NULL THEN bal WHEN k IS NULL THEN s_acctbal ELSE s_acctbal + bal END AS s_acctbal FROM {_MERGED}
WHERE CASE WHEN s_suppkey IS NULL THEN bal > 9000 WHEN k IS NULL THEN s_acctbal >= 0 ELSE bal >= 0 END""")
tsql_query("rewrite_merge_output", _MERGE + " OUTPUT $action, inserted.s_suppkey AS new_key, deleted.s_suppkey AS old_key;", f"""SELECT * FROM (SELECT CASE WHEN s_suppkey IS NULL THEN CASE WHEN bal > 9000 THEN 'INSERT' END WHEN k IS NULL THEN CASE WHEN s_acctbal < 0 THEN 'DELETE' END WHEN bal < 0 THEN 'DELETE' ELSE 'UPDATE' END AS action, coalesce(s_suppkey, k) AS new_key, s_suppkey AS old_key FROM {_MERGED}) x WHERE action IS NOT NULL""", output=True)
tsql_query("rewrite_for_xml", "SELECT r_regionkey AS [@id], r_name AS name FROM region WHERE r_regionkey = 2 FOR XML PATH('area'), ROOT('areas')", "SELECT '<areas><area id=\"2\"><name>' || r_name || '</name></area></areas>' AS xml FROM region WHERE r_regionkey = 2")
tsql_query("rewrite_cube", "SELECT o_orderstatus AS s, o_orderpriority AS p, COUNT(*) AS n, GROUPING(o_orderstatus) AS g FROM dbo.orders GROUP BY o_orderstatus, o_orderpriority WITH CUBE", "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n, CAST(grouping(o_orderstatus) AS TINYINT) AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
tsql_query("rewrite_try_cast", "SELECT event_id, TRY_CAST(event_type AS INT) AS bad, TRY_CONVERT(DECIMAL(10, 2), value) AS good FROM events", "SELECT event_id, try_cast(event_type AS INT) AS bad, try_cast(value AS DECIMAL(10, 2)) AS good FROM events")
tsql_query("rewrite_concat_ws", "SELECT n_nationkey, CONCAT_WS('-', n_name, NULL, CAST(n_regionkey AS VARCHAR(5))) AS shown FROM nation", "SELECT n_nationkey, concat_ws('-', n_name, NULL, n_regionkey) AS shown FROM nation")


@query("rewrite_select_into", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment")
def rewrite_select_into(spark, sf_dir):
    """SELECT ... INTO makes a table, which is then read."""
    name = table_name(spark, "segments")
    made = transpile(f"SELECT c_mktsegment, COUNT(*) AS n INTO {name} FROM dbo.customer WHERE c_acctbal > 0 GROUP BY c_mktsegment")
    views(spark, sf_dir, "customer")
    spark.sql(made.sql)
    return spark.table(name)


# texts of the other direction are plain Spark SQL already, but for a function and quoted names
tsql_query("reverse_limit_coalesce", 'SELECT "c_name", coalesce("c_mktsegment", \'none\') AS s, length(c_name) AS n FROM customer ORDER BY c_custkey LIMIT 7', "SELECT c_name, coalesce(c_mktsegment, 'none') AS s, CAST(length(c_name) AS INT) AS n FROM customer ORDER BY c_custkey LIMIT 7")
tsql_query("reverse_uuid_now", "SELECT r_regionkey, gen_random_uuid() AS id, now() AS at FROM region")
tsql_query("reverse_uuid_distinct", "SELECT COUNT(DISTINCT x.id) AS n, MIN(length(x.id)) AS len FROM (SELECT gen_random_uuid() AS id FROM customer) x", "SELECT count(*) AS n, 36 AS len FROM customer")


def both_ways(name: str, sql: str, oracle: str) -> None:
    """Registers a query of the PostgreSQL kind, run by way of its T-SQL."""

    def run(spark, sf_dir):
        made = transpile(to_tsql(sql)).sql
        views(spark, sf_dir, made)
        return spark.sql(made)

    QUERIES[name], ORACLES[name] = run, oracle


both_ways("reverse_limit_to_top", 'SELECT "c_name", c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 9', "SELECT c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 9")
both_ways("reverse_offset_to_fetch", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10 OFFSET 30", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10 OFFSET 30")
both_ways("reverse_functions", "SELECT c_custkey, COALESCE(nullif(c_mktsegment, 'BUILDING'), 'none') AS s, COALESCE(NULL, NULL, c_name) AS n, LENGTH(c_name) AS len, now() > TIMESTAMP '2020-01-01' AS later, length(gen_random_uuid()) AS u FROM customer", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS s, c_name AS n, CAST(length(c_name) AS INT) AS len, true AS later, 36 AS u FROM customer")
both_ways("reverse_subquery", 'SELECT n_name FROM nation WHERE "n_regionkey" IN (SELECT "r_regionkey" FROM region ORDER BY r_name DESC LIMIT 2)', "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region ORDER BY r_name DESC LIMIT 2)")
