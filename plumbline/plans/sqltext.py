"""What SQL texts hold and how well they would move to another database, as queries over sql_corpus(id, sql).

Everything is a regular-expression count or a flag per text, so it scales with the number of texts and stays in one
stage. The scores are sums over such flags. The same templates give the query and its oracle; only the spelling of
regular-expression functions differs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import ORACLES, QUERIES, query, table

#: Texts with the features that the rules below look for.
CORPUS = [
    (1, "SELECT c.name, o.total FROM customers c INNER JOIN orders o ON c.id = o.customer_id WHERE o.total > 100 ORDER BY o.total DESC"),
    (2, "SELECT TOP 10 * FROM orders ORDER BY created_at DESC"),
    (3, "SELECT TOP 5 PERCENT name FROM products ORDER BY price"),
    (4, "SELECT ISNULL(phone, 'none') AS phone, LEN(name) AS n FROM [customers] WHERE GETDATE() > created_at"),
    (5, "WITH spend AS (SELECT customer_id, SUM(total) AS s FROM orders GROUP BY customer_id) SELECT * FROM spend WHERE s > 1000"),
    (6, "MERGE INTO inventory AS t USING products AS s ON t.product_id = s.id WHEN MATCHED THEN UPDATE SET quantity = 1"),
    (7, "SELECT region, COUNT(*) FROM customers GROUP BY region WITH ROLLUP HAVING COUNT(*) > 3"),
    (8, "SELECT name, ROW_NUMBER() OVER (PARTITION BY region ORDER BY total DESC) AS rn FROM customers"),
    (9, "SELECT DATEADD(day, 7, GETDATE()), DATEDIFF(month, a, b), DATEPART(year, c) FROM events"),
    (10, "SELECT a.x FROM a FULL OUTER JOIN b ON a.id = b.id RIGHT JOIN c ON b.id = c.id CROSS JOIN d"),
    (11, "SELECT name FROM products WHERE id IN (SELECT product_id FROM order_items WHERE quantity > 5) UNION SELECT name FROM categories"),
    (12, "UPDATE orders SET status = 'DONE' WHERE id = 5"),
    (13, "DELETE FROM sessions WHERE created_at < '2024-01-01' -- old ones"),
    (14, "DROP TABLE logs"),
    (15, "SELECT * FROM orders WITH (NOLOCK) WHERE notes = NULL"),
    (16, "/* report */ SELECT DISTINCT status FROM orders"),
    (17, "SELECT t.name FROM sys.tables t JOIN sys.columns c ON t.object_id = c.object_id"),
    (18, "BEGIN TRANSACTION; UPDATE payments SET amount = 0; COMMIT"),
    (19, "SELECT id FROM users LIMIT 20 OFFSET 40"),
    (20, "SELECT * INTO #recent FROM orders WHERE created_at >= DATEADD(month, -1, GETDATE())"),
    (21, "GRANT SELECT ON orders TO analyst"),
    (22, "SELECT CAST(total AS INT) / 2, CONVERT(VARCHAR(10), created_at, 120) FROM orders NATURAL JOIN customers"),
    (23, "INSERT INTO products (name) OUTPUT inserted.id VALUES ('x')"),
    (24, "SELECT id, STUFF(name, 1, 2, ''), CHARINDEX('a', name), NEWID() FROM products FOR JSON PATH"),
]


def corpus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CORPUS, "id long, sql string")


VALUES = "sql_corpus(id, sql) AS (SELECT CAST(a AS BIGINT), b FROM (VALUES " + ", ".join("({}, '{}')".format(i, s.replace("'", "''")) for i, s in CORPUS) + ") v(a, b))"
TOKEN = re.compile(r"#(n|has|strip)\{(.*?)\}#")


def spell(template: str, engine: str) -> str:
    """#n{pattern}# counts matches in u (the text without comments, in upper case), #has{pattern}# tests for one."""

    def one(m: re.Match) -> str:
        p = m[2].replace("'", "''") if engine == "duckdb" else m[2]
        if m[1] == "n":
            return f"CAST(regexp_count(u, r'{p}') AS BIGINT)" if engine == "spark" else f"CAST(len(regexp_extract_all(u, '{p}')) AS BIGINT)"
        return f"(u RLIKE r'{p}')" if engine == "spark" else f"regexp_matches(u, '{p}')"

    return TOKEN.sub(one, template)


STRIP = {
    "spark": r"trim(regexp_replace(regexp_replace(regexp_replace(sql, r'--[^\n]*', ''), r'(?s)/\*.*?\*/', ''), r'\s+', ' '))",
    "duckdb": r"trim(regexp_replace(regexp_replace(regexp_replace(sql, '--[^\n]*', '', 'g'), '(?s)/\*.*?\*/', '', 'g'), '\s+', ' ', 'g'))",
}


#: Per query its template and prelude.
TEMPLATES: dict[str, tuple[str, str]] = {}
#: A statement an order, put together from pieces by its key, for the same queries over many texts.
PIECES = (
    ["o.total, COUNT(*)", "TOP 10 o.name", "TOP 5 PERCENT o.name", "ISNULL(o.phone, 0), LEN(o.name)", "DATEADD(day, 7, GETDATE())", "ROW_NUMBER() OVER (ORDER BY o.total) AS rn"],
    ["orders o", "[orders] o WITH (NOLOCK)", "users o"],
    ["", " INNER JOIN customers c ON c.id = o.id", " FULL OUTER JOIN logs c ON c.id = o.id CROSS JOIN sessions d", " NATURAL JOIN payments c", " LEFT JOIN products c ON c.id = o.id JOIN categories d ON d.id = c.id"],
    ["", " WHERE o.notes = NULL", " WHERE o.id IN (SELECT id FROM users) -- checked", " WHERE o.total > 5 ORDER BY o.total", " GROUP BY o.total WITH ROLLUP", " UNION SELECT CAST(a AS INT), SUM(b) FROM inventory", " /* MERGE */"],
)
_STATEMENT = "concat('SELECT ', " + ", ' FROM ', ".join([f"({{0}})[{{1}}o_orderkey % {len(PIECES[0])}{{2}}]", " , ".join(f"({{{3 + i}}})[{{1}}o_orderkey % {len(p)}{{2}}]" for i, p in enumerate(PIECES[1:]))]) + ")"


def statements(engine: str) -> str:
    """SELECT id, sql of a statement an order."""
    lists = [("array(" if engine == "spark" else "[") + ", ".join("'" + x + "'" for x in p) + (")" if engine == "spark" else "]") for p in PIECES]
    before, after = ("CAST(", " AS INT)") if engine == "spark" else ("CAST(", " AS INT) + 1")
    return f"SELECT o_orderkey AS id, {_STATEMENT.format(lists[0], before, after, *lists[1:])} AS sql FROM orders"


def full(name: str, engine: str, given: str) -> str:
    """The query over s(id, sql, clean, u); given: common table expressions in front, ending in a comma."""
    template, prelude = TEMPLATES[name]
    base = f"s AS (SELECT id, sql, {STRIP[engine]} AS clean, upper({STRIP[engine]}) AS u FROM sql_corpus)"
    return f"WITH {given}{base}{', ' + spell(prelude, engine) if prelude else ''} {spell(template, engine)}"


def analyse(texts: DataFrame, name: str) -> DataFrame:
    """The query of that name over any texts (id, sql)."""
    texts.createOrReplaceTempView("sql_corpus")
    return texts.sparkSession.sql(full(name, "spark", ""))


def text_query(name: str, template: str, prelude: str = "") -> None:
    """Registers a query over s(id, sql, clean, u). prelude: further common table expressions, ending in a comma."""
    TEMPLATES[name] = template, prelude
    QUERIES[name], ORACLES[name] = lambda spark, sf_dir: analyse(corpus(spark), name), full(name, "duckdb", f"{VALUES}, ")


def rows_query(name: str) -> None:
    """Registers the query of that name over a statement an order."""

    def run(spark, sf_dir):
        table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
        return analyse(spark.sql(statements("spark")), name)

    QUERIES[f"{name}_rows"], ORACLES[f"{name}_rows"] = run, full(name, "duckdb", f"sql_corpus AS ({statements('duckdb')}), ")


#: Deductions, weights and thresholds (fixed values).
MSSQL_DATES = ("GETDATE", "GETUTCDATE", "DATEADD", "DATEDIFF", "DATEPART", "DATENAME")
WINDOWS = "ROW_NUMBER|RANK|DENSE_RANK|NTILE|LAG|LEAD|FIRST_VALUE|LAST_VALUE|SUM|AVG|COUNT|MIN|MAX"
NONSTANDARD = ("GETDATE", "GETUTCDATE", "ISNULL", "LEN", "NEWID", "CHARINDEX", "DATEADD", "DATEDIFF", "DATEPART", "PATINDEX", "STUFF", "REPLICATE", "SPACE", "SCOPE_IDENTITY")
SYSTEM = r"SYS\.(TABLES|COLUMNS|INDEXES|SCHEMAS|VIEWS|PROCEDURES)|INFORMATION_SCHEMA|@@(ROWCOUNT|IDENTITY|ERROR|VERSION|TRANCOUNT)"
DEPRECATED = r"TEXTIMAGE_ON|WITH \(NOLOCK\)|WITH \(READUNCOMMITTED\)|FILESTREAM"

_n_dates = " + ".join(f"CAST(#has{{\\b{f}\\s*\\(}}# AS INT)" for f in MSSQL_DATES)
_n_odd = " + ".join(f"CAST(#has{{\\b{f}\\s*\\(}}# AS INT)" for f in NONSTANDARD)
_flag = lambda p: f"CAST(#has{{{p}}}# AS INT)"

#: One row a text: what it has, as 0/1 or counts.
FEATURES = f"""f AS (SELECT id, sql, u, #n{{\\bJOIN\\b}}# AS joins, {_flag(r'\b(FULL|RIGHT)( OUTER)? JOIN\b')} AS odd_join, {_flag(r'\bGROUP BY\b')} AS grouped, #n{{\\b(SUM|AVG|COUNT|MIN|MAX)\\s*\\(}}# AS aggs,
 #n{{\\b({WINDOWS})\\s*\\([^()]*\\)\\s*OVER\\s*\\(}}# AS windows, #n{{\\(\\s*SELECT\\b}}# AS subqueries, {_flag(r'^SELECT TOP [0-9]+')} AS top_n, {_flag(r'SELECT TOP [0-9]+ PERCENT')} AS top_percent,
 {_flag(r'\bLIMIT [0-9]+|\bOFFSET [0-9]+|FETCH (FIRST|NEXT)')} AS limited, {_flag(r'\bMERGE\b')} AS merges, {_n_dates} AS mssql_dates, {_flag(r'\bSYSDATE\b|\bNOW\s*\(')} AS other_dates, {_flag(r'\bWITH [A-Z_0-9]+ AS ?\(')} AS ctes,
 #n{{\\bUNION\\b}}# AS unions, {_flag(r'\bORDER BY\b')} AS ordered, {_flag(r'\bHAVING\b')} AS having_clause, {_flag(r'SELECT DISTINCT\b')} AS distincts FROM s)"""

text_query("sql_strip", "SELECT id, clean FROM s")
text_query("sql_stmt_type", "SELECT id, CASE WHEN #has{^(SELECT|INSERT|UPDATE|DELETE|MERGE|WITH)\\b}# THEN 'DML' WHEN #has{^(CREATE|ALTER|DROP|TRUNCATE|RENAME)\\b}# THEN 'DDL' WHEN #has{^(GRANT|REVOKE)\\b}# THEN 'DCL' WHEN #has{^(BEGIN|COMMIT|ROLLBACK|SAVEPOINT)\\b}# THEN 'TCL' ELSE 'UNKNOWN' END AS kind FROM s")
text_query("sql_classify", "SELECT id, joins, grouped, aggs, windows, subqueries, top_n, top_percent, limited, merges, mssql_dates, ctes, unions, ordered, having_clause, distincts FROM f", FEATURES)
_complexity = "2 * CAST(subqueries > 0 AS INT) + 3 * CAST(windows > 0 AS INT) + CAST(joins > 0 AS INT) + 2 * CAST(joins > 2 AS INT) + 3 * merges + 2 * ctes + CAST(unions > 0 AS INT)"
text_query("sql_complexity", f"SELECT id, CAST({_complexity} AS INT) AS points, CASE WHEN {_complexity} <= 1 THEN 'simple' WHEN {_complexity} <= 4 THEN 'medium' ELSE 'complex' END AS grade FROM f", FEATURES)

#: Risk by feature: medium ones, the window functions (high), a percentage TOP (high) and MERGE (blocker).
SCORED = FEATURES + """, r AS (SELECT *, odd_join + CAST(subqueries > 0 AS INT) + CAST(top_n = 1 AND top_percent = 0 AS INT) + CAST(mssql_dates > 0 AS INT) AS mediums, CAST(windows > 0 AS INT) AS windowed FROM f),
 p AS (SELECT *, greatest(0, 100 - 50 * merges - 10 * windowed - 30 * top_percent - 15 * mediums) AS syntax_score, greatest(0, 100 - 20 * mssql_dates) AS function_score, greatest(0, 100 - 50 * merges - 15 * mediums) AS feature_score,
 greatest(0, CASE WHEN mediums + windowed + top_percent + merges = 0 THEN 100 ELSE 100 - 15 - 40 * merges - 20 * (windowed + top_percent) END) AS rewrite_score FROM r),
 t AS (SELECT *, round((30 * syntax_score + 25 * function_score + 25 * feature_score + 20 * rewrite_score) / 100.0, 1) AS total FROM p)"""
_risk = "CASE WHEN merges > 0 OR total < 50 THEN 'BLOCKER' WHEN windowed + top_percent > 0 OR total < 70 THEN 'HIGH' WHEN mediums > 0 OR total < 85 THEN 'MEDIUM' WHEN grouped + aggs + ctes + unions + distincts + other_dates > 0 OR total < 95 THEN 'LOW' ELSE 'NONE' END"
text_query("sql_compat_score", f"SELECT id, CAST(syntax_score AS BIGINT) AS syntax_score, CAST(function_score AS BIGINT) AS function_score, CAST(feature_score AS BIGINT) AS feature_score, CAST(rewrite_score AS BIGINT) AS rewrite_score, CAST(total AS DOUBLE) AS total, {_risk} AS risk FROM t", SCORED)
text_query("sql_flags", f"SELECT id, #has{{\\bTOP\\b}}# AS has_top, #has{{\\bFETCH (FIRST|NEXT)\\b}}# AS has_fetch, #has{{\\[[A-Z_]+\\]}}# AS has_brackets, #has{{WITH ROLLUP|ROLLUP ?\\(}}# AS has_rollup, #has{{WITH CUBE|CUBE ?\\(}}# AS has_cube, #has{{SELECT .* INTO #}}# AS has_select_into, #has{{\\bOUTPUT (INSERTED|DELETED)}}# AS has_output, #has{{FOR (XML|JSON)}}# AS has_for_doc, #has{{{DEPRECATED}}}# AS has_hint FROM s")
text_query("sql_guard", "SELECT id, #has{^(SELECT|SHOW|EXPLAIN|DESCRIBE|DESC|WITH)\\b}# AND NOT #has{\\b(DROP|ALTER|TRUNCATE|CREATE|INSERT|UPDATE|DELETE|GRANT|REVOKE|EXECUTE|EXEC|CALL|MERGE|REPLACE)\\b}# AS allowed FROM s")
text_query("hint_strip", "SELECT id, #n{ WITH \\((NOLOCK|READUNCOMMITTED|ROWLOCK|UPDLOCK|HOLDLOCK|TABLOCK)\\)}# AS hints, replace(u, ' WITH (NOLOCK)', '') AS without_hints FROM s")
text_query("detect_rewrites", f"SELECT id, #has{{\\bTOP [0-9]+}}# AS top_to_limit, #has{{\\bISNULL\\s*\\(}}# AS isnull_to_coalesce, #has{{\\bGETDATE\\s*\\(}}# AS getdate_to_now, #has{{\\bLEN\\s*\\(}}# AS len_to_length, #has{{\\[[A-Z_]+\\]}}# AS brackets_to_quotes, #has{{\\bCHARINDEX\\s*\\(}}# AS charindex_to_position, #has{{\\bNEWID\\s*\\(}}# AS newid_to_uuid FROM s")
text_query("sql_functions", "SELECT id, array_join(array_sort(array_distinct(transform(regexp_extract_all(u, r'\\b([A-Z_]+) ?\\(', 1), x -> x))), ',') AS functions FROM s")
ORACLES["sql_functions"] = f"WITH {VALUES}, s AS (SELECT id, sql, upper({STRIP['duckdb']}) AS u FROM sql_corpus) SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(u, '\\b([A-Z_]+) ?\\(', 1))), ',') AS functions FROM s"
text_query("sql_tables", "SELECT id, array_join(array_sort(array_distinct(regexp_extract_all(u, r'\\b(?:FROM|JOIN|UPDATE|INTO|USING)\\s+([A-Z_.#\\[\\]]+)', 1))), ',') AS tables FROM s")
ORACLES["sql_tables"] = f"WITH {VALUES}, s AS (SELECT id, sql, upper({STRIP['duckdb']}) AS u FROM sql_corpus) SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(u, '\\b(?:FROM|JOIN|UPDATE|INTO|USING)\\s+([A-Z_.#\\[\\]]+)', 1))), ',') AS tables FROM s"
text_query("sql_joins", "SELECT id, #n{\\bINNER JOIN\\b}# AS inner_joins, #n{\\bLEFT( OUTER)? JOIN\\b}# AS left_joins, #n{\\bRIGHT( OUTER)? JOIN\\b}# AS right_joins, #n{\\bFULL( OUTER)? JOIN\\b}# AS full_joins, #n{\\bCROSS JOIN\\b}# AS cross_joins, #n{\\bNATURAL JOIN\\b}# AS natural_joins, #n{\\bJOIN\\b}# AS joins FROM s")
text_query("sql_score_syntax", f"SELECT id, CAST(greatest(0, 100 - 10 * ({_n_odd}) - 10 * CAST(#has{{\\[[A-Z_]+\\]}}# AS INT) - 15 * CAST(#has{{\\bTOP [0-9]+}}# AS INT)) AS INT) AS score FROM s")
text_query("score_risk", f"SELECT id, CAST(greatest(0, 100 - least(15 * ({_n_odd}), 60) - 30 * {_flag(r'\bTOP [0-9]+')} - 20 * {_flag(r'\[[A-Z_]+\]')} - 40 * {_flag(SYSTEM)} - 20 * {_flag(DEPRECATED)}) AS INT) AS score FROM s")
text_query("sql_diagnose", f"SELECT severity, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN #has{{\\bMERGE\\b|{SYSTEM}}}# THEN 'CRITICAL' WHEN #has{{\\bPERCENT\\b|\\bOUTPUT (INSERTED|DELETED)|FOR (XML|JSON)}}# THEN 'HIGH' WHEN ({_n_odd}) > 0 OR #has{{\\[[A-Z_]+\\]|\\bTOP [0-9]+}}# THEN 'MEDIUM' ELSE 'NONE' END AS severity FROM s) x GROUP BY severity")
text_query("join_chain_score", "SELECT id, CAST(5 * (#n{\\bJOIN\\b}# + 1) + 20 * #n{\\bFULL( OUTER)? JOIN\\b}# + 10 * #n{\\bCROSS JOIN\\b}# + 25 * #n{\\bNATURAL JOIN\\b}# AS BIGINT) AS points FROM s WHERE #has{\\bJOIN\\b}#")

#: Findings by severity, then the feasibility of a migration and what follows from it.
FOUND = FEATURES + f""", g AS (SELECT id, merges + {_flag(SYSTEM)} AS criticals, top_percent + CAST(windows > 0 AS INT) AS highs, ({_n_odd}) + {_flag(r'\[[A-Z_]+\]')} + odd_join AS mediums, 0.9 AS conf FROM f),
 m AS (SELECT *, round(greatest(0, 100 - 20 * criticals - 10 * highs - 3 * mediums) * (CASE WHEN mediums > 0 THEN 0.5 + 0.5 * conf ELSE 1 END), 1) AS score FROM g)"""
text_query("migration_score", "SELECT id, CAST(score AS DOUBLE) AS score, CASE WHEN score > 85 THEN 'SAFE_AUTO_MIGRATION' WHEN score >= 70 THEN 'NEED_REVIEW' ELSE 'HIGH_RISK' END AS advice FROM m", FOUND)

SIZES = {"USERS": 5000, "ORDERS": 50000, "PRODUCTS": 2000, "ORDER_ITEMS": 200000, "CATEGORIES": 100, "LOGS": 1000000, "SESSIONS": 500000, "PAYMENTS": 30000, "INVENTORY": 10000, "CUSTOMERS": 20000}
_size = "greatest(CASE WHEN #has{\\b(FROM|JOIN|UPDATE|INTO|USING)\\b}# THEN 10000 ELSE 0 END, " + ", ".join(f"CASE WHEN #has{{\\b(FROM|JOIN|UPDATE|INTO|USING)\\s+{t}\\b}}# THEN {n} ELSE 0 END" for t, n in SIZES.items()) + ")"
text_query("sim_cardinality", f"SELECT id, CAST(floor({_size} * (1 + 0.2 * #n{{\\bLEFT( OUTER)? JOIN\\b}}# + 0.5 * #n{{\\bFULL( OUTER)? JOIN\\b}}#)) AS BIGINT) AS rows_estimated FROM s")
_fail = f"""CAST(#has{{= NULL|<> NULL}}# AS INT) AS null_compare, CAST(#has{{\\bTOP [0-9]+}}# AND NOT #has{{\\bORDER BY\\b}}# AS INT) AS paging, {_flag(r'GETDATE|GETUTCDATE|SYSDATETIME')} AS time_zone, CAST(#n{{\\bJOIN\\b}}# > 1 AS INT) AS multiplicity,
 {_flag(r'\b(LEN|ISNULL|DATEDIFF)\s*\(')} AS semantics, {_flag(r'\bCAST\b|\bCONVERT\b')} AS casts, {_flag(r'\b(SUM|AVG)\s*\(')} AS agg_order"""
text_query("sim_failures", f"SELECT id, {_fail} FROM s")
SIMULATED = f"""x AS (SELECT id, {_fail} FROM s), y AS (SELECT *, null_compare AS highs, paging + multiplicity + semantics + time_zone AS mediums, casts + agg_order AS lows FROM x),
 z AS (SELECT *, greatest(0, least(1, round(1 - 0.08 * highs - 0.04 * mediums - 0.01 * lows, 4))) AS score FROM y)"""
_level = "CASE WHEN score >= 0.95 AND highs = 0 AND mediums <= 1 THEN 'NONE' WHEN score >= 0.90 AND highs = 0 THEN 'LOW' WHEN score >= 0.80 AND highs <= 1 THEN 'MEDIUM' WHEN score >= 0.60 THEN 'HIGH' ELSE 'CRITICAL' END"
text_query("sim_verdict", f"SELECT id, CAST(score AS DOUBLE) AS score, {_level} AS risk, CASE WHEN score >= 0.95 AND highs = 0 AND mediums <= 1 THEN 'SAFE_TO_EXECUTE' WHEN score >= 0.88 AND {_level} IN ('NONE', 'LOW', 'MEDIUM') THEN 'SAFE_TO_EXECUTE_WITH_MONITORING' WHEN score >= 0.70 THEN 'NEEDS_MANUAL_REVIEW' ELSE 'HIGH_RISK_DO_NOT_EXECUTE' END AS verdict FROM z", SIMULATED)
text_query("sim_drift", "SELECT id, CASE WHEN highs > 0 THEN 'MODERATE_DRIFT' WHEN mediums > 1 THEN 'LOW_DRIFT' ELSE 'STABLE' END AS drift, semantics > 0 AS null_semantics_differ, agg_order = 0 AS aggregates_stable, paging = 0 AS ordering_stable, casts > 0 AS coerced FROM y", SIMULATED)

#: Confidence: engine weights .20/.25/.25/.30, shared out anew where an engine has no say.
DECIDED = FOUND + f""", {SIMULATED}, k AS (SELECT m.id, m.score AS points, m.criticals, m.highs, z.score AS sim, greatest(0, 1 - 0.05 * m.highs - 0.15 * m.criticals) AS diag, CASE WHEN m.mediums > 0 THEN 0.9 ELSE NULL END AS rewrite_conf FROM m JOIN z ON m.id = z.id),
 c AS (SELECT *, round(CASE WHEN rewrite_conf IS NULL THEN (0.20 * diag + 0.0025 * points + 0.30 * sim) / 0.75 ELSE 0.20 * diag + 0.25 * rewrite_conf + 0.0025 * points + 0.30 * sim END, 4) AS confidence FROM k)"""
text_query("kernel_confidence", "SELECT id, CAST(confidence AS DOUBLE) AS confidence FROM c", DECIDED)
text_query("kernel_risks", "SELECT id, CASE WHEN criticals > 0 THEN 'CRITICAL' WHEN highs > 0 THEN 'HIGH' WHEN sim < 0.95 THEN 'MEDIUM' ELSE 'LOW' END AS worst, criticals > 0 AS blocking FROM c", DECIDED)
text_query("kernel_decision", "SELECT id, CASE WHEN criticals > 0 OR points < 70 OR confidence < 0.5 OR sim < 0.70 THEN 'BLOCK' WHEN points < 85 OR confidence < 0.8 OR highs > 0 OR sim < 0.88 THEN 'REVIEW' ELSE 'SAFE' END AS decision FROM c", DECIDED)

for _name in ("sql_classify", "sql_complexity", "sql_compat_score", "sql_score_syntax", "score_risk", "sql_joins", "migration_score", "sim_failures", "sim_verdict", "kernel_confidence", "kernel_decision"):
    rows_query(_name)

# --- scores from results of runs: a row a text and database ---
RUNS = [(1, "source", True, 10, "", 0), (1, "pg", True, 10, "", 0), (1, "oracle", True, 10, "", 3), (2, "source", True, 10, "", 0), (2, "pg", False, 0, "syntax error near TOP", 0), (2, "oracle", False, 0, "connection refused", 0), (3, "source", True, 5, "", 0), (3, "pg", True, 4, "", 120), (3, "oracle", False, 0, "function does not exist", 0)]
_RUNS = "runs(id, db, success, n_rows, error, value_diffs) AS (SELECT CAST(a AS BIGINT), b, c, CAST(d AS BIGINT), e, CAST(f AS BIGINT) FROM (VALUES " + ", ".join(f"({a}, '{b}', {str(c).lower()}, {d}, '{e}', {f})" for a, b, c, d, e, f in RUNS) + ") v(a, b, c, d, e, f))"
_DIALECT = "syntax|parse|unsupported|not supported|does not exist|invalid"


def runs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RUNS, "id long, db string, success boolean, n_rows long, error string, value_diffs long")


def execution_score(df: DataFrame) -> DataFrame:
    """Share of runs that succeeded, less 10 for each database that failed by dialect."""
    ok, dialect = F.count_if("success"), F.count_if(~F.col("success") & F.lower("error").rlike(_DIALECT))
    return df.groupBy("id").agg(F.round(F.greatest(ok * 100.0 / F.count(F.lit(1)) - dialect * 10, F.lit(0.0)), 1).alias("score"))


@query("score_execution", f"WITH {_RUNS} SELECT id, round(greatest(count(*) FILTER (success) * 100.0::DOUBLE / count(*) - 10 * count(*) FILTER (NOT success AND regexp_matches(lower(error), '{_DIALECT}')), 0), 1) AS score FROM runs GROUP BY id")
def score_execution(spark, sf):
    return execution_score(runs(spark))


def result_score(df: DataFrame) -> DataFrame:
    """0 with fewer than two results; else less 30 for differing row counts and half a point a value, 40 at most."""
    good = F.col("success")
    n, counts = F.count_if(good), F.count_distinct(F.when(good, F.col("n_rows")))
    score = 100.0 - F.when(counts > 1, 30.0).otherwise(0.0) - F.least(F.sum("value_diffs") * 0.5, F.lit(40.0))
    return df.groupBy("id").agg(F.when(n < 2, 0.0).otherwise(score).alias("score"))


@query("score_result", f"WITH {_RUNS} SELECT id, CASE WHEN count(*) FILTER (success) < 2 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE - CASE WHEN count(DISTINCT n_rows) FILTER (success) > 1 THEN 30 ELSE 0 END - least(CAST(sum(value_diffs) AS DOUBLE) * 0.5, 40) END AS score FROM runs GROUP BY id")
def score_result(spark, sf):
    return result_score(runs(spark))


@query("score_total", f"""WITH {_RUNS}, e AS (SELECT id, round(greatest(count(*) FILTER (success) * 100.0::DOUBLE / count(*) - 10 * count(*) FILTER (NOT success AND regexp_matches(lower(error), '{_DIALECT}')), 0), 1) AS e FROM runs GROUP BY id),
 r AS (SELECT id, CASE WHEN count(*) FILTER (success) < 2 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE - CASE WHEN count(DISTINCT n_rows) FILTER (success) > 1 THEN 30 ELSE 0 END - least(CAST(sum(value_diffs) AS DOUBLE) * 0.5, 40) END AS r FROM runs GROUP BY id)
 SELECT id, round(0.30 * 100 + 0.30 * e + 0.25 * r + 0.15 * 100, 1) AS total, CASE WHEN 45 + 0.30 * e + 0.25 * r >= 90 THEN 'LOW' WHEN 45 + 0.30 * e + 0.25 * r >= 70 THEN 'MEDIUM' WHEN 45 + 0.30 * e + 0.25 * r >= 50 THEN 'HIGH' ELSE 'CRITICAL' END AS level FROM e JOIN r USING (id)""")
def score_total(spark, sf):
    """Weighted .30 syntax, .30 execution, .25 result, .15 risk; syntax and risk are full for these texts."""
    both = execution_score(runs(spark)).withColumnRenamed("score", "e").join(result_score(runs(spark)).withColumnRenamed("score", "r"), "id")
    total = 45.0 + 0.30 * F.col("e") + 0.25 * F.col("r")
    level = F.when(total >= 90, "LOW").when(total >= 70, "MEDIUM").when(total >= 50, "HIGH").otherwise("CRITICAL")
    return both.select("id", F.round(total, 1).alias("total"), level.alias("level"))
