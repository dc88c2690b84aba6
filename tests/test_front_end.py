"""The T-SQL front end and the procedure compiler."""

import pytest

from plumbline.plans import procedures as P
from plumbline.plans.lexer import batches, tokenize, tree
from plumbline.plans.transpile import transpile


@pytest.mark.parametrize(
    "sql, want, rules",
    [
        ("SELECT TOP 5 a FROM t ORDER BY a", "SELECT a FROM t ORDER BY a LIMIT 5", ["top_to_limit"]),
        ("SELECT [a b], x FROM [dbo].[t]", "SELECT `a b`, x FROM `dbo`.`t`", ["brackets"]),
        ("SELECT ISNULL(a, ISNULL(b, N'x')) FROM t", "SELECT coalesce(a, coalesce(b, 'x')) FROM t", ["national_strings", "isnull"]),
        ("SELECT LEN(LTRIM(a)) FROM t", "SELECT length(rtrim(LTRIM ( a ))) FROM t".replace("LTRIM ( a )", "LTRIM (a)"), ["len"]),
        ("SELECT a FROM t WITH (NOLOCK)", "SELECT a FROM t", ["hints"]),
        ("SELECT a INTO #x FROM t", "CREATE TABLE x USING parquet AS SELECT a FROM t", ["select_into"]),
        ("SELECT a FROM t ORDER BY a OFFSET 0 ROWS FETCH NEXT 3 ROWS ONLY", "SELECT a FROM t ORDER BY a LIMIT 3", ["offset_fetch"]),
        ("SELECT DATEADD(mm, -2, d) FROM t", "SELECT timestampadd(MONTH, -2, d) FROM t", ["dateadd"]),
        ("SELECT CONVERT(DECIMAL(10, 2), x) FROM t", "SELECT CAST(x AS DECIMAL(10,2)) FROM t", ["convert"]),
        ("SELECT a FROM t WHERE x IN (SELECT TOP 1 y FROM u)", "SELECT a FROM t WHERE x IN (SELECT y FROM u LIMIT 1)", ["top_to_limit"]),
        ("SELECT 'it''s [x] TOP 1 GETDATE()' AS a FROM t -- ISNULL(a, b)", r"SELECT 'it\'s [x] TOP 1 GETDATE()' AS a FROM t", []),
    ],
)
def test_transpile(sql, want, rules):
    got = transpile(sql)
    assert got.sql == want and sorted(got.applied) == sorted(rules)


def test_confidence_is_a_geometric_mean():
    r = transpile("SELECT TOP 3 ISNULL(a, 0) FROM t")
    assert r.confidence == pytest.approx(0.98, abs=1e-3) and transpile("SELECT a FROM t").confidence == 1.0
    assert transpile("SELECT @@IDENTITY AS i FROM t").warnings and transpile("MERGE INTO t USING s ON t.k = s.k WHEN MATCHED THEN DELETE").warnings
    assert transpile("MERGE INTO t USING s ON t.k = s.k WHEN MATCHED THEN DELETE").sql.startswith("SELECT t.* EXCEPT (_t) FROM")


def test_it_is_stable():
    for sql in ("SELECT a, coalesce(b, 0) FROM t WHERE c = 'x' ORDER BY a LIMIT 5", "SELECT count(*) FROM t"):
        once = transpile(sql).sql
        assert transpile(once).sql == once


def test_errors():
    for bad in ("", "SELECT (a FROM t", "SELECT a) FROM t"):
        with pytest.raises(ValueError):
            transpile(bad)


def test_lexer():
    assert [t.kind for t in tokenize("SELECT [a]]b], N'x''y', \"q\", @v, 1.5e3 /* c */ -- d")] == ["word", "bracket", "op", "string", "op", "quoted", "op", "variable", "op", "number"]
    assert len(tree(tokenize("a (b (c), d)"))) == 2
    assert batches("SELECT 1\nGO\nSELECT 2\ngo;\n") == ["SELECT 1", "SELECT 2"]


def test_parse_procedure():
    p = P.parse(P.ORDER_COUNT)
    assert p.name == "OrderCount" and [(n, t) for n, t, _ in p.parameters] == [("status", "CHAR (1)"), ("low", "FLOAT")]
    assert [n.kind for n in p.body] == ["declare", "assign", "if"]
    assert [n.kind for n in p.body[2].body] == ["sql"] and [n.kind for n in p.body[2].other] == ["print", "return"]
    assert [n.kind for n in P.parse("").body] == []
    kinds = [n.kind for n in P.parse("BEGIN TRAN; INSERT INTO t SELECT a FROM u; UPDATE t SET a = 1 WHERE b = 2; EXEC p @x = 1; COMMIT; PRINT 'done'").body]
    assert kinds == ["tran", "sql", "sql", "exec", "tran", "print"]
    assert [n.kind for n in P.parse("SELECT CASE WHEN a = 1 THEN 2 ELSE 3 END FROM t; RETURN").body] == ["sql", "return"]


def test_control_flow():
    assert P.control_flow(P.parse(P.FLOW)) and sorted(P.control_flow(P.parse(P.FLOW))) == sorted(P._FLOW)


def test_simplify():
    body = P.simplify(P.parse("SET @a = 2 + 3 * 4; SET @b = 2 * 3; IF 1 = 1 SET @c = 1 ELSE SET @c = 2; WHILE 0 = 1 SET @d = 1; RETURN; SET @e = 5").body)
    assert [(n.kind, n.name) for n in body] == [("assign", "a"), ("assign", "b"), ("assign", "c"), ("return", "")]
    assert body[0].text == "14" and body[1].text == "6"
    assert [P.fold(t) for t in ("8 / 3 * 4", "@x - 2 + 3", "2 + 3 * @x", "1.5 + 2", "7 - 2", "2 * 3 / 4")] == ["8 / 3 * 4", "@x - 2 + 3", "2 + 3 * @x", "1.5 + 2", "5", "2 * 3 / 4"]


def test_script_is_the_same_each_time():
    assert P.to_script(P.parse(P.SUM_TO)) == P.to_script(P.parse(P.SUM_TO))


def test_return_leaves(spark):
    script = P.to_script(P.parse("DECLARE @x INT = 1; SELECT @x AS v; IF @x = 1 RETURN; SELECT 2 AS v"))
    assert [r.v for r in spark.sql(script).collect()] == [1]


@pytest.mark.parametrize("bad", ["UPDATE t SET a = 1 FROM t, s WHERE t.k = s.k", "DELETE t FROM t RIGHT JOIN s ON s.k = t.k", "SELECT a FROM t FOR XML RAW", "UPDATE t SET a = 1 OUTPUT inserted.* WHERE b = 2"])
def test_what_has_no_equal_plan_is_refused(bad):
    with pytest.raises(ValueError):
        transpile(bad)


def test_a_row_that_meets_several_sources_is_updated_once(spark):
    made = transpile("UPDATE t SET t.v = s.w + t.v FROM ta t JOIN sa s ON s.k = t.k WHERE s.w > 0")
    spark.createDataFrame([(1, 10), (2, 20)], "k int, v int").createOrReplaceTempView("ta")
    spark.createDataFrame([(1, 5), (1, 5), (1, -9), (2, -1)], "k int, w int").createOrReplaceTempView("sa")
    assert sorted(map(tuple, spark.sql(made.sql).collect())) == [(1, 15), (2, 20)]
    assert spark.sql(made.hits).first()[0] == 1


@pytest.mark.parametrize(
    "text, want",
    [
        ("DECLARE @i INT = 0; BEGIN TRY SET @i = 7; END TRY BEGIN CATCH SET @i = -1; END CATCH SELECT @i AS i", (7,)),
        ("DECLARE @i INT = 0; BEGIN TRY SET @i = 7; THROW 50001, 'too bad', 1; SET @i = 8; END TRY BEGIN CATCH SET @i = @i + 100; END CATCH SELECT @i AS i, ERROR_MESSAGE() AS m", (107, "too bad")),
        ("DECLARE @i INT = 0; BEGIN TRY SET @i = 1 / 0; END TRY BEGIN CATCH IF @i = 0 BEGIN SELECT 'caught' AS c; RETURN; END SET @i = 5; END CATCH SELECT @i AS i", ("caught",)),
        ("DECLARE @i INT = 0, @n INT = 0; WHILE @i < 5 BEGIN SET @i = @i + 1; BEGIN TRY IF @i = 2 THROW 50001, 'x', 1; SET @n = @n + 1; END TRY BEGIN CATCH IF @i = 2 CONTINUE; END CATCH SET @n = @n + 10; END SELECT @n AS n", (44,)),
        ("DECLARE @i INT = 0; BEGIN TRY BEGIN TRY THROW 1, 'in', 1; END TRY BEGIN CATCH SET @i = 1; THROW; END CATCH END TRY BEGIN CATCH SET @i = @i + 10; END CATCH SELECT @i AS i, ERROR_MESSAGE() AS m", (11, "in")),
        ("DECLARE @i INT = 0, @j INT = 0, @n INT = 0; WHILE @i < 3 BEGIN SET @i = @i + 1; SET @j = 0; WHILE 1 = 1 BEGIN SET @j = @j + 1; IF @j = @i BREAK; SET @n = @n + 1; END END SELECT @n AS n", (3,)),
        ("RAISERROR('only a word', 10, 1); SELECT 1 AS x", (1,)),
        ("DECLARE @r INT, @rc INT; EXEC @rc = dbo.Half @x = 10, @y = @r OUTPUT; SELECT @r AS r, @rc AS rc", (5, 0)),
        ("DECLARE @r INT, @rc INT; EXEC @rc = Half 9, @r OUT; SELECT @r AS r, @rc AS rc", (None, 1)),
        ("EXEC sp_executesql N'SELECT 4 AS x'", (4,)),
    ],
)
def test_scripts(spark, text, want):
    half = P.parse("CREATE PROCEDURE dbo.Half @x INT, @y INT OUTPUT AS BEGIN IF @x % 2 = 1 RETURN 1; SET @y = @x / 2; RETURN 0; END")
    assert [tuple(r) for r in spark.sql(P.to_script(P.parse(text), None, {"Half": half})).collect()] == [want]


def test_a_variable_is_not_taken_for_a_column(spark):
    spark.createDataFrame([(1, 10), (2, 20)], "k int, v int").createOrReplaceTempView("tb")
    assert [tuple(r) for r in spark.sql(P.to_script(P.parse("DECLARE @k INT = 2; SELECT v FROM tb WHERE k = @k"))).collect()] == [(20,)]


@pytest.mark.parametrize("bad", ["GOTO a; a: SELECT 1", "EXEC nobody @x = 1", "EXEC (@text)", "SAVE TRAN a", "BREAK", "UPDATE t SET a = 1 OUTPUT inserted.a"])
def test_what_cannot_be_compiled_is_refused(bad):
    with pytest.raises(ValueError):
        P.to_script(P.parse(bad))


def test_break_and_continue_in_the_control_flow():
    edges = set(P.control_flow(P.parse("WHILE @i < 5 BEGIN IF @i = 1 CONTINUE; IF @i = 2 BREAK; SET @i = 3; END SELECT 1")))
    assert {(3, 1, "loop_back"), (6, 1, "loop_back"), (5, 7, "sequential"), (1, 7, "false_branch")} <= edges and (5, 6, "sequential") not in edges


def test_to_tsql():
    from plumbline.plans.transpile import to_tsql

    assert to_tsql('SELECT DISTINCT "a b", NOW() FROM t LIMIT 5') == "SELECT DISTINCT TOP 5 [a b], GETDATE () FROM t"
    assert to_tsql("SELECT a FROM t ORDER BY a LIMIT 5 OFFSET 10") == "SELECT a FROM t ORDER BY a OFFSET 10 ROWS FETCH NEXT 5 ROWS ONLY"
    assert to_tsql("SELECT a FROM t UNION SELECT b FROM u LIMIT 3") == "SELECT TOP 3 * FROM (SELECT a FROM t UNION SELECT b FROM u) AS limited"
    assert to_tsql("SELECT 'LIMIT 5' AS \"x\" -- LIMIT 3") == "SELECT 'LIMIT 5' AS [x]"
    with pytest.raises(ValueError):
        to_tsql("SELECT a FROM t OFFSET 10")


def test_merge_fails_where_source_rows_repeat(spark):
    from plumbline.storage import table_name

    t, s = table_name(spark, "t"), table_name(spark, "s")
    spark.createDataFrame([(1, 10), (2, 20)], "k int, v int").write.saveAsTable(t)
    merge = f"MERGE INTO {t} AS a USING {s} AS b ON a.k = b.k WHEN MATCHED THEN UPDATE SET a.v = b.w WHEN NOT MATCHED THEN INSERT (k, v) VALUES (b.k, b.w);"
    body = f"DECLARE @m NVARCHAR(80) = 'fine'; BEGIN TRY {merge} END TRY BEGIN CATCH SET @m = ERROR_MESSAGE(); END CATCH SELECT @m AS m"
    spark.createDataFrame([(1, 5), (3, 6), (3, 7)], "k int, w int").write.saveAsTable(s)
    assert spark.sql(P.to_script(P.parse(body))).first().m == "fine"
    assert sorted(map(tuple, spark.table(t).collect())) == [(1, 5), (2, 20), (3, 6), (3, 7)]
    spark.createDataFrame([(1, 8)], "k int, w int").write.insertInto(s)
    assert spark.sql(P.to_script(P.parse(body))).first().m.startswith("MERGE: a row of the target")
    assert sorted(map(tuple, spark.table(t).collect())) == [(1, 5), (2, 20), (3, 6), (3, 7)]


def test_columns_keep_their_order_and_types(spark):
    from plumbline.storage import table_name

    t = table_name(spark, "t")
    spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "k int, v int, w string").write.saveAsTable(t)
    spark.sql(P.to_script(P.parse(f"UPDATE {t} SET v = v * 2 WHERE k = 1; INSERT INTO {t} VALUES (3, 30, 'c'); DELETE FROM {t} WHERE k = 2")))
    assert spark.table(t).dtypes == [("k", "int"), ("v", "int"), ("w", "string")]
    assert sorted(map(tuple, spark.table(t).collect())) == [(1, 20, "a"), (3, 30, "c")]


@pytest.mark.parametrize("sql", ["SELECT a.k, t.v FROM ap_a a CROSS APPLY (SELECT TOP 1 b.v FROM ap_b b WHERE b.k = a.k ORDER BY b.d DESC, b.v) t", "SELECT a.k, (SELECT TOP (1) v FROM ap_b b WHERE b.k = a.k ORDER BY ISNULL(d, 0) DESC, v) AS v FROM ap_a a"])
def test_correlated_top_keeps_its_order(spark, sql):
    """Also where ORDER BY names what is not selected: the window that stands for the limit has the order, at any size."""
    spark.range(40).selectExpr("id AS k").createOrReplaceTempView("ap_a")
    spark.range(0, 4000, 1, 8).selectExpr("id % 40 AS k", "id AS v", "(id * 7919) % 997 AS d").createOrReplaceTempView("ap_b")
    df = spark.sql(transpile(sql).sql)
    best = {k: max((v for v in range(4000) if v % 40 == k), key=lambda v: (v * 7919 % 997, -v)) for k in range(40)}
    assert {r.k: r.v for r in df.collect()} == best and df.columns == ["k", "v"]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [row_number()" in x]
    assert windows and all("DESC" in x for x in windows)


def test_rows_of_a_procedure_stay_off_the_driver(spark):
    """More rows than the driver may collect; the last SELECT counts, also after EXEC, in a loop or before RETURN."""
    spark.range(0, 200_000, 1, 4).selectExpr("id AS k", "repeat(CAST(id AS STRING), 20) AS s").createOrReplaceTempView("many")
    base = "CREATE PROCEDURE P @low BIGINT = 0 AS BEGIN SELECT 1 AS one; %s END"
    bodies = {
        "SELECT k, s, NULL AS nothing, COUNT(*) OVER (PARTITION BY k) FROM dbo.many WHERE k >= @low;": 200_000,
        "DECLARE @i INT = 0; WHILE @i < 3 BEGIN SET @i = @i + 1; SELECT k, s FROM many WHERE k % 2 = 0 OR @i < 3; END RETURN 1; SELECT 2 AS two;": 100_000,
        "BEGIN TRY SELECT k, s FROM many; SELECT k FROM no_such_table; END TRY BEGIN CATCH PRINT 'caught'; SELECT TOP 150000 k FROM many; END CATCH": 150_000,
        "EXEC Inner;": 199_000,
        "SELECT k FROM many; SELECT 'last' AS v": 1,
    }
    inner = {"Inner": P.parse("CREATE PROCEDURE Inner AS BEGIN SELECT k, s FROM many WHERE k >= 1000; END")}
    tables = lambda: [t.name for d in spark.catalog.listDatabases() if d.name.startswith("plumbline_") for t in spark.catalog.listTables(d.name) if t.name.startswith("rows_")]
    for body, n in bodies.items():
        with P.rows_of(spark, P.parse(base % body), {"low": "0L"}, inner) as rows:
            assert rows.count() == n
            assert ("LocalRelation" in rows._jdf.queryExecution().analyzed().toString()) == (n == 1)
        assert not tables()
    want = spark.sql("SELECT k, s FROM many")
    told = [tuple(P.validate(spark, P.parse(text), want).drop("error").first()) for text in ("SELECT k, s FROM many", "SELECT k, s FROM many WHERE k > 9", "SELECT k FROM many", "SELECT x FROM many")]
    assert told == [("MATCH", True, 0, 0), ("DIFF", True, 10, 0), ("DIFF", False, None, None), ("ERROR", None, None, None)]
