"""DML, comparison, graph and stream operators on small frames."""

import itertools

import pytest
from pyspark.sql import functions as F

from plumbline import catalogue
from plumbline.functions import tsql
from plumbline.operators import diff, dml, graph, order
from plumbline.plans.reports import stock_query
from plumbline.sources.queries import copy_table, read_csv, select
from plumbline.streaming import events


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_update_ignores_null_conditions(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "k int, v int")
    assert rows(dml.update(df, {"v": F.lit(0)}, F.col("v") > 5)) == [(1, 5), (2, None), (3, 0)]
    assert rows(dml.delete(df, F.col("v") > 5)) == [(1, 5), (2, None)]


def test_merge_takes_the_first_clause(spark):
    t = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "k int, v int")
    s = spark.createDataFrame([(2, 5), (3, 500), (4, 1), (5, -1)], "k int, v int")
    whens = [dml.When("matched", "delete", {}, F.col("s_v") > 100), dml.When("matched", "update", {"v": F.col("v") + F.col("s_v")}), dml.When("source", "insert", {"v": F.col("s_v")}, F.col("s_v") > 0), dml.When("target", "update", {"v": F.lit(0)})]
    assert rows(dml.merge(t, s, ["k"], whens)) == [(1, 0), (2, 25), (4, 1)]
    actions = {r.k: r._action for r in dml.merge_actions(t, s, ["k"], whens).collect()}
    assert actions == {1: "update", 2: "update", 3: "delete", 4: "insert", 5: "skip"}


@pytest.mark.parametrize(
    "a, b, kinds, mode, tolerance, want",
    [
        (1.0, 1.004, "double", "tolerance", None, True), (1.0, 1.006, "double", "tolerance", None, False), (1.0, 1.4, "double", "tolerance", 0.5, True), (3, 4, "int", "tolerance", None, False), ("a ", "a", "string", "tolerance", None, True),
        ("a", "A", "string", "tolerance", None, False), ("1.50", "1.5", "string", "tolerance", None, True), (None, None, "int", "tolerance", None, True), (None, 1, "int", "tolerance", None, False), (1.0, 1.00001, "double", "loose", None, True),
        (1.0, 1.001, "double", "loose", None, False), (" a", "a ", "string", "loose", None, True), (1.0, 1.0000001, "double", "text", None, True), (1.0, 1.0001, "double", "strict", None, False),
    ],
)
def test_equal(spark, a, b, kinds, mode, tolerance, want):
    df = spark.createDataFrame([(a, b)], f"a {kinds}, b {kinds}")
    t = df.schema["a"].dataType
    assert df.select(diff.equal(F.col("a"), F.col("b"), t, t, mode, tolerance).alias("x")).first().x is want


def test_booleans_and_their_spellings(spark):
    df = spark.createDataFrame([(True, "yes", 1), (False, "N", 0)], "a boolean, b string, c int")
    for other in ("b", "c"):
        x = diff.equal(F.col("a"), F.col(other), df.schema["a"].dataType, df.schema[other].dataType, "tolerance")
        assert [r.x for r in df.select(x.alias("x")).collect()] == [True, True]


def test_diff_of_equal_frames(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert diff.strict(df, df).first().equal and diff.summary(df, df, ["k"]).first().status == "MATCH"
    assert diff.field_diffs(df, df, ["k"]).isEmpty()
    assert diff.strict(df.union(df), df).first().only_source == 2


def test_reachable_stops_on_cycles(spark):
    edges = spark.createDataFrame([("b", "a", "X"), ("c", "b", "X"), ("a", "c", "X"), ("d", "c", "X")], "src string, dst string, type string")
    got = {(r.node, r.depth) for r in graph.reachable(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {("b", 1), ("c", 2), ("d", 3)}


def test_datediff_counts_boundaries(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-31 23:59:59' AS a, TIMESTAMP_NTZ '2024-02-01 00:00:00' AS b")
    for unit, n in (("year", 0), ("quarter", 0), ("month", 1), ("day", 1), ("week", 0), ("hour", 1), ("minute", 1), ("second", 1)):
        assert df.select(tsql.datediff(unit, "a", "b").alias("n")).first().n == n, unit


def test_patterns():
    assert tsql.like_to_regex("a%b_[1-3]c.") == r"a[\s\S]*b[\s\S][1-3]c\."


def test_stock_filters(spark):
    stock = spark.createDataFrame([(1, "red ring", "A", 5, 1.0), (2, "blue ring", "B", 1, 9.0)], "product_id int, product_name string, warehouse string, min_quantity int, quantity double")
    assert stock_query(stock).count() == 2 and stock_query(stock, cap=1).count() == 1
    assert [r.product_id for r in stock_query(stock, low_only=True).collect()] == [1]
    assert stock_query(stock, name_part="ring", warehouse="B").count() == 1


def test_select_and_copy(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "a"), (2, None, None)], "k int, gone string, v string")
    assert rows(select(df, ["k"], {"v": None})) == [(2,)] and [r.k for r in select(df, order_by=["-k"], limit=1).collect()] == [2]
    assert copy_table(df, str(tmp_path / "t")).columns == ["k", "v"]
    (tmp_path / "x.csv").write_text("k;v\n1;é\n", encoding="utf-8")
    assert rows(read_csv(spark, str(tmp_path / "x.csv"), "k int, v string", sep=";")) == [(1, "é")]


def test_stream_equals_batch(spark, tmp_path):
    spark.sql("SELECT id AS event_id, TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(id AS INT)) AS ts, id % 3 AS user_id, 'click' AS event_type, 1.5D AS value, '{}' AS props FROM range(60)").repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    got = rows(events.stream_events(spark, str(tmp_path)))
    assert sum(r[2] for r in got) == 60 and len(got) == 3


def test_token_buckets(spark, tmp_path):
    data = [(i, i // 2, 1) for i in range(12)] + [(100 + i, 50 + i, 2) for i in range(2)]
    df = spark.createDataFrame(data, "event_id long, second long, user_id long").selectExpr("event_id", "user_id", "timestamp_seconds(second) AS ts")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    got = {r.event_id: r.allowed for r in events.run_to_table(events.token_buckets(stream, 2, 1), "append").collect()}
    tokens, last = {}, {}
    for e, s, u in data:
        tokens[u] = min(2, tokens.get(u, 2) + (s - last.get(u, s)))
        last[u] = s
        assert got[e] == (tokens[u] >= 1)
        tokens[u] -= 1 if tokens[u] >= 1 else 0


def test_nothing_imports_the_text_operators():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for f in itertools.chain(root.glob("plumbline/**/*.py"), root.glob("*.py")):
        if "llm" not in f.parts and f.name not in ("__spark_entry__.py", "corpus_pipeline.py"):
            assert "plumbline.llm" not in f.read_text() and ".llm" not in f.read_text(), f


def test_entry_without_them(spark, tmp_path):
    """With the folders gone the entry still imports and gives the other queries."""
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "plumbline", tmp_path / "plumbline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'report_sales' in q and not any(n.startswith('op1_') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True, timeout=120)


@pytest.mark.parametrize("descending", [True, False])
def test_global_rank(spark, descending):
    from plumbline.operators.order import global_rank, top_percent

    values = [(i, None if i % 17 == 0 else float(i * 7919 % 101)) for i in range(500)]
    df = spark.createDataFrame(values, "k int, v double").repartition(5)
    want = sorted(values, key=lambda t: (t[1] is None, (-t[1] if descending else t[1]) if t[1] is not None else 0, t[0]))
    got = {r.k: r.rank for r in global_rank(df, "v", ["k"], descending, buckets=7).collect()}
    assert [got[k] for k, _ in want] == list(range(1, 501))
    if descending:
        assert {r.k for r in top_percent(df, 3, "v", ["k"]).collect()} == {k for k, _ in want[:15]}
    assert global_rank(df.where("false"), "v", ["k"]).isEmpty()


def test_graph_of_many_edges(spark):
    """A layered graph of 100,000 edges, with a cycle behind it: least depths and layers as by a plain walk."""
    import random

    rnd, layers, width = random.Random(3), 20, 2500
    pairs = {((k, i), (k - 1, rnd.randrange(width))) for k in range(1, layers) for i in range(width) for _ in range(2)} | {((k, i), (rnd.randrange(k), rnd.randrange(width))) for k in range(2, layers) for i in range(0, width, 7)}
    name = lambda n: f"{n[0]}-{n[1]}"
    rows = [(name(a), name(b), "CALLS") for a, b in pairs] + [("p", "q", "CALLS"), ("q", "p", "CALLS"), ("r", "q", "CALLS")]
    assert len(rows) > 95_000
    df = graph.saved(spark.createDataFrame(rows, "src string, dst string, type string"), "test-edges")
    needs, users = {}, {}
    for a, b in pairs:
        needs.setdefault(a, []).append(b)
        users.setdefault(b, []).append(a)
    wave = {}
    for n in sorted({x for p in pairs for x in p}):
        wave[n] = 1 + max((wave[m] for m in needs.get(n, [])), default=-1)
    assert {(r.node, r.wave) for r in graph.waves(df).collect()} == {(name(n), w) for n, w in wave.items()}
    start = (0, 5)
    depth, front = {start: 0}, [start]
    while front:
        front = [a for n in front for a in users.get(n, []) if a not in depth and not depth.update({a: depth[n] + 1})]
    got = {(r.node, r.depth) for r in graph.reachable(df, spark.createDataFrame([(name(start),)], "node string")).collect()}
    assert got == {(name(n), d) for n, d in depth.items() if d}
    assert {(r.start, r.node) for r in graph.cycles(df).collect()} == {("p", "q"), ("q", "p")}


def test_strict_counts_repeats(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x"), (3, "y")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, "x"), (2, "x"), (4, "y")], "k int, v string")
    assert tuple(diff.strict(a, b).first()) == (2, 2, False) and tuple(diff.strict(a, a).first()) == (0, 0, True)


def test_field_diffs_is_an_inner_join(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    plan = diff.field_diffs(a, a, ["k"], "strict")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "FullOuter" not in plan


@pytest.mark.parametrize("n", [1, 3, 4, 10, 97])
def test_global_ntile(spark, n):
    df = spark.range(n).select(F.col("id"), (F.col("id") % 5).cast("double").alias("v"))
    got = {r.id: r.tile for r in order.global_ntile(df, 4, "v", ["id"]).collect()}
    place = sorted(range(n), key=lambda i: (i % 5, i))
    q, rest = divmod(n, 4)
    assert [got[i] for i in place] == [t + 1 for t in range(4) for _ in range(q + (t < rest))]


def test_references_of_a_text():
    assert graph.references("WITH a AS (SELECT * FROM t1) SELECT * FROM a JOIN [dbo].[t 2] x ON 1 = 1; EXEC p.q 1; MERGE INTO m USING s ON 1 = 1") == {("t1", "DEPENDS_ON"), ("t 2", "DEPENDS_ON"), ("q", "CALLS"), ("m", "DEPENDS_ON"), ("s", "DEPENDS_ON")}


def test_models_come_in_order_and_keys_are_checked(spark):
    from plumbline.sources import tables as t

    assert [m.name for m in t.in_order([t.ORDERS, t.CUSTOMERS])] == ["customers", "orders_made"]
    loop = [t.Model("a", [], [], foreign=[("x", "b", "y")]), t.Model("b", [], [], foreign=[("x", "a", "y")])]
    with pytest.raises(ValueError):
        t.in_order(loop)
    assert t.ddl(t.ORDERS) == "CREATE TABLE orders_made (id BIGINT NOT NULL, customer_id BIGINT, status STRING DEFAULT 'PENDING', total_amount DECIMAL(12,2)) USING parquet TBLPROPERTIES ('model.key' = 'id', 'model.foreign' = 'customer_id>customers.id')"
    df = spark.createDataFrame([(1, 5), (1, None), (2, 6)], "k int, c int")
    assert t.repeats(df, ["k"]).first().k == 1
    assert [r.c for r in t.orphans(df, "c", spark.createDataFrame([(5,)], "id int"), "id").collect()] == [6]


def test_machines():
    from plumbline.streaming import machines as m

    assert m.terminal(m.SESSION) == ["COMPLETED", "FAILED"] and m.terminal(m.NODE) == ["SKIPPED", "SUCCESS", "FAILED"]
    assert m.allowed(m.SESSION, "PAUSED") == ["session_resumed", "session_completed", "session_failed"] and m.allowed(m.NODE, "SUCCESS") == []


def test_fold_of_one_hot_key(spark):
    """All events under one key, in many chunks, as a plain loop folds them."""
    import random

    from plumbline.streaming import machines as m

    rnd = random.Random(2)
    log = [(1, i, rnd.choice(["session_started", "session_paused", "session_resumed", "other"])) for i in range(5000)]
    state, ok = "INIT", 0
    for _, _, e in log:
        if (state, e) in m.SESSION:
            state, ok = m.SESSION[state, e], ok + 1
    df = spark.createDataFrame(log, "k int, i int, e string").repartition(3)
    got = m.fold(df, m.SESSION, "k", F.floor(F.col("i") / 100), ["i"], "e", "INIT").first()
    assert (got.state, got.accepted, got.refused) == (state, ok, 5000 - ok)


def test_diagnostics_pass_over_strings_and_comments(spark):
    from plumbline.plans import diagnostics

    df = spark.createDataFrame([(1, "SELECT 'FROM x JOIN y' AS t /* FROM z */ FROM [a b].c -- JOIN q\n"), (2, None), (3, "")], "id long, sql string")
    assert [(r.id, r.object, r.name, r.risk) for r in diagnostics.objects(df).collect()] == [(1, "table", "[A B].C", "MEDIUM")]


def test_a_name_is_registered_once():
    from plumbline.registry import Once

    names = Once(a=1)
    with pytest.raises(ValueError):
        names["a"] = 2


def orders_of(spark, path, rows):
    """The tables of sf0.001 in path, with orders of these customers and prices, in this order, in one file."""
    import shutil

    shutil.copytree("/root/testdata/sf0.001", path, dirs_exist_ok=True)
    path.chmod(0o755)
    (path / "orders.parquet").unlink()
    spark.createDataFrame([(k, c, "O", p) for k, (c, p) in enumerate(rows)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").selectExpr(
        "*", "TIMESTAMP '1996-01-01 00:00:00' AS o_orderdate", "'5-LOW' AS o_orderpriority").coalesce(1).write.parquet(str(path / "orders.parquet"))
    return str(path)


def test_equal_sums_rank_by_the_next_key(spark, tmp_path):
    """0.1 + 0.2 + 0.3 is not 0.3 + 0.2 + 0.1 in doubles: sums that are equal must not be ranked by their order of rows."""
    nation = {r.c_custkey: r.c_nationkey for r in spark.read.parquet("/root/testdata/sf0.001/customer.parquet").collect()}
    a, b = next((x, y) for x in sorted(nation) for y in sorted(nation) if x < y and nation[x] == nation[y])
    for name, up, down in (("s", a, b), ("t", b, a)):
        sf = orders_of(spark, tmp_path / name, [(up, 0.1), (up, 0.2), (up, 0.3), (down, 0.3), (down, 0.2), (down, 0.1)])
        ranks = {r.customer_id: (r.total_spent, r.rank_no) for r in catalogue.QUERIES["win_row_number"](spark, sf).collect()}
        assert ranks == {a: (0.6, 1), b: (0.6, 2)}
    big = [(a, 1e300), (a, 0.1), (b, float("nan")), (b, 0.5)]  # no decimals hold these
    ranks = {r.customer_id: (str(r.total_spent), r.rank_no) for r in catalogue.QUERIES["win_row_number"](spark, orders_of(spark, tmp_path / "u", big)).collect()}
    assert ranks == {b: ("nan", 1), a: ("1e+300", 2)}


def test_ties_at_a_limit_go_by_the_selected_columns(spark, tmp_path):
    """Twelve equal sums of doubles whose rows come in different orders, ten places."""
    prices = [1000000.1, 1000000.2, 1000000.3]
    rows = [(c, p) for c in range(40, 28, -1) for p in (prices if c % 2 else prices[::-1])]
    got = catalogue.QUERIES["rewrite_cte"](spark, orders_of(spark, tmp_path / "t", rows)).collect()
    assert [(r.o_custkey, int(r.s)) for r in got] == [(c, 3000001) for c in range(29, 39)]
