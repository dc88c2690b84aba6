"""Certification of a migration from its test results: aggregations over results(test_id, status, risk_score, known_issues, tags)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import ORACLES, QUERIES, query, table

SCHEMA = "test_id string, status string, risk_score double, known_issues long, area string, tags string, category string"
RESULTS = [
    ("schema_tables", "PASS", 0.0, 0, "schema", "smoke,schema", ""), ("schema_counts", "PASS", 0.0, 0, "schema", "smoke,schema", ""), ("select_all", "PASS", 0.0, 0, "sql", "crud", ""), ("select_null", "PASS", 0.0, 1, "sql", "edge,null-handling", ""),
    ("boolean_filter", "PASS", 20.0, 0, "sql", "edge,boolean", ""), ("string_filter", "CONDITIONAL", 15.0, 1, "sql", "crud,collation", "collation"), ("group_count", "PASS", 0.0, 0, "sql", "aggregation,group-by", ""), ("sum_totals", "FAIL", 40.0, 0, "sql", "aggregation,numeric-precision", "precision"),
    ("join_three", "PASS", 0.0, 0, "sql", "join,multi-table", ""), ("low_stock", "PASS", 0.0, 0, "data", "inventory,edge", ""), ("created_at", "ERROR", 60.0, 0, "data", "edge,datetime", "type_mapping"), ("paging", "PASS", 0.0, 2, "sql", "pagination", ""),
    ("create_order", "CONDITIONAL", 10.0, 0, "flow", "business_flow,join", "precision"), ("update_order", "PASS", 0.0, 0, "flow", "business_flow", ""), ("customer_api", "PASS", 0.0, 0, "api", "crud", ""), ("order_api", "FAIL", 55.0, 1, "api", "crud,join", "nullability"),
]
_ROWS = "results(test_id, status, risk_score, known_issues, area, tags, category) AS (SELECT a, b, CAST(c AS DOUBLE), CAST(d AS BIGINT), e, f, g FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c}, {d}, '{e}', '{f}', '{g}')" for a, b, c, d, e, f, g in RESULTS) + ") v(a, b, c, d, e, f, g))"

#: Expected tests by area, and what a tag adds to the risk (fixed values).
EXPECTED = {"schema": 3, "sql": 10, "data": 4, "api": 4, "flow": 4}
TAG_RISK = {"pagination": 20, "group-by": 10, "aggregation": 10, "join": 15, "left-join": 15, "multi-table": 25, "boolean": 20, "null-handling": 20, "datetime": 25, "numeric-precision": 15, "collation": 15, "edge": 15, "crud": 5}


#: Results that the queries are to read in place of the listed ones, while one is put together.
_GIVEN: list[DataFrame] = []


def results(spark: SparkSession) -> DataFrame:
    return _GIVEN[-1] if _GIVEN else spark.createDataFrame(RESULTS, SCHEMA)


def certify(given: DataFrame, name: str) -> DataFrame:
    """The query of that name over any results (columns as in SCHEMA)."""
    _GIVEN.append(given)
    try:
        return QUERIES[name](given.sparkSession, "")
    finally:
        _GIVEN.pop()


def _tally(status: str) -> F.Column:
    return F.count_if(F.col("status") == status)


@query("cert_report", f"WITH {_ROWS} SELECT area, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (status = 'PASS') AS BIGINT) AS passed, CAST(count(*) FILTER (status = 'FAIL') AS BIGINT) AS failed, CAST(count(*) FILTER (status = 'ERROR') AS BIGINT) AS errors, CAST(count(*) FILTER (status = 'CONDITIONAL') AS BIGINT) AS conditional, round(count(*) FILTER (status IN ('PASS', 'CONDITIONAL')) * 100.0::DOUBLE / count(*), 2) AS pass_rate FROM results GROUP BY area")
def cert_report(spark, sf):
    n = F.count(F.lit(1))
    return results(spark).groupBy("area").agg(n.alias("total"), _tally("PASS").alias("passed"), _tally("FAIL").alias("failed"), _tally("ERROR").alias("errors"), _tally("CONDITIONAL").alias("conditional"), F.round(F.count_if(F.col("status").isin("PASS", "CONDITIONAL")) * 100.0 / n, 2).alias("pass_rate"))


def coverage(df: DataFrame) -> DataFrame:
    want = df.sparkSession.createDataFrame(list(EXPECTED.items()), "area string, expected long")
    have = df.groupBy("area").agg(F.count_distinct("test_id").alias("covered"))
    covered = F.least(F.coalesce("covered", F.lit(0)), F.col("expected"))
    return want.join(have, "area", "left").select("area", "expected", covered.alias("covered"), F.round(covered * 100.0 / F.col("expected"), 1).alias("percent"))


_COVER = "cover AS (SELECT w.area, CAST(w.expected AS BIGINT) AS expected, CAST(least(coalesce(h.n, 0), w.expected) AS BIGINT) AS covered, round(least(coalesce(h.n, 0), w.expected) * 100.0::DOUBLE / w.expected, 1) AS percent FROM (VALUES " + ", ".join(f"('{a}', {n})" for a, n in EXPECTED.items()) + ") w(area, expected) LEFT JOIN (SELECT area, count(DISTINCT test_id) AS n FROM results GROUP BY area) h ON h.area = w.area)"


@query("cert_coverage", f"WITH {_ROWS}, {_COVER} SELECT * FROM cover")
def cert_coverage(spark, sf):
    return coverage(results(spark))


def confidence(df: DataFrame) -> DataFrame:
    """Pass rate .40, coverage .40, consistency .20; consistency by test: 100, 85 with known issues, 70 with a risk, 60 conditional, 20 error, 0 failed."""
    each = F.when(F.col("status") == "PASS", F.when(F.col("known_issues") > 0, 85.0).when(F.col("risk_score") > 0, 70.0).otherwise(100.0)).when(F.col("status") == "CONDITIONAL", 60.0).when(F.col("status") == "ERROR", 20.0).otherwise(0.0)
    parts = df.agg((_tally("PASS") * 100.0 / F.count(F.lit(1))).alias("p"), F.avg(each).alias("c"), (F.count_if(F.col("status").isin("FAIL", "ERROR")) / F.count(F.lit(1))).alias("failure_rate"))
    return parts.crossJoin(coverage(df).agg(F.avg("percent").alias("v"))).select(F.round(F.col("p") * 0.4, 1).alias("pass_part"), F.round(F.col("v") * 0.4, 1).alias("coverage_part"), F.round(F.col("c") * 0.2, 1).alias("consistency_part"), F.round("failure_rate", 4).alias("failure_rate")).withColumn("confidence", F.round(F.col("pass_part") + F.col("coverage_part") + F.col("consistency_part"), 1))


_EACH = "CASE WHEN status = 'PASS' THEN CASE WHEN known_issues > 0 THEN 85 WHEN risk_score > 0 THEN 70 ELSE 100 END WHEN status = 'CONDITIONAL' THEN 60 WHEN status = 'ERROR' THEN 20 ELSE 0 END"
_CONF = f"conf AS (SELECT *, round(pass_part + coverage_part + consistency_part, 1) AS confidence FROM (SELECT round(count(*) FILTER (status = 'PASS') * 100.0::DOUBLE / count(*) * 0.4::DOUBLE, 1) AS pass_part, round((SELECT avg(percent) FROM cover) * 0.4::DOUBLE, 1) AS coverage_part, round(avg({_EACH}) * 0.2::DOUBLE, 1) AS consistency_part, round(count(*) FILTER (status IN ('FAIL', 'ERROR'))::DOUBLE / count(*), 4) AS failure_rate FROM results) x)"


@query("cert_confidence", f"WITH {_ROWS}, {_COVER}, {_CONF} SELECT * FROM conf")
def cert_confidence(spark, sf):
    return confidence(results(spark))


#: Severity of a failure by its kind of difference.
_SEVERITY = "CASE WHEN status = 'ERROR' THEN 'BLOCKER' WHEN category IN ('nullability', 'type_mapping') THEN 'HIGH' WHEN category = 'precision' THEN 'MEDIUM' ELSE 'LOW' END"


def failures(df: DataFrame) -> DataFrame:
    severity = F.when(F.col("status") == "ERROR", "BLOCKER").when(F.col("category").isin("nullability", "type_mapping"), "HIGH").when(F.col("category") == "precision", "MEDIUM").otherwise("LOW")
    return df.where(F.col("status").isin("FAIL", "ERROR", "CONDITIONAL")).select("test_id", "status", severity.alias("severity"), "risk_score")


@query("cert_risk", f"WITH {_ROWS} SELECT test_id, status, {_SEVERITY} AS severity, risk_score FROM results WHERE status IN ('FAIL', 'ERROR', 'CONDITIONAL')")
def cert_risk(spark, sf):
    return failures(results(spark))


@query("cert_decision", f"WITH {_ROWS}, {_COVER}, {_CONF} SELECT confidence, failure_rate, CASE WHEN failure_rate <= 0 AND confidence > 75 THEN 'READY' WHEN failure_rate >= 0.20 THEN 'NOT_READY' ELSE 'REVIEW_REQUIRED' END AS decision FROM conf")
def cert_decision(spark, sf):
    decision = F.when((F.col("failure_rate") <= 0) & (F.col("confidence") > 75), "READY").when(F.col("failure_rate") >= 0.20, "NOT_READY").otherwise("REVIEW_REQUIRED")
    return confidence(results(spark)).select("confidence", "failure_rate", decision.alias("decision"))


_TAG_CASE = "CASE t " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TAG_RISK.items()) + " ELSE 0 END"


@query("risk_dimensions", f"""WITH {_ROWS}, each AS (SELECT r.area, r.test_id, (coalesce(sum({_TAG_CASE}), 0) + 10 * max(known_issues)) * CASE WHEN max(status) = 'FAIL' THEN 1.5::DOUBLE ELSE 1 END AS risk FROM results r, unnest(string_split(r.tags, ',')) u(t) GROUP BY r.area, r.test_id)
 SELECT area, raw, CASE WHEN raw <= 20 THEN 'SAFE' WHEN raw <= 40 THEN 'LOW_RISK' WHEN raw <= 60 THEN 'MEDIUM_RISK' WHEN raw <= 80 THEN 'HIGH_RISK' ELSE 'BLOCKER' END AS readiness FROM (SELECT area, least(100, round(sum(risk) / sum(greatest(risk, 10)) * 100, 1)) AS raw FROM each GROUP BY area) x""")
def risk_dimensions(spark, sf):
    """Risk per area: what tags, known issues and failures add, against a floor of 10 a test."""
    tag = F.explode(F.split("tags", ","))
    per_tag = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TAG_RISK.items() for x in kv]), F.col("tag")), F.lit(0))
    each = results(spark).withColumn("tag", tag).groupBy("area", "test_id").agg((F.sum(per_tag) + 10 * F.max("known_issues")).alias("r"), F.max("status").alias("status"))
    risk = F.col("r") * F.when(F.col("status") == "FAIL", 1.5).otherwise(1.0)
    raw = F.least(F.lit(100.0), F.round(F.sum(risk) / F.sum(F.greatest(risk, F.lit(10.0))) * 100, 1))
    out = each.groupBy("area").agg(raw.alias("raw"))
    level = F.when(F.col("raw") <= 20, "SAFE").when(F.col("raw") <= 40, "LOW_RISK").when(F.col("raw") <= 60, "MEDIUM_RISK").when(F.col("raw") <= 80, "HIGH_RISK").otherwise("BLOCKER")
    return out.withColumn("readiness", level)


#: Messages to kinds of issue, the first that matches.
ISSUES = [("syntax", "syntax|parse|unexpected token"), ("missing_object", "does not exist|not found|unknown table"), ("type_mapping", "type|cast|convert"), ("precision", "precision|rounding|decimal"), ("nullability", "null"), ("connection", "connect|timeout|refused")]
MESSAGES = [(1, "Syntax error near TOP"), (2, "relation foo does not exist"), (3, "cannot cast text to int"), (4, "rounding of total differs"), (5, "unexpected NULL in notes"), (6, "connection refused"), (7, "something else")]
_MESSAGES = "messages(id, message) AS (SELECT CAST(a AS BIGINT), b FROM (VALUES " + ", ".join(f"({i}, '{m}')" for i, m in MESSAGES) + ") v(a, b))"


@query("issue_classify", f"WITH {_MESSAGES} SELECT id, CASE " + " ".join(f"WHEN regexp_matches(lower(message), '{p}') THEN '{k}'" for k, p in ISSUES) + " ELSE 'other' END AS kind FROM messages")
def issue_classify(spark, sf):
    kind = F.coalesce(*[F.when(F.lower("message").rlike(p), F.lit(k)) for k, p in ISSUES], F.lit("other"))
    return spark.createDataFrame(MESSAGES, "id long, message string").select("id", kind.alias("kind"))


#: Which state an issue may go to from which.
MOVES = {("OPEN", "ANALYZED"), ("ANALYZED", "FIXING"), ("FIXING", "FIXED"), ("FIXED", "VERIFIED"), ("FIXING", "FAILED"), ("FAILED", "FIXING"), ("VERIFIED", "CLOSED"), ("FIXED", "FIXING")}
STEPS = [(1, 1, "OPEN"), (1, 2, "ANALYZED"), (1, 3, "FIXING"), (1, 4, "FIXED"), (1, 5, "VERIFIED"), (2, 1, "OPEN"), (2, 2, "FIXING"), (2, 3, "FIXED"), (3, 1, "OPEN"), (3, 2, "ANALYZED"), (3, 3, "FIXING"), (3, 4, "FAILED"), (3, 5, "FIXING")]
_STEPS = "steps(issue, seq, state) AS (SELECT CAST(a AS BIGINT), CAST(b AS BIGINT), c FROM (VALUES " + ", ".join(f"({a}, {b}, '{c}')" for a, b, c in STEPS) + ") v(a, b, c))"


@query("issue_lifecycle", f"WITH {_STEPS}, l AS (SELECT *, lag(state) OVER (PARTITION BY issue ORDER BY seq) AS before FROM steps) SELECT issue, max_by(state, seq) AS state, CAST(count(*) FILTER (before IS NOT NULL AND (before || '>' || state) NOT IN (" + ", ".join(f"'{a}>{b}'" for a, b in sorted(MOVES)) + ")) AS BIGINT) AS illegal, CAST(count(*) FILTER (state = 'FIXING') AS BIGINT) AS attempts FROM l GROUP BY issue")
def issue_lifecycle(spark, sf):
    from pyspark.sql.window import Window

    steps = spark.createDataFrame(STEPS, "issue long, seq long, state string").withColumn("before", F.lag("state").over(Window.partitionBy("issue").orderBy("seq")))
    legal = F.concat_ws(">", "before", "state").isin(*[f"{a}>{b}" for a, b in MOVES])
    return steps.groupBy("issue").agg(F.max_by("state", "seq").alias("state"), F.count_if(F.col("before").isNotNull() & ~legal).alias("illegal"), F.count_if(F.col("state") == "FIXING").alias("attempts"))


#: An event as a test's result, in SQL that both engines read.
_EVENT = """SELECT concat('t', CAST(event_id AS VARCHAR(20))) AS test_id, CASE event_id % 10 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'CONDITIONAL' ELSE 'PASS' END AS status, CAST((event_id % 7) * 10 AS DOUBLE) AS risk_score, CAST(event_id % 3 AS BIGINT) AS known_issues,
 CASE user_id % 5 WHEN 0 THEN 'schema' WHEN 1 THEN 'sql' WHEN 2 THEN 'data' WHEN 3 THEN 'api' ELSE 'flow' END AS area, CASE event_id % 4 WHEN 0 THEN 'crud' WHEN 1 THEN 'edge,null-handling' WHEN 2 THEN 'join,multi-table' ELSE 'aggregation,numeric-precision' END AS tags,
 CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'precision' WHEN 2 THEN 'nullability' WHEN 3 THEN 'type_mapping' ELSE 'collation' END AS category FROM events"""


def _over_events(name: str) -> None:
    def run(spark, sf):
        table(spark, sf, "events").createOrReplaceTempView("events")
        return certify(spark.sql(_EVENT), name)

    QUERIES[f"{name}_rows"], ORACLES[f"{name}_rows"] = run, ORACLES[name].replace(_ROWS, f"results AS ({_EVENT})")


for _name in [n for n, sql in ORACLES.items() if _ROWS in sql]:
    _over_events(_name)
