"""What follows from the findings on statements: a path, a plan of steps, fixes, and rounds of fixing until nothing fails.

All of it is columns over a DataFrame of findings, a row a statement or an issue; the rounds keep their state in tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query, table
from ..storage import saved

#: From which confidence on a rewrite is applied without review (fixed value).
SURE = 0.90


def migration_path(rules: Column, confidence: Column, critical: Column, high: Column, recommendation: Column) -> Column:
    """DIRECT without rules or findings, MANUAL with findings that no rule meets, AUTO_REWRITE if sure and safe, else PARTIAL."""
    return F.when((rules == 0) & ~critical & ~high, "DIRECT").when(rules == 0, "MANUAL").when((confidence >= SURE) & (recommendation == "SAFE"), "AUTO_REWRITE").otherwise("PARTIAL")


def strategy(path: Column, recommendation: Column, rules: Column, blocking: Column) -> Column:
    """How to go on, in a sentence."""
    return (
        F.when(recommendation == "BLOCK", F.concat(F.lit("Do not migrate: solve "), blocking.cast("string"), F.lit(" blocking findings first.")))
        .when(path == "DIRECT", "Runs on the target as it is; run it on a test system first.")
        .when(path == "AUTO_REWRITE", F.concat(F.lit("Rewritten by "), rules.cast("string"), F.lit(" rules; compare results on a test system, then release.")))
        .when(path == "PARTIAL", F.concat(rules.cast("string"), F.lit(" changes are made; review each, test, and settle the findings of high risk before release.")))
        .otherwise("Rewrite by hand, test on the target, and compare results of both sides.")
    )


def effort(high: Column, medium: Column) -> Column:
    return F.when(high > 2, "HIGH").when((high > 0) | (medium > 3), "MEDIUM").otherwise("LOW")


def steps(findings: DataFrame) -> DataFrame:
    """id, step, action and automatic of findings (id, rules, critical_tables, high_functions, high, medium), rewrites first."""

    def some(condition: Column, action: str) -> Column:
        one = F.array(F.struct(F.lit(action).alias("action"), F.lit(False).alias("automatic")))
        return F.when(condition, one).otherwise(F.slice(one, 1, 0))

    always = F.lit(True)
    rewrites = F.transform(F.when(F.col("rules") > 0, F.sequence(F.lit(1), F.col("rules").cast("int"))).otherwise(F.expr("cast(array() as array<int>)")), lambda _: F.struct(F.lit("REWRITE_SQL").alias("action"), F.lit(True).alias("automatic")))
    manual = [some(F.col("critical_tables"), "UPDATE_SCHEMA"), some(F.col("high_functions") | (F.col("high") > 0), "MANUAL_REVIEW"), some(always, "TEST_RECOMMENDED"), some(always, "VALIDATE_EXECUTION"), some(always, "VERIFY_RESULTS")]
    return findings.select("id", F.posexplode(F.concat(rewrites, *manual)).alias("step", "s")).select("id", (F.col("step") + 1).alias("step"), "s.*")


def _findings(spark, sf) -> DataFrame:
    """A row a part, with made-up findings."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("id"), (F.col("p_size") % 4).alias("rules"), (k % 5 == 0).alias("critical_tables"), (k % 7 == 0).alias("high_functions"), (k % 4).alias("high"), (k % 6).alias("medium"), (F.lit(0.8) + (k % 3) * 0.1).alias("confidence"), F.when(k % 11 == 0, "BLOCK").when(k % 2 == 0, "SAFE").otherwise("REVIEW").alias("recommendation"),
    )


_F = "f AS (SELECT p_partkey AS id, p_size % 4 AS rules, p_partkey % 5 = 0 AS critical_tables, p_partkey % 7 = 0 AS high_functions, p_partkey % 4 AS high, p_partkey % 6 AS medium, 0.8::DOUBLE + (p_partkey % 3) * 0.1::DOUBLE AS confidence, CASE WHEN p_partkey % 11 = 0 THEN 'BLOCK' WHEN p_partkey % 2 = 0 THEN 'SAFE' ELSE 'REVIEW' END AS recommendation FROM part)"
_PATH = "CASE WHEN rules = 0 AND NOT critical_tables AND high = 0 THEN 'DIRECT' WHEN rules = 0 THEN 'MANUAL' WHEN confidence >= 0.9 AND recommendation = 'SAFE' THEN 'AUTO_REWRITE' ELSE 'PARTIAL' END"


@query("migration_steps", f"""WITH {_F}, s AS (SELECT id, 0 AS rank, unnest(range(rules)) AS k, 'REWRITE_SQL' AS action, true AS automatic FROM f UNION ALL SELECT id, 1, 0, 'UPDATE_SCHEMA', false FROM f WHERE critical_tables UNION ALL SELECT id, 2, 0, 'MANUAL_REVIEW', false FROM f WHERE high_functions OR high > 0
 UNION ALL SELECT id, 3, 0, 'TEST_RECOMMENDED', false FROM f UNION ALL SELECT id, 4, 0, 'VALIDATE_EXECUTION', false FROM f UNION ALL SELECT id, 5, 0, 'VERIFY_RESULTS', false FROM f) SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY rank, k) AS INT) AS step, action, automatic FROM s""")
def migration_steps(spark, sf):
    return steps(_findings(spark, sf))


@query("migration_effort", f"WITH {_F} SELECT CASE WHEN high > 2 THEN 'HIGH' WHEN high > 0 OR medium > 3 THEN 'MEDIUM' ELSE 'LOW' END AS effort, {_PATH} AS path, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY 1, 2")
def migration_effort(spark, sf):
    f = _findings(spark, sf)
    path = migration_path(F.col("rules"), F.round("confidence", 6), F.col("critical_tables"), F.col("high") > 0, F.col("recommendation"))
    return f.groupBy(effort(F.col("high"), F.col("medium")).alias("effort"), path.alias("path")).agg(F.count(F.lit(1)).alias("n"))


@query("kernel_strategy", f"""WITH {_F}, p AS (SELECT *, {_PATH} AS path FROM f) SELECT id, CASE WHEN recommendation = 'BLOCK' THEN 'Do not migrate: solve ' || high || ' blocking findings first.' WHEN path = 'DIRECT' THEN 'Runs on the target as it is; run it on a test system first.' WHEN path = 'AUTO_REWRITE' THEN 'Rewritten by ' || rules || ' rules; compare results on a test system, then release.'
 WHEN path = 'PARTIAL' THEN rules || ' changes are made; review each, test, and settle the findings of high risk before release.' ELSE 'Rewrite by hand, test on the target, and compare results of both sides.' END AS strategy FROM p""")
def kernel_strategy(spark, sf):
    f = _findings(spark, sf)
    path = migration_path(F.col("rules"), F.round("confidence", 6), F.col("critical_tables"), F.col("high") > 0, F.col("recommendation"))
    return f.select("id", strategy(path, F.col("recommendation"), F.col("rules"), F.col("high")).alias("strategy"))


# --- fixes ---
#: How likely a fix of a kind of issue works, by what its cause names (fixed values).
LIKELY = {"SCHEMA_ADJUSTMENT": (0.80, 0.50), "DATA_NORMALIZATION": {"precision": 0.85, "datetime": 0.80, "rounding": 0.70, "": 0.75}, "QUERY_BEHAVIOR": (0.90, 0.50), "API_CONTRACT": 0.70, "SQL_REWRITE": 0.50}
#: Source types of T-SQL that have another name on the target (fixed values).
TYPE_RULES = "NVARCHAR\\(MAX\\)|VARCHAR\\(MAX\\)|VARBINARY\\(MAX\\)|UNIQUEIDENTIFIER|DATETIME2|DATETIMEOFFSET|MONEY|SMALLMONEY|BIT|IMAGE|NTEXT"
#: Texts in an error that a rewrite rule meets, and how sure the rule is (fixed values).
REWRITES = {r"SELECT\s+TOP\s+\d+": 0.90, r"DATEPART\(": 0.85, r"GETDATE\(\)": 0.98, r"NEWID\(\)": 0.95, r"ISNULL\(": 0.97, r"OFFSET\s+\d+\s+ROWS\s+FETCH\s+NEXT": 0.93}


def fixes(issues: DataFrame) -> DataFrame:
    """issues (id, kind, cause, known) with fix and likely: what kind of fix an issue gets, and how likely it works."""
    kind, cause = F.col("kind"), F.col("cause")
    fix = F.when(kind == "sql", "SQL_REWRITE").when(kind == "schema", "SCHEMA_ADJUSTMENT").when(kind == "data", "DATA_NORMALIZATION").when(kind.isin("orm", "api"), "QUERY_BEHAVIOR").otherwise("GENERIC")
    sure = F.greatest(*[F.when(cause.rlike(f"(?i){p}"), c).otherwise(0.0) for p, c in REWRITES.items()])
    low = F.lower(cause)
    normal = LIKELY["DATA_NORMALIZATION"]
    data = F.when(low.contains("precision"), normal["precision"]).when(low.contains("datetime"), normal["datetime"]).when(low.contains("rounding"), normal["rounding"]).otherwise(normal[""])
    likely = (
        F.when(kind == "sql", F.when(sure > 0, sure).otherwise(LIKELY["SQL_REWRITE"])).when(kind == "schema", F.when(cause.rlike(f"(?i){TYPE_RULES}"), LIKELY["SCHEMA_ADJUSTMENT"][0]).otherwise(LIKELY["SCHEMA_ADJUSTMENT"][1]))
        .when(kind == "data", data).when(kind == "orm", F.when(F.col("known"), LIKELY["QUERY_BEHAVIOR"][0]).otherwise(LIKELY["QUERY_BEHAVIOR"][1])).when(kind == "api", LIKELY["API_CONTRACT"]).otherwise(0.30)
    )
    return issues.withColumn("fix", fix).withColumn("likely", likely)


CAUSES = {"sql": "Incorrect syntax near SELECT TOP 5", "schema": "cannot map DATETIME2 to a column", "data": "precision of total differs", "orm": "other order of rows", "api": "field missing"}


def _issues(spark, sf) -> DataFrame:
    """A row an event, as an issue whose kind and cause follow from it."""
    names = list(CAUSES)
    kind = F.get(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % 6).cast("int"))
    cause = F.element_at(F.create_map(*[F.lit(x) for p in CAUSES.items() for x in p]), F.coalesce(kind, F.lit("api")))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.coalesce(kind, F.lit("odd")).alias("kind"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("rounding: "), F.col("event_type"))).otherwise(cause).alias("cause"), (F.col("user_id") % 2 == 0).alias("known"))


_ISSUES = "i AS (SELECT event_id AS id, coalesce(['sql', 'schema', 'data', 'orm', 'api'][event_id % 6 + 1], 'odd') AS kind, CASE WHEN event_id % 4 = 0 THEN 'rounding: ' || event_type ELSE CASE coalesce(['sql', 'schema', 'data', 'orm', 'api'][event_id % 6 + 1], 'api') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CAUSES.items()) + " END END AS cause, user_id % 2 = 0 AS known FROM events)"
_LIKELY = "CASE kind WHEN 'sql' THEN CASE WHEN cause LIKE '%SELECT TOP 5%' THEN 0.9 ELSE 0.5 END WHEN 'schema' THEN CASE WHEN cause LIKE '%DATETIME2%' THEN 0.8 ELSE 0.5 END WHEN 'data' THEN CASE WHEN cause LIKE '%precision%' THEN 0.85 WHEN cause LIKE '%datetime%' THEN 0.8 WHEN cause LIKE '%rounding%' THEN 0.7 ELSE 0.75 END WHEN 'orm' THEN CASE WHEN known THEN 0.9 ELSE 0.5 END WHEN 'api' THEN 0.7 ELSE 0.3 END"


@query("fix_strategies", f"WITH {_ISSUES} SELECT CASE kind WHEN 'sql' THEN 'SQL_REWRITE' WHEN 'schema' THEN 'SCHEMA_ADJUSTMENT' WHEN 'data' THEN 'DATA_NORMALIZATION' WHEN 'odd' THEN 'GENERIC' ELSE 'QUERY_BEHAVIOR' END AS fix, CAST({_LIKELY} AS DOUBLE) AS likely, CAST(count(*) AS BIGINT) AS n FROM i GROUP BY 1, 2")
def fix_strategies(spark, sf):
    return fixes(_issues(spark, sf)).groupBy("fix", "likely").agg(F.count(F.lit(1)).alias("n"))


def until_stable(issues: DataFrame, works: Callable[[int], Column], most: int = 10, calm: int = 2) -> DataFrame:
    """issues (id, ...) with state and rounds after rounds of fixing and running again: an issue whose fix works in a round is RESOLVED.

    works(round): whether the tests of an issue pass after that round's fix. Ends after so many rounds, or when calm rounds
    in a row change nothing. A round's state is a table; only a count comes to the driver.
    """
    now = saved(issues.withColumn("state", F.lit("IDENTIFIED")).withColumn("rounds", F.lit(0)), "fix-round")
    still = 0
    for k in range(1, most + 1):
        open_ = F.col("state") == "IDENTIFIED"
        now = saved(now.withColumn("rounds", F.when(open_, F.lit(k)).otherwise(F.col("rounds"))).withColumn("state", F.when(open_ & works(k), "RESOLVED").otherwise(F.col("state"))), "fix-round")
        changed = now.where((F.col("rounds") == k) & (F.col("state") == "RESOLVED")).count()
        still = 0 if changed else still + 1
        if still >= calm or now.where("state = 'IDENTIFIED'").isEmpty():
            break
    return now


@query("fix_loop", f"WITH {_ISSUES}, l AS (SELECT id, CAST({_LIKELY} AS DOUBLE) AS likely FROM i), r AS (SELECT id, CASE WHEN likely >= 0.8 THEN 1 WHEN likely >= 0.7 THEN 2 WHEN likely >= 0.5 THEN 3 ELSE NULL END AS k FROM l) SELECT CASE WHEN k IS NULL THEN 'IDENTIFIED' ELSE 'RESOLVED' END AS state, CAST(coalesce(k, 5) AS INT) AS rounds, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1, 2")
def fix_loop(spark, sf):
    """Likelier fixes work in earlier rounds; those under a half never do, and two rounds without a change end it."""
    limits = {1: 0.8, 2: 0.7, 3: 0.5}
    done = until_stable(fixes(_issues(spark, sf)).select("id", "likely"), lambda k: F.col("likely") >= limits.get(k, 2.0))
    return done.groupBy("state", "rounds").agg(F.count(F.lit(1)).alias("n"))
