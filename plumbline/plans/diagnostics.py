"""What in a statement may be in the way on another database: a row an object (table, column, function, join) with its risk.

Works on any DataFrame (id, sql), a stage without a shuffle; the summary is one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query, table
from .transpile import Transpiler

#: Names that are words of SQL (fixed values).
RESERVED = (
    "ORDER GROUP SELECT FROM WHERE TABLE INDEX VIEW USER ROLE SCHEMA DATABASE CASE WHEN THEN ELSE END KEY VALUE TYPE NAME STATE STATUS LEVEL SIZE DATE TIME TIMESTAMP ROW COLUMN CHECK DEFAULT PRIMARY "
    "FOREIGN REFERENCES CONSTRAINT ASC DESC LIMIT OFFSET FETCH UNION INTERSECT EXCEPT GRANT REVOKE DENY COMMIT ROLLBACK SAVEPOINT CROSS FULL INNER JOIN LEFT NATURAL OUTER RIGHT ON BETWEEN IN IS LIKE NOT NULL "
    "AND OR XOR TRUE FALSE ANY ALL SOME EXISTS BEGIN DECLARE EXEC EXECUTE CALL"
).split()
#: Functions that every database has, and those of the target besides (fixed values).
STANDARD = "COUNT SUM AVG MIN MAX COALESCE NULLIF CAST UPPER LOWER TRIM SUBSTRING REPLACE ABS ROUND CEILING FLOOR CURRENT_TIMESTAMP CURRENT_DATE ROW_NUMBER RANK DENSE_RANK NTILE LAG LEAD FIRST_VALUE LAST_VALUE CONCAT".split()
NATIVE = "NOW CURRENT_TIMESTAMP COALESCE LENGTH POSITION EXTRACT AGE GEN_RANDOM_UUID".split()
#: Words before a parenthesis that are no functions.
NOT_FUNCTIONS = "IN VALUES OVER WITH AS EXISTS AND OR NOT ON FROM JOIN SELECT WHERE BY THEN ELSE WHEN HAVING UNION ALL USING INTO VARCHAR NVARCHAR CHAR NCHAR DECIMAL NUMERIC FLOAT TOP SET LIKE BETWEEN DISTINCT APPLY PIVOT UNPIVOT".split()
NAME = r"(?:\[[^\]]+\]|[A-Z_#][A-Z0-9_#$]*)"


def clean(sql: Column) -> Column:
    """Without comments and strings, in upper case."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(sql, r"--[^\n]*", " "), r"(?s)/\*.*?\*/", " "), r"'(?:[^']|'')*'", "''")
    return F.upper(bare)


def objects(corpus: DataFrame) -> DataFrame:
    """id, object, name and risk (NONE, LOW, MEDIUM, HIGH) of what the texts name, each name once a text and kind."""
    u = F.col("_u")
    bracket, plain = lambda n: n.contains("["), lambda n: F.element_at(F.split(F.regexp_replace(n, r"[\[\]]", ""), r"\."), -1)
    rewritten = [*Transpiler().functions, "TRY_CAST"]

    def found(pattern: str) -> Column:
        return F.array_distinct(F.regexp_extract_all(u, F.lit(pattern), F.lit(1)))

    def each(kind: str, names: Column, risk) -> Column:
        return F.transform(names, lambda n: F.struct(F.lit(kind).alias("object"), n.alias("name"), risk(n).alias("risk")))

    tables = each("table", found(rf"\b(?:FROM|JOIN|UPDATE|INTO|USING)\s+({NAME}(?:\.{NAME})*)"), lambda n: F.when(bracket(n), "MEDIUM").when(plain(n).isin(*RESERVED), "LOW").otherwise("NONE"))
    columns = each("column", found(rf"\b[A-Z_][A-Z0-9_]*\.({NAME})"), lambda n: F.when(bracket(n) | plain(n).isin(*RESERVED), "LOW").otherwise("NONE"))
    names = F.filter(found(r"\b([A-Z_][A-Z0-9_]*)\s*\("), lambda n: ~n.isin(*NOT_FUNCTIONS))
    functions = each("function", names, lambda n: F.when(n.isin(*STANDARD, *NATIVE), "NONE").when(n.isin(*rewritten), "LOW").otherwise("HIGH"))
    kinds = F.array_distinct(F.transform(F.regexp_extract_all(u, F.lit(r"\b(?:(INNER|LEFT|RIGHT|FULL|CROSS|NATURAL)\s+(?:OUTER\s+)?)?JOIN\b"), F.lit(1)), lambda j: F.when(j == "", "INNER").otherwise(j)))
    joins = each("join", kinds, lambda j: F.when(j.isin("FULL", "CROSS"), "LOW").when(j == "NATURAL", "MEDIUM").otherwise("NONE"))
    return corpus.select("id", clean(F.col("sql")).alias("_u")).select("id", F.explode(F.concat(tables, columns, functions, joins)).alias("o")).select("id", "o.*")


def summary(found: DataFrame) -> DataFrame:
    """How many objects of each kind have which risk."""
    return found.groupBy("object", "risk").agg(F.count(F.lit(1)).alias("n"))


PARTS = (
    ["p.name, COUNT(*)", "ISNULL(p.size, 0), FOO_BAR(x)", "LEN(p.[name]), UPPER(p.kind) /* SECRET( */", "NOW(), STUFF(a, 1, 2, ''IN (x)'')"],
    ["parts p", "[part list] p", "dbo.orders p"],
    ["", " JOIN users u ON u.id = p.id", " LEFT JOIN [user] u ON u.key = p.id", " FULL OUTER JOIN status s ON s.id = p.id", " NATURAL JOIN view"],
)


def texts(spark, sf: str) -> DataFrame:
    """A statement a part, put together from pieces by its key."""
    k = F.col("p_partkey")
    piece = lambda i: F.get(F.array(*[F.lit(x.replace("''", "'")) for x in PARTS[i]]), (k % len(PARTS[i])).cast("int"))
    return table(spark, sf, "part").select(k.alias("id"), F.concat(F.lit("SELECT "), piece(0), F.lit(" FROM "), piece(1), piece(2)).alias("sql"))


#: What each piece names, for the oracle: by hand, not by the patterns above.
TOLD = (
    [[("column", "NAME", "LOW"), ("function", "COUNT", "NONE")], [("column", "SIZE", "LOW"), ("function", "ISNULL", "LOW"), ("function", "FOO_BAR", "HIGH")], [("column", "[NAME]", "LOW"), ("column", "KIND", "NONE"), ("function", "LEN", "LOW"), ("function", "UPPER", "NONE")], [("function", "NOW", "NONE"), ("function", "STUFF", "LOW")]],
    [[("table", "PARTS", "NONE")], [("table", "[PART LIST]", "MEDIUM")], [("table", "DBO.ORDERS", "NONE"), ("column", "ORDERS", "NONE")]],
    [[], [("table", "USERS", "NONE"), ("join", "INNER", "NONE"), ("column", "ID", "NONE")], [("table", "[USER]", "MEDIUM"), ("join", "LEFT", "NONE"), ("column", "KEY", "LOW"), ("column", "ID", "NONE")], [("table", "STATUS", "LOW"), ("join", "FULL", "LOW"), ("column", "ID", "NONE")], [("table", "VIEW", "LOW"), ("join", "NATURAL", "MEDIUM")]],
)
_TOLD = "t(part, k, object, name, risk) AS (VALUES " + ", ".join(f"({i}, {k}, '{o}', '{n}', '{r}')" for i, some in enumerate(TOLD) for k, told in enumerate(some) for o, n, r in told) + ")"
_FOUND = f"WITH {_TOLD}, o AS (SELECT DISTINCT p_partkey AS id, object, name, risk FROM part JOIN t ON (part = 0 AND k = p_partkey % 4) OR (part = 1 AND k = p_partkey % 3) OR (part = 2 AND k = p_partkey % 5))"


@query("sql_objects", f"{_FOUND} SELECT * FROM o")
def sql_objects(spark, sf):
    return objects(texts(spark, sf))


@query("sql_objects_summary", f"{_FOUND} SELECT object, risk, CAST(count(*) AS BIGINT) AS n FROM o GROUP BY object, risk")
def sql_objects_summary(spark, sf):
    return summary(objects(texts(spark, sf)))
