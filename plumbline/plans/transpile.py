"""T-SQL to Spark SQL: token trees are rewritten block by block, so literals and comments can't be hit by accident."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions.tsql import STYLES, like_to_regex, unit_of
from ..registry import exact_sum
from .lexer import Group, Token, split, tokenize, tree

#: How sure a rewrite is (fixed values).
CONFIDENCE = {
    "top_to_limit": 0.98, "top_percent": 0.9, "top_with_ties": 0.95, "offset_fetch": 0.98, "fetch_first": 0.95, "brackets": 0.99, "national_strings": 0.99, "hints": 0.95, "getdate": 0.95, "getutcdate": 0.9, "sysdatetime": 0.92,
    "isnull": 0.98, "len": 0.95, "newid": 0.95, "charindex": 0.95, "patindex": 0.85, "stuff": 0.95, "replicate": 0.98, "dateadd": 0.95, "datediff": 0.9, "datepart": 0.9, "datename": 0.85, "eomonth": 0.95, "datetrunc": 0.9, "format": 0.8,
    "iif": 0.99, "choose": 0.98, "convert": 0.85, "try_convert": 0.85, "concat": 0.95, "quotename": 0.95, "plus_concat": 0.85, "apply": 0.95, "variables": 0.95, "select_into": 0.85, "isnumeric": 0.9, "schema_prefix": 0.98, "types": 0.95, "identity": 0.6, "update": 0.9, "update_join": 0.8, "delete": 0.95, "delete_join": 0.85, "for_json": 0.8, "json_value": 0.95, "string_split": 0.95, "generate_series": 0.95, "ident_current": 0.6,
    "for_xml": 0.8, "merge": 0.85, "output": 0.85, "concat_ws": 0.95,
}
TYPES = {
    "NVARCHAR": "STRING", "VARCHAR": "STRING", "NCHAR": "STRING", "CHAR": "STRING", "TEXT": "STRING", "NTEXT": "STRING", "BIT": "BOOLEAN", "DATETIME": "TIMESTAMP_NTZ", "DATETIME2": "TIMESTAMP_NTZ", "SMALLDATETIME": "TIMESTAMP_NTZ",
    "DATETIMEOFFSET": "TIMESTAMP", "TINYINT": "SMALLINT", "MONEY": "DECIMAL(19,4)", "SMALLMONEY": "DECIMAL(10,4)", "REAL": "FLOAT", "FLOAT": "DOUBLE", "UNIQUEIDENTIFIER": "STRING", "VARBINARY": "BINARY", "IMAGE": "BINARY", "NUMERIC": "DECIMAL", "XML": "STRING",
}
SIZELESS = {"STRING", "TIMESTAMP_NTZ", "TIMESTAMP", "BINARY", "DOUBLE", "BOOLEAN"}
CLAUSES = {"FROM", "WHERE", "GROUP", "HAVING", "ORDER", "OFFSET", "UNION", "EXCEPT", "INTERSECT", "INTO", "FOR", "OPTION"}
HINTS = {"NOLOCK", "READUNCOMMITTED", "READCOMMITTED", "READPAST", "ROWLOCK", "PAGLOCK", "TABLOCK", "TABLOCKX", "UPDLOCK", "XLOCK", "HOLDLOCK", "SERIALIZABLE", "REPEATABLEREAD", "NOEXPAND"}
OPERATORS = re.compile(r"[-+*/%=<>!|&^,]|<>|!=|<=|>=")


@dataclass
class Result:
    sql: str
    applied: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    #: names of variables, which become :name parameters
    parameters: list[str] = field(default_factory=list)
    #: the rows of an OUTPUT clause, from the table as it was before the statement; and where INTO sends them
    output: str = ""
    output_into: str = ""
    #: counts the rows that an UPDATE, DELETE or MERGE hits
    hits: str = ""
    #: counts what must not be there for the plan to be right: target rows of a MERGE that meet several source rows
    check: str = ""

    @property
    def confidence(self) -> float:
        """The geometric mean over the rules that were applied."""
        sure = [CONFIDENCE[r] for r in self.applied]
        return round(math.exp(sum(map(math.log, sure)) / len(sure)), 4) if sure else 1.0


class Transpiler:
    def __init__(self, exact: tuple[str, ...] = (), settled: bool = False):
        self.result = Result("")
        #: columns of doubles whose SUM is rounded once at its end; whether rows that tie at a limit go by the selected columns
        self.exact, self.settled = exact, settled
        #: how many parentheses are open around what is written
        self.depth = 0
        self.functions: dict[str, Callable[[list[str]], str]] = {
            "GETDATE": self.plain("getdate", "localtimestamp()"), "SYSDATETIME": self.plain("sysdatetime", "localtimestamp()"), "SYSDATETIMEOFFSET": self.plain("sysdatetime", "current_timestamp()"),
            "GETUTCDATE": self.plain("getutcdate", "CAST(to_utc_timestamp(current_timestamp(), current_timezone()) AS TIMESTAMP_NTZ)"), "SYSUTCDATETIME": self.plain("getutcdate", "CAST(to_utc_timestamp(current_timestamp(), current_timezone()) AS TIMESTAMP_NTZ)"),
            "NEWID": self.plain("newid", "uuid()"), "GEN_RANDOM_UUID": self.plain("newid", "uuid()"), "ISNULL": self.call("isnull", "coalesce({0}, {1})"), "LEN": self.call("len", "length(rtrim({0}))"), "REPLICATE": self.call("replicate", "repeat({0}, {1})"),
            "IIF": self.call("iif", "if({0}, {1}, {2})"), "CHARINDEX": self.charindex, "PATINDEX": self.patindex, "STUFF": self.call("stuff", "overlay({0} PLACING {3} FROM {1} FOR {2})"), "CHOOSE": lambda a: self.done("choose", f"elt({', '.join(a)})"),
            "DATEADD": self.dateadd, "DATEDIFF": self.datediff, "DATEDIFF_BIG": self.datediff, "DATEPART": self.datepart, "DATENAME": self.datename, "DATETRUNC": self.datetrunc, "EOMONTH": self.eomonth, "FORMAT": self.format, "CONVERT": self.convert("CAST", "convert"),
            "TRY_CONVERT": self.convert("try_cast", "try_convert"), "CONCAT": lambda a: self.done("concat", "concat(" + ", ".join(f"coalesce(CAST({x} AS STRING), '')" for x in a) + ")"),
            "CONCAT_WS": lambda a: self.done("concat_ws", f"concat_ws({', '.join(a)})"),
            "JSON_VALUE": self.call("json_value", "get_json_object({0}, {1})"), "JSON_QUERY": self.call("json_value", "get_json_object({0}, {1})"),
            "STRING_SPLIT": self.call("string_split", "(SELECT explode(split({0}, concat('\\\\Q', {1}, '\\\\E'))) AS value)"), "GENERATE_SERIES": self.series,
            "SCOPE_IDENTITY": self.identity, "IDENT_CURRENT": self.identity, "QUOTENAME": self.call("quotename", "concat('[', replace({0}, ']', ']]'), ']')"), "ISNUMERIC": self.call("isnumeric", "CAST(coalesce(CAST({0} AS STRING) RLIKE '^[+-]?([0-9]+[.]?[0-9]*|[0-9]*[.]?[0-9]+)$', false) AS INT)"),
        }

        if exact:
            self.functions["SUM"] = lambda a: exact_sum(a[0]) if a[0] in exact else f"sum({a[0]})"

    def done(self, rule: str, sql: str) -> str:
        if rule not in self.result.applied:
            self.result.applied.append(rule)
        return sql

    def plain(self, rule: str, sql: str):
        return lambda args: self.done(rule, sql)

    def call(self, rule: str, template: str):
        return lambda args: self.done(rule, template.format(*args))

    # --- functions whose form depends on their arguments ---
    def series(self, a: list[str]) -> str:
        return self.done("generate_series", f"(SELECT explode(sequence({', '.join(a)})) AS value)")

    def identity(self, a: list[str]) -> str:
        self.result.warnings.append("identities are given by the writer: see surrogate_key")
        return self.done("ident_current", "CAST(NULL AS BIGINT)")

    def charindex(self, a: list[str]) -> str:
        return self.done("charindex", f"locate({', '.join(a)})")

    def patindex(self, a: list[str]) -> str:
        body = a[0].strip()
        if not (body.startswith("'") and body.endswith("'")):
            self.result.warnings.append("PATINDEX with a pattern that is not a literal")
            return f"PATINDEX({', '.join(a)})"
        p = body[1:-1].replace("''", "'")
        regex = ("" if p.startswith("%") else "^") + like_to_regex(p.strip("%")) + ("" if p.endswith("%") else "$")
        regex = regex.replace("\\", "\\\\").replace("'", "\\'")
        return self.done("patindex", f"regexp_instr({a[1]}, '{regex}')")

    def dateadd(self, a: list[str]) -> str:
        u = unit_of(a[0])
        n = f"({a[1]})" if not re.fullmatch(r"-?\s*\d+", a[1]) else a[1].replace(" ", "")
        u, n = ("MONTH", f"3 * {n}") if u == "QUARTER" else ("DAY", n) if u in ("DAYOFYEAR", "WEEKDAY") else (u, n)
        return self.done("dateadd", f"timestampadd({u}, {n}, {a[2]})")

    def datediff(self, a: list[str]) -> str:
        u, x, y = unit_of(a[0]), a[1], a[2]
        days = lambda d: f"datediff(CAST({d} AS DATE), DATE '1970-01-01')"
        seconds = lambda d: f"(CAST({days(d)} AS BIGINT) * 86400 + hour({d}) * 3600 + minute({d}) * 60 + second({d}))"
        if u == "YEAR":
            sql = f"(year({y}) - year({x}))"
        elif u in ("QUARTER", "MONTH"):
            k, f = (4, "quarter") if u == "QUARTER" else (12, "month")
            sql = f"((year({y}) * {k} + {f}({y})) - (year({x}) * {k} + {f}({x})))"
        elif u in ("DAY", "DAYOFYEAR", "WEEKDAY"):
            sql = f"datediff(CAST({y} AS DATE), CAST({x} AS DATE))"
        elif u == "WEEK":
            sql = f"CAST(floor(({days(y)} + 4) / 7) - floor(({days(x)} + 4) / 7) AS INT)"
        else:
            n = {"HOUR": 3600, "MINUTE": 60, "SECOND": 1}[u]
            sql = f"({seconds(y)} DIV {n} - {seconds(x)} DIV {n})"
        return self.done("datediff", sql)

    def datepart(self, a: list[str]) -> str:
        u = unit_of(a[0])
        f = {"YEAR": "year", "QUARTER": "quarter", "MONTH": "month", "DAY": "day", "DAYOFYEAR": "dayofyear", "WEEKDAY": "dayofweek", "HOUR": "hour", "MINUTE": "minute", "SECOND": "second"}.get(u)
        if f is None:
            return self.done("datepart", f"CAST(floor((dayofyear({a[1]}) + dayofweek(trunc({a[1]}, 'YEAR')) - 2) / 7) + 1 AS INT)")
        return self.done("datepart", f"{f}({a[1]})")

    def datename(self, a: list[str]) -> str:
        u = unit_of(a[0])
        if u in ("MONTH", "WEEKDAY"):
            return self.done("datename", f"date_format({a[1]}, '{'MMMM' if u == 'MONTH' else 'EEEE'}')")
        return self.done("datename", f"CAST({self.datepart(a)} AS STRING)")

    def datetrunc(self, a: list[str]) -> str:
        return self.done("datetrunc", f"CAST(date_trunc('{unit_of(a[0])}', {a[1]}) AS TIMESTAMP_NTZ)")

    def eomonth(self, a: list[str]) -> str:
        return self.done("eomonth", f"last_day({a[0]})" if len(a) == 1 else f"last_day(add_months({a[0]}, {a[1]}))")

    def format(self, a: list[str]) -> str:
        p = a[1].strip()[1:-1]
        if m := re.fullmatch(r"[Nn](\d*)", p):
            return self.done("format", f"format_number({a[0]}, {m[1] or 2})")
        if p in ("C", "c"):
            return self.done("format", f"concat('$', format_number({a[0]}, 2))")
        return self.done("format", f"date_format({a[0]}, '{p.replace('dddd', 'EEEE').replace('ddd', 'EEE')}')")

    def convert(self, cast: str, rule: str):
        def run(a: list[str]) -> str:
            if len(a) > 2 and self.type_of(a[0]) == "STRING":
                style = int(a[2])
                if style in STYLES:
                    quoted = STYLES[style].replace("'", "\\'")
                    return self.done(rule, f"date_format({a[1]}, '{quoted}')")
                self.result.warnings.append(f"CONVERT style {style} is not known")
            return self.done(rule, f"{cast}({a[1]} AS {self.type_of(a[0])})")

        return run

    def type_of(self, text: str) -> str:
        """A type's Spark name; sizes go where Spark's type has none."""
        m = re.fullmatch(r"\s*(\w+)\s*(\(.*\))?\s*", text)
        if not m:
            return text
        name = TYPES.get(m[1].upper(), m[1].upper())
        if name != m[1].upper():
            self.done("types", "")
        return name if name in SIZELESS or "(" in name else name + (m[2] or "").replace(" ", "")

    # --- trees to text ---
    def args(self, group: Group) -> list[str]:
        return [self.expression(p) for p in split(group.items, ",")] if group.items else []

    def expression(self, items: list) -> str:
        if items and isinstance(items[0], Token) and items[0].upper in ("SELECT", "WITH"):
            return self.query(items)
        return self.raw(items)

    def raw(self, items: list) -> str:
        """Items that are no query, part by part."""
        out: list[str] = []
        i = 0
        while i < len(items):
            x = items[i]
            nxt = items[i + 1] if i + 1 < len(items) else None
            if isinstance(x, Group):
                self.depth += 1
                out.append("(" + self.expression(x.items) + ")")
                self.depth -= 1
            elif x.kind == "word" and isinstance(nxt, Group) and x.upper in self.functions:
                out.append(self.functions[x.upper](self.args(nxt)))
                i += 1
            elif x.kind == "word" and isinstance(nxt, Group) and x.upper in ("CAST", "TRY_CAST"):
                at = max(k for k, y in enumerate(nxt.items) if isinstance(y, Token) and y.upper == "AS")
                kind = self.type_of(self.expression(nxt.items[at + 1 :]))
                out.append(f"{'CAST' if x.upper == 'CAST' else 'try_cast'}({self.expression(nxt.items[:at])} AS {kind})")
                i += 1
            elif x.kind == "word" and x.upper == "WITH" and isinstance(nxt, Group) and nxt.items and all(isinstance(y, Token) and (y.upper in HINTS or y.text == ",") for y in nxt.items):
                self.done("hints", "")
                i += 1
            elif x.kind == "word" and x.upper in ("CROSS", "OUTER") and isinstance(nxt, Token) and nxt.upper == "APPLY":
                out.append(self.done("apply", "JOIN LATERAL" if x.upper == "CROSS" else "LEFT JOIN LATERAL"))
                i += 2
                table = [items[i]]
                if not isinstance(items[i], Group) and i + 1 < len(items) and isinstance(items[i + 1], Group):
                    i += 1
                    table.append(items[i])
                out.append(self.expression(table))
                while i + 1 < len(items) and isinstance(items[i + 1], Token) and items[i + 1].kind in ("word", "bracket") and items[i + 1].upper not in CLAUSES | {"CROSS", "OUTER", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "ON"}:
                    i += 1
                    out.append(self.token(items[i]))
                out.append("ON true")
            elif x.kind == "word" and x.upper == "DBO" and isinstance(nxt, Token) and nxt.text == ".":
                self.done("schema_prefix", "")
                i += 1
            else:
                out.append(self.token(x))
            i += 1
        return self.plus(tidy(out), items)

    def plus(self, text: str, items: list) -> str:
        """+ between strings becomes ||, where a literal or a cast to a string shows that it joins text."""
        tops = [x for x in items if isinstance(x, Token)]
        if any(t.text == "+" for t in tops) and any(t.kind == "string" for t in tops):
            self.done("plus_concat", "")
            return re.sub(r" \+ (?=(?:[^']*'[^']*')*[^']*$)", " || ", text)
        return text

    def token(self, x: Token) -> str:
        if x.kind == "bracket":
            return self.done("brackets", "`" + x.text[1:-1].replace("]]", "]").replace("`", "``") + "`")
        if x.kind == "quoted":
            return "`" + x.text[1:-1].replace('""', '"') + "`"
        if x.kind == "string":
            body = x.text
            if body[0] in "nN":
                body = self.done("national_strings", body[1:])
            inner = body[1:-1].replace("''", "'").replace("\\", "\\\\").replace("'", "\\'")
            return f"'{inner}'"
        if x.kind == "variable":
            if x.text.upper() in ("@@IDENTITY", "@@ROWCOUNT", "@@ERROR", "@@TRANCOUNT"):
                self.result.warnings.append(f"{x.text} has no value in Spark")
                return self.done("identity", "CAST(NULL AS BIGINT)")
            name = x.text.lstrip("@")
            if name not in self.result.parameters:
                self.result.parameters.append(name)
            return self.done("variables", f":{name}")
        return x.text

    # --- statements that change rows: the query gives the table as it is afterwards ---
    def clauses(self, items: list, names: tuple[str, ...]) -> dict[str, list]:
        """Items by the clause words that stand at this level; what comes first has the key ''."""
        out: dict[str, list] = {"": []}
        now = ""
        for x in items:
            if isinstance(x, Token) and x.kind == "word" and x.upper in names and x.upper not in out:
                now = x.upper
                out[now] = []
            else:
                out[now].append(x)
        return out

    @staticmethod
    def named(items: list) -> tuple[list, Token]:
        """A table reference's name, and its alias or last part."""
        k = 1
        while k + 1 < len(items) and isinstance(items[k], Token) and items[k].text == ".":
            k += 2
        rest = [x for x in items[k:] if not (isinstance(x, Token) and x.upper == "AS")]
        return items[:k], rest[0] if rest and isinstance(rest[0], Token) and rest[0].kind in ("word", "bracket") and rest[0].upper not in ("WITH", "ON") else items[k - 1]

    def joined(self, items: list) -> tuple[tuple[list, Token], list[tuple[str, list, Token, list]]]:
        """The target of FROM <target> JOIN <source> ON <condition> JOIN ..., and each source with how it is joined and its condition."""
        words = [x.upper if isinstance(x, Token) else "" for x in items]
        at = [k for k, w in enumerate(words) if w == "JOIN"]
        if any(isinstance(x, Token) and x.text == "," for x in items):
            raise ValueError("FROM with commas cannot be rewritten; write it as JOIN")
        starts = []
        for k in at:
            first = k
            while words[first - 1] in ("INNER", "LEFT", "OUTER", "RIGHT", "FULL", "CROSS"):
                first -= 1
            how = " ".join(words[first : k + 1])
            if how not in ("JOIN", "INNER JOIN", "LEFT JOIN", "LEFT OUTER JOIN"):
                raise ValueError(f"{how} in a statement that changes rows cannot be rewritten")
            starts.append((first, k, "LEFT JOIN" if how.startswith("LEFT") else "JOIN"))
        head = self.named(items[: starts[0][0]] if starts else items)
        sources = []
        for (_, k, how), end in zip(starts, [*(first for first, _, _ in starts[1:]), len(items)]):
            on = words.index("ON", k, end)
            name, alias = self.named(items[k + 1 : on])
            sources.append((how, name, alias, items[on + 1 : end]))
        return head, sources

    def met(self, sources: list[tuple[str, list, Token, list]], where: str) -> str:
        """FROM ... WHERE of the sources for a row of the target. Conditions of inner joins stand in WHERE, where they may name it."""
        out, conditions = "", []
        for k, (how, name, alias, on) in enumerate(sources):
            table = f"{self.expression(name)} {self.token(alias)}"
            if how == "LEFT JOIN" and k:
                out += f" LEFT JOIN {table} ON {self.expression(on)}"
            elif how == "LEFT JOIN":
                raise ValueError("a LEFT JOIN right after the target cannot be rewritten")
            else:
                out += (" CROSS JOIN " if k else "FROM ") + table
                conditions.append(f"({self.expression(on)})")
        return f"{out} WHERE {' AND '.join([*conditions, f'({where})'])}"

    def output(self, items: list, inserted: Callable[[str], str], deleted: Callable[[str], str]) -> str:
        """The select list of an OUTPUT clause."""
        words = [x.upper if isinstance(x, Token) else "" for x in items]
        if "INTO" in words:
            k = words.index("INTO")
            self.result.output_into = render(items[k + 1 : k + 2])
            items = items[:k]
        columns = []
        for p in split(items, ","):
            text = self.expression(p)
            if re.search(r"(?i)\b(inserted|deleted)\.\*", text):
                raise ValueError("OUTPUT with * cannot be rewritten; name the columns")
            bare = re.fullmatch(r"(?i)(?:inserted|deleted)\.(`[^`]+`|\w+)", text)
            new = re.sub(r"(?i)\binserted\.(`[^`]+`|\w+)", lambda m: f"({inserted(m[1])})", text)
            new = re.sub(r"(?i)\bdeleted\.(`[^`]+`|\w+)", lambda m: f"({deleted(m[1])})", new)
            columns.append(f"{new} AS {bare[1]}" if bare else new)
        self.done("output", "")
        return ", ".join(columns)

    def assignments(self, items: list) -> dict[str, str]:
        sets = {}
        for p in split(items, ","):
            eq = next(k for k, x in enumerate(p) if isinstance(x, Token) and x.text in ("=", "+=", "-="))
            column, value = self.token(p[eq - 1]), self.expression(p[eq + 1 :])
            sets[column] = value if p[eq].text == "=" else f"{self.expression(p[:eq])} {p[eq].text[0]} ({value})"
        return sets

    def update(self, items: list) -> str:
        part = self.clauses(items[1:], ("SET", "OUTPUT", "FROM", "WHERE"))
        table, alias = self.named(part[""])
        sources: list = []
        if "FROM" in part:
            (table, alias), sources = self.joined(part["FROM"])
        sets, a = self.assignments(part["SET"]), self.token(alias)
        where = self.expression(part["WHERE"]) if "WHERE" in part else "true"
        start = f"FROM {self.expression(table)} {a}"
        if sources:
            # one of the rows that meet a target row gives the values, as T-SQL has it; struct fields keep the sources' names
            names = [self.token(x[2]) for x in sources]
            one = ", ".join(f"struct({n}.*) AS {n}" for n in names)
            start += f" LEFT JOIN LATERAL (SELECT any_value(struct({one})) AS _m {self.met(sources, where)}) _u ON true"
            hit = "_u._m IS NOT NULL"
            field_of = re.compile(r"(?<![\w.`])(" + "|".join(map(re.escape, names)) + r")\.(?=[\w`])", re.I)
            sets = {c: field_of.sub(lambda m: f"_u._m.{m[1]}.", v) for c, v in sets.items()}
            self.done("update_join", "")
        else:
            hit = f"coalesce({where}, false)"
            self.done("update", "")
        lower = {c.lower(): v for c, v in sets.items()}
        if "OUTPUT" in part:
            self.result.output = f"SELECT {self.output(part['OUTPUT'], lambda c: lower.get(c.lower(), f'{a}.{c}'), lambda c: f'{a}.{c}')} {start} WHERE {hit}"
        self.result.hits = f"SELECT count(*) {start} WHERE {hit}"
        columns = ", ".join(f"CASE WHEN {hit} THEN {v} ELSE {a}.{c} END AS {c}" for c, v in sets.items())
        return f"SELECT {a}.* EXCEPT ({', '.join(sets)}), {columns} {start}"

    def delete(self, items: list) -> str:
        part = self.clauses(items[1:], ("OUTPUT", "FROM", "WHERE"))
        rest = part.get("FROM") or part[""]
        words = [x.upper if isinstance(x, Token) else "" for x in rest]
        if "FROM" in words:  # DELETE FROM t OUTPUT ... FROM t JOIN ...
            rest = rest[words.index("FROM") + 1 :]
        (table, alias), sources = self.joined(rest)
        a, where = self.token(alias), self.expression(part["WHERE"]) if "WHERE" in part else "true"
        start = f"FROM {self.expression(table)} {a}"
        if sources:
            self.done("delete_join", "")
            met = self.met(sources, where)
            hit, stays = f"EXISTS (SELECT 1 {met})", f"NOT EXISTS (SELECT 1 {met})"
        else:
            self.done("delete", "")
            hit, stays = f"coalesce({where}, false)", f"NOT coalesce({where}, false)"
        if "OUTPUT" in part:
            self.result.output = f"SELECT {self.output(part['OUTPUT'], lambda c: 'NULL', lambda c: f'{a}.{c}')} {start} WHERE {hit}"
        self.result.hits = f"SELECT count(*) {start} WHERE {hit}"
        return f"SELECT {a}.* {start} WHERE {stays}"

    def merge(self, items: list) -> str:
        """The target as it is after MERGE: a full join, and of each kind of row the first clause whose condition holds."""
        words = [x.upper if isinstance(x, Token) else "" for x in items]
        first = words.index("WHEN")
        using, on = words.index("USING"), words.index("ON")
        table, alias = self.named([x for x in items[1:using] if x.upper != "INTO"])
        source, other = self.named(items[using + 1 : on])
        a, b, condition = self.token(alias), self.token(other), self.expression(items[on + 1 : first])
        self.done("merge", "")
        self.result.warnings.append("MERGE fails in T-SQL where several source rows meet one target row: run check first, which counts such rows")
        self.result.check = f"SELECT count(*) FROM (SELECT {a}._r FROM (SELECT *, monotonically_increasing_id() AS _r FROM {self.expression(table)}) {a} JOIN {self.expression(source)} {b} ON {condition} GROUP BY {a}._r HAVING count(*) > 1)"
        tail = items[first:]
        end = next((k for k, x in enumerate(tail) if isinstance(x, Token) and x.upper == "OUTPUT"), len(tail))
        given, tail = tail[end + 1 :], tail[:end]
        kinds: dict[str, list[tuple[str, str, dict[str, str]]]] = {"matched": [], "source": [], "target": []}
        for clause in split_words(tail, "WHEN"):
            w = [x.upper if isinstance(x, Token) else "" for x in clause]
            then = w.index("THEN")
            kind = "matched" if w[0] == "MATCHED" else "target" if "SOURCE" in w[:then] else "source"
            test = self.expression(clause[w.index("AND") + 1 : then]) if "AND" in w[:then] else "true"
            do, rest = w[then + 1], clause[then + 2 :]
            if do == "UPDATE":
                values = self.assignments(rest[1:])
            elif do == "INSERT":
                columns = [self.token(p[0]) for p in split(rest[0].items, ",")]
                values = dict(zip(columns, self.args(rest[-1])))
            else:
                values = {}
            kinds[kind].append((test, do, values))
        rows = {"matched": f"{a}._t AND {b}._s", "source": f"{a}._t IS NULL", "target": f"{b}._s IS NULL"}
        cases = [(f"{rows[k]} AND coalesce({test}, false)", do, values) for k, clauses in kinds.items() for test, do, values in clauses]
        columns = list(dict.fromkeys(c for _, _, v in cases for c in v))
        start = f"FROM (SELECT *, true AS _t FROM {self.expression(table)}) {a} FULL JOIN (SELECT *, true AS _s FROM {self.expression(source)}) {b} ON {condition}"

        def after(c: str) -> str:
            return "CASE " + " ".join(f"WHEN {test} THEN {dict((k.lower(), v) for k, v in values.items()).get(c.lower(), 'NULL' if do == 'INSERT' else f'{a}.{c}')}" for test, do, values in cases) + f" ELSE {a}.{c} END"

        action = "CASE " + " ".join(f"WHEN {test} THEN '{do}'" for test, do, _ in cases) + " END"
        if given:
            given = [Token("word", "_action") if isinstance(x, Token) and x.text.lower() == "$action" else x for x in given]
            text = self.output(given, after, lambda c: f"{a}.{c}")
            self.result.output = f"SELECT {re.sub(r'^_action(?!\w)|(?<=, )_action(?!\w)', f'{action} AS action', text)} {start} WHERE {action} IS NOT NULL"
        self.result.hits = f"SELECT count({action}) {start}"
        changed = ", ".join(f"{after(c)} AS {c}" for c in columns)
        stays = f"coalesce({action}, CASE WHEN {a}._t THEN 'KEEP' ELSE 'DELETE' END) <> 'DELETE'"
        return f"SELECT {a}.* EXCEPT ({', '.join(['_t', *columns])}){', ' + changed if changed else ''} {start} WHERE {stays}"

    @staticmethod
    def xml_tags(items: list) -> tuple[str, str]:
        """The row's and the root's tag of FOR XML PATH; other modes are refused."""
        if not items or items[0].upper != "PATH":
            raise ValueError("only FOR XML PATH can be rewritten")
        row, root = "row", ""
        for k, x in enumerate(items):
            tag = items[k + 1].items[0].text.lstrip("nN").strip("'") if k + 1 < len(items) and isinstance(items[k + 1], Group) and items[k + 1].items else None
            if x.upper == "PATH" and tag is not None:
                row = tag
            elif x.upper == "ROOT":
                root = tag or "root"
        if not re.fullmatch(r"[A-Za-z_][\w.-]*", row) or not re.fullmatch(r"([A-Za-z_][\w.-]*)?", root):
            raise ValueError("FOR XML PATH needs tags that are names")
        return row, root

    # --- query blocks ---
    def query(self, items: list) -> str:
        """A query: common table expressions, then blocks joined by set operators."""
        head, i = "", 0
        if isinstance(items[0], Token) and items[0].upper == "WITH":
            while not (isinstance(items[i], Token) and items[i].upper == "SELECT"):
                i += 1
            head = self.expression_of_ctes(items[:i])
        blocks: list[list] = [[]]
        joins: list[str] = []
        for x in items[i:]:
            if isinstance(x, Token) and x.kind == "word" and x.upper in ("UNION", "EXCEPT", "INTERSECT"):
                joins.append(x.upper)
                blocks.append([])
            elif isinstance(x, Token) and x.upper == "ALL" and blocks[-1] == [] and joins:
                joins[-1] += " ALL"
            else:
                blocks[-1].append(x)
        out = self.block(blocks[0])
        for how, b in zip(joins, blocks[1:]):
            out += f" {how} {self.block(b)}"
        return head + out

    def expression_of_ctes(self, items: list) -> str:
        recursive = any(isinstance(x, Group) and self.mentions(x, items[k - 2]) for k, x in enumerate(items) if k > 2 and isinstance(items[k - 1], Token) and items[k - 1].upper == "AS")
        text = self.expression(items[1:])
        return ("WITH RECURSIVE " if recursive else "WITH ") + text + " "

    def mentions(self, group: Group, name) -> bool:
        return isinstance(name, Token) and any((isinstance(x, Token) and x.upper == name.upper) or (isinstance(x, Group) and self.mentions(x, name)) for x in group.items)

    def with_order(self, rest: list) -> tuple[int, str]:
        """How many columns were added, and a SELECT that gives what its ORDER BY needs as _order1, _order2, ...

        Spark makes a limit within a correlated subquery a ranked window, which gets the ORDER BY only where the sort stands
        right below the limit; a key that is not selected puts a projection between them, and the order is lost.
        """
        words = [x.upper if isinstance(x, Token) else "" for x in rest]
        if "FROM" not in words or "ORDER" not in words or words[1] == "DISTINCT":  # with DISTINCT all keys are selected
            return 0, "SELECT " + self.raw(rest[1:])
        f, k = words.index("FROM"), max(i for i, w in enumerate(words) if w == "ORDER")
        name = lambda x: x.text.strip('[]"`').lower() if isinstance(x, Token) else None
        selected = {name(c[-1]) for c in split(rest[1:f], ",")} - {"*", None}
        added, keys = [], []
        for key in split(rest[k + 2 :], ","):
            n = next((i for i, x in enumerate(key) if isinstance(x, Token) and x.upper in ("ASC", "DESC", "NULLS")), len(key))
            if len(key[:n]) == 1 and isinstance(key[0], Token) and (key[0].kind == "number" or name(key[0]) in selected):
                keys.append(self.raw(key))
                continue
            added.append(f"{self.raw(key[:n])} AS _order{len(added) + 1}")
            keys.append(" ".join([f"_order{len(added)}", *(x.text for x in key[n:])]))
        return len(added), f"SELECT {', '.join([self.raw(rest[1:f]), *added])} {self.raw(rest[f:k])} ORDER BY {', '.join(keys)}"

    def block(self, items: list) -> str:
        """One SELECT. TOP and OFFSET/FETCH become LIMIT or ranks over the block."""
        top = percent = ties = limit = offset = into = None
        rest = list(items)
        at = 1
        if len(rest) > 1 and isinstance(rest[1], Token) and rest[1].upper == "DISTINCT":
            at = 2
        if len(rest) > at and isinstance(rest[at], Token) and rest[at].upper == "TOP":
            top = self.expression([rest[at + 1]]).strip("() ")
            end = at + 2
            if end < len(rest) and isinstance(rest[end], Token) and rest[end].upper == "PERCENT":
                percent, end = True, end + 1
            if end + 1 < len(rest) and isinstance(rest[end], Token) and rest[end].upper == "WITH" and rest[end + 1].upper == "TIES":
                ties, end = True, end + 2
            del rest[at:end]
        words = [x.upper if isinstance(x, Token) else "" for x in rest]
        if "OFFSET" in words and words.index("OFFSET") + 1 < len(rest):
            k = words.index("OFFSET")
            tail = rest[k:]
            offset = self.expression([tail[1]])
            fetch = [i for i, w in enumerate(words[k:]) if w == "FETCH"]
            limit = self.expression([tail[fetch[0] + 2]]) if fetch else None
            del rest[k:]
            self.done("offset_fetch", "")
        elif "FETCH" in words:
            k = words.index("FETCH")
            limit = self.expression([rest[k + 2]])
            del rest[k:]
            self.done("fetch_first", "")
        words = [x.upper if isinstance(x, Token) else "" for x in rest]
        if "OPTION" in words:
            del rest[words.index("OPTION") : words.index("OPTION") + 2]
            self.done("hints", "")
            words = [x.upper if isinstance(x, Token) else "" for x in rest]
        if "INTO" in words and "FROM" in words and words.index("INTO") < words.index("FROM"):
            k = words.index("INTO")
            end = k + 2
            while end + 1 < len(rest) and words[end] == ".":
                end += 2
            into = self.expression(rest[k + 1 : end]).lstrip("#")
            del rest[k:end]
            self.done("select_into", "")
            words = [x.upper if isinstance(x, Token) else "" for x in rest]
        document = "FOR" in words and words.index("FOR") + 1 < len(words) and words[words.index("FOR") + 1] in ("JSON", "XML")
        xml = None
        if document:
            k = words.index("FOR")
            if words[k + 1] == "XML":
                xml = self.xml_tags(rest[k + 2 :])
            elif "AUTO" not in words[k:] and "PATH" not in words[k:]:
                raise ValueError("FOR JSON needs AUTO or PATH")
            del rest[k:]
            words = words[:k]
        if top is not None and (percent or ties):
            k = max(i for i, w in enumerate(words) if w == "ORDER") if "ORDER" in words else len(rest)
            order = self.expression(rest[k:])
            f = words.index("FROM")
            columns, source = self.expression(rest[1:f]), self.expression(rest[f:k])
            if percent:
                self.done("top_percent", "")
                self.result.warnings.append("TOP PERCENT ranks all rows in one task; operators.order.top_percent spreads them")
                inner = f"SELECT {columns}, row_number() OVER ({order}) AS _nth, count(*) OVER () AS _all {source}"
                sql = f"SELECT * EXCEPT (_nth, _all) FROM ({inner}) WHERE _nth <= ceil(_all * {top} / 100)"
            else:
                self.done("top_with_ties", "")
                sql = f"SELECT * EXCEPT (_nth) FROM (SELECT {columns}, rank() OVER ({order}) AS _nth {source}) WHERE _nth <= {top}"
        else:
            hidden, sql = self.with_order(rest) if self.depth and (top or limit or offset) is not None else (0, "SELECT " + self.raw(rest[1:]))
            if self.settled and not self.depth and (top or limit or offset) is not None and "ORDER" in words:
                columns = split(rest[1 : words.index("FROM")], ",")
                if any(isinstance(c[-1], Token) and c[-1].text == "*" for c in columns):
                    raise ValueError("rows that tie cannot be settled by *; name the columns")
                sql += "".join(f", {n}" for n in range(1, len(columns) + 1))
            if top is not None:
                sql += self.done("top_to_limit", f" LIMIT {top}")
            if limit is not None:
                sql += f" LIMIT {limit}"
            if offset is not None and offset != "0":
                sql += f" OFFSET {offset}"
            if hidden:
                sql = f"SELECT * EXCEPT ({', '.join(f'_order{n}' for n in range(1, hidden + 1))}) FROM ({sql})"
        if xml:
            row, root = xml
            # to_xml puts white space between elements
            each = f"regexp_replace(to_xml(struct(*), map('rowTag', '{row}', 'attributePrefix', '@')), '>\\\\s+<', '><')"
            body = f"array_join(collect_list({each}), '')"
            sql = self.done("for_xml", f"SELECT {f"concat('<{root}>', {body}, '</{root}>')" if root else body} AS xml FROM ({sql})")
        elif document:
            sql = self.done("for_json", f"SELECT to_json(collect_list(struct(*))) AS json FROM ({sql})")
        if into:
            sql = f"CREATE TABLE {into} USING parquet AS {sql}"
        return sql


def tidy(parts: list[str]) -> str:
    text = " ".join(p for p in parts if p)
    text = re.sub(r"(?<=[\w`]) \. (?=[\w`*])", ".", text)
    return re.sub(r" ,", ",", text)


def split_words(items: list, word: str) -> list[list]:
    """What follows each occurrence of a word at this level, but within CASE."""
    out: list[list] = []
    cases = 0
    for x in items:
        w = x.upper if isinstance(x, Token) and x.kind == "word" else ""
        cases += (w == "CASE") - (w == "END")
        if w == word and not cases:
            out.append([])
        elif out:
            out[-1].append(x)
    return out


def render(items: list) -> str:
    """Items as T-SQL again."""
    out = " ".join("(" + render(x.items) + ")" if isinstance(x, Group) else x.text for x in items)
    return re.sub(r"(?<=[\w\]]) \. (?=[\w\[*])", ".", out).replace(" ,", ",")


def statement(t: Transpiler, items: list) -> str:
    """A query, or for UPDATE, DELETE and MERGE the query that gives the table as it is afterwards."""
    first = items[0].upper if isinstance(items[0], Token) else ""
    change = {"UPDATE": t.update, "DELETE": t.delete, "MERGE": t.merge}.get(first)
    return change(items) if change else t.query(items) if first in ("SELECT", "WITH") else t.expression(items)


def transpile(sql: str, exact: tuple[str, ...] = (), settled: bool = False) -> Result:
    """The statement in Spark SQL with the rules applied, warnings, parameters and confidence.

    exact: columns of doubles whose sums do not depend on the order of rows. settled: of rows that tie where TOP or OFFSET
    cuts, which T-SQL leaves open, those of least selected columns are taken. What has no equal plan raises a ValueError; a
    warning never stands for a wrong one.
    """
    t = Transpiler(exact, settled)
    items = tree(tokenize(sql.strip().rstrip(";")))
    if not items:
        raise ValueError("an empty statement")
    first = items[0].upper if isinstance(items[0], Token) else ""
    if first not in ("SELECT", "WITH", "UPDATE", "DELETE", "MERGE"):
        t.result.warnings.append(f"{first} is kept as it is")
    t.result.sql = statement(t, items)
    return t.result


#: Function names of the other direction.
BACK = {"NOW": "GETDATE", "COALESCE": "ISNULL", "LENGTH": "LEN", "GEN_RANDOM_UUID": "NEWID"}


def to_tsql(sql: str) -> str:
    """A query of the PostgreSQL kind as T-SQL: LIMIT and OFFSET, names in quotes, and functions that are called otherwise.

    COALESCE of more than two values stays, since ISNULL takes two. OFFSET needs an ORDER BY in T-SQL.
    """

    def name(x: Token) -> str:
        return "[" + x.text[1:-1].replace('""', '"').replace("]", "]]") + "]" if x.kind == "quoted" else x.text

    def block(items: list) -> str:
        words = [x.upper if isinstance(x, Token) else "" for x in items]
        limit = offset = None
        for w in ("LIMIT", "OFFSET"):
            if w in words:
                k = words.index(w)
                value = text(items[k + 1 : k + 2])
                limit, offset = (value, offset) if w == "LIMIT" else (limit, value)
                del items[k : k + 2], words[k : k + 2]
        if offset is not None and "ORDER" not in words:
            raise ValueError("OFFSET needs an ORDER BY in T-SQL")
        if offset is not None:
            return text(items) + f" OFFSET {offset} ROWS" + (f" FETCH NEXT {limit} ROWS ONLY" if limit is not None else "")
        if limit is not None:
            at = max(k for k, w in enumerate(words) if w == "SELECT") + 1
            at += at < len(words) and words[at] == "DISTINCT"
            if any(w in ("UNION", "EXCEPT", "INTERSECT") for w in words):
                return f"SELECT TOP {limit} * FROM ({text(items)}) AS limited"
            return f"{text(items[:at])} TOP {limit} {text(items[at:])}"
        return text(items)

    def text(items: list) -> str:
        out = []
        for k, x in enumerate(items):
            if isinstance(x, Group):
                inner = list(x.items)
                out.append("(" + (block(inner) if inner and isinstance(inner[0], Token) and inner[0].upper in ("SELECT", "WITH") else text(inner)) + ")")
                continue
            after = items[k + 1] if k + 1 < len(items) else None
            if x.kind == "word" and x.upper in BACK and isinstance(after, Group) and (x.upper != "COALESCE" or len(split(after.items, ",")) == 2):
                out.append(BACK[x.upper])
            else:
                out.append(name(x))
        return re.sub(r"(?<=[\w\]]) \. (?=[\w\[*])", ".", " ".join(out)).replace(" ,", ",")

    return block(tree(tokenize(sql.strip().rstrip(";"))))
