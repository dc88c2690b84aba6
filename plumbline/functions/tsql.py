"""T-SQL functions as column expressions, with T-SQL's semantics where Spark's function of that name differs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def isnull(x: ColumnOrName, default: Column) -> Column:
    return F.coalesce(_c(x), default)


def len_(x: ColumnOrName) -> Column:
    """Length without trailing blanks."""
    return F.length(F.rtrim(_c(x)))


def charindex(needle: str, x: ColumnOrName, start: int = 1) -> Column:
    return F.locate(needle, _c(x), max(start, 1))


def like_to_regex(pattern: str) -> str:
    """A LIKE pattern, with %, _ and character classes, as a regular expression without anchors."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "%":
            out += "[\\s\\S]*"
        elif ch == "_":
            out += "[\\s\\S]"
        elif ch == "[" and (end := pattern.find("]", i + 1)) > 0:
            body = pattern[i + 1 : end]
            out += "[" + body.replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(ch)
        i += 1
    return out


def patindex(pattern: str, x: ColumnOrName) -> Column:
    """1-based place of the first match, 0 if there is none. A leading % lets the match start anywhere."""
    anywhere = pattern.startswith("%")
    body = like_to_regex(pattern.strip("%") if anywhere else pattern.rstrip("%"))
    tail = "" if pattern.endswith("%") else "$"
    return F.regexp_instr(_c(x), F.lit(("" if anywhere else "^") + body + tail))


def like(x: ColumnOrName, pattern: str) -> Column:
    return _c(x).rlike("^" + like_to_regex(pattern) + "$")


def stuff(x: ColumnOrName, start: int, length: int, new: str) -> Column:
    """Null where start lies outside the text."""
    x = _c(x)
    return F.when((F.lit(start) >= 1) & (F.lit(start) <= F.length(x)), F.overlay(x, F.lit(new), F.lit(start), F.lit(length)))


def replicate(x: ColumnOrName, n: int) -> Column:
    return F.repeat(_c(x), n)


def concat(*xs: Column) -> Column:
    """Nulls count as empty."""
    return F.concat(*[F.coalesce(x.cast("string"), F.lit("")) for x in xs])


def quotename(x: ColumnOrName) -> Column:
    return F.concat(F.lit("["), F.replace(_c(x), F.lit("]"), F.lit("]]")), F.lit("]"))


def isnumeric(x: ColumnOrName) -> Column:
    return F.coalesce(_c(x).rlike(r"^[+-]?([0-9]+\.?[0-9]*|[0-9]*\.?[0-9]+)$"), F.lit(False)).cast("int")


def int_div(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Whole-number division that truncates; null for a zero divisor."""
    return F.when(_c(b) != 0, F.call_function("div", _c(a), _c(b)))


#: Units as T-SQL abbreviates them.
UNITS = {
    "yy": "YEAR", "yyyy": "YEAR", "year": "YEAR", "qq": "QUARTER", "q": "QUARTER", "quarter": "QUARTER", "mm": "MONTH", "m": "MONTH", "month": "MONTH", "dy": "DAYOFYEAR", "y": "DAYOFYEAR", "dayofyear": "DAYOFYEAR",
    "dd": "DAY", "d": "DAY", "day": "DAY", "wk": "WEEK", "ww": "WEEK", "week": "WEEK", "dw": "WEEKDAY", "w": "WEEKDAY", "weekday": "WEEKDAY", "hh": "HOUR", "hour": "HOUR", "mi": "MINUTE", "n": "MINUTE", "minute": "MINUTE",
    "ss": "SECOND", "s": "SECOND", "second": "SECOND", "ms": "MILLISECOND", "millisecond": "MILLISECOND",
}
_SECONDS = {"HOUR": 3600, "MINUTE": 60, "SECOND": 1}


def unit_of(name: str) -> str:
    return UNITS[name.strip().lower()]


def _day_number(d: Column) -> Column:
    return F.datediff(d.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")


def _second_number(d: Column) -> Column:
    return _day_number(d) * 86400 + F.hour(d) * 3600 + F.minute(d) * 60 + F.second(d)


def datediff(unit: str, a: ColumnOrName, b: ColumnOrName) -> Column:
    """How many boundaries of the unit lie between a and b."""
    u, a, b = unit_of(unit), _c(a), _c(b)
    months = (F.year(b) * 12 + F.month(b)) - (F.year(a) * 12 + F.month(a))
    if u == "YEAR":
        return (F.year(b) - F.year(a)).cast("bigint")
    if u == "QUARTER":
        return ((F.year(b) * 4 + F.quarter(b)) - (F.year(a) * 4 + F.quarter(a))).cast("bigint")
    if u == "MONTH":
        return months.cast("bigint")
    if u in ("DAY", "DAYOFYEAR", "WEEKDAY"):
        return _day_number(b) - _day_number(a)
    if u == "WEEK":  # weeks begin on Sunday; day 0, 1970-01-01, was a Thursday
        return F.floor((_day_number(b) + 4) / 7) - F.floor((_day_number(a) + 4) / 7)
    if u in _SECONDS:
        n = _SECONDS[u]
        return F.floor(_second_number(b) / n) - F.floor(_second_number(a) / n)
    raise ValueError(f"no DATEDIFF by {unit}")


def dateadd(unit: str, n: int, d: ColumnOrName) -> Column:
    u, d = unit_of(unit), _c(d)
    if u in ("YEAR", "QUARTER", "MONTH"):
        return (d + F.expr(f"INTERVAL '{n * {'YEAR': 12, 'QUARTER': 3, 'MONTH': 1}[u]}' MONTH"))
    if u in ("DAY", "DAYOFYEAR", "WEEKDAY", "WEEK"):
        return d + F.expr(f"INTERVAL '{n * (7 if u == 'WEEK' else 1)}' DAY")
    return d + F.expr(f"INTERVAL '{n}' {u}")


def datepart(unit: str, d: ColumnOrName) -> Column:
    """Weekday counts from Sunday = 1; weeks begin on Sunday, the first holds 1 January."""
    u, d = unit_of(unit), _c(d)
    first = F.dayofweek(F.trunc(d.cast("date"), "year"))
    return {
        "YEAR": F.year(d), "QUARTER": F.quarter(d), "MONTH": F.month(d), "DAY": F.dayofmonth(d), "DAYOFYEAR": F.dayofyear(d), "WEEKDAY": F.dayofweek(d),
        "WEEK": F.floor((F.dayofyear(d) + first - 2) / 7).cast("int") + 1, "HOUR": F.hour(d), "MINUTE": F.minute(d), "SECOND": F.second(d),
    }[u].cast("bigint")


def datename(unit: str, d: ColumnOrName) -> Column:
    u = unit_of(unit)
    if u in ("MONTH", "WEEKDAY"):
        return F.date_format(_c(d), "MMMM" if u == "MONTH" else "EEEE")
    return datepart(unit, d).cast("string")


def eomonth(d: ColumnOrName, months: int = 0) -> Column:
    return F.last_day(F.add_months(_c(d).cast("date"), months))


def datetrunc(unit: str, d: ColumnOrName) -> Column:
    u, d = unit_of(unit), _c(d)
    if u == "WEEK":  # back to Sunday
        return F.date_sub(d.cast("date"), F.dayofweek(d) - 1).cast("timestamp_ntz")
    return F.date_trunc("DAY" if u in ("DAYOFYEAR", "WEEKDAY") else u, d).cast("timestamp_ntz")


#: CONVERT's styles as date patterns (fixed values).
STYLES = {
    1: "MM/dd/yy", 3: "dd/MM/yy", 4: "dd.MM.yy", 23: "yyyy-MM-dd", 101: "MM/dd/yyyy", 102: "yyyy.MM.dd", 103: "dd/MM/yyyy", 104: "dd.MM.yyyy",
    105: "dd-MM-yyyy", 108: "HH:mm:ss", 110: "MM-dd-yyyy", 111: "yyyy/MM/dd", 112: "yyyyMMdd", 120: "yyyy-MM-dd HH:mm:ss", 121: "yyyy-MM-dd HH:mm:ss.SSS", 126: "yyyy-MM-dd'T'HH:mm:ss.SSS",
}


def convert_style(d: ColumnOrName, style: int) -> Column:
    return F.date_format(_c(d), STYLES[style])


def format_(x: ColumnOrName, pattern: str) -> Column:
    """FORMAT: N or N<digits> and C for numbers, else a date pattern."""
    if m := re.fullmatch(r"[Nn](\d*)", pattern):
        return F.format_number(_c(x), int(m[1] or 2))
    if pattern in ("C", "c"):
        return F.concat(F.lit("$"), F.format_number(_c(x), 2))
    return F.date_format(_c(x), re.sub("t+", "a", pattern.replace("dddd", "EEEE").replace("ddd", "EEE")))


def json_value(x: ColumnOrName, path: str) -> Column:
    return F.get_json_object(_c(x), path)
