"""Places of matches in whole texts, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

SPAN = "struct<start:int,end:int,m:string>"
NONE = f"cast(array() as array<{SPAN}>)"
BLOCK = 128


def running(values: Column, plus: Callable[[Column, Column], Column] = lambda x, y: x + y) -> Column:
    """Running sums of an array of ints that aren't negative (or what plus makes of them), blockwise, so that thousands of entries stay cheap."""

    def append(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array(plus(F.element_at(acc, -1), x)))

    def of(a: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int"))
        sums = F.transform(blocks, lambda b: F.aggregate(F.slice(a, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda x, y: plus(x, y)))
        before = F.aggregate(sums, F.array(F.lit(0)), append)
        return let(before, lambda o: F.flatten(F.transform(blocks, lambda b: F.slice(F.aggregate(F.slice(a, b * BLOCK + 1, F.lit(BLOCK)), F.array(F.get(o, b)), append), 2, BLOCK))))

    return let(values, lambda a: F.when(F.size(a) == 0, F.expr("cast(array() as array<int>)")).otherwise(of(a)))


def find_spans(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches of a pattern as array<struct<start, end, m>>, in code points, end exclusive.

    The gaps between matches come from split() with the same pattern, so matches and gaps add up to the text.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def of(m: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m))
        ends = running(F.zip_with(gaps, m, lambda g, x: F.char_length(g) + F.char_length(x)))
        return let(ends, lambda e: F.transform(m, lambda x, i: F.struct((F.get(e, i) - F.char_length(x)).alias("start"), F.get(e, i).alias("end"), x.alias("m"))))

    return let(found, lambda m: F.when(F.size(m) == 0, F.expr(NONE)).otherwise(of(m)))


def disjoint(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others. These are looked through in blocks by place, so that only near ones are compared."""
    places = F.sort_array(F.transform(others, lambda o: F.struct(o["start"].alias("start"), o["end"].alias("end"))))

    def block(p: Column) -> Callable[[Column], Column]:
        return lambda k: let(F.slice(p, k * BLOCK + 1, F.lit(BLOCK)), lambda x: F.struct(F.get(x, F.lit(0))["start"].alias("start"), F.array_max(F.transform(x, lambda o: o["end"])).alias("end"), x.alias("all")))

    def meets(s: Column) -> Callable[[Column], Column]:
        return lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"])

    def apart(x: Column, bs: Column) -> Column:
        return F.filter(x, lambda s: ~F.exists(bs, lambda b: meets(s)(b) & F.exists(b["all"], meets(s))))

    def of(x: Column) -> Callable[[Column], Column]:
        return lambda p: let(F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), block(p)), lambda bs: apart(x, bs))

    return let(spans, lambda x: F.when((F.size(x) == 0) | (F.size(others) == 0), x).otherwise(let(places, of(x))))


def best_apart(rows: DataFrame, spans: str, rank: Callable[[Column], Column], out: str) -> DataFrame:
    """rows with out: of the spans (with start and end), the best by rank (a struct, the least first) that overlap no better one that stays; by place.

    Spans fall into groups that overlap nothing outside; within a group the best stays, then the best beside it, and so
    on. Column by column, since the analyser gives up on lambdas nested this deep; a column that a lambda reads only once
    would be put into it by the optimiser, and is bound by let() instead.
    """

    def meets(c: Column) -> Callable[[Column], Column]:
        return lambda o: (o["s"]["start"] < c["s"]["end"]) & (c["s"]["start"] < o["s"]["end"])

    def chosen(ranked: Column) -> Column:
        return F.aggregate(ranked, F.slice(ranked, 1, 0), lambda acc, c: F.when(F.exists(acc, meets(c)), acc).otherwise(F.concat(acc, F.array(c))))

    def group(a: Column, k: Column) -> Column:
        return F.sort_array(F.transform(F.slice("_places", a + 1, F.coalesce(F.get("_heads", k + 1), F.size("_places")) - a), lambda p: F.struct(rank(p["s"]).alias("r"), p["s"].alias("s"))))

    def heads(ends: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size("_places") - 1), lambda i: (i == 0) | (F.get("_places", i)["start"] >= F.get(ends, i - 1)))

    rows = rows.withColumn("_places", F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s.alias("s")))))
    ends = running(F.transform("_places", lambda p: p["end"]), F.greatest)
    rows = rows.withColumn("_heads", F.when(F.size("_places") > 0, let(ends, heads)).otherwise(F.expr("cast(array() as array<int>)")))
    rows = rows.withColumn("_groups", F.transform("_heads", group))
    kept = F.transform(F.flatten(F.transform("_groups", lambda g: F.when(F.size(g) == 1, g).otherwise(chosen(g)))), lambda c: c["s"])
    return rows.withColumn(out, kept).drop("_places", "_heads", "_groups")


def blanked(rows: DataFrame, text: Column, spans: str, out: str) -> DataFrame:
    """rows with out: text, as long as it is, with blanks in place of the spans; these may overlap."""

    def rest(s: Column, at: Column) -> Column:
        return F.struct(at.alias("start"), s["end"].alias("end"), F.repeat(F.lit(" "), s["end"] - at).alias("tag"))

    rows = rows.withColumn("_places", F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))))
    ends = running(F.transform("_places", lambda p: p["end"]), F.greatest)
    parts = let(ends, lambda e: F.filter(F.transform("_places", lambda s, k: rest(s, F.greatest(s["start"], F.coalesce(F.get(e, k - 1), F.lit(0))))), lambda s: s["start"] < s["end"]))
    return rows.withColumn("_places", parts).withColumn(out, replaced(text, F.col("_places"))).drop("_places")


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of m pass the Luhn check."""
    ds = F.reverse(F.split(digits(m), ""))
    doubled = F.transform(ds, lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, F.lit(9)).otherwise(F.lit(0))).otherwise(d.cast("int")))
    return F.when(digits(m) == "", F.lit(False)).otherwise(F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0)


def replaced(text: Column, spans: Column) -> Column:
    """text with each span (start, end, tag) replaced by its tag; a span that begins within an earlier one is joined to it."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["tag"]).alias("out"))
        joined = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(joined)

    done = F.aggregate(F.sort_array(spans), start, step)
    return F.when(F.size(spans) == 0, text).otherwise(let(done, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.char_length(text)))))
