"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source has the same expected number of copies, target / source size. Its whole part is given;
the fraction is rounded dependently: two fractional documents meet, and words pass from one to the other, in a random
direction, until one of them is taken whole or not at all; the other goes on. The direction's odds keep each
document's expectation, and the words that both stand for stay the same. So the words taken differ from the target by
the last document left at most. Large documents meet first, so that one is a small one.

The meetings form a reduction tree. A leaf folds at most a few hundred documents of one source and size class; it
leaves one residual document. Residuals of ``fan_in`` neighbouring leaves meet in the next round, until each size
class, and at last each source, has one, which is rounded by its own probability. About ``reserve`` documents of each
source join only at its root, to take up what large residuals still hold. Before all that, documents with over
1 / ``giants`` of their source's words are rounded one by one against all the others of the source together. A hot source only has more
leaves, never larger ones; rows that repeat a doc_id, source and size are dealt out by a row number as well, so they
spread over the leaves too.

Cases. Null text: size 0. Null source: a source of its own, ordered last. Null or repeated doc_id: each row is a
document. Very long texts are sized whole. A source without words has target 0 and no copies. Empty table: no rows.
Other columns are ignored by ``mix`` and kept by ``mixed_documents``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import count_words, field, from_row, let, numbered, read, saved, uniform

EPS = 1e-9


def targets(units: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """source, n_docs, source_size and target of every source in units (source, size).

    All sizes together are shared by weight; a target stops at max_repeat times its source's size, the excess goes
    to the others by weight. Sources sorted by cap / weight are capped from the front, up to the first whose fair
    share of what is left stays within its cap. One row per source passes through the single-task windows.
    """
    per = units.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (k + 1).cast("int")).cast("long")
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeat)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left_words = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    left_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("rate", left_words / left_weight)
    within = F.col("rate") * F.col("weight") <= F.col("cap")
    per = per.withColumn("first_rate", F.first(F.when(within, F.col("rate")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    per = per.withColumn("rate", F.coalesce("first_rate", F.lit(0.0)))
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.col("rate"))
    return per.select("source", "n_docs", "source_size", target.alias("target"))


def _fold(units: Column, level: int, seed: int) -> Column:
    """Folds an array of (size, doc_id, salt, row_id, p) into (decided array of (row_id, one), at most one residual)."""
    unit = "struct<size:bigint,doc_id:bigint,salt:bigint,row_id:bigint,p:double>"
    start = F.struct(F.lit(None).cast(unit).alias("rest"), F.expr("cast(array() as array<struct<row_id:bigint,one:int>>)").alias("done"))

    def with_p(u: Column, p: Column) -> Column:
        return F.struct(*[u[c].alias(c) for c in ("size", "doc_id", "salt", "row_id")], p.alias("p"))

    def meet(rest: Column, x: Column) -> Column:
        """Both documents' fractions after some words have passed between them."""
        a, b, m, n = rest["p"], x["p"], rest["size"], x["size"]
        flows = F.struct(F.least((1.0 - a) * m, b * n).alias("to"), F.least(a * m, (1.0 - b) * n).alias("fro"))
        r = uniform(rest["doc_id"], rest["salt"], m, x["doc_id"], x["salt"], n, F.lit(level), F.lit(seed))
        moved = let(flows, lambda f: F.when(r * (f["to"] + f["fro"]) < f["fro"], f["to"]).otherwise(-f["fro"]))
        return let(moved, lambda d: F.struct((a + d / m).alias("a"), (b - d / n).alias("b")))

    def is_open(p: Column) -> Column:
        return (p > EPS) & (p < 1.0 - EPS)

    def settled(u: Column, p: Column) -> Column:
        done = F.array(F.struct(u["row_id"].alias("row_id"), F.round(p).cast("int").alias("one")))
        return F.when(is_open(p), F.expr("cast(array() as array<struct<row_id:bigint,one:int>>)")).otherwise(done)

    def step(acc: Column, x: Column) -> Column:
        rest, done = acc["rest"], acc["done"]
        after = let(meet(rest, x), lambda q: F.struct(F.when(is_open(q["a"]), with_p(rest, q["a"])).when(is_open(q["b"]), with_p(x, q["b"])).alias("rest"), F.concat(done, settled(rest, q["a"]), settled(x, q["b"])).alias("done")))
        return F.when(rest.isNull(), F.struct(x.alias("rest"), done.alias("done"))).otherwise(after)

    return F.aggregate(F.sort_array(units, asc=False), start, step)


def _giants(units: Column, p: Column, mass: Column, seed: int) -> Column:
    """Rounds the largest documents of a source, each against all the others together.

    units: array of (size, doc_id, salt, row_id); p: the fraction that all documents of the source have; mass: their words.
    All others have one fraction, so that words which pass between one document and all others change that fraction
    alike, and each keeps its expectation. Gives (p of the others, done: array of (row_id, p)).
    """
    start = F.struct(p.alias("p"), mass.cast("double").alias("mass"), F.expr("cast(array() as array<struct<row_id:bigint,p:double>>)").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        q, s, rest = acc["p"], x["size"], acc["mass"] - x["size"]
        r = uniform(x["doc_id"], x["salt"], s, F.lit("giant"), F.lit(seed))
        flows = F.struct(F.least((1.0 - q) * s, q * rest).alias("to"), F.least(q * s, (1.0 - q) * rest).alias("fro"))
        moved = let(flows, lambda f: F.when(r * (f["to"] + f["fro"]) < f["fro"], f["to"]).otherwise(-f["fro"]))

        def after(d: Column) -> Column:
            others = F.least(F.lit(1.0), F.greatest(F.lit(0.0), q - F.when(rest > 0, d / rest).otherwise(F.lit(0.0))))
            return F.struct(others.alias("p"), rest.alias("mass"), F.concat(acc["done"], F.array(F.struct(x["row_id"].alias("row_id"), (q + d / s).alias("p")))).alias("done"))

        return let(moved, after)

    return F.aggregate(F.sort_array(units, asc=False), start, step)


def _salted(units: DataFrame) -> DataFrame:
    """units (row_id, doc_id, source, size) with salt: the row_id where another row has the same doc_id, source and size, else null.

    Draws depend on doc_id, size and salt, so that they stay the same however the table is split, as far as its rows differ.
    """
    key = ["doc_id", "source", "size"]
    again = units.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = saved(again.select(*[F.col(c).alias(f"_{c}") for c in key]), "mix-repeated")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    return units.join(again, same, "left").select("row_id", *key, F.when(F.col("_size").isNotNull(), F.col("row_id")).alias("salt"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of every row of docs (doc_id, text, source). Options: see mix_units."""
    units = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), count_words(F.col("text").cast("string")).alias("size"))
    return mix_units(units, **options).drop("row_id")


def mix_units(
    units: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, leaf: int = 128, fan_in: int = 64, reserve: int = 384, giants: int = 200, seed: int = 7
) -> DataFrame:
    """row_id, doc_id, source, size, source_size, target and copies of every row of units (row_id, doc_id, source, size)."""
    units = _salted(saved(units, "mix-units"))
    per = saved(targets(units, weights, max_repeat).withColumn("share", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))), "mix-targets")
    # a class holds sizes within about a fifth of each other
    cls = F.floor(F.log2(F.col("size") + 1.0) * 4).cast("int")
    rows = units.join(per, units["source"].eqNullSafe(per["source"]), "inner").drop(per["source"]).withColumn("cls", cls)
    whole = F.floor(F.col("share") + EPS)
    rows = rows.withColumn("whole", whole.cast("int")).withColumn("p", F.greatest(F.lit(0.0), F.col("share") - whole))
    open_rows = rows.where((F.col("p") > EPS) & (F.col("size") > 0))
    # at most giants of them in a source
    large = open_rows.where(F.col("size") * giants > F.col("source_size")).groupBy("source").agg(
        _giants(F.collect_list(F.struct("size", "doc_id", "salt", "row_id")), F.first("p"), F.first("source_size"), seed).alias("g")
    )
    large = saved(large.select("source", "g.p", "g.done"), "mix-giants")
    settled = large.select(F.explode("done").alias("d")).select("d.*")
    closed = (F.col("p") <= EPS) | (F.col("p") >= 1.0 - EPS)
    done = settled.where(closed).select("row_id", F.round("p").cast("int").alias("one"))
    left_over = settled.where(~closed).withColumnRenamed("p", "_p")
    rest = large.select(F.col("source").alias("_source"), F.col("p").alias("_p"))
    small = open_rows.where(F.col("size") * giants <= F.col("source_size")).join(rest, F.col("source").eqNullSafe(F.col("_source")), "left")
    small = small.withColumn("p", F.coalesce("_p", "p")).drop("_p", "_source")
    done = done.unionByName(small.where(closed).select("row_id", F.round("p").cast("int").alias("one")))
    still = open_rows.join(left_over, "row_id").withColumn("p", F.col("_p")).drop("_p")
    open_rows = small.where(~closed)
    # a few documents of each source meet the others only at the root, where what large ones leave over finds takers
    unit = F.struct("r.size", "r.doc_id", "r.salt", "r.row_id", "r.p").alias("u")
    # (drawn by size, so that the largest, which leave most, are there and sizes below them follow closely)
    late = uniform(F.col("doc_id"), F.col("size"), F.col("salt"), F.lit(seed), F.lit("late")) * F.col("source_size") < F.col("size") * reserve
    waiting = open_rows.where(late).unionByName(still.select(*open_rows.columns)).alias("r").select("r.source", F.lit(0).alias("cls"), F.lit(0).alias("node"), unit)
    open_rows = open_rows.where(~late)
    n = open_rows.groupBy("source", "cls").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(leaf))).cast("int").alias("leaves"))
    keyed = (
        open_rows.alias("r").join(n.alias("n"), F.col("r.source").eqNullSafe(F.col("n.source")) & (F.col("r.cls") == F.col("n.cls")))
        .select("r.source", "r.cls", F.pmod(F.xxhash64(F.lit(seed), "r.doc_id", "r.size", "r.salt"), F.col("n.leaves")).cast("int").alias("node"), unit)
    )
    most = n.agg(F.max("leaves")).first()[0] or 0
    rounds, width = 1, most
    while width > 1:
        rounds, width = rounds + 1, -(-width // fan_in)
    level = 0
    plan = (["leaf"] + ["node"] * (rounds - 1) + ["class"] if most else []) + ["source"]
    for what in plan:
        if what == "node":
            keyed = keyed.withColumn("node", F.floor(F.col("node") / fan_in).cast("int"))
        elif what == "class":
            keyed = keyed.withColumn("node", F.lit(0)).withColumn("cls", F.floor(F.col("cls") / 8).cast("int"))
        elif what == "source":
            keyed = keyed.withColumn("cls", F.lit(0)).unionByName(waiting)
        folded = saved(keyed.groupBy("source", "cls", "node").agg(_fold(F.collect_list("u"), level, seed).alias("f")), f"mix-level{level}")
        now = folded.select(F.explode("f.done").alias("d")).select("d.*")
        done = done.unionByName(now)
        keyed = folded.where("f.rest is not null").select("source", "cls", "node", F.col("f.rest").alias("u"))
        level += 1
    last = keyed.select(F.col("u.row_id").alias("row_id"), (uniform(F.col("u.doc_id"), F.col("u.size"), F.col("u.salt"), F.lit(seed)) < F.col("u.p")).cast("int").alias("one"))
    done = done.unionByName(last)
    out = rows.join(done, "row_id", "left")
    # documents without a word have no mass to pass on: each is rounded by itself
    alone = ((F.col("size") == 0) & (uniform(F.col("doc_id"), F.col("salt"), F.lit(seed)) < F.col("p"))).cast("int")
    copies = (F.col("whole") + F.coalesce("one", alone)).cast("long")
    return out.select("row_id", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them. Needs doc_id, text and source; keeps every column."""
    rows = numbered(docs, "mix-rows")
    units = rows.select(F.col("_at").alias("row_id"), field("doc_id").cast("long").alias("doc_id"), field("source").cast("string").alias("source"), count_words(field("text").cast("string")).alias("size"))
    # row by row, so that rows of one doc_id keep their own copies and never meet in one task
    chosen = mix_units(units, **options).where("copies > 0").select("row_id", "copies")
    repeated = rows.join(chosen.hint("merge"), F.col("_at") == F.col("row_id")).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return from_row(repeated, docs)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
