"""Quality rules by cross-document line frequency, in DataFrame operations only.

Lines are normalised (ASCII lower case, digits to 0, white space to one blank) and hashed. Per host (the column
``source``) a line's distinct documents are counted. With ``copies_once`` exact copies of a text count as one document, so
that copies alone don't condemn their own lines; without it each row counts. A line in more than max(least_docs, host documents * share) documents is
boilerplate and is removed. A document that keeps under ``min_left_percent`` of its words is depleted and
rejected, besides those that fail the base rules (too few words, or too many words in repeated 3-word windows).

Counting is an aggregation over (host, line, text) and then (host, line), both with partial sums before the
shuffle, so a line that stands in a third of all documents never gathers in one task.

Cases. Null text: no words, fails the base rule. Null source: a host of its own. Null or repeated doc_id: each row
is judged. Very long texts are judged whole, all their lines count. Empty table: no rows. Other columns are ignored by
``judge`` and kept by ``kept_documents``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD, as_row, field, from_row, let, read, saved, words

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
SYMBOLS = "#*$%&|<>"


def normal_line(line: Column) -> Column:
    return F.translate(F.trim(F.regexp_replace(line, SPACE, " ")), UPPER + DIGITS, LOWER + "0" * 10)


def words_of(normal: Column) -> Column:
    """How many words a normalised line has, one at least: they stand a blank apart."""
    return F.char_length(normal) - F.char_length(F.translate(normal, " ", "")) + 1


def repeated_words(ws: Column) -> Column:
    """How many words stand in a 3-word window that the array holds twice or more. Sorts the windows' hashes with their places."""

    def of(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 3)
        hashes = F.transform(places, lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))

    def covered(h: Column) -> Column:
        tagged = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(tagged, lambda t: F.filter(F.transform(t, lambda x, k: F.when((F.coalesce(F.get(t, k - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(t, k + 1)["h"] == x["h"], F.lit(False))), x["i"])), lambda i: i.isNotNull()))
        # windows cover three words each, fewer where the next one starts earlier
        return let(F.sort_array(twice), lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b))

    return let(ws, lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(of(w)))


def features(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, source, the base columns, text_hash and the normalised lines of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ws = words(text)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    out = docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"),
        let(ws, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.char_length(F.array_join(w, "")).cast("long").alias("chars"), repeated_words(w).cast("long").alias("rep"))).alias("w"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.transform(F.transform(x, normal_line), lambda y: F.struct(F.xxhash64(y).alias("h"), words_of(y).alias("n"))).alias("all"))).alias("l"),
        F.xxhash64(text).alias("text_hash"),
    )
    return out.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", "source", F.col("w.n").alias("n_words"), F.col("w.chars").alias("word_chars"), "n_symbols",
        F.col("l.dup").alias("n_dup_lines"), F.col("w.rep").alias("n_repeat_words"), "text_hash", F.col("l.all").alias("lines"),
    )


def frequent_lines(feats: DataFrame, least_docs: int, per_mille: int, copies_once: bool = True) -> DataFrame:
    """source and hash of the lines above their host's limit."""
    feats = feats.withColumn("text_hash", F.col("text_hash" if copies_once else "row_id"))
    rows = feats.select("source", "text_hash", F.explode("lines.h").alias("h"))
    n = rows.distinct().groupBy("source", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least_docs)
    hosts = feats.select("source", "text_hash").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("host_docs"))
    limit = F.greatest(F.lit(least_docs), F.floor(F.col("host_docs") * per_mille / 1000))
    return n.alias("n").join(hosts.alias("t"), F.col("n.source").eqNullSafe(F.col("t.source"))).where(F.col("n.n") > limit).select(F.col("n.source").alias("source"), F.col("n.h").alias("h"))


def judge(
    docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, least_docs: int = 20, per_mille: int = 10, min_left_percent: int = 30, copies_once: bool = True
) -> DataFrame:
    """Per row: the base columns, base_failed, removed_words, removed (hashes of its removed lines), kept, text_hash."""
    feats = saved(features(docs), "quality-features")
    often = frequent_lines(feats, least_docs, per_mille, copies_once)
    rows = feats.select("row_id", "source", F.explode("lines").alias("l")).select("row_id", "source", "l.*")
    hit = rows.alias("r").join(often.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.h") == F.col("o.h")), "left_semi")
    lost = hit.groupBy("row_id").agg(F.sum("n").alias("removed_words"), F.collect_set("h").alias("removed"))
    out = feats.drop("lines").join(lost, "row_id", "left")
    gone = F.coalesce("removed_words", F.lit(0)).cast("long")
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    depleted = (F.col("n_words") - gone) * 100 < F.col("n_words") * min_left_percent
    return out.withColumn("removed_words", gone).withColumn("removed", F.coalesce("removed", F.array().cast("array<bigint>"))).withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """docs without the rejected rows, the others without their boilerplate lines (n_chars follows the text, if there is one)."""
    verdict = judge(docs, **options).where("kept").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_hash").alias("_hash"), "removed").dropDuplicates(["_id", "_source", "_hash"])
    text = F.coalesce(field("text").cast("string"), F.lit(""))
    same = (F.xxhash64(text) == F.col("_hash")) & field("doc_id").eqNullSafe(F.col("_id")) & field("source").cast("string").eqNullSafe(F.col("_source"))
    joined = as_row(docs).join(verdict, same, "inner")
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~(x.rlike(WORD) & F.array_contains(F.col("removed"), F.xxhash64(normal_line(x))))), "\n")
    new = F.when(F.size("removed") > 0, left).otherwise(field("text").cast("string"))
    return from_row(joined.withColumn("_text", new), docs, F.col("_text"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), tri AS (
  SELECT row_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t
  FROM (SELECT row_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), twice AS (
  SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, t) AS n FROM tri) WHERE n > 1
), rep AS (
  SELECT row_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY row_id
), lines AS (
  SELECT row_id, source, text, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
         translate(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000') AS line
  FROM (SELECT row_id, source, text, unnest(ls) AS l FROM d)
), hosts AS (
  SELECT source, count(DISTINCT text) AS host_docs FROM d GROUP BY source
), often AS (
  SELECT n.source, n.line FROM (SELECT source, line, count(DISTINCT text) AS n FROM lines GROUP BY source, line) n
  JOIN hosts h ON n.source IS NOT DISTINCT FROM h.source WHERE n.n > greatest(20, floor(h.host_docs * 10 / 1000))
), lost AS (
  SELECT l.row_id, sum(l.n) AS removed FROM lines l
  WHERE EXISTS (SELECT 1 FROM often o WHERE o.source IS NOT DISTINCT FROM l.source AND o.line = l.line) GROUP BY l.row_id
), f AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         coalesce(lost.removed, 0) AS removed
  FROM d LEFT JOIN rep USING (row_id) LEFT JOIN lost USING (row_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ((n_words - removed) * 100 < n_words * 30) AS kept
FROM f
"""
