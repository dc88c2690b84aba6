"""Secrets: rules, and sliding-window Shannon entropy for what the rules leave, in DataFrame functions only.

Base spans are fixed patterns (assign, access, hex). Other candidate strings are runs of a character class; each
class has its own alphabet, window and limit. A window slides over the run: the counts of its characters and the sum
of c * log2(c) change by the character that enters and the one that leaves, so a step costs the same whatever the
window. Entropy is log2(w) - sum / w. The windows at or above the limit make one span, from the first to the last.
Runs are cut at base spans and at words with a placeholder in them (the allow-list), what stands beside is scanned by
itself. UUIDs, digests named as such and runs without both letters and digits are suppressed. Of overlapping spans of
several classes the widest stays, then the next that overlaps none that stays.

Cases. Null text: empty, no spans. Empty or very long texts are scanned whole. Null or repeated doc_id: each row is
scanned. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_row, field, let, read
from .pii import of_kind, told
from .spans import NONE, best_apart, blanked, find_spans, running

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: name: alphabet, class in a pattern, window, limit in bits
CLASSES = {
    "hex": (DIGITS + "abcdefABCDEF", "0-9A-Fa-f", 20, 3.0),
    "upper": (UPPER + DIGITS, "A-Z0-9", 20, 3.5),
    "base64": (UPPER + LOWER + DIGITS + "+/_=-", "A-Za-z0-9+/_=-", 24, 3.9),
}
#: Words (runs of letters and digits) that hold one of these are no secrets.
ALLOWED = r"(?i)example|sample|dummy|placeholder|changeme|redacted|your[_-]|xxxx|0123456|1234567|abcdef|(.)\1{5}"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
ALLOWED_WORD = rf"(?<![A-Za-z0-9])[A-Za-z0-9]*(?:{ALLOWED})[A-Za-z0-9]*"
#: Suppressed after these words: digests are no secrets.
NAMED = r"(?i)(?:sha-?[0-9]{1,3}|md5|digest|checksum|commit|integrity|etag)[\"']?\x20*[:=-]?\x20*[\"']?$"


def base_spans(text: Column) -> dict[str, Column]:
    """The base spans of each kind. text must not be null."""
    none = F.expr(NONE)
    assign = F.when(F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), find_spans(text, ASSIGN)).otherwise(none)
    return {
        "assign": F.filter(assign, lambda s: F.char_length(F.regexp_extract(s["m"], r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?(.*)$""", 1)) >= 6),
        "access": F.when(F.contains(text, F.lit("AKIA")), find_spans(text, ACCESS)).otherwise(none),
        "hex": F.when(text.rlike("[0-9a-f]{24}"), find_spans(text, HEX)).otherwise(none),
    }


def windows_over(m: Column, alphabet: str, window: int, limit: float) -> Column:
    """struct<a, b>: where the windows of m at or above the limit begin and end; null if there are none."""
    table = F.array(*[F.lit(k * math.log2(k) if k else 0.0) for k in range(window + 1)])
    state = "struct<n:array<int>,s:double,a:int,b:int>"
    start = F.expr(f"cast(named_struct('n', array_repeat(0, {len(alphabet)}), 's', 0D, 'a', null, 'b', null) as {state})")

    def step(codes: Column, t: Column):
        def run(acc: Column, i: Column) -> Column:
            enters = F.get(codes, i)
            leaves = F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(-1))
            # the one that leaves goes first; where both are the same character nothing changes
            old_out = F.when(leaves >= 0, F.get(acc["n"], leaves)).otherwise(F.lit(0))
            old_in = F.get(acc["n"], enters) - F.when(leaves == enters, F.lit(1)).otherwise(F.lit(0))
            s = acc["s"] + F.when(leaves >= 0, F.get(t, old_out - 1) - F.get(t, old_out)).otherwise(F.lit(0.0)) + F.get(t, old_in + 1) - F.get(t, old_in)
            n = F.transform(acc["n"], lambda c, k: c + F.when(k == enters, F.lit(1)).otherwise(F.lit(0)) - F.when(k == leaves, F.lit(1)).otherwise(F.lit(0)))
            high = (i >= window - 1) & (F.lit(math.log2(window)) - s / window >= limit - 1e-9)
            return F.struct(n.alias("n"), s.alias("s"), F.when(high, F.coalesce(acc["a"], i - window + 1)).otherwise(acc["a"]).alias("a"), F.when(high, i + 1).otherwise(acc["b"]).alias("b"))

        return run

    codes = F.transform(F.split(m, ""), lambda c: F.position(c, F.lit(alphabet)) - 1)
    out = let(codes, lambda cs: let(table, lambda t: F.aggregate(F.sequence(F.lit(0), F.size(cs) - 1), start, step(cs, t))))
    return F.struct(out["a"].alias("a"), out["b"].alias("b"))


def _seen(alphabet: str, window: int, limit: float):
    return lambda s: F.struct(s["start"].alias("start"), windows_over(s["m"], alphabet, window, limit).alias("w"))


def beside_allowed(s: Column, window: int) -> Column:
    """The parts of a run (start, end, m) beside its allowed words, those of a window's length at least."""

    def of(gaps: Column) -> Column:
        words = F.regexp_extract_all(s["m"], F.lit(ALLOWED_WORD), F.lit(0))
        ends = running(F.transform(gaps, lambda g, k: F.char_length(g) + F.coalesce(F.char_length(F.get(words, k)), F.lit(0))))
        parts = let(ends, lambda e: F.transform(gaps, lambda g, k: let(s["start"] + F.coalesce(F.get(e, k - 1), F.lit(0)), lambda at: F.struct(at.alias("start"), (at + F.char_length(g)).alias("end"), g.alias("m")))))
        return F.filter(parts, lambda p: F.char_length(p["m"]) >= window)

    return F.when(s["m"].rlike(ALLOWED), let(F.split(s["m"], ALLOWED_WORD, -1), of)).otherwise(F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m"))))


def _beside(window: int):
    return lambda s: beside_allowed(s, window)


def added_candidates(masked: Column, text: Column) -> Column:
    """array<struct<kind, start, end>> of high entropy; masked: text with blanks in place of base spans, so that what stands beside them is looked at by itself."""
    out = []
    for alphabet, chars, window, limit in CLASSES.values():
        runs = F.when(masked.rlike(f"[{chars}]{{{window}}}"), find_spans(masked, f"(?<![{chars}])[{chars}]{{{window},}}+")).otherwise(F.expr(NONE))
        whole = F.filter(runs, lambda s: ~s["m"].rlike(UUID))
        parts = F.flatten(F.transform(whole, _beside(window)))
        likely = F.filter(parts, lambda s: s["m"].rlike("[0-9]") & s["m"].rlike("[A-Za-z]"))
        free = F.filter(likely, lambda s: ~F.substring(text, F.greatest(F.lit(1), s["start"] - 23), F.least(F.lit(24), s["start"])).rlike(NAMED))
        seen = F.transform(free, _seen(alphabet, window, limit))
        out.append(F.transform(F.filter(seen, lambda s: s["w"]["a"].isNotNull()), lambda s: F.struct(F.lit(3).alias("kind"), (s["start"] + s["w"]["a"]).alias("start"), (s["start"] + s["w"]["b"]).alias("end"))))
    return F.concat(*out)


def scan(docs: DataFrame) -> DataFrame:
    """docs with spans: struct<base, added>, arrays of (kind, start, end)."""
    text = F.coalesce(field("text").cast("string"), F.lit(""))
    kinds = base_spans(text)
    rows = as_row(docs).withColumn("_base", F.concat(*[F.transform(kinds[k], of_kind(i)) for i, k in enumerate(KINDS[:3])]))
    rows = blanked(rows, text, "_base", "_masked").withColumn("_found", added_candidates(F.col("_masked"), text))
    rows = best_apart(rows, "_found", lambda c: F.struct((c["start"] - c["end"]).alias("width"), c["start"].alias("start")), "_added")
    return rows.select(*[field(c).alias(c) for c in docs.columns if c != "spans"], F.struct(F.col("_base").alias("base"), F.col("_added").alias("added")).alias("spans"))


def by_place(spans: Column) -> Column:
    turned = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.transform(turned, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda i: F.size(F.filter("spans.base", lambda s: s["kind"] == i)).cast("long")
    return out.select(
        "doc_id", *[n(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sha2(told(by_place(F.col("spans.base")), KINDS), 256).alias("base_sha256"),
        told(by_place(F.concat("spans.base", "spans.added")), KINDS).alias("spans"),
    )
