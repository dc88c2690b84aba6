"""Personal data: rules, and candidate gradient boosting for what the rules leave, in DataFrame functions only.

The base spans are fixed patterns (email, ip, card, phone). High-recall generators then propose further spans of each
kind that may overlap each other: spelt-out or spaced addresses, numbers in other groupings. Features of format
(lengths, digits, separators, Luhn) and of context (words before, characters at the edges) go through boosted
trees, as a CASE expression; a calibrated threshold for each kind selects. A candidate that overlaps a base span is
dropped; of overlapping selected ones the most probable stays, then the next that overlaps none that stays.

The trees are fitted on ``TRAINING_ROWS`` sentences written from templates with a fixed seed: no corpus text is read
for it, so the model is the same for every input.

Cases. Null text: empty, no spans. Empty or very long texts are scanned whole. Null or repeated doc_id: each row is
scanned. Empty table: no rows. Other columns are ignored, or kept by redacted_documents.
"""

from __future__ import annotations

import functools
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import as_row, field, from_row, let, read
from .spans import NONE, best_apart, digits, disjoint, find_spans, luhn, replaced

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. (?<!..)|\G starts a match only at the head of a run or where the last match ended: others can't match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators of further candidates, high in recall; those of one kind may overlap too.
WIDE = {
    "email": [
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}){1,4}",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20at\x20[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}){1,4}",
    ],
    "ip": [r"(?<![0-9A-Za-z:.])(?:[0-9]{1,3}(?:\x20?(?:\[\.\]|\(dot\)|\.)\x20?[0-9]{1,3}){3}|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])"],
    "card": [r"(?<![0-9])[0-9]{4}(?:[\x20./_-]{1,3}[0-9]{4}){2}[\x20./_-]{1,3}[0-9]{1,7}(?![0-9])"],
    "phone": [r"(?<![0-9.+])(?:00[0-9]{1,3}[\x20./-])?\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20./-]?[0-9]{3,4}(?![0-9])"],
}
#: A cheap test that a text may hold a match.
HINT = {"email": [r"@|\(at\)|\[at\]", r"\x20at\x20[A-Za-z0-9-]{1,63}\x20?[.\(\[d]"], "ip": [r"[0-9](?:\x20?(?:\[\.\]|\(dot\)|\.)|:)\x20?[0-9A-Fa-f]"], "card": [r"[0-9]{4}[\x20./_-]"], "phone": [r"[0-9]{2}\)?[\x20./-]"]}
CONTEXT = {
    "email": r"(?i)mail|contact|write|reach|address",
    "ip": r"(?i)\bip\b|host|server|address|login",
    "card": r"(?i)card|visa|master|credit|debit|payment|account",
    "phone": r"(?i)phone|tel|call|mobile|fax|cell|dial",
}
BEFORE = 32
TRAINING_ROWS = 3000


def base_spans(text: Column) -> dict[str, Column]:
    """The base spans of each kind. text must not be null."""
    part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}|(?<=0))"
    n = lambda s: F.char_length(digits(s["m"]))
    none = F.expr(NONE)
    return {
        "email": F.when(F.contains(text, F.lit("@")), find_spans(text, EMAIL)).otherwise(none),
        "ip": F.filter(F.when(text.rlike(r"[0-9]\.[0-9]"), find_spans(text, IP)).otherwise(none), lambda s: s["m"].rlike(rf"^{part}(?:\.{part}){{3}}$")),
        "card": F.filter(F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), find_spans(text, CARD)).otherwise(none), lambda s: n(s).between(13, 19) & luhn(s["m"])),
        "phone": F.filter(F.when(F.contains(text, F.lit("+")), find_spans(text, PHONE)).otherwise(none), lambda s: n(s).between(9, 15)),
    }


def _features(kind: int, s: Column) -> Column:
    m, low = s["m"], s["before"]
    count = lambda p: F.regexp_count(m, F.lit(p))
    values = [
        F.lit(kind), F.char_length(m), count("[0-9]"), count("[A-Za-z]"), count(r"\x20"), count("@"), count(r"\."), count("-"), count(r"[()\[\]]"),
        luhn(m).cast("int"), s["edge"].rlike("^[A-Za-z0-9]").cast("int"), low.rlike("[A-Za-z0-9]$").cast("int"),
        *[low.rlike(CONTEXT[k]).cast("int") for k in KINDS],
        count(":"), F.char_length(F.regexp_extract(m, "[A-Za-z]*$", 0)), count("[0-9]+"), F.char_length(F.regexp_extract(m, "^[^0-9]*([0-9]*)", 1)),
        F.char_length(F.regexp_extract(m, "([0-9]*)$", 1)), count("/"), count(r"\.\x20"), count("[A-Z]"),
    ]
    return F.array(*[v.cast("double") for v in values])


def _proposal(k: int):
    return lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m"), _features(k, s).alias("x"))


def of_kind(k: int):
    """A lambda that gives a span the number of its kind."""
    return lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def candidates(text: Column, base: Column) -> Column:
    """array<struct<kind, start, end, m, x>>: proposed spans that overlap no base span, with their features."""
    out = []
    for k, hint, pattern in ((k, h, p) for k, kind in enumerate(KINDS) for h, p in zip(HINT[kind], WIDE[kind])):
        spans = disjoint(F.when(text.rlike(hint), find_spans(text, pattern)).otherwise(F.expr(NONE)), base)
        near = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m"), F.substring(text, F.greatest(F.lit(1), s["start"] - BEFORE + 1), F.least(F.lit(BEFORE), s["start"])).alias("before"), F.substring(text, s["end"] + 1, F.lit(1)).alias("edge")))
        out.append(F.transform(near, _proposal(k)))
    return F.concat(*out)


def _sentences(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(text, kind, start, end) of the personal data in it; kind -1: none."""
    rnd = random.Random(seed)
    num = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randint(2, 9)))
    tld = lambda: rnd.choice(["com", "org", "net", "de", "fr", "es", "io"])

    def card() -> str:
        body = num(15)
        total = sum(d if i % 2 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(map(int, body)))
        full = body + str(-total % 10)
        return rnd.choice([". ", "/", "  ", "_", "."]).join(full[i : i + 4] for i in range(0, 16, 4))

    def email() -> str:
        at, dot = rnd.choice([("@", " dot "), (" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" @ ", "."), ("[at]", "."), (" (at) ", ".")])
        return f"{word()}{rnd.choice(['', '.' + word(), num(2)])}{at}{word()}{dot}{tld()}"

    def ip() -> str:
        part = [str(rnd.randint(0, 255)) for _ in range(4)]
        return rnd.choice(["[.]".join(part), "(dot)".join(part), ":".join(f"{rnd.randrange(65536):x}" for _ in range(8))])

    def phone() -> str:
        return rnd.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"00{num(2)} {num(3)} {num(3)} {num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"({num(3)}) {num(4)} {num(4)}"])

    told = {"email": ["email", "mail me:", "contact", "write to"], "ip": ["server", "ip", "host", "login from"], "card": ["card", "visa", "credit card number", "payment by"], "phone": ["call", "phone:", "tel.", "mobile", "fax"]}
    plain = [
        lambda: f"{word()} at {word()}. {word().title()} {word()}", lambda: f"{word()} at {word()}. {word().title()}. {word().title()}. {word().title()} {word()}", lambda: f"{word()} at {word()}. {word()} . {word()}", lambda: f"looked at {word()}. {word().title()}", lambda: f"{num(4)}-{num(4)}-{num(4)} {num(2)}",
        lambda: f"20{num(2)} {num(3)} {num(3)}", lambda: f"pages {num(3)}-{num(3)} {num(3)}", lambda: f"{num(2)} {num(3)} {num(4)}", lambda: f"{num(4)} {num(4)} {num(4)} {num(4)}",
        lambda: f"{num(4)}. {num(4)}. {num(4)}. {num(4)}", lambda: f"part {num(4)}/{num(4)}/{num(4)}/{num(3)}", lambda: f"{num(1)}. {num(1)}. {num(2)}. {num(1)}", lambda: f"version {num(1)} .{num(1)} .{num(2)} .{num(3)}",
        lambda: f"{num(4)}.{num(3)}.{num(3)}", lambda: f"at {num(2)}.{num(3)} {num(4)}", lambda: f"{word()} @ {word()} . {word()}", lambda: f"{num(2)}/{num(4)}{num(3)}",
        lambda: ":".join(f"{rnd.randrange(256):02x}" for _ in range(8)),
    ]
    make = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(n):
        head = " ".join(word() for _ in range(rnd.randint(2, 7)))
        tail = " ".join(word() for _ in range(rnd.randint(1, 4)))
        if rnd.random() < 0.5:
            k = rnd.randrange(4)
            value = make[KINDS[k]]()
            if (KINDS[k] != "phone" or value[0] == "(") and rnd.random() < 0.4:
                cue = ""
            else:
                cue = rnd.choice(told[KINDS[k]]) + " "
            out.append((f"{head} {cue}{value} {tail}", k, len(head) + 1 + len(cue), len(head) + 1 + len(cue) + len(value)))
        else:
            out.append((f"{head} {rnd.choice(plain)()} {tail}", -1, 0, 0))
    return out


@functools.lru_cache(maxsize=4)
def _fitted(spark: SparkSession, rows: int, seed: int) -> boosting.Model:
    made = spark.createDataFrame(_sentences(rows, seed), "text string, kind int, a int, b int")
    none = F.expr(NONE)
    got = made.select("kind", "a", "b", F.explode(candidates(F.col("text"), none)).alias("c")).select(
        F.col("c.kind").alias("k"), F.col("c.x").alias("x"),
        # a candidate is right if it shares at least four fifths of both with the data
        ((F.col("c.kind") == F.col("kind")) & ((F.least("b", "c.end") - F.greatest("a", "c.start")) * 5 >= (F.greatest("b", "c.end") - F.least("a", "c.start")) * 4)).alias("y"),
    ).collect()
    x = np.array([r["x"] for r in got])
    y, k = np.array([float(r["y"]) for r in got]), np.array([r["k"] for r in got])
    order = np.random.default_rng(seed).permutation(np.lexsort((*x.T, y)))
    return boosting.fit(x[order], y[order], k[order], len(KINDS))


def fitted(spark: SparkSession, rows: int = TRAINING_ROWS, seed: int = 11) -> boosting.Model:
    """The trees, fitted once a session on that many template sentences."""
    return _fitted(spark, rows, seed)


def with_spans(rows: DataFrame, text: Column, model: boosting.Model) -> DataFrame:
    """rows with _base and _added, arrays of (kind, start, end), each by kind and start. text must not be null."""
    kinds = base_spans(text)
    limit = F.array(*[F.lit(float(t)) for t in model.thresholds])
    scored = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), model.column(c["x"]).alias("p"))
    rows = rows.withColumn("_base", F.concat(*[F.transform(kinds[k], of_kind(i)) for i, k in enumerate(KINDS)]))
    rows = rows.withColumn("_taken", F.filter(F.transform(candidates(text, F.col("_base")), scored), lambda c: c["p"] >= F.get(limit, c["kind"])))
    rows = best_apart(rows, "_taken", lambda c: F.struct((-c["p"]).alias("p"), c["start"].alias("start"), c["kind"].alias("kind")), "_best")
    plain = F.transform("_best", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return rows.withColumn("_added", F.sort_array(plain)).drop("_taken", "_best")


def told(spans: Column, kinds: tuple[str, ...]) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, model: boosting.Model | None = None) -> DataFrame:
    """docs with spans (struct of base and added)."""
    model = model or fitted(docs.sparkSession)
    rows = with_spans(as_row(docs), F.coalesce(field("text").cast("string"), F.lit("")), model)
    return rows.select(*[field(c).alias(c) for c in docs.columns if c != "spans"], F.struct(F.col("_base").alias("base"), F.col("_added").alias("added")).alias("spans"))


def redacted_documents(docs: DataFrame, model: boosting.Model | None = None) -> DataFrame:
    """docs with each span replaced by [EMAIL], [IP], [CARD] or [PHONE]; n_chars, if there is one, follows the text."""
    model = model or fitted(docs.sparkSession)
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = field("text").cast("string")
    found = with_spans(as_row(docs), F.coalesce(text, F.lit("")), model)
    every = F.transform(F.concat("_base", "_added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(tags, s["kind"]).alias("tag")))
    new = F.when(F.size("_every") > 0, replaced(text, F.col("_every"))).otherwise(text)
    return from_row(found.withColumn("_every", every).withColumn("_text", new), docs, F.col("_text"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda i: F.size(F.filter("spans.base", lambda s: s["kind"] == i)).cast("long")
    return out.select(
        "doc_id", *[n(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(told(F.col("spans.base"), KINDS), 256).alias("base_sha256"),
        told(F.sort_array(F.concat("spans.base", "spans.added")), KINDS).alias("spans"),
    )
