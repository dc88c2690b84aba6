"""Substring dedup by recompression.

A text's words become symbols; rounds then name runs of one symbol and pairs of symbols. A name is a 64-bit hash of
what it stands for, the same function on every executor, so it is global without a dictionary passing through a
shuffle. Which pairs a round names depends on one bit of each symbol (left or right), so equal substrings get equal
symbols except near their ends. Rounds are restricted: round r makes no symbol over limits[r] words, and only runs of
up to ``run`` symbols are named. Then a round loses at most limits[r] - 1 words at either end of a substring, and
naming runs at most ``run``; the limits are chosen so that all rounds together lose at most the outer quarters of a
window. The symbols over its inner words are therefore the same in each occurrence of the window, and the one of
them with the least name is the window's anchor. Neighbouring windows mostly share theirs.

1. Per anchor, the key is a hash of the words around it that any window with this anchor holds. Keys are shuffled; anchors
   whose key stands anywhere else are shared. Keys met more than once in a batch are sent once, as known.
2. Texts meet their shared anchors. A text without one is done: nothing of it repeats.
3. The hashes of the windows of each shared anchor meet again by key: a window counts as repeated if another
   occurrence has the same key, the same place in the anchor and the same hash. The masks go back to the texts.

A hot passage sends a row a batch, not a row an occurrence; nothing makes pairs. Work is per batch in numpy.
Intermediate rows are written to the shared folder. Two windows count as equal by two hashes of 64 bits, that of the
words around their anchor (key) and that of all their words; no other approximation is made: rows of one row hash only
share their anchors' places, which propose, and each row goes on under a number of its own.

Cases. Null or empty text: no words, nothing removed. Null or repeated doc_id: each row is a text of its own, so a
repeated row repeats all its windows. Texts under a window: nothing removed. Very long texts are read whole, in blocks of
texts of about a million words. Empty table: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts_for, read, saved

ODD = np.uint64(0x9E3779B97F4A7C15)
#: Most words of a symbol, and most windows of an anchor that a mask holds.
LARGEST = 16
MASK = 40


def scatter(z: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection."""
    z = z + ODD
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def limits_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest run that is named, and the most words of a symbol round by round."""
    left = window // 4
    run = min(3, left // 2)
    left, limits, size = left - run, [], 2
    while left >= size - 1 and size <= LARGEST:
        limits.append(size)
        left -= size - 1
        size *= 2
    while left >= 1 and limits:
        size = max(x for x in (2, 4, 8, LARGEST) if x <= max(limits) and x - 1 <= left)
        limits.append(size)
        left -= size - 1
    return run, tuple(sorted(limits))


def parse(x: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and name of the symbols that the rounds leave. x: word hashes; doc: the text of each."""
    run, limits = limits_for(window)
    sym, start, length = scatter(x), np.arange(len(x)), np.ones(len(x), np.int64)
    if run > 1 and len(x):
        first = np.flatnonzero(np.r_[True, (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])])
        k = np.diff(np.r_[first, len(x)])
        named = (k > 1) & (k <= run)
        keep = ~np.repeat(named, k)
        keep[first] = True
        at = first[named]
        sym[at] = scatter(sym[at] * ODD + k[named].astype(np.uint64))
        length[at] = k[named]
        sym, start, length, doc = sym[keep], start[keep], length[keep], doc[keep]
    for r, limit in enumerate(limits):
        right = scatter(sym ^ np.uint64(r + 1)) >> np.uint64(63) == 1
        a = np.flatnonzero(~right[:-1] & right[1:] & (length[:-1] + length[1:] <= limit) & (doc[:-1] == doc[1:]))
        sym[a] = scatter(scatter(sym[a]) + sym[a + 1] * ODD)
        length[a] += length[a + 1]
        keep = np.ones(len(sym), bool)
        keep[a + 1] = False
        sym, start, length, doc = sym[keep], start[keep], length[keep], doc[keep]
    return start, length, sym


def least_between(name: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Index of the least name from a to b, both included; the first of equal ones."""
    out = np.empty(len(a), np.int64)
    level, best = 0, np.arange(len(name))
    size = b - a + 1
    todo = np.arange(len(a))
    while len(todo):
        span = 1 << level
        now = size[todo] < 2 * span
        at = todo[now]
        x, y = best[a[at]], best[b[at] - span + 1]
        out[at] = np.where(name[y] < name[x], y, x)
        todo = todo[~now]
        if len(todo):
            x, y = best[:-span], best[span:]
            best = np.where(name[y] < name[x], y, x)
            level += 1
    return out


class Spans:
    """Hashes of spans of a row of word hashes, from prefix sums."""

    def __init__(self, x: np.ndarray):
        power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(x), ODD)])
        self.back = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(x), np.uint64(pow(int(ODD), -1, 2**64)))])
        self.prefix = np.r_[np.uint64(0), np.add.accumulate(scatter(x) * power[:-1])]

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return scatter((self.prefix[hi] - self.prefix[lo]) * self.back[lo] + (hi - lo).astype(np.uint64))


class WordHashes(dict):
    keep = 300_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 35)
        self[word] = h
        return h


def row_hash(doc_id, raw: bytes) -> int:
    """Of a row, as a signed long."""
    seed = 0 if pd.isna(doc_id) else (int(doc_id) * 2 + 1) % 2**64
    h = xxhash.xxh64_intdigest(raw, seed)
    return h - 2**64 if h >= 2**63 else h


class Block:
    """Some texts as one row of word hashes, with their anchors: symbol (start, length), first window, number of windows, key, code."""

    def __init__(self, split: list[list[bytes]], known: WordHashes, window: int):
        if len(known) > known.keep:
            known.clear()
        n = np.array([len(w) for w in split], np.int64)
        x = np.concatenate([np.zeros(0, np.uint64), *(np.fromiter(map(known.__getitem__, w), np.uint64, len(w)) for w in split)])
        doc = np.repeat(np.arange(len(n)), n)
        self.begin = np.cumsum(n) - n
        self.spans = Spans(x)
        start, length, name = parse(x, doc, window)
        symbol = np.repeat(np.arange(len(start)), length)
        s = np.arange(len(x))
        s = s[s + window <= (self.begin + n)[doc]]
        edge = window // 4
        chosen = least_between(name, symbol[s + edge], symbol[s + window - 1 - edge])
        new = np.flatnonzero(np.r_[np.ones(min(1, len(s)), bool), (chosen[1:] != chosen[:-1]) | (s[1:] != s[:-1] + 1)])
        self.first, self.windows = s[new], np.diff(np.r_[new, len(s)])
        self.start, self.length, self.doc = start[chosen[new]], length[chosen[new]], doc[s[new]]
        self.key = scatter(self.spans.of(self.start + self.length - 1 - edge, self.start + edge + 1) + self.length.astype(np.uint64) * ODD)
        self.code = (self.start - self.begin[self.doc]) * (2 * LARGEST) + self.length


def _blocks(batch: pd.DataFrame, most: int = 1_000_000) -> Iterator[tuple[pd.DataFrame, list[bytes], list[list[bytes]]]]:
    """Rows of batch, their texts as bytes and as words, about so many words at a time."""
    raws, split, begin, n = [], [], 0, 0
    for k, text in enumerate(batch["text"]):
        raw = (text or "").encode("utf-8", "replace")
        raws.append(raw)
        split.append(raw.split())
        n += len(split[-1])
        if n >= most or k + 1 == len(batch):
            yield batch.iloc[begin : k + 1], raws, split
            raws, split, begin, n = [], [], k + 1, 0


def _ask(window: int):
    """Rows (k, row, code): a code of -1 stands for anchors known to be shared; under -1 it is such an anchor itself, once a block, under a key that spreads."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            for rows, raws, split in _blocks(batch):
                b = Block(split, known, window)
                row = np.array([row_hash(i, r) for i, r in zip(rows["doc_id"], raws)], np.int64)[b.doc]
                some, first, back, count = np.unique(b.key, return_index=True, return_inverse=True, return_counts=True)
                shared = count[back] > 1
                sure = np.unique(np.stack([row[shared], b.code[shared]]), axis=1)  # equal rows have equal ones
                spread = scatter(sure[0].view(np.uint64) + sure[1].astype(np.uint64) + row[:1].view(np.uint64).sum())
                k = np.r_[b.key[~shared], some[count > 1], spread].view(np.int64)
                stands = int((count > 1).sum())
                yield pd.DataFrame({"k": k, "row": np.r_[row[~shared], np.zeros(stands, np.int64), sure[0]], "code": np.r_[b.code[~shared], np.full(stands, -1), -2 - sure[1]]})

    return run


def _answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    got = []
    for b in batches:
        k, row, code = b["k"].to_numpy(), b["row"].to_numpy(), b["code"].to_numpy()
        sure = code < -1
        if sure.any():
            yield pd.DataFrame({"row": row[sure], "code": -2 - code[sure]})
        got.append((k[~sure], row[~sure], code[~sure]))
    if got:
        k, row, code = (np.concatenate(x) for x in zip(*got))
        order = np.argsort(k, kind="stable")
        k, row, code = k[order], row[order], code[order]
        same = k[1:] == k[:-1]
        shared = np.r_[False, same] | np.r_[same, False]
        hit = shared & (code >= 0)
        yield pd.DataFrame({"row": row[hit], "code": code[hit]})


def _digest(kept: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(kept)).hexdigest()


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        raws = [(t or "").encode("utf-8", "replace") for t in batch["text"]]
        yield pd.DataFrame({"row": np.array([row_hash(i, r) for i, r in zip(batch["doc_id"], raws)], np.int64), "doc_id": batch["doc_id"], "z": [press.compress(r) for r in raws]})


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts without shared anchors are done; the others go on with theirs."""
    unpress = zstandard.ZstdDecompressor()
    for batch in batches:
        n, digest, z = [], [], []
        for data, codes in zip(batch["z"], batch["codes"]):
            if codes is None:
                ws = unpress.decompress(data).split()
                n.append(len(ws))
                digest.append(_digest(ws))
                z.append(None)
            else:
                n.append(None)
                digest.append(None)
                z.append(data)
        yield pd.DataFrame({"row": batch["row"], "doc_id": batch["doc_id"], "n_words": pd.array(n, "Int64"), "kept_sha256": digest, "z": z, "codes": batch["codes"]})


def _windows(window: int):
    """Rows (k, row, at, hashes): an anchor's windows, at = first start * 64 + place in the anchor.

    at < 0 (-1 - place) stands for windows known to be repeated. Without hashes it is such an anchor itself: the low bits of k are its mask, the others spread it.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, unpress = WordHashes(), zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                b = Block([unpress.decompress(z).split() for z in part["z"]], known, window)
                wanted = np.concatenate([np.full(len(c), k, np.int64) * 2**36 + c for k, c in enumerate(part["codes"])])
                ok = np.isin(b.doc * np.int64(2**36) + b.code, wanted)
                first, n, doc, key = b.first[ok], b.windows[ok], b.doc[ok], b.key[ok]
                row = part["row"].to_numpy()[doc]
                last = first + n - 1
                place = first - b.start[ok] + window
                whole = scatter(b.spans.of(first, last + window) + key + (place * 64 + n).astype(np.uint64) * ODD)
                _, one, back, count = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
                shared = count[back] > 1
                ask = np.flatnonzero(~shared)
                stands = one[count > 1]
                send = np.r_[ask, stands]
                each = np.repeat(first[send], n[send]) + (np.arange(n[send].sum()) - np.repeat(np.cumsum(n[send]) - n[send], n[send]))
                raw = b.spans.of(each, each + window).tobytes()
                cut = np.r_[0, np.cumsum(n[send])] * 8
                hashes = [raw[x:y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
                where = (first - b.begin[doc]) * 64 + place
                yield pd.DataFrame({"k": key[send].view(np.int64), "row": np.r_[row[ask], np.zeros(len(stands), np.int64)], "at": np.r_[where[ask], -1 - place[stands]], "hashes": hashes})
                if shared.any():
                    spread = scatter(row[shared].view(np.uint64) + where[shared].astype(np.uint64))
                    mask = (np.int64(1) << n[shared]) - 1
                    # the low bits hold the mask, the others spread the row
                    k = (spread.view(np.int64) & ~np.int64(2**MASK - 1)) | mask
                    yield pd.DataFrame({"k": k, "row": row[shared], "at": where[shared], "hashes": None})

    return run


def _masks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (row, start, mask): the first window's start, and which of the windows from there on are repeated."""
    shift = 2**MASK
    got = []
    for b in batches:
        sure = b["hashes"].isna().to_numpy()
        if sure.any():
            s = b[sure]
            yield pd.DataFrame({"row": s["row"], "start": s["at"] // 64, "mask": s["k"] & (shift - 1)})
        got.append(b[~sure])
    rows = pd.concat(got, ignore_index=True) if got else None
    if rows is None or not len(rows):
        return
    n = np.array([len(h) // 8 for h in rows["hashes"]], np.int64)
    w = np.frombuffer(b"".join(rows["hashes"]), np.uint64)
    owner = np.repeat(np.arange(len(rows)), n)
    nth = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
    at = rows["at"].to_numpy()
    place = np.where(at < 0, -1 - at, at % 64)[owner] + nth
    k = rows["k"].to_numpy()[owner]
    word = scatter(w + place.astype(np.uint64) * ODD)
    stands = (at < 0)[owner]
    order = np.lexsort((word, k))
    ks, ws, st = k[order], word[order], stands[order]
    same = (ks[1:] == ks[:-1]) & (ws[1:] == ws[:-1])
    hit = np.zeros(len(w), bool)
    hit[order] = (np.r_[False, same] | np.r_[same, False]) & ~st
    mask = np.zeros(len(rows), np.int64)
    np.bitwise_or.at(mask, owner[hit], np.int64(1) << nth[hit])
    out = np.flatnonzero(mask)
    yield pd.DataFrame({"row": rows["row"].to_numpy()[out], "start": at[out] // 64, "mask": mask[out]})


def covered(n: int, starts, masks, window: int) -> np.ndarray:
    """Which of n words a repeated window covers."""
    steps = np.zeros(n + 1, np.int64)
    if starts is not None:
        first, mask = np.asarray(starts, np.int64), np.asarray(masks, np.int64)
        for k in range(MASK):
            at = first[(mask >> k & 1) == 1] + k
            np.add.at(steps, at, 1)
            np.add.at(steps, at + window, -1)
    return np.cumsum(steps[:n]) > 0


def _finish(window: int, texts: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            n, gone, digest, kept = [], [], [], []
            for z, starts, masks in zip(batch["z"], batch["starts"], batch["masks"]):
                ws = unpress.decompress(z).split()
                out = covered(len(ws), starts, masks, window)
                left = [w for w, x in zip(ws, out.tolist()) if not x]
                n.append(len(ws))
                gone.append(int(out.sum()))
                digest.append(_digest(left))
                kept.append(b" ".join(left).decode("utf-8", "replace") if texts else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_words": n, "n_removed": gone, "kept_sha256": digest, "kept": kept})

    return run


def without_repeats(docs: DataFrame, window: int = 35, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, for texts that lose words, kept of every row of docs (doc_id, text)."""
    if not 3 <= window <= 48:
        raise ValueError("a window has 3 to 48 words")
    # ids pass as strings: as numbers, pandas would round them beside nulls
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = parts_for(docs)
    asked = rows.mapInPandas(_ask(window), "k long, row long, code long").repartition(parts, "k")
    # equal rows have equal codes: a set holds what one text has, however often it stands
    codes = asked.mapInPandas(_answer, "row long, code long").groupBy("row").agg(F.collect_set("code").alias("codes"))
    packed = rows.mapInPandas(_packed, "row long, doc_id string, z binary")
    met = packed.join(codes, "row", "left").mapInPandas(_meet, "row long, doc_id string, n_words long, kept_sha256 string, z binary, codes array<long>")
    met = saved(met.withColumn("row", F.monotonically_increasing_id()), "substring-texts")
    shared = met.where("z is not null")
    windows = shared.select("row", "z", "codes").mapInPandas(_windows(window), "k long, row long, at long, hashes binary").repartition(parts, "k")
    hits = windows.mapInPandas(_masks, "row long, start long, mask long").groupBy("row").agg(F.collect_list(F.struct("start", "mask")).alias("h")).select("row", F.col("h.start").alias("starts"), F.col("h.mask").alias("masks"))
    cut = shared.select("row", "doc_id", "z").join(hits, "row", "left").mapInPandas(_finish(window, texts), "doc_id string, n_words long, n_removed long, kept_sha256 string, kept string")
    done = met.where("z is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept"))
    return done.unionByName(cut).withColumn("doc_id", F.col("doc_id").cast("long"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read(spark, sf_dir, "documents"), texts=False).drop("kept")


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT row_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS t
  FROM (SELECT row_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), again AS (
  SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY t) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT row_id, list(DISTINCT i + k) AS p FROM again, (SELECT unnest(range(0, 35)) AS k) GROUP BY row_id
), word AS (
  SELECT d.row_id, i, w[i] AS x, g.i IS NULL AS stays
  FROM (SELECT row_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) d LEFT JOIN (SELECT row_id, unnest(p) AS i FROM gone) g USING (row_id, i)
), kept AS (
  SELECT row_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word WHERE stays GROUP BY row_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (row_id)
"""
