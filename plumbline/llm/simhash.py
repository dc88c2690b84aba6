"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has 64 bits, each the majority of that bit over the XXH64 hashes of a text's word shingles. Equal
fingerprints are one class. Between classes the candidates come from the pigeonring principle (Qin and Xiao,
2018): cut two fingerprints that differ in at most t bits into m segments on a ring; then some segment i exists
from which every chain of l consecutive segments differs in at most l * t / m bits in all. With t = 2 and m = 5
chains of one and two segments must be equal, of three and four differ in at most one bit. The equal chain of two
segments is the key under which fingerprints meet, the longer chains prune before the full Hamming check.

A key's bucket never turns into all its pairs: buckets compare in vectors, and what a bucket emits is one edge per
fingerprint, to the least of its part. With 25 bits as the key, 10 billion different fingerprints make buckets of
300. Only in a bucket over ``dense`` fingerprints, a very large group of near copies, all masks of t free bits are walked
instead: fingerprints equal outside a mask are within t bits, so a sort a mask finds every link with memory for one
column. Components over the classes are Spark rounds (components.py).

Texts that are less alike (the pipeline's near-dedup, minhash.py) have wider fingerprints: a segment is a key in variants, its
least certain bits taken either way, and the chains from it prune as above.

Cases. Null or empty text, or no word: fingerprint zero, linked like any other. Under n words: the whole sequence
is the only shingle. Null doc_id: gets its fingerprint's component, or null when no id is in it. Repeated rows stay.
Very long texts are hashed whole, in blocks of shingles. Empty table: no rows. Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import field, from_row, numbered, read, saved
from .components import components
from .substring import scatter

BITS = 64
SEED = 42


def fingerprint(text: str | None, n: int = 3) -> int:
    ws = (text or "").encode("utf-8", "replace").lower().split()
    if not ws:
        return 0
    shingles = map(b" ".join, zip(*(ws[i:] for i in range(n)))) if len(ws) >= n else [b" ".join(ws)]
    digest = xxhash.xxh64_intdigest
    ones, total = np.zeros(BITS, np.int64), 0
    while True:  # in blocks, so that a very long text needs no more memory
        h = np.fromiter((digest(s, SEED) for s in itertools.islice(shingles, 65_536)) if not isinstance(shingles, list) else (digest(s, SEED) for s in shingles), np.uint64)
        if len(h):
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
            total += len(h)
        if isinstance(shingles, list) or len(h) < 65_536:
            break
    value = np.packbits((2 * ones > total).astype(np.uint8), bitorder="little").view("<u8")[0]
    return int(value)


def _fingerprints(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([fingerprint(t, n) for t in batch["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": fp})

    return run


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every row of docs (doc_id, text)."""
    # ids pass as strings: as numbers, pandas would round them beside nulls
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(_fingerprints(n), "doc_id string, fp long").select(F.col("doc_id").cast("long").alias("doc_id"), "fp")


def segments(m: int) -> list[tuple[int, int]]:
    """First bit and width of m segments."""
    cuts = [BITS * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def chain_keys(fp: np.ndarray, m: int, bound: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each start on the ring the bits of the chain that must be equal, all else zero."""
    seg = segments(m)
    equal = sum(1 for length in range(1, m + 1) if length * bound // m == 0)
    for i in range(m):
        mask = 0
        for j in range(equal):
            a, width = seg[(i + j) % m]
            mask |= ((1 << width) - 1) << a
        yield i, fp & np.uint64(mask)


def passes_chains(diff: np.ndarray, start: np.ndarray, m: int, bound: int) -> np.ndarray:
    """Whether each chain from start keeps within its share of the bound; the full chain is the Hamming check."""
    seg = segments(m)
    per = np.stack([np.bitwise_count(diff & np.uint64(((1 << w) - 1) << a)) for a, w in seg]).astype(np.int64)
    total, ok = np.zeros(len(diff), np.int64), np.ones(len(diff), bool)
    at = np.arange(len(diff))
    for length in range(1, m + 1):
        total += per[(start + length - 1) % m, at]
        ok &= total <= length * bound // m
    return ok


def merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root after joining a with b; root points at the least index of each part."""
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return root


def linked(fp: np.ndarray, key: np.ndarray, start: np.ndarray, m: int, bound: int, dense: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, least of its part) within the buckets of equal (start, key)."""
    order = np.lexsort((fp, key, start))
    fp, key, start = fp[order], key[order], start[order]
    fresh = np.r_[True, (key[1:] != key[:-1]) | (start[1:] != start[:-1])]
    first = np.flatnonzero(fresh)
    size = np.diff(np.r_[first, len(fp)])
    bucket = np.repeat(np.arange(len(first)), size)
    root = np.arange(len(fp))
    small = np.flatnonzero(np.isin(bucket, np.flatnonzero((size > 1) & (size <= dense))))
    for d in range(1, int(size[size <= dense].max(initial=1))):
        a = small[small + d < len(fp)]
        a = small = a[bucket[a + d] == bucket[a]]  # who has no partner at this distance has none further on
        if not len(a):
            break
        hit = a[passes_chains(fp[a] ^ fp[a + d], start[a], m, bound)]
        root = merged(root, hit, hit + d)
    for k in np.flatnonzero(size > dense):
        lo, hi = first[k], first[k] + size[k]
        some = fp[lo:hi]
        seg = segments(m)
        equal = sum(1 for length in range(1, m + 1) if length * bound // m == 0)
        fixed = {x for j in range(equal) for x in range(seg[(start[lo] + j) % m][0], sum(seg[(start[lo] + j) % m]))}
        free = [x for x in range(BITS) if x not in fixed]
        part = np.arange(len(some))
        for bits in itertools.combinations(free, bound):
            masked = some & np.uint64(~sum(1 << x for x in bits) & (2**64 - 1))
            o = np.argsort(masked, kind="stable")
            same = np.flatnonzero(masked[o][1:] == masked[o][:-1])
            part = merged(part, o[same], o[same + 1])
        root[lo:hi] = part + lo
    out = np.flatnonzero(root != np.arange(len(fp)))
    return fp[out], fp[root[out]]


# --- similarity 0.8: wide fingerprints, keys that allow for their least certain bits ---
WIDE, WIDTH, FLIPS = 128, 16, 2
SEGMENTS = WIDE // WIDTH
#: Of sets of similarity 0.8 a bit differs with probability 0.151; 3.3 standard deviations more, 3 pairs in 10,000 differ in more.
FAR = 33
QUOTAS = np.arange(1, SEGMENTS + 1) * FAR // SEGMENTS


def wide(some: np.ndarray) -> tuple[bytes, bytes]:
    """The SimHash of WIDE bits of a set of hashes, and the FLIPS bits of each segment whose majorities are closest."""
    ones = np.zeros(WIDE, np.int64)
    for at in range(0, len(some), 255):  # sums of up to 255 bits stay within a byte
        part = some[at : at + 255]
        both = np.stack([part, scatter(part ^ np.uint64(SEED))], axis=1)
        ones += np.unpackbits(both.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    margin = np.abs(2 * ones - len(some)).reshape(SEGMENTS, WIDTH)
    low = np.argsort(margin, axis=1, kind="stable")[:, :FLIPS].astype(np.uint8)
    return np.packbits((2 * ones > len(some)).astype(np.uint8), bitorder="little").tobytes(), low.tobytes()


def segment_keys(bits: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Keys [row, segment and variant] of fingerprints [row, segment] whose bits low [row, segment, flip] are taken either way.

    Two meet in a segment if all bits of it in which they differ are among the least certain of one of them.
    """
    masks = np.uint16(1) << low.astype(np.uint16)
    chosen = (np.arange(2**FLIPS)[:, None] >> np.arange(FLIPS)) & 1
    flips = np.bitwise_or.reduce(np.where(chosen.astype(bool), masks[:, :, None, :], np.uint16(0)), axis=3)
    keys = (bits[:, :, None] ^ flips).astype(np.int32) | (np.arange(SEGMENTS, dtype=np.int32) << WIDTH)[:, None]
    return keys.reshape(len(bits), SEGMENTS * 2**FLIPS)


def within_far(bits: np.ndarray, start: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether rows i and j of bits [row, segment] differ in FAR bits at most, and each chain from start [row] keeps within its share."""
    words = bits.view(np.uint64)

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = np.bitwise_count(words[i] ^ words[j]).sum(axis=-1, dtype=np.int64) <= FAR
        at = np.flatnonzero(ok)
        if len(at):
            i, j = (np.broadcast_to(x, ok.shape)[at] for x in (i, j))
            per = np.bitwise_count(bits[i] ^ bits[j]).astype(np.int64)
            ring = (start[i][:, None] + np.arange(SEGMENTS)) % SEGMENTS
            ok[at] = (np.cumsum(np.take_along_axis(per, ring, axis=1), axis=1) <= QUOTAS).all(axis=1)
        return ok

    return near


def parted(key: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray], small: int = 64) -> np.ndarray:
    """For each row the first row of its part: rows of one key that pairs of near rows connect. Rows are by key."""
    first = np.flatnonzero(np.r_[np.ones(min(1, len(key)), bool), key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    root = np.arange(len(key))
    n = np.repeat(size, size)
    some = np.flatnonzero((n > 1) & (n <= small))
    for d in range(1, int(size[size <= small].max(initial=1))):
        at = some[some + d < len(key)]
        at = some = at[key[at + d] == key[at]]  # who has no partner at this distance has none further on
        at = at[near(at, at + d)]
        root = merged(root, at, at + d)
    for lo, m in zip(first[size > small].tolist(), size[size > small].tolist()):
        part = np.arange(m)
        for i in range(m - 1):
            todo = np.flatnonzero(part[i + 1 :] != part[i]) + i + 1
            close = todo[near(todo + lo, np.array(i + lo))]
            for r in np.unique(part[close]):
                part[part == max(r, part[i])] = min(r, part[i])
        root[lo : lo + m] = part + lo
    return root


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        some = batch[batch["bits"].str.len() > 0]
        bits = np.frombuffer(b"".join(some["bits"]), np.uint16).reshape(-1, SEGMENTS)
        keys = segment_keys(bits, np.frombuffer(b"".join(some["low"]), np.uint8).reshape(-1, SEGMENTS, FLIPS))
        each, words = keys.shape[1], bits.view(np.int64)
        yield pd.DataFrame({"key": keys.ravel(), "id": np.repeat(some["id"].to_numpy(), each), **{f"w{k}": np.repeat(words[:, k], each) for k in range(WIDE // 64)}})


def _close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    got = [b for b in batches if len(b)]
    if got:
        rows = pd.concat(got, ignore_index=True).sort_values(["key", "id"], kind="stable")
        key, ids = rows["key"].to_numpy(), rows["id"].to_numpy()
        bits = np.stack([rows[f"w{k}"].to_numpy() for k in range(WIDE // 64)], axis=1).view(np.uint16)
        root = parted(key, within_far(bits, key >> WIDTH))
        out = np.flatnonzero(root != np.arange(len(root)))
        yield pd.DataFrame({"u": ids[out], "v": ids[root[out]]}).drop_duplicates()


def wide_links(classes: DataFrame, rows: int) -> DataFrame:
    """Edges (u, v) between so many rows of classes (id, bits, low), as of wide(), that are within FAR bits and pass the chains of a segment they share."""
    keys = classes.select("id", "bits", "low").mapInPandas(_segments, "key int, id long, " + ", ".join(f"w{k} long" for k in range(WIDE // 64)))
    # a partition is held whole: a million rows or so each
    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows * SEGMENTS * 2**FLIPS // 1_000_000))
    return keys.repartition(parts, "key").mapInPandas(_close, "u long, v long")


def _links(m: int, bound: int, dense: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [(b["fp"].to_numpy().view(np.uint64), b["key"].to_numpy().view(np.uint64), b["start"].to_numpy()) for b in batches if len(b)]
        if got:
            fp, key, start = (np.concatenate(x) for x in zip(*got))
            u, v = linked(fp, key, start, m, bound, dense)
            yield pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return run


def _keys(m: int, bound: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy().view(np.uint64)
            for i, key in chain_keys(fp, m, bound):
                yield pd.DataFrame({"start": np.full(len(fp), i, np.int32), "key": key.view(np.int64), "fp": fp.view(np.int64)})

    return run


def near_classes(prints: DataFrame, bound: int = 2, m: int = 5, dense: int = 1024) -> DataFrame:
    """doc_id, fp and component_id of every row of prints (doc_id, fp)."""
    classes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    keys = classes.select("fp").mapInPandas(_keys(m, bound), "start int, key long, fp long")
    # a partition is held whole: a million rows or so each
    parts = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-classes.count() * m // 1_000_000))
    edges = keys.repartition(parts, "start", "key").mapInPandas(_links(m, bound, dense), "u long, v long")
    roots = components(edges, "simhash-components")
    member = roots.join(classes, roots["node"] == classes["fp"]).select("node", "root", "least")
    named = member.join(member.groupBy("root").agg(F.min("least").alias("component")), "root").select("node", "component")
    # written, so that the last join deals out both its sides, and one with a hot fingerprint can be split
    label = saved(classes.join(named, classes["fp"] == named["node"], "left").select("fp", F.coalesce("component", "least").alias("component_id")), "simhash-labels")
    return prints.join(label, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, n: int = 3, bound: int = 2) -> DataFrame:
    """doc_id, fp and component_id of every row of docs (doc_id, text); texts within bound bits are linked."""
    return near_classes(saved(fingerprints(docs, n), "simhash-prints"), bound)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each component: that of the least doc_id, nulls last, the first by text and source where rows repeat it."""
    rows = numbered(docs, "simhash-rows")
    # components over row ids of its own: doc_id may be null or stand on unrelated rows
    label = near_duplicates(rows.select(F.col("_at").alias("doc_id"), field("text").alias("text")), **options).select(F.col("doc_id").alias("_at"), F.col("component_id").alias("_root"))
    return first_of_each(rows, label, docs)


def first_of_each(rows: DataFrame, label: DataFrame, docs: DataFrame) -> DataFrame:
    """Of rows (_row, _at) the first of each _root in label (_at, _root), as rows of docs."""
    named = rows.select("_at", field("doc_id").cast("long").alias("_doc")).join(label, "_at").select("_at", "_root", F.col("_doc").isNull().alias("_none"), "_doc")
    named = saved(named, "dedup-named")
    same = named.groupBy("_root", "_none", "_doc").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_at"))
    least = saved(same.groupBy("_root").agg(F.min(F.struct("_none", "_doc", "n", "_at")).alias("x")).select("_root", "x.*"), "dedup-least")
    keep = least.where("n = 1").select("_at")
    # the least id of a component mostly stands on one row; text and source are read only where it does not
    tied = least.where("n > 1").select(F.col("_root").alias("_r"), F.col("_doc").alias("_d"))
    if not tied.isEmpty():
        again = named.join(tied, (F.col("_root") == F.col("_r")) & F.col("_doc").eqNullSafe(F.col("_d"))).select("_at", "_root")
        source = field("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
        order = F.struct(field("text").cast("string"), source, F.col("_at"))
        chosen = rows.join(again, "_at").groupBy("_root").agg(F.min_by("_at", order).alias("_at")).select("_at")
        keep = saved(keep.unionByName(chosen), "dedup-keep")
    # keep grows with the documents: the same join at every size
    return from_row(rows.join(keep.hint("merge"), "_at", "left_semi"), docs)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
