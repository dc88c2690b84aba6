"""Near-duplicates by the Jaccard similarity of 5-word shingles: SimHash fingerprints propose, and MinHash bands beside them; the shingle sets decide.

Pairs of similarity 0.8 differ in about 15 of 100 bits of a SimHash, too many for segments that must be equal. But a bit
in which they differ is nearly always one whose majority is close, and a text knows which these are.

1. Texts of equal lower-case words are one class. It has a SimHash of 128 bits in 8 segments of 16 (simhash.wide). Each
   segment is a key in four variants, its two least certain bits taken either way; what meets by one is compared by the
   pigeonring chains from that segment and the Hamming distance, 33 bits at most. In simulation a pair of similarity 0.8
   is found with probability 0.975, one of 0.85 with 0.994, one of 0.9 with 0.999. For what is missed there, a class also has
   120 least hashes, as 20 bands of 6: a pair of 0.8 meets in some band with probability 0.998, one of 0.5 with 0.27.
2. Where classes meet by a band's key, sketches (two bits of each least hash) leave out pairs that are surely apart: one of
   0.8 is left out with a probability under 0.00001. Each meeting, by segment or band, sends a forest of its pairs, and
   components over all of them are the groups; a class is in one group at most.
3. The texts of a group's members are sent to it, once, and their shingle sets are compared in full: no estimate
   decides. A group over ``chunk`` members is dealt into parts: all of them meet the first part, and what has not joined
   the largest component then meets every part. So a task holds two parts at most, and pairs that are already joined are
   not compared. Components over the links are Spark rounds (components.py).

Cases. Null or empty text, or no word: one class, linked to no other. Under five words: the whole sequence is the only shingle.
Very long texts are hashed whole. Null or repeated ids: rows are told apart by numbers of their own. Empty table: no rows. Other
columns are kept, whatever their names. Two shingles of equal 64-bit hash would be taken for equal, as two texts of equal
128-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, dropped, field, numbered, saved
from .components import components
from .simhash import first_of_each, parted, wide, wide_links
from .substring import ODD, WordHashes, scatter

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 20, 6
FACTORS = scatter(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def lower_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def shingles(ws: list[bytes], known: WordHashes, n: int = WORDS) -> np.ndarray:
    """The distinct hashes of the shingles of ws, in order."""
    if len(known) > known.keep:
        known.clear()
    x = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
    n = min(n, len(x)) or 1
    out = np.zeros(max(len(x) - n + 1, 0), np.uint64)
    for i in range(n):
        out = out * ODD + x[i : i + len(out)]
    return np.unique(scatter(out))


def least_hashes(some: np.ndarray) -> np.ndarray:
    """Of a set that is not empty, by each of the factors."""
    least = np.full(len(FACTORS), 2**64 - 1, np.uint64)
    for at in range(0, len(some), 4096):
        least = np.minimum(least, (FACTORS[:, None] * some[None, at : at + 4096]).min(axis=1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band of least hashes."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = scatter(key * ODD + column)
    return key


def sketch_of(least: np.ndarray) -> np.ndarray:
    """Two bits of each least hash, 32 to a word of 64 bits; what is left over is zero."""
    bits = np.zeros(-(-len(least) // 32) * 32, np.uint64)
    bits[: len(least)] = scatter(least) >> np.uint64(62)
    return (bits.reshape(-1, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many of their least hashes' bits, taken by two, sketches [row, word] differ."""
    d = a ^ b
    return np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=-1, dtype=np.int64)


#: A pair of similarity LEAST differs in that many on average, less those that agree by chance, and 4.5 standard deviations.
APART = BANDS * ROWS * (1 - LEAST) * 0.75 + 4.5 * (BANDS * ROWS * (1 - LEAST) * 0.75 * (1 - (1 - LEAST) * 0.75)) ** 0.5


def _prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = WordHashes()
    for batch in batches:
        same, keys, sketch, bits, low = [], [], [], [], []
        for text in batch["text"]:
            ws = lower_words(text)
            same.append(xxhash.xxh3_128_digest(b" ".join(ws)))
            some = shingles(ws, known)
            least = least_hashes(some) if ws else None
            print_of = wide(some) if ws else (b"", b"")
            bits.append(print_of[0])
            low.append(print_of[1])
            keys.append(band_keys(least).tobytes() if ws else b"")
            sketch.append(sketch_of(least).tobytes() if ws else b"")
        yield pd.DataFrame({"_at": batch["_at"], "same": same, "keys": keys, "sketch": sketch, "bits": bits, "low": low})


def _bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        some = batch[batch["keys"].str.len() > 0]
        yield pd.DataFrame({"key": np.frombuffer(b"".join(some["keys"]), np.int64), "id": np.repeat(some["id"].to_numpy(), BANDS), "sketch": np.repeat(some["sketch"].to_numpy(), BANDS)})


def near_sketches(key: np.ndarray, sketch: np.ndarray, small: int = 64) -> np.ndarray:
    """For each row the first row of its part: rows of one key that pairs of sketches within APART connect. Rows are by key."""
    return parted(key, lambda i, j: differing(sketch[i], sketch[j]) <= APART, small)


def _near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (u, v) between classes that meet by a key and may be similar."""
    got = [b for b in batches if len(b)]
    if got:
        rows = pd.concat(got, ignore_index=True).sort_values(["key", "id"], kind="stable")
        ids = rows["id"].to_numpy()
        sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint64).reshape(len(rows), -1)
        root = near_sketches(rows["key"].to_numpy(), sketch)
        out = np.flatnonzero(root != np.arange(len(root)))
        yield pd.DataFrame({"u": ids[out], "v": ids[root[out]]}).drop_duplicates()


def forest(sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """Links that join all sets which pairs of similarity least or more connect."""
    size = np.array([len(s) for s in sets])
    begin = np.cumsum(size) - size
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    root, links = np.arange(len(sets)), []
    for i in range(len(sets) - 1):
        todo = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        todo = todo[np.minimum(size[todo], size[i]) >= least * np.maximum(size[todo], size[i]) - 1e-9]
        if not len(todo):
            continue
        mine = np.zeros(int(code.max()) + 1, bool)
        mine[code[begin[i] : begin[i] + size[i]]] = True
        for part in np.array_split(todo, -(-len(todo) // 1000)):
            both = np.add.reduceat(mine[np.concatenate([code[begin[j] : begin[j] + size[j]] for j in part])].astype(np.int64), np.cumsum(size[part]) - size[part])
            for j in part[both >= least * (size[part] + size[i] - both) - 1e-9]:
                if root[j] != root[i]:
                    links.append((i, int(j)))
                    root[root == root[j]] = root[i]
    return links


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (u, v) of the meetings in rows (key, id, text) that are sorted by key."""
    known = WordHashes()

    def edges(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        keys, ids, texts = rows["key"].to_numpy(), rows["id"].to_numpy(), rows["text"].to_numpy()
        cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        u, v = [], []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            for i, j in forest([shingles(lower_words(t), known) for t in texts[a:b]]):
                u.append(ids[a + i])
                v.append(ids[a + j])
        yield pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})

    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = batch["key"].iloc[-1]
        closed = batch["key"] != last
        if rest and rest[0]["key"].iloc[0] != last:
            yield from edges(pd.concat([*rest, batch[closed]], ignore_index=True))
            rest = [batch[~closed]]
        elif closed.any():
            yield from edges(batch[closed])
            rest = [batch[~closed]]
        else:
            rest.append(batch)
    if rest:
        yield from edges(pd.concat(rest, ignore_index=True))


def _links(met: DataFrame, rows: DataFrame, parts: int) -> DataFrame:
    """Edges (u, v) between members of one meeting, of met (id, key); rows (_at, text)."""
    # met grows with the documents: the same join at every size
    joined = rows.join(met.hint("merge"), F.col("_at") == F.col("id")).select("key", "id", "text").repartition(parts, "key").sortWithinPartitions("key")
    return joined.mapInPandas(_verified, "u long, v long")


def near_labels(rows: DataFrame, chunk: int = 1000, batch: int = 1000) -> DataFrame:
    """_at and _root of every row of rows (_at, text): rows that pairs of similarity 0.8 or more connect have one _root.

    chunk: members of a group that meet in one part, about; batch: texts that a Python worker holds at a time.
    """
    with batches_of(rows.sparkSession, batch):
        return _near_labels(rows, chunk)


def _near_labels(rows: DataFrame, chunk: int) -> DataFrame:
    spark = rows.sparkSession
    least_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    prints = saved(rows.mapInPandas(_prints, "_at long, same binary, keys binary, sketch binary, bits binary, low binary"), "near-prints")
    classes = saved(prints.groupBy("same").agg(F.min(F.struct("_at", "keys", "sketch", "bits", "low")).alias("x")).select("same", F.col("x._at").alias("id"), "x.keys", "x.sketch", "x.bits", "x.low"), "near-classes")
    # a partition is held whole: a million rows or so each
    n_classes = classes.count()
    parts = max(least_parts, -(-n_classes * BANDS // 1_000_000))
    bands = classes.select("id", "keys", "sketch").mapInPandas(_bands, "key long, id long, sketch binary").repartition(parts, "key")
    close = wide_links(classes, n_classes).unionByName(bands.mapInPandas(_near, "u long, v long"))
    groups = components(close, "near-groups").withColumnRenamed("node", "id")
    size = groups.groupBy(F.col("root").alias("_r")).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(chunk))).cast("int").alias("n"))
    members = saved(groups.join(size, F.col("root") == F.col("_r")).select("id", "root", "n", F.pmod(F.xxhash64("id"), "n").cast("int").alias("part")), "near-members")
    every = F.sequence(F.lit(0), F.col("n") - 1)
    first = members.select("id", "root", F.explode(F.when(F.col("part") == 0, every).otherwise(F.array("part"))).alias("at"))
    links = saved(_links(first.select("id", F.xxhash64("root", "at").alias("key")), rows, parts), "near-links")
    roots = components(links, "near-components")
    # of groups in several parts, what stands outside the largest component meets every part
    large = members.where("n > 1").join(roots.withColumnRenamed("root", "_c"), F.col("id") == F.col("node"), "left").select("id", "root", "n", "part", F.coalesce("_c", "id").alias("c"))
    most = large.groupBy("root", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("root").agg(F.max_by("c", F.struct("k", "c")).alias("c"))
    rest = saved(large.join(most, ["root", "c"], "left_anti").select("id", "root", "n"), "near-rest")
    if not rest.isEmpty():
        halves = rest.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(chunk))).cast("int").alias("m"))
        again = F.sequence(F.lit(0), F.col("m") - 1)
        one = members.join(halves, "root").select("id", "root", F.col("part").alias("a"), F.explode(again).alias("b"))
        other = rest.join(halves, "root").select("id", "root", F.explode(every).alias("a"), F.pmod(F.xxhash64("id", F.lit(2)), "m").cast("int").alias("b"))
        met = one.unionByName(other).select("id", F.xxhash64("root", "a", "b").alias("key")).distinct()
        roots = components(links.unionByName(_links(met, rows, parts)), "near-components")
    # written, so that the last join deals out both its sides, and one with a hot text can be split
    label = saved(classes.join(roots, classes["id"] == roots["node"], "left").select("same", F.coalesce("root", "id").alias("_root")), "near-labels")
    out = saved(prints.select("_at", "same").join(label, "same").select("_at", "_root"), "near-roots")
    dropped(prints, classes, members, links, rest, label)
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies: that of the least doc_id, nulls last, the first by text and source where rows repeat it."""
    rows = numbered(docs, "near-rows")
    return first_of_each(rows, near_labels(rows.select("_at", field("text").cast("string").alias("text"))), docs)
