"""Best-fit packing by minimum bin slack.

Tokenising runs where the texts are; equal words are tokenised once a batch and the ids joined as bytes, since the
vocabulary drops white space and never merges over it. Only a row per piece goes on.

The packing itself works on the histogram of piece lengths, which has at most ``capacity`` entries however many
documents there are. For each bin the largest length left is fixed, then a bitset subset-sum over the lengths
left (Python integers as bitsets) finds the fullest combination that fits, and that pattern is removed from the
histogram as often as the counts allow. Pieces get a rank within their length, by salted counts, so one length that
a third of all pieces share is spread, whether the rows differ or repeat; a lookup in the bounded plan then gives each
its sequence and place.

Cases. Null or empty text: the end token alone. Null or repeated doc_id: each row is a document. Empty table: no
rows. A text over the capacity, however long, is cut into pieces, the last may be shorter; no piece is dropped. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read, saved
from .wordcodes import word_codes

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
#: The vocabulary's own splitting, for words of these characters only: lower-casing is all that its normaliser does to them.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-įıĲ-ȹȻ-ȽȿɁ-ɏ]+")
LETTERS = "a-zß-öø-ʯ"
PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")


class WordTokens:
    """Token ids of texts, for a vocabulary that marks where words end (``</w>``).

    Each distinct word of a batch is split once: plain words into the vocabulary's parts, any other word is one part.
    Parts, which many words share, are tokenised once and kept, about ``keep`` of them between batches; plain ones
    with the merges alone, the others by the whole tokenizer. Ids are put together by index, not word by word.
    """

    def __init__(self, path: str, keep: int = 500_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer = None
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True
        self.keep = keep
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, "<u4")

    def _alone(self, word: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, fresh: list[str], odd: list[str], block: int = 1024) -> None:
        """fresh: parts of plain words; odd: words with a leading NUL, for the whole tokenizer."""
        sizes, ids = [self.size], [self.flat]
        for k in range(0, len(fresh), block):
            some = fresh[k : k + block]
            got = np.array(self.merges.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[got]) + 1
            if len(cuts) != len(some):
                each = [self._alone(w) for w in some]
                got, cuts = np.concatenate(each), np.cumsum([len(x) for x in each])
            sizes.append(np.diff(cuts, prepend=0))
            ids.append(got)
        for word in odd:
            ids.append(self._alone(word[1:]))
            sizes.append(np.array([len(ids[-1])]))
        first = len(self.size)
        self.at.update(zip([*fresh, *odd], range(first, first + len(fresh) + len(odd))))
        self.size, self.flat = np.concatenate(sizes), np.concatenate(ids)

    @staticmethod
    def _spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
        """begin[i], begin[i] + 1, ... (n[i] of them) for each i."""
        ends = np.cumsum(n)
        return np.repeat(begin - (ends - n), n) + np.arange(int(n.sum()))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin (one more than texts)."""
        distinct, codes, first = word_codes(texts)
        if len(self.at) > self.keep:
            self.forget()
        plain = PLAIN.fullmatch
        flat: list[str] = []
        n_parts = np.ones(len(distinct), np.int64)
        for k, word in enumerate(distinct):
            if not plain(word) or "<|" in word:
                flat.append("\0" + word)
            elif (low := word.lower()).isalpha():
                flat.append(low)
            else:
                parts = PARTS.findall(low)
                n_parts[k] = len(parts)
                flat += parts
        fresh = set(flat).difference(self.at)
        odd = [w for w in fresh if w[0] == "\0"]
        self._learn(list(fresh.difference(odd)), odd)
        part = np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))
        # ids of the distinct words, then of the texts
        n = self.size[part]
        own = self.flat[self._spread((np.cumsum(self.size) - self.size)[part], n)]
        size = np.add.reduceat(n, np.cumsum(n_parts) - n_parts) if len(n) else np.zeros(0, np.int64)
        n = size[codes]
        ids = own[self._spread((np.cumsum(size) - size)[codes], n)]
        return ids, np.r_[0, np.cumsum(n)][first]


@functools.lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """One a Python worker, so that later tasks know the words of earlier ones."""
    return WordTokens(path)


def _pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()
    step = capacity * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                ids, first = tokens.encode(part.column("text"))
                rows = []
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                    raw = ids[a:b].tobytes() + end
                    rows += [(doc_id, k, x // 4, len(raw[x : x + step]) // 4, zlib.crc32(raw[x : x + step])) for k, x in enumerate(range(0, len(raw), step))]
                columns = zip(*rows) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES)], NAMES)

    return run


def tokenised_pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """A row per piece of every row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pieces(vocabulary, capacity, end_id), PIECES)


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, int]]:
    """(length, times) of a combination of the lengths left that fills room as far as any can. lengths: descending."""
    full, mask = 1 << room, (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        left = min(counts[length], room // length) if length <= room else 0
        times = 1
        while left > 0:
            take = min(times, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            if reach & full:
                left = 0
                break
            left -= take
            times *= 2
        if reach & full:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return list(used.items())


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns [(length, times), ...], each with the number of bins it fills; together they use up the histogram."""
    counts = {k: v for k, v in histogram.items() if v}
    lengths = sorted(counts, reverse=True)
    out = []
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        inside = fullest(counts, lengths, capacity - first) if first < capacity else []
        counts[first] += 1
        times: dict[int, int] = {first: 1}
        for length, n in inside:
            times[length] = times.get(length, 0) + n
        bins = min(counts[k] // n for k, n in times.items())
        for k, n in times.items():
            counts[k] -= n * bins
        lengths = [k for k in lengths if counts[k]]
        out.append((sorted(times.items(), reverse=True), bins))
    return out


def _lookup(plan: list[tuple[list[tuple[int, int]], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first ranks of its slots, and each slot's times, offset and first sequence."""
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first_bin = 0
    for pattern, bins in plan:
        offset = 0
        for length, n in pattern:
            slots.setdefault(length, []).append((used.get(length, 0), n, offset, first_bin))
            used[length] = used.get(length, 0) + n * bins
            offset += n * length
        first_bin += bins
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v)) for k, v in slots.items()}


def _place(plan):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = plan.value
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            seq, off = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for one in np.unique(length):
                at = np.flatnonzero(length == one)
                begin, times, offset, first = slots[int(one)]
                k = np.searchsorted(begin, rank[at], side="right") - 1
                d = rank[at] - begin[k]
                seq[at] = first[k] + d // times[k]
                off[at] = offset[k] + d % times[k] * one
            out = batch.drop(columns=["rank"])
            out["sequence_id"], out["offset"] = seq, off
            yield out

    return run


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, rank_group: int = 200) -> DataFrame:
    """PIECES, sequence_id and offset of every piece of docs (doc_id, text). rank_group: pieces ranked together, about."""
    spark = docs.sparkSession
    pieces = saved(tokenised_pieces(docs, vocabulary, capacity, end_id).withColumn("h", F.xxhash64(F.monotonically_increasing_id())), "pack-pieces")
    # at most capacity rows come to the driver, and go back as the number of groups of each length
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spark.sparkContext.broadcast(_lookup(plan_bins(histogram, capacity)))
    groups = spark.createDataFrame([(k, -(-n // rank_group)) for k, n in histogram.items()], "length long, groups long")
    salted = pieces.join(F.broadcast(groups), "length").withColumn("salt", F.pmod("h", "groups")).drop("groups")
    per = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = per.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = salted.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("h")))
    # ids pass as strings: as numbers, pandas would round them beside nulls
    ranked = ranked.join(before, ["length", "salt"]).select(F.col("doc_id").cast("string").alias("doc_id"), "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth") - 1).alias("rank"))
    placed = ranked.mapInPandas(_place(plan), PIECES.replace("doc_id long", "doc_id string") + ", sequence_id long, offset long")
    return placed.withColumn("doc_id", F.col("doc_id").cast("long"))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), default_vocabulary())
