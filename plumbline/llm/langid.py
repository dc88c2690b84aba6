"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word (ASCII letters in lower case) forwards and backwards and labels each of them
with probabilities of the languages. A document's probabilities are the mean over all its bytes. Its state starts
anew with each word, so equal words have equal labels and are read once: a worker keeps the sums of the words it has
met. Words over ``PIECE`` bytes are read in pieces.

It is trained in numpy by backpropagation through time with Adam, on at most ``per_lang`` documents of each language
and ``per_doc`` words of each, evenly spaced, ``total`` documents in all; only documents with a lang and outside the
held-out quarter are used. Everything else covers all rows.

Cases. Null text or no letter: ``und`` with score 0. No labelled document to learn from: all ``und``. Null doc_id:
held out (never learned from). Repeated rows: each is labelled. Very long texts are read whole. Empty table: no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, read, saved, words
from .wordcodes import word_codes

PIECE = 32
PAD = 256
HELD_OUT = 2


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def new_weights(langs: int, hidden: int, seed: int) -> dict[str, np.ndarray]:
    """For each direction the input table (a row a byte: update, reset, new gate), the recurrent matrix; the output layer."""
    r = np.random.default_rng(seed)
    w = {}
    for d in "fb":
        w[d + "x"] = r.normal(0, 0.3, (257, 3 * hidden)).astype(np.float32)
        w[d + "u"] = r.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
        w[d + "c"] = np.zeros(3 * hidden, np.float32)
    w["o"] = r.normal(0, 0.3, (2 * hidden, langs)).astype(np.float32)
    w["ob"] = np.zeros(langs, np.float32)
    return w


def run_gru(w: dict[str, np.ndarray], d: str, ids: np.ndarray, keep: bool = False):
    """States [time, batch, hidden] of one direction over ids [time, batch]; with keep what the way back needs."""
    table, u, c = w[d + "x"], w[d + "u"], w[d + "c"]
    k = u.shape[0]
    h = np.zeros((ids.shape[1], k), np.float32)
    out, saved = np.empty((*ids.shape, k), np.float32), []
    steps = range(len(ids)) if d == "f" else range(len(ids) - 1, -1, -1)
    for t in steps:
        x = table[ids[t]]
        a = h @ u + c
        gates = _sigmoid(x[:, : 2 * k] + a[:, : 2 * k])
        z, r = gates[:, :k], gates[:, k:]
        n = np.tanh(x[:, 2 * k :] + r * a[:, 2 * k :])
        if keep:
            saved.append((t, h, z, r, n, a[:, 2 * k :]))
        h = n + z * (h - n)
        out[t] = h
    return (out, saved) if keep else out


def _gru_back(w: dict[str, np.ndarray], d: str, ids: np.ndarray, saved: list, grad: np.ndarray, g: dict[str, np.ndarray]) -> None:
    """Adds the gradients of one direction to g, through time; grad: by the states."""
    u = w[d + "u"]
    k = u.shape[0]
    carry = np.zeros_like(grad[0])
    for t, h, z, r, n, an in reversed(saved):
        dh = grad[t] + carry
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * an * r * (1 - r)
        dx = np.concatenate([dz, dr, dn], axis=1)
        da = np.concatenate([dz, dr, dn * r], axis=1)
        np.add.at(g[d + "x"], ids[t], dx)
        g[d + "u"] += h.T @ da
        g[d + "c"] += da.sum(axis=0)
        carry = dh * z + da @ u.T


def probabilities(w: dict[str, np.ndarray], ids: np.ndarray) -> np.ndarray:
    """[time, batch, langs] of ids [time, batch]."""
    k = w["fu"].shape[0]
    z = run_gru(w, "f", ids) @ w["o"][:k] + run_gru(w, "b", ids) @ w["o"][k:] + w["ob"]
    z -= z.max(axis=2, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=2, keepdims=True)
    return z


def loss_and_gradients(w: dict[str, np.ndarray], ids: np.ndarray, real: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over the real bytes, each labelled with its word's language y."""
    k = w["fu"].shape[0]
    hf, sf = run_gru(w, "f", ids, True)
    hb, sb = run_gru(w, "b", ids, True)
    z = hf @ w["o"][:k] + hb @ w["o"][k:] + w["ob"]
    z -= z.max(axis=2, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=2, keepdims=True)
    n = max(1, int(real.sum()))
    at = np.take_along_axis(p, np.broadcast_to(y[None, :, None], (*ids.shape, 1)), axis=2)[:, :, 0]
    loss = float(-(np.log(at + 1e-12) * real).sum() / n)
    dz = p.copy()
    dz[:, np.arange(len(y)), y] -= 1
    dz *= (real / n)[:, :, None]
    g = {name: np.zeros_like(v) for name, v in w.items()}
    h = np.concatenate([hf, hb], axis=2)
    g["o"] = np.tensordot(h, dz, axes=([0, 1], [0, 1])).astype(w["o"].dtype)
    g["ob"] = dz.sum(axis=(0, 1))
    dh = dz @ w["o"].T
    _gru_back(w, "f", ids, sf, dh[:, :, :k], g)
    _gru_back(w, "b", ids, sb, dh[:, :, k:], g)
    return loss, g


def as_ids(some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words [time, batch], padded, and which of them are real."""
    width = max(map(len, some))
    flat = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in some), np.uint8).reshape(len(some), width)
    real = np.arange(width)[None, :] < np.array([len(s) for s in some])[:, None]
    return np.where(real, flat, PAD).T.astype(np.int64), real.T.astype(np.float32)


def train(samples: list[tuple[bytes, int]], langs: int, hidden: int = 16, steps: int = 600, batch: int = 384, rate: float = 0.02, seed: int = 5) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    w = new_weights(langs, hidden, seed)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    by_lang = [[s for s, y in samples if y == k] for k in range(langs)]
    live = [k for k in range(langs) if by_lang[k]]
    for t in range(1, steps + 1):
        y = r.choice(live, batch)  # languages alike, however many words each has
        some = [by_lang[k][r.integers(len(by_lang[k]))] for k in y]
        ids, real = as_ids(some)
        _, g = loss_and_gradients(w, ids, real, np.asarray(y))
        now = rate * min(1.0, t / 20) * 0.5 * (1 + np.cos(np.pi * t / steps))
        for k in w:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            w[k] = (w[k] - now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return w


class Labels:
    """Sums of a word's byte probabilities, for all words met so far (about ``keep`` at most)."""

    def __init__(self, w: dict[str, np.ndarray], keep: int = 500_000):
        self.w, self.keep, self.langs = w, keep, len(w["ob"])
        self.at: dict[str, int] = {}
        self.sums = np.zeros((0, self.langs), np.float32)

    def learn(self, fresh: list[str], batch: int = 2048) -> None:
        pieces, owner = [], []
        for k, word in enumerate(w.encode("utf-8", "replace") for w in fresh):
            for p in range(0, len(word), PIECE):
                pieces.append(word[p : p + PIECE])
                owner.append(k)
        sums = np.zeros((len(fresh), self.langs), np.float32)
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        owner = np.array(owner)
        for p in range(0, len(order), batch):
            some = order[p : p + batch]
            ids, real = as_ids([pieces[i] for i in some])
            np.add.at(sums, owner[some], (probabilities(self.w, ids) * real[:, :, None]).sum(axis=0))
        first = len(self.sums)
        self.at.update((word, first + k) for k, word in enumerate(fresh))
        self.sums = np.concatenate([self.sums, sums])

    def documents(self, texts: pa.Array) -> np.ndarray:
        """Mean probabilities [text, langs]; zeros for a text without a byte."""
        words, codes, first = word_codes(texts, lower=True)
        if len(self.at) > self.keep:
            self.at, self.sums = {}, self.sums[:0]
        self.learn([w for w in words if w not in self.at])
        own = self.sums[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))].astype(np.float64)
        out = np.zeros((len(texts), self.langs))
        real = first[1:] > first[:-1]
        if real.any():
            total = np.add.reduceat(own[codes], first[:-1][real], axis=0)
            out[real] = total / total.sum(axis=1, keepdims=True)
        return out


_LABELS: dict[bytes, Labels] = {}


def _labels(w: dict[str, np.ndarray]) -> Labels:
    """One a Python worker and network."""
    key = b"".join(w[k].tobytes() for k in sorted(w))
    if key not in _LABELS:
        _LABELS.clear()
        _LABELS[key] = Labels(w)
    return _LABELS[key]


def _predict(w: dict[str, np.ndarray] | None, langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = _labels(w) if w is not None else None
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = part.column("text")
                some = np.array([t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()], bool)
                pred, score = np.full(len(some), "und", object), np.zeros(len(some))
                if labels is not None and some.any():
                    p = labels.documents(texts.filter(pa.array(some)))
                    pred[some] = [langs[k] for k in p.argmax(axis=1)]
                    score[some] = np.clip(np.round(p.max(axis=1), 6), 0, 1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT, F.lit(True))


def training_words(docs: DataFrame, per_lang: int, per_doc: int, total: int) -> list[tuple[bytes, str]]:
    """(word, lang) of a bounded sample: documents by the order of a hash of their id, up to per_lang a language, total in all."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).withColumn("_h", F.shiftrightunsigned(F.xxhash64(F.lit(3), "doc_id"), 11) * F.lit(2.0**-53))
    # written first: its size is known then, and small it is broadcast, so that no text is dealt out by lang
    n = saved(known.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")), "langid-counts")
    langs = n.count()
    if langs > total:  # the languages with most documents
        n = n.orderBy(F.desc("_n"), "lang").limit(total)
    per_lang = max(1, min(per_lang, total // max(1, langs)))
    # a rate, so that few texts are sorted: twice as many as wanted on average
    some = known.join(n, "lang").where(F.col("_h") * F.col("_n") < 2 * per_lang + 50)
    ranked = some.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id", F.length("text"), "text"))).where(F.col("_r") <= per_lang)
    spaced = let(words(F.col("text")), lambda w: F.when(F.size(w) <= per_doc, w).otherwise(F.transform(F.sequence(F.lit(0), F.lit(per_doc - 1)), lambda i: F.get(w, F.floor(i * F.size(w) / per_doc).cast("int")))))
    rows = ranked.select("lang", F.col("_r").alias("r"), spaced.alias("w")).collect()
    out = []
    for row in sorted(rows, key=lambda x: (x["lang"], x["r"])):
        for word in row["w"]:
            raw = word.encode("utf-8", "replace").lower()
            out += [(raw[p : p + PIECE], row["lang"]) for p in range(0, len(raw), PIECE)]
    return out


def identify(docs: DataFrame, per_lang: int = 300, per_doc: int = 150, total: int = 30_000, hidden: int = 16, steps: int = 600) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs (doc_id, text, lang)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sample = training_words(docs, per_lang, per_doc, total)
    langs = sorted({y for _, y in sample})
    w = train([(s, langs.index(y)) for s, y in sample], len(langs), hidden, steps) if langs else None
    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(_predict(w, langs), "doc_id long, held_out boolean, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
