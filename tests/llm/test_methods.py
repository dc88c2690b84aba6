"""Each method against brute force, an exact round trip or held-out accuracy."""

import bisect
import random
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from plumbline.llm import langid, mixing, packing, simhash, substring, topk, warc
from plumbline.llm.common import count_words
from plumbline.llm.components import components
from pyspark.sql import functions as F

from .. import oracle

SF = "/root/testdata/sf0.001"


# --- mixing ---
def waterfill(sizes, weights=(5, 2, 1), cap=3):
    """Targets by sharing out the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        rate = left / sum(w[s] for s in open_)
        over = {s for s in open_ if rate * w[s] > cap * sizes[s]}
        if not over:
            target |= {s: rate * w[s] for s in open_}
            break
        target |= {s: float(cap * sizes[s]) for s in over}
        open_ -= over
    return target


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, "w " * min(5000, int(rnd.paretovariate(1.1) * 20)), rnd.choice(["hot"] * 6 + ["b", "c", "d", None, "é"])) for i in range(3000)] + [(9999, "w " * 3, "tiny"), (10000, None, "void")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, leaf=32, fan_in=4).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
    want, taken = waterfill(sizes), defaultdict(int)
    for r in got:
        share = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert int(share) <= r.copies <= min(3, int(share) + 1) or r.copies == pytest.approx(share)
        taken[r.source] += r.copies * r.size
    for s, n in taken.items():
        # off by one document at most, and that one of the smaller ones
        assert abs(n - want[s]) <= max(0.002 * want[s], sorted(r.size for r in got if r.source == s)[sum(r.source == s for r in got) // 2]), s
    assert sorted(map(tuple, mixing.mix(docs, leaf=32, fan_in=4).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert mixing.mixed_documents(docs, leaf=32, fan_in=4).count() == sum(r.copies for r in got)


def test_inclusion_is_fair(spark):
    """Over many seeds a document is taken as often as its probability says."""
    rows = [(i, "w " * (1 + i % 7), "a" if i % 2 else "b") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    n = sum(np.array([r.copies for r in sorted(mixing.mix(docs, seed=s).collect(), key=lambda r: r.doc_id)]) for s in range(12))
    share = {r.source: r.target / r.source_size for r in mixing.mix(docs).collect()}
    for s, odd in (("a", 1), ("b", 0)):
        assert np.mean(n[odd::2]) / 12 == pytest.approx(share[s], abs=0.06)
        assert len(set(n[odd::2])) > 1


# --- near duplicates ---
def brute_components(prints, bound=2):
    values = sorted({f for _, f in prints})
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= bound:
                root[find(a)] = find(b)
    least = {}
    for d, f in prints:
        least[find(f)] = min(d, least.get(find(f), d))
    return {d: least[find(f)] for d, f in prints}


@pytest.mark.parametrize("dense", [8, 128])
def test_near_classes(spark, dense):
    rnd = random.Random(dense)
    prints, d = [], 0
    for _ in range(40):
        f = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 2, 5, 40])):
            prints.append((d, f))
            d += 1
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                f ^= 1 << rnd.randrange(64)
    prints += [(d + i, 0) for i in range(3)]
    signed = [(i, f - 2**64 if f >= 2**63 else f) for i, f in prints]
    got = {r.doc_id: r.component_id for r in simhash.near_classes(spark.createDataFrame(signed, "doc_id long, fp long"), dense=dense).collect()}
    assert got == brute_components(prints)


def test_chain_filter_keeps_each_close_pair_somewhere():
    rnd = np.random.default_rng(4)
    a = rnd.integers(0, 2**63, 500, dtype=np.uint64)
    for bound in (1, 2, 3):
        flips = np.zeros(500, np.uint64)
        for _ in range(bound):
            flips ^= np.uint64(1) << rnd.integers(0, 64, 500, dtype=np.uint64)
        kept = np.zeros(500, bool)
        for i in range(5):
            kept |= simhash.passes_chains(a ^ (a ^ flips), np.full(500, i), 5, bound)
        assert kept.all()


def test_fingerprint():
    import xxhash

    text = "The Quick brown fox the quick BROWN fox jumps É"
    ws = text.encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + 3]), 42) for i in range(len(ws) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("One two") == xxhash.xxh64_intdigest(b"one two", 42)


def test_spark_hash_is_the_same(spark):
    import xxhash

    got = spark.sql("SELECT xxhash64('ab é') AS h").first().h % 2**64
    assert got == xxhash.xxh64_intdigest("ab é".encode(), 42)


def test_components(spark):
    rnd = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100 + rnd.randrange(50)) for i in range(60)] + [(500, 501), (501, 500), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


# --- exact top k ---
@pytest.mark.parametrize("n, k, clusters", [(1500, 10, 12), (40, 10, 2), (5, 10, 1), (800, 3, 0)])
def test_best_of(n, k, clusters):
    r = np.random.default_rng(n)
    x = r.normal(size=(n, 8))
    if clusters:
        x = r.normal(size=(clusters, 8))[r.integers(0, clusters, n)] * 3 + x * 0.2
    x[: n // 10] = x[0]  # ties
    ids = r.permutation(n * 2)[:n]
    frame = pd.DataFrame({"vec_id": ids, "v": list(x)})
    queries = frame[frame.vec_id % 5 == 0]
    got = topk.best_of(queries, frame, k).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    whole = np.floor(1024 * x).astype(np.int64)
    for q, part in got.groupby("query_id"):
        score = whole @ whole[list(ids).index(q)]
        want = sorted((-s, i) for s, i in zip(score, ids) if i != q)[:k]
        assert list(zip(-part.score, part.vec_id)) == want
    assert got.query_id.nunique() == (len(queries) if n > 1 else 0)


def test_clusters_are_pruned():
    r = np.random.default_rng(3)
    x = np.floor(1024 * (r.normal(size=(40, 16))[np.repeat(np.arange(40), 100)] * 4 + r.normal(size=(4000, 16)) * 0.05))
    s = topk.Search(x[:64], np.arange(64), x, np.arange(4000), 10)
    tree = topk.cover_tree(x, np.arange(4000))

    def covers(node):
        assert np.sqrt(((x[node.rows] - node.centre) ** 2).sum(axis=1)).max() <= node.radius + 1e-6
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
        for c in node.children:
            covers(c)

    covers(tree)
    s.walk(topk.cover_tree(x[:64], np.arange(64)), tree)
    assert s.pruned > s.pairs / 3


def test_large_components_stay_exact():
    frame = pd.DataFrame({"vec_id": [0, 5, 7], "v": [[1e9, 1.0], [1e9, 2.0], [-1e9, 3.0]]})
    got = topk.best_of(frame[frame.vec_id == 0], frame, 10)
    big = int(1024e9)
    assert got[["query_id", "vec_id", "score"]].values.tolist() == [[0, 5, big * big + 1024 * 2048], [0, 7, -big * big + 1024 * 3072]]


def test_blocks_meet(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    key = lambda rows: sorted(map(tuple, rows))
    assert key(topk.top_k(df, query_block=2, candidate_block=60, cell_rows=40, sample=100).collect()) == key(topk.top_k(df).collect())


def test_queries_of_one_id_rank_apart(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [3.0, 0.0]), (2, [0.0, 2.0])]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=2).collect()))
    big = 1024 * 1024
    assert got == [(100, 1, 1, 3 * big), (100, 1, 2, 2 * big), (100, 2, 1, 0), (100, 2, 2, 0)]


def test_clustered_blocks_are_left_out_before_the_shuffle(spark, monkeypatch):
    """Few block pairs are sent where vectors cluster, a third of all rows being one vector; and nothing is lost."""
    r = np.random.default_rng(8)
    x = (r.normal(size=(30, 12))[r.integers(0, 30, 6000)] * 4 + r.normal(size=(6000, 12)) * 0.1).astype(np.float32)
    x[:2000] = x[0]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    sent, keep = [], topk.saved

    def watched(frame, name):
        out = keep(frame, name)
        if name == "topk-asked":
            sent.append(out.count())
        if name in ("topk-start", "topk-others"):
            sent.append((name, out.count()))
        return out

    monkeypatch.setattr(topk, "saved", watched)
    got = topk.top_k(df, every=100, candidate_block=100, cell_rows=150, sample=1000).collect()
    pairs = sum(n for _, n in (s for s in sent if isinstance(s, tuple)))
    assert pairs < 60 * 80 / 5  # 60 queries, 60 blocks and more
    whole = np.floor(1024 * x.astype(float)).astype(np.int64)
    for q in range(0, 6000, 100):
        score = whole @ whole[q]
        want = sorted((-int(s), i) for i, s in enumerate(score) if i != q)[:10]
        assert [(-g.score, g.vec_id) for g in sorted(got, key=lambda g: g.rank) if g.query_id == q] == want


# --- language ---
def test_gradients():
    w = {k: v.astype(np.float64) for k, v in langid.new_weights(3, 4, 1).items()}
    ids, real = langid.as_ids([b"abc", b"de", b"fghij"])
    y = np.array([0, 2, 1])
    _, g = langid.loss_and_gradients(w, ids, real.astype(np.float64), y)
    r = np.random.default_rng(0)
    for name in w:
        for _ in range(4):
            at = tuple(r.integers(0, s) for s in w[name].shape)
            if name in ("fx", "bx"):
                at = (int(ids[r.integers(0, 2), 0]), at[1])
            up = {k: v.copy() for k, v in w.items()}
            down = {k: v.copy() for k, v in w.items()}
            up[name][at] += 1e-2
            down[name][at] -= 1e-2
            slope = (langid.loss_and_gradients(up, ids, real, y)[0] - langid.loss_and_gradients(down, ids, real, y)[0]) / 2e-2
            assert g[name][at] == pytest.approx(slope, abs=2e-3), name


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert len(got) > 150 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_lang_of_others_is_not_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("?"))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(langid.identify(docs, steps=60)) == key(langid.identify(other, steps=60))


# --- substrings ---
def brute_removed(docs, w):
    seen = defaultdict(int)
    for x in docs:
        for i in range(len(x) - w + 1):
            seen[tuple(x[i : i + w])] += 1
    out = []
    for x in docs:
        gone = [False] * len(x)
        for i in range(len(x) - w + 1):
            if seen[tuple(x[i : i + w])] > 1:
                gone[i : i + w] = [True] * w
        out.append([t for t, g in zip(x, gone) if not g])
    return out


@pytest.mark.parametrize("window, words", [(35, 1000), (35, 2), (35, 1), (12, 20), (3, 3)])
def test_without_repeats(spark, window, words):
    rnd = random.Random(window + words)
    docs = [[str(rnd.randrange(words)) for _ in range(rnd.randrange(160))] for _ in range(60)]
    for _ in range(40):
        a, b = rnd.choice(docs), rnd.choice(docs)
        i, j = rnd.randrange(len(a) + 1), rnd.randrange(len(b) + 1)
        b[j:j] = a[i : i + rnd.randrange(window - 2, window + 30)]
    docs.append(list(docs[0]))
    df = spark.createDataFrame([(i, "  ".join(x) + "\n") for i, x in enumerate(docs)], "doc_id long, text string").repartition(5)
    import hashlib

    want = brute_removed(docs, window)
    for r in substring.without_repeats(df, window).collect():
        kept = " ".join(want[r.doc_id])
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(docs[r.doc_id]), len(docs[r.doc_id]) - len(want[r.doc_id]), hashlib.sha256(kept.encode()).hexdigest())
        assert r.kept in (None, kept)


def test_symbols_are_consistent():
    """The symbols over the inner words of a window don't depend on what surrounds it."""
    rnd = np.random.default_rng(5)
    inner = rnd.integers(0, 2**63, 35, dtype=np.uint64)
    inner[10:13] = inner[10]
    found = set()
    for _ in range(200):
        before, after = (rnd.choice(np.r_[inner[:2], inner[-2:], rnd.integers(0, 2**63, 3, dtype=np.uint64)], rnd.integers(0, 30)) for _ in range(2))
        x = np.r_[before, inner, after]
        start, length, name = substring.parse(x, np.zeros(len(x), int), 35)
        a, b = len(before) + 8, len(before) + 27
        found.add(tuple((int(s) - len(before), int(n), int(v)) for s, n, v in zip(start, length, name) if s < b and s + n > a))
    assert len(found) == 1


# --- packing ---
def test_tokens_equal_the_tokenizer():
    rnd = random.Random(1)
    odd = ["".join(chr(rnd.choice([rnd.randrange(1, 128), rnd.randrange(128, 0x250), rnd.randrange(0x250, 0x3000), 0x1F600, 39, 115, 60, 124, 32])) for _ in range(rnd.randrange(60))) for _ in range(2000)]
    odd += ["it's we'll I'D 'S’s <|endoftext|>x a<|startoftext|>", "İstanbul ΣΑΣ ß ǅ ŉ Ⱥ Ⱦ", "", None, "a" * 5000]
    odd = [t if t is None else t.encode("utf-8", "ignore").decode() for t in odd]
    tokens = packing.WordTokens(packing.default_vocabulary())
    ids, first = tokens.encode(pa.array(odd))
    for i, t in enumerate(odd):
        assert ids[first[i] : first[i + 1]].tolist() == tokens.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_pack(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs, packing.default_vocabulary()).toPandas()
    tokens = packing.WordTokens(packing.default_vocabulary())
    texts = {r.doc_id: r.text for r in docs.collect()}
    for d, part in rows.sort_values("piece").groupby("doc_id"):
        ids = np.array([*tokens.tokenizer.encode(texts[d], add_special_tokens=False).ids, 1], "<u4")
        assert part.piece.tolist() == list(range(len(part))) and part.length.sum() == len(ids)
        assert all(n == 4096 for n in part.length[:-1])
        for r in part.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for _, part in rows.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *part.length.cumsum()[:-1]] and part.length.sum() <= 4096
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 4096) + 1


@pytest.mark.parametrize("seed", range(4))
def test_fullest(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        room = rnd.randrange(1, 60)
        counts = {n: rnd.randrange(1, 4) for n in rnd.sample(range(1, 40), rnd.randrange(1, 8))}
        got = packing.fullest(counts, sorted(counts, reverse=True), room)
        reach = {0}
        for n, c in counts.items():
            reach = {r + n * k for r in reach for k in range(c + 1) if r + n * k <= room}
        assert sum(n * k for n, k in got) == max(reach) and all(k <= counts[n] for n, k in got)


def best_fit_decreasing(h, capacity):
    free = []  # what is left in each bin
    for n in sorted(h, reverse=True):
        for _ in range(h[n]):
            i = bisect.bisect_left(free, n)
            bisect.insort(free, (free.pop(i) if i < len(free) else capacity) - n)
    return len(free)


def test_plan_uses_all():
    rnd = random.Random(2)
    h = {rnd.randrange(1, 4097): rnd.randrange(1, 50) for _ in range(300)} | {4096: 5, 1: 1000}
    used = defaultdict(int)
    plan = packing.plan_bins(h, 4096)
    for pattern, bins in plan:
        assert sum(n * k for n, k in pattern) <= 4096
        for n, k in pattern:
            used[n] += k * bins
    assert used == h
    assert sum(b for _, b in plan) <= best_fit_decreasing(h, 4096) * 1.005


# --- archives ---
def records(n=40):
    rnd = random.Random(1)
    return [warc.record(i, f"http://x/{i}\n é", bytes(rnd.randrange(97, 123) for _ in range(rnd.randrange(900))), i - 1 if i % 3 == 0 else None) for i in range(n)]


def read_back(data):
    rows = list(warc.salvage(data))
    return [r["page_id"] for r in rows if "reason" not in r], [r for r in rows if "reason" in r]


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage(zipped):
    parts = [warc.member(r) if zipped else r for r in records()]
    assert read_back(b"".join(parts)) == (list(range(40)), [])
    data = bytearray(b"".join(parts))
    at = sum(map(len, parts[:10])) + len(parts[10]) // 2
    data[at] ^= 0xFF
    got, gaps = read_back(bytes(data))
    assert set(range(40)) - set(got) <= {10} and len(gaps) <= 1
    data = b"".join(parts[:5]) + b"junk\x1f\x8b\x08zz WARC/1.1\r\n" * 3 + b"".join(parts[5:20]) + parts[20][:30] + b"".join(parts[21:])
    got, gaps = read_back(data)
    assert got == [i for i in range(40) if i != 20] and len(gaps) == 2
    assert sum(g["length"] for g in gaps) == len(b"junk\x1f\x8b\x08zz WARC/1.1\r\n" * 3) + 30


def test_damaged_stream_gives_what_comes_before():
    d = zlib.compressobj(6, wbits=31)
    z = d.compress(b"".join(records())) + d.flush()
    assert read_back(z)[0] == list(range(40))
    m = len(z) * 3 // 4
    got, gaps = read_back(z[:m] + bytes(x ^ 255 for x in z[m : m + 6]) + z[m + 6 :])
    assert got == list(range(len(got))) and len(got) > 10 and len(gaps) == 1


def test_members_end_with_nul():
    for size in (0, 10, 2**24 - 1, 2**24, 2**24 + 5):
        m = warc.member(b"a" * size)
        assert m[-1] == 0
        d = zlib.decompressobj(31)
        assert len(d.decompress(m)) == size


def test_archives(spark, tmp_path):
    pages = [(1, "u", "<p>é</p>"), (2, "u", "<p>é</p>"), (3, None, ""), (9, "u", None), (4, "u", "x" * 100)]
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), f"file://{tmp_path}/w", min_bytes=1, records_per_file=2)
    assert list(tmp_path.glob("w/*.warc.gz")) and not list(tmp_path.glob("w/*.txt"))
    rows = {r.page_id: r for r in warc.read_archives(spark, f"file://{tmp_path}/w", payloads=True).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in rows.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 9: ("response", None), 4: ("response", None)}
    assert bytes(rows[2].payload).decode() == "<p>é</p>" and rows[1].payload is None and rows[1].payload_bytes == 9
    warc.write_archives(spark.createDataFrame([(i, "u", f"{i} " * 2000) for i in range(50)], "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/b", archive_bytes=3000)
    sizes = [f.stat().st_size for f in tmp_path.glob("b/*.warc.gz")]
    assert max(sizes) <= 3000 and len(sizes) > 1 and warc.read_archives(spark, f"file://{tmp_path}/b").where("reason is null").count() == 50
    big = 2**53 + 3
    warc.write_archives(spark.createDataFrame([(big - 2, "u", "x"), (big, "u", "x"), (1, "u", "y")], "page_id long, url string, html string"), f"file://{tmp_path}/i")
    assert {(r.page_id, r.refers_to) for r in warc.read_archives(spark, f"file://{tmp_path}/i").collect()} == {(big - 2, big), (big, None), (1, None)}
    import gzip

    for f in tmp_path.glob("w/*.warc.gz"):
        assert gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n")


@pytest.mark.parametrize("name", ["op1_warc_salvage", "op6_dual_tree_topk", "op8_substring_dedup", "op9_quality_rules"])
def test_sql(spark, name):
    from plumbline.llm import registry

    oracle.same(registry.QUERIES[name](spark, SF), oracle.connect(SF), registry.ORACLES[name])


# --- pipeline ---
def test_pipeline(spark, tmp_path):
    """Each stage against its operator's rows or a plain version, on what the stage before it kept."""
    import corpus_pipeline
    from plumbline.llm import pii, quality

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")

    def run(name, frame):
        stages[name](spark, frame, SF).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    kept = run("quality_rules", docs)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    once = run("simhash_near_dedup", kept)
    assert {r.doc_id for r in once.collect()} == brute_near(kept)
    clean = run("pii", once)
    before, model = {r.doc_id: r.text for r in once.collect()}, pii.fitted(spark)
    spans = {r.doc_id: r.spans for r in pii.scan(once, model).collect()}
    for r in clean.collect():
        text, want, at = before[r.doc_id], "", 0
        for a, b, k in sorted((s.start, s.end, s.kind) for s in [*spans[r.doc_id].base, *spans[r.doc_id].added]):
            if a >= at:
                want += text[at:a] + f"[{pii.KINDS[k].upper()}]"
            at = max(at, b)
        assert r.text == want + text[at:] and r.n_chars == len(r.text)
    mixed = run("mix_sources", clean)
    copies = {r.doc_id: r.copies for r in mixing.mix(clean).collect() if r.copies}
    n = defaultdict(int)
    for r in mixed.collect():
        n[r.doc_id] += 1
    assert n == copies and mixed.dtypes == docs.dtypes
    packed = run("best_fit_packing", mixed)
    assert packed.where("piece = 0").count() == mixed.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_word_count(spark):
    some = ["a  b\tc", None, "", " ", " x", "a\x1cb c"]
    df = spark.createDataFrame(list(enumerate(some)), "i int, t string").select("i", count_words(F.col("t")).alias("n"))
    assert {r.i: r.n for r in df.collect()} == {i: len((t or "").encode().split()) for i, t in enumerate(some)}


def _jaccard(a, b, n=5):
    a, b = ({tuple(ws[i : i + n]) for i in range(max(len(ws) - n + 1, 1))} for ws in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_near_dedup_stage_finds_planted_copies(spark):
    import corpus_pipeline

    rnd, docs, want = random.Random(5), [], set()
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    for g in range(60):
        ws = [word() for _ in range(rnd.choice([100, 200, 400]))]
        first = " ".join(ws)
        want.add(len(docs))
        docs.append((len(docs), first))
        for changed in (1, 2):
            copy = list(ws)
            for k in range(changed * len(ws) // 100):
                copy[(k * 100 + 50) % len(ws)] = word()
            near = " ".join(copy)
            if _jaccard(first, near) < 0.8:
                want.add(len(docs))
            docs.append((len(docs), near))
        other = " ".join(ws[: len(ws) // 2] + [word() for _ in range(len(ws) // 2)])
        assert _jaccard(first, other) < 0.8
        want.add(len(docs))
        docs.append((len(docs), other))
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    got = {r.doc_id for r in stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), SF).collect()}
    assert len(want) < 3 * 60 and got == want


def test_forest_links_what_pairs_connect():
    from plumbline.llm import minhash

    rnd = np.random.default_rng(6)
    base = np.arange(100, dtype=np.uint64)
    sets = [np.unique(np.r_[rnd.permutation(base)[: rnd.integers(85, 101)], rnd.integers(1000, 2000, 3).astype(np.uint64)]) for _ in range(40)] + [np.arange(500, 600, dtype=np.uint64)]
    assert minhash.forest([np.arange(8, dtype=np.uint64), np.arange(10, dtype=np.uint64)]) == [(0, 1)]  # 0.8 itself
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if both * 5 >= 4 * (len(a) + len(sets[j]) - both):
                root = [root[j] if r == root[i] else r for r in root]
    mine = list(range(len(sets)))
    for i, j in minhash.forest(sets):
        assert mine[i] != mine[j]
        mine = [mine[i] if r == mine[j] else r for r in mine]
    assert len({*zip(root, mine)}) == len(set(root)) == len(set(mine)) > 1


def brute_near(docs):
    """The least doc_id of each component of pairs with 5-word Jaccard of 0.8 or more."""
    sets = [(r.doc_id, {tuple(ws[i : i + 5]) for i in range(max(len(ws) - 4, 1))}) for r in docs.collect() for ws in [r.text.encode().lower().split()]]
    root = {d: d for d, _ in sets}
    assert len(root) == len(sets)
    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((root[d], root[e]))
                root = {k: low if v == high else v for k, v in root.items()}
    return set(root.values())


def test_near_dedup_stage_equals_all_pairs(spark):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    rows = stages["quality_rules"](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).select("doc_id", "text")
    kept = spark.createDataFrame([tuple(r) for r in rows.collect()], rows.schema)
    assert {r.doc_id for r in stages["simhash_near_dedup"](spark, kept, SF).collect()} == brute_near(kept)


def test_long_headers_and_urls_like_version_lines_are_read():
    urls = ["http://a/warc-specifications/WARC/1.1", "http://a/" + "é" * 400_000, "http://a/b"]
    data = [warc.record(i, u, b"x" * 10) for i, u in enumerate(urls)]
    for packed in (data, [warc.member(d) for d in data]):
        got = list(warc.salvage(b"".join(packed)))
        assert [(x.get("page_id"), x.get("uri"), x.get("reason")) for x in got] == [(i, u, None) for i, u in enumerate(urls)]
    cut = data[2][: data[2].index(b"/b") + 2]
    assert [(x.get("page_id"), x.get("reason")) for x in warc.salvage(cut + data[0])] == [(None, "headers cut off"), (0, None)]


def test_parts_follow_the_sources_not_the_plan(spark):
    from plumbline.llm.common import input_bytes, parts_for

    some = spark.createDataFrame([(i, "x") for i in range(3)], "doc_id long, text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert parts_for(some) == parts_for(some.join(docs, "doc_id")) == parts_for(docs.join(docs.select("doc_id"), "doc_id")) == 4
    assert 0 < input_bytes(docs) and parts_for(docs, input_bytes(docs) // 10) >= 10


@pytest.fixture(scope="module")
def same_rows(spark):
    """60,000 equal rows, half of them without an id, beside others."""
    one = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).cast("long").alias("doc_id"), F.lit("the same few words here").alias("text"), F.lit("hot").alias("source"))
    other = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(id % 50 as int))").alias("text"), F.expr("concat('s', id % 3)").alias("source"))
    return one.unionByName(other).repartition(6)


def test_mix_spreads_equal_rows(spark, same_rows):
    units = same_rows.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "source", count_words(F.col("text")).alias("size"))
    salted = mixing._salted(units)
    assert salted.where("source = 'hot'").agg(F.count_distinct("salt")).first()[0] == 60_000
    assert salted.where("source <> 'hot' and salt is not null").count() == 0
    leaves = salted.where("source = 'hot'").groupBy(F.pmod(F.xxhash64(F.lit(7), "doc_id", "size", "salt"), F.lit(469))).count()
    assert leaves.agg(F.max("count")).first()[0] < 400
    got = mixing.mix(same_rows).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("n"), F.first("target").alias("t"), F.count("*").alias("rows"))
    assert sum(r.rows for r in got.collect()) == 63_000
    assert all(abs(r.n - r.t) <= max(0.002 * r.t, 50) for r in got.collect())


def test_packing_spreads_equal_rows(spark, same_rows):
    rows = packing.pack(same_rows, packing.default_vocabulary()).select("length", "sequence_id", "offset")
    used = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count_distinct("offset").alias("places"), F.count("*").alias("k"))
    assert rows.count() == 63_000 and used.where("n > 4096 or n <> end or places <> k").count() == 0


def test_substrings_of_equal_rows(spark):
    """A third of all rows are one text; each loses all its words, and their anchors are gathered once."""
    hot = " ".join(f"h{i % 90}" for i in range(200))
    rnd = random.Random(4)
    docs = [hot] * 3000 + [" ".join(str(rnd.randrange(10**9)) for _ in range(40)) for _ in range(500)] + ["lone " * 20 + hot + " end" * 3]
    df = spark.createDataFrame([(None if i % 2 else 5, t) for i, t in enumerate(docs)], "doc_id long, text string").repartition(6)
    got = substring.without_repeats(df).groupBy("n_words", "n_removed").count().collect()
    assert {(r.n_words, r.n_removed): r["count"] for r in got} == {(200, 200): 3000, (40, 0): 500, (223, 200): 1}


def test_hits_far_into_a_text():
    far = 2**23 + 7
    gone = substring.covered(far + 100, np.array([far]), np.array([0b101]), 35)
    assert np.flatnonzero(gone).tolist() == list(range(far, far + 37))
    rows = list(substring._masks(iter([pd.DataFrame({"k": [9, 9], "row": [1, 2], "at": [far * 64 + 3, 3], "hashes": [np.array([5, 6], np.uint64).tobytes(), np.array([5, 7], np.uint64).tobytes()]})])))
    assert pd.concat(rows).sort_values("row").values.tolist() == [[1, far, 1], [2, 0, 1]]


def test_large_ids_beside_nulls(spark):
    big = 2**53 + 3
    df = spark.createDataFrame([(big, "a b c"), (None, "d e f")], "doc_id long, text string").coalesce(1)
    for frame in (simhash.fingerprints(df), substring.without_repeats(df), packing.pack(df, packing.default_vocabulary())):
        assert {r.doc_id for r in frame.collect()} == {big, None}


def test_sketches_leave_out_what_is_apart():
    from plumbline.llm import minhash

    rnd, lost, kept = np.random.default_rng(3), 0, 0
    for _ in range(400):
        base = rnd.integers(0, 2**63, 900, dtype=np.uint64)
        a, near, far = base[:500], base[50:550], base[250:750]  # similarities 0.82 and 0.33
        s = [minhash.sketch_of(minhash.least_hashes(x)) for x in (a, near, far)]
        lost += minhash.differing(s[0], s[1]) > minhash.APART
        kept += minhash.differing(s[0], s[2]) <= minhash.APART
    assert lost == 0 and kept < 40
    key = np.repeat(np.arange(3), [70, 5, 1])
    sketch = np.stack([minhash.sketch_of(minhash.least_hashes(np.arange(k % 2 * 1000, k % 2 * 1000 + 300 + k % 7, dtype=np.uint64))) for k in range(76)])
    assert minhash.near_sketches(key, sketch).tolist() == [*[0, 1] * 35, *[70, 71] * 2, 70, 75]


def test_large_groups_in_parts(spark):
    """Two hundred near copies of each other in chains, dealt into parts of 20: as many components as without parts."""
    from plumbline.llm import minhash

    rnd, docs = random.Random(9), []
    for g in range(3):
        ws = [f"{g}x{rnd.randrange(10**6)}" for _ in range(300)]
        for _ in range(70):
            ws = list(ws)
            for _ in range(4):
                ws[rnd.randrange(300)] = f"y{rnd.randrange(10**6)}"
            docs.append((len(docs), " ".join(ws)))
    df = spark.createDataFrame(docs, "_at long, text string")
    want = {(r._at, r._root) for r in minhash.near_labels(df).collect()}
    assert len({r for _, r in want}) == 3
    assert {(r._at, r._root) for r in minhash.near_labels(df, chunk=20).collect()} == want


@pytest.mark.parametrize("once", [True, False])
def test_lines_of_copies(spark, once):
    """A line of 30 copies of one text and one of 30 different texts; only the latter is frequent if copies count once."""
    from plumbline.llm import quality

    word = " ".join(f"w{k}" for k in range(60))
    rows = [(i, f"the same line here\n{word}", "h") for i in range(30)] + [(100 + i, f"shared words of a footer\nown text {i} x{i} {word} {'abcdefghijklmnopqrstuvwxyz0123456789'[i]}", "h") for i in range(30)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), copies_once=once).collect()
    assert {r.removed_words for r in got if r.doc_id >= 100} == {5}
    assert {r.removed_words for r in got if r.doc_id < 100} == ({0} if once else {64})
    assert all(r.kept == (once or r.doc_id >= 100) for r in got)


def test_pipeline_leaves_only_its_result(spark):
    import corpus_pipeline
    from plumbline.llm import common

    mark = len(common.PATHS)
    out = corpus_pipeline.run(spark, SF)
    hadoop = spark._jvm.org.apache.hadoop.fs
    left = [p for p in common.PATHS[mark:] if hadoop.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop.Path(p))]
    assert len(left) == 1 and "best_fit_packing" in left[0] and out.count() > 0


def test_training_sample_is_bounded_in_all(spark):
    docs = spark.createDataFrame([(i, f"wort{i} und mehr", f"l{i % 12}") for i in range(600)], "doc_id long, text string, lang string")
    count = lambda **k: len(langid.training_words(docs, **k)) // 3
    assert count(per_lang=10, per_doc=150, total=1000) == 120
    assert count(per_lang=10, per_doc=150, total=60) == 60
    assert count(per_lang=10, per_doc=150, total=5) == 5


def planted_pairs(seed=11, n=300):
    """Pairs of texts with 5-word Jaccard of 0.8 to 0.9, each unlike all others."""
    rnd, out = random.Random(seed), []
    while len(out) < n:
        ws = [f"w{rnd.randrange(10**7)}" for _ in range(rnd.choice([120, 300, 600]))]
        copy = list(ws)
        for k in rnd.sample(range(len(ws)), max(1, len(ws) // rnd.choice([45, 60, 90]))):
            copy[k] = f"x{rnd.randrange(10**7)}"
        if 0.8 <= _jaccard(" ".join(ws), " ".join(copy)) <= 0.9:
            out.append((" ".join(ws), " ".join(copy)))
    return out


def test_near_dedup_links_by_fingerprints(spark):
    """Near copies are found by the SimHash alone: its edges, without what other keys add, join planted pairs and no others."""
    from plumbline.llm import minhash

    docs = [(2 * k + side, text) for k, pair in enumerate(planted_pairs()) for side, text in enumerate(pair)]
    known = minhash.WordHashes()
    prints = [simhash.wide(minhash.shingles(minhash.lower_words(t), known)) for _, t in docs]
    classes = spark.createDataFrame([(i, *map(bytearray, p)) for (i, _), p in zip(docs, prints)] + [(10**6, bytearray(), bytearray())], "id long, bits binary, low binary")
    edges = {(min(r.u, r.v), max(r.u, r.v)) for r in simhash.wide_links(classes, len(docs)).collect()}
    assert all(u // 2 == v // 2 for u, v in edges) and len(edges) >= 0.95 * len(docs) / 2


def test_near_dedup_stage_uses_fingerprints(spark, monkeypatch):
    """The stage finds near copies where none of its other keys does."""
    from plumbline.llm import minhash

    docs = [(2 * k + side, text) for k, pair in enumerate(planted_pairs(12, 100)) for side, text in enumerate(pair)]
    df = spark.createDataFrame(docs, "_at long, text string")
    monkeypatch.setattr(minhash, "_near", lambda batches: (b.iloc[:0].rename(columns={"key": "u", "id": "v"})[["u", "v"]] for b in batches))
    root = {r._at: r._root for r in minhash.near_labels(df).collect()}
    assert sum(root[2 * k] == root[2 * k + 1] for k in range(100)) >= 93 and len(set(root.values())) >= 100


def test_variants_of_segments():
    rnd = np.random.default_rng(8)
    bits, low = rnd.integers(0, 2**16, (5, simhash.SEGMENTS)).astype(np.uint16), np.tile(np.array([3, 14], np.uint8), (5, simhash.SEGMENTS, 1))
    keys = simhash.segment_keys(bits, low)
    for row in range(5):
        want = {(s << 16) | (int(bits[row, s]) & ~(1 << 3) & ~(1 << 14) | a << 3 | b << 14) for s in range(simhash.SEGMENTS) for a in (0, 1) for b in (0, 1)}
        assert set(keys[row].tolist()) == want
    a, b = np.zeros(8, np.uint16), np.zeros(8, np.uint16)
    b[0], b[1] = 0b1111, 0b11111  # 4 and 5 bits: the share of one segment is 4, of two 8
    near = simhash.within_far(np.stack([a, b]), np.array([0, 0]))
    assert near(np.array([0]), np.array([1])).tolist() == [False]
    assert simhash.within_far(np.stack([a, b]), np.array([2, 2]))(np.array([0]), np.array([1])).tolist() == [True]
