"""Every query over empty tables, nulls in any column, empty and long texts, ties, repeated rows and clashing extra columns."""

import pytest
from plumbline.llm import registry
from pyspark.sql import functions as F

import corpus_pipeline

from .. import oracle

LONG = " ".join(f"w{i % 977} x{i}" for i in range(30_000))
DOCS = [
    (1, "alpha beta gamma delta " * 20, "en", "s1"), (1, "alpha beta gamma delta " * 20, "en", "s1"), (2, "alpha beta gamma delta " * 20, "en", "s2"), (3, None, None, None), (4, "", "de", "s1"), (5, " \n\t ", "de", None), (None, "one two three " * 30, "fr", "s2"), (None, None, None, None),
    (6, LONG, "en", "s1"), (7, "12345 67890", "en", "s1"), (8, "mail a@b.co token=abcdef123", None, "s3"), (9, "alpha beta gamma delta " * 20 + "more", "en", "s3"), (2, "other text", "de", "s2"), (10, "ein Wort und noch eins", "de", "s3"),
]
DOC_SCHEMA = "doc_id long, text string, lang string, source string"
EXTRA = ["size", "row_id", "_id", "spans", "fp", "copies", "component_id", "removed", "n_words", "kept", "length", "rank", "_row_x", "codes", "score"]


def write(spark, path, docs, pages, vectors):
    d = spark.createDataFrame(docs, DOC_SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    d.withColumns({c: F.lit(7) for c in EXTRA}).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit(7) for c in ("digest", "best", "revisit", "n")}).write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(7) for c in ("v", "p", "b", "query_id")}).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    pages = [(1, "http://a/ é", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u\r\nWARC-Type: z", None), (4, "u", ""), (None, "u", "<p>x</p>"), (None, None, None), (2, None, "<p>x</p>"), (5, "u", "WARC/1.1\r\n" * 50)]
    vectors = [(0, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (7, [0.5, 0.5], None), (8, None, 1), (9, [float("nan"), 1.0], 1), (10, [None, 1.0], 1), (11, [], 1), (12, [2.0], 1), (None, [1.0, 1.0], 1), (13, [0.5, 0.5], 2)]
    return write(spark, tmp_path_factory.mktemp("odd"), DOCS, pages, vectors)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [], [])


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_empty(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in ("pipeline", "op6_dual_tree_topk", "op10_best_fit_packing")])
def test_a_row_per_row(spark, odd, name):
    rows = registry.QUERIES[name](spark, odd).collect()
    assert len(rows) == (8 if name.startswith("op1_") else len(DOCS))


def test_packing_keeps_every_token(spark, odd):
    rows = registry.QUERIES["op10_best_fit_packing"](spark, odd).collect()
    assert sum(r.piece == 0 for r in rows) == len(DOCS)


def test_topk_on_odd_vectors(spark, odd):
    rows = sorted(map(tuple, registry.QUERIES["op6_dual_tree_topk"](spark, odd).select("query_id", "rank", "vec_id", "score").collect()))
    big = 1024 * 1024
    assert [r for r in rows if r[0] == 0] == [(0, 1, 12, 2 * big), (0, 2, 100, big), (0, 3, 100, big), (0, 4, 7, big // 2), (0, 5, 13, big // 2), (0, 6, 11, 0)]
    # each of the two rows is a query, and a candidate of the other
    assert [r for r in rows if r[0] == 100] == [x for x in [(100, 1, 12, 2 * big), (100, 2, 0, big), (100, 3, 100, big), (100, 4, 7, big // 2), (100, 5, 13, big // 2), (100, 6, 11, 0)] for _ in range(2)]
    assert len(rows) == 18


def test_quality_and_substring_equal_their_sql(spark, odd):
    con = oracle.connect(odd)
    for name in ("op8_substring_dedup", "op9_quality_rules"):
        oracle.same(registry.QUERIES[name](spark, odd), con, registry.ORACLES[name])


def test_und(spark, odd):
    rows = registry.QUERIES["op7_language_id"](spark, odd).collect()
    assert sum(r.lang_pred == "und" and r.score == 0 for r in rows) == 5


def test_pipeline_stages_on_odd_documents(spark, odd, tmp_path):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, odd)
        if name != "best_fit_packing":
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() > 0


def test_one_row_of_each_component_whatever_its_id(spark):
    from plumbline.llm import simhash

    a, b, c, d = ("".join(f"{w}{i} " for i in range(60)) for w in "abcd")
    docs = spark.createDataFrame([(1, a, "s"), (2, a, "s"), (2, b, "s"), (None, c, "s"), (None, d, "s"), (None, d, "s"), (None, a, "s"), (3, d, "t"), (3, d, "s")], "doc_id long, text string, source string")
    got = sorted(((r.doc_id, r.text, r.source) for r in simhash.one_of_each(docs).collect()), key=lambda r: r[1])
    assert got == [(1, a, "s"), (2, b, "s"), (None, c, "s"), (3, d, "s")]
