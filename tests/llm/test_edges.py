"""Every operator on nulls, empty and long texts, repeated rows, clashing extra columns and empty tables."""

import pytest

import corpus_pipeline
from tessera.llm import (
    compression_quality, maxent_lm, mil_toxicity, mixing, nnls_packing, rule_cascade, simhash, surrogates, url_rules, va_search,
)
from pyspark.sql import functions as F

LONG = "word " * 30_000 + "end."
TEXTS = [
    (1, "A plain text about rivers and hills. It has two sentences.", "en", "src1"),
    (1, "A plain text about rivers and hills. It has two sentences.", "en", "src1"),
    (2, None, "en", "src2"),
    (3, "", None, "src0"),
    (4, " \t\n ", "de", None),
    (None, "Nobody knows this row, mail me at ann.b@mail1.example.com now", "fr", "src4"),
    (5, LONG, "en", "src1"),
    (6, "Größe und Länge \U0001f600 sind verschieden, sagt Frau Müller.", "de", "src3"),
    (7, "one", "es", "src5"),
]
KIND = "doc_id long, text string, lang string, source string, n_chars long, score string, sequence_id string, word string, node long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*t, None if t[1] is None else len(t[1]), "x", "y", "z", 1) for t in TEXTS], KIND).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(1, 8)] + [(3, None, 1), (None, 1, 1), (2, 0, 0), (2, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def empty(df):
    return df.filter("false")


WHOLE = {
    "quality": lambda d, l: compression_quality.classify(d, l),
    "toxicity": lambda d, l: mil_toxicity.classify(d, l),
    "rules": lambda d, l: rule_cascade.cascade(d),
    "lm": lambda d, l: maxent_lm.score(d, vocabulary=64, buckets=64),
    "simhash": lambda d, l: simhash.near_duplicates(d),
    "surrogates": lambda d, l: surrogates.pseudonymise(d, b"key"),
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_one_row_for_each_row(name, docs, labels):
    got = WHOLE[name](docs, labels).collect()
    assert len(got) == len(TEXTS)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((t[0] is None, t[0] or 0) for t in TEXTS)


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_empty_table(name, docs, labels):
    assert WHOLE[name](empty(docs), empty(labels)).count() == 0


@pytest.mark.parametrize("name", ["quality", "toxicity"])
def test_scores_lie_in_range(name, docs, labels):
    for r in WHOLE[name](docs, labels).collect():
        assert 0 <= r["score"] <= 1 and r["predicted"] in (0, 1) and r["held_out"] is not None


@pytest.mark.parametrize("name", ["quality", "toxicity"])
def test_without_labels(name, docs, labels):
    assert WHOLE[name](docs, empty(labels)).count() == len(TEXTS)


def test_surrogates_keep_other_columns(docs):
    got = surrogates.pseudonymise(docs, b"key")
    assert got.columns == [*docs.columns, "n_replaced"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[2]["text"] is None and rows[3]["text"] == "" and rows[None]["n_replaced"] == 1
    assert "ann.b@" not in rows[None]["text"] and "Müller" not in rows[6]["text"]


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    assert {r["doc_id"] for r in got} <= {1, None, 5, 6, 7}
    assert all(0 < r["taken_tokens"] <= r["n_tokens"] for r in got)
    assert mixing.mix(empty(docs)).count() == 0


def test_packing_empty(docs):
    assert nnls_packing.pack(empty(docs)).count() == 0


def test_url_rules_on_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG", "https://a.org/x?y#z", "https://a.org/x?y#z", "ftp://é.example.org/es/é"]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    rows = {r["page_id"]: r for r in url_rules.judge(pages).collect()}
    assert len(rows) == len(urls)
    assert (rows[0]["host"], rows[0]["path"], rows[0]["rule"], rows[0]["verdict"]) == ("", "", None, "allow")
    assert (rows[4]["host"], rows[4]["path"], rows[4]["rule"]) == ("www.example.org", "", None)
    assert rows[5]["rule"] == "org/" and rows[7]["rule"] == "example.org/es/" and rows[7]["verdict"] == "block"
    assert url_rules.judge(pages.filter("false")).count() == 0


def test_search_on_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [0.5]), (None, [1.0, 1.0]), (100, [3.0, -1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = va_search.exact_top_k(frame, F.col("vec_id") % 100 == 0).collect()
    of = lambda q: [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
    m = 1024 * 1024
    assert of(0) == [(1, 1, 5 * m), (2, 100, m), (3, 7, m // 2), (4, 6, 0)]
    assert of(100) == [(1, 7, 3 * m // 2), (2, 0, m), (3, 1, m), (4, 6, 0)]
    assert va_search.exact_top_k(frame.filter("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_search_with_a_repeated_query(spark):
    rows = [(0, [10.0, 10.0])] * 50 + [(i, [1.0 + i / 100, 1.0]) for i in range(1, 41)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = va_search.exact_top_k(frame, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(40, 30, -1))
    few = va_search.exact_top_k(frame.filter("vec_id < 6"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in few] == [5, 4, 3, 2, 1]


def test_pipeline_stages_on_odd_rows(spark, docs, tmp_path):
    rows = [(i, 1, 0) for i in (1, 2, 3, 5, 6, 7)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for frame in (plain, empty(plain)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            frame = stage(spark, frame, str(tmp_path))
            if k < 4:
                assert frame.columns == plain.columns
        frame.count()
