import numpy as np
import pytest

from lodestead.embedding import embed, hashed_words
from lodestead.operators import dense, fusion, lexical

DOCS = [("about", "We are 34 people in one office."), ("contact", "Order MRD-4400 by mail"), ("limits", "Rate limits per minute"), ("pricing", "The team plan costs dollars")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id string, text string").cache()


def search(spark, docs, q, k=10):
    rows = lexical.bm25(docs, spark.createDataFrame([(1, q)], "query_id int, text string"), k).orderBy("place").collect()
    return [r.id for r in rows]


def test_bm25(spark, docs):
    assert search(spark, docs, "MRD-4400") == ["contact"]
    assert search(spark, docs, "4400")[0] == "contact"
    assert search(spark, docs, "team plan dollars")[0] == "pricing"
    assert search(spark, docs, "nothing here matches sourdough") == []
    assert search(spark, docs, "") == []
    once, twice = (lexical.bm25(docs, spark.createDataFrame([(1, q)], "query_id int, text string")).first().score for q in ("rate", "rate rate"))
    assert once == twice
    assert search(spark, docs.limit(0), "rate") == []


def test_bm25_against_plain_count(spark, docs):
    import math

    n, tf, dl = 4, 1, {"limits": 4}
    avg = sum(r.dl for r in lexical.document_lengths(docs).collect()) / 4
    want = math.log(1 + (n - 1 + 0.5) / 1.5) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl["limits"] / avg))
    got = lexical.bm25(docs, spark.createDataFrame([(1, "rate")], "query_id int, text string")).first().score
    assert abs(got - want) < 1e-8


def test_corpus_stats_count_empty_texts(spark):
    table = spark.createDataFrame([("a", "one two"), ("b", ""), ("c", None), (None, "x"), ("a", "one two")], "id string, text string")
    rows = lexical.unique_rows(table, "id", "text")
    r = lexical.corpus_stats(lexical.document_lengths(rows)).first()
    assert (r.n, r.avgdl) == (3, pytest.approx(2 / 3))


def ranked(spark, *ids):
    return spark.createDataFrame([("q", i, n + 1) for n, i in enumerate(ids)] or [], "query_id string, id string, place int")


def fused(spark, lists, weights=None, limit=20):
    return [r.id for r in fusion.fuse([ranked(spark, *x) for x in lists], weights, limit).orderBy("place").collect()]


def test_rrf(spark):
    assert fused(spark, [["a", "b"], ["c", "b"]])[0] == "b"
    assert fused(spark, [["a"], ["b"]], [3.0, 1.0]) == ["a", "b"]
    assert fused(spark, [["a"], ["b"]], [0.0, 1.0]) == ["b"]
    assert fused(spark, [[], []]) == []
    assert len(fused(spark, [[f"x{i}" for i in range(50)]], limit=5)) == 5


def test_dense(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    table = spark.createDataFrame([(f"v{i:03}", [float(z) for z in v]) for i, v in enumerate(x)] + [("zero", [0.0] * 8), ("short", [1.0]), ("none", None), ("v000", [float(z) for z in x[0]])], "id string, vector array<float>")
    good = dense.usable(table, dim=8)
    assert good.count() == 300
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    queries = good.where("id < 'v003'").withColumnRenamed("id", "query_id")
    got = dense.search_all(good, queries, 5).orderBy("query_id", "place").collect()
    for q in range(3):
        want = [f"v{i:03}" for i in np.argsort(-np.round(u @ u[q], 9), kind="stable")[:5]]
        assert [r.id for r in got if r.query_id == f"v{q:03}"] == want
    first = dense.search(good, queries.orderBy("query_id").limit(1).select("vector"), 5).collect()
    assert [r.id for r in first] == [r.id for r in got if r.query_id == "v000"]
    assert dense.search_all(good, queries.limit(0), 5).count() == 0


def test_hybrid_reports_zero_for_the_other_list(spark, docs):
    vectors = embed(docs).select("id", "vector")
    q = spark.createDataFrame([("q", "rate limits", hashed_words(["rate limits"])[0].tolist())], "query_id string, text string, vector array<float>")
    hits = fusion.hybrid(docs, vectors, q, limit=4, candidates=1).orderBy("place").collect()
    assert hits[0].id == "limits" and hits[0].dense > 0 and hits[0].lexical > 0
    none = q.selectExpr("query_id", "text", "cast(null as array<float>) as vector")
    only = fusion.hybrid(docs, vectors, none, limit=4).collect()
    assert [h.id for h in only] == ["limits"] and only[0].dense == 0
    assert fusion.grounded(fusion.hybrid(docs, vectors, none, limit=4)).count() == 0


def test_embedding_is_stable():
    a, b = hashed_words(["Rate limits", ""])
    assert abs(np.linalg.norm(a) - 1) < 1e-6 and not b.any() and (hashed_words(["rate LIMITS"])[0] == a).all()
