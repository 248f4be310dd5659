"""Embedding and nearest-neighbour search against brute force."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobquarry.functions.vectors import embed_text, hashing_model, last_token_pool, pool_last_token
from jobquarry.operators import search

DIMS = 6


def brute(queries, corpus, k):
    """The k best (score, id) of every query, by the stated order."""
    out = {}
    for query_id, q in queries:
        hits = []
        for vec_id, v in corpus:
            if v is None or len(v) != DIMS or any(x is None for x in v):
                continue
            norms = np.linalg.norm(q) * np.linalg.norm(v)
            if norms > 0 and np.isfinite(norms):
                hits.append((-round((1 + float(np.dot(q, v)) / norms) / 2, 9), vec_id))
        out[query_id] = [(vec_id, -s) for s, vec_id in sorted(hits)[:k]]
    return {q: hits for q, hits in out.items() if hits}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    # A third of the corpus is copies of one vector, which must tie by id.
    vectors = rng.integers(-3, 4, (300, DIMS)).astype(float)
    vectors[:100] = vectors[0]
    corpus = [(int(i), v.tolist()) for i, v in zip(rng.permutation(300), vectors)]
    corpus += [(900, None), (901, [1.0]), (902, [0.0] * DIMS), (903, [None] * DIMS), (904, [float("nan")] * DIMS)]
    queries = [(i, rng.integers(-3, 4, DIMS).astype(float).tolist()) for i in range(25)]
    queries += [(90, [0.0] * DIMS), (91, corpus[0][1]), (92, [1.0])]
    return queries, corpus


def frames(spark, data, id_type="long"):
    cast = str if id_type == "string" else int
    queries = [(cast(i), v) for i, v in data[0]]
    corpus = [(cast(i), v) for i, v in data[1]]
    return (
        spark.createDataFrame(queries, f"query_id {id_type}, query_vector array<double>").repartition(3),
        spark.createDataFrame(corpus, f"vec_id {id_type}, embedding array<float>").repartition(7),
    )


@pytest.mark.parametrize("id_type", ["long", "string"])
@pytest.mark.parametrize("grid", [False, True])
@pytest.mark.parametrize("k", [1, 10, 400])
def test_search_is_exact(spark, data, id_type, grid, k):
    queries, corpus = frames(spark, data, id_type)
    sizes = {"query_bytes": 5 * DIMS * 8, "corpus_bytes": 40 * DIMS * 8} if grid else {}
    got = {}
    hits = search.knn_search(queries, corpus, k, DIMS, **sizes)
    for r in hits.orderBy("query_id", "hit_rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.hit_rank == len(got[r.query_id])
    cast = str if id_type == "string" else int
    usable = [(cast(i), v) for i, v in data[0] if len(v) == DIMS]
    assert got == brute(usable, [(cast(i), v) for i, v in data[1]], k)


def test_filter_comes_before_ranking(spark, data):
    queries, corpus = frames(spark, data)
    hits = search.knn_search(queries, corpus, 3, DIMS, where=F.col("vec_id") % 2 == 0).collect()
    even = [(i, v) for i, v in data[1] if i % 2 == 0]
    usable = [(i, v) for i, v in data[0] if len(v) == DIMS]
    want = {(q, i) for q, found in brute(usable, even, 3).items() for i, _ in found}
    assert {(r.query_id, r.vec_id) for r in hits} == want


def test_no_queries_or_no_corpus(spark, data):
    queries, corpus = frames(spark, data)
    assert search.knn_search(queries.limit(0), corpus, 3, DIMS).count() == 0
    assert search.knn_search(queries, corpus.limit(0), 3, DIMS).count() == 0


def test_blocks_of_scores(monkeypatch):
    from jobquarry.functions import vectors

    monkeypatch.setattr(vectors, "BLOCK_ELEMENTS", 50)
    rng = np.random.default_rng(1)
    corpus, queries = rng.integers(0, 3, (200, 4)).astype(float), rng.integers(0, 3, (5, 4)).astype(float)
    best = vectors.BestHits(queries, 7)
    for part in np.array_split(np.arange(200), 3):
        best.add(part, corpus[part])
    scores = 1 + (queries @ corpus.T) / np.outer(
        np.linalg.norm(queries, axis=1), np.where(np.linalg.norm(corpus, axis=1) > 0, np.linalg.norm(corpus, axis=1), np.nan)
    )
    for row in range(5):
        order = sorted((i for i in range(200) if np.isfinite(scores[row, i])), key=lambda i: (-round(scores[row, i] / 2, 9), i))
        rows, ids, _ = best.hits()
        assert ids[rows == row].tolist() == order[:7]


def test_pooling(spark):
    hidden = [[[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]] * 3
    mask = [[1, 1, 0], [1, 1, 1], [0, 0, 0]]
    df = spark.createDataFrame(list(zip(hidden, mask)), "h array<array<double>>, m array<int>")
    got = [r[0] for r in df.select(last_token_pool(F.col("h"), F.col("m"))).collect()]
    assert got == pool_last_token(np.array(hidden), np.array(mask)).tolist() == [[3.0, 4.0], [5.0, 6.0], [5.0, 6.0]]


def test_model_runs_in_batches_on_whole_texts(spark):
    def make():
        calls = []

        def embed(texts):
            calls.append(len(texts))
            assert max(calls) <= 4
            return np.array([[len(t), len(t.split())] for t in texts])

        return embed

    texts = ["", "a b", None, "word " * 5000] + ["x"] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.e for r in df.select("i", embed_text(F.col("t"), make, batch_size=4).alias("e")).collect()}
    assert got == {i: [len(t or ""), len((t or "").split())] for i, t in enumerate(texts)}


def test_text_search_and_answers(spark):
    jobs = [(1, "data engineer", "u1", "spark and data"), (2, "cook", "u2", "food and fire"), (3, "painter", None, "")]
    corpus = spark.createDataFrame(jobs, "doc_id int, title string, source_url string, body string")
    vectors = corpus.withColumn("embedding", embed_text(F.col("body"), hashing_model(64)))
    queries = spark.createDataFrame([("q1", "Spark DATA", 2), ("q2", "fire", 1), ("q3", "", 5)], "query_id string, query_text string, k int")
    hits = search.semantic_search(queries, vectors, "k", 64, hashing_model(64))
    answers = search.shape_hits(hits, vectors, "query_id", "hit_rank", corpus_id="doc_id", vector="embedding")
    rows = {(r.query_id, r.hit_rank): json.loads(r.response) for r in answers.collect()}
    assert sorted(rows) == [("q1", 1), ("q1", 2), ("q2", 1)]
    first = rows["q1", 1]
    assert list(first) == ["title", "url", "job", "score"]
    assert (first["title"], first["url"]) == ("data engineer", "u1")
    assert first["job"] == {"doc_id": 1, "title": "data engineer", "source_url": "u1", "body": "spark and data"}
    assert rows["q2", 1]["title"] == "cook" and 0.5 < first["score"] <= 1
