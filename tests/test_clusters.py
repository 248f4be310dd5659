"""Search over clusters: the same hits as the plain search, and files that are not read."""

import re

import numpy as np
import pytest

from jobquarry.operators import clusters, search
from test_search import DIMS, data, frames  # noqa: F401


def found(df):
    return sorted(tuple(r) for r in df.select("query_id", "vec_id", "score", "hit_rank").collect())


@pytest.mark.parametrize("k, cells", [(1, 6), (10, 6), (400, 3), (5, 1)])
def test_equals_the_plain_search(spark, data, tmp_path, monkeypatch, k, cells):  # noqa: F811
    queries, corpus = frames(spark, data)
    monkeypatch.setattr(clusters, "PART_ROWS", 40)
    monkeypatch.setattr(clusters, "PART_QUERIES", 7)
    path = str(tmp_path / "corpus")
    clusters.write_clustered(corpus, path, "embedding", DIMS, cells)
    assert spark.read.parquet(f"{path}/rows").count() == corpus.count()
    assert found(clusters.search_clustered(queries, path, k, DIMS)) == found(search.knn_search(queries, corpus, k, DIMS))


def test_far_clusters_are_not_read(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, DIMS)) * 10
    corpus = [(i, (centres[i % 20] + rng.standard_normal(DIMS) * 0.1).tolist()) for i in range(2_000)]
    queries = [(i, (centres[i] + rng.standard_normal(DIMS) * 0.1).tolist()) for i in range(2)]
    corpus = spark.createDataFrame(corpus, "vec_id long, embedding array<float>")
    queries = spark.createDataFrame(queries, "query_id long, query_vector array<double>")
    path = str(tmp_path / "corpus")
    clusters.write_clustered(corpus, path, "embedding", DIMS, 20)
    read, whole = [], clusters.cluster_rows

    def watched(spark, path, cells):
        rows = whole(spark, path, cells)
        read.append(set(cells))
        return rows

    monkeypatch.setattr(clusters, "cluster_rows", watched)
    hits = clusters.search_clustered(queries, path, 5, DIMS)
    assert found(hits) == found(search.knn_search(queries, corpus, 5, DIMS))
    # The first look reads a cluster or two per query, the second what they cannot rule out.
    assert 1 <= len(read[0]) <= 4 and len(read[0] | read[1]) <= 6
    scan = whole(spark, path, sorted(read[0]))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*cell", scan)


def test_nothing_to_search(spark, tmp_path):
    corpus = spark.createDataFrame([(1, None), (2, [0.0] * DIMS), (3, [1.0])], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0] * DIMS)], "query_id long, query_vector array<double>")
    path = str(tmp_path / "corpus")
    clusters.write_clustered(corpus, path, "embedding", DIMS, 4)
    assert clusters.search_clustered(queries, path, 3, DIMS).count() == 0
