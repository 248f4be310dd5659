"""Whitening against numpy's eigenvectors of the covariance."""

import numpy as np
import pytest

from jobquarry.llm import queries, whitening


def brute(vectors, keep=4):
    """Fit list, eigenvalues and components by a dense covariance."""
    x = np.unique(np.floor(np.array(vectors, np.float64) * 256).astype(np.int64), axis=0)
    centred = x - x.mean(0)
    covariance = centred.T @ centred / len(x)
    values, axes = np.linalg.eigh(covariance)
    return x, values[::-1][:keep], axes[:, ::-1][:, :keep], np.trace(covariance)


def got(spark, rows, **more):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string")
    return whitening.whitened(frame, **more).collect()


@pytest.mark.parametrize("scales", [np.linspace(3, 0.2, 12), np.geomspace(50, 0.02, 12)])
def test_equals_eigenvectors_of_the_covariance(spark, scales):
    rnd = np.random.default_rng(1)
    mixing = np.linalg.qr(rnd.normal(size=(12, 12)))[0]
    vectors = (rnd.normal(size=(400, 12)) * scales @ mixing + 7).astype(np.float32)
    vectors = np.concatenate([vectors, vectors[:90]])
    x, values, axes, trace = brute(vectors)
    rows = got(spark, [(i, v.tolist(), "x") for i, v in enumerate(vectors)])
    assert len(rows) == 490 and {r.n for r in rows} == {len(x)}
    own = {r.vec_id: r for r in rows}
    ints = np.floor(vectors.astype(np.float64) * 256).astype(np.int64)
    want = (ints - x.mean(0)) @ axes / np.sqrt(values)
    have = np.array([own[i].whitened for i in range(490)])
    sign = np.sign((want * have).sum(0))
    assert np.abs(have * sign - want).max() < 1e-8
    assert np.allclose(own[0].explained, values / trace, rtol=1e-9)
    assert own[0].identity_error < 1e-9
    sums = x.sum(0)
    assert [own[i].deviation for i in range(490)] == [int(((len(x) * v - sums) ** 2).sum()) for v in ints]


def test_badly_conditioned_rows(spark):
    """Two columns that differ by a rounding step, and one that never varies."""
    rnd = np.random.default_rng(2)
    a = rnd.integers(-(2**22), 2**22, size=(300, 3))
    x = np.column_stack([a, a[:, 0] + (np.arange(300) == 7), np.full(300, 9)])
    vectors = (x / 256).astype(np.float64)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows = sorted(whitening.whitened(frame).collect(), key=lambda r: r.vec_id)
    centred = x - x.mean(0)
    singular = np.linalg.svd(centred, compute_uv=False)
    assert len(rows[0].explained) == 4
    assert np.allclose(rows[0].explained, singular[:4] ** 2 / (singular**2).sum(), rtol=1e-4, atol=0)
    assert rows[0].identity_error < 1e-4


def test_rows_that_take_no_part(spark):
    rows = [
        (1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a"), (None, [2.0, 0.0], "b"), (3, [0.0, 1.0], "c"), (4, None, "d"), (5, [], "e"),
        (6, [1.0, None], "f"), (7, [float("nan"), 1.0], "g"), (8, [1.0, float("inf")], "h"), (9, [1.0, 2.0, 3.0], "i"), (10, [-0.0, 1.0], "j"),
    ]
    found = got(spark, rows)
    assert sorted((r.vec_id or 0) for r in found) == [0, 1, 1, 3, 10]
    assert {r.n for r in found} == {3} and all(len(r.whitened) == 2 for r in found)


def test_no_variance_no_rows_and_huge_entries(spark):
    alone = got(spark, [(1, [1.0, 2.0], None), (2, [1.0, 2.0], None)])
    assert [(r.n, r.deviation, r.whitened, r.identity_error) for r in alone] == [(1, 0, [], None)] * 2
    assert got(spark, [(1, None, None)]) == []
    huge = got(spark, [(1, [3e38, 2.0], None), (2, [1.0, 2.0], None), (3, [-3e38, 5.0], None)])
    # Saturated entries all but cancel in the sums, so the second row's deviation is a long.
    assert [r.deviation is None for r in sorted(huge, key=lambda r: r.vec_id)] == [True, False, True]
    assert len(huge[0].explained) >= 1


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    vectors = np.array([r.embedding for r in table])
    x, values, axes, trace = brute(vectors)
    have = {(r.vec_id, r.component): r for r in queries.QUERIES["op12_whitening"](spark, folder).collect()}
    assert len(have) == 4 * len(table)
    for k in range(4):
        want = (np.floor(vectors.astype(np.float64) * 256) - x.mean(0)) @ axes[:, k] / np.sqrt(values[k])
        own = np.array([have[r.vec_id, k + 1].whitened for r in table])
        assert np.abs(own * np.sign(own @ want) - want).max() < 1e-8
        assert abs(have[table[0].vec_id, k + 1].explained * trace / values[k] - 1) < 1e-9
    assert have[table[0].vec_id, 1].n == len(x) and have[table[0].vec_id, 1].identity_error < 1e-9
