"""The forest against brute force."""

import numpy as np
import pytest

from jobquarry.llm import ann

TABLE = "/root/testdata/sf0.1/embeddings.parquet"
IS_QUERY = "id % 50 = 0"


def brute(ids, rows, k=5):
    x = np.array(rows, np.float64)
    norms = np.sqrt((x * x).sum(1))
    out = {}
    for q in [i for i, d in enumerate(ids) if d % 50 == 0]:
        scores = (x * x[q]).sum(1) / (norms * norms[q])
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[q]][:k]
        out[ids[q]] = [(ids[i], scores[i]) for i in order]
    return out


def test_recall_and_scores_on_the_whole_table(spark):
    table = spark.read.parquet(TABLE)
    rows = table.orderBy("vec_id").collect()
    want = brute([r.vec_id for r in rows], [r.embedding for r in rows])
    got = {}
    for r in ann.nearest_neighbours(table, IS_QUERY).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    exact = {q: dict(w) for q, w in want.items()}
    found = 0
    for q, hits in got.items():
        hits.sort()
        assert [h[0] for h in hits] == [1, 2, 3, 4, 5]
        assert all(a[2] >= b[2] for a, b in zip(hits, hits[1:]))
        found += sum(h[1] in exact[q] for h in hits)
        assert all(abs(exact[q][h[1]] - h[2]) < 1e-12 for h in hits if h[1] in exact[q])
    assert found / (5 * len(want)) >= 0.9


@pytest.mark.parametrize("block", [16_384, 3])
def test_small_tables_are_exact(spark, block):
    """Ties, copies, bad vectors, other lengths: with few rows the ascent ends at the root."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 8)).round(2)
    rows = [(i, base[i % 40].tolist()) for i in range(0, 120)]
    rows += [(200 + i, (base[1] * 2.0**i).tolist()) for i in range(12)]
    good = list(rows)
    rows += [(300, None), (350, []), (400, [0.0] * 8), (450, [1.0] * 7 + [None]), (500, [float("nan")] * 8), (None, base[0].tolist()), (550, [1.0, 2.0])]
    docs = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, class int, level int")
    want = brute([i for i, _ in good], [v for _, v in good])
    got = {}
    for r in ann.nearest_neighbours(docs, IS_QUERY, block=block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert {q: [v for v, _ in h] for q, h in got.items()} == {q: [v for v, _ in h] for q, h in want.items()}
    assert ann.nearest_neighbours(docs.limit(0), IS_QUERY).count() == 0


def test_near_vectors_share_longer_prefixes():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 64))
    near = x + 0.05 * rng.standard_normal(x.shape)
    same = np.mean([ann.strings(x, t) >> 42 == ann.strings(near, t) >> 42 for t in range(8)])
    other = np.mean([ann.strings(x, t) >> 42 == ann.strings(near[::-1], t) >> 42 for t in range(8)])
    assert same > 0.5 > 0.01 > other


@pytest.mark.parametrize("noise", [0.1, 0.3, 0.6, 1.0])
def test_recall_inside_a_hot_cluster(spark, noise):
    """A third of the rows around one centre, whose strings share long prefixes."""
    rng = np.random.default_rng(7)
    rows = rng.standard_normal((6000, 64))
    rows[::3] = rng.standard_normal(64) + noise * rng.standard_normal((2000, 64))
    docs = spark.createDataFrame([(i, v) for i, v in enumerate(rows.tolist())], "vec_id long, embedding array<double>")
    want = brute(list(range(6000)), rows)
    hot = [q for q in want if q % 3 == 0]
    got = {}
    for r in ann.nearest_neighbours(docs, IS_QUERY).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    found = {q: len(got[q] & {v for v, _ in want[q]}) for q in want}
    assert set(got) == set(want)
    print("hot cluster", noise, sum(found[q] for q in hot) / (5 * len(hot)), "all", sum(found.values()) / (5 * len(want)))
    assert sum(found[q] for q in hot) / (5 * len(hot)) >= 0.9


@pytest.mark.parametrize("least", [ann.LEAST, 20])
def test_an_id_with_many_near_vectors_gets_its_neighbours(spark, least):
    """The query's own other vectors are nearer than all others, at the root and in the trees."""
    rng = np.random.default_rng(9)
    centre = rng.standard_normal(16)
    near = lambda n, noise: (centre + noise * rng.standard_normal((n, 16))).tolist()
    others = near(60, 0.2)
    rows = [(0, v) for v in near(12, 0.01)] + list(enumerate(others, 1))
    # A copy: two ids ask with one vector, and only one of them has more.
    rows.append((50, rows[0][1]))
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([v for _, v in rows])
    got = {}
    for r in ann.nearest_neighbours(docs, IS_QUERY, least=least).collect():
        got.setdefault(r.query_id, []).append((round(r.score, 9), r.vec_id))
    # A row per query vector and rank: 12 vectors of id 0, and two of id 50.
    assert len(got[0]) == 12 * 5 and len(got[50]) == 2 * 5
    assert all(v != 0 for _, v in got[0])
    if least == ann.LEAST:
        cosine = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
        for q in (0, 50):
            mine = [i for i, (d, _) in enumerate(rows) if d == q]
            free = [i for i, (d, _) in enumerate(rows) if d != q]
            want = [s for m in mine for s in sorted(cosine[m, free])[-5:]]
            assert np.allclose(sorted(s for s, _ in got[q]), sorted(want), atol=1e-8)
