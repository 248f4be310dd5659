"""The n-gram join against all pairs of full sets."""

import random
import re

import numpy as np
import pytest

from jobquarry.llm import jaccard_join, leaders


def shingles(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, percent=90):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, groups=30, copies=10, longest=300):
    """Groups of edited copies; all texts also hold phrases that many others hold."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgéß") for _ in range(rnd.randint(1, 6)))
    common = [[word() for _ in range(12)] for _ in range(4)]
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rnd.randint(2, longest))] + rnd.choice(common) + rnd.choice(common)
        for _ in range(rnd.randint(1, copies)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 35))):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += ["", None, " \t\n", "One two", "one  TWO", "a b c", "A B c", "a b c d", "Éa b c", "éa b c", texts[0], texts[0].upper()]
    nine = " ".join(f"w{i}" for i in range(11))
    texts += [nine, nine + " more", "x " * 30]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def got(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.components(docs, **more).collect()), key=str)


@pytest.mark.parametrize("percent, seed", [(90, 1), (75, 2), (100, 3)])
def test_equals_all_pairs(spark, percent, seed):
    rows = corpus(seed)
    assert got(spark, rows, percent=percent) == brute(rows, percent)


def test_large_buckets_in_crowds(spark, monkeypatch):
    for name, value in (("SMALL", 3), ("BLOCK", 5), ("PASSING", 11), ("MEETING", 7)):
        monkeypatch.setattr(leaders, name, value)
    rows = corpus(6, groups=8, copies=50, longest=60)
    assert got(spark, rows) == brute(rows)


def test_any_token_classes_give_the_same(spark, monkeypatch):
    """All tokens frequent, all very frequent: combinations only, the same links."""
    rows = corpus(4, groups=12)
    want = brute(rows)
    sketch = jaccard_join.sketch_of
    for rare, frequent in ((-1, 255), (-1, -1)):
        monkeypatch.setattr(jaccard_join, "sketch_of", lambda *a, r=rare, f=frequent: (sketch(*a)[0], r, f))
        assert got(spark, rows) == want


def test_linked_sets_share_a_key():
    """Random sets at the threshold, with random counters."""
    rnd = np.random.default_rng(5)
    sketch = rnd.integers(0, 12, 1 << jaccard_join.SKETCH_BITS).astype(np.uint8), 2, 8
    for percent in (70, 90):
        small = jaccard_join.small_below(percent)
        for _ in range(150):
            n = int(rnd.integers(small, 700))
            x = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
            gone = int(jaccard_join.allowed_misses(np.array([len(x)]), percent)[0])
            y = np.sort(rnd.choice(x, len(x) - gone, replace=False))
            sizes = np.array([len(x), len(y)])
            keys = [set(), set()]
            for bands in (np.log2(sizes).astype(int), np.log2(sizes * 100 // percent).astype(int)):
                k, owner = jaccard_join.prefix_keys(np.concatenate([x, y]), sizes, bands, sketch, percent)
                for i in (0, 1):
                    keys[i] |= set(k[owner == i].tolist())
            assert keys[0] & keys[1]


def test_bitmaps_differ_in_no_more_bits_than_the_sets():
    rnd = np.random.default_rng(6)
    sets = [np.unique(rnd.integers(0, 5_000, int(rnd.integers(1, 3_000)), dtype=np.uint64)) for _ in range(40)]
    sets[3:3] = [np.zeros(0, np.uint64)]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    bits = jaccard_join.bitmaps(np.concatenate(sets), at)
    apart = np.bitwise_count(bits[:, None] ^ bits[None]).sum(2)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            assert apart[i, j] <= len(np.setxor1d(x, y)) and (i != j or apart[i, j] == 0)


def test_null_ids_repeats_and_clashing_names(spark):
    text = "one two three four five six seven"
    rows = [(None, text, 1), (9, text, 2), (9, text, 3), (4, "else " * 9, 4), (4, "", 5), (None, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    found = sorted(((r.doc_id, r.component_id) for r in jaccard_join.components(docs).collect()), key=str)
    assert found == sorted([(None, 9), (9, 9), (9, 9), (4, 4), (4, 4), (None, None)], key=str)
    assert jaccard_join.components(docs.limit(0)).count() == 0


def test_one_very_long_text(spark):
    long = " ".join(f"w{i % 90_001}" for i in range(100_000))
    rows = [(1, long), (2, long + " end"), (3, long[: len(long) // 2]), (4, None)]
    assert [r[2] for r in got(spark, rows)] == [1, 1, 3, 4]


def meetings(spark, monkeypatch, rows):
    """Number of pairs that were compared."""
    count = [0]
    whole = leaders.similar_pairs

    def counted(pairs, *more):
        count[0] += pairs.count()
        return whole(pairs, *more)

    monkeypatch.setattr(jaccard_join, "similar_pairs", counted)
    result = got(spark, rows)
    monkeypatch.setattr(jaccard_join, "similar_pairs", whole)
    return count[0], result


def test_tight_groups_cost_linear_work(spark, monkeypatch):
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(10_000)}" for _ in range(120)]

    def copies(n):
        out = []
        for i in range(n):
            copy = list(base)
            copy[rnd.randrange(120)] = f"new{i}"
            out.append((i, " ".join(copy)))
        return out

    few, _ = meetings(spark, monkeypatch, copies(300))
    many, result = meetings(spark, monkeypatch, copies(1_200))
    assert {r[2] for r in result} == {0}
    assert few < 5 * 300 and many < 5 * 1_200
