"""Near-duplicate components against all pairs of full sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobquarry.llm import leaders, near_dedup
from jobquarry.llm.hashing import shingle_sets


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows, percent=85):
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


def corpus(seed, groups=25, copies=12):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgéß") for _ in range(rnd.randint(1, 6)))
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rnd.randint(5, 260))]
        for _ in range(rnd.randint(1, copies)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 40))):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += ["", None, " \t\n", "One two", "one  TWO", "a b c d", "A b c d e", "a b c d e", "Éa b c d e", "éa b c d e", texts[0], texts[0].upper()]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def got(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.components(docs, **more).collect()), key=str)


@pytest.mark.parametrize("percent", [80, 85, 100])
def test_equals_all_pairs(spark, percent):
    rows = corpus(1)
    assert got(spark, rows, percent=percent) == brute(rows, percent)


@pytest.mark.parametrize("small", [2, 9])
def test_large_groups(spark, monkeypatch, small):
    """Leaders are copied for every seven that they meet, blocks hold nine outsiders."""
    for name, value in (("MEETING", 7), ("SMALL", small), ("BLOCK", 9), ("PASSING", 20)):
        monkeypatch.setattr(leaders, name, value)
    rows = corpus(2, groups=6, copies=60)
    assert got(spark, rows) == brute(rows)


def near_copies(n, edits):
    """Copies of one text of 250 words, each with some words of its own."""
    rnd = random.Random(n + edits)
    base = [f"w{rnd.randrange(50_000)}" for _ in range(250)]
    out = []
    for i in range(n):
        copy = list(base)
        for k in rnd.sample(range(250), edits):
            copy[k] = f"own{i}x{k}"
        out.append((i, " ".join(copy)))
    return out


@pytest.mark.parametrize("edits, sizes", [(1, (10_000, 20_000)), (9, (1_000, 2_000))])
def test_rows_grow_with_the_documents(spark, monkeypatch, edits, sizes):
    """Tight groups (all pairs link) and loose ones (no pair does at 80 %): rows that are compared."""
    made = []
    for n in sizes:
        count = [0]
        pairs_of, texts_of = leaders._met, leaders._texts_of

        def met(*args, count=count, pairs_of=pairs_of):
            out = pairs_of(*args)
            count[0] += out.count()
            return out

        def texts(roles, *args, count=count, texts_of=texts_of):
            count[0] += roles.count()
            return texts_of(roles, *args)

        with monkeypatch.context() as patch:
            patch.setattr(leaders, "_met", met)
            patch.setattr(leaders, "_texts_of", texts)
            result = got(spark, near_copies(n, edits), percent=80)
        made.append(count[0])
        assert len({r[2] for r in result}) == (1 if edits == 1 else n)
    # A document is filed under up to 77 keys.
    assert made[0] < 30 * sizes[0] and made[1] < 2.5 * made[0]


def test_null_ids_repeats_and_clashing_names(spark):
    text = "one two three four five six seven"
    rows = [(None, text, 1), (9, text, 2), (9, text, 3), (4, "else " * 9, 4), (4, "", 5), (4, "", 6), (None, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    found = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.components(docs).collect()), key=str)
    assert found == sorted([(None, 9, False), (9, 9, True), (9, 9, True), (4, 4, True), (4, 4, True), (4, 4, True), (None, None, True)], key=str)
    left = near_dedup.first_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(9, text), (4, "else " * 9), (4, ""), (4, ""), (None, None)], key=str)
    assert near_dedup.components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_pairs_within_the_radius_share_a_key(spark, percent):
    """Pigeonhole: any two signatures that differ in at most as many symbols meet."""
    radius = near_dedup.radius_of(percent)
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 16, near_dedup.SYMBOLS, dtype=np.uint16)
    rows = [(0, base.tobytes())]
    for i in range(1, 300):
        other = base.copy()
        other[rnd.choice(near_dedup.SYMBOLS, radius, replace=False)] += np.uint16(1)
        rows.append((i, other.tobytes()))
    keys = spark.createDataFrame([(i, bytearray(s)) for i, s in rows], "i long, signature binary").select("i", F.explode(near_dedup.chunk_keys(radius)).alias("key"))
    first = keys.where("i = 0").select("key")
    assert keys.join(first, "key").select("i").distinct().count() == len(rows)


def test_thresholds_that_chunks_cannot_hold_are_refused():
    assert near_dedup.radius_of(85) == 37 and near_dedup.radius_of(80) == 46
    with pytest.raises(ValueError):
        near_dedup.radius_of(60)


def test_shingles_are_cut_per_text():
    texts = ["a b c d e f", None, "", "a b c d e f", "x", " b c d e f", "A B C D E"]
    values, at = shingle_sets(pa.array(texts))
    sets = [set(values[a:b].tolist()) for a, b in zip(at[:-1], at[1:])]
    assert [len(s) for s in sets] == [2, 0, 0, 2, 1, 1, 1]
    assert sets[0] == sets[3] and sets[5] < sets[0] and sets[6] < sets[0]
