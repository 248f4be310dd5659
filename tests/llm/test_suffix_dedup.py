"""Repeated passages against a plain table of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobquarry.llm import suffix_dedup
from jobquarry.llm.deep_shallow import BlindTrie, suffix_order


def brute(texts, length, least_bytes=0, least_words=0):
    """(n_bytes, n_removed, n_spans, digest) of each text; shorter runs than these stay."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            gone[a:b] = b - a >= least_bytes or len(d[a:b].split()) >= least_words
        kept = bytes(b for b, g in zip(d, gone) if not g)
        runs = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, rows, length=200, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(docs, length)
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect())


def texts(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60) for _ in range(4)]
    out = [prose(rnd.randint(1, 150)) for _ in range(30)]
    for _ in range(30):
        parts = [prose(rnd.randint(0, 60)) for _ in range(3)]
        passage = rnd.choice(shared)
        cut = rnd.randint(0, 120)
        parts.insert(rnd.randint(0, 3), passage[cut : cut + rnd.randint(150, 330)])
        out.append("".join(parts))
    out += [out[3], out[3], out[40], "", None, "x" * 199, "y" * 200, "z" * 201, "ab" * 300, "Aningen, " * 60]
    out += ["\0" * 300, "\0a" * 150]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = list(enumerate(texts(seed)))
    want = Counter((i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows], 200)))
    assert run(spark, rows) == want


def test_crowded_grams_equal_brute_force(spark):
    rows = list(enumerate(texts(3)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = suffix_dedup.keyed(docs)
    plain = {r.id: suffix_dedup._merged([s.asDict() for s in r.spans]) for r in suffix_dedup.repeated_spans(keyed).collect()}
    crowd = {r.id: suffix_dedup._merged([s.asDict() for s in r.spans]) for r in suffix_dedup.repeated_spans(keyed, gathered=1).collect()}
    assert plain == crowd and plain


def test_long_texts_are_cut_into_pieces(spark):
    rnd = random.Random(5)
    long = "".join(rnd.choice("abcdef ") for _ in range(9000))
    keyed = suffix_dedup.keyed(spark.createDataFrame([(1, long), (2, long[2000:5000] + "!" + long[100:450])], "doc_id long, text string"))
    merged = lambda piece: {
        r.id: suffix_dedup._merged([s.asDict() for s in r.spans]) for r in suffix_dedup.repeated_spans(keyed, piece=piece).collect()
    }
    assert merged(1 << 20) == merged(700) == {1: [[100, 450], [2000, 5000]], 2: [[0, 3000], [3001, 3351]]}


def test_null_and_repeated_ids_and_clashing_names(spark):
    same = "word " * 80
    rows = [(None, same, 1, 2), (7, same, 3, 4), (7, same, 3, 4), (None, "short", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int, n_bytes int")
    got = suffix_dedup.remove_repeats(docs)
    assert len(set(got.columns)) == len(got.columns) and "spans" in got.columns
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in got.collect()) == [(5, 0, 0)] + [(400, 400, 1)] * 3
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_suffix_order_is_the_sorted_order():
    rnd = random.Random(9)
    stock = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 90))).encode() for _ in range(40)]
    texts = [rnd.choice(stock) + rnd.choice(stock) for _ in range(300)] + [b"", b"a\0", b"a", b"a\0\0", b"\0" * 50, b"\0" * 49]
    groups = np.sort(np.array([rnd.randint(0, 3) for _ in texts]))
    order, shared = suffix_order(texts, groups)
    assert (groups[order] == groups).all()
    for i in range(1, len(texts)):
        a, b = texts[order[i - 1]], texts[order[i]]
        if groups[i] != groups[i - 1]:
            assert shared[i] == -1
        else:
            assert a <= b and shared[i] == BlindTrie.common(a, b)
