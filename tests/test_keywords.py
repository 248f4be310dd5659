"""Dictionary matching against one regular expression per keyword, and batches by length."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobquarry.functions import vectors
from jobquarry.operators import keywords
from jobquarry.operators.keywords import match_keywords


def brute(text, names):
    words = lambda s: re.findall(r"\w+", s.lower())
    own, out = words(text or ""), []
    for name in names:
        w = words(name)
        if w and any(own[i : i + len(w)] == w for i in range(len(own))):
            out.append(name)
    return sorted(set(out))


def test_ten_thousand_keywords_equal_one_regex_each(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(2, 3)))
    names = sorted({" ".join(word() for _ in range(rnd.choice([1, 1, 2, 3]))) for _ in range(12_000)})[:10_000]
    names += ["Ab Cd", "ab-cd", "", "++", "é"]
    texts = [rnd.choice([", ", " ", "\n"]).join(word().title() for _ in range(rnd.randint(0, 60))) for _ in range(80)] + [None, "", "É!"]
    rows = list(enumerate(texts)) + [(None, "ab, cd"), (0, texts[0])]
    frame = spark.createDataFrame([(i, t) for i, t in rows], "id int, t string")
    found = match_keywords(frame.distinct(), "t", spark.createDataFrame([(n,) for n in names], "name string"), "name", "id")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000 and "Python" not in plan
    got = {r.id: r.keywords for r in found.collect()}
    assert got == {i: brute(t, names) for i, t in rows} and sum(map(len, got.values())) > 200


def test_no_dictionary(spark):
    frame = spark.createDataFrame([(1, "a b")], "id int, t string")
    empty = spark.createDataFrame([("+",)], "name string")
    assert [tuple(r) for r in match_keywords(frame, "t", empty, "name", "id").collect()] == [(1, [])]


def test_batches_hold_like_lengths():
    rnd = np.random.default_rng(2)
    lengths = np.concatenate([rnd.integers(1, 40, 900), rnd.integers(400, 8_192, 60), [8_192, 0]])
    batches = vectors.batches_by_length(lengths, 16_384)
    assert sorted(np.concatenate(batches).tolist()) == list(range(len(lengths)))
    padded = sum(len(b) * max(1, lengths[b].max()) for b in batches)
    assert all(len(b) == 1 or len(b) * lengths[b].max() <= 16_384 for b in batches)
    plain = sum(len(part) * part.max() for part in np.array_split(lengths, len(lengths) // 64))
    # A tenth at most is padding; batches of 64 rows in any order are mostly padding.
    assert padded < 1.12 * lengths.sum() < plain
    assert vectors.batches_by_length(np.zeros(0, int), 10) == []


@pytest.mark.parametrize("budget", [1, 60, 10_000])
def test_vectors_do_not_depend_on_batches(spark, budget):
    # Local functions, so that they travel with the job.
    def tokenizer():
        return lambda text: [len(w) for w in text.split()]

    def model():
        def run(tokens, mask):
            assert tokens.shape == mask.shape and tokens.shape[1] <= 50
            # What padding must not change: sums over real tokens, and the last of them.
            state = np.stack([np.cumsum(tokens * mask, 1), tokens], 2).astype(float)
            return vectors.pool_last_token(state, mask)

        return run

    texts = [" ".join("x" * (1 + (i * j) % 7) for j in range(i % 70)) for i in range(200)] + [None, " "]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    rows = frame.select("i", vectors.embed_tokens(F.col("t"), tokenizer, model, max_tokens=50, budget=budget).alias("v")).collect()
    for row in rows:
        ids = ([len(w) for w in (texts[row.i] or "").split()] or [0])[:50]
        assert row.v == [float(sum(ids)), float(ids[-1])]


def test_first_words_and_runs_are_those_of_all_tokens(spark):
    texts = ["", None, " ", "one", "  Two  words", "é-ß_1, Çx y", "..a..b..", "a\n\tb c", "x" * 500, "e\u0301t\u0301 \u0130I", "a b a b", "1 2 3"]
    words = keywords.tokens(F.col("t"))
    frame = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("w", words)
    rows = frame.select("t", "w", keywords.first_words(F.col("t")).alias("first"), keywords.phrases(F.col("w"), 3).alias("runs")).collect()
    for r in rows:
        assert r.first == (" ".join(r.w[:2]) if r.w and len(r.w) > 1 else None)
        want = {" ".join(r.w[i : i + n]) for n in (1, 2, 3) for i in range(len(r.w) - n + 1)} if r.w else set()
        assert sorted(r.runs or []) == sorted(want)


def test_runs_of_a_text_are_found_once(spark):
    frame = spark.range(5).select("id", F.concat(F.lit("a b c "), "id").alias("t"))
    names = spark.createDataFrame([("a b",), ("c 3",)], "name string")
    plan = match_keywords(frame, "t", names, "name", "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
