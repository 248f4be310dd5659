"""Language proportions on held-out rows, on made mixtures, and on odd texts."""

import math

import numpy as np
import pytest

from jobquarry.llm import language_mixture as lm

TABLE = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet(TABLE)
    return docs, lm.learn(docs.where(~lm.held_out()))


def test_held_out_accuracy(learned):
    docs, model = learned
    rows = lm.identify(docs.where(lm.held_out()), model).select("lang", "lang_pred", "score").collect()
    assert len(rows) > 250 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_counts_are_those_of_a_plain_loop(spark, learned):
    docs, _ = learned
    few = docs.where("doc_id < 40")
    model = lm.learn(few)
    plain = {}
    for r in few.collect():
        buckets, spans, _ = lm._words([r.text])
        row = plain.setdefault(r.lang, np.full(lm.BUCKETS, lm.SMOOTHING))
        for low, high in spans.T:
            np.add.at(row, buckets[low:high], 1)
    assert model.languages == tuple(sorted(plain))
    for k, lang in enumerate(model.languages):
        assert np.allclose(model.logs[:, k], np.log(plain[lang] / plain[lang].sum()), atol=1e-4)


def test_mixtures_are_found(spark, learned):
    docs, model = learned
    texts = {lang: docs.where(f"lang = '{lang}' AND n_chars > 3000 AND crc32(cast(doc_id as string)) % 3 = 1").first().text[:2000] for lang in ("en", "fr", "de")}
    rows = [(1, texts["en"] + " " + texts["fr"]), (2, texts["de"]), (3, texts["de"] + " " + texts["en"] + " " + texts["fr"])]
    got = {r.doc_id: r for r in lm.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    names = lambda r: {p.split(":")[0] for p in r.languages.split(",")}
    assert names(got[1]) >= {"en", "fr"} and got[2].lang_pred == "de" and got[2].score > 0.9 and names(got[3]) >= {"en", "fr", "de"}
    assert 0.3 < got[1].score < 0.7


def test_odd_texts(spark, learned):
    _, model = learned
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 +- 5", "x"), (None, "the", "x"), (5, "the " * 200_000, None), (6, "中文字", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = {r.doc_id: r for r in lm.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[None].lang_pred == got[5].lang_pred == "en"
    assert got[6].lang_pred in model.languages
    assert lm.identify(docs.limit(0), model).count() == 0
    nothing = lm.learn(docs.where("false").withColumnRenamed("score", "lang"))
    assert {r.lang_pred for r in lm.identify(docs, nothing).collect()} == {"und"}


def test_em_recovers_proportions():
    rng = np.random.default_rng(2)
    languages = np.log(rng.dirichlet(np.full(50, 0.3), 3) + 1e-9)
    drawn = np.concatenate([rng.choice(50, 600, p=np.exp(languages[0]) / np.exp(languages[0]).sum()), rng.choice(50, 200, p=np.exp(languages[2]) / np.exp(languages[2]).sum())])
    chosen, shares = lm.mixture(languages[:, drawn].T)
    assert sorted(chosen) == [0, 2] and abs(shares[chosen.index(0)] - 0.75) < 0.06


def plain_mixture(words, penalty=lm.PENALTY, rounds=lm.ROUNDS):
    """The method in plain loops, from a list of log-likelihoods per word."""
    count, kinds = len(words), len(words[0])
    relative = [[math.exp(max(x - max(w), -60.0)) for x in w] for w in words]
    total = [sum(w[k] for w in words) for k in range(kinds)]
    chosen, shares = [total.index(max(total))], [1.0]
    density = [r[chosen[0]] for r in relative]
    height = sum(math.log(d) for d in density)
    while len(chosen) < kinds:
        best = None
        for extra in range(kinds):
            if extra in chosen or sum(r[extra] / d for r, d in zip(relative, density)) / count <= 1:
                continue
            columns, weights = [*chosen, extra], [s * 0.9 for s in shares] + [0.1]
            for _ in range(rounds):
                parts = [0.0] * len(columns)
                for r in relative:
                    own = [r[c] * w for c, w in zip(columns, weights)]
                    parts = [p + o / sum(own) for p, o in zip(parts, own)]
                weights = [p / count for p in parts]
            mixed = [sum(r[c] * w for c, w in zip(columns, weights)) for r in relative]
            reached = sum(math.log(m) for m in mixed)
            if best is None or reached > best[0]:
                best = (reached, extra, weights, mixed)
        if best is None or best[0] - height <= penalty * math.log(count + 1):
            break
        height, extra, shares, density = best
        chosen.append(extra)
    return chosen, shares


def test_predictions_equal_a_plain_loop(spark, learned):
    """Whole texts, mixed ones too, word by word and language by language."""
    docs, model = learned
    texts = [r.text for r in docs.where("length(text) < 1500").orderBy("doc_id").limit(40).collect()]
    texts += [f"{a} {b}" for a, b in zip(texts[::2], texts[1::2])] + [None, "", "12 !", "é"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in lm.identify(frame, model).collect()}
    for i, text in enumerate(texts):
        if not any(map(str.isalpha, text or "")):
            assert (got[i].lang_pred, got[i].score, got[i].languages) == ("und", 0.0, "")
            continue
        buckets, spans, _ = lm._words([text])
        words = [[sum(float(model.logs[b, k]) for b in buckets[a:z]) for k in range(len(model.languages))] for a, z in zip(*spans.tolist())]
        chosen, shares = plain_mixture(words)
        first = max(range(len(chosen)), key=lambda k: (shares[k], -chosen[k]))
        assert got[i].lang_pred == model.languages[chosen[first]]
        assert got[i].score == pytest.approx(min(1.0, shares[first]), abs=1e-3)
        assert {x.split(":")[0] for x in got[i].languages.split(",")} == {model.languages[c] for c in chosen}
