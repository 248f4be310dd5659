"""The pipeline's stages: what each must take out, keep, and return."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from jobquarry.llm import decontamination, mixing, toxicity
from test_near_dedup import shingles
from test_suffix_dedup import brute as brute_repeats

SMALL = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_are_those_of_the_job():
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "decontamination", "mixing"]


def test_toxicity_stage_takes_out_what_is_predicted(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    net = toxicity.learned(docs.where(~toxicity.held_out()), labels.where(~toxicity.held_out()))
    want = ids(toxicity.scored(docs, net).where("score < 0.5"))
    got = pipeline.without_toxic(spark, docs, SMALL)
    assert got.columns == docs.columns and ids(got) == want and 0.8 < len(want) / docs.count() < 1


def test_near_dedup_stage_keeps_one_of_each_group(spark):
    docs = table(spark, "documents")
    rows = [(r.doc_id, shingles(r.text)) for r in docs.select("doc_id", "text").collect()]
    holders = {}
    for i, (_, s) in enumerate(rows):
        for x in s:
            holders.setdefault(x, []).append(i)
    shared = {}
    for group in holders.values():
        for a in group:
            for b in group:
                if b < a:
                    shared[a, b] = shared.get((a, b), 0) + 1
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(rows[a][1]) + len(rows[b][1]) - n):
            root[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    got = pipeline.without_near_duplicates(spark, docs, SMALL)
    assert got.columns == docs.columns and ids(got) == sorted(least.values())


def test_repeats_stage_cuts_texts(spark):
    docs = table(spark, "documents").where("doc_id < 150")
    rows = docs.orderBy("doc_id").collect()
    want = brute_repeats([r.text for r in rows], 152, 200, 51)
    got = {r.doc_id: r for r in pipeline.without_repeats(spark, docs, SMALL).collect()}
    assert len(got) == len(rows)
    for row, (n_bytes, removed, _, _) in zip(rows, want):
        new = got[row.doc_id]
        assert n_bytes - removed - len(new.text.encode()) in range(8) and (removed or new.text == row.text)
        assert new.n_chars == (len(new.text) if removed else row.n_chars) and (new.lang, new.source) == (row.lang, row.source)


def test_repeats_stage_knows_passages_by_words(spark):
    """A passage of 51 short words goes; one of fewer words and bytes stays."""
    some = " ".join(f"word{i}" for i in range(26))
    texts = ["or " * 51 + "xne", "two " + "or " * 51, f"three {some}", f"four {some}", None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in pipeline.without_repeats(spark, docs, SMALL).collect()}
    assert got == {0: "xne", 1: "two ", 2: texts[2], 3: texts[3], 4: None, 5: ""} and len(some) < 200


def test_benchmark_stage_takes_out_documents_with_items(spark):
    docs, items = table(spark, "documents"), table(spark, "benchmark")
    sets = [shingles(r.text) for r in items.collect()]
    bad = [r.doc_id for r in docs.collect() if any(s and 10 * len(s & shingles(r.text)) >= 8 * len(s) for s in sets)]
    got = pipeline.without_benchmark(spark, docs, SMALL)
    assert bad and got.columns == docs.columns and ids(got) == sorted(set(ids(docs)) - set(bad))


def test_mixing_stage_takes_whole_copies(spark):
    docs = table(spark, "documents")
    got = pipeline.mix(spark, docs, SMALL)
    assert got.columns == [*docs.columns, "copy"]
    copies = {r.doc_id: r.copies for r in mixing.copies_of(docs).select("row.doc_id", "copies").collect()}
    counted = {r.doc_id: (r.n, r.top) for r in got.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("top")).collect()}
    assert counted == {d: (n, n) for d, n in copies.items() if n}


def test_the_whole_run(spark):
    rows = pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"] and rows.count() > 0


def test_stages_take_odd_rows_and_more_columns(spark):
    text = "some words that are repeated in more than one of these rows of the table"
    docs = spark.createDataFrame(
        [(1, text, None, None, None, 5), (None, text + " again", "en", "a", 3, 6), (3, None, "en", "a", 0, 7), (4, "", None, "b", 0, 8), (4, "", None, "b", 0, 8)],
        "doc_id long, text string, lang string, source string, n_chars long, row int",
    )
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SMALL).count() == 0, name
    assert pipeline.without_near_duplicates(spark, docs, SMALL).count() == 5 - 1
    assert pipeline.without_benchmark(spark, docs, SMALL).count() == 5


def test_targets_are_those_of_sharing_again_and_again(spark):
    rnd = random.Random(8)
    for _ in range(3):
        sizes = {f"s{i:02d}": rnd.choice([0, 3, 50, 10_000, 400_000]) for i in range(11)}
        weights = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(sorted(sizes))}
        want, left, open_ = {}, float(sum(sizes.values())), set(sizes)
        while open_:
            level = left / sum(weights[s] for s in open_)
            full = {s for s in open_ if weights[s] * level >= 3 * sizes[s]}
            if not full:
                want |= {s: weights[s] * level for s in open_}
                break
            want |= {s: 3.0 * sizes[s] for s in full}
            left -= sum(3.0 * sizes[s] for s in full)
            open_ -= full
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(frame).collect()}
        assert got == pytest.approx(want)


def test_mixing_of_null_sources_texts_and_repeats(spark):
    rows = [(i, "w " * (i % 7), ["a", "b", None][i % 3], i) for i in range(300)] + [(None, None, None, 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    first = mixing.copies_of(docs).select("row.doc_id", "row.source", "size", "source_size", "target", "copies").collect()
    assert sorted(map(str, first)) == sorted(map(str, mixing.copies_of(docs.repartition(5)).select("row.doc_id", "row.source", "size", "source_size", "target", "copies").collect()))
    assert len(first) == 302 and all(r.copies <= 3 for r in first)
    assert all(r["size"] == (r.doc_id or 0) % 7 for r in first if r.doc_id is not None)
    for source in ("a", "b", None):
        own = [r for r in first if r.source == source]
        assert abs(sum(r["size"] * r.copies for r in own) - own[0].target) < 0.25 * own[0].target
    assert mixing.copies_of(docs.limit(0)).count() == 0 and mixing.mixed_corpus(docs).columns == [*docs.columns, "copy"]


def test_containment_of_short_and_odd_items(spark):
    docs = spark.createDataFrame(
        [(1, "x y z " * 50 + "one two three four five six seven " + "q r s " * 50), (2, "Just  THREE words"), (3, None), (4, ""), (None, "one two three four five six seven"),
         (5, "one two three four five six 7 eight nine ten"), (6, "one two three four five six seven"), (6, "one two three four five six seven")],
        "doc_id long, text string",
    )
    items = spark.createDataFrame(
        [(10, "one two three four five six seven"), (11, "just three words"), (12, None), (13, " "), (None, "one two three four five"), (10, "one two three four five six seven")],
        "item_id long, text string",
    )
    found = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontamination.contained_items(docs, items).collect()}
    assert found == {
        (1, 10, 3, 3), (None, 10, 3, 3), (6, 10, 3, 3), (2, 11, 1, 1), (1, None, 1, 1), (None, None, 1, 1), (5, None, 1, 1), (6, None, 1, 1),
    }
    assert sorted(map(str, (r.doc_id for r in decontamination.without_items(docs, items).collect()))) == ["3", "4"]
    assert decontamination.contained_items(docs, items.limit(0)).count() == 0
    assert re.fullmatch(r"\[\^.*\]\+", decontamination.WORD)


def test_an_item_of_millions_of_words(spark):
    """Sizes times per mille are more than an int holds."""
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2_700_000)), lambda i: i.cast("string")), " ")
    items = spark.range(1).select(F.lit(7).alias("item_id"), words.alias("text"))
    docs = spark.range(2).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, F.concat(F.lit("start "), words)).otherwise(F.lit("other text")).alias("text"))
    found = decontamination.contained_items(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in found] == [(0, 7, 2_699_996, 2_699_996)]
