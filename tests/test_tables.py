"""Table operators: deduplication, plans, checks, readers, writers, streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from jobquarry import PatternConfig, load_patterns, scratch_path
from jobquarry.operators import dedup, downloads, links, quality
from jobquarry.operators.postings import extract_postings
from jobquarry.plans import process_urls as plan
from jobquarry.plans.process_pages import process_pages
from jobquarry.schema import FIELD_KINDS, POSTING_SCHEMA, conform_postings, postings_from_json
from jobquarry.sources import readers, writers
from jobquarry.streaming.incremental import distinct_urls, ingest, stream_dedup


def test_dedup_keeps_the_first_and_all_rows_without_id(spark):
    rows = [("a", 3), ("b", 1), ("a", 2), ("", 4), ("", 5), (None, 6), (None, 7), ("b", 8)]
    df = spark.createDataFrame(rows, "job_id string, pos int").repartition(4)
    got = sorted((r.pos, r.job_id) for r in dedup.dedup_job_id(df, "pos").collect())
    assert got == [(1, "b"), (2, "a"), (4, ""), (5, ""), (6, None), (7, None)]


def test_process_urls_and_stats_agree(spark, config):
    base = "https://careers.example.com/en/details/"
    urls = [base + "1/a", base + "2/b?team=T", base + "1/other-slug", base + "3/c.pdf", None, base + "2/b?team=T", "x", base + "9/z"]
    df = spark.createDataFrame(
        [(i, u, {"k": "v"} if i else None, f"t{i}") for i, u in enumerate(urls)],
        "pos int, url string, metadata map<string,string>, title string",
    ).repartition(3)
    rows = {r.pos: r for r in plan.process_urls(df, config, "pos").collect()}
    assert sorted(rows) == [0, 1, 7]
    assert (rows[1].job_id, rows[1].team, rows[0].team, rows[0].title, rows[0].location) == ("2", "T", None, "t0", "")
    assert rows[0].metadata == {} and rows[1].metadata == {"k": "v"}
    stats = plan.processing_stats(df, config).first().asDict()
    assert stats == {"original_count": 8, "valid_count": 5, "invalid_count": 3, "duplicate_count": 2, "final_count": 3}


def test_stats_without_any_job_id_group(spark):
    rule = PatternConfig({"url_validation": {"valid_pattern": "http", "extracted_fields": ["job_id"]}})
    df = spark.createDataFrame([(i, "http://x") for i in range(5)], "pos int, url string")
    assert plan.process_urls(df, rule, "pos").count() == 5
    assert plan.processing_stats(df, rule).first().final_count == 5


def test_empty_runs_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(c, p, 0 if rng.random() < 0.8 else rng.randint(1, 3)) for c in ("a", "b") for p in range(200)]
    rows += [("c", p, 0) for p in range(30)] + [("d", 5, None)]
    want, run = {}, {}
    for crawl, page, jobs in rows:
        run[crawl] = run.get(crawl, 0) + 1 if not jobs else 0
        want[crawl, page] = run[crawl]
    df = spark.createDataFrame(rows, "crawl string, page int, jobs int").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for pieces in (1, 7, 60):
            spark.conf.set("spark.sql.shuffle.partitions", pieces)
            got = dedup.empty_page_runs(df, "crawl", "page", "jobs").collect()
            assert {(r.crawl, r.page): r.empty_run for r in got} == want
            assert all(r.limit_reached == (r.empty_run >= 5) for r in got)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sparse_page_numbers_keep_tasks_even(spark, monkeypatch):
    """One crawl with page numbers 4,096 apart is dealt like any other."""
    held = []
    monkeypatch.setattr(dedup, "stored", lambda df, name: held.append(df.cache()) or held[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(40_000).select(F.lit("c").alias("crawl"), (F.col("id") * 4096).alias("page"), (F.col("id") % 9 == 0).cast("int").alias("jobs"))
        found = dedup.empty_page_runs(rows, "crawl", "page", "jobs")
        assert found.where("empty_run = 8").count() == 40_000 // 9
        sizes = [r["count"] for r in held[0].groupBy("_chunk").count().collect()]
        assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        for df in held:
            df.unpersist()


def test_merge_and_counts(spark):
    old = spark.createDataFrame([("u1", 1, 0), ("u1", 1, 1)], "url string, page_number int, pos int")
    new = spark.createDataFrame([("u2", 2, 1), ("u1", 2, 0), ("u2", 3, 0), ("u3", 3, 1)], old.schema)
    merged = dedup.resume_merge(old, new, "page_number", "pos")
    assert sorted(map(tuple, merged.collect())) == [("u1", 1, 0), ("u1", 1, 1), ("u2", 2, 1), ("u3", 3, 1)]
    counts = {r.page_number: (r.jobs_found, r.jobs_new) for r in dedup.page_counts(old.unionByName(new), "page_number").collect()}
    assert counts == {1: (2, 1), 2: (2, 1), 3: (2, 1)}


def test_download_plan(spark):
    jobs = spark.createDataFrame([("http://h/a/b", "1"), ("", "2"), (None, "3"), ("http://h/c", "")], "url string, job_id string")
    named = downloads.with_file_name(jobs)
    landed = spark.createDataFrame([("1__a_b.html",), ("1__a_b.html",)], "file_name string")
    steps = downloads.download_plan(named, landed)
    assert sorted(r.status for r in steps.collect()) == ["fetch", "no_url", "no_url", "skip"]
    assert downloads.download_summary(steps).first().asDict() == {"success_count": 2, "failed_count": 2, "total_count": 4}
    lost = spark.createDataFrame([("c.html",)], "file_name string")
    assert downloads.download_summary(steps, lost).first().failed_count == 3


def type_of(values):
    """What a column of JSON values is, after the stated type order."""
    seen = set()
    for value in values:
        seen.update(type(v) for v in value) if isinstance(value, list) else seen.add(type(value))
    for kind, name in ((dict, "object"), (float, "float"), (int, "long"), (bool, "boolean"), (str, "text")):
        if kind in seen:
            return name
    return None


DOCUMENTS = [
    {"a": 1, "b": "x", "c": [1, 2.5], "d": None, "e": [], "f": {"z": 1}, "g": True, "h": [[1.5]], "i": 2**80, "j": [None], "k": [1, "x"]},
    {"a": 2.0, "b": 3, "c": None, "d": [{"q": 1}], "e": [None], "f": "t", "g": "no", "h": "s", "i": 1, "j": [True, "a"], "k": ["x", [1]]},
    {"a": 1e300, "l": 10.0, "m": [1, 1.0], "n": 12345678901234567890, "o": [[1], [2]], "p": [[1], "x"]},
]


def test_field_types_of_a_column(spark):
    df = spark.createDataFrame([(json.dumps(d),) for d in DOCUMENTS] + [("{bad",), ("[1]",), (None,)], "doc string")
    got = {r.field: r.field_type for r in quality.infer_field_types(df, "doc").collect()}
    columns = {k: [d[k] for d in DOCUMENTS if k in d and d[k] is not None] for d in DOCUMENTS for k in d}
    assert got == {k: type_of(v) for k, v in columns.items()}


def test_mapping_check(spark):
    expected = {k: "long" for k in "abcdefghijk"} | {"zz": "text"}
    texts = [json.dumps(d) for d in DOCUMENTS] + ["{bad", "{} tail", '{"zz": "x"}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, doc string")
    got = {(r.i, r.field, r.issue, r.got) for r in quality.check_mapping(df, "doc", expected, "i").collect()}
    want = {(3, None, "not_json", None), (4, None, "not_json", None)}
    for i, document in [*enumerate(DOCUMENTS), (5, {"zz": "x"})]:
        for key, kind in expected.items():
            if key not in document:
                want.add((i, key, "missing_key", None))
            else:  # one document's list counts as a column of its own
                value = document[key]
                found = type_of(value if isinstance(value, list) else [] if value is None else [value])
                if found != kind:
                    want.add((i, key, "type_mismatch", found))
    assert got == want
    passed = {r.i: r.passed for r in quality.mapping_passed(df, "doc", {"zz": "long"}, "i").collect()}
    assert passed == {0: False, 1: False, 2: False, 3: False, 4: False, 5: True}


def test_rules_and_reactions(spark, config):
    df = conform_postings(
        spark.createDataFrame(
            [("1", "Engineer", "2024-01-02", 1.0, 2.0), ("x", "Dev", "soon", 3.0, 2.0), ("", " ", None, None, 2.0)],
            "job_id string, title string, publish_date string, salary_min double, salary_max double",
        )
    )
    got = {r.job_id: r.violations for r in quality.violations(df, config).collect()}
    assert got == {
        "1": [],
        "x": ["job_id:numeric", "title:min_length", "publish_date:valid_date", "salary:logical_range".replace("salary", "salary_range")],
        "": ["job_id:not_empty", "job_id:numeric", "title:not_empty", "title:min_length"],
    }
    ok = {"job_id": quality.numeric(F.col("job_id"))}
    assert {r.job_id for r in quality.on_violation(df, "skip_record", ok).where("set_aside").collect()} == {"x", ""}
    repaired = quality.on_violation(df, "use_default", ok, {"job_id": F.lit("0")})
    assert sorted(r.job_id for r in repaired.collect()) == ["0", "0", "1"]
    with pytest.raises(Exception, match="rule broken"):
        quality.on_violation(df, "raise_error", ok).collect()
    assert quality.on_violation(df.where("job_id = '1'"), "raise_error", ok).count() == 1


def test_configured_reaction_to_missing_fields(spark, config):
    df = spark.createDataFrame([("1", "a"), ("", "b"), (None, "c")], "job_id string, title string")
    assert quality.missing_required(df, config, "job_id", "title").where("set_aside").count() == 2
    repair = PatternConfig({"error_handling": {"missing_required_fields": "use_default"}})
    fixed = quality.missing_required(df, repair, "job_id", defaults={"job_id": F.col("title")})
    assert sorted(r.job_id for r in fixed.collect()) == ["1", "b", "c"]


def test_expected_types():
    mapping = {"jobs": {"mappings": {"properties": {"a": {"type": "text"}, "b": {"properties": {"c": {"type": "long"}}}}}}}
    want = {"a": "text", "b": "object"}
    assert quality.expected_types(mapping, "jobs") == want
    assert quality.expected_types(mapping["jobs"]["mappings"]) == want
    assert quality.expected_types({"a": {"type": "text"}}) == {"a": "text"}


def test_posting_round_trip(spark):
    assert len(FIELD_KINDS) == 53
    source = spark.createDataFrame(
        [("1", "T é", "C", ["a"], 1.5, {"k": "v"}, "remote", "bogus")],
        "job_id string, title string, company string, benefits array<string>, salary_min double, metadata map<string,string>,"
        "work_arrangement string, job_type string",
    )
    full = conform_postings(source)
    again = postings_from_json(writers.posting_json(full), "posting")
    assert again.drop("valid").first() == full.first()
    text = writers.posting_json(full).first().posting
    assert "é" in text and list(json.loads(text)) == list(FIELD_KINDS) and json.loads(text)["salary_max"] is None
    assert full.first().job_type is None and full.first().work_arrangement == "remote"


def test_load_postings_shapes(spark):
    job = '{"job_id": "1", "title": "t", "company": "c", "extra": [1]}'
    texts = [f"[{job}, {job}]", f' {{"jobs": [{job}], "n": 1}}', "{}", '"x"', "3", "{bad", "[]", '{"jobs": []}', f"[{job}] tail"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, doc string")
    rows = readers.load_postings(df, "doc", "i").collect()
    assert sorted(r.i for r in rows if r.reason is None) == [0, 0, 1]
    assert sorted(r.i for r in rows if r.reason) == [2, 3, 4, 5, 8]


def test_job_list_files(spark, tmp_path):
    job = {"job_id": "1", "title": "t", "company": "c"}
    write(tmp_path / "a" / "list.json", json.dumps([job, job], indent=1))
    write(tmp_path / "object.json", json.dumps({"jobs": [job]}, indent=1))
    write(tmp_path / "bad.json", "{}")
    rows = readers.read_job_lists(spark, str(tmp_path)).collect()
    assert sorted(r.file_path.rsplit("/", 1)[1] for r in rows if r.reason is None) == ["list.json", "list.json", "object.json"]
    assert [r.file_path.rsplit("/", 1)[1] for r in rows if r.reason] == ["bad.json"]


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_snapshot_tree(spark, tmp_path):
    job = lambda n: json.dumps({"job_id": str(n), "title": "t", "company": "c"}, indent=1)
    write(tmp_path / "a" / "9" / "old.json", job(9))
    write(tmp_path / "a" / "10" / "new.json", job(10))
    write(tmp_path / "a" / "10" / "bad.json", "{bad")
    write(tmp_path / "a" / "10" / "note.txt", "no json")
    write(tmp_path / "a" / ".checkpoints" / "x.json", job(0))
    write(tmp_path / "b" / "draft" / "x.json", job(1))
    write(tmp_path / "c" / "3" / "x.json", job(3))
    rows = readers.read_latest_snapshots(spark, f"file:{tmp_path}").collect()
    assert sorted(json.loads(r.document)["job_id"] for r in rows if r.readable) == ["10", "3"]
    assert sum(not r.readable for r in rows) == 1
    tree = readers.read_postings_tree(spark, str(tmp_path / "a" / "10")).collect()
    assert sorted((r.job_id or "", r.reason or "") for r in tree) == [("", "invalid JSON"), ("10", "")]
    assert readers.read_latest_snapshots(spark, f"file:{tmp_path}/b/..").count() == 3


def test_listing_envelopes(spark, tmp_path, config):
    jobs = [{"url": "https://careers.example.com/en/details/1/a", "title": "A", "metadata": {"k": "v"}}, {"url": None}]
    envelope = {"source_url": "s", "company_name": "c", "total_jobs": 2, "total_pages_attempted": "unknown", "jobs": jobs}
    write(tmp_path / "l" / "one.json", json.dumps(envelope, indent=2))
    write(tmp_path / "l" / "none.json", json.dumps({**envelope, "jobs": []}, indent=2))
    rows = readers.read_listings(spark, str(tmp_path / "l")).orderBy("pos")
    assert [(r.pos, r.url, r.title, r.company_name) for r in rows.collect()] == [(0, jobs[0]["url"], "A", "c"), (1, None, None, "c")]
    stats = plan.processing_stats(rows, config)
    header = plan.processed_header(stats, "s", "c", 3)
    writers.write_processed(plan.process_urls(rows, config, "file_path", "pos"), header, str(tmp_path / "out"))
    summary = spark.read.json(str(tmp_path / "out" / "summary")).first()
    assert summary.processed_total_jobs == 1 and summary.processing_stats.invalid_count == 1
    assert spark.read.json(str(tmp_path / "out" / "jobs")).first().job_title == "A"


def test_process_pages_writes_everything_once(spark, fixtures, config, tmp_path):
    pages = readers.read_html_dump(spark, str(fixtures / "dump"))
    counts = process_pages(pages, config, str(tmp_path / "out"), "file_stem").first()
    assert (counts.successful, counts.failed, counts.total) == (2, 2, 4)
    saved = spark.read.schema(POSTING_SCHEMA).json(str(tmp_path / "out" / "postings"))
    assert sorted(r.job_id for r in saved.collect()) == ["1001", "1002"]
    assert {r.status for r in spark.read.json(str(tmp_path / "out" / "rejected")).collect()} == {"error_page", "missing_required"}


def test_corpus_rejections(spark, tmp_path):
    texts = ['{"e": [1.0, 2]}', '{"e": [[1.0, 2]]}', '{"e": [1]}', '{"e": [1, null]}', '{"e": [0, 0]}', '{"x": 1}', "{bad"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, doc string")
    flagged = writers.corpus_from_json(df, "doc", "e", 2, "i")
    reasons = {r.i: r.reason for r in flagged.collect()}
    assert reasons == {0: None, 1: writers.NESTED_VECTOR, 2: writers.WRONG_LENGTH, 3: writers.NULL_IN_VECTOR,
                       4: writers.ZERO_VECTOR, 5: writers.NO_VECTOR, 6: writers.NO_VECTOR}
    for _ in range(2):
        writers.index_corpus(flagged.withColumn("company", F.lit("c")), "e", 2, str(tmp_path / "c"), "company")
    assert readers and writers.read_corpus(spark, str(tmp_path / "c")).count() == 2  # indexing appends


def test_an_append_that_dies_leaves_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    rows = lambda ids: spark.createDataFrame([(i, [1.0, float(i)] if i else None) for i in ids], "i int, e array<float>")
    writers.index_corpus(rows([0, 1]), "e", 2, path, batch="run 1/a")
    with monkeypatch.context() as broken:
        # The folder of the data is named, that of the commit no more.
        calls, whole = [], writers.quote
        broken.setattr(writers, "quote", lambda name, safe: 1 / 0 if calls else calls.append(1) or whole(name, safe))
        with pytest.raises(ZeroDivisionError):
            writers.index_corpus(rows([2, 3]), "e", 2, path, batch="2")
    assert sorted(r.i for r in writers.read_indexed(spark, path).collect()) == [0, 1]
    for _ in range(2):
        writers.index_corpus(rows([2, 3, 4]), "e", 2, path, batch="2")
    assert sorted(r.i for r in writers.read_indexed(spark, path).collect()) == [0, 1, 2, 3, 4]
    assert sorted(r.i for r in writers.read_corpus(spark, path).collect()) == [1, 2, 3, 4]


def test_document_pages_in_order(spark):
    pages = [(d, p, f"<{d}.{p}>") for d in (1, 2) for p in range(700)]
    df = spark.createDataFrame(pages, "doc long, page long, text string").repartition(7)
    got = {r.doc: r.text for r in readers.document_pages_text(df, "doc", "page", "text").collect()}
    assert got == {d: "".join(t for x, _, t in pages if x == d) for d in (1, 2)}


def test_streams_equal_batches(spark, tmp_path):
    source = tmp_path / "links"
    schema = "page int, pos int, url string"
    run = lambda: stream_dedup(
        spark.readStream.schema(schema).parquet(str(source)), str(tmp_path / "seen"), str(tmp_path / "cp"), "page", "pos"
    ).awaitTermination()
    first = [(1, 0, "a"), (1, 1, "b"), (2, 0, "a")]
    second = [(3, 0, "b"), (3, 1, "c"), (4, 0, "c")]
    for batch in (first, second):
        spark.createDataFrame(batch, schema).repartition(2).write.mode("append").parquet(str(source))
        run()
    seen = spark.read.parquet(str(tmp_path / "seen"))
    assert sorted((r.page, r.pos, r.url) for r in seen.collect()) == [(1, 0, "a"), (1, 1, "b"), (3, 1, "c")]
    run()  # nothing new
    assert spark.read.parquet(str(tmp_path / "seen")).count() == 3
    assert distinct_urls(spark.read.parquet(str(source))).count() == 3


def test_ingest_takes_each_page_once(spark, fixtures, tmp_path):
    dump = tmp_path / "dump"
    for name in ("1001_full.html", "1002_bullets.html"):
        write(dump / name, (fixtures / "dump" / name).read_text())
        ingest(
            spark, str(dump), str(tmp_path / "landed"), str(tmp_path / "cp"), fmt="text", wholetext="true",
            pathGlobFilter="*.html", transform=lambda df: df.select(F.length("value").alias("n")),
        ).awaitTermination()
    got = sorted(r.n for r in spark.read.parquet(str(tmp_path / "landed")).collect())
    assert got == sorted(len((fixtures / "dump" / n).read_text()) for n in ("1001_full.html", "1002_bullets.html"))


def test_pages_become_postings_as_they_land(spark, fixtures, config, tmp_path):
    stream = ingest(
        spark, str(fixtures / "dump"), str(tmp_path / "postings"), str(tmp_path / "cp"), fmt="text", wholetext="true",
        pathGlobFilter="*.html",
        transform=lambda df: extract_postings(df, config, html="value").where("status = 'ok'"),
    )
    stream.awaitTermination()
    batch = extract_postings(readers.read_html_dump(spark, str(fixtures / "dump")), config).where("status = 'ok'")
    landed = spark.read.parquet(str(tmp_path / "postings"))
    kept = [name for name in batch.columns if name not in ("scraped_date", "metadata")]
    assert landed.select(kept).exceptAll(batch.select(kept)).count() == 0 and landed.count() == 2


def test_pattern_files(fixtures, tmp_path):
    config = load_patterns(fixtures / "works_pattern.yaml")
    assert config.require("job_url_selectors", "url_validation").company_name == "Example Works"
    with pytest.raises(ValueError, match="lacks"):
        config.require("nothing")
    with pytest.raises(ValueError, match="not found"):
        load_patterns(tmp_path / "none.yaml")
    write(tmp_path / "bad.yaml", "a: [1")
    with pytest.raises(ValueError, match="YAML"):
        load_patterns(tmp_path / "bad.yaml")
    assert load_patterns({"basic_info": {"title": "h1"}}).field_rule("basic_info", "title") == "h1"


def test_scratch_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_path(spark, "x")
    assert path != scratch_path(spark, "x")
    assert root is None or path.startswith(root)


def test_snapshot_folders_decide(spark, tmp_path):
    job = lambda n: json.dumps({"job_id": str(n)})
    write(tmp_path / "acme" / "9" / "a.json", job("old"))
    write(tmp_path / "acme" / "10" / "sub" / "a.json", job("new"))
    write(tmp_path / "beta" / "1" / "sub" / "x.json", job("b"))
    write(tmp_path / "big [1]" / "99999999999999999999999" / "x.json", job("big"))
    write(tmp_path / "big [1]" / "100" / "x.json", job("small"))
    for root in (str(tmp_path), f"file:{tmp_path}/", f"file://{tmp_path}"):
        rows = readers.read_latest_snapshots(spark, root).collect()
        assert sorted(json.loads(r.document)["job_id"] for r in rows) == ["b", "big", "new"]


def test_json_as_libraries_read_it(spark):
    texts = [
        '[{"job_id": "1", "title": "a", "job_id": "2"}]', '{"jobs": [{"job_id": "3", "salary_min": NaN}]}',
        '[{"job_id": "4"}] trailing', "{broken", "3", '[{"job_id": "5"}],[]', '  {"jobs": []}',
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, d string")
    rows = readers.load_postings(docs, "d", "i").select("i", "job_id", "reason").collect()
    assert sorted((r.i, r.job_id) for r in rows if r.reason is None) == [(0, "2"), (1, "3")]
    assert sorted(r.i for r in rows if r.reason) == [2, 3, 4, 5]

    fields = ['{"a": 1, "a": "x"}', '{"b": NaN}', "{broken", '{"c": {"d": 1, "d": 2}}', "[1]"]
    docs = spark.createDataFrame(list(enumerate(fields)), "i int, d string")
    found = {r.field: r.field_type for r in quality.infer_field_types(docs, "d").collect()}
    assert found == {"a": "text", "b": "float", "c": "object"}
    left_out = {r.reason: r.documents for r in quality.unreadable_documents(docs, "d").collect()}
    assert left_out == {"not_json": 1, "not an object": 1}
    issues = {(r.i, r.issue, r.got) for r in quality.check_mapping(docs.where("i < 3"), "d", {"a": "text", "b": "long"}, "i").collect()}
    assert issues == {(0, "missing_key", None), (1, "missing_key", None), (1, "type_mismatch", "float"), (2, "not_json", None)}


def test_fields_without_a_variant_form_are_typed_alike(spark):
    """The same fields, once more beside an inner object that repeats a key."""
    fields = '"a": "1", "b": 1, "c": 1.0, "d": true, "e": null, "f": {"x": 1}, "g": [1, "x"], "h": [[1.5], 2], "i": [], "j": 1e5, "k": 12345678901234567890, "l": NaN'
    docs = spark.createDataFrame([(0, "{" + fields + "}"), (1, "{" + fields + ', "z": {"y": 1, "y": "2"}}')], "i int, d string")
    by_row = [{r.field: r.field_type for r in quality.infer_field_types(docs.where(F.col("i") == i), "d").collect()} for i in (0, 1)]
    assert by_row[1].pop("z") == "object" and by_row[0] == by_row[1] and len(by_row[0]) == 12
    expected = {**{k: "text" for k in "abcdefghijkl"}, "missing": "long"}
    issues = {i: {(r.field, r.issue, r.got) for r in quality.check_mapping(docs.where(F.col("i") == i), "d", expected).collect()} for i in (0, 1)}
    assert issues[0] == issues[1] and ("missing", "missing_key", None) in issues[0] and ("h", "type_mismatch", "float") in issues[0]


def test_a_list_of_more_than_128_mb(spark):
    piece = '{"job_id": "1", "title": "' + "x" * 4000 + '"},'
    big = spark.range(1).select(F.concat(F.lit("["), F.repeat(F.lit(piece), 35_000), F.lit('{"job_id": "last"}]')).alias("d"))
    loaded = readers.load_postings(big, "d").groupBy("reason").count().collect()
    assert [(r.reason, r["count"]) for r in loaded] == [(None, 35_001)]


def test_empty_runs_keep_rows_with_nulls(spark):
    rows = [("a", 1, 0), ("a", 2, 0), ("a", None, 0), (None, 1, 0), (None, None, 3)]
    found = dedup.empty_page_runs(spark.createDataFrame(rows, "c string, n int, jobs int"), "c", "n", "jobs").collect()
    assert len(found) == 5 and {(r.c, r.n): r.empty_run for r in found}[("a", 2)] >= 2


def test_missing_sections_raise(spark):
    pages = spark.createDataFrame([("u", "h")], "url string, html string")
    with pytest.raises(ValueError, match="url_validation"):
        plan.validate_urls(pages, PatternConfig({}))
    with pytest.raises(ValueError, match="job_url_selectors"):
        links.extract_links(pages, PatternConfig({}), "http://h", keep=["url"])


def test_pages_whose_links_cannot_be_read_say_so(spark, config):
    from jobquarry.functions.html import links_of

    class Broken:
        def read(self, page):
            raise RecursionError("too deep")

    assert links_of("<a href='/x'>x</a>", [Broken()]) == {"links": [], "failure": "RecursionError: too deep"}
    assert links_of(None, []) == {"links": [], "failure": None}
    pages = spark.createDataFrame([(1, "<a href='/x'>x</a>"), (2, None), (4, "")], "i int, html string")
    assert links.unread_pages(pages, config, "i").count() == 0
