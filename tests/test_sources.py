"""Files, snapshot trees and envelopes: what is read, what is refused, what is never opened."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from jobquarry.operators.scan import running_sums
from jobquarry.sources import envelopes, files, many, readers, snapshots


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def jobs_of(df):
    key = lambda r: (r.file_path, -1 if r.pos is None else r.pos)
    return [
        (r.file_path.rsplit("/", 1)[1], r.pos, r.url, r.title, r.listing_url, r.company_name, r.total_pages_crawled, r.reason)
        for r in sorted(df.collect(), key=key)
    ]


ODD = ['a, "b" [c] {d}', "back\\slash\\", 'end\\"', "é,\u2028ß", "", "]}", '",{"url": "x"}', "line\nbreak,\ttab"]


def envelope(n, rnd, **more):
    jobs = [{"url": f"http://h/{i}", "title": rnd.choice(ODD) + str(i), "metadata": {"k,": rnd.choice(ODD)}, "tags": [1, [2, {"x": 3}]]} for i in range(n)]
    return {"source_url": "http://s,1", "company_name": 'Acme, "Inc" [1]', "total_pages_crawled": 3, "extra": {"jobs": [{"url": "no"}], "x": [1, 2]}, "jobs": jobs, **more}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Envelopes of many shapes, some of them broken."""
    root, rnd = tmp_path_factory.mktemp("envelopes"), random.Random(4)
    good = envelope(40, rnd)
    write(root / "a_line.json", json.dumps(good, ensure_ascii=False))
    write(root / "b_indented.json", json.dumps(good, indent=2))
    write(root / "c_last.json", json.dumps({"jobs": [{"url": "one"}], "company_name": None, "total_pages_crawled": 7}))
    write(root / "d_empty_list.json", json.dumps({"company_name": "none", "jobs": [ ]}))
    write(root / "e_no_jobs.json", json.dumps({"company_name": "x", "jobs": None}))
    write(root / "f_other.json", json.dumps({"company_name": "x"}))
    write(root / "g_cut.json", json.dumps(good)[:-25])
    write(root / "h_rest.json", json.dumps(envelope(2, rnd)) + " {}")
    write(root / "i_text.json", "no JSON, at all")
    write(root / "j_job.json", '{"jobs": [{"url": "a"}, {"url": b}]}')
    write(root / "k_alone.json", json.dumps({"jobs": [{"url": "only", "title": "t,u"}]}, separators=(",", ":")))
    return root


@pytest.mark.parametrize("block", [None, 97, 1000])
def test_huge_envelopes_in_pieces_equal_whole_ones(spark, folder, block):
    whole = jobs_of(readers.read_listings(spark, str(folder)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        if block:
            spark.conf.set("spark.sql.files.maxPartitionBytes", block)
            spark.conf.set("spark.sql.files.openCostInBytes", 0)
        pieces = jobs_of(envelopes.read_huge_listings(spark, str(folder)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert pieces == whole
    reasons = {row[0]: row[-1] for row in whole if row[-1]}
    assert reasons == {
        "e_no_jobs.json": envelopes.NO_JOBS, "f_other.json": envelopes.NO_JOBS,
        **dict.fromkeys(("g_cut.json", "h_rest.json", "i_text.json", "j_job.json"), envelopes.BAD_ENVELOPE),
    }
    assert sum(row[-1] is None for row in whole) == 82


def test_lines_of_envelopes_with_broken_ones(spark, tmp_path):
    write(tmp_path / "lines.json", '{"jobs": [{"url": "a"}]}\n{"jobs": [\n{"company_name": "x"}\n')
    rows = readers.read_listings(spark, str(tmp_path), multi_line=False).select("url", "reason").collect()
    assert sorted((r.url or "", r.reason or "") for r in rows) == [("", envelopes.BAD_ENVELOPE), ("", envelopes.NO_JOBS), ("a", "")]


def test_running_sums_over_chunks(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, 1, 2, 9]), i, rnd.randint(-3, 9)) for i in range(500)]
    got = running_sums(spark.createDataFrame(rows, "k string, c int, i int, v int"), ["k"], "c", "i", total=F.col("v")).collect()
    order = lambda r: (r[1] is not None, r[1] or 0, r[2])
    want = {r[2]: sum(o[3] for o in rows if o[0] == r[0] and order(o) < order(r)) for r in rows}
    assert {r.i: r.total for r in got} == want


def test_files_out_and_in_again(spark, tmp_path):
    rows = [(f"{i % 7}/p {i}.html", f"<p>é {i}</p>" if i % 5 else None) for i in range(60)]
    frame = spark.createDataFrame(rows, "n string, html string").repartition(4)
    root = f"file://{tmp_path}/dump"
    for _ in range(2):  # again: whole files replace whole files
        assert files.write_files(frame, root, F.col("n"), F.col("html")) == 60
    back = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).collect()
    assert sorted(r.value for r in back) == sorted(h or "" for _, h in rows if h)
    assert not list(tmp_path.rglob("*.part"))
    for bad in ("../x", "", "/x", "a//b"):
        with pytest.raises(Exception, match="no file name"):
            files.write_files(spark.createDataFrame([(bad, "x")], "n string, html string"), root, F.col("n"), F.col("html"))


def test_paths_that_tasks_open():
    assert files.opens_in_tasks("/a b") and files.opens_in_tasks("file:///a") and files.opens_in_tasks("s3a://b/k") and not files.opens_in_tasks("viewfs://x/y")
    system, path = files.task_files("file:///tmp/a%20b")
    assert path == "/tmp/a b" and files.task_files("/tmp/a%20b")[1] == "/tmp/a%20b"
    with pytest.raises(ValueError, match="viewfs"):
        files.task_files("viewfs://x/y")


def tree(root):
    job = lambda n: json.dumps({"job_id": str(n)})
    write(root / "acme" / "9" / "a.json", job("old"))
    write(root / "acme" / "10" / "sub" / "a.json", job("new"))
    write(root / "acme" / "10" / "_tmp" / "a.json", job("hidden"))
    write(root / "acme" / "10" / "note.txt", job("text"))
    write(root / "beta" / "1" / "x.json", job("before the empty one"))
    (root / "beta" / "2").mkdir()
    write(root / "big [1]" / "99999999999999999999999" / "x.json", job("big"))
    write(root / "big [1]" / "0100" / "x.json", job("small"))
    write(root / "names" / "latest" / "x.json", job("no number"))
    write(root / "stray.json", job("stray"))


def test_an_empty_newest_folder_counts(spark, tmp_path):
    tree(tmp_path)
    for root in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}/"):
        newest = {(r.company, r.snapshot) for r in readers.newest_folders(spark, root).collect()}
        assert newest == {("acme", "10"), ("beta", "2"), ("big [1]", "99999999999999999999999")}
        rows = readers.read_latest_snapshots(spark, root).collect()
        assert sorted(json.loads(r.document)["job_id"] for r in rows) == ["big", "new"]


def test_folders_where_only_spark_can_look(spark, tmp_path, monkeypatch):
    tree(tmp_path)
    for module in (snapshots, readers):
        monkeypatch.setattr(module, "opens_in_tasks", lambda uri: False)
    rows = readers.read_latest_snapshots(spark, f"file://{tmp_path}").collect()
    assert sorted(json.loads(r.document)["job_id"] for r in rows) == ["big", "new"]


def test_old_snapshots_are_never_listed(tmp_path, monkeypatch):
    tree(tmp_path)
    asked = []
    whole = snapshots.FolderReader._below
    monkeypatch.setattr(snapshots.FolderReader, "_below", lambda self, *names: asked.append(names) or whole(self, *names))
    reader = snapshots.FolderReader(str(tmp_path), 2)
    parts = reader.partitions()
    # The driver asks for the companies' names and for nothing else.
    assert asked == [()] and [p.names for p in parts] == [["acme", "beta"], ["big [1]", "names"]]
    found = [row for p in parts for row in reader.read(p)]
    assert asked[1:] == [("acme",), ("beta",), ("big [1]",), ("names",)] and len(found) == 7
    assert list(snapshots.FolderReader(str(tmp_path / "beta" / "2"), 2).read(snapshots._Companies([]))) == []


def test_ten_thousand_companies(spark, tmp_path):
    for i in range(10_000):
        for snapshot in (1, 2):
            (tmp_path / f"c{i}" / str(snapshot)).mkdir(parents=True)
    for i in range(0, 10_000, 500):
        write(tmp_path / f"c{i}" / "2" / "a.json", "{}")
        write(tmp_path / f"c{i}" / "1" / "a.json", "{}")
    newest = readers.newest_folders(spark, str(tmp_path))
    assert snapshots.snapshot_folders(spark, str(tmp_path)).rdd.getNumPartitions() == 157
    assert newest.where("snapshot = '2'").count() == 10_000
    assert readers.read_latest_snapshots(spark, str(tmp_path)).count() == 20


def listed(df):
    return sorted((r.file_path, r.value) for r in df.collect())


def spark_reads(spark, path, suffix="*", recursive=False):
    read = spark.read.option("pathGlobFilter", suffix).option("recursiveFileLookup", recursive).text(str(path), wholetext=True)
    return sorted((r.file_path, r.value) for r in read.select("_metadata.file_path", "value").collect())


def test_files_read_in_tasks_are_those_of_sparks_reader(spark, tmp_path):
    names = ["x y%z+ü[1]~.json", "q?#é;=&@$,!'()*^`{}|  .json", "_hidden.json", ".hidden.json", "_k=v.json", "empty.json", "note.txt", "_metadata", "z._COPYING_"]
    for folder in ("", "a b", "a b/1", "a b/1/deep é/er", "a b/1/.part", "a b/_tmp", "c%20d/2"):
        for name in names:
            write(tmp_path / folder / name, "" if name == "empty.json" else f"﻿ {folder}\r\n{name}\n")
    (tmp_path / "a b" / "1" / "raw.json").write_bytes(b"\xff{\x00")
    for suffix, recursive in (("", False), (".json", False), (".json", True), ("", True)):
        assert many.list_files(spark, str(tmp_path), suffix, recursive) is not None
        got = listed(many.whole_files(spark, str(tmp_path), suffix, recursive))
        assert got and got == spark_reads(spark, tmp_path, f"*{suffix}", recursive)
    one = tmp_path / "a b" / "note.txt"
    assert listed(many.whole_files(spark, f"file://{one}")) == spark_reads(spark, one)
    both = [str(one), str(tmp_path / "c%20d")]
    assert listed(many.whole_files(spark, both, recursive=True)) == sorted(spark_reads(spark, one) + spark_reads(spark, tmp_path / "c%20d", recursive=True))


def test_what_only_spark_reads_is_left_to_it(spark, tmp_path):
    write(tmp_path / "p" / "k=1" / "x.json", "1")
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "x.json.gz").write_bytes(gzip.compress(b"{}"))
    for path in (tmp_path / "p", tmp_path / "z", tmp_path / "z" / "*"):
        assert many.list_files(spark, str(path)) is None
        assert listed(many.whole_files(spark, str(path))) == spark_reads(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        many.whole_files(spark, str(tmp_path / "none"))


def test_many_small_files_are_few_tasks(spark, tmp_path):
    for i in range(300):
        write(tmp_path / f"c{i % 5}" / "1" / f"{i}.json", json.dumps({"job_id": str(i), "title": "t", "company": "c"}))
    tree = readers.read_postings_tree(spark, str(tmp_path))
    assert sorted(int(r.job_id) for r in tree.collect()) == list(range(300))
    assert tree.rdd.getNumPartitions() == 1 < spark.read.option("recursiveFileLookup", True).text(str(tmp_path), wholetext=True).rdd.getNumPartitions()


@pytest.mark.parametrize("small", [0, 400, 1 << 20])
def test_small_files_are_cut_as_sparks_reader_cuts(spark, tmp_path, small):
    for i, text in enumerate(["", ",", ",,", "a,b", "a,,b,", "﻿", "﻿,x", "﻿{\"a\": 1,\r\n}", "é,  ,\n", "x," * 400]):
        write(tmp_path / f"f [{i}] %20.json", text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 97)
        kinds = envelopes._cut(spark, str(tmp_path), small), envelopes._split_by_spark(spark, str(tmp_path))
        got, want = ([r[:1] + r[3:] for r in sorted(map(tuple, df.collect()))] for df in kinds)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want


def test_large_envelopes_are_still_split(spark, folder):
    assert jobs_of(envelopes.read_huge_listings(spark, str(folder), small=2000)) == jobs_of(readers.read_listings(spark, str(folder)))
