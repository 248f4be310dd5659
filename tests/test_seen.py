"""The seen-set of incremental runs: what it lets through, and how much it reads."""

import random

import pytest

from jobquarry.streaming import seen
from jobquarry.streaming.seen import SeenSet


def frame(spark, urls):
    return spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, n int")


def run(spark, path, batches, **layout):
    """What each batch lets through, and (filters, parts) read by it."""
    out = []
    for k, urls in enumerate(batches):
        fresh = SeenSet(spark, path, **layout).add(frame(spark, urls), "url", k)
        row = spark.read.json(f"{path}/manifest/batch_id={k}").first()
        out.append((sorted((r.url for r in fresh.collect()), key=str), (row.filters_read, row.parts_read)))
    return out


def test_ten_batches_read_only_what_they_touch(spark, tmp_path):
    batches = [[f"http://h/{k}/{i}" for i in range(60)] for k in range(9)]
    again = batches[2][7]
    batches.append([again, "http://h/new"])
    found = run(spark, str(tmp_path / "seen"), batches, buckets=16, filter_bits=1 << 14)
    for urls, (fresh, (filters, parts)) in zip(batches[:9], found):
        assert fresh == sorted(urls)
        # All buckets are touched and nearly no key is doubtful: filters are read, no history.
        assert filters <= 16 and parts <= 8
    fresh, (filters, parts) = found[9]
    # Two keys touch two buckets; one bucket may know its key, and holds no more than its parts.
    assert fresh == ["http://h/new"] and filters <= 2 and 1 <= parts <= seen.MAX_PARTS


def test_full_filters_and_many_parts_stay_exact(spark, tmp_path, monkeypatch):
    """Filters for nine keys each, parts merged after every second batch."""
    monkeypatch.setattr(seen, "MAX_PARTS", 2)
    rnd = random.Random(5)
    batches = [sorted({f"u{rnd.randrange(120)}" for _ in range(40)} | ({None} if k % 2 else set()), key=str) for k in range(8)]
    known = set()
    for urls, (fresh, _) in zip(batches, run(spark, str(tmp_path / "seen"), batches, buckets=3, filter_bits=64)):
        assert fresh == sorted(set(urls) - known, key=str)
        known |= set(urls)
    manifest = spark.read.json(f"{tmp_path}/seen/manifest/batch_id=7").collect()
    assert all(len(r.parts) <= 2 for r in manifest)


def test_a_batch_that_dies_or_runs_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "seen")
    SeenSet(spark, path, buckets=4).add(frame(spark, ["a", "b"]), "url", 0)
    with monkeypatch.context() as broken:
        broken.setattr(SeenSet, "_note", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            SeenSet(spark, path).add(frame(spark, ["b", "c"]), "url", 1)
    for _ in range(2):
        assert [r.url for r in SeenSet(spark, path).add(frame(spark, ["b", "c"]), "url", 1).collect()] == ["c"]
    assert SeenSet(spark, path, buckets=99).buckets == 4
    # Batch numbers with a hole: the last manifest before counts.
    assert [r.url for r in SeenSet(spark, path).add(frame(spark, ["c", "d"]), "url", 7).collect()] == ["d"]
    assert SeenSet(spark, path).add(frame(spark, []), "url", 8).count() == 0
    assert SeenSet(spark, path).add(frame(spark, ["a", "d"]), "url", 9).count() == 0


def test_layouts_that_cannot_be(spark, tmp_path):
    with pytest.raises(ValueError):
        SeenSet(spark, str(tmp_path / "x"), buckets=0)
    with pytest.raises(ValueError):
        SeenSet(spark, str(tmp_path / "x"), filter_bits=100)
