"""Archives: round trips, and what a damaged file still gives."""

import hashlib
import random

import pyarrow as pa
import pytest

from jobquarry.llm import warc


def pages(n, seed=1):
    rnd = random.Random(seed)
    return [(i, f"http://h/{i}?é x\n", "".join(rnd.choice("<p>añ\r\n ") for _ in range(rnd.randint(0, 4000)))) for i in range(n)]


def archive(rows, compressed=True):
    records = []
    for i, url, html in rows:
        data = html.encode()
        record = warc.record_bytes(i, url, data, hashlib.sha256(data).hexdigest(), len(data), None)
        records.append(warc.member(record) if compressed else record)
    return records


def read(data):
    return list(warc.salvage(warc._Window(pa.BufferReader(data))))


def check_cover(found, size):
    """Records and gaps follow each other without holes or overlaps."""
    assert [f["start"] for f in found] == [0, *(f["end"] for f in found[:-1])] and found[-1]["end"] == size


@pytest.mark.parametrize("compressed", [True, False])
def test_whole_files(compressed):
    rows = pages(40)
    data = b"".join(archive(rows, compressed))
    found = read(data)
    assert [(f["page_id"], f["payload"].decode()) for f in found] == [(i, html) for i, _, html in rows]
    check_cover(found, len(data))
    assert read(b"") == []


@pytest.mark.parametrize("compressed", [True, False])
@pytest.mark.parametrize("damage", ["flip", "cut", "insert", "head", "tail", "length"])
def test_later_records_are_recovered(compressed, damage):
    rows = pages(30, 2)
    records = archive(rows, compressed)
    lost = 7
    record = records[lost]
    middle = len(record) // 2
    broken = {
        "flip": record[:middle] + bytes([record[middle] ^ 0x55]) + record[middle + 1 :],
        "cut": record[: middle + 3],
        "insert": record[:middle] + b"\0garbage WARC/1.1\r\n" + record[middle:],
        "head": record[5:],
        "tail": record,
        "length": record.replace(b"Content-Length: ", b"Content-Length: 9") if not compressed else record[:3] + b"\xff" + record[4:],
    }[damage]
    data = b"".join([*records[:lost], broken, *records[lost + 1 :]])
    if damage == "tail":
        data = data[:-9]
        lost = len(rows) - 1
    found = read(data)
    assert [f["page_id"] for f in found if f["kind"] == "record"] == [i for i, _, _ in rows if i != lost]
    gaps = [f for f in found if f["kind"] == "gap"]
    assert len(gaps) == 1 and gaps[0]["reason"]
    assert gaps[0]["start"] == sum(map(len, records[:lost]))
    check_cover(found, len(data))


def test_records_inside_payloads_are_not_found_unless_the_outer_one_is_lost():
    inner = archive([(1, "http://in/", "inner")], False)[0]
    outer = warc.record_bytes(2, "http://out/", inner, hashlib.sha256(inner).hexdigest(), len(inner), None)
    assert [f["page_id"] for f in read(outer)] == [2]
    assert [f.get("page_id") for f in read(b"X" + outer[3:])] == [None, 1, None]


def test_junk_only_and_gaps_at_both_ends():
    data = b"\x1f\x8b\x08junk" * 1000
    assert [(f["kind"], f["start"], f["end"]) for f in read(data)] == [("gap", 0, len(data))]
    found = read(b"abc" + archive(pages(1))[0] + b"WARC/1.0\r\n")
    assert [f["kind"] for f in found] == ["gap", "record", "gap"]


@pytest.mark.parametrize("compressed", [True, False])
def test_tables_round_trip(spark, tmp_path, compressed):
    same = "<p>" + "x" * 200
    rows = [(i, u, h, "more") for i, u, h in pages(60, 3)]
    rows += [(500, "u", same, "m"), (400, "u", same, "m"), (450, None, same, "m"), (None, "n", same, "m"), (601, "e", None, None), (602, "e", "", None), (603, "s", "short", ""), (604, "s", "short", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    manifest = warc.write_archives(df, str(tmp_path / "out"), archive_bytes=20_000, compressed=compressed)
    assert manifest.count() > 3
    got = warc.read_archives(manifest).collect()
    assert all(r.kind == "record" for r in got) and len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    for i, _, html, _ in rows:
        data = (html or "").encode()
        row = by_id[i]
        assert (row.payload_bytes, row.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        shared = html == same and i != 400
        assert (row.record_type, row.refers_to) == (("revisit", 400) if shared else ("response", None))
        assert row.payload is None if shared else bytes(row.payload) == data
    empty = warc.write_archives(df.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(empty).count() == 0


@pytest.mark.parametrize("compressed", [True, False])
def test_headers_have_no_limit(compressed):
    rows = [(1, "http://h/1", "a"), (2, "http://h/" + "é" * 400_000, "b"), (3, "http://h/3", "c")]
    found = read(b"".join(archive(rows, compressed)))
    assert [(f["kind"], f.get("page_id")) for f in found] == [("record", 1), ("record", 2), ("record", 3)]


@pytest.mark.parametrize("damage", ["gap", "missing"])
def test_a_strict_read_reports_lost_records(spark, tmp_path, damage):
    records = archive(pages(5))
    broken = b"".join([*records[:2], *([records[2][:-9]] if damage == "gap" else []), *records[3:]])
    (tmp_path / "a.warc.gz").write_bytes(broken)
    manifest = spark.createDataFrame([(f"{tmp_path}/a.warc.gz", len(broken), 5)], warc.MANIFEST)
    assert warc.read_archives(manifest).where("kind = 'record'").count() == 4
    with pytest.raises(Exception, match="gap from" if damage == "gap" else "4 records, 5 in the manifest"):
        warc.read_archives(manifest, strict=True).collect()
