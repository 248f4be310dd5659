"""WARC archives: writing with revisit records, and a reader that salvages damaged files.

Writing: payload digests are grouped in Spark (one small row per digest), then each task
appends one gzip member per record to archives of bounded size in a shared folder. A task
names its files by its attempt and returns a manifest; only the manifest of the attempt
that succeeded counts, so a task that ran twice, or half, leaves nothing that is read.

Reading: one archive is one task. Records are checked: gzip checksum, version line,
lengths, closing lines, block and payload digest. After a failed check the reader does
not trust the damaged record's length, but searches byte by byte for the next gzip member
or version line that starts a valid header, goes on there, and reports the bytes between
as a quarantined gap with the reason. Memory is bounded by one record and one read buffer.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobquarry.llm.frames import stored
from jobquarry.session import scratch_path

#: Payloads shorter than this are always written in full.
LEAST_SHARED = 100
#: An archive is closed once it has this many bytes.
ARCHIVE_BYTES = 64 << 20
READ = 1 << 18
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/\d\.\d\r\n")

MANIFEST = "file string, bytes long, records long"
RECORD = (
    "file string, start long, end long, kind string, reason string, record_type string, page_id long, target_uri string, "
    "payload_digest string, payload_bytes long, refers_to long, payload binary"
)
_NAMES = [c.split()[0] for c in RECORD.split(", ")]
_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
_KINDS = [_TYPES[c.split()[1]] for c in RECORD.split(", ")]


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder; plain paths and file: URIs are local."""
    local = re.sub(r"^file:/+", "/", uri)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(uri)


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id: int | None, uri: str | None, payload: bytes | None, digest: str, length: int, refers_to: int | None) -> bytes:
    """One record; without a payload a revisit. Escapes in the URI keep a header on its line."""
    revisit = payload is None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block += f"Content-Length: {length}\r\n\r\n".encode() + (payload or b"")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{uri}|{digest}|{revisit}")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>",
             "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: {_sha1(block)}",
             f"X-Payload-Length: {length}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {quote(uri, safe='!#$%&()*+,/:;=?@[]~-._')}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"X-Refers-To-Page-ID: {refers_to}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _writer(folder: str, limit: int, compressed: bool):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, path = open_folder(folder)
        made: list[tuple[str, int, int]] = []
        stream, name, size, count = None, "", 0, 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                page_id, url, html, digest, refers_to = (v.as_py() for v in row)
                payload = (html or "").encode()
                data = record_bytes(page_id, url, payload if refers_to is None else None, digest, len(payload), refers_to)
                data = member(data) if compressed else data
                if stream is None:
                    name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{len(made)}.warc" + ".gz" * compressed
                    stream, size, count = system.open_output_stream(f"{path}/{name}", compression=None), 0, 0
                stream.write(data)
                size, count = size + len(data), count + 1
                if size >= limit:
                    stream.close()
                    made.append((f"{folder}/{name}", size, count))
                    stream = None
        if stream is not None:
            stream.close()
            made.append((f"{folder}/{name}", size, count))
        columns = list(zip(*made, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["file", "bytes", "records"])

    return write


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_SHARED, archive_bytes: int = ARCHIVE_BYTES, compressed: bool = True) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) below ``folder``; the manifest.

    Of rows with equal payloads of at least ``least`` bytes, those with the smallest page_id
    are responses (all rows with that id, should it be repeated), the others revisits of it.
    Rows without a page_id are revisits where another has one, else responses. A null html
    is an empty payload. Other columns are not written. No rows, no archives.
    """
    system, path = open_folder(folder)
    system.create_dir(path, recursive=True)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html",
        F.sha2(F.coalesce(F.col("html"), F.lit("")), 256).alias("digest"),
        (F.octet_length(F.coalesce(F.col("html"), F.lit(""))) >= least).alias("shareable"),
    )
    first = (
        rows.where("shareable").groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    )
    first = stored(first, "payloads")
    joined = rows.join(first, "digest", "left")
    refers = F.when(F.col("shareable") & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    ready = joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))
    return stored(ready.mapInArrow(_writer(folder, archive_bytes, compressed), MANIFEST), "manifest")


class Damaged(ValueError):
    """A check that a record failed."""


class _Window:
    """Random access to a file through one buffer, for a reader that moves forwards."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size, self.at, self.data = file, file.size(), 0, b""

    def read(self, start: int, count: int) -> bytes:
        count = max(0, min(count, self.size - start))
        if start < self.at or start + count > self.at + len(self.data):
            self.at = start
            self.data = self.file.read_at(min(max(count, READ), self.size - start), start)
        return self.data[start - self.at : start - self.at + count]

    def find(self, pattern: re.Pattern[bytes], start: int) -> int:
        """Where the pattern (of at most 16 bytes) next occurs, or the size."""
        while start < self.size:
            data = self.read(start, READ)
            if hit := pattern.search(data):
                return start + hit.start()
            if start + len(data) >= self.size:
                return self.size
            start += len(data) - 15
        return self.size


def _inflate(window: _Window, start: int, most: int | None = None) -> tuple[bytes, int]:
    """The content of the gzip member at ``start`` and where it ends, or its first ``most`` bytes."""
    packer, parts, at, total = zlib.decompressobj(31), [], start, 0
    while not packer.eof:
        data = window.read(at, READ)
        if not data:
            raise Damaged("truncated member")
        try:
            part = packer.decompress(data) if most is None else packer.decompress(data, most - total)
        except zlib.error as error:
            raise Damaged(f"bad member: {str(error)[:60]}") from None
        parts.append(part)
        total += len(part)
        at += len(data) - len(packer.unused_data)
        if most is not None and total >= most:
            break
    return b"".join(parts), at


def _headers(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    if not VERSION.match(lines[0] + b"\r\n"):
        raise Damaged("no version line")
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Damaged("bad header line")
        out[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not out.get("content-length", "").isdigit() or "warc-type" not in out:
        raise Damaged("no length or type")
    return out


def _head_at(window: _Window, start: int, compressed: bool) -> tuple[dict[str, str], int]:
    """Headers of the record at ``start`` and their length with the empty line."""
    size = 1 << 13
    while True:
        head = _inflate(window, start, size)[0] if compressed else window.read(start, size)
        if not VERSION.match(head[:10]):
            raise Damaged("no version line")
        end = head.find(b"\r\n\r\n")
        if end >= 0:
            return _headers(head[:end]), end + 4
        if len(head) < size:
            raise Damaged("no end of headers")
        # No limit on a header, but what is none ends early.
        if not all(b":" in line for line in head.split(b"\r\n")[1:-1]):
            raise Damaged("bad header line")
        size *= 4


def _record_at(window: _Window, start: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``start``; raises Damaged."""
    compressed = window.read(start, 3) == MAGIC
    headers, head = _head_at(window, start, compressed)
    length = int(headers["content-length"])
    if compressed:
        data, end = _inflate(window, start)
        if len(data) != head + length + 4:
            raise Damaged("length differs")
    else:
        if start + head + length + 4 > window.size:
            raise Damaged("truncated record")
        data, end = window.read(start, head + length + 4), start + head + length + 4
    block, closing = data[head : head + length], data[head + length :]
    if closing != b"\r\n\r\n":
        raise Damaged("no closing lines")
    stated = headers.get("warc-block-digest", "")
    if stated.startswith("sha1:") and stated != _sha1(block):
        raise Damaged("block digest differs")
    return headers, block, end


_CANDIDATE = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r\n")


def _next_valid(window: _Window, start: int) -> int:
    """The next place where a member or version line starts a valid header."""
    while (start := window.find(_CANDIDATE, start)) < window.size:
        try:
            _head_at(window, start, window.read(start, 3) == MAGIC)
            return start
        except Damaged:
            start += 1
    return window.size


def _whole_number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d{1,18}|-?9\d{18}", text) else None


def salvage(window: _Window) -> Iterator[dict]:
    """Records in order, and gaps for all bytes that belong to none."""
    at, bad, reason = 0, None, ""
    while at < window.size:
        try:
            headers, block, end = _record_at(window, at)
            payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
            kind = headers["warc-type"]
            algorithm, _, digest = headers.get("warc-payload-digest", "").partition(":")
            if kind == "response" and algorithm == "sha256" and hashlib.sha256(payload).hexdigest() != digest:
                raise Damaged("payload digest differs")
        except Damaged as damage:
            if bad is None:
                bad, reason = at, str(damage)
            at = _next_valid(window, at + 1)
            continue
        if bad is not None:
            yield {"start": bad, "end": at, "kind": "gap", "reason": reason}
            bad = None
        full = kind != "revisit"
        yield {
            "start": at, "end": end, "kind": "record", "record_type": kind, "page_id": _whole_number(headers.get("x-page-id")),
            "target_uri": headers.get("warc-target-uri"),
            "payload_digest": digest if algorithm == "sha256" else hashlib.sha256(payload).hexdigest() if full else None,
            "payload_bytes": len(payload) if full else _whole_number(headers.get("x-payload-length")),
            "refers_to": _whole_number(headers.get("x-refers-to-page-id")), "payload": payload if full else None,
        }
        at = end
    if bad is not None:
        yield {"start": bad, "end": window.size, "kind": "gap", "reason": reason}


def _reader(payloads: bool, strict: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, records in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist(), strict=True):
                system, path = open_folder(name)
                rows, held, count = [], 0, 0
                with system.open_input_file(path) as file:
                    for row in salvage(_Window(file)):
                        if strict and row["kind"] == "gap":
                            raise ValueError(f"{name}: gap from {row['start']} to {row['end']}: {row['reason']}")
                        count += 1
                        held += len(row.get("payload") or b"") + 200
                        row["file"] = name
                        if not payloads:
                            row.pop("payload", None)
                        rows.append(row)
                        if held > 8_000_000 or len(rows) >= 10_000:
                            yield _batch(rows)
                            rows, held = [], 0
                if strict and count != records:
                    raise ValueError(f"{name}: {count} records, {records} in the manifest")
                yield _batch(rows)

    return read


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(_NAMES, _KINDS, strict=True)], _NAMES)


def read_archives(manifest: DataFrame, payloads: bool = True, strict: bool = False) -> DataFrame:
    """A row per record and per quarantined gap (``kind``) of the files in ``manifest.file``.

    Files may be gzip members, plain records, or a mixture after damage. Gaps have their
    bytes in ``start`` and ``end`` and the first failed check in ``reason``. ``strict`` is
    for archives that must be whole: a gap, or another number of records than
    ``manifest.records``, is an error.
    """
    files = manifest.select("file", F.col("records") if strict else F.lit(None).cast("long").alias("records"))
    # One file per task: the files are few and large, and their names are all that moves.
    spread = files.repartition(max(1, min(files.count(), 100_000)), "file")
    return spread.mapInArrow(_reader(payloads, strict), RECORD)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages written to archives in the shared folder and read back from them."""
    manifest = write_archives(pages, scratch_path(spark, "archives"))
    return read_archives(manifest, payloads=False, strict=True)
