"""The texts of very many files, listed and read in tasks.

Spark's own reader counts each file as some MB when it plans its tasks, so a million small
files are tens of thousands of tasks, and the driver holds every path. Here tasks list the
folders and read the files, which are dealt out by path. The rows are those of Spark's
reader. It still reads what only it can: file systems that tasks cannot open, patterns of
paths, compressed files, folders of partitions; and all where there is no scratch folder.
"""

from __future__ import annotations

import os
import posixpath
import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobquarry.session import stored
from jobquarry.sources.files import opens_in_tasks, task_files

LISTED = "file_path string, size long, folder boolean"
#: Paths, and files, in one batch; bytes of files after which a batch is handed on.
PATHS, TEXTS, TEXT_BYTES = 10_000, 1_000, 4 << 20
#: Tasks over which folders are dealt for listing.
FOLDER_TASKS = 64
#: Files, and bytes of them, that one task reads.
TASK_FILES, TASK_BYTES = 4_000, 16 << 20
#: Endings that Spark's reader takes for compressed files.
COMPRESSED = r"\.(gz|gzip|bz2|deflate|lz4|snappy|zst|zstd|passthrough)$"


def _hidden(name: str) -> bool:
    """Names that Spark's sources leave out."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def _encoded(name: str) -> str:
    """A name as it stands in a path that Spark gives: other letters stay, blanks and signs do not."""
    kept = (c if ord(c) > 127 and unicodedata.category(c)[0] not in "ZC" else quote(c, safe="-_.!~'()*:@&=+$,;", errors="surrogateescape") for c in name)
    return "".join(kept) if not re.fullmatch(r"[\w.-]*", name, re.ASCII) else name


def _entries(uri: str) -> Iterator[tuple[str, bool, int]]:
    """Name, whether it is a folder, and size of what a folder holds; a local one is never held whole."""
    system, path = task_files(uri)
    if not isinstance(system, fs.LocalFileSystem):
        for found in system.get_file_info(fs.FileSelector(path)):
            yield found.base_name, found.type == fs.FileType.Directory, found.size or 0
        return
    with os.scandir(path) as entries:
        for entry in entries:
            try:
                yield entry.name, entry.is_dir(), entry.stat().st_size
            except FileNotFoundError:  # gone meanwhile, or a link to nothing
                continue


def _walk(uri: str, suffix: str, recursive: bool, levels: int | None) -> Iterator[tuple[str, int, bool]]:
    """The files below a folder, and the folders ``levels`` below it, which are not looked into."""
    waiting = [(uri.rstrip("/"), 1)]
    while waiting:
        folder, level = waiting.pop()
        for name, is_folder, size in _entries(folder):
            if _hidden(name):
                continue
            path = f"{folder}/{_encoded(name)}"
            if not is_folder:
                if name.endswith(suffix):
                    yield path, size, False
            elif recursive and (levels is None or level < levels):
                waiting.append((path, level + 1))
            elif recursive or "=" in name:
                yield path, 0, True


def _listed(folders: DataFrame, suffix: str, recursive: bool, levels: int | None = None) -> DataFrame:
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, int, bool]] = []
            for uri in batch.column(0).to_pylist():
                for row in _walk(uri, suffix, recursive, levels):
                    rows.append(row)
                    if len(rows) >= PATHS:
                        yield as_batch(rows)
                        rows = []
            if rows:
                yield as_batch(rows)

    def as_batch(rows: list[tuple[str, int, bool]]) -> pa.RecordBatch:
        paths, sizes, kinds = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(kinds, pa.bool_())], ["file_path", "size", "folder"]
        )

    return folders.select("file_path").mapInArrow(listed, LISTED)


def _roots(spark: SparkSession, path: str | list[str]) -> list[tuple[str, int, bool]] | None:
    """The paths as Spark's file system gives them, or none where tasks cannot list them."""
    jvm, roots = spark._jvm, []
    for given in [path] if isinstance(path, str) else path:
        if re.search(r"[*?\[\]{}\\]", given) or not opens_in_tasks(given):
            return None
        where = jvm.org.apache.hadoop.fs.Path(given)
        system = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if not system.exists(where):
            return None
        status = system.getFileStatus(where)
        uri = re.sub("^file:/+", "file:/", status.getPath().toUri().toString())
        if not opens_in_tasks(uri) or _hidden(posixpath.basename(uri)):
            return None
        roots.append((uri, status.getLen(), status.isDirectory()))
    return roots


def list_files(spark: SparkSession, path: str | list[str], suffix: str = "", recursive: bool = False) -> DataFrame | None:
    """``file_path`` and ``size`` of the files with bytes in them, as a stored table; none: Spark has to read them.

    Tasks list the first two levels of folders, a root each, and then what lies below.
    """
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        return None
    roots = _roots(spark, path)
    if roots is None:
        return None
    given = spark.createDataFrame(roots, LISTED)
    top = stored(
        given.where("NOT folder").where(F.col("file_path").endswith(suffix)).union(
            _listed(given.where("folder").repartition(max(1, len(roots))), suffix, recursive, 2)
        ),
        "files",
    )
    odd = top.agg(F.coalesce(F.max("folder"), F.lit(False)), F.coalesce(F.max(F.col("file_path").rlike(COMPRESSED)), F.lit(False))).first()
    if odd[1] or (odd[0] and not recursive):
        return None
    if not odd[0]:
        return top.where("size > 0").select("file_path", "size")
    files = top.where("NOT folder").union(_listed(top.where("folder").repartition(FOLDER_TASKS, "file_path"), suffix, recursive))
    files = stored(files.where("size > 0").select("file_path", "size"), "files")
    return None if files.where(F.col("file_path").rlike(COMPRESSED)).limit(1).count() else files


def dealt(files: DataFrame) -> DataFrame:
    """The files over as many tasks as their number and ``size`` ask for.

    By a count of its own: the paths are so few bytes that Spark would put them into one task.
    """
    count, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return files.repartition(max(1, -(-count // TASK_FILES), -(-size // TASK_BYTES)), "file_path")


def read_files(files: DataFrame) -> DataFrame:
    """``file_path`` and ``value``, the whole text of each file. A task reads its files one by one."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: list[str] = []
        contents: list[bytes] = []
        held = 0
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = task_files(uri)
                with system.open_input_stream(path) as stream:
                    content = stream.read()
                paths.append(uri)
                contents.append(content)
                held += len(content)
                if held >= TEXT_BYTES or len(paths) >= TEXTS:
                    yield as_batch(paths, contents)
                    paths, contents, held = [], [], 0
        if paths:
            yield as_batch(paths, contents)

    def as_batch(paths: list[str], contents: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["file_path", "content"])

    read = dealt(files).select("file_path").mapInArrow(texts, "file_path string, content binary")
    return read.select("file_path", F.col("content").cast("string").alias("value"))


def whole_files(spark: SparkSession, path: str | list[str], suffix: str = "", recursive: bool = False) -> DataFrame:
    """``file_path`` and ``value`` of all files in a folder, or at any depth below it."""
    files = list_files(spark, path, suffix, recursive)
    if files is not None:
        return read_files(files)
    reader = spark.read.option("recursiveFileLookup", recursive)
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), "value")
