"""Snapshot trees ``root/company/snapshot/...``, looked into company by company.

The driver lists the names of the companies, and nothing else. Tasks list each company's
folder (names only), the newest snapshots are settled by an aggregate, and only those
folders are ever opened: what older snapshots hold is not listed, however much it is, and
a newest snapshot counts even where it holds no file.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from jobquarry.sources.files import opens_in_tasks, task_files
from jobquarry.sources.many import TEXT_BYTES, dealt

#: Companies that one task lists.
COMPANIES_PER_TASK = 64
FOLDERS = "company string, snapshot string, folder string"


class _Companies(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(0)
        self.names = names


class FolderReader(DataSourceReader):
    """The folders two levels below a root; one listing here, one per company in the tasks."""

    def __init__(self, root: str, per_task: int):
        self.root, self.per_task = root, per_task

    def _below(self, *names: str) -> list[fs.FileInfo]:
        system, top = task_files(self.root)
        return [f for f in system.get_file_info(fs.FileSelector(posixpath.join(top, *names))) if f.type == fs.FileType.Directory]

    def partitions(self) -> list[_Companies]:
        names = sorted(f.base_name for f in self._below())
        return [_Companies(names[i : i + self.per_task]) for i in range(0, len(names), self.per_task)] or [_Companies([])]

    def read(self, partition: _Companies) -> Iterator[tuple[str, str, str]]:
        for company in partition.names:
            for folder in self._below(company):
                yield company, folder.base_name, posixpath.join(self.root, company, folder.base_name)


class SnapshotFolders(DataSource):
    """``spark.read.format("snapshot_folders").load(root)``: company, snapshot, folder."""

    @classmethod
    def name(cls) -> str:
        return "snapshot_folders"

    def schema(self) -> str:
        return FOLDERS

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options["path"].rstrip("/"), int(self.options.get("companiesPerTask", COMPANIES_PER_TASK)))


def snapshot_folders(spark: SparkSession, root: str) -> DataFrame:
    """Company and snapshot folders below a root; their contents are not listed.

    On file systems that only Spark's JVM knows, the driver asks it for the same names.
    """
    if opens_in_tasks(root):
        spark.dataSource.register(SnapshotFolders)
        return spark.read.format("snapshot_folders").load(root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "*/*")) or []
    folders = [f.getPath() for f in found if f.isDirectory()]
    return spark.createDataFrame([(f.getParent().getName(), f.getName(), f.toString()) for f in folders], FOLDERS)


def folder_files(folders: DataFrame, folder: str, suffix: str, *keep: str) -> DataFrame:
    """Files anywhere below the folders, a row each: ``keep``, file_path, size. Listed in tasks."""
    kept = [f for f in folders.schema if f.name in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "file_path string, size long"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, uri in enumerate(batch.column(0).to_pylist()):
                system, path = task_files(uri)
                files = [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.base_name.endswith(suffix)]
                # Hidden files and folders are what Spark's sources leave out, too.
                files = [f for f in files if not any(p.startswith((".", "_")) for p in posixpath.relpath(f.path, path).split("/"))]
                if files:
                    same = [batch.column(c + 1).take(pa.array([i] * len(files))) for c in range(len(kept))]
                    paths = [uri.rstrip("/") + "/" + posixpath.relpath(f.path, path) for f in files]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(paths), pa.array([f.size for f in files], pa.int64())], names)

    names = [*(f.name for f in kept), "file_path", "size"]
    return folders.select(F.col(folder), *(f.name for f in kept)).mapInArrow(listed, schema)


def file_texts(files: DataFrame, *keep: str) -> DataFrame:
    """``keep``, file_path and document: the text of each file, read in tasks.

    Files are dealt over the tasks one by one, so a company with very many is no one task's.
    Texts are handed on some at a time.
    """
    kept = [f for f in files.schema if f.name in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "file_path string, document string"])
    names = [*(f.name for f in kept), "file_path", "document"]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, found, held = 0, [], 0
            for i, uri in enumerate(batch.column("file_path").to_pylist()):
                system, path = task_files(uri)
                with system.open_input_stream(path) as stream:
                    content = stream.read()
                found.append(content.decode("utf-8", "replace"))
                held += len(content)
                if held >= TEXT_BYTES or i + 1 == batch.num_rows:
                    same = batch.slice(start, len(found))
                    yield pa.RecordBatch.from_arrays([*same.columns, pa.array(found, pa.string())], names)
                    start, found, held = i + 1, [], 0

    return dealt(files).select(*(f.name for f in kept), "file_path").mapInArrow(texts, schema)
