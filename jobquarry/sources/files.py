"""Files read, written and listed inside tasks, where Spark has no reader or writer for them.

Spark's own sources stay the way for tables. These are for one file per row (page dumps,
envelopes), and for looking into folders without listing all that lies below.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Schemes that tasks can open, by the name the file library knows them under.
TASK_SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def scheme_of(uri: str) -> str:
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):/", uri)
    return found[1].lower() if found else "file"


def opens_in_tasks(uri: str) -> bool:
    """Whether tasks can open such a path; any other only Spark's own readers can."""
    return scheme_of(uri) in TASK_SCHEMES


def task_files(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file, for use inside a task."""
    scheme = scheme_of(uri)
    if scheme not in TASK_SCHEMES:
        raise ValueError(f"tasks cannot open {scheme}: paths")
    if scheme == "file":
        return fs.LocalFileSystem(), unquote(re.sub(r"^file:/+", "/", uri)) if uri.startswith("file:") else uri
    return fs.FileSystem.from_uri(re.sub(r"^[^:]*", TASK_SCHEMES[scheme], uri))


def write_files(df: DataFrame, root: str, name: Column, content: Column) -> int:
    """One file per row below ``root``; ``name`` may hold folders. Returns how many.

    A file is written under another name and then moved, so a task that is run again
    replaces whole files by whole files. Names must be unique, and stay below the root.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = task_files(root)
        count, made = 0, set()
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not name or name.startswith("/") or posixpath.normpath(f"/{name}") != f"/{name}":
                    raise ValueError(f"no file name: {name!r}")
                path = posixpath.join(top, name)
                folder, base = posixpath.split(path)
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{folder}/.{base}.part") as out:
                    out.write((content or "").encode())
                system.move(f"{folder}/.{base}.part", path)
                count += 1
        yield pa.RecordBatch.from_pydict({"written": [count]})

    written = df.select(name.cast("string").alias("name"), content.cast("string").alias("content")).mapInArrow(write, "written long")
    return written.agg(F.coalesce(F.sum("written"), F.lit(0))).first()[0]
