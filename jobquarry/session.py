"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import uuid
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "jobquarry", **conf: str) -> SparkSession:
    """A session with the settings the jobs here are written for.

    Nothing in the package needs them to be right: they only bound the size of the
    Arrow batches sent to Python and of the scan tasks that parse HTML.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Pages vary from 1 KB to many MB, so batches are bounded by bytes, not rows.
        "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
        "spark.sql.files.maxPartitionBytes": "64m",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    Raises where the session names none: a machine-local folder would be missing on
    other machines.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again, with its lineage cut."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_file(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a shared file, for reading it inside a task."""
    local = re.sub(r"^file:/+", "/", uri)
    return (fs.LocalFileSystem(), unquote(local)) if local.startswith("/") else fs.FileSystem.from_uri(uri)
