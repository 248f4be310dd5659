"""Which pages still have to be fetched, given those that have landed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobquarry.functions.urls import page_file_name

SKIP, FETCH, NO_URL = "skip", "fetch", "no_url"


def with_file_name(jobs: DataFrame, url: str = "url", job_id: str | None = "job_id") -> DataFrame:
    id_column = F.col(job_id) if job_id else None
    return jobs.withColumn("file_name", page_file_name(F.col(url), id_column))


def _names(df: DataFrame) -> DataFrame:
    """The distinct file names of a frame, ready for a join with a skewed side.

    Adaptive execution splits a skewed join only if both sides come straight from a
    shuffle on the join key. A plain distinct would already be partitioned that way and
    go in without one, so the names are made distinct together with their hash.
    """
    return df.select("file_name", F.xxhash64("file_name").alias("_hash")).distinct().drop("_hash")


def download_plan(jobs: DataFrame, landed: DataFrame, url: str = "url") -> DataFrame:
    """Rows of ``jobs`` (with ``file_name``) and what to do with each.

    The landed side is one row per file name, so the join cannot multiply rows and only
    the jobs side can be skewed, which adaptive execution splits.
    """
    names = _names(landed).withColumn("_landed", F.lit(True))
    has_url = F.coalesce(F.col(url) != "", F.lit(False))
    return jobs.join(names, "file_name", "left").select(
        *jobs.columns,
        F.when(~has_url, F.lit(NO_URL))
        .when(F.col("_landed").isNotNull(), F.lit(SKIP))
        .otherwise(F.lit(FETCH))
        .alias("status"),
    )


def skip_existing(jobs: DataFrame, landed: DataFrame) -> DataFrame:
    """Rows whose page has not landed yet."""
    return jobs.join(_names(landed), "file_name", "left_anti")


def download_summary(plan: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Successful (skipped ones included), failed and total rows of a finished plan.

    ``failed`` holds the file names that could not be fetched; without it every planned
    fetch counts as done.
    """
    fetch_failed = F.lit(False)
    if failed is not None:
        names = _names(failed).withColumn("_failed", F.lit(True))
        plan = plan.join(names, "file_name", "left")
        fetch_failed = (F.col("status") == FETCH) & F.col("_failed").isNotNull()
    lost = (F.col("status") == NO_URL) | fetch_failed
    return plan.agg(
        F.count_if(~lost).alias("success_count"),
        F.count_if(lost).alias("failed_count"),
        F.count(F.lit(1)).alias("total_count"),
    )
