"""Stored pages to posting files, rejects and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from jobquarry.config import PatternConfig
from jobquarry.operators.postings import MISSING_FIELDS, OK, extract_postings
from jobquarry.operators.quality import RAISE_ERROR, SKIP_RECORD, USE_DEFAULT, violations
from jobquarry.schema import REQUIRED_FIELDS, field_default
from jobquarry.sources.writers import write_postings

#: A posting that breaks rules of the ``validation`` section, where those set it aside.
INVALID = "invalid"
KEEP = "log_warning"


def judge(extracted: DataFrame, config: PatternConfig) -> DataFrame:
    """The reactions of ``error_handling`` to extracted rows, with their ``violations``.

    ``missing_required_fields`` is for rows without a key field: ``skip_record`` (the
    default) leaves them among the rejects, ``use_default`` makes them postings with the
    default of each such field, ``raise_error`` ends the job. ``invalid_fields`` is for
    postings that break a rule of ``validation``: ``log_warning`` (the default) keeps them
    and names the rules, ``skip_record`` rejects them, ``raise_error`` ends the job.
    """
    handling = config.section("error_handling")
    missing = handling.get("missing_required_fields") or SKIP_RECORD
    invalid = handling.get("invalid_fields") or KEEP
    if missing not in (SKIP_RECORD, USE_DEFAULT, RAISE_ERROR) or invalid not in (KEEP, SKIP_RECORD, RAISE_ERROR):
        raise ValueError(f"unknown reaction among {missing!r}, {invalid!r}")
    lacks, status = F.col("status") == MISSING_FIELDS, F.col("status")
    rows = extracted
    if missing == USE_DEFAULT:
        filled = {name: F.when(lacks & (F.coalesce(F.col(name), F.lit("")) == ""), field_default(name)).otherwise(F.col(name)) for name in REQUIRED_FIELDS}
        rows = rows.withColumns({**filled, "status": F.when(lacks, F.lit(OK)).otherwise(status)})
    elif missing == RAISE_ERROR:
        stop = F.raise_error(F.concat(F.lit("a page lacks a key field: "), F.to_json(F.struct(*REQUIRED_FIELDS))))
        rows = rows.withColumn("status", F.when(lacks, stop.cast("string")).otherwise(status))
    rows = violations(rows, config)
    broken = (status == OK) & (F.size("violations") > 0)
    if invalid == SKIP_RECORD:
        named = F.when(broken, F.array_join("violations", ",")).otherwise(F.col("failure"))
        rows = rows.withColumns({"failure": named, "status": F.when(broken, F.lit(INVALID)).otherwise(status)})
    elif invalid == RAISE_ERROR:
        stop = F.raise_error(F.concat(F.lit("rules broken: "), F.array_join("violations", ",")))
        rows = rows.withColumn("status", F.when(broken, stop.cast("string")).otherwise(status))
    return rows


def process_pages(
    pages: DataFrame, config: PatternConfig, path: str, *keep: str, **options
) -> DataFrame:
    """Extract all pages once, write postings and rejects, return the counts.

    The judged rows are written first and read back for the outputs: pages are parsed
    exactly once, and a lost executor costs its own tasks only. The counts are observed
    by that write. It shuffles nothing, so each task reports when its rows are done, and a
    task that is run again counts once. ``postings`` holds JSON lines, ``rejected`` the
    other rows with their status and failure, ``violations`` the rules that postings break.
    """
    spark = pages.sparkSession
    staged = f"{path}/extracted"
    ok = F.col("status") == OK
    counts = Observation()
    judged = judge(extract_postings(pages, config, *keep, **options), config).observe(
        counts, F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.count(F.lit(1)).alias("total")
    )
    judged.write.mode("errorifexists").parquet(staged)
    extracted = spark.read.parquet(staged)
    write_postings(extracted.where(ok), f"{path}/postings", *keep)
    extracted.where(~ok).select(*keep, "status", "failure").write.json(f"{path}/rejected")
    extracted.where(ok & (F.size("violations") > 0)).select(*keep, "violations").write.json(f"{path}/violations")
    found = counts.get
    row = tuple(int(found.get(name) or 0) for name in ("successful", "failed", "total"))
    return spark.createDataFrame([row], "successful long, failed long, total long")
