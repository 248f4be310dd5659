"""Listing rows to validated, deduplicated postings-to-fetch, with counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from jobquarry.config import PatternConfig
from jobquarry.functions.urls import UrlRule
from jobquarry.operators.dedup import dedup_job_id
from jobquarry.sources.writers import write_processed

# Listing fields carried over, and fields taken from the URL.
LISTING_COLUMNS = [
    "title", "location", "department", "job_type", "posted_date", "company", "source_url",
]
URL_COLUMNS = ["job_id", "team", "job_title"]


def validate_urls(rows: DataFrame, config: PatternConfig, url: str = "url") -> DataFrame:
    """Adds ``valid`` and ``extracted_fields`` (null for an invalid URL)."""
    rule = UrlRule.of(F.col(url), config.require("url_validation").url_validation)
    pairs = [part for name, column in rule.fields.items() for part in (F.lit(name), column)]
    fields = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return rows.withColumn("valid", rule.valid).withColumn(
        "extracted_fields", F.when(F.col("valid"), fields)
    )


def processed_rows(valid: DataFrame, *keep: str) -> DataFrame:
    """Listing fields and URL fields side by side; absent ones are ''."""
    field = lambda name: (
        F.when(F.map_contains_key("extracted_fields", name), F.col("extracted_fields")[name])
        .otherwise(F.lit(""))
        .alias(name)
    )
    listing = lambda name: (
        F.coalesce(F.col(name), F.lit("")) if name in valid.columns else F.lit("")
    ).alias(name)
    metadata = (
        F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>"))
        if "metadata" in valid.columns
        else F.create_map().cast("map<string,string>")
    )
    return valid.select(
        *keep,
        "url",
        *map(field, URL_COLUMNS),
        *map(listing, LISTING_COLUMNS),
        metadata.alias("metadata"),
        "extracted_fields",
    )


def process_urls(rows: DataFrame, config: PatternConfig, *order: str) -> DataFrame:
    """Valid rows, first per job id in the given order. One shuffle, on the job id."""
    valid = validate_urls(rows, config).where("valid")
    return dedup_job_id(processed_rows(valid, *order), *order)


def processing_stats(rows: DataFrame, config: PatternConfig) -> DataFrame:
    """original, valid, invalid, duplicate and final counts without the rows themselves.

    ``final`` is the number of distinct ids plus the rows without one, so only ids are
    shuffled, reduced per task first.
    """
    checked = validate_urls(rows, config)
    job_id = F.when(F.col("valid"), F.col("extracted_fields")["job_id"])
    has_id = F.coalesce(job_id != "", F.lit(False))
    counts = checked.select("valid", F.when(has_id, job_id).alias("_id")).agg(
        F.count(F.lit(1)).alias("original_count"),
        F.count_if("valid").alias("valid_count"),
        (F.countDistinct("_id") + F.count_if(F.col("valid") & F.col("_id").isNull())).alias(
            "final_count"
        ),
    )
    return counts.select(
        "original_count",
        "valid_count",
        (F.col("original_count") - F.col("valid_count")).alias("invalid_count"),
        (F.col("valid_count") - F.col("final_count")).alias("duplicate_count"),
        "final_count",
    )


def processed_header(stats: DataFrame, source_url: str, company: str, pages_crawled: int) -> DataFrame:
    """The one-row summary that goes with the processed rows."""
    return stats.select(
        F.lit(source_url).alias("source_url"),
        F.col("original_count").alias("original_total_jobs"),
        F.col("final_count").alias("processed_total_jobs"),
        F.struct(*stats.columns).alias("processing_stats"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(
            "processing_timestamp"
        ),
        F.lit(company).alias("company_name"),
        F.lit(pages_crawled).cast("long").alias("total_pages_crawled"),
    )


def run_process_urls(
    rows: DataFrame, config: PatternConfig, path: str, source_url: str, pages_crawled: int, *order: str
) -> DataFrame:
    """Validate, deduplicate and write listing rows, counting them on the way; returns the summary.

    The input is read once. Two writes without a shuffle behind their counting points
    observe the counts, so tasks and stages that are run again count once: the valid rows
    (original and valid counts), then the first row of each job id (the final count).
    """
    spark = rows.sparkSession
    seen, kept = Observation(), Observation()
    checked = validate_urls(rows, config).observe(
        seen, F.count(F.lit(1)).alias("original"), F.count_if("valid").alias("valid")
    )
    processed_rows(checked.where("valid"), *order).write.mode("errorifexists").parquet(f"{path}/valid")
    firsts = dedup_job_id(spark.read.parquet(f"{path}/valid"), *order)
    firsts = firsts.observe(kept, F.count(F.lit(1)).alias("final"))
    firsts.write.mode("errorifexists").parquet(f"{path}/firsts")
    original, valid, final = (int(o.get.get(n) or 0) for o, n in ((seen, "original"), (seen, "valid"), (kept, "final")))
    stats = spark.createDataFrame(
        [(original, valid, original - valid, valid - final, final)],
        "original_count long, valid_count long, invalid_count long, duplicate_count long, final_count long",
    )
    header = processed_header(stats, source_url, config.company_name, pages_crawled)
    write_processed(spark.read.parquet(f"{path}/firsts"), header, path)
    return header
