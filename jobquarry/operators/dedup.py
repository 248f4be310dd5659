"""First-wins deduplication, run merging and crawl statistics.

Every operator here stays whole and even under a hot key: rows are reduced on the map
side (limit-1 window groups or partial aggregates) before any shuffle, so a key that
holds a third of all rows sends one row per map task to its reducer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobquarry.session import stored

# Fixed value: as many empty pages in a row end a crawl.
MAX_EMPTY_PAGES = 5


def first_rows(df: DataFrame, key: Column | list[Column], *order: str) -> DataFrame:
    """The first row of every key in the given order.

    ``row_number() = 1`` is planned with a group limit before the shuffle, unlike
    ``dropDuplicates``, which would keep an arbitrary row.
    """
    keys = key if isinstance(key, list) else [key]
    ranked = df.withColumn(
        "_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    )
    return ranked.where(F.col("_place") == 1).drop("_place")


def dedup_url(links: DataFrame, *order: str, url: str = "url") -> DataFrame:
    return first_rows(links, F.col(url), *order)


def dedup_job_id(rows: DataFrame, *order: str, job_id: str = "job_id") -> DataFrame:
    """First row per job id; rows without an id are all kept.

    Those rows are keyed by their own order values, which also spreads them.
    """
    has_id = F.coalesce(F.col(job_id) != "", F.lit(False))
    own = F.when(~has_id, F.struct(*order))
    return first_rows(rows, [F.when(has_id, F.col(job_id)), own], *order)


def resume_merge(
    existing: DataFrame, new: DataFrame, *order: str, url: str = "url"
) -> DataFrame:
    """An earlier crawl followed by the new crawl's rows with unseen URLs.

    Both sides of the anti join are reduced to one row per URL before it.
    """
    fresh = dedup_url(new, *order, url=url)
    seen = existing.select(url).distinct()
    return existing.unionByName(fresh.join(seen, url, "left_anti"), allowMissingColumns=True)


def union_runs(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Both runs with all their rows; ``run`` tells which came first."""
    return existing.withColumn("run", F.lit(0)).unionByName(
        new.withColumn("run", F.lit(1)), allowMissingColumns=True
    )


def crawl_order(links: DataFrame, *order: str) -> DataFrame:
    """Rows in page and element order, range-partitioned by Spark's sort."""
    return links.orderBy(*order)


def crawl_summary(links: DataFrame, *source: str, url: str = "url", page: str = "page_number") -> DataFrame:
    return links.groupBy(*source).agg(
        F.countDistinct(url).alias("total_jobs"),
        F.countDistinct(page).alias("total_pages_crawled"),
    )


def page_counts(links: DataFrame, page: str, *, url: str = "url") -> DataFrame:
    """Links per page, and how many of them no earlier page had.

    A URL is new on the lowest page that has it, so an aggregate finds it; no window
    has to gather all rows of a URL that is on every page.
    """
    found = links.groupBy(page).agg(F.count(F.lit(1)).alias("jobs_found"))
    new = (
        links.groupBy(url)
        .agg(F.min(page).alias(page))
        .groupBy(page)
        .agg(F.count(F.lit(1)).alias("jobs_new"))
    )
    return found.join(new, page, "left").select(
        page, "jobs_found", F.coalesce("jobs_new", F.lit(0)).cast("long").alias("jobs_new")
    )


def empty_page_runs(
    pages: DataFrame,
    crawl: str,
    page_number: str,
    job_count: str,
    *keep: str,
    limit: int = MAX_EMPTY_PAGES,
) -> DataFrame:
    """Length of the run of empty pages that each page ends, per crawl.

    Rows are cut into chunks by their rank in (crawl, page number), as Spark's range
    partitioning deals them, so one huge crawl is not one task, however far apart its page
    numbers lie. Runs are counted inside each chunk of a crawl, then one row per chunk
    carries the open run over the border. Page numbers must be whole numbers, unique
    within a crawl.
    """
    ranged = pages.select(
        crawl,
        page_number,
        *keep,
        (F.coalesce(F.col(job_count), F.lit(0)) == 0).alias("is_empty"),
    ).repartitionByRange(crawl, page_number)
    # Stored, so that every later step sees the same chunks.
    flagged = stored(ranged.withColumn("_chunk", F.spark_partition_id()), "ranged")
    inside = Window.partitionBy(crawl, "_chunk").orderBy(page_number)
    local = flagged.withColumn("_at", F.row_number().over(inside)).withColumn(
        "_filled_at",
        F.max(F.when(~F.col("is_empty"), F.col("_at"))).over(
            inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ),
    )

    # One row per chunk: where it starts within its crawl, and where the last page with
    # jobs before it stands. The gap between the two is the run carried into it.
    before = (
        Window.partitionBy(crawl).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        local.groupBy(crawl, "_chunk")
        .agg(F.max("_at").cast("long").alias("_size"), F.max("_filled_at").alias("_last"))
        .withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .withColumn("_filled", F.max(F.col("_start") + F.col("_last")).over(before))
        .withColumn("_carry", F.col("_start") - F.coalesce("_filled", F.lit(0)))
        .select(crawl, "_chunk", "_carry")
    )
    since_filled = F.when(F.col("_filled_at").isNotNull(), F.col("_at") - F.col("_filled_at"))
    run = F.when(F.col("is_empty"), F.coalesce(since_filled, F.col("_carry") + F.col("_at")))
    carried = carried.select(F.col(crawl).alias("_crawl"), F.col("_chunk").alias("_piece"), "_carry")
    # Null crawls and page numbers are a crawl and a chunk of their own.
    same = F.col(crawl).eqNullSafe(F.col("_crawl")) & F.col("_chunk").eqNullSafe(F.col("_piece"))
    return local.join(carried, same).select(
        crawl,
        page_number,
        *keep,
        "is_empty",
        F.coalesce(run, F.lit(0)).cast("long").alias("empty_run"),
        (F.coalesce(run, F.lit(0)) >= limit).alias("limit_reached"),
    )
