"""Readers for listings, page dumps, posting files and snapshot trees."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobquarry.functions.json_types import is_json, one_value
from jobquarry.schema import LISTING_SCHEMA, POSTING_SCHEMA, conform_postings
from jobquarry.session import stored
from jobquarry.sources.envelopes import BAD_ENVELOPE, NO_JOBS
from jobquarry.sources.files import opens_in_tasks
from jobquarry.sources.many import whole_files
from jobquarry.sources.snapshots import file_texts, folder_files, snapshot_folders


def read_listings(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """Listing envelopes as one row per job, in the envelope's order.

    ``pos`` is the place in the envelope. A crawl's single JSON document needs
    ``multi_line``; envelopes kept one per line do not, and split over tasks. An envelope
    that is no JSON, or has no list of jobs, is one row with its ``reason``, which is null
    for jobs. ``read_huge_listings`` cuts an envelope too large for one row.
    """
    if multi_line:
        read = whole_files(spark, path)
    else:
        read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file_path"), "value")
    texts = read.withColumnRenamed("value", "text")
    texts = texts.where(F.trim("text", F.lit(" \t\r\n")) != "")
    # Parsed once; only a text without a list is looked at again.
    parsed = texts.select("*", F.explode(F.array(one_value(F.col("text"), LISTING_SCHEMA.simpleString()))).alias("_e"))
    reason = F.when(F.col("_e.jobs").isNull(), F.when(is_json(F.col("text")), F.lit(NO_JOBS)).otherwise(F.lit(BAD_ENVELOPE)))
    # The reason is settled below the generator, so that no row carries the whole list.
    judged = parsed.select(
        "file_path",
        F.col("_e.source_url").alias("listing_url"),
        "_e.company_name",
        "_e.total_pages_crawled",
        reason.alias("reason"),
        "_e.jobs",
    )
    header = ["file_path", "listing_url", "company_name", "total_pages_crawled"]
    rows = judged.select(*header, "reason", F.posexplode_outer("jobs").alias("pos", "job")).where(
        F.col("job").isNotNull() | F.col("reason").isNotNull()
    )
    return rows.select(*header, F.col("pos").cast("long").alias("pos"), "job.*", "reason")


def read_html_dump(spark: SparkSession, path: str) -> DataFrame:
    """All ``*.html`` files of one folder: (file_name, file_stem, html)."""
    files = whole_files(spark, path, ".html")
    pages = files.select(_decoded(F.substring_index("file_path", "/", -1)).alias("file_name"), F.col("value").alias("html"))
    return with_file_stem(pages)


def _decoded(name: Column) -> Column:
    """A file's name as it is; Spark gives it with its blanks and signs encoded."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def read_packed_dump(spark: SparkSession, path: str, name: Column, html: str = "html") -> DataFrame:
    """A dump packed into parquet, for page counts no file system likes as files."""
    packed = spark.read.parquet(path).select(name.alias("file_name"), F.col(html).alias("html"))
    return with_file_stem(packed)


def with_file_stem(pages: DataFrame) -> DataFrame:
    return pages.withColumn("file_stem", F.regexp_replace("file_name", r"(?<=.)\.[^.]*$", ""))


def latest_snapshot(df: DataFrame, company: str, snapshot: str) -> DataFrame:
    """Rows of each company's numerically greatest snapshot.

    Snapshots that are not all digits do not count; a company without one drops out.
    The maxima are one row per company, so a huge company costs no extra shuffle of its
    rows when that side is small enough for Spark to broadcast it.
    """
    # Digits of any length: the longer number is greater, then the later text.
    digits = F.ltrim(F.col(snapshot), F.lit("0"))
    numbered = df.withColumn("_snapshot", F.when(F.col(snapshot).rlike(r"\A[0-9]+\z"), F.struct(F.length(digits), digits)))
    newest = (
        numbered.where(F.col("_snapshot").isNotNull())
        .groupBy(company)
        .agg(F.max("_snapshot").alias("_snapshot"))
    )
    return numbered.join(newest, [company, "_snapshot"], "left_semi").select(*df.columns)


def newest_folders(spark: SparkSession, root: str) -> DataFrame:
    """Company, snapshot and folder of every company's newest snapshot, with or without files."""
    return latest_snapshot(snapshot_folders(spark, root), "company", "snapshot")


def read_latest_snapshots(spark: SparkSession, root: str, one_per_file: bool = True) -> DataFrame:
    """Documents of every company's newest snapshot folder, that is, of no other one.

    Folders are listed and files are read in tasks (:mod:`snapshots`), and no path passes
    through the driver. Only where tasks cannot open the file system, the newest folders
    (one per company) are handed to Spark's reader by name.
    """
    newest = newest_folders(spark, root)
    if opens_in_tasks(root):
        files = stored(folder_files(newest, "folder", ".json", "company", "snapshot"), "files")
        texts = file_texts(files)
        if not one_per_file:
            lines = F.explode(F.split("document", "\r\n|\r|\n"))
            texts = texts.select("file_path", lines.alias("document")).where("document <> ''")
        return texts.select("*", F.explode(F.array(is_json(F.col("document")))).alias("readable"))
    # Paths are read as patterns, so signs of patterns in folder names are escaped.
    paths = [re.sub(r"([*?\[\]{}\\])", r"\\\1", row.folder) for row in newest.toLocalIterator()]
    return read_json_documents(spark, paths, one_per_file) if paths else read_no_documents(spark)


def read_json_documents(
    spark: SparkSession, path: str | list[str], one_per_file: bool = True
) -> DataFrame:
    """JSON texts below a folder, with ``readable`` telling the broken ones."""
    texts = _json_texts(spark, path, one_per_file)
    return texts.select("*", F.explode(F.array(is_json(F.col("document")))).alias("readable"))


def _json_texts(spark: SparkSession, path: str | list[str], one_per_file: bool) -> DataFrame:
    if one_per_file:
        return whole_files(spark, path, ".json", recursive=True).withColumnRenamed("value", "document")
    return (
        spark.read.option("pathGlobFilter", "*.json")
        .option("recursiveFileLookup", True)
        .text(path)
        .select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("document"))
    )


def read_no_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "file_path string, document string, readable boolean")


BAD_JSON = "invalid JSON"
BAD_SHAPE = "neither a list of jobs nor an object with a jobs list"


def read_postings_tree(
    spark: SparkSession, path: str | list[str], one_per_file: bool = True
) -> DataFrame:
    """Postings of all JSON files below a folder; ``reason`` marks texts that are not JSON."""
    texts = _json_texts(spark, path, one_per_file)
    parsed = texts.select(
        "file_path", "document", F.explode(F.array(one_value(F.col("document"), POSTING_SCHEMA.simpleString()))).alias("_p")
    )
    # Only a text that gave no posting is looked at again.
    reason = F.when(F.col("_p").isNull(), F.when(~is_json(F.col("document")), F.lit(BAD_JSON)))
    return conform_postings(parsed.select("file_path", reason.alias("reason"), "_p.*"), "file_path", "reason")


def load_postings(documents: DataFrame, document: str, *keep: str) -> DataFrame:
    """Texts holding ``[...]`` or ``{"jobs": [...]}`` as posting rows.

    A text of another shape is one row with its ``reason``, which is null for postings.
    """
    element = POSTING_SCHEMA.simpleString()
    text = F.col(document)
    first = F.left(F.ltrim(text, F.lit(" \t\r\n")), F.lit(1))
    jobs = F.when(first == "[", one_value(text, f"array<{element}>")).when(
        first == "{", one_value(text, f"struct<jobs: array<{element}>>")["jobs"]
    )
    # The reason is settled below the generator, so that no row carries the whole list.
    readable = documents.select(*keep, F.explode(F.array(jobs)).alias("_jobs"))
    judged = readable.withColumn("reason", F.when(F.col("_jobs").isNull(), F.lit(BAD_SHAPE)))
    flagged = judged.select(*keep, "reason", F.posexplode_outer("_jobs").alias("pos", "_job")).where(
        F.col("_job").isNotNull() | F.col("reason").isNotNull()
    )
    rows = flagged.select(*keep, "reason", F.col("pos").cast("long").alias("pos"), "_job.*")
    return conform_postings(rows, *keep, "pos", "reason")


def read_job_lists(
    spark: SparkSession, path: str | list[str], one_per_file: bool = True
) -> DataFrame:
    """JSON files (or lines) that each hold many postings; see ``load_postings``."""
    return load_postings(read_json_documents(spark, path, one_per_file), "document", "file_path")


PAGES_PER_CHUNK = 256


def document_pages_text(pages: DataFrame, document: str, page_no: str, text: str) -> DataFrame:
    """Each document's page texts joined in page order, nothing between them.

    Joined in two steps, so that one document with very many pages is put together in
    pieces by many tasks and only its pieces meet in one.
    """

    def joined(group: list[str], order: str, value: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct(order, value)))
        return F.array_join(F.transform(ordered, lambda page: page[value]), "")

    chunked = pages.withColumn("_chunk", F.expr(f"`{page_no}` div {PAGES_PER_CHUNK}"))
    pieces = chunked.groupBy(document, "_chunk").agg(joined([document], page_no, text).alias(text))
    return pieces.groupBy(document).agg(joined([document], "_chunk", text).alias(text))
