"""One huge listing envelope, cut into its jobs by all tasks at once.

An envelope is one JSON object with a ``jobs`` list. Read as one document it is one row of
one task, whatever its size. Here the file is read in pieces between commas, which Spark
splits like the lines of a text. Whether a piece starts inside a string, how deep it lies,
and which job it belongs to are running sums (of quotes, brackets, and beginnings), so the
pieces of each job find together by a number, in parallel. Only a job's text is ever put
together, never the list.

A comma is no part of another UTF-8 character and of no escape, so pieces cut no token in two.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobquarry.functions.json_types import is_json, one_value
from jobquarry.operators.scan import running_sums
from jobquarry.schema import LISTING_SCHEMA
from jobquarry.session import stored
from jobquarry.sources import many

BAD_ENVELOPE = "invalid JSON"
NO_JOBS = "no list of jobs"
#: Bytes of a file that a task reads whole.
SMALL = 4 << 20
_JOB = LISTING_SCHEMA["jobs"].dataType.elementType.simpleString()
_HEADER = "struct<source_url:string,company_name:string,total_pages_crawled:bigint>"


def _outside_strings(text: Column, inside: Column) -> Column:
    """What of a piece lies outside of strings; ``inside`` says where it starts."""
    plain = F.regexp_replace(text, r"(?s)\\.", "")
    opened = F.concat(F.when(inside, F.lit('"')).otherwise(F.lit("")), plain)
    return F.regexp_replace(F.regexp_replace(opened, '"[^"]*"', "_"), '"[^"]*\\z', "_")


def _split_by_spark(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("i"),
        F.col("value").alias("text"),
    )


def _cut(spark: SparkSession, path: str | list[str], small: int = SMALL) -> DataFrame:
    """``file_path, block, i, text``: what lies between commas.

    Spark's reader splits the large files. Files of ``small`` bytes at most may be very
    many; tasks read those whole and cut them into the same pieces.
    """
    files = many.list_files(spark, path)
    if files is None:
        return _split_by_spark(spark, path)
    # A mark at the beginning is no text, nor is nothing behind the last comma a piece.
    text = F.regexp_replace(F.regexp_replace("value", "\\A\ufeff", ""), ",\\z", "")
    whole = many.read_files(files.where(F.col("size") <= small)).select("file_path", "value", text.alias("text")).where("value <> '\ufeff'")
    cut = whole.select("file_path", F.lit(0).cast("long").alias("block"), F.posexplode(F.split("text", ",")).alias("i", "text"))
    cut = cut.withColumn("i", F.col("i").cast("long"))
    large = [re.sub(r"([*?\[\]{}\\])", r"\\\1", unquote(r.file_path)) for r in files.where(F.col("size") > small).select("file_path").toLocalIterator()]
    return cut.union(_split_by_spark(spark, large)) if large else cut


def _pieces(spark: SparkSession, path: str | list[str], small: int = SMALL) -> DataFrame:
    """``file_path, block, i, text`` and ``depth``, ``part``, ``entry`` of each piece, stored."""
    read = stored(_cut(spark, path, small), "pieces")
    quotes = F.regexp_count(F.regexp_replace("text", r"(?s)\\.", ""), F.lit('"'))
    placed = running_sums(read, ["file_path"], "block", "i", quotes=quotes)
    bare = placed.withColumn("inside", F.col("quotes") % 2 == 1).withColumn("bare", _outside_strings(F.col("text"), F.col("inside")))
    bare = stored(bare.drop("quotes"), "pieces")
    change = F.regexp_count("bare", F.lit(r"[\[{]")) - F.regexp_count("bare", F.lit(r"[\]}]"))
    deep = stored(running_sums(bare, ["file_path"], "block", "i", depth=change), "pieces")
    starts = (~F.col("inside") & (F.col("depth") <= 2)).cast("long")
    top = (~F.col("inside") & (F.col("depth") <= 1)).cast("long")
    numbered = running_sums(deep, ["file_path"], "block", "i", part=starts, entry=top)
    # Sums over earlier rows; a piece that begins something belongs to it.
    return numbered.select(
        "file_path", "block", "i", "text", "bare", "inside", "depth", (F.col("part") + starts).alias("part"), (F.col("entry") + top).alias("entry")
    )


def _parts(pieces: DataFrame) -> DataFrame:
    """``file_path, entry, part, text``: the pieces of each entry or job put together again."""
    ordered = F.array_sort(F.collect_list(F.struct("block", "i", "text")))
    return pieces.groupBy("file_path", "entry", "part").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), ",").alias("text"))


def _balanced(pieces: DataFrame) -> DataFrame:
    """``file_path, sound``: whether brackets and quotes close, and one object is all there is."""
    change = F.regexp_count("bare", F.lit(r"[\[{]")) - F.regexp_count("bare", F.lit(r"[\]}]"))
    quotes = F.regexp_count(F.regexp_replace("text", r"(?s)\\.", ""), F.lit('"'))
    # Only the first piece lies outside of the object, which it opens; nothing opens behind a close.
    misplaced = F.when(F.col("depth") < 1, (F.col("part") > 1) | ~F.col("bare").rlike(r"\A\s*\{") | (F.col("depth") < 0)).otherwise(F.lit(False))
    behind = F.col("bare").rlike(r"[\]}]\s*[\[{_]")
    return pieces.groupBy("file_path").agg(
        ((F.sum(change) == 0) & (F.sum(quotes) % 2 == 0) & (F.count_if(misplaced | behind) == 0)).alias("sound")
    )


def read_huge_listings(spark: SparkSession, path: str | list[str], small: int = SMALL) -> DataFrame:
    """As ``read_listings``: one row per job, or one with the ``reason`` for a file without.

    The columns are file_path, listing_url, company_name, total_pages_crawled, pos, the
    fields of a job, and reason. Of several ``jobs`` keys the last counts. A file that is no
    JSON, or has no list of jobs, gives one row; an empty file has no piece and gives none.
    ``small`` is the size up to which a file is read by one task.
    Of header entries that are lists or objects themselves, only brackets and quotes count.
    """
    pieces = stored(_pieces(spark, path, small), "pieces")
    parts = _parts(pieces)
    key = r'\A\s*\{?\s*"jobs"\s*:\s*'
    entries = parts.groupBy("file_path", "entry").agg(F.min(F.struct("part", "text")).alias("head"), F.max("part").alias("last"))
    entries = stored(entries.select("file_path", "entry", F.col("head.part").alias("begin"), "last", F.col("head.text").alias("head")), "entries")
    lists = entries.where(F.col("head").rlike(key)).groupBy("file_path").agg(F.max(F.struct("entry", "begin", "last", "head")).alias("at"))
    lists = stored(lists.select("file_path", "at.entry", "at.begin", "at.last", F.col("at.head").rlike(key + r"\[").alias("is_list")), "lists")
    where = lists.where("is_list").select(F.col("file_path").alias("_file"), F.col("entry").alias("_entry"), "begin", "last")
    inside = parts.join(where, (F.col("file_path") == F.col("_file")) & (F.col("entry") == F.col("_entry")))
    text = F.when(F.col("part") == F.col("begin"), F.regexp_replace("text", key + r"\[", "")).otherwise(F.col("text"))
    text = F.when(F.col("part") == F.col("last"), F.regexp_replace(text, r"\]\s*(\}\s*)?\z", "")).otherwise(text)
    jobs = inside.select("file_path", (F.col("part") - F.col("begin")).alias("pos"), F.trim(text).alias("text"), (F.col("begin") == F.col("last")).alias("only"))
    jobs = jobs.where(~(F.col("only") & F.col("text").rlike(r"\A\s*\z")))
    jobs = stored(jobs.select("file_path", "pos", one_value(F.col("text"), _JOB).alias("job"), is_json(F.col("text")).alias("whole")), "jobs")

    scalar = F.regexp_replace(F.regexp_replace("head", r"\A\s*\{?", ""), r"\}?\s*\z", "")
    closed = F.when(F.col("head").rlike(r":\s*[\[{]"), F.lit(None)).otherwise(F.concat(F.lit("{"), scalar, F.lit("}")))
    fields = entries.where(~F.col("head").rlike(key)).select("file_path", "entry", one_value(closed, _HEADER).alias("h"), (closed.isNotNull() & ~is_json(closed)).alias("broken"))
    header = fields.groupBy("file_path").agg(
        *(F.max_by(f"h.{n}", F.when(F.col(f"h.{n}").isNotNull(), F.col("entry"))).alias(n) for n in ("source_url", "company_name", "total_pages_crawled")),
        F.max("broken").alias("broken"),
    )
    broken = jobs.groupBy("file_path").agg((F.count_if(~F.col("whole")) > 0).alias("broken_job"))
    files = _balanced(pieces).join(header, "file_path", "left").join(broken, "file_path", "left").join(lists.select("file_path", "is_list"), "file_path", "left")
    reason = F.when(~F.col("sound") | F.coalesce("broken", F.lit(False)) | F.coalesce("broken_job", F.lit(False)), F.lit(BAD_ENVELOPE)).when(
        ~F.coalesce("is_list", F.lit(False)), F.lit(NO_JOBS)
    )
    readable = lambda c: F.when(~reason.eqNullSafe(F.lit(BAD_ENVELOPE)), F.col(c))
    header = {"listing_url": "source_url", "company_name": "company_name", "total_pages_crawled": "total_pages_crawled"}
    files = stored(files.select("file_path", *(readable(c).alias(n) for n, c in header.items()), reason.alias("reason")), "files")
    good = files.where("reason IS NULL").join(jobs.where("job IS NOT NULL"), "file_path")
    bad = files.where("reason IS NOT NULL").select("*", F.lit(None).cast("long").alias("pos"), F.lit(None).cast(_JOB).alias("job"))
    rows = good.drop("whole").unionByName(bad)
    return rows.select("file_path", "listing_url", "company_name", "total_pages_crawled", "pos", "job.*", "reason")
