"""Pick up what is new: pages that have landed, links not seen in an earlier run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from jobquarry.operators.dedup import dedup_url
from jobquarry.streaming.seen import SeenSet


def ingest(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    *,
    fmt: str = "parquet",
    schema: T.StructType | None = None,
    transform: Callable[[DataFrame], DataFrame] = lambda df: df,
    **options: str,
) -> StreamingQuery:
    """Process the files of ``source`` that no earlier run handled, then stop.

    The checkpoint remembers the files, so running it again costs only new ones. Whole
    HTML files are read with ``fmt="text", wholetext="true"``.
    """
    reader = spark.readStream.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return (
        transform(reader.load(source))
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(target)
    )


def stream_dedup(
    links: DataFrame,
    target: str,
    checkpoint: str,
    *order: str,
    url: str = "url",
    seen: str | None = None,
    buckets: int = 16,
    filter_bits: int = 1 << 17,
) -> StreamingQuery:
    """Append each URL's first row, over all runs, to ``target``.

    The URLs of earlier batches are a :class:`SeenSet` (at ``seen``; beside the target by
    default), so a batch reads the filters of the buckets it touches, and URLs only of
    those buckets where one of its own may have been seen. Each micro-batch owns its
    folders: one that is run again after a failure gives the same result. Inside a batch
    the first row wins, with one row per URL and task shuffled. Null URLs are one URL.
    """
    table = seen or f"{target.rstrip('/')}-seen"

    def add_new(batch: DataFrame, batch_id: int) -> None:
        known = SeenSet(batch.sparkSession, table, buckets, filter_bits)
        fresh = known.add(dedup_url(batch, *order, url=url), url, batch_id)
        fresh.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return (
        links.writeStream.foreachBatch(add_new)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def distinct_urls(links: DataFrame, url: str = "url") -> DataFrame:
    """The same as one streaming operator, for sinks other than files.

    Any row of a URL may win, and its state grows with the URLs seen: a watermark would
    bound it, but would also let an old URL through again.
    """
    return links.dropDuplicates([url])
