"""Writers: postings, processed listings, and the search corpus."""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobquarry.functions.json_types import JSON_OPTIONS, one_value
from jobquarry.schema import FIELD_KINDS


def posting_json(df: DataFrame, *keep: str) -> DataFrame:
    """Each posting as one JSON text with all its fields, nulls written out."""
    fields = F.struct(*FIELD_KINDS)
    return df.select(*keep, F.to_json(fields, {"ignoreNullFields": "false"}).alias("posting"))


def write_postings(df: DataFrame, path: str, *keep: str, mode: str = "errorifexists") -> None:
    """Postings as JSON lines; the page they came from stays as a column in ``keep``."""
    df.select(*keep, *FIELD_KINDS).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_processed(
    jobs: DataFrame, header: DataFrame, path: str, mode: str = "errorifexists"
) -> None:
    """Processed listings as a folder: ``jobs`` (JSON lines) and a one-row ``summary``.

    The jobs of a run are never gathered into one JSON document: that would put the
    whole result into one task.
    """
    jobs.write.mode(mode).option("ignoreNullFields", "false").json(f"{path}/jobs")
    header.coalesce(1).write.mode(mode).option("ignoreNullFields", "false").json(f"{path}/summary")


NO_VECTOR = "no embedding"
WRONG_LENGTH = "embedding length differs"
NULL_IN_VECTOR = "embedding holds nulls"
ZERO_VECTOR = "embedding has no direction"


def corpus_rejection(vector: Column, dims: int) -> Column:
    """Why a document cannot be indexed; null when it can."""
    return (
        F.when(vector.isNull(), F.lit(NO_VECTOR))
        .when(F.exists(vector, lambda x: x.isNull() | F.isnan(x)), F.lit(NULL_IN_VECTOR))
        .when(F.size(vector) != dims, F.lit(WRONG_LENGTH))
        .when(~F.exists(vector, lambda x: x != 0), F.lit(ZERO_VECTOR))
    )


NESTED_VECTOR = "embedding is nested"


def corpus_from_json(df: DataFrame, document: str, field: str, dims: int, *keep: str) -> DataFrame:
    """JSON documents with their vector as a column and the ``reason`` against it.

    A list inside the vector is told apart from a missing vector: it is the usual fault
    of an embedding step that returns one vector per batch.
    """
    # Read as everywhere: the last of repeated keys counts, and a text may have any size.
    own = one_value(F.col(document), f"struct<`{field}`:string>")
    parsed = df.select(*keep, document, F.explode(F.array(own)).alias("_v"))
    text = F.col("_v").getField(field)
    vector = F.from_json(text, "array<float>", JSON_OPTIONS)
    lists = F.from_json(text, "array<string>", JSON_OPTIONS)
    nested = F.coalesce(F.exists(lists, lambda x: x.startswith("[")), F.lit(False))
    return (
        parsed.select(*keep, document, vector.alias(field), nested.alias("_nested"))
        .withColumn(
            "reason",
            F.when(F.col("_nested"), F.lit(NESTED_VECTOR)).otherwise(
                corpus_rejection(F.col(field), dims)
            ),
        )
        .drop("_nested")
    )


def index_corpus(
    df: DataFrame, vector: str, dims: int, path: str, *partition: str, batch: str | None = None
) -> str:
    """Append documents to the corpus table, those that cannot be searched set apart.

    Both kinds go out in one write, under ``searchable=true`` and ``searchable=false``,
    so the model that made the vectors runs once. A ``reason`` already there is kept.

    Each append has a folder of its own, named ``batch`` (any name; a new one by default),
    and counts once its commit is written, after all else. One that died is not seen by
    readers; run again under its name it takes the place of what it left, so every
    document is there once. Returns the name.
    """
    name = batch or uuid.uuid4().hex
    reason = corpus_rejection(F.col(vector), dims)
    if "reason" in df.columns:
        reason = F.coalesce(F.col("reason"), reason)
    flagged = df.withColumn("reason", reason).withColumn("searchable", F.col("reason").isNull())
    # Each part of the table goes to few tasks, and a large one to as many as its size asks for.
    gathered = flagged.hint("rebalance", "searchable", *partition)
    folder = f"{path.rstrip('/')}/data/batch={quote(name, safe='')}"
    gathered.write.mode("overwrite").partitionBy("searchable", *partition).parquet(folder)
    spark = df.sparkSession
    commit = spark.createDataFrame([(name,)], "batch string").coalesce(1)
    commit.write.mode("overwrite").json(f"{path.rstrip('/')}/commits/batch={quote(name, safe='')}")
    return name


def read_indexed(spark: SparkSession, path: str) -> DataFrame:
    """All documents of committed appends, with ``reason`` and ``searchable``."""
    root = path.rstrip("/")
    names = [row.batch for row in spark.read.schema("batch string").option("recursiveFileLookup", True).json(f"{root}/commits").collect()]
    folders = [f"{root}/data/batch={quote(name, safe='')}" for name in sorted(names)]
    # Spark reads boolean partition values back as text.
    rows = spark.read.option("basePath", f"{root}/data").option("mergeSchema", True).parquet(*folders)
    return rows.drop("batch").withColumn("searchable", F.col("searchable").cast("boolean"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The documents a search may use; set-apart ones are pruned by their partition."""
    return read_indexed(spark, path).where("searchable").drop("searchable", "reason")
