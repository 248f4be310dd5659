"""A corpus made ready for training, stage by stage.

Each stage is a function of (spark, docs, sf_dir). Its result is written as Parquet and
read again as the ``docs`` of the next, so that a lost executor costs one stage at most.
All stages but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobquarry.llm import decontamination, mixing, near_dedup, suffix_dedup, toxicity
from jobquarry.llm.frames import stored

#: Near-duplicates in the pipeline: this many percent of shared shingles.
SIMILAR = 80
#: Passages to cut out have this many words, or bytes, at least.
PASSAGE_WORDS, PASSAGE_BYTES = 51, 200
#: Strings whose repeats are looked for: as short as so many words of two letters can be.
PASSAGE_STRING = 2 * PASSAGE_WORDS + PASSAGE_WORDS - 1


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is predicted go. The network learns from labelled rows."""
    learning = docs.where(~toxicity.held_out()).select("doc_id", "text")
    net = toxicity.learned(learning, _table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return toxicity.scored(rows, net).where("predicted = 0").select("row.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by near-duplicate links, one stays."""
    return near_dedup.first_of_each(docs, SIMILAR)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur twice or more are cut out; what is left is the text."""
    whole = docs.select(F.struct(*docs.columns).alias("whole"), "doc_id", "text")
    cleaned = suffix_dedup.remove_repeats(whole, PASSAGE_STRING, least_bytes=PASSAGE_BYTES, least_words=PASSAGE_WORDS)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("whole.n_chars"))
    return cleaned.select(*(new.get(c, F.col("whole").getField(c)).alias(c) for c in docs.columns))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontamination.without_items(docs, _table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their source's target asks, numbered by ``copy``."""
    return mixing.mixed_corpus(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_duplicates),
    ("suffix_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("mixing", mix),
]
#: SQL cannot express the first stage; the tests check every stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
