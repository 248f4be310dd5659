"""Mixing sources to target weights by whole documents.

1. Words are summed per source (partial sums, one row per source).
2. Sources share all words by weight. A target stops at ``most`` times its source's size;
   what is above is shared again by weight. The end of that process is a water level L:
   target = min(weight * L, most * size). With sources ordered by most * size / weight,
   the full ones come first, so L is found from running sums, without iterating.
3. A source's rate is target / size. Each of its documents is taken floor(rate) times, and
   once more with probability rate - floor(rate), by a seeded hash of its id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobquarry.llm.frames import WORD, stored

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    One row per source, about 50 bytes each, is ordered in one task: the table's size is
    that of the list of sources, not of the corpus.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(ordered) - 1) % len(weights) + 1)
    filled = Window.orderBy(F.col("full_at"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    after = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    size = F.col("source_size").cast("double")
    return (
        sizes.withColumn("weight", weight)
        .withColumn("full_at", F.lit(most) * size / F.col("weight"))
        .withColumn("level", (F.sum(size).over(everything) - F.coalesce(F.lit(most) * F.sum(size).over(before), F.lit(0.0))) / F.sum("weight").over(after))
        # The level of the first source that is not filled; all later ones share it.
        .withColumn("level", F.min(F.when(F.col("full_at") > F.col("level"), F.struct("full_at", "level"))).over(everything)["level"])
        .select(
            "source",
            "source_size",
            F.coalesce(F.least(F.col("weight") * F.col("level"), F.lit(most) * size), F.lit(most) * size).alias("target"),
        )
    )


def uniform(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) from the columns alone: 52 bits of an MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def copies_of(docs: DataFrame, seed: int = 1, weights: tuple[float, ...] = WEIGHTS, most: float = MOST,
              text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """Columns ``row`` (the input row), ``size``, ``source_size``, ``target`` and ``copies``.

    A null text has size 0; a null source is a source of its own and the last. Sources
    without words have target 0 and their documents are not taken. Rows with the same id
    and text are drawn alike. An empty table gives an empty one.
    """
    counted = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col(f"`{source}`").alias("source"),
        words(F.col(f"`{text}`")).alias("size"),
        uniform(seed, F.col(f"`{doc_id}`"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))).alias("draw"),
    )
    sizes = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sum(words(F.col(f"`{text}`"))).alias("source_size"))
    shares = stored(targets(sizes, weights, most), "targets")
    joined = counted.join(shares, counted["source"].eqNullSafe(shares["source"])).drop("source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = (F.floor(rate) + (F.col("draw") < rate - F.floor(rate)).cast("int")).cast("int")
    return joined.select("row", "size", "source_size", "target", copies.alias("copies"))


def mixed_corpus(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with ``copy`` from 1 on."""
    taken = copies_of(docs, **options).where("copies > 0")
    columns = [f.name for f in taken.schema["row"].dataType if f.name != "copy"]
    repeated = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return repeated.select(*(F.col("row").getField(c).alias(c) for c in columns), "copy")
