"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, items: Column, *keep: str, pos: str = "pos", item: str = "item") -> DataFrame:
    """One row per array element with its place; null elements give no row.

    The outer form, because from a plain explode Spark derives a filter on the array
    and computes it a second time, which matters when it comes from a parser or a model.
    """
    return (
        df.select(*keep, F.posexplode_outer(items).alias(pos, item))
        .where(F.col(item).isNotNull())
        .withColumn(pos, F.col(pos).cast("long"))
    )
