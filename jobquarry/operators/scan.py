"""Running sums over ordered rows that no single task has to see whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(df: DataFrame, keys: list[str], chunk: str, order: str, **values: Column) -> DataFrame:
    """``df`` with the sum of each of ``values`` over all earlier rows of its ``keys``.

    Earlier: of a lower ``chunk``, or of the same one with a lower ``order`` (unique there).
    Rows are summed inside their chunk; one row per chunk carries the sums over the borders.
    So a task holds a chunk, and the chunks of one key are the longest row of numbers that
    a task orders. Keys and chunks may be null.
    """
    inside = Window.partitionBy(*keys, chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = list(values)
    own = df.select("*", *(c.alias(f"_own_{n}") for n, c in values.items()))
    local = own.select("*", *(F.coalesce(F.sum(f"_own_{n}").over(inside), F.lit(0)).alias(f"_in_{n}") for n in sums))
    before = Window.partitionBy(*(f"_k{i}" for i in range(len(keys)))).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(chunk).alias("_chunk")).agg(
        *(F.sum(f"_own_{n}").alias(f"_all_{n}") for n in sums)
    )
    carried = totals.select(
        *(f"_k{i}" for i in range(len(keys))), "_chunk", *(F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_carry_{n}") for n in sums)
    )
    same = F.col(chunk).eqNullSafe(F.col("_chunk"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return local.join(carried, same).select(
        *(F.col(c) for c in df.columns), *((F.col(f"_carry_{n}") + F.col(f"_in_{n}")).alias(n) for n in sums)
    )
