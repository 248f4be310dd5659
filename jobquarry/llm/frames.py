"""Helpers shared by the operators: stored tables, packed rows, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobquarry.session import scratch_path

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Edges of a graph that one task handles, of the few numbers that an edge is.
EDGES_PER_FILE = 250_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the cluster's shared folder and read again.

    Cuts the lineage: what follows reads files that outlive any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else, so that every engine agrees."""
    return F.translate(text, UPPER, LOWER)


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Columns ``row`` (the whole input row), ``id``, ``fp`` and ``text``.

    ``(id, fp)``, the id and a fingerprint of the text, stands for a row: ids may be
    null or repeated, and rows equal in both have equal results. The input's own
    columns are inside ``row``, so none of them can clash with a working column.
    """
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col(f"`{doc_id}`").cast("long").alias("id"),
        F.xxhash64(F.col(f"`{text}`")).alias("fp"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )


def unpacked(df: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``row`` and the new ones, which replace those of the same name."""
    old = [f.name for f in df.schema["row"].dataType if f.name not in new]
    return df.select(*(F.col("row").getField(c).alias(c) for c in old), *(c.alias(n) for n, c in new.items()))


def same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["id"].eqNullSafe(right["id"]) & (left["fp"] == right["fp"])


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts come to about ``limit`` bytes; one row at least."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = pc.binary_length(batch.column(at)).fill_null(0).to_pylist()
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if len(sizes) > start:
            yield batch.slice(start)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables that hold all rows of their keys, from batches sorted by them.

    A table has about ``rows`` rows and ends where a key ends; only the last, perhaps
    unfinished, key is carried on.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = [table.column(k)[-1] for k in keys]
        cut = table.num_rows
        step = 1
        same = lambda i: all(table.column(k)[i].equals(v) for k, v in zip(keys, last, strict=True))
        # Sorted rows: gallop back, then halve, to the first row of the last key.
        while cut - step >= 0 and same(cut - step):
            step *= 2
        low, high = max(-1, cut - step), cut - 1
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (low, middle) if same(middle) else (middle, high)
        if high > 0:
            yield table.slice(0, high)
            rest = table.slice(high).combine_chunks().to_batches()
            held, count = rest, table.num_rows - high
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def connected_components(edges: DataFrame) -> DataFrame:
    """Columns ``node`` and ``root``, the smallest node reachable, of an edge list ``a, b``.

    Alternates the large-star and small-star steps until the edges stay the same. Only
    minima per node and joins are used, so no neighbour list is ever collected, and each
    round is a stored table, of as many files as its edges ask for.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = stored(ordered.distinct(), "edges")
    mark = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    seen = mark(now)
    files = -(-seen[0] // EDGES_PER_FILE)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct().coalesce(files), "edges")
        before, seen = seen, mark(now)
        if before == seen:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
