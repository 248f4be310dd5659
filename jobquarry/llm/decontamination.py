"""Benchmark decontamination: size-partitioned MinHash containment search, then exact sets.

A document holds a test item when at least ``share`` of the item's distinct 5-word
shingles occur in it, however long the document is.

1. An item's sketch is its k smallest shingle hashes (a bottom-k MinHash). With k = n -
   ceil(share * n) + 1, a document that holds ``share`` of the item's n shingles misses
   at most k - 1 of them, so it has one of the sketch: the search loses nothing.
2. Items and documents are partitioned by size, in powers of two. A document is only
   compared with items small enough to be contained in it; a sketch is looked up with the
   least document size class that its item fits in.
3. Each shingle of a document is looked up in the sketches once. What is found is a pair
   of document and item, and only documents in pairs are read again. A shingle that very
   many documents and sketches have makes a pair of each two of them.
4. Exact containment: the shingles of the document meet those of the item, as sets.

Only built-in expressions are used. Sketches are read from a stored table, so that Spark
knows their size and broadcasts them only below its own limit; otherwise both sides are
shuffled on the hash, and adaptive execution splits a frequent hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobquarry.llm.frames import WORD, ascii_lower, keyed, same_row, stored

SHARE = 0.8
SIZE = 5


def shingles(text: Column, size: int = SIZE) -> Column:
    """Distinct shingle hashes; a shorter text has its whole sequence as its only one."""
    words = F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - size + 1)
        # get() counts from 0 and gives null beyond the end, which never happens here.
        long = F.transform(starts, lambda i: F.xxhash64(*(F.get(w, i + (j - 1)) for j in range(size))))
        short = F.array(F.xxhash64(F.concat_ws(" ", w), F.size(w)))
        empty = F.array().cast("array<bigint>")
        return F.when(F.size(w) >= size, F.array_distinct(long)).when(F.size(w) > 0, short).otherwise(empty)

    # One lambda variable, so that the words are cut out once and not once per use.
    return F.flatten(F.transform(F.array(words), of))


def size_class(n: Column) -> Column:
    return F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int")


def contained_items(docs: DataFrame, items: DataFrame, share: float = SHARE, text: str = "text", doc_id: str = "doc_id",
                    item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``id, fp, doc_id, item_id, n_shared, n_item, containment`` of every pair that reaches ``share``.

    Items or documents without words are in no pair. Items with equal ids and different
    texts are searched one by one, equal rows count once; so do equal documents. Null ids
    are kept. Empty tables give an empty one.
    """
    per_mille = math.ceil(share * 1000)
    rows = keyed(docs, text, doc_id).select("id", "fp", "text")
    # ceil(share * n) in whole numbers, so that no rounding moves the threshold.
    item_rows = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), shingles(F.coalesce(F.col(f"`{item_text}`"), F.lit(""))).alias("s"))
    needed = F.expr(f"int((size(s) * {per_mille}L + 999) div 1000)")
    item_rows = stored(
        item_rows.where(F.size("s") > 0)
        .select("item_id", F.array_sort("s").alias("s"))
        .distinct()
        .select("item_id", F.xxhash64("s").alias("item_fp"), "s", F.size("s").alias("n_item"), needed.alias("needed")),
        "items",
    )
    # The hash is mixed once more: the smallest of these are the sketch.
    sketches = item_rows.select(
        "item_id", "item_fp", size_class(F.col("needed")).alias("least_class"),
        F.explode(F.slice(F.array_sort(F.transform("s", lambda x: F.struct(F.xxhash64(x).alias("rank"), x.alias("hash")))), 1,
                          F.col("n_item") - F.col("needed") + 1)).alias("at"),
    ).select("item_id", "item_fp", "least_class", F.col("at.hash").alias("hash"))
    sketches = stored(sketches, "sketches")
    sets = rows.select("id", "fp", shingles(F.col("text")).alias("s"))
    probes = sets.select("id", "fp", size_class(F.size("s")).alias("class"), F.explode("s").alias("hash"))
    hits = probes.join(sketches, (probes["hash"] == sketches["hash"]) & (probes["class"] >= sketches["least_class"]))
    pairs = stored(hits.select("id", "fp", "item_id", "item_fp").distinct(), "pairs")
    wanted = stored(pairs.select("id", "fp").distinct(), "wanted")
    texts = rows.join(wanted, same_row(rows, wanted), "left_semi").dropDuplicates(["id", "fp"])
    read = texts.select("id", "fp", shingles(F.col("text")).alias("d"))
    both = (
        read.join(pairs, same_row(read, pairs))
        .select(read["id"], read["fp"], "d", "item_id", "item_fp")
    )
    exact = both.join(item_rows, both["item_id"].eqNullSafe(item_rows["item_id"]) & (both["item_fp"] == item_rows["item_fp"])).select(
        "id", "fp", item_rows["item_id"], item_rows["item_fp"], "n_item", "needed", F.size(F.array_intersect("d", "s")).alias("n_shared")
    )
    return exact.where("n_shared >= needed").select(
        "id", "fp", F.col("id").alias("doc_id"), "item_id", F.col("n_shared").cast("long").alias("n_shared"),
        F.col("n_item").cast("long").alias("n_item"), (F.col("n_shared") / F.col("n_item")).alias("containment"),
    )


def without_items(docs: DataFrame, items: DataFrame, share: float = SHARE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    rows = keyed(docs, text, doc_id)
    found = stored(contained_items(docs, items, share, text, doc_id).select("id", "fp").distinct(), "contaminated")
    left = rows.join(found, same_row(rows, found), "left_anti")
    return left.select("row.*")
