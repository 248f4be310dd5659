"""Near-duplicate documents: a multi-index Hamming join on b-bit signatures, then full sets.

1. A document is its set of 5-word shingles. Documents with the same set are one *class*
   from here on, so groups of copies never multiply.
2. A class has a signature of 128 symbols of b = 16 bits, each the tail of one minimum
   hash. Two sets of similarity s differ in each symbol with probability 1 - s.
3. Signatures are split into 32 chunks of four symbols. If two differ in at most r = 32 + a
   symbols, then by pigeonhole one of the first a + 1 chunks has at most one error, or one
   of the others has none. So a class is filed under each of the first a + 1 chunks with
   each symbol left out in turn (all allowed errors) and under the others as they are, and
   every pair within the threshold r shares a key. r lies 4.4 deviations above the mean
   number of differing symbols at the link threshold: 37 for 0.85 (50 keys), 46 for 0.8
   (77 keys).
4. Buckets with the same members are searched once. The members of a bucket meet by leaders
   and crowds (:mod:`leaders`), so a tight group of n copies costs a few times n comparisons
   and no bucket, however large, is one task.
5. Of those that meet, the ones whose signatures are within r have their full sets compared;
   links are between similar sets only.
6. Connected components of the links give the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobquarry.llm.frames import arrow_map, chunks, keyed, same_row, stored, unpacked
from jobquarry.llm.hashing import mixed, shingle_sets
from jobquarry.llm.leaders import components_of_buckets, similar_pairs

SYMBOLS, BYTES_PER_SYMBOL = 128, 2
CHUNKS, PER_CHUNK = 32, 4
#: Deviations by which the signature threshold exceeds the mean distance at the link threshold.
MARGIN = 4.4
#: Words of a shingle.
WORDS = 5

_RANDOM = np.random.default_rng(77)
_FACTORS = _RANDOM.integers(1, 1 << 31, SYMBOLS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _RANDOM.integers(0, 1 << 32, SYMBOLS, dtype=np.uint32)


def radius_of(percent: int) -> int:
    """The signature threshold for a similarity; at most one error per chunk is enumerated."""
    differing = 1 - percent / 100
    radius = round(SYMBOLS * differing + MARGIN * (SYMBOLS * differing * (1 - differing)) ** 0.5)
    if not 0 < percent <= 100 or radius >= 2 * CHUNKS:
        raise ValueError(f"a similarity of {percent} % needs more than one error per chunk")
    return radius


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of symbols per set; sets must not be empty."""
    out = np.empty((len(offsets) - 1, SYMBOLS), np.uint16)
    if not len(out):
        return out
    short = (values >> np.uint64(32)).astype(np.uint32)
    for k in range(SYMBOLS):
        hashed = short * _FACTORS[k]
        hashed += _SHIFTS[k]
        least = np.minimum.reduceat(hashed, offsets[:-1])
        least = (least ^ (least >> np.uint32(15))) * np.uint32(0x9E3779B1)
        out[:, k] = (least >> np.uint32(16)).astype(np.uint16)
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of shingles, class and signature of each text."""
    for chunk in chunks(batches, "text"):
        values, offsets = shingle_sets(chunk.column("text"), WORDS)
        counts = np.diff(offsets)
        full = counts > 0
        classes = np.zeros(len(counts), np.uint64)
        marks: list[bytes | None] = [None] * len(counts)
        if full.any():
            at = offsets[:-1][full]
            classes[full] = mixed(np.add.reduceat(mixed(values), at) + counts[full].astype(np.uint64))
            rows = signatures(values, np.append(at, len(values)))
            for i, row in zip(np.flatnonzero(full).tolist(), rows, strict=True):
                marks[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                chunk.column("id"),
                chunk.column("fp"),
                pa.array(counts),
                pa.array(classes.view(np.int64), mask=~full),
                pa.array(marks, pa.binary()),
            ],
            ["id", "fp", "n_shingles", "node", "signature"],
        )


def chunk_keys(radius: int, signature: str = "signature"):
    """The keys a signature is filed under, as an array column."""
    loose = radius - CHUNKS + 1
    size = PER_CHUNK * BYTES_PER_SYMBOL
    piece = lambda at, length: F.substring(F.col(signature), at + 1, length)
    keys = []
    for c in range(CHUNKS):
        at = c * size
        if c < loose:
            for s in range(PER_CHUNK):
                cut = s * BYTES_PER_SYMBOL
                after = cut + BYTES_PER_SYMBOL
                rest = F.concat(piece(at, cut), piece(at + after, size - after))
                keys.append(F.xxhash64(F.lit(c), F.lit(s), rest))
        else:
            keys.append(F.xxhash64(F.lit(c), piece(at, size)))
    return F.array(*keys)


def _within(radius: int):
    """Pairs whose signatures differ in ``radius`` symbols at most."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for c in ("one", "two"))
            close = pa.array((one != two).sum(1) <= radius)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(close), batch.column("b").filter(close)], ["a", "b"])

    return within


def close_pairs(pairs: DataFrame, nodes: DataFrame, radius: int) -> DataFrame:
    """Those of the pairs ``a, b`` whose signatures are within the radius."""
    first = nodes.select(F.col("node").alias("a"), F.col("signature").alias("one"))
    second = nodes.select(F.col("node").alias("b"), F.col("signature").alias("two"))
    return arrow_map(pairs.join(first, "a").join(second, "b").select("a", "b", "one", "two"), _within(radius), "a long, b long")


def _components(rows: DataFrame, percent: int) -> DataFrame:
    """``id, fp, n_shingles, node, component_id`` for the rows of :func:`keyed`."""
    radius = radius_of(percent)
    described = stored(
        arrow_map(
            rows.select("id", "fp", "text"),
            _describe,
            "id long, fp long, n_shingles long, node long, signature binary",
        ),
        "signatures",
    )
    nodes = stored(
        described.where("node IS NOT NULL")
        .groupBy("node")
        .agg(F.min(F.struct(F.col("id").isNull(), "id", "fp")).alias("first"), F.first("n_shingles").alias("n_shingles"),
             F.first("signature").alias("signature"))
        .select("node", "first.id", "first.fp", "n_shingles", "signature"),
        "nodes",
    )
    filed = nodes.select("node", F.col("n_shingles").alias("n"), F.explode(chunk_keys(radius)).alias("key"))
    buckets = filed.groupBy("key").agg(
        F.count(F.lit(1)).alias("c"),
        F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
    )
    kept = stored(buckets.where("c > 1").groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key"), "buckets")
    members = stored(filed.join(kept, "key").select("key", "node", "n"), "filed")

    def confirm(pairs: DataFrame) -> DataFrame:
        near = stored(close_pairs(pairs, nodes, radius), "near")
        return similar_pairs(near, nodes, rows, percent, WORDS)

    roots = components_of_buckets(members, nodes, rows, percent, WORDS, confirm)
    labelled = nodes.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    component = labelled.groupBy("root").agg(F.min("id").alias("component_id"))
    by_node = stored(labelled.join(component, "root").select("node", "component_id"), "components")
    return described.join(by_node, "node", "left").select(
        "id", "fp", "n_shingles", "node", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    )


def components(docs: DataFrame, percent: int = 85, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, copy_class``, one row per row of ``docs``.

    Links: 100 * intersection >= percent * union of the shingle sets. ``component_id`` is
    the smallest id reachable; rows without words (null and empty texts too) are linked
    with nothing and have their own id. Ids may be null (a component of such rows only has
    none) or repeated (the rows count one by one); ``kept`` is true for every row whose id
    is its component's. ``copy_class`` is the same for rows with the same shingles. Other
    columns play no part; an empty table gives an empty one.
    """
    return _components(keyed(docs, text, doc_id), percent).select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
        F.col("node").alias("copy_class"),
    )


def first_of_each(docs: DataFrame, percent: int = 85, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one row of each component stays.

    Of several rows with the component's id, one with its shingles stays. Rows without
    words are no duplicates and stay.
    """
    rows = keyed(docs, text, doc_id)
    labelled = stored(_components(rows, percent), "labelled")
    found = labelled.where(F.col("node").isNull() | F.col("id").eqNullSafe(F.col("component_id")))
    wordless = found.where("node IS NULL").select("id", "fp").distinct()
    chosen = found.where("node IS NOT NULL").groupBy("component_id").agg(F.min(F.struct("id", "fp")).alias("at"))
    stays = stored(wordless.union(chosen.select("at.id", "at.fp")), "stays")
    stays = stays.hint("merge")
    kept = rows.join(stays, same_row(rows, stays)).select(rows["id"], rows["fp"], "row")
    # Rows equal in id and text all come through the join; one of each goes on.
    several = stored(
        labelled.where("node IS NOT NULL").groupBy("id", "fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "several"
    )
    if several.isEmpty():
        return unpacked(kept)
    once = kept.join(several, same_row(kept, several), "left_anti")
    again = kept.join(several, same_row(kept, several), "left_semi")
    copy = F.row_number().over(Window.partitionBy("id", "fp").orderBy(F.xxhash64("row")))
    return unpacked(once.union(again.withColumn("copy", copy).where("copy = 1").drop("copy")))
