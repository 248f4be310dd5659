"""Similarity join of documents as sets of word n-grams, by token-combination prefixes.

A document is its set of 3-word shingles (*tokens*); documents with the same set are one
*class* from here on. Two classes link where 100 * intersection >= percent * union. Then
either set x misses at most t(x) = |x| - ceil(percent * |x| / 100) of its tokens in the other.

1. **Token classes.** All texts are counted into a sketch of 2**22 counters, whose rounded
   logarithms (4 MB at any size of the corpus) go to every task. A token whose counter does
   not stand out is *rare* (class 1), then come *frequent* (2) and *very frequent* ones (3).
   The sketch only decides what is cheap; every result is the same with any sketch.
2. **Extended prefixes.** Tokens are ordered by counter, then hash. Tokens of class k fall
   into groups; in a group, a prefix with p tokens loses all its k-combinations only after
   p - k + 1 misses. The prefix is extended until the groups together need t(x) + 1 misses.
   Of two linked sets, let x be the one whose prefix ends first: y holds all but t(x) of
   that prefix in its own, so some group keeps k common tokens.
3. **Index.** A set is filed under each rare token of its prefix and under each combination
   of k tokens of a group of class k. The number of groups follows the size of the set, in
   bands by powers of two; a set that may link into the next band is filed there too.
   Sets too small for the argument, and those that may link with them, are filed under
   the plain prefix of t(x) + 1 tokens as well.
4. **Verification.** Members of a bucket meet by leaders and crowds (:mod:`leaders`). A set
   has a bitmap of 2,048 bits, each the parity of the tokens that fall on it, so two bitmaps
   differ in no more bits than the sets do in tokens: pairs that differ in too many bits
   cannot link. The full sets of the others are compared. Components of the links are the
   result.

Texts are read three times and shuffled only where a class has someone to meet; what is
shuffled of the others are their keys, about an eighth of the tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobquarry.llm.frames import arrow_map, chunks, keyed, stored
from jobquarry.llm.hashing import STEPS, mixed, shingle_sets
from jobquarry.llm.leaders import components_of_buckets, similar_pairs

#: The sketch has 2 ** SKETCH_BITS counters, sent in pieces.
SKETCH_BITS, PIECES = 22, 16
#: A level is this many times the logarithm to base 2 of a counter.
STEPS_PER_OCTAVE = 4
#: Counters of rare tokens reach this many times the mean, but ``LEAST`` at least: below
#: that, a counter tells chance meetings in it rather than its tokens. Those of frequent
#: ones reach ``FREQUENT`` times as much.
RARE, LEAST, FREQUENT = 2, 4, 64
#: Bits of a set's bitmap, a power of two.
BITMAP = 2048
#: Misses per group that a set at the lower end of its band can have.
PER_GROUP = 4


def allowed_misses(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100)


def groups_of(band: np.ndarray, percent: int) -> np.ndarray:
    """Groups per token class for sets of a band."""
    return np.maximum(1, (2**band * (100 - percent)) // (100 * PER_GROUP))


def small_below(percent: int) -> int:
    """Sets of this size or more always need t + 1 misses, in whatever groups their tokens are."""
    if not 60 <= percent <= 100:
        raise ValueError(f"a similarity of {percent} % is outside 60 to 100")
    n = np.arange(1, 100_000)
    upper = np.log2(n * 100 // percent).astype(np.int64)
    # Groups of class 2 waste one token each, those of class 3 two.
    enough = n - 3 * groups_of(upper, percent) >= allowed_misses(n, percent) + 1
    return int(n[~enough].max(initial=0)) + 1


def _describe(words: int):
    """Number of shingles and class of each text."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            values, at = shingle_sets(chunk.column("text"), words)
            counts = np.diff(at)
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column("id"),
                    chunk.column("fp"),
                    pa.array(counts),
                    pa.array(_classes(values, at).view(np.int64), mask=counts == 0),
                    pa.array([row.tobytes() for row in bitmaps(values, at)], pa.binary(), mask=counts == 0),
                ],
                ["id", "fp", "n_shingles", "node", "bits"],
            )

    return describe


def bitmaps(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of bytes per set: of each bit, the parity of the members that fall on it."""
    sets = len(at) - 1
    place = np.repeat(np.arange(sets), np.diff(at)) * BITMAP + (mixed(values * STEPS[3]) % np.uint64(BITMAP)).astype(np.int64)
    parity = (np.bincount(place, minlength=sets * BITMAP) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(sets, BITMAP), axis=1)


def _may_link(percent: int):
    """Pairs whose bitmaps differ in no more bits than linked sets of their sizes can."""

    def may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BITMAP // 8) for c in ("one", "two"))
            both = batch.column("one_n").to_numpy() + batch.column("two_n").to_numpy()
            apart = np.bitwise_count(one ^ two).sum(1, dtype=np.int64)
            kept = pa.array(apart * (100 + percent) <= both * (100 - percent))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], ["a", "b"])

    return may_link


def possible_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` without those that their bitmaps rule out."""
    first = nodes.select(F.col("node").alias("a"), F.col("bits").alias("one"), F.col("n").alias("one_n"))
    second = nodes.select(F.col("node").alias("b"), F.col("bits").alias("two"), F.col("n").alias("two_n"))
    joined = pairs.join(first, "a").join(second, "b").select("a", "b", "one", "two", "one_n", "two_n")
    return arrow_map(joined, _may_link(percent), "a long, b long")


def _classes(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One number per set, from its members and their number; 0 for empty sets."""
    counts = np.diff(at)
    out = np.zeros(len(counts), np.uint64)
    full = counts > 0
    if full.any():
        out[full] = mixed(np.add.reduceat(mixed(values), at[:-1][full]) + counts[full].astype(np.uint64))
    return out


def _first_seen(classes: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which rows bring a class that this task has not met yet."""
    new = np.zeros(len(classes), bool)
    for i, c in enumerate(classes.tolist()):
        if c and c not in seen:
            seen.add(c)
            new[i] = True
    return new


def _slots(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _count(words: int):
    """Counters of a task's texts, copies once, in pieces; they stop at 65,535 per task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, seen = np.zeros(1 << SKETCH_BITS, np.uint32), set()
        for chunk in chunks(batches, "text"):
            values, at = shingle_sets(chunk.column("text"), words)
            new = _first_seen(_classes(values, at), seen)
            np.add.at(counters, _slots(values[np.repeat(new, np.diff(at))]), 1)
        if counters.any():
            short = np.minimum(counters, 0xFFFF).astype(np.uint16)
            for i, piece in enumerate(np.split(short, PIECES)):
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([piece.tobytes()], pa.binary())], ["piece", "counters"])

    return count


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the pieces that a task gets; a byte per counter leaves it, and the total."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, data in zip(batch.column("piece").to_pylist(), batch.column("counters"), strict=True):
            part = np.frombuffer(data.as_buffer(), np.uint16)
            sums[i] = sums[i] + part if i in sums else part.astype(np.int64)
    for i, total in sums.items():
        data = level_of(total).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([data], pa.binary()), pa.array([int(total.sum())])], ["piece", "levels", "total"])


def level_of(count: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.rint(STEPS_PER_OCTAVE * np.log2(np.maximum(count, 1)))).astype(np.uint8)


def sketch_of(rows: DataFrame, words: int) -> tuple[np.ndarray, int, int]:
    """The level of each counter (2 ** SKETCH_BITS bytes, whatever the corpus), and the
    highest levels of rare and of frequent tokens."""
    counted = arrow_map(rows.select("text"), _count(words), "piece long, counters binary")
    summed = arrow_map(counted.repartition(PIECES, "piece"), _sum, "piece long, levels binary, total long")
    levels, total = np.zeros((PIECES, (1 << SKETCH_BITS) // PIECES), np.uint8), 0
    for row in summed.collect():
        levels[row.piece] = np.frombuffer(row.levels, np.uint8)
        total += row.total
    rare = max(LEAST, RARE * total >> SKETCH_BITS)
    return levels.reshape(-1), int(level_of(np.array(rare))), int(level_of(np.array(FREQUENT * rare)))


def _runs(keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal keys."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Position of each entry in its run of equal keys."""
    starts = _runs(keys)
    lengths = np.diff(np.append(starts, len(keys)))
    return np.arange(len(keys)) - np.repeat(starts, lengths)


def prefix_keys(
    values: np.ndarray, sizes: np.ndarray, bands: np.ndarray, sketch: tuple[np.ndarray, int, int], percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sets laid end to end in ``values``, and the number of the set of each key.

    ``bands`` below 0 ask for the plain prefix: all tokens count as rare.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    levels, rare, frequent = sketch
    level = levels[_slots(values)]
    kind = np.where((bands[owner] < 0) | (level <= rare), 1, np.where(level <= frequent, 2, 3))
    misses = allowed_misses(sizes, percent)
    groups = groups_of(np.maximum(bands, 0), percent)
    order = np.lexsort((values, level, owner))
    # All that a prefix can need: t + 1, and the tokens that groups of class 2 and 3 waste.
    order = order[_ranks(owner[order]) <= (misses + 3 * groups)[owner[order]]]
    values, owner, kind = values[order], owner[order], kind[order]
    group = (values % groups[owner].astype(np.uint64)).astype(np.int64) * 4 + kind
    by_group = np.lexsort((group, owner))
    rank = np.empty(len(order), np.int64)
    rank[by_group] = _ranks(owner[by_group] * (4 * int(groups.max(initial=1)) + 4) + group[by_group])
    unit = (rank >= kind - 1) | (kind == 1)
    total = np.cumsum(unit)
    starts = _runs(owner)
    before = np.zeros(len(sizes), np.int64)
    before[owner[starts]] = total[starts] - unit[starts]
    # Up to and with the token that makes the misses t + 1.
    kept = total - unit - before[owner] <= misses[owner]
    values, owner, kind, group = values[kept], owner[kept], kind[kept], group[kept]
    tag = mixed((bands[owner] + 2).astype(np.uint64) * STEPS[0])
    one = kind == 1
    keys, owners = [mixed(values[one] * STEPS[1] + tag[one])], [owner[one]]
    for k in (2, 3):
        at = np.flatnonzero(kind == k)
        at = at[np.lexsort((values[at], group[at], owner[at]))]
        starts = _runs(owner[at] * (4 * int(groups.max(initial=1)) + 4) + group[at])
        lengths = np.diff(np.append(starts, len(at)))
        for length in np.unique(lengths[lengths >= k]).tolist():
            rows = at[starts[lengths == length][:, None] + np.arange(length)]
            for chosen in combinations(range(length), k):
                key = tag[rows[:, 0]] + np.uint64(k)
                for c in chosen:
                    key = mixed(key * STEPS[2] + values[rows[:, c]])
                keys.append(key)
                owners.append(owner[rows[:, 0]])
    return np.concatenate(keys), np.concatenate(owners)


def _file(levels, rare: int, frequent: int, words: int, percent: int):
    """The keys of each class, once per task."""
    small = small_below(percent)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sketch = np.frombuffer(levels.value, np.uint8), rare, frequent
        for chunk in chunks(batches, "text"):
            values, at = shingle_sets(chunk.column("text"), words)
            classes, sizes = _classes(values, at), np.diff(at)
            largest = sizes * 100 // percent
            # Where nothing may be missing and nothing larger fits, only the same set links.
            new = _first_seen(classes, seen) & ((largest > sizes) | (allowed_misses(sizes, percent) > 0))
            safe = np.maximum(sizes, 1)
            low, high = np.log2(safe).astype(np.int64), np.log2(np.maximum(largest, 1)).astype(np.int64)
            for rows, bands in (
                (new & (sizes >= small), low),
                (new & (sizes >= small) & (high > low), high),
                (new & (sizes < small * 100 / percent), np.full(len(sizes), -1)),
            ):
                at_rows = np.flatnonzero(rows)
                if not len(at_rows):
                    continue
                keys, owner = prefix_keys(values[np.repeat(rows, sizes)], sizes[rows], bands[rows], sketch, percent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(classes[at_rows][owner].view(np.int64)), pa.array(sizes[at_rows][owner])], ["key", "node", "n"]
                )

    return file


def components(docs: DataFrame, percent: int = 90, words: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id, copy_class``, one row per row of ``docs``.

    Links: 100 * intersection >= percent * union of the sets of shingles of ``words`` words
    (a shorter text is one shingle). ``component_id`` is the smallest id reachable by links,
    rows with equal sets included. Rows without words (null and empty texts too) are linked
    with nothing and have their own id. Ids may be null (a component of such rows only has
    none) or repeated (the rows count one by one). ``copy_class`` is the same for rows with
    equal sets. Other columns play no part; an empty table gives an empty one.
    """
    rows = keyed(docs, text, doc_id).select("id", "fp", "text")
    described = stored(arrow_map(rows, _describe(words), "id long, fp long, n_shingles long, node long, bits binary"), "described")
    nodes = stored(
        described.where("node IS NOT NULL")
        .groupBy("node").agg(
            F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp")).alias("first"),
            F.first("n_shingles").alias("n"), F.first("bits").alias("bits"),
        )
        .select("node", "first.id", "first.fp", "n", "bits"),
        "nodes",
    )
    levels, rare, frequent = sketch_of(rows, words)
    sent = docs.sparkSession.sparkContext.broadcast(levels.tobytes())
    filed = stored(arrow_map(rows.select("text"), _file(sent, rare, frequent, words, percent), "key long, node long, n long"), "filed")
    shared = filed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("key")
    members = stored(filed.join(stored(shared, "shared"), "key").distinct(), "bucketed")

    def confirm(pairs: DataFrame) -> DataFrame:
        return similar_pairs(stored(possible_pairs(pairs, nodes, percent), "possible"), nodes, rows, percent, words)

    roots = components_of_buckets(members, nodes, rows, percent, words, confirm)
    labelled = nodes.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    component = labelled.groupBy("root").agg(F.min("id").alias("component_id"))
    by_node = stored(labelled.join(component, "root").select("node", "component_id"), "components")
    return described.join(by_node, "node", "left").select(
        F.col("id").alias("doc_id"), "n_shingles",
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("node").alias("copy_class"),
    )
