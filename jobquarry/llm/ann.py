"""Approximate nearest neighbours: a forest of hash-prefix trees, as sorted arrays.

1. Equal vectors are one class, indexed once; its smallest ids stand for it at the end.
2. Each of 40 trees hashes a vector to a long string: after a random rotation, the signed
   coordinates in order of falling magnitude, packed into 63 bits. Near vectors share long
   prefixes. A tree is its sorted strings, cut by first symbol over the tasks; a symbol
   with very many vectors is cut further by a hash of the class, since everything below
   adds up over such cuts.
3. Descent: in each tree a query finds the range of strings that share its first 1, 2, ...
   symbols, by binary search, down to the longest prefix that occurs.
4. Synchronous ascent: all trees give way symbol by symbol together, until the ranges of
   the query's level hold enough candidates over all trees: a share of the index, and as
   many as ``DENSE`` times the largest range of one symbol, which is about the size of the
   cluster a query is in. Ranges of one cluster overlap, so a share of the index alone would
   be reached there with few different candidates. What is needed is one count per query,
   tree and level.
5. The candidates are compared by exact cosine where they lie; a task returns the best few
   of each query. Queries that have too few candidates even at one symbol (tiny tables), or
   whose ranges together hold more than the whole index (large clusters), ascend to the
   root and meet all rows once, in blocks, which is exact.

``candidates`` is a share of the index: among vectors without structure, neighbours are
hardly nearer than the rest, and no index reaches a recall of 0.9 with less. Within a
cluster the same holds for the cluster's rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobquarry.llm.frames import stored, whole_groups

TREES = 40
#: Candidates (over all trees) at which the ascent stops: this share of the index, and this many.
SHARE, LEAST = 0.05, 256
#: And this many times the largest range of one symbol, so that it also holds inside clusters.
DENSE = 1.5
#: Strings have at most this many symbols: 12 is what 63 bits hold at best for 12 or more symbols.
LEVELS = 12
#: Vectors per task of a tree's first symbol.
BLOCK = 16_384


@lru_cache(maxsize=256)
def _rotation(dim: int, tree: int) -> np.ndarray:
    drawn = np.random.default_rng((dim, tree)).standard_normal((dim, dim))
    return np.linalg.qr(drawn)[0] if dim <= 1024 else drawn


def symbol_bits(dim: int) -> int:
    return max(1, (2 * dim - 1).bit_length())


def string_length(dim: int) -> int:
    return min(LEVELS, 63 // symbol_bits(dim), dim)


def strings(vectors: np.ndarray, tree: int) -> np.ndarray:
    """The hash strings of the rows in one tree, packed first symbol highest."""
    dim = vectors.shape[1]
    turned = vectors @ _rotation(dim, tree)
    length, bits = string_length(dim), symbol_bits(dim)
    order = np.argsort(-np.abs(turned), axis=1, kind="stable")[:, :length]
    symbols = 2 * order + (np.take_along_axis(turned, order, 1) < 0)
    out = np.zeros(len(vectors), np.int64)
    for k in range(length):
        out = (out << bits) | symbols[:, k]
    return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Packed vectors of one length as rows of doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.asarray(v, np.float64).tobytes() for v in batch.column("v").to_pylist()]
        at = batch.schema.get_field_index("v")
        yield batch.set_column(at, "v", pa.array(rows, pa.binary()))


def _hashed(trees: int, vectors: bool):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.take(pa.array(np.flatnonzero(dims == dim)))
                for start in range(0, own.num_rows, 2048):
                    part = own.slice(start, 2048)
                    rows = _matrix(part.column("v"))
                    shift = symbol_bits(dim) * (string_length(dim) - 1)
                    for tree in range(trees):
                        codes = strings(rows, tree)
                        columns = [part.column("class"), part.column("dim"), pa.array(np.full(len(codes), tree, np.int32)),
                                   pa.array((codes >> shift).astype(np.int32)), pa.array(codes), part.column("is_query")]
                        names = ["class", "dim", "tree", "head", "code", "is_query"]
                        if vectors:
                            columns, names = [*columns, *(part.column(c) for c in ("first", "single", "v"))], [*names, "first", "single", "v"]
                        yield pa.RecordBatch.from_arrays(columns, names)

    return hashed


_KEYS = ["dim", "tree", "head", "block"]


def _groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """One table per block of a tree's symbol."""
    for table in whole_groups(batches, _KEYS, rows):
        new = np.ones(table.num_rows, bool)
        new[1:] = False
        for name in _KEYS:
            values = table.column(name).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        starts = np.append(np.flatnonzero(new), table.num_rows)
        for low, high in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            yield table.slice(low, high - low)


def _ranges(codes: np.ndarray, wanted: np.ndarray, level: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Where, among sorted codes, those begin and end that share ``level`` symbols with each wanted one."""
    shift = (symbol_bits(dim) * (string_length(dim) - level)).astype(np.int64)
    low = (wanted >> shift) << shift
    return np.searchsorted(codes, low, "left"), np.searchsorted(codes, low | ((np.int64(1) << shift) - 1), "right")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each query of a block, how many strings share its first 1, 2, ... symbols."""
    for group in _groups(batches, 50_000):
        dim = group.column("dim")[0].as_py()
        asks, codes = group.column("asks").to_numpy(zero_copy_only=False), group.column("code").to_numpy()
        wanted, index = codes[asks], np.sort(codes[~asks])
        if not len(wanted):
            continue
        counts = np.zeros((len(wanted), LEVELS), np.int64)
        for k in range(string_length(dim)):
            low, high = _ranges(index, wanted, np.full(len(wanted), k + 1), dim)
            counts[:, k] = high - low
        yield pa.RecordBatch.from_arrays(
            [pa.array(group.column("class").to_numpy()[asks]), pa.array(group.column("tree").to_numpy()[asks]), *(pa.array(counts[:, k].copy()) for k in range(LEVELS))],
            ["class", "tree", *(f"n{k + 1}" for k in range(LEVELS))],
        )


def _nearest(k: int):
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 5_000):
            dim = group.column("dim")[0].as_py()
            asks = group.column("asks").to_numpy(zero_copy_only=False)
            if not asks.any() or asks.all():
                continue
            classes, codes = group.column("class").to_numpy(), group.column("code").to_numpy()
            level = group.column("level").to_numpy()[asks]
            vectors = _matrix(group.column("v"))
            order = np.flatnonzero(~asks)[np.argsort(codes[~asks], kind="stable")]
            low, high = _ranges(codes[order], codes[asks], level, dim)
            queries, asked = vectors[asks], classes[asks]
            index, first = vectors[order], group.column("first").to_numpy()[order]
            single = group.column("single").to_numpy(zero_copy_only=False)[order]
            names = group.column("own").filter(pa.array(asks)).to_pylist()
            norms, own = np.sqrt((index * index).sum(1)), np.sqrt((queries * queries).sum(1))
            out: list[tuple[np.ndarray, ...]] = []
            own_ids: list[int | None] = []
            for start in range(0, len(queries), 256):
                rough = (queries[start : start + 256] @ index.T) / norms
                for i, row in enumerate(rough, start):
                    at = np.arange(low[i], high[i])
                    if names[i] is not None:
                        # Rows that only the query's own id has are not its neighbours.
                        at = at[~(single[at] & (first[at] == names[i]))]
                    if len(at) > 2 * k:
                        # All that may tie, up to rounding, with the last one needed.
                        at = at[row[at] >= -np.partition(-row[at], 2 * k)[2 * k] - 1e-9 * own[i]]
                    # The same order of sums for every pair, whatever the block.
                    exact = (index[at] * queries[i]).sum(1) / (norms[at] * own[i])
                    best = np.lexsort((first[at], -exact))[: k + 2]
                    own_ids.extend([names[i]] * len(best))
                    out.append((np.full(len(best), asked[i]), classes[order[at[best]]], exact[best]))
            if out:
                columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([columns[0], pa.array(own_ids, pa.int64()), *columns[1:]], ["query", "own", "class", "score"])

    return nearest


def _in_blocks(rows: DataFrame, blocks: DataFrame, on: list[str]) -> DataFrame:
    """Index rows in one block of their symbol each; queries once more in every block, as ``asks``."""
    joined = rows.join(blocks, on)
    index = joined.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).withColumn("asks", F.lit(False))
    asking = joined.where("is_query").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asks", F.lit(True))
    return index.union(asking.select(index.columns))


def nearest_neighbours(vectors: DataFrame, is_query: str, k: int = 5, trees: int = TREES, share: float = SHARE, least: int = LEAST,
                       vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k nearest rows found for each row that ``is_query``.

    ``is_query`` is an SQL condition on the column ``id``. Score is the cosine in double
    precision; ties go to the smaller id. Vectors that are null, empty, zero or hold null or
    non-finite values take no part, nor do rows without an id; only vectors of the same
    length are compared. Rows with the query's own id are not its neighbours. Rows equal
    in id and vector count once. Fewer candidates than k give fewer rows; other columns
    play no part.
    """
    asking = F.expr(is_query)
    v = F.col(f"`{embedding}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    )
    rows = rows.select("id", F.xxhash64("v").alias("class"), F.size("v").alias("dim"), "v")
    ids = stored(rows.select("id", "class", asking.alias("is_query")).distinct(), "ids")
    classes = rows.groupBy("class", "dim").agg(F.min("id").alias("first"), (F.min("id") == F.max("id")).alias("single"), F.first("v").alias("v"), F.max(asking.cast("int")).cast("boolean").alias("is_query"))
    classes = stored(
        classes.mapInArrow(_packed, "class long, dim int, first long, single boolean, v binary, is_query boolean"), "vectors"
    )
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    enough = F.create_map(*(F.lit(x) for dim, n in sizes.items() for x in (dim, max(least, int(share * n))))) if sizes else F.lit(None).cast("map<int,int>")

    light = stored(
        classes.mapInArrow(_hashed(trees, False), "class long, dim int, tree int, head int, code long, is_query boolean"), "strings"
    )
    on = ["dim", "tree", "head"]
    blocks = stored(light.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "blocks")
    counted = _in_blocks(light, blocks, on).select(*_KEYS, "class", "code", "asks")
    counted = counted.repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(
        _counts, "class long, tree int, " + ", ".join(f"n{i + 1} long" for i in range(LEVELS))
    )
    # Over the blocks of a symbol first: the largest range is one tree's.
    summed = [F.sum(f"n{i + 1}").alias(f"n{i + 1}") for i in range(LEVELS)]
    totals = counted.groupBy("class", "tree").agg(*summed).groupBy("class").agg(*summed, F.max("n1").alias("widest"))
    asked = classes.where("is_query").select("class", "dim").join(totals, "class", "left")
    level, rows_in_all = F.lit(0), F.create_map(*(F.lit(x) for pair in sizes.items() for x in pair)) if sizes else F.lit(None).cast("map<int,long>")
    needed = F.greatest(F.element_at(enough, F.col("dim")), DENSE * F.coalesce("widest", F.lit(0)))
    for i in range(1, LEVELS + 1):
        n = F.coalesce(F.col(f"n{i}"), F.lit(0))
        level = F.when(n >= needed, F.when(n <= F.element_at(rows_in_all, F.col("dim")), F.lit(i)).otherwise(F.lit(0))).otherwise(level)
    # One search per class that asks; one more for each of its ids that other vectors have too.
    several = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    repeated = ids.where("is_query").join(several, "id").select("class", F.col("id").alias("own"))
    searches = stored(ids.where("is_query").join(several, "id", "left_anti").select("class", F.lit(None).cast("long").alias("own")).distinct().union(repeated), "searches")
    levels = stored(asked.select("class", level.cast("int").alias("level")).join(searches, "class"), "levels")

    heavy = classes.mapInArrow(_hashed(trees, True), "class long, dim int, tree int, head int, code long, is_query boolean, first long, single boolean, v binary")
    found = _search(_in_blocks(heavy, blocks, on).join(levels.withColumnRenamed("class", "asked"), F.col("asks") & (F.col("class") == F.col("asked")), "left"), k)
    at_root = levels.where("level = 0")
    if not at_root.isEmpty():
        whole = classes.withColumns({"tree": F.lit(-1), "head": F.lit(-1), "code": F.lit(0).cast("long")})
        count = F.create_map(*(F.lit(x) for dim, n in sizes.items() for x in (dim, -(-n // block))))
        whole = whole.withColumn("blocks", F.element_at(count, F.col("dim"))).drop("is_query")
        index = whole.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).withColumn("asks", F.lit(False)).withColumn("level", F.lit(None).cast("int")).withColumn("own", F.lit(None).cast("long"))
        at_all = whole.join(at_root, "class").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asks", F.lit(True))
        found = found.union(_search(index.union(at_all.select(index.columns)), k))
    best = found.groupBy("query", "own", "class").agg(F.max("score").alias("score"))
    return _expanded(best, ids, searches, k)


def _search(rows: DataFrame, k: int) -> DataFrame:
    wanted = rows.where("NOT asks OR level IS NOT NULL").select(*_KEYS, "class", "code", "asks", F.coalesce("level", F.lit(-1)).alias("level"), "own", "first", "single", "v")
    # Queries that search at the root are not asked for in the trees.
    wanted = wanted.where("NOT asks OR level > 0 OR tree < 0")
    return wanted.repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(_nearest(k), "query long, own long, class long, score double")


def _expanded(best: DataFrame, ids: DataFrame, searches: DataFrame, k: int) -> DataFrame:
    """Classes to rows: of each class its k + 1 smallest ids, one more for the query itself."""
    few = Window.partitionBy("class").orderBy("id")
    members = stored(ids.withColumn("place", F.row_number().over(few)).where(F.col("place") <= k + 1).select("class", "id"), "members")
    first = members.groupBy("class").agg(F.min("id").alias("first"))
    nearest = Window.partitionBy("query", "own").orderBy(F.col("score").desc(), "first")
    top = best.join(first, "class").withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= k + 1)
    top = stored(top.select("query", "own", "class", "score"), "best")
    named = searches.where("own IS NOT NULL").select("class", F.col("own").alias("id"), "own")
    asking = ids.where("is_query").join(named, ["class", "id"], "left").select(F.col("class").alias("query"), F.col("id").alias("query_id"), F.col("own").alias("asker"))
    pairs = asking.join(top, "query").where("asker <=> own").drop("asker", "own").join(members, "class").where("id <> query_id")
    order = Window.partitionBy("query", "query_id").orderBy(F.col("score").desc(), "id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
