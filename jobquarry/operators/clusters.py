"""Exact search over a corpus stored in clusters, of which most are never read.

A cluster is a folder of the stored corpus with a centre and a radius over its unit
vectors. For unit vectors the distance grows as the cosine falls, so by the triangle
inequality no member of a cluster is nearer to a query than the distance of the centre less
the radius. A query searches its nearest clusters first, as many as hold k rows; the
distance of its k-th hit there rules out the clusters that lie beyond it. The result is
that of ``knn_search``: clusters only decide what need not be read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobquarry.functions.vectors import BestHits, comparable, vector_matrix
from jobquarry.operators.search import topk_hits, usable_vectors
from jobquarry.session import stored

#: Vectors that centres are fitted on; where they lie changes what is read, not what is found.
SAMPLE = 50_000
#: Rows of a cluster, and queries that search it, which meet in one task.
PART_ROWS, PART_QUERIES = 20_000, 5_000
#: Distances are trusted to this much, scores being rounded to nine digits.
MARGIN = 1e-4


def _units(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return matrix / np.where(norms > 0, norms, np.nan)[:, None]


def _placed(centres: np.ndarray, dims: int):
    """The nearest centre of each vector and its distance; -1 for vectors without direction."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _units(vector_matrix(batch.column("_cv"), dims).astype(np.float64))
            apart = 2 - 2 * units @ centres.T + (np.einsum("ij,ij->i", centres, centres) - 1)
            good = np.isfinite(apart).all(1) if len(centres) else np.zeros(len(units), bool)
            cell = np.full(len(units), -1)
            if good.any():
                cell[good] = apart[good].argmin(1)
            far = np.zeros(len(units))
            far[good] = np.linalg.norm(units[good] - centres[cell[good]], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(cell, pa.int32()), pa.array(far)], ["_row", "cell", "far"])

    return placed


def write_clustered(corpus: DataFrame, path: str, vector: str, dims: int, cells: int, seed: int = 1) -> None:
    """Store a corpus below ``path`` by clusters: ``rows/cell=n`` and the list of ``cells``.

    Rows whose vector is missing, of another length or without direction go to ``cell=-1``,
    which no search reads. The list of cells is ``cells * dims`` numbers.
    """
    units = usable_vectors(corpus, vector, vector, dims).select(F.col(vector).cast("array<double>").alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    sample = units.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))).withColumn("l", length).where("l > 0 AND l < double('infinity')")
    sample = stored(sample.orderBy(F.xxhash64("v")).limit(SAMPLE).select(F.transform("v", lambda x: x / F.col("l")).alias("v")), "sample")
    many = min(cells, sample.distinct().count())
    centres = np.zeros((0, dims))
    if many > 1:
        fitted = KMeans(k=many, seed=seed, maxIter=10, featuresCol="f").fit(sample.select(array_to_vector("v").alias("f")))
        centres = np.array(fitted.clusterCenters())
    elif many:
        centres = np.array([sample.first().v])
    row = F.struct(*(F.col(f"`{c}`") for c in corpus.columns))
    good = F.when(F.size(F.col(vector)) == dims, F.col(vector).cast("array<double>")).otherwise(F.array_repeat(F.lit(float("nan")), dims))
    kind = corpus.select(row.alias("_row")).schema["_row"].dataType
    placed = corpus.select(row.alias("_row"), F.coalesce(good, F.array_repeat(F.lit(float("nan")), dims)).alias("_cv")).mapInArrow(
        _placed(centres, dims), f"_row {kind.simpleString()}, cell int, far double"
    )
    placed.select("_row", "far", "cell").repartition("cell", F.pmod(F.xxhash64("_row"), F.lit(16))).write.partitionBy("cell").parquet(f"{path}/rows")
    spark = corpus.sparkSession
    radius = spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).where("cell >= 0")
    found = {r.cell: (r.radius, r.n) for r in radius.collect()}
    listed = [(c, float(found[c][0]), found[c][1], centres[c].tolist()) for c in sorted(found)]
    spark.createDataFrame(listed, "cell int, radius double, n long, centre array<double>").coalesce(1).write.parquet(f"{path}/cells")


def _bounds(cells: list, dims: int, k: int):
    """Per query: which clusters it must search first, and the least distance of all others."""
    centres = np.array([c.centre for c in cells]).reshape(-1, dims)
    radius, sizes = np.array([c.radius for c in cells]), np.array([c.n for c in cells])
    numbers = [c.cell for c in cells]

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _units(vector_matrix(batch.column("_qv"), dims))
            out: dict[str, list] = {"row": [], "cell": [], "first": [], "least": []}
            for i in np.flatnonzero(np.isfinite(units).all(1)).tolist():
                apart = np.linalg.norm(centres - units[i], axis=1)
                order = np.argsort(apart, kind="stable")
                enough = int(np.searchsorted(np.cumsum(sizes[order]), k)) + 1
                for place, c in enumerate(order.tolist()):
                    out["row"].append(i)
                    out["cell"].append(numbers[c])
                    out["first"].append(place < enough)
                    out["least"].append(max(0.0, float(apart[c] - radius[c])))
            at = pa.array(out.pop("row"), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column("_qv").take(at), pa.array(out["cell"], pa.int32()), pa.array(out["first"], pa.bool_()), pa.array(out["least"], pa.float64())],
                [batch.schema.names[0], "_qv", "cell", "first", "least"],
            )

    return bounds


def _meet(k: int, dims: int, query_id: str, corpus_id: str):
    def meet(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            kinds = [queries.schema.field(query_id).type, rows.schema.field(corpus_id).type, pa.float64()]
            return pa.table([pa.array([], kind) for kind in kinds], names=[query_id, corpus_id, "score"])
        found = rows.column(corpus_id).combine_chunks()
        best = BestHits(vector_matrix(queries.column("_qv").combine_chunks(), dims), k)
        best.add(comparable(found), vector_matrix(rows.column("_cv").combine_chunks(), dims))
        row, ids, scores = best.hits()
        return pa.table([queries.column(query_id).combine_chunks().take(pa.array(row)), pa.array(ids.tolist(), found.type), pa.array(scores)], names=[query_id, corpus_id, "score"])

    return meet


def search_clustered(
    queries: DataFrame, path: str, k: int, dims: int, *, query_id: str = "query_id", query_vector: str = "query_vector",
    corpus_id: str = "vec_id", corpus_vector: str = "embedding",
) -> DataFrame:
    """What ``knn_search`` finds, from a corpus that ``write_clustered`` stored."""
    spark = queries.sparkSession
    cells = spark.read.parquet(f"{path}/cells").collect()
    wanted = usable_vectors(queries, query_id, query_vector, dims).select(query_id, F.col(query_vector).cast("array<double>").alias("_qv"))
    kind = wanted.schema[query_id].dataType.simpleString()
    pairs = stored(wanted.mapInArrow(_bounds(cells, dims, k), f"`{query_id}` {kind}, _qv array<double>, cell int, first boolean, least double"), "bounds")
    sizes = {c.cell: max(1, math.ceil(c.n / PART_ROWS)) for c in cells}
    near = stored(_searched(spark, pairs.where("first"), path, k, dims, sizes, query_id, corpus_id, corpus_vector), "near")
    # score = (1 + cos) / 2 and distance ** 2 = 2 - 2 * cos.
    last = near.withColumn("place", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score")))).where(F.col("place") == k)
    last = last.select(F.col(query_id).alias("_q"), F.sqrt(F.greatest(F.lit(0.0), 4 - 4 * F.col("score"))).alias("reach"))
    others = pairs.where("NOT first").join(last, F.col(query_id) == F.col("_q"), "left")
    others = stored(others.where(F.col("reach").isNull() | (F.col("least") <= F.col("reach") + MARGIN)).select(*pairs.columns), "others")
    far = _searched(spark, others, path, k, dims, sizes, query_id, corpus_id, corpus_vector)
    return topk_hits(near.unionByName(far), k, query_id, corpus_id)


def cluster_rows(spark: SparkSession, path: str, cells: list[int]) -> DataFrame:
    """The stored rows of some clusters; files of others are pruned by their folder."""
    return spark.read.parquet(f"{path}/rows").where(F.col("cell").isin(cells))


def _searched(spark, pairs: DataFrame, path: str, k: int, dims: int, sizes: dict[int, int], query_id: str, corpus_id: str, corpus_vector: str) -> DataFrame:
    """Hits of pairs of query and cluster; each part of a cluster meets blocks of its queries."""
    asked = {r.cell: max(1, math.ceil(r["count"] / PART_QUERIES)) for r in pairs.groupBy("cell").count().collect()}
    rows = cluster_rows(spark, path, sorted(asked)).select("cell", F.col(f"_row.{corpus_id}").alias(corpus_id), F.col(f"_row.{corpus_vector}").alias("_cv"))
    rows = rows.where(F.col(corpus_id).isNotNull())
    number = lambda of: F.try_element_at(F.create_map(*(F.lit(x) for c in asked for x in (c, of[c]))), F.col("cell")) if asked else F.lit(1)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    deal = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    left = pairs.select(query_id, "_qv", "cell", deal(query_id, number(asked)).alias("block"), every(number(sizes)).alias("part"))
    right = rows.select("*", deal(corpus_id, number(sizes)).alias("part"), every(number(asked)).alias("block"))
    task = ["cell", "part", "block"]
    kinds = f"`{query_id}` {pairs.schema[query_id].dataType.simpleString()}, `{corpus_id}` {rows.schema[corpus_id].dataType.simpleString()}, score double"
    return left.groupBy(*task).cogroup(right.groupBy(*task)).applyInArrow(_meet(k, dims, query_id, corpus_id), kinds)
