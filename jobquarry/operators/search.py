"""Exact nearest-neighbour search over a vector table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobquarry.functions.vectors import (
    BestHits,
    EmbedFn,
    comparable,
    embed_text,
    vector_matrix,
)
from jobquarry.session import stored

# Query vectors broadcast at once, and corpus vectors they meet.
QUERY_BLOCK_BYTES = 32 * 1024 * 1024
CORPUS_BLOCK_BYTES = 32 * 1024 * 1024


def topk_hits(hits: DataFrame, k: int, query: str = "query_id", order: str = "vec_id") -> DataFrame:
    """The best k rows per query with their rank.

    Planned as a group limit on both sides of the shuffle, so each task sends at most k
    rows per query however many one query has.
    """
    ranking = Window.partitionBy(query).orderBy(F.desc("score"), F.asc(order))
    ranked = hits.withColumn("hit_rank", F.row_number().over(ranking))
    return ranked.where(F.col("hit_rank") <= k)


def usable_vectors(df: DataFrame, row_id: str, vector: str, dims: int) -> DataFrame:
    """Rows with an id and a vector of the right length.

    Nulls inside a vector become NaN in the kernel, which drops those rows; looking for
    them here would walk every vector once more.
    """
    return df.where(F.col(row_id).isNotNull() & (F.size(vector) == dims))


def knn_search(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    dims: int,
    *,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    corpus_id: str = "vec_id",
    corpus_vector: str = "embedding",
    where: Column | None = None,
    query_bytes: int = QUERY_BLOCK_BYTES,
    corpus_bytes: int = CORPUS_BLOCK_BYTES,
) -> DataFrame:
    """The k corpus rows nearest to each query: (query, id, score, hit_rank).

    score = (1 + cosine) / 2. ``where`` filters the corpus before ranking. Only the id
    and the vector of the corpus are read.

    The query side is computed once and stored in the shared folder. The corpus stays
    where it lies and is scanned once for each group of queries, of ``query_bytes`` at most,
    that is broadcast to the tasks. A task takes a block of the corpus at a time and returns
    k rows per query and block. So memory is a group, a block and the hits of one, whatever
    the number of queries, and all that is read, is read by Spark.
    """
    if where is not None:
        corpus = corpus.where(where)
    wanted = usable_vectors(queries, query_id, query_vector, dims).select(
        F.col(query_id), F.col(query_vector).cast("array<double>").alias("_qv")
    )
    wanted = stored(wanted, "query-vectors")
    rows = usable_vectors(corpus, corpus_id, corpus_vector, dims).select(
        F.col(corpus_id), F.col(corpus_vector).alias("_cv")
    )
    id_type = lambda df, name: df.schema[name].dataType.simpleString()
    schema = (
        f"`{query_id}` {id_type(wanted, query_id)}, `{corpus_id}` {id_type(rows, corpus_id)}, score double"
    )
    corpus_rows = max(1, corpus_bytes // (dims * 8))
    names = [query_id, corpus_id, "score"]
    scored = None
    for group in _query_groups(wanted, query_id, max(1, query_bytes // (dims * 8))):
        part = rows.mapInArrow(_scorer(group, k, dims, corpus_rows, names), schema)
        scored = part if scored is None else scored.union(part)
    return topk_hits(scored, k, query_id, corpus_id)


def _query_groups(wanted: DataFrame, query_id: str, limit: int) -> Iterator[Broadcast]:
    """The queries in groups of about ``limit`` rows, each sent to the tasks as one Arrow table."""
    context, groups = wanted.sparkSession.sparkContext, max(1, -(-wanted.count() // limit))
    for group in range(groups):
        # Ids may repeat, but a group is a share of the ids' hashes and so of the rows.
        part = wanted.where(F.pmod(F.xxhash64(query_id, "_qv"), F.lit(groups)) == group) if groups > 1 else wanted
        table = part.toArrow()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        yield context.broadcast(sink.getvalue().to_pybytes())


def _scorer(queries: Broadcast, k: int, dims: int, corpus_rows: int, names: list[str]):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, count = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, corpus_rows):
                part = batch.slice(start, corpus_rows)
                if held and count + part.num_rows > corpus_rows:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, count = [], 0
                held.append(part)
                count += part.num_rows
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.ipc.open_stream(queries.value).read_all().combine_chunks()
        if not table.num_rows:
            return
        query_ids, matrix = table.column(0).combine_chunks(), vector_matrix(table.column(1).combine_chunks(), dims)
        for block in blocks(batches):
            found = block.column(0).combine_chunks()
            best = BestHits(matrix, k)
            best.add(comparable(found), vector_matrix(block.column(1).combine_chunks(), dims))
            row, hit_ids, scores = best.hits()
            yield pa.RecordBatch.from_arrays(
                [query_ids.take(pa.array(row)), pa.array(hit_ids.tolist(), found.type), pa.array(scores)], names
            )

    return score


def shape_hits(
    hits: DataFrame,
    corpus: DataFrame,
    *keep: str,
    corpus_id: str,
    vector: str | None = None,
    title: str = "title",
    url: str = "source_url",
) -> DataFrame:
    """Hits as JSON ``{title, url, job, score}``, the vector left out of ``job``.

    The wide corpus rows are only joined here, to k rows per query. The hits are stored
    first, so Spark knows their size: few are broadcast, and the corpus then stays where
    it is; many are shuffled with it.
    """
    hits = stored(hits, "hits")
    fields = [name for name in corpus.columns if name != vector]
    wide = corpus.select(F.col(corpus_id), F.struct(*fields).alias("job"))
    answer = F.struct(
        F.col(f"job.{title}").alias("title"),
        F.col(f"job.{url}").alias("url"),
        F.col("job"),
        F.col("score"),
    )
    return hits.join(wide, corpus_id).select(
        *keep, F.to_json(answer, {"ignoreNullFields": "false"}).alias("response")
    )


def embed_table(
    df: DataFrame, text: str, make_model: Callable[[], EmbedFn], *keep: str, into: str = "embedding"
) -> DataFrame:
    """A table with its vector column added."""
    return df.select(*keep, embed_text(F.col(text), make_model).alias(into))


def semantic_search(
    queries: DataFrame,
    corpus: DataFrame,
    k: int | str,
    dims: int,
    make_model: Callable[[], EmbedFn],
    *,
    query_id: str = "query_id",
    query_text: str = "query_text",
    corpus_id: str = "doc_id",
    corpus_vector: str = "embedding",
    where: Column | None = None,
) -> DataFrame:
    """Many text queries against an embedded corpus: (query, id, score, hit_rank).

    ``k`` is one number, or the column of ``queries`` with each query's own; the search
    then runs for the largest, and each query's surplus hits are dropped.
    """
    if isinstance(k, str):
        most = queries.agg(F.max(k)).first()[0] or 1
        hits = semantic_search(
            queries, corpus, most, dims, make_model, query_id=query_id, query_text=query_text,
            corpus_id=corpus_id, corpus_vector=corpus_vector, where=where,
        )
        limits = queries.select(query_id, F.col(k).alias("_k"))
        return hits.join(limits, query_id).where(F.col("hit_rank") <= F.col("_k")).drop("_k")
    vectors = embed_table(queries, query_text, make_model, query_id, into="query_vector")
    return knn_search(
        vectors,
        corpus,
        k,
        dims,
        query_id=query_id,
        corpus_id=corpus_id,
        corpus_vector=corpus_vector,
        where=where,
    )
