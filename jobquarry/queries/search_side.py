"""Embedding, pooling and nearest-neighbour search."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from jobquarry.functions import vectors
from jobquarry.functions.vectors import hashing_model, last_token_pool, pool_last_token
from jobquarry.operators import clusters, search
from jobquarry.operators.unnest import unnest
from jobquarry.queries.registry import query, split_table, table
from jobquarry.session import scratch_path
from jobquarry.sources.readers import document_pages_text

DIMS = 64
K = 10
TEXT_DIMS = 32


def label_centres(spark, sf):
    """One query vector per label: the mean of all its vectors."""
    mean = F.array(*(F.avg(F.col("embedding")[i].cast("double")) for i in range(DIMS)))
    return (
        table(spark, sf, "embeddings")
        .groupBy("label")
        .agg(mean.alias("query_vector"))
        .select(F.col("label").cast("long").alias("query_id"), "query_vector")
    )


CENTRES_SQL = """
centres AS (
  SELECT label AS query_id, list(x ORDER BY i) AS query_vector
  FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x
        FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
        GROUP BY label, i)
  GROUP BY label),
scored AS (
  SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, label,
         round((1 + list_cosine_similarity(query_vector, CAST(embedding AS DOUBLE[]))) / 2, 9) AS score
  FROM centres, embeddings)"""


KNN_SQL = "WITH" + CENTRES_SQL + """
SELECT query_id, vec_id, round(score, 6) AS score,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS hit_rank
FROM scored QUALIFY hit_rank <= 10"""


@query("clustered_search", KNN_SQL)
def clustered_search(spark, sf):
    """The same hits from a corpus stored in clusters, of which only near ones are read."""
    path = scratch_path(spark, "clusters")
    clusters.write_clustered(table(spark, sf, "embeddings"), path, "embedding", DIMS, 12)
    return clusters.search_clustered(label_centres(spark, sf), path, K, DIMS).withColumn("score", F.round("score", 6))


@query("knn_search", KNN_SQL)
def knn_search(spark, sf):
    hits = search.knn_search(label_centres(spark, sf), table(spark, sf, "embeddings"), K, DIMS)
    return hits.withColumn("score", F.round("score", 6))


@query(
    "filtered_knn",
    "WITH" + CENTRES_SQL + """
SELECT query_id, vec_id, round(score, 6) AS score,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS hit_rank
FROM scored WHERE label IN (1, 3, 5, 7) QUALIFY hit_rank <= 10""",
)
def filtered_knn(spark, sf):
    hits = search.knn_search(
        label_centres(spark, sf), table(spark, sf, "embeddings"), K, DIMS,
        where=F.col("label").isin(1, 3, 5, 7),
    )
    return hits.withColumn("score", F.round("score", 6))


@query(
    "topk_hits",
    """
SELECT o_custkey AS query_id, o_orderkey AS order_id, o_totalprice AS score,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS hit_rank
FROM orders QUALIFY hit_rank <= 3""",
)
def topk_hits(spark, sf):
    """Orders stand for hits already scored, customers for queries."""
    hits = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("order_id"),
        F.col("o_totalprice").alias("score"),
    )
    return search.topk_hits(hits, 3, "query_id", "order_id")


@query(
    "last_token_pool",
    """
SELECT vec_id, CAST(generate_subscripts(state, 1) - 1 AS BIGINT) AS pos,
       round(CAST(unnest(state) AS DOUBLE), 6) AS x
FROM (SELECT vec_id, CASE WHEN label = 0 THEN embedding[57:64] ELSE embedding[8 * label - 7:8 * label] END AS state
      FROM (SELECT vec_id, embedding, least(label, 8) AS label FROM embeddings))""",
)
def last_token_pool_query(spark, sf):
    """A vector as eight token states of eight values, masked after as many as its label."""
    states = F.array(*(F.slice("embedding", 8 * i + 1, 8) for i in range(8)))
    mask = F.array(*(F.when(F.col("label") > i, 1).otherwise(0) for i in range(8)))
    pooled = table(spark, sf, "embeddings").select(
        "vec_id", F.posexplode(last_token_pool(states, mask)).alias("pos", "x")
    )
    return pooled.select(
        "vec_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("x").cast("double"), 6).alias("x")
    )


BUCKETS_SQL = """
buckets AS (
  SELECT {key}, ('0x' || substr(md5(token), 1, 8))::BIGINT % 32 AS dim, CAST(count(*) AS DOUBLE) AS x
  FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM {source})
  GROUP BY ALL)"""


@query(
    "embed_text",
    "WITH" + BUCKETS_SQL.format(key="doc_id", source="documents") + " SELECT doc_id, dim, x FROM buckets",
)
def embed_text(spark, sf):
    """The hashing model over whole documents, non-zero values only."""
    vectors = search.embed_table(
        split_table(spark, sf, "documents", "doc_id").select("doc_id", "text"), "text", hashing_model(TEXT_DIMS), "doc_id"
    )
    values = unnest(vectors, F.col("embedding").cast("array<double>"), "doc_id", pos="dim", item="x")
    return values.where("x <> 0")


SEARCH_SQL = (
    """
WITH joined AS (SELECT conv_id AS query_id, string_agg(text, '' ORDER BY turn, text) AS text
                FROM conversations GROUP BY conv_id),"""
    + BUCKETS_SQL.format(key="query_id", source="joined").replace("buckets AS", "q AS")
    + ","
    + BUCKETS_SQL.format(key="doc_id", source="documents").replace("buckets AS", "d AS")
    + """,
qn AS (SELECT query_id, sqrt(sum(x * x)) AS n FROM q GROUP BY 1),
dn AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM d GROUP BY 1),
dots AS (SELECT query_id, doc_id, sum(q.x * d.x) AS dot FROM q JOIN d USING (dim) GROUP BY 1, 2),
scored AS (
  SELECT query_id, doc_id, round((1 + coalesce(dot, 0) / (qn.n * dn.n)) / 2, 9) AS score
  FROM qn CROSS JOIN dn LEFT JOIN dots USING (query_id, doc_id)),
hits AS (
  SELECT query_id, doc_id, score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS hit_rank
  FROM scored QUALIFY hit_rank <= 10)"""
)


def resume_hits(spark, sf):
    """Whole conversations as paged query documents against all documents."""
    queries = document_pages_text(
        table(spark, sf, "conversations"), "conv_id", "turn", "text"
    ).select(F.col("conv_id").alias("query_id"), F.col("text").alias("query_text"))
    corpus = search.embed_table(
        split_table(spark, sf, "documents", "doc_id").select("doc_id", "text"), "text", hashing_model(TEXT_DIMS), "doc_id"
    )
    return search.semantic_search(queries, corpus, K, TEXT_DIMS, hashing_model(TEXT_DIMS))


@query(
    "semantic_search",
    SEARCH_SQL + " SELECT query_id, doc_id, round(score, 6) AS score, hit_rank FROM hits",
)
def semantic_search(spark, sf):
    return resume_hits(spark, sf).withColumn("score", F.round("score", 6))


@query(
    "shape_hits",
    SEARCH_SQL + """
SELECT query_id, hit_rank, lang AS title, source AS url, h.doc_id AS job_id, md5(text) AS job_text_md5,
       FALSE AS has_vector, round(score, 6) AS score
FROM hits h JOIN documents d ON h.doc_id = d.doc_id""",
)
def shape_hits(spark, sf):
    """The JSON answers, taken apart again so that both engines' number formats agree."""
    corpus = table(spark, sf, "documents").withColumn("vector", F.array(F.lit(0.0)))
    shaped = search.shape_hits(
        resume_hits(spark, sf), corpus, "query_id", "hit_rank",
        corpus_id="doc_id", vector="vector", title="lang", url="source",
    )
    answer = "title string, url string, job struct<doc_id: long, text: string, vector: string>, score double"
    return shaped.select("query_id", "hit_rank", F.from_json("response", answer).alias("r")).select(
        "query_id", "hit_rank", "r.title", "r.url",
        F.col("r.job.doc_id").alias("job_id"),
        F.md5("r.job.text").alias("job_text_md5"),
        F.col("r.job.vector").isNotNull().alias("has_vector"),
        F.round("r.score", 6).alias("score"),
    )


def word_lengths():
    """A tokenizer without a vocabulary: the length of each word."""
    return lambda text: [len(word) for word in re.findall(r"[^\x20\x09-\x0D]+", text)]


def sum_and_last():
    """A model without weights: the sum of the tokens so far, and the token, of the last one."""
    return lambda tokens, mask: pool_last_token(np.stack([np.cumsum(tokens * mask, 1), tokens], 2), mask)


@query(
    "embed_tokens",
    """
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')[1:512] AS w FROM documents)
SELECT doc_id, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS DOUBLE) AS total,
       CAST(CASE WHEN len(w) > 0 THEN length(w[-1]) ELSE 0 END AS DOUBLE) AS last
FROM words""",
)
def embed_tokens(spark, sf):
    """Texts as tokens, cut to 512 and batched by length."""
    docs = split_table(spark, sf, "documents", "doc_id").select("doc_id", "text")
    vector = vectors.embed_tokens(F.col("text"), word_lengths, sum_and_last, max_tokens=512)
    return docs.select("doc_id", vector.alias("v")).select("doc_id", F.col("v")[0].cast("double").alias("total"), F.col("v")[1].cast("double").alias("last"))
