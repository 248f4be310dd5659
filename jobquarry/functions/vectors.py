"""Embedding helpers: pooling, batch inference, and the top-k kernel used in tasks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Scores are compared at this precision, so that equal vectors tie on every machine
# whatever order their products were added up in.
SCORE_DIGITS = 9
# Elements of one score block: 32 MB of doubles.
BLOCK_ELEMENTS = 4_000_000

EmbedFn = Callable[[list[str]], np.ndarray]


def last_token_pool(hidden: Column, mask: Column) -> Column:
    """The state of the last real token; with no real token, the last state."""
    tokens = F.aggregate(mask, F.lit(0), lambda total, bit: total + bit.cast("int"))
    return F.try_element_at(hidden, F.when(tokens > 0, tokens).otherwise(F.lit(-1)))


def pool_last_token(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The same for a model's batch output, for use inside an embedding function."""
    last = mask.sum(axis=1).astype(int) - 1
    return hidden[np.arange(hidden.shape[0]), last, :]


def embed_text(text: Column, make_model: Callable[[], EmbedFn], batch_size: int = 64) -> Column:
    """Text to vector with any model; ``make_model`` runs once per Python worker.

    The model sees whole texts in batches. A null text counts as an empty one. Marked as
    nondeterministic, so that Spark never runs the model again for a filter on its result.
    """

    def make_predict():
        model = make_model()

        def predict(texts: np.ndarray) -> np.ndarray:
            return np.asarray(model([t or "" for t in texts.reshape(-1)]), dtype=np.float32)

        return predict

    predict = predict_batch_udf(
        make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    )
    return predict.asNondeterministic()(F.coalesce(text, F.lit("")))


def batches_by_length(lengths: np.ndarray, budget: int) -> list[np.ndarray]:
    """Rows in batches of like length, each at most ``budget`` padded tokens or one row."""
    order, batches, start = np.argsort(lengths, kind="stable"), [], 0
    for end in range(1, len(order) + 1):
        # Rising lengths, so the next row is the longest of its batch.
        if end == len(order) or (end + 1 - start) * max(1, lengths[order[end]]) > budget:
            batches.append(order[start:end])
            start = end
    return batches


def embed_tokens(
    text: Column,
    make_tokenizer: Callable[[], Callable[[str], list[int]]],
    make_model: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]],
    *,
    max_tokens: int = 8192,
    budget: int = 65_536,
    pad: int = 0,
) -> Column:
    """Text to vector by way of tokens: cut to the model's length, padded, and batched by length.

    A tokenizer gives the ids of a text; the model takes a matrix of ids and its mask (1 for
    tokens, 0 for padding, which stands on the right) and returns a vector per row, as
    ``pool_last_token`` makes them. Both are made once per Python worker. The texts of an
    Arrow batch are sorted by length and cut into batches of ``budget`` padded tokens, so
    padding stays small, and put back in order. A null or empty text is one padding token.
    """
    made: dict = {}

    @F.arrow_udf("array<float>")
    def embed(texts: pa.Array) -> pa.Array:
        if not made:
            made.update(tokenizer=make_tokenizer(), model=make_model())
        ids = [(made["tokenizer"](t.as_py() or "") or [pad])[:max_tokens] for t in texts]
        lengths = np.array([len(i) for i in ids], np.int64)
        vectors: list = [None] * len(ids)
        for rows in batches_by_length(lengths, budget):
            width = int(lengths[rows].max())
            tokens, mask = np.full((len(rows), width), pad, np.int64), np.zeros((len(rows), width), np.int64)
            for at, row in enumerate(rows.tolist()):
                tokens[at, : lengths[row]], mask[at, : lengths[row]] = ids[row], 1
            for row, vector in zip(rows.tolist(), np.asarray(made["model"](tokens, mask), np.float32), strict=True):
                vectors[row] = vector
        return pa.array(vectors, pa.list_(pa.float32()))

    # Nondeterministic, so that Spark never runs the model again for a filter on its result.
    return embed.asNondeterministic()(text)


def hashing_model(dims: int) -> Callable[[], EmbedFn]:
    """A model without weights: token counts in hashed buckets.

    Stands in where no transformer is installed. A token is a run of letters, digits
    and underscores in lower case.
    """

    def make() -> EmbedFn:
        class Buckets(dict):
            def __missing__(self, token: str) -> int:
                if len(self) > 1_000_000:
                    self.clear()
                digest = hashlib.md5(token.encode("utf-8")).hexdigest()
                self[token] = bucket = int(digest[:8], 16) % dims
                return bucket

        bucket, token = Buckets().__getitem__, re.compile(r"[a-z0-9_]+")

        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dims), dtype=np.float32)
            for row, text in enumerate(texts):
                hits = np.fromiter(map(bucket, token.findall(text.lower())), dtype=np.int64)
                out[row] = np.bincount(hits, minlength=dims)
            return out

        return embed

    return make


def vector_matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """A list column whose rows all have ``dims`` values as a matrix; nulls become NaN."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dims)


def comparable(ids: pa.Array) -> np.ndarray:
    """Ids as an array numpy can sort: integers, or fixed-width text."""
    if pa.types.is_string(ids.type) or pa.types.is_large_string(ids.type):
        return np.asarray(ids.to_pylist(), dtype=np.str_)
    return ids.to_numpy(zero_copy_only=False)


class BestHits:
    """The running top k of every query, fed with blocks of corpus vectors.

    Order is score down, id up, decided on rounded scores, so the result does not
    depend on how the corpus was cut into blocks. Work is done in tiles of some queries by
    some corpus rows; the state is k places per query, and only queries with a hit in a
    tile have theirs merged.
    """

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries.astype(np.float64), k
        norms = np.linalg.norm(self.queries, axis=1)
        # Scores of unit vectors are products; a query without direction matches nothing.
        with np.errstate(invalid="ignore", divide="ignore"):
            self.queries /= np.where(norms > 0, norms, np.nan)[:, None]
        self.scores = np.full((len(queries), k), -np.inf)
        self.ids: np.ndarray | None = None

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        norms = np.linalg.norm(vectors.astype(np.float64), axis=1)
        usable = np.isfinite(norms) & (norms > 0)
        # By id, so that of equal scores those further left win.
        order = np.argsort(ids, kind="stable")
        order = order[usable[order]]
        if not len(order):
            return
        if self.ids is None:
            self.ids = np.zeros(self.scores.shape, ids.dtype)
        elif self.ids.dtype != ids.dtype:
            self.ids = self.ids.astype(np.promote_types(self.ids.dtype, ids.dtype))
        step = max(1, min(len(order), BLOCK_ELEMENTS // vectors.shape[1], BLOCK_ELEMENTS))
        for start in range(0, len(order), step):
            part = order[start : start + step]
            block = vectors[part].astype(np.float64) / norms[part, None]
            rows = max(1, BLOCK_ELEMENTS // len(part))
            for first in range(0, len(self.queries), rows):
                self._tile(slice(first, first + rows), ids[part], block)

    def _tile(self, own: slice, ids: np.ndarray, block: np.ndarray) -> None:
        scores = self.queries[own] @ block.T
        np.nan_to_num(scores, copy=False, nan=-np.inf)
        floor = self.scores[own, -1]
        # Nothing below a query's last place needs rounding or sorting.
        rows = np.flatnonzero(scores.max(1) >= 2 * floor - 1 - 1e-8)
        rows = rows[np.isfinite(scores[rows].max(1))]
        if not len(rows):
            return
        scores = scores if len(rows) == len(scores) else scores[rows]
        take = min(self.k, len(ids))
        if take < len(ids):
            cut = -np.partition(-scores, take - 1, axis=1)[:, take - 1] - 4e-9
            row, column = np.nonzero(scores >= cut[:, None])
        else:
            row, column = np.nonzero(np.isfinite(scores))
        rounded = np.round((1.0 + scores[row, column]) / 2.0, SCORE_DIGITS)
        # Rows come in order and columns by id, so a stable sort by score settles ties.
        order = np.lexsort((-rounded, row))
        row, column, rounded = row[order], column[order], rounded[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        kept = (place < take) & np.isfinite(rounded)
        best = np.full((len(rows), take), -np.inf)
        found = np.zeros((len(rows), take), ids.dtype)
        best[row[kept], place[kept]] = rounded[kept]
        found[row[kept], place[kept]] = ids[column[kept]]
        at = np.arange(len(self.queries))[own][rows]
        both = np.concatenate([self.scores[at], best], axis=1)
        both_ids = np.concatenate([self.ids[at], found], axis=1)
        order = np.lexsort((both_ids, -both), axis=1)[:, : self.k]
        self.scores[at] = np.take_along_axis(both, order, 1)
        self.ids[at] = np.take_along_axis(both_ids, order, 1)

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query rows, ids and scores of all places taken, best first within a query."""
        if self.ids is None:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        row, place = np.nonzero(np.isfinite(self.scores))
        return row, self.ids[row, place], self.scores[row, place]
