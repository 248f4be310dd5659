"""Languages of a document as a mixture, by expectation-maximisation.

Model: per language, a smoothed distribution over hashed byte trigrams of lower-cased
words, counted over all training rows (partial sums per task, then one row per language
and trigram; only those counts, at most 2 ** 15 per language, reach the driver).

Prediction: each word's log-likelihood under each language is the sum over its trigrams.
A document's words are drawn from a mixture of languages. Starting from the best single
language, languages are added one by one: one is tried only if a small share of it would
raise the likelihood, expectation-maximisation finds the proportions, and it stays if the
likelihood less a penalty per language rises. Null proportions do not occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobquarry.llm.frames import chunks
from jobquarry.llm.hashing import joined_bytes

BUCKETS = 1 << 15
#: Added to each trigram count.
SMOOTHING = 0.5
#: Log-likelihood that a further language must gain, times log(number of words + 1).
PENALTY = 2.0
ROUNDS = 12
UNKNOWN = "und"

_LETTER = np.ones(256, bool)
_LETTER[:128] = False
_LETTER[[*range(ord("a"), ord("z") + 1)]] = True


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of all texts, where each word begins in them, and each text's first word.

    A word begins with the space before it and includes trigrams that run into the next
    space; runs of anything but letters are one space.
    """
    data, offsets = joined_bytes(pa.array([f" {t.lower()}  " for t in texts], pa.large_string()))
    letters = _LETTER[data]
    # Of each run of non-letters only the last byte stays, as a space.
    keep = letters.copy()
    keep[:-1] |= ~letters[:-1] & letters[1:]
    ends = offsets[1:] - 1
    keep[ends] = True
    keep[ends - 1] = True
    data = np.where(letters, data, 0x20)[keep].astype(np.uint32)
    moved = np.concatenate([[0], np.cumsum(keep)])
    offsets = moved[offsets]
    packed = np.zeros(len(data), np.uint32)
    packed[:-2] = data[:-2] | (data[1:-1] << np.uint32(8)) | (data[2:] << np.uint32(16))
    buckets = ((packed * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)
    starts = np.flatnonzero(data == 0x20)
    first = np.searchsorted(starts, offsets)
    return buckets, starts, first


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`trigrams`, without the spaces that end a text and begin no word."""
    buckets, starts, first = trigrams(texts)
    ends = np.append(starts[1:], len(buckets))
    real = ends - starts > 1
    counted = np.concatenate([[0], np.cumsum(real)])
    return buckets, np.stack([starts[real], ends[real]]), counted[first]


def _sums(values: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Sums of rows over half-open spans."""
    total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[spans[1]] - total[spans[0]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, row in counts.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at])], ["lang", "bucket", "n"])
        counts.clear()

    for chunk in chunks(batches, "text"):
        buckets, spans, first = _words(chunk.column("text").to_pylist())
        langs = chunk.column("lang").to_pylist()
        for i, lang in enumerate(langs):
            own = spans[:, first[i] : first[i + 1]]
            if own.shape[1]:
                if lang not in counts:
                    counts[lang] = np.zeros(BUCKETS, np.int64)
                counts[lang] += np.bincount(buckets[own[0, 0] : own[1, -1]], minlength=BUCKETS)
        if len(counts) > 200:
            yield from flush()
    yield from flush()


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: Log-probabilities, one row per bucket and one column per language.
    logs: np.ndarray


def learn(docs: DataFrame) -> Model:
    """The model of all rows of ``docs`` (text, lang) in which neither is null."""
    counted = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(_count, "lang string, bucket int, n long")
    summed = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = summed.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).select("lang", "c.bucket", "c.n").toArrow().sort_by("lang")
    logs = np.zeros((BUCKETS, rows.num_rows), np.float32)
    for k in range(rows.num_rows):
        counts = np.full(BUCKETS, SMOOTHING)
        counts[rows.column("bucket")[k].values.to_numpy()] += rows.column("n")[k].values.to_numpy()
        logs[:, k] = np.log(counts / counts.sum())
    return Model(tuple(rows.column("lang").to_pylist()), logs)


def mixture(scores: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[list[int], np.ndarray]:
    """Chosen columns and their proportions, from one row of log-likelihoods per word."""
    words = len(scores)
    relative = np.exp(np.maximum(scores - scores.max(1, keepdims=True), -60.0))
    chosen = [int(np.argmax(scores.sum(0)))]
    shares = np.ones(1)
    density = relative[:, chosen[0]]
    height = np.log(density).sum()
    cost = penalty * np.log(words + 1.0)
    while len(chosen) < scores.shape[1]:
        # The slope of the likelihood when a little of each language is mixed in.
        slope = (relative / density[:, None]).mean(0)
        slope[chosen] = 0.0
        best = None
        for extra in np.flatnonzero(slope > 1.0):
            columns = relative[:, [*chosen, extra]]
            weights = np.append(shares * 0.9, 0.1)
            for _ in range(rounds):
                parts = columns * weights
                parts /= parts.sum(1, keepdims=True)
                weights = parts.mean(0)
            mixed = columns @ weights
            reached = np.log(mixed).sum()
            if best is None or reached > best[0]:
                best = (reached, int(extra), weights, mixed)
        if best is None or best[0] - height <= cost:
            break
        height, extra, shares, density = best
        chosen.append(extra)
    return chosen, shares


def _predict(model: Model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = max(50_000, 4_000_000 // max(4, len(model.languages)))
        for chunk in chunks(batches, "text", limit):
            texts = chunk.column("text").to_pylist()
            langs, scores, lists = [UNKNOWN] * len(texts), [0.0] * len(texts), [""] * len(texts)
            if model.languages:
                buckets, spans, first = _words([t or "" for t in texts])
                rows = _sums(model.logs[buckets], spans)
                for i, text in enumerate(texts):
                    own = rows[first[i] : first[i + 1]]
                    if not len(own) or not any(map(str.isalpha, text)):
                        continue
                    chosen, shares = mixture(own)
                    order = sorted(range(len(chosen)), key=lambda k: (-shares[k], chosen[k]))
                    langs[i] = model.languages[chosen[order[0]]]
                    scores[i] = float(min(1.0, shares[order[0]]))
                    lists[i] = ",".join(f"{model.languages[chosen[k]]}:{shares[k]:.3f}" for k in order)
            names = [n for n in chunk.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(chunk.column(n) for n in names), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(lists, pa.string())],
                [*names, "lang_pred", "score", "languages"],
            )

    return predict


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``lang_pred``, ``score`` and ``languages``.

    ``lang_pred`` has the largest proportion, ``score`` is that proportion, and
    ``languages`` lists all chosen ones with theirs. Texts that are null or have no letter
    get ``und`` and 0, as do all texts if nothing was learned. Ties go to the language
    first in code point order. Only the text decides.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    new = ["lang_pred", "score", "languages"]
    found = rows.mapInArrow(_predict(model), f"row {kind}, lang_pred string, score double, languages string")
    old = [c for c in docs.columns if c not in new]
    return found.select(*(F.col("row").getField(c).alias(c) for c in old), *new)


def held_out(doc_id: str = "doc_id", parts: int = 3, part: int = 1):
    """Whether a row is kept from learning; rows without an id are not."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string")) % parts == part, F.lit(False))
