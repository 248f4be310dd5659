"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Input of a word: a learned vector of its hash, the mean of learned vectors of its hashed
character trigrams, and how much more often the labelled sample has it in toxic documents.
Two gated recurrent layers read a window of words in both directions, attention weighs
their states into one vector, and a logistic unit scores it. A document's score is that of
its highest window, brought to a probability; windows overlap by half and cover the whole
text, so a single sentence in a long document counts.

Training is multiple-instance learning on a bounded sample of labelled documents: a toxic
document vouches only for its highest window, any window of another document is clean. The
number of steps is fixed, so training costs the same for every corpus. Each task scores
its texts with the network's weights, a few hundred kilobytes.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobquarry.llm.frames import chunks, stored
from jobquarry.llm.hashing import BASE, BYTE, INVERSE, mixed, powers

#: Words per window and from one window to the next.
WINDOW, STRIDE = 24, 12
WORD_ROWS, TRIGRAM_ROWS, WIDTH, HIDDEN, ATTEND = 8192, 4096, 8, 8, 8
STEPS, BATCH, RESCORE = 500, 128, 100
#: Pull of the learned word vectors towards nothing, so that a small sample is not learned by heart.
DECAY = 3e-4
#: The sample: documents without and with the label, and the longest text (in characters) that is drawn.
SAMPLE, SAMPLE_CHARS = (2000, 1000), 12_000
TOKEN = re.compile(r"\w+")
INPUT = 2 * WIDTH + 1


@dataclass
class Words:
    """Distinct words with their hashed features."""

    row: np.ndarray
    trigrams: np.ndarray
    begins: np.ndarray
    evidence: np.ndarray

    @staticmethod
    def of(words: list[str], evidence: dict[str, float], block: int = 30_000) -> Words:
        """Built a block of words at a time, since its hashing takes many times their bytes."""
        parts = [Words._of(words[start : start + block], evidence) for start in range(0, len(words), block)]
        ends = np.cumsum([0] + [len(p.trigrams) for p in parts])
        begins = [p.begins[:-1] + end for p, end in zip(parts, ends[:-1].tolist(), strict=True)]
        return Words(
            np.concatenate([p.row for p in parts]), np.concatenate([p.trigrams for p in parts]),
            np.concatenate([*begins, ends[-1:]]), np.concatenate([p.evidence for p in parts]),
        )

    @staticmethod
    def _of(words: list[str], evidence: dict[str, float]) -> Words:
        data = "".join(f"<{w}>" for w in words).encode()
        lengths = np.fromiter((len(w.encode()) + 2 for w in words), np.int64, len(words))
        bytes_ = np.frombuffer(data, np.uint8)
        begins = np.concatenate([[0], np.cumsum(lengths)])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[bytes_] * powers(BASE, len(bytes_)), dtype=np.uint64)])
        whole = mixed((sums[begins[1:]] - sums[begins[:-1]]) * powers(INVERSE, len(bytes_) + 1)[begins[:-1]])
        three = bytes_.astype(np.uint32)
        packed = three.copy()
        packed[:-2] = three[:-2] | (three[1:-1] << np.uint32(8)) | (three[2:] << np.uint32(16))
        hashed = (packed * np.uint32(2654435761)) >> np.uint32(20)
        # The last two bytes of a word start no trigram of their own; their row is that of nothing.
        inside = np.ones(len(bytes_), bool)
        inside[begins[1:] - 1] = False
        inside[begins[1:] - 2] = False
        kept = np.concatenate([[0], np.cumsum(inside)])
        known = np.fromiter((evidence.get(w, 0.0) for w in words), np.float32, len(words))
        return Words((whole & np.uint64(WORD_ROWS - 1)).astype(np.int32), hashed[inside].astype(np.int32), kept[begins], known)


def windows_of(count: int) -> list[int]:
    """Starts of the windows over ``count`` words; the last one ends the text."""
    return list(range(0, max(1, count - (WINDOW - STRIDE)), STRIDE)) if count else []


def index_windows(tokens: list) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all windows (-1 beyond the end of a text), and whose text each is."""
    flat = np.concatenate([np.asarray(t, np.int64) for t in tokens]) if tokens else np.zeros(0, np.int64)
    lengths = np.array([len(t) for t in tokens], np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    starts = [windows_of(n) for n in lengths.tolist()]
    owner = np.repeat(np.arange(len(tokens)), [len(s) for s in starts])
    at = np.fromiter((x for s in starts for x in s), np.int64)[:, None] + np.arange(WINDOW)
    inside = at < lengths[owner][:, None]
    if not len(flat):
        return np.zeros((0, WINDOW), np.int64), owner
    return np.where(inside, flat[np.minimum(at + begins[owner][:, None], len(flat) - 1)], -1), owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _tanh(x: np.ndarray) -> np.ndarray:
    return 2.0 / (1.0 + np.exp(np.clip(-2.0 * x, -30, 30))) - 1.0


def _scatter(target: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Add each value to its row; rows may repeat."""
    order = np.argsort(rows, kind="stable")
    begins = np.flatnonzero(np.diff(rows[order], prepend=-1))
    target[rows[order][begins]] += np.add.reduceat(values[order], begins, axis=0)


@dataclass
class Network:
    p: dict[str, np.ndarray]
    #: Probability = sigmoid(scale * highest + shift).
    scale: float = 1.0
    shift: float = 0.0
    evidence: dict[str, float] = field(default_factory=dict)
    #: Set if the sample has not both classes: the score of everything.
    constant: float | None = None

    @staticmethod
    def new(seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        p = {"word": draw(WORD_ROWS, WIDTH, scale=0.02), "tri": draw(TRIGRAM_ROWS, WIDTH, scale=0.05),
             "attend": draw(2 * HIDDEN, ATTEND, scale=0.3), "ask": draw(ATTEND, scale=0.3), "out": draw(2 * HIDDEN, scale=0.3), "bias": np.zeros(1, np.float32)}
        for side in ("f", "b"):
            p[f"in_{side}"] = draw(INPUT, 3 * HIDDEN, scale=0.3)
            p[f"inb_{side}"] = np.zeros(3 * HIDDEN, np.float32)
            p[f"rec_{side}"] = draw(HIDDEN, 3 * HIDDEN, scale=0.3)
        return Network(p)

    def inputs(self, words: Words) -> np.ndarray:
        counts = np.diff(words.begins)
        sums = np.add.reduceat(self.p["tri"][words.trigrams], words.begins[:-1], axis=0)
        return np.concatenate([self.p["word"][words.row], sums / counts[:, None], words.evidence[:, None]], axis=1).astype(np.float32)

    def _walk(self, steps: np.ndarray, inside: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction for inputs (time, window, 3 * hidden)."""
        recurrent, h = self.p[f"rec_{side}"], np.zeros((steps.shape[1], HIDDEN), np.float32)
        states, memory = np.zeros((WINDOW, steps.shape[1], HIDDEN), np.float32), []
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            again = h @ recurrent
            gates = _sigmoid(steps[t, :, : 2 * HIDDEN] + again[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            n = _tanh(steps[t, :, 2 * HIDDEN :] + r * again[:, 2 * HIDDEN :])
            on = inside[t][:, None]
            new = np.where(on, n + z * (h - n), h)
            if keep:
                memory.append((t, h, z, r, n, again[:, 2 * HIDDEN :], on))
            states[t] = h = new
        return states, memory

    def forward(self, projected: dict[str, np.ndarray], at: np.ndarray, keep: bool = False):
        """Logits of windows, from the words' projected inputs and the window index."""
        times = np.ascontiguousarray(at.T)
        inside = times >= 0
        walked = {s: self._walk(projected[s][times], inside, s, keep) for s in ("f", "b")}
        states = np.concatenate([walked["f"][0], walked["b"][0]], axis=2)
        looked = _tanh(states @ self.p["attend"])
        weights = looked @ self.p["ask"]
        weights = np.where(inside, weights, np.float32(-1e9))
        weights = np.exp(weights - weights.max(0))
        weights /= weights.sum(0)
        pooled = (weights[:, :, None] * states).sum(0)
        logits = pooled @ self.p["out"] + self.p["bias"][0]
        return logits, (times, inside, walked, states, looked, weights, pooled) if keep else None

    def project(self, inputs: np.ndarray) -> dict[str, np.ndarray]:
        return {s: inputs @ self.p[f"in_{s}"] + self.p[f"inb_{s}"] for s in ("f", "b")}

    def project_words(self, words: Words, evidence: np.ndarray, block: int = 20_000) -> dict[str, np.ndarray]:
        """Projected inputs of many words, a block at a time."""
        parts = []
        for start in range(0, len(words.row), block):
            begins = words.begins[start : start + block + 1]
            part = Words(words.row[start : start + block], words.trigrams[begins[0] : begins[-1]], begins - begins[0], evidence[start : start + block])
            parts.append(self.project(self.inputs(part)))
        return {s: np.concatenate([p[s] for p in parts]) for s in ("f", "b")}

    def gradients(self, words: Words, at: np.ndarray, target: np.ndarray, learned: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of the windows, and its gradient for every parameter.

        ``learned``: a factor per word for its learned vectors (0 drops them).
        """
        inputs = self.inputs(words)
        factor = np.ones(len(inputs), np.float32) if learned is None else learned.astype(np.float32)
        inputs[:, : 2 * WIDTH] *= factor[:, None]
        logits, (times, inside, walked, states, looked, weights, pooled) = self.forward(self.project(inputs), at, True)
        chance = _sigmoid(logits)
        loss = float(-(target * np.log(chance + 1e-9) + (1 - target) * np.log(1 - chance + 1e-9)).mean())
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        d_logit = ((chance - target) / len(target)).astype(np.float32)
        g["bias"][0], g["out"] = d_logit.sum(), pooled.T @ d_logit
        d_pooled = d_logit[:, None] * self.p["out"]
        d_weight = (states * d_pooled).sum(2)
        d_states = weights[:, :, None] * d_pooled
        d_score = weights * (d_weight - (weights * d_weight).sum(0))
        g["ask"] = np.einsum("tna,tn->a", looked, d_score)
        d_looked = d_score[:, :, None] * self.p["ask"] * (1 - looked**2)
        g["attend"] = np.einsum("tnh,tna->ha", states, d_looked)
        d_states = d_states + d_looked @ self.p["attend"].T
        d_inputs = np.zeros_like(inputs)
        order = np.argsort(times, axis=None, kind="stable")[np.count_nonzero(~inside) :]
        begins = np.flatnonzero(np.diff(times.ravel()[order], prepend=-1))
        present = times.ravel()[order][begins]
        for side, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            recurrent, d_h = self.p[f"rec_{side}"], 0.0
            d_steps = np.zeros((*times.shape, 3 * HIDDEN), np.float32)
            for t, h, z, r, n, again, on in reversed(walked[side][1]):
                d_h = d_h + d_states[t, :, part]
                d_new = np.where(on, d_h, 0)
                d_n = d_new * (1 - z) * (1 - n**2)
                d_z = d_new * (h - n) * z * (1 - z)
                d_r = d_n * again * r * (1 - r)
                d_steps[t] = np.concatenate([d_z, d_r, d_n], axis=1)
                d_again = np.concatenate([d_z, d_r, d_n * r], axis=1)
                g[f"rec_{side}"] += h.T @ d_again
                d_h = np.where(on, d_new * z, d_h) + d_again @ recurrent.T
            d_projected = np.zeros((len(inputs), 3 * HIDDEN), np.float32)
            d_projected[present] = np.add.reduceat(d_steps.reshape(-1, 3 * HIDDEN)[order], begins, axis=0)
            g[f"in_{side}"] = inputs.T @ d_projected
            g[f"inb_{side}"] = d_projected.sum(0)
            d_inputs += d_projected @ self.p[f"in_{side}"].T
        d_inputs[:, : 2 * WIDTH] *= factor[:, None]
        _scatter(g["word"], words.row, d_inputs[:, :WIDTH])
        counts = np.diff(words.begins)
        _scatter(g["tri"], words.trigrams, np.repeat(d_inputs[:, WIDTH : 2 * WIDTH] / counts[:, None], counts, axis=0))
        return loss, g


def log_odds(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """Smoothed and shrunk by how little has been seen."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1.0)) - np.log((clean + 0.5) / (n_clean + 1.0))
    return (np.clip(odds, -4, 4) * (clean + toxic) / (clean + toxic + 8.0)).astype(np.float32)


def _batch_words(at: np.ndarray, row: np.ndarray, words: Words, evidence: np.ndarray) -> tuple[Words, np.ndarray]:
    """The words of some windows numbered anew; the same word in two classes of document is two."""
    label = np.broadcast_to(row[:, None], at.shape)
    marks = np.where(at >= 0, at * 2 + label, -1)
    used, inverse = np.unique(marks, return_inverse=True)
    inverse = inverse.reshape(at.shape)
    if used[0] < 0:
        used, inverse = used[1:], inverse - 1
    word, label = used // 2, used % 2
    lengths = np.diff(words.begins)[word]
    begins = np.concatenate([[0], np.cumsum(lengths)])
    index = np.arange(begins[-1]) + np.repeat(words.begins[:-1][word] - begins[:-1], lengths)
    return Words(words.row[word], words.trigrams[index], begins, evidence[label, word]), inverse


def train(texts: list[str], labels: np.ndarray, prior: float | None = None, seed: int = 5, steps: int = STEPS) -> Network:
    """A network from labelled texts (1 is toxic); ``prior`` is the share of toxic ones in general."""
    labels = np.asarray(labels, np.int64)
    net = Network.new(seed)
    if not (labels == 1).any() or not (labels == 0).any():
        net.constant = float(labels.mean()) if len(labels) else 0.0
        return net
    number: dict[str, int] = {}
    tokens = [np.array([number.setdefault(w, len(number)) for w in TOKEN.findall(t.lower())], np.int64) for t in texts]
    if not number:
        net.constant = float(labels.mean())
        return net
    counts = np.zeros((len(number), 2))
    for own, k in zip(tokens, labels.tolist(), strict=True):
        counts[np.unique(own), k] += 1
    n_clean, n_toxic = int((labels == 0).sum()), int((labels == 1).sum())
    known = np.where(counts.sum(1) > 1, log_odds(counts[:, 0], counts[:, 1], n_clean, n_toxic), 0)
    told = np.flatnonzero(known)
    names = list(number)
    net.evidence = dict(zip((names[i] for i in told.tolist()), known[told].tolist(), strict=True))
    words = Words.of(names, {})
    del number, names, known, told
    # What a document itself adds to a word's counts must not speak for its label.
    less = np.maximum(counts - 1, 0)
    without = np.stack([log_odds(less[:, 0], counts[:, 1], n_clean - 1, n_toxic), log_odds(counts[:, 0], less[:, 1], n_clean, n_toxic - 1)])
    windows, owner = index_windows(tokens)
    windows = windows.astype(np.int32)
    label = labels[owner]
    rng = np.random.default_rng(seed)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}

    def score_all() -> np.ndarray:
        out = np.empty(len(windows), np.float32)
        for k in (0, 1):
            projected = net.project_words(words, without[k])
            mine = np.flatnonzero(label == k)
            for start in range(0, len(mine), 4096):
                part = mine[start : start + 4096]
                out[part] = net.forward(projected, windows[part])[0]
        return out

    order = np.argsort(owner, kind="stable")
    borders = np.flatnonzero(np.diff(owner[order])) + 1
    by_doc = np.split(order, borders)
    hints = np.where(windows >= 0, without[1][windows], 0).sum(1)
    scores = hints.astype(np.float32)
    for step in range(steps):
        if step and step % RESCORE == 0:
            scores = score_all()
        if step % RESCORE == 0:
            highest = np.array([w[np.argmax(scores[w])] for w in by_doc])
            toxic, hard = highest[label[highest] == 1], highest[label[highest] == 0]
            clean = np.flatnonzero(label == 0)
        pick = lambda of, n: of[rng.integers(0, len(of), n)]
        rows = np.concatenate([pick(toxic, BATCH // 2), pick(hard, BATCH // 4), pick(clean, BATCH // 4)])
        batch, at = _batch_words(windows[rows], label[rows], words, without)
        _, g = net.gradients(batch, at, label[rows].astype(np.float32), rng.random(len(batch.row)) < 0.5)
        for k, value in net.p.items():
            if k in ("word", "tri"):
                g[k] += DECAY * value
            first, second = moment[k]
            first += 0.1 * (g[k] - first)
            second += 0.001 * (g[k] ** 2 - second)
            rate = 0.01 * np.sqrt(1 - 0.999 ** (step + 1)) / (1 - 0.9 ** (step + 1))
            value -= rate * first / (np.sqrt(second) + 1e-8)
    scores = score_all()
    top = np.array([scores[w].max() for w in by_doc])
    truth = np.array([label[w[0]] for w in by_doc], float)
    net.scale, net.shift = _calibrated(top, truth, truth.mean() if prior is None else prior)
    return net


def _calibrated(top: np.ndarray, truth: np.ndarray, prior: float) -> tuple[float, float]:
    """Logistic fit of the label on the highest logit, at the given prior; Newton steps with a ridge."""
    weight = np.where(truth == 1, prior / max(1, truth.sum()), (1 - prior) / max(1, (1 - truth).sum())) * len(truth)
    x = np.stack([top, np.ones_like(top)], 1).astype(np.float64)
    w = np.array([1.0, 0.0])
    for _ in range(25):
        chance = _sigmoid(x @ w)
        slope = x.T @ (weight * (chance - truth)) + 0.1 * (w - [1.0, 0.0])
        bend = (x * (weight * chance * (1 - chance))[:, None]).T @ x + 0.1 * np.eye(2)
        w = w - np.clip(np.linalg.solve(bend, slope), -1, 1)
    return max(1e-3, float(w[0])), float(w[1])


def sample(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = SAMPLE, longest: int = SAMPLE_CHARS) -> tuple[list[str], np.ndarray, float]:
    """A bounded sample of labelled rows: ``per_class`` of each label, in the order of a hash.

    Returns texts, labels and the share of toxic rows among all that could be drawn.

    At most ``sum(per_class) * longest`` characters reach the driver. Rows without a text,
    an id or a label of 0 or 1 are not drawn, nor are ids that occur twice; a document
    labelled twice counts as its highest label.
    """
    marked = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Only ids and lengths are shuffled and ordered; the texts of those drawn are read at the end.
    lengths = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("length")
    )
    light = stored(
        lengths.join(marked, "doc_id").where((F.col("n") == 1) & (F.col("length") <= longest)).select("doc_id", "toxic"), "labelled"
    )
    draw = F.xxhash64("doc_id", F.lit(11))
    drawn = {
        r.doc_id: int(r.toxic)
        for k in (0, 1)
        for r in light.where(F.col("toxic") == k).orderBy(draw, "doc_id").limit(per_class[k]).collect()
    }
    rows = docs.where(F.col("doc_id").isin(list(drawn))).select("doc_id", "text").collect() if drawn else []
    texts = {r.doc_id: r.text for r in rows}
    share = light.agg(F.avg("toxic")).first()[0]
    return [texts[i] for i in drawn], np.array(list(drawn.values()), np.int64), float(share or 0.0)


def learned(docs: DataFrame, labels: DataFrame, **bounds) -> Network:
    """The network of a bounded sample of ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic)."""
    net = train(*sample(docs, labels, **bounds))
    _give_back()
    return net


def _give_back() -> None:
    """Return what training took and freed to the system, where the C library can do that."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _score(net: Network):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            texts = chunk.column("text").to_pylist()
            names = [n for n in chunk.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(chunk.column(n) for n in names), pa.array(probabilities(net, texts), pa.float64())], [*names, "score"]
            )

    return score


def probabilities(net: Network, texts: list[str | None]) -> np.ndarray:
    if net.constant is not None:
        return np.full(len(texts), net.constant)
    number: dict[str, int] = {}
    tokens = [[number.setdefault(w, len(number)) for w in TOKEN.findall((t or "").lower())] for t in texts]
    highest = np.full(len(texts), float(net.p["bias"][0]))
    if number:
        words = Words.of(list(number), net.evidence)
        projected = net.project_words(words, words.evidence)
        windows, owner = index_windows(tokens)
        logits = np.empty(len(windows), np.float32)
        for start in range(0, len(windows), 4096):
            logits[start : start + 4096] = net.forward(projected, windows[start : start + 4096])[0]
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        highest[owner[first]] = np.maximum.reduceat(logits, first)
    return _sigmoid(net.scale * highest + net.shift).astype(np.float64)


def scored(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``score`` and ``predicted`` (score >= 0.5).

    Null and empty texts, and texts without words, get the score of no words at all. Only
    the text decides.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text}`").alias("text"))
    found = rows.mapInArrow(_score(net), f"row {rows.schema['row'].dataType.simpleString()}, score double")
    old = [c for c in docs.columns if c not in ("score", "predicted")]
    return found.select(*(F.col("row").getField(c).alias(c) for c in old), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def held_out(doc_id: str = "doc_id", parts: int = 5):
    """Whether a row is kept from learning; rows without an id are not."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string")) % parts == 0, F.lit(False))
