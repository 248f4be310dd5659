"""Hashing of bytes and words in numpy, over many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SEED = np.random.default_rng(20240611)
#: Odd multipliers and one random value per byte: all hashing here derives from these.
BASE = np.uint64(int(_SEED.integers(1 << 62)) * 2 + 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64)
STEPS = _SEED.integers(1, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}

#: ASCII white space, fixed by the definition of a word.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[ord("A") : ord("Z") + 1] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit word."""
    x = (x ^ (x >> np.uint64(30))) * STEPS[5]
    x = (x ^ (x >> np.uint64(27))) * STEPS[6]
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, count: int) -> np.ndarray:
    """base ** 0, 1, 2, ... modulo 2 ** 64."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < count:
        have = np.full(max(count, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if count <= 1 << 22:
            _POWERS[int(base)] = have
    return have[:count]


def joined_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after another, and the offsets of the texts."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the lower-cased texts, and where each text's words begin."""
    data, offsets = joined_bytes(texts)
    data = LOWERED[data]
    space = IS_SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    first[inner] = ~space[inner]
    last = ~space
    last[:-1] &= space[1:]
    ends_at = offsets[1:][offsets[1:] > 0] - 1
    last[ends_at] = ~space[ends_at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    values = BYTE[data] * powers(BASE, len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    hashes = (sums[ends] - sums[starts]) * powers(INVERSE, len(data) + 1)[starts]
    hashes = mixed(hashes + (ends - starts).astype(np.uint64) * STEPS[7])
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, and where each text's begin.

    A text with fewer than ``size`` words has its whole sequence as one shingle; a text
    without words has none.
    """
    words, at = word_hashes(texts)
    if len(words) >= size:
        rolled = np.zeros(len(words) - size + 1, np.uint64)
        for j in range(size):
            rolled += words[j : len(words) - size + 1 + j] * STEPS[j % 5]
            rolled = rolled * BASE + STEPS[5]
        rolled = mixed(rolled)
    else:
        rolled = np.zeros(0, np.uint64)
    sets, lengths = [], []
    for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if high - low >= size:
            own = np.unique(rolled[low : high - size + 1])
        elif high > low:
            # One element arrays wrap around silently, as all sums here are meant to.
            total = np.full(1, high - low, np.uint64)
            for word in words[low:high]:
                total = mixed(total * BASE + word)
            own = total
        else:
            own = np.zeros(0, np.uint64)
        sets.append(own)
        lengths.append(len(own))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
