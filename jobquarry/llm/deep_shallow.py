"""Deep-shallow suffix sorting of byte strings, in groups.

Shallow: a vectorised sort by one character of eight bytes after the other, down to a small
depth; not the multikey quicksort with its three-way partition, though with the same order.
Deep: what is still tied there shares a long prefix, and is ordered by a blind trie, whose
inner nodes hold one skipped depth and one branching character each, so that inserting a
suffix compares its bytes once.
"""

from __future__ import annotations

import numpy as np

#: Bytes ordered character by character before the blind tries take over.
SHALLOW = 24


class BlindTrie:
    """Suffixes by their branching bytes. A node is ``[depth, {byte: child}]``, a leaf a list of rows."""

    def __init__(self, texts: list[bytes]) -> None:
        self.texts = texts
        self.root: list | None = None

    @staticmethod
    def common(a: bytes, b: bytes) -> int:
        """Length of the longest common prefix."""
        n = min(len(a), len(b))
        differing = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
        return n - (differing.bit_length() + 7) // 8

    def insert(self, row: int) -> None:
        text = self.texts[row]
        if self.root is None:
            self.root = ["leaf", [row]]
            return
        # Blind descent: follow branching bytes, without looking at those skipped.
        node, path = self.root, []
        while node[0] != "leaf":
            path.append(node)
            depth, children = node
            byte = text[depth] if depth < len(text) else -1
            node = children.get(byte) or next(iter(children.values()))
        other = self.texts[node[1][0]]
        if other == text:
            node[1].append(row)
            return
        depth = self.common(text, other)
        above = None
        for step in path:
            if step[0] > depth:
                break
            above = step
        mine = text[depth] if depth < len(text) else -1
        leaf = ["leaf", [row]]
        if above is not None and above[0] == depth:
            above[1][mine] = leaf
            return
        theirs = other[depth] if depth < len(other) else -1
        key = None if above is None else (text[above[0]] if above[0] < len(text) else -1)
        below = self.root if above is None else above[1][key]
        fork = [depth, {theirs: below, mine: leaf}]
        if above is None:
            self.root = fork
        else:
            above[1][key] = fork

    def ordered(self) -> tuple[list[int], list[int]]:
        """Rows in suffix order, and each one's common prefix with the row before it."""
        rows: list[int] = []
        shared: list[int] = []
        stack: list[tuple[list, int]] = [(self.root, 0)] if self.root else []
        while stack:
            node, prefix = stack.pop()
            if node[0] == "leaf":
                rows += node[1]
                shared += [prefix] + [len(self.texts[node[1][0]])] * (len(node[1]) - 1)
                continue
            depth, children = node
            inner = sorted(children)
            for i in range(len(inner) - 1, -1, -1):
                stack.append((children[inner[i]], depth if i else prefix))
        return rows, shared


def suffix_order(texts: list[bytes], groups: np.ndarray, known: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Order within each group, and each row's common prefix with the row before it.

    ``groups`` are sorted group numbers; the first ``known`` bytes are the same within a
    group. A group's first row has -1. A text that is a prefix of another comes first.
    """
    count = len(texts)
    if not count:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth = known + SHALLOW
    head = np.frombuffer(b"".join(t[known:depth].ljust(SHALLOW, b"\0") for t in texts), np.uint8)
    head = head.reshape(count, SHALLOW)
    characters = head.view(">u8").astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, count)

    # Shallow: sort by one character at a time, only where rows still tie.
    order = np.arange(count)
    part = groups.astype(np.int64)
    for k in range(characters.shape[1]):
        tied = np.flatnonzero(np.bincount(part, minlength=int(part.max()) + 1)[part] > 1) if k else order
        by = np.lexsort((characters[order[tied], k], part[tied]))
        order[tied] = order[tied][by]
        new = np.ones(count, bool)
        new[1:] = part[1:] != part[:-1]
        same_part = np.flatnonzero(~new)
        new[same_part] = characters[order[same_part], k] != characters[order[same_part - 1], k]
        part = np.cumsum(new) - 1

    shared = np.full(count, -1, np.int64)
    a, b = order[1:], order[:-1]
    within = groups[a] == groups[b]
    equal = np.cumprod(head[a] == head[b], axis=1, dtype=np.int64).sum(1)
    cut = np.minimum(lengths[a], lengths[b])
    shared[1:][within] = np.minimum(known + equal, cut)[within]

    # Deep: one blind trie for each part that is still tied.
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    ends = np.append(starts[1:], count)
    for low, high in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
        members = order[low:high].tolist()
        trie = BlindTrie(texts)
        for row in members:
            trie.insert(row)
        rows, prefixes = trie.ordered()
        first = shared[low]
        order[low:high] = rows
        shared[low:high] = prefixes
        shared[low] = first
    return order, shared
