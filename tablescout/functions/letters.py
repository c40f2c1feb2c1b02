"""Letter counts of texts, and what they say about the common subsequence of two texts.

Two texts of n and m characters whose letter counts differ by d in sum have at most
(n + m - d) / 2 characters in common, so they score at most 100 * (1 - d / (n + m)). Counts
over a box of texts (least and most of every letter) give the same bound for all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

CLASSES = 47  # letters a-z and digits fall into classes of their own; blanks are not counted
HIGHEST = 255  # larger counts are held as this: differences only get smaller


def counts(texts: Sequence[str]) -> np.ndarray:
    """Texts by classes, one byte each."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    ink = flat != 32
    found = np.bincount(row[ink] * CLASSES + flat[ink] % CLASSES, minlength=len(texts) * CLASSES)
    return np.minimum(found, HIGHEST).astype(np.uint8).reshape(len(texts), CLASSES)


def bound(own: np.ndarray, n: int, low: np.ndarray, high: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """Highest score that a text of ``n`` characters can have with any text of each box."""
    own, low, high = own.astype(np.int16), low.astype(np.int16), high.astype(np.int16)
    apart = (np.maximum(low - own, 0) + np.maximum(own - high, 0)).sum(axis=1)
    return 100.0 * (1 - apart / np.maximum(n + longest, 1))


class Splits:
    """A binary tree over letter counts: every node splits at the median of its most varied class.

    Built from a bounded sample, it only says which texts lie together, never what is found.
    """

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.letter = np.zeros(1 << depth, np.int64)
        self.least = np.full(1 << depth, HIGHEST + 1, np.int64)  # counts from here on go right
        groups = {1: sample.astype(np.int64)}
        for node in range(1, 1 << depth):
            own = groups.pop(node, sample[:0])
            if len(own) < 2:
                continue
            self.letter[node] = letter = int(np.argmax(own.var(axis=0)))
            self.least[node] = least = int(np.median(own[:, letter])) + (np.median(own[:, letter]) == own[:, letter].min())
            right = own[:, letter] >= least
            groups[2 * node], groups[2 * node + 1] = own[~right], own[right]

    def path(self, own: np.ndarray) -> np.ndarray:
        """The way of each row down the tree, as a number of ``depth`` bits."""
        node = np.ones(len(own), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (own[np.arange(len(own)), self.letter[node]] >= self.least[node])
        return node - (1 << self.depth)
