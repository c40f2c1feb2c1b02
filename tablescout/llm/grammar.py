"""A straight-line grammar of many word sequences at once, by rounds of Re-Pair.

Every rule stands for a fixed stretch of words, made of two shorter stretches. A round counts
the adjacent pairs of all sequences and replaces each occurrence that is more frequent than
the pairs it overlaps; rounds go on while pairs repeat. What is left of each sequence is then
joined pair by pair into one symbol, so that every place between two words is the inner
boundary of a rule wherever it is derived.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAST = 64  # Re-Pair ends when a round replaces less than one symbol in so many


@dataclass
class Grammar:
    """Rules by number, and every place at which one is derived.

    ``begin``, ``middle`` and ``end`` give the stretch of a rule's first derivation and its
    inner boundary; ``rule`` and ``place`` list all derivations.
    """

    begin: np.ndarray
    middle: np.ndarray
    end: np.ndarray
    rule: np.ndarray
    place: np.ndarray


def _chosen(rank: np.ndarray, worst: int) -> np.ndarray:
    """Places whose pair ranks before both pairs it overlaps; of a pair overlapping itself every other one."""
    if len(rank) == 0:
        return np.zeros(0, np.int64)
    around = np.concatenate([[worst], rank, [worst]])
    good = (rank < worst) & (rank <= around[:-2]) & (rank <= around[2:])
    at = np.flatnonzero(good)
    if not len(at):
        return at
    new = np.ones(len(at), bool)
    new[1:] = np.diff(at) > 1
    group = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - group) % 2 == 0]


def build(words: np.ndarray, offs: np.ndarray) -> Grammar:
    """The grammar of the sequences ``words[offs[i]:offs[i + 1]]``."""
    symbol = words.astype(np.int64)
    place = np.arange(len(words))
    end = place + 1
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    rules = 0
    found: list[tuple[np.ndarray, ...]] = []
    base = int(symbol.max()) + 1 if len(symbol) else 0
    paired = True
    while len(symbol) > 1:
        inside = row[1:] == row[:-1]
        if not inside.any():
            break
        if paired:
            names, key = np.unique(symbol, return_inverse=True)
            _, pair, count = np.unique(key[:-1] * len(names) + key[1:], return_inverse=True, return_counts=True)
            np.subtract.at(count, pair[~inside], 1)
            order = np.argsort(-count, kind="stable")
            rank_of = np.empty(len(order), np.int64)
            rank_of[order] = np.arange(len(order))
            worst = int((count > 1).sum())
            rank = np.where(inside, np.minimum(rank_of[pair], worst), worst)
            at = _chosen(rank, worst)
            paired = len(at) * LEAST >= len(symbol)
            made = rank[at]
        else:  # every rule from here on has one place
            first = np.searchsorted(row, row[:-1], "left")
            at = np.flatnonzero(inside & ((np.arange(len(row) - 1) - first) % 2 == 0))
            made = np.arange(len(at))
        if not len(at):
            paired = False
            continue
        kinds, one, number = np.unique(made, return_index=True, return_inverse=True)
        found.append((place[at][one], end[at][one], end[at + 1][one], rules + number, place[at]))
        symbol[at] = base + rules + number
        end[at] = end[at + 1]
        rules += len(kinds)
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        symbol, place, end, row = symbol[keep], place[keep], end[keep], row[keep]
    if not found:
        return Grammar(*(np.zeros(0, np.int64) for _ in range(5)))
    return Grammar(*(np.concatenate(x) for x in zip(*found)))
