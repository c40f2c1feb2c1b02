"""Best token-set matches inside one bounded tile of values.

Runs in tasks: Spark cuts both value lists into tiles (see ``operators.entities``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from tablescout.functions import letters


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word of bits per step."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: set[str], b: set[str]) -> float:
    """token_set_ratio of two token sets."""
    if not a or not b:
        return 0.0
    both = a & b
    only_a, only_b = " ".join(sorted(a - b)), " ".join(sorted(b - a))
    if both and not (only_a and only_b):
        return 100.0
    sect = sum(map(len, both)) + max(len(both) - 1, 0)
    gap = 1 if both else 0
    la, lb = len(only_a), len(only_b)
    dist = la + lb - 2 * common_length(only_a, only_b)
    best = 1 - dist / (2 * (sect + gap) + la + lb)
    if both:
        best = max(best, 1 - (gap + la) / (2 * sect + gap + la), 1 - (gap + lb) / (2 * sect + gap + lb))
    return 100.0 * best


def text_ratio(a: str | None, b: str | None) -> float | None:
    """Ratio of two texts; of an absent text it is unknown, unless the other one is without words."""
    if a is None or b is None:
        known = b if a is None else a
        return 0.0 if known is not None and not known.split() else None
    return ratio(set(a.split()), set(b.split()))


def best_names(names: pd.Series, options: pd.Series, threshold: float) -> pd.DataFrame:
    """Per name the place and score of its best option, the earliest among equals.

    Column names repeat across datasets, so most pairs of a batch are scored once.
    """
    out, seen = [], {}
    for name, choices in zip(names, options):
        at, best = None, 0.0
        for i, other in enumerate(choices):
            if (name, other) not in seen:
                seen[name, other] = round(ratio(set(name.split()), set(other.split())), 6)
            score = seen[name, other]
            if score >= threshold and (at is None or score > best):
                at, best = i, score
        out.append((at, best if at is not None else None))
    return pd.DataFrame(out, columns=["at", "score"]).astype({"at": "Int32", "score": "Float64"})


LEAF = 64  # seed values whose letter counts share one box


class Tile:
    """Seed values of one tile, ready for many candidates."""

    def __init__(self, values: list[str], positions: list[int]):
        tokens = [set(v.split()) for v in values]
        texts = [" ".join(sorted(t)) for t in tokens]
        bags = letters.counts(texts)
        tree = letters.Splits(bags, max(0, (len(values) // LEAF).bit_length()))
        order = np.lexsort((np.array(positions), tree.path(bags))) if values else np.zeros(0, np.int64)
        self.values = [values[i] for i in order]
        self.positions = np.array(positions, np.int64)[order]
        self.tokens = [tokens[i] for i in order]
        self.bags = bags[order]
        texts = [texts[i] for i in order]
        self.length = np.array([len(t) for t in texts], dtype=np.int64)
        self.rank = np.empty(len(values), np.int64)  # among equal scores the first place wins, then the first text
        self.rank[sorted(range(len(values)), key=lambda i: (self.positions[i], self.values[i]))] = np.arange(len(values))
        first = np.arange(0, len(values), LEAF)
        self.low, self.high = (f.reduceat(self.bags, first, axis=0) for f in (np.minimum, np.maximum)) if values else (bags, bags)
        self.longest = np.maximum.reduceat(self.length, first) if values else self.length
        self.code = {ch: i + 1 for i, ch in enumerate(sorted(set("".join(texts))))}
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.fromiter(map(self.code.__getitem__, "".join(texts)), np.int64, int(self.length.sum()))
        holders: dict[str, list[int]] = {}
        for j, toks in enumerate(self.tokens):
            for t in toks:
                holders.setdefault(t, []).append(j)
        self.holders = {t: np.array(h) for t, h in holders.items()}
        self.compared = 0

    def _common(self, text: str, at: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence with each value of ``at``, 64 characters a word of bits."""
        n = len(text)
        words = -(-n // 64)
        where = np.zeros((len(self.code) + 1, words), dtype=np.uint64)
        for i, ch in enumerate(text):
            if ch in self.code:
                where[self.code[ch], i // 64] |= np.uint64(1 << i % 64)
        full = np.full(words, np.iinfo(np.uint64).max)
        full[-1] >>= np.uint64(64 * words - n)
        row = np.tile(full, (len(at), 1))
        length, start = self.length[at], self.start[at]
        order = np.argsort(-length, kind="stable")  # rows that have ended stay behind
        row, length, start = row[order], length[order], start[order]
        for step in range(int(length.max(initial=0))):
            on = int(np.searchsorted(-length, -step, "left"))
            open_row = row[:on]
            hit = open_row & where[self.flat[start[:on] + step]]
            total = open_row + hit
            carry = total < hit
            for k in range(1, words):  # what overflows one word goes on to the next
                total[:, k] += carry[:, k - 1]
                carry[:, k] |= carry[:, k - 1] & (total[:, k] == 0)
            row[:on] = total | (open_row & ~hit)
        out = np.empty(len(at), np.int64)
        out[order] = n - np.bitwise_count(row & full).astype(np.int64).sum(axis=1)
        return out

    def best(self, value: str, threshold: float, by_letters: bool) -> tuple[int, float] | None:
        """Index and score of the best value that scores ``threshold`` or more, the earliest among equals.

        ``by_letters`` false: only what shared tokens alone are worth is looked at.
        """
        mine = set(value.split())
        if not mine or not self.values:
            return None
        text = " ".join(sorted(mine))
        n = len(text)
        shared = np.zeros(len(self.values), dtype=np.int64)
        for t in mine:
            if t in self.holders:
                shared[self.holders[t]] += len(t) + 1
        score = np.zeros(len(self.values))
        idx = np.flatnonzero(shared)
        sect = shared[idx] - 1
        score[idx] = np.round(200.0 * sect / (sect + np.minimum(n, self.length[idx])), 6)
        bar = max(threshold, float(score.max()))
        if by_letters and bar < 100:
            bag = letters.counts([text])[0]
            leaves = np.flatnonzero(letters.bound(bag, n, self.low, self.high, self.longest) >= bar - 1e-6)
            at = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < len(self.values)]
            at = at[letters.bound(bag, n, self.bags[at], self.bags[at], self.length[at]) >= bar - 1e-6]
            self.compared += len(at)
            whole = at[shared[at] == 0]
            score[whole] = np.round(200.0 * self._common(text, whole) / (n + self.length[whole]), 6)
            for k in at[shared[at] > 0]:
                score[k] = round(ratio(mine, self.tokens[k]), 6)
        most = score.max()
        if most < threshold:
            return None
        top = np.flatnonzero(score == most)
        top = int(top[np.argmin(self.rank[top])])
        return top, float(most)


def match_tile(cands: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
    """One row per candidate value that finds a match in the tile at its ``bar`` or above.

    ``compared`` on each row: the values whose letters were compared one by one.
    """
    out = []
    if len(cands) and len(seeds):
        tile = Tile(seeds["seed_norm"].tolist(), seeds["seed_pos"].tolist())
        for key, value, bar, by_letters in zip(cands["domain"], cands["norm"], cands["bar"], cands["letters"]):
            tile.compared = 0
            hit = tile.best(value, bar, bool(by_letters))
            j, score = hit or (None, None)
            out.append((key, value, None if hit is None else tile.values[j], None if hit is None else tile.positions[j], score, tile.compared))
    return pd.DataFrame(out, columns=["domain", "norm", "seed_norm", "seed_pos", "score", "compared"]).astype(
        {"seed_pos": "Int64", "score": "Float64", "compared": "int64"})
