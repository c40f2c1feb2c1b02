"""Simple-8b: as many numbers of equal width as fit in the lower 60 bits of a 64-bit word.

The upper 4 bits select count and width. Numbers are coded in blocks; a block's last word
may be part full. A number over 60 bits is an escape: its word holds its place among the
full 64-bit numbers that follow the block's words. Whole arrays are coded and decoded at
once, so the cost does not depend on the number of blocks.
"""

from __future__ import annotations

import numpy as np

# Numbers in a word and their width, by selector; the last selector is the escape.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0, 1], np.int64)
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0, 60], np.uint64)
ESCAPE = 15
WIDEST = 13
LOW = np.uint64((1 << 60) - 1)
MASKS = (np.uint64(1) << WIDTHS) - np.uint64(1)


def _need(values: np.ndarray) -> np.ndarray:
    """The narrowest selector of each number; one more is an escape."""
    return np.searchsorted(MASKS[:WIDEST + 1], values).astype(np.int8)


_NEED = _need(np.arange(1 << 16, dtype=np.uint64))


def _before(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _chain(after: np.ndarray) -> np.ndarray:
    """0, after[0], after[after[0]], ... up to the end: eight steps at a time, then the seven between."""
    n = len(after) - 1
    two = after[after]
    four = two[two]
    eight = four[four].tolist()
    heads, at = [], 0
    while at < n:
        heads.append(at)
        at = eight[at]
    heads = np.array(heads)
    even = np.stack([heads, two[heads], four[heads], four[two[heads]]], axis=1)
    all_steps = np.stack([even, after[even]], axis=2).ravel()
    return all_steps[all_steps < n]


def pack(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code blocks of the given sizes: all words, words of each block, escapes of each block."""
    values, sizes = values.astype(np.uint64, copy=False), sizes.astype(np.int64, copy=False)
    n, blocks = len(values), len(sizes)
    ends = np.cumsum(sizes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(blocks, np.int64), np.zeros(blocks, np.int64)
    place, stop = np.arange(n, dtype=np.int32), np.repeat(ends.astype(np.int32), sizes)
    need = _NEED[values] if int(values.max()) < len(_NEED) else _need(values)
    widest = int(need.max())
    choice = np.full(n, widest if widest <= WIDEST else ESCAPE, np.int8)
    fit = np.flatnonzero(need < choice).astype(np.int32)
    for s in range(min(widest - 1, WIDEST), -1, -1):
        fit = fit[need[fit] <= s]
        if not len(fit):
            break
        breaks = np.flatnonzero(np.diff(fit) > 1)
        runs = np.diff(np.concatenate([[-1], breaks, [len(fit) - 1]]))
        wide = np.repeat(np.append(fit[breaks], fit[-1]) + 1, runs)  # the next number too wide
        choice[fit[np.minimum(fit + int(COUNTS[s]), stop[fit]) <= wide]] = s
    first = _chain(np.append(np.minimum(place + COUNTS.astype(np.int32)[choice], stop), np.int32(n)))
    kind = choice[first].astype(np.int64)
    filled = np.diff(np.append(first, n))
    block = np.searchsorted(ends, first, "right")
    shift = (place - np.repeat(first, filled)).astype(np.uint64) * np.repeat(WIDTHS[kind], filled)
    escaped = kind == ESCAPE
    extras = values[first[escaped]]
    extra_of = np.bincount(block[escaped], minlength=blocks)
    low = values.copy()
    if len(extras):
        low[first[escaped]] = np.arange(len(extras)) - _before(extra_of)[block[escaped]]
    words = np.bitwise_or.reduceat(low << shift, first) | (kind.astype(np.uint64) << np.uint64(60))
    word_of = np.bincount(block, minlength=blocks)
    if len(extras):  # each block's escapes follow its words
        out = np.empty(len(words) + len(extras), np.uint64)
        out[np.arange(len(words)) + np.repeat(_before(extra_of), word_of)] = words
        out[np.arange(len(extras)) + np.repeat(np.cumsum(word_of), extra_of)] = extras
        words = out
    return words, word_of, extra_of


def unpack(coded: np.ndarray, word_of: np.ndarray, extra_of: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of consecutive blocks, each of ``sizes`` numbers."""
    if not len(coded):
        return np.zeros(0, np.uint64)
    both = word_of + extra_of
    mine = np.arange(len(coded)) - np.repeat(_before(both), both) < np.repeat(word_of, both)
    words, extras = coded[mine], coded[~mine]
    kind = (words >> np.uint64(60)).astype(np.int64)
    words = words & LOW
    count = COUNTS[kind]
    full = word_of > 0
    last = np.cumsum(word_of)[full] - 1
    count[last] = 0
    total = np.concatenate([[0], np.cumsum(count)])
    count[last] = sizes[full] - (total[last + 1] - total[last + 1 - word_of[full]])
    start = _before(count)
    inner = (np.arange(int(count.sum())) - np.repeat(start, count)).astype(np.uint64)
    out = (np.repeat(words, count) >> (inner * np.repeat(WIDTHS[kind], count))) & np.repeat(MASKS[kind], count)
    if len(extras):
        at = np.flatnonzero(kind == ESCAPE)
        out[start[at]] = extras[words[at].astype(np.int64) + np.repeat(_before(extra_of), word_of)[at]]
    return out
