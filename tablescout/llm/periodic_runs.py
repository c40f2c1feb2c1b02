"""Stretches of words that repeat with a period, found on a grammar of the texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.grammar import Grammar, build
from tablescout.llm.texts import list_column, pieces

RUNS = "array<struct<start: long, length: long, period: long>>"


class Repeats:
    """For the grams of one length at a time: how far on the same gram stands next in its document.

    Grams are numbered exactly: a longer gram is the pair of two shorter ones that cover it.
    Places whose gram stands nowhere else in the document are given up for all longer grams.
    """

    def __init__(self, words: np.ndarray, row: np.ndarray):
        self.size = 1
        self.rank = np.full(len(words), -1)
        self.at = np.arange(len(words))
        self._number(row * (int(words.max()) + 1 if len(words) else 1) + words)

    def _number(self, key: np.ndarray) -> None:
        _, number, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = count[number] > 1
        self.rank[:] = -1
        self.at, number = self.at[twice], number[twice]
        self.rank[self.at] = number

    def grow(self, size: int) -> None:
        """Go on to grams of ``size`` words, at most twice the present size."""
        on = self.at + (size - self.size)
        self.at = self.at[(on < len(self.rank)) & (self.rank[np.minimum(on, len(self.rank) - 1)] >= 0)]
        other = self.rank[self.at + (size - self.size)]
        self._number(self.rank[self.at] * len(self.rank) + other)
        self.size = size

    def steps(self) -> np.ndarray:
        """Distance to the next equal gram, 0 where it is further than a gram's size."""
        out = np.zeros(len(self.rank), np.int64)
        order = np.argsort(self.rank[self.at], kind="stable")
        at = self.at[order]
        same = self.rank[at[1:]] == self.rank[at[:-1]]
        far = np.diff(at)
        near = same & (far <= self.size)
        out[at[:-1][near]] = far[near]
        return out


def _extents(words: np.ndarray, offs: np.ndarray, row: np.ndarray, at: np.ndarray, period: np.ndarray):
    """Begin and end of the stretch of ``period`` around each place, within its document."""
    begin, end = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    order = np.lexsort((period, row[at]))
    key = np.stack([row[at], period])[:, order]
    cuts = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0).any(axis=0)])) if len(at) else np.zeros(0, np.int64)
    for group in np.split(order, cuts[1:]) if len(at) else []:
        q, a, b = int(period[group[0]]), int(offs[row[at[group[0]]]]), int(offs[row[at[group[0]]] + 1])
        breaks = np.concatenate([[a - 1], np.flatnonzero(words[a:b - q] != words[a + q:b]) + a, [b - q]])
        place = np.searchsorted(breaks, at[group])
        begin[group], end[group] = breaks[place - 1] + 1, breaks[place] + q
    return begin, end


def _crossing(grammar: Grammar, words: np.ndarray, offs: np.ndarray, row: np.ndarray, least: int, times: int):
    """Rule, begin, end and period of every run that crosses a rule's inner boundary, on the rule's first derivation.

    A run of period q holds more than ``(times - 1) * q - size`` grams of a size from q on that
    stand again q words later and not before. Periods are taken in classes of (below, size];
    in each, some place of a coarse grid before the boundary lies on such a gram.
    """
    found = []
    repeats = Repeats(words, row)
    size, below = max(1, (least + 1) * 10 // 26), 0
    while repeats.size < size:
        repeats.grow(min(size, repeats.size * 2))
    rules = np.arange(len(grammar.begin))
    while len(repeats.at):
        length = grammar.end[rules] - grammar.begin[rules]
        rules = rules[length >= max(least, times * (below + 1))]
        if not len(rules):
            break
        step = max(1, size * 6 // 10)
        far = repeats.steps()
        for back in range(0, 2 * size - 2 + step, step):
            at = grammar.middle[rules] - 1 - back
            inside = at >= grammar.begin[rules]
            period = np.where(inside, far[np.maximum(at, 0)], 0)
            hit = period > below
            if hit.any():
                found.append((rules[hit], at[hit], period[hit]))
        below, size = size, max(size + 1, size * 5 // 4)
        repeats.grow(size)
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    rule, at, period = (np.concatenate(x) for x in zip(*found))
    begin, end = _extents(words, offs, row, at, period)
    begin, end = np.maximum(begin, grammar.begin[rule]), np.minimum(end, grammar.end[rule])
    good = (begin < grammar.middle[rule]) & (grammar.middle[rule] < end) & (end - begin >= np.maximum(least, times * period))
    return tuple(np.unique(np.stack([rule, begin, end, period])[:, good], axis=1))


def runs_of(words: np.ndarray, offs: np.ndarray, least: int = 24, times: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and period of all maximal runs of the sequences ``words[offs[i]:offs[i + 1]]``, by begin and period."""
    grammar = build(words, offs)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    rule, begin, end, period = _crossing(grammar, words, offs, row, least, times)
    wanted = np.isin(grammar.rule, rule)
    derived, place = grammar.rule[wanted], grammar.place[wanted]
    order = np.argsort(derived, kind="stable")
    derived, place = derived[order], place[order]
    first, last = np.searchsorted(derived, rule, "left"), np.searchsorted(derived, rule, "right")
    many = last - first
    which = np.repeat(np.arange(len(rule)), many)
    shift = place[np.arange(len(which)) - np.repeat(np.cumsum(many) - many - first, many)] - grammar.begin[rule[which]]
    begin, end, period = begin[which] + shift, end[which] + shift, period[which]
    order = np.lexsort((-end, begin, period))
    begin, end, period = begin[order], end[order], period[order]
    # a run that ends at the edge of its rule is part of one that a larger rule holds whole
    reach = np.searchsorted(np.unique(period), period) * (len(words) + 1) + end
    whole = np.ones(len(reach), bool)
    whole[1:] = reach[1:] > np.maximum.accumulate(reach)[:-1]
    begin, end, period = begin[whole], end[whole], period[whole]
    order = np.lexsort((period, begin))
    return begin[order], end[order], period[order]


def _finder(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                words, count = [], []
                for text in part.column("text").cast(pa.binary()):
                    own = text.as_py().split()
                    words += own
                    count.append(len(own))
                known = {w: i for i, w in enumerate(set(words))}
                ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                offs = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
                begin, end, period = runs_of(ids, offs, least, times)
                drop = np.zeros(len(ids) + 1, np.int64)
                np.add.at(drop, begin + period, 1)
                np.add.at(drop, end, -1)
                keep = np.cumsum(drop[:-1]) == 0
                row = np.searchsorted(offs, begin, "right") - 1
                texts = []
                for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
                    kept = keep[a:b]
                    texts.append(b" ".join(words[a:b] if kept.all() else [words[a + i] for i in np.flatnonzero(kept).tolist()]))
                runs = pa.StructArray.from_arrays([pa.array(begin - offs[row]), pa.array(end - begin), pa.array(period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(count, pa.int64()), list_column(runs, np.bincount(row, minlength=part.num_rows)),
                     pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])
    return run


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """doc_id, n_words, runs (start, length, period) and collapsed: one row per row of ``docs``.

    A run is a stretch of words ``[^\\x20\\x09-\\x0D]+`` of smallest period q, at least ``least``
    and ``times`` * q words long (``times`` is 3 or more), that no neighbouring word extends.
    ``runs`` is in order of start and period; ``collapsed`` is the text without the words that
    some run holds after its first q words, joined by one space.

    The texts of a piece of a batch share one Re-Pair grammar. Runs across the inner boundary of
    a rule are found once, on the rule's first derivation, and moved to all its derivations; of
    equal periods only the intervals that no other holds remain. No row is shuffled.

    A null or empty text, or one of white space, has no words and no runs; a null doc_id keeps
    its row; repeated rows are read each on their own; other columns are ignored; an empty table
    gives no rows.
    """
    if times < 3 or least < 1:
        raise ValueError("runs need three periods and a positive length")
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(_finder(least, times), f"doc_id long, n_words long, runs {RUNS}, collapsed string")
