"""Benchmark decontamination by the q-gram lemma and banded alignment.

An item of m characters that occurs with at most k edits shares at least
m - q + 1 - q * k of its q-grams with the text, on diagonals that differ by at most 2 * k.
Shared q-grams are counted in overlapping diagonal bands; only regions that reach the bound
are aligned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.texts import BASE, KeyTable, free_names, pieces, shared

Q = 10
BUDGET = 0.05  # edits per character of an item
BLOCK_BYTES = 8 << 20  # benchmark text that one scan holds; a larger benchmark takes more scans
FLAG_BITS = 22


class Folder:
    """Lower-cased characters with every run of white space as one blank."""

    def __init__(self):
        self.codes = np.full(0x110000, -1, np.int32)

    def fold(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Folded characters and the place of each in ``raw``."""
        code = self.codes[raw]
        if (code < 0).any():
            for c in np.unique(raw[code < 0]):
                low = chr(c).lower()
                self.codes[c] = 32 if chr(c).isspace() else ord(low) if len(low) == 1 else c
            code = self.codes[raw]
        keep = code != 32
        keep[1:] |= code[:-1] != 32
        at = np.flatnonzero(keep)
        return code[at], at


def _grams(code: np.ndarray) -> np.ndarray:
    """A number for the ``Q`` characters from each place on, built by doubling."""
    value, have = code.astype(np.uint64), 1
    wide, out, done = value, None, 0
    while True:
        if Q & have:
            n = max(0, len(code) - Q + 1)
            if out is None:
                out = value[done:done + n].copy() if n else np.zeros(0, np.uint64)
            else:
                out = out * np.uint64(pow(BASE, have, 1 << 64)) + value[done:done + n]
            done += have
        have *= 2
        if have > Q:
            return out if len(wide) >= Q else np.zeros(0, np.uint64)
        value = value[:-(have // 2)] * np.uint64(pow(BASE, have // 2, 1 << 64)) + value[have // 2:]


def _flag(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(64 - FLAG_BITS)).astype(np.int64)


class Index:
    """q-grams of a block of items, with the edits each allows and the count it needs."""

    def __init__(self, ids: list[int], texts: list[str]):
        folder = Folder()
        self.ids, self.items = [], []
        for i, text in zip(ids, texts):
            code, _ = folder.fold(np.frombuffer(text.encode("utf-32-le"), np.uint32))
            code = code[1:] if len(code) and code[0] == 32 else code
            code = code[:-1] if len(code) and code[-1] == 32 else code
            if len(code):
                self.ids.append(i)
                self.items.append(code)
        size = np.array([len(c) for c in self.items], np.int64)
        self.size = size
        self.edits = np.maximum(0, np.minimum((size * BUDGET).astype(np.int64), (size - Q) // Q))
        self.need = np.maximum(1, size - Q + 1 - Q * self.edits)
        self.stride = 2 * self.edits + 1
        self.whole = {}  # items too short for a q-gram match whole texts only
        for j, c in enumerate(self.items):
            if len(c) < Q:
                self.whole.setdefault(c.tobytes(), []).append(j)
        long = [j for j in range(len(size)) if size[j] >= Q]
        grams = [_grams(self.items[j]) for j in long]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.array(long, np.int64), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.item, self.place = item[order], place[order]
        keys, self.begin, self.times = np.unique(flat[order], return_index=True, return_counts=True)
        self.table = KeyTable(keys)
        self.flags = np.zeros(1 << FLAG_BITS, bool)
        self.flags[_flag(keys)] = True

    def regions(self, code: np.ndarray):
        """(item, first diagonal, last diagonal) of every band that reaches its bound."""
        grams = _grams(code)
        at = np.flatnonzero(self.flags[_flag(grams)])
        got = self.table.find(grams[at])
        at, got = at[got >= 0], got[got >= 0]
        times = self.times[got]
        total = int(times.sum())
        if not total:
            return []
        spot = np.repeat(self.begin[got] - (np.cumsum(times) - times), times) + np.arange(total)
        item, place, pos = self.item[spot], self.place[spot], np.repeat(at, times)
        band = (pos - place) // self.stride[item]
        item, place, band = np.tile(item, 2), np.tile(place, 2), np.concatenate([band, band - 1])
        order = np.lexsort((place, band, item))
        item, place, band = item[order], place[order], band[order]
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (band[1:] != band[:-1])
        other = new.copy()
        other[1:] |= place[1:] != place[:-1]  # a q-gram of the item counts once a band
        first = np.flatnonzero(new)
        shared = np.add.reduceat(other.astype(np.int64), first)
        ok = shared >= self.need[item[first]]
        item, band = item[first][ok], band[first][ok]
        return list(zip(item.tolist(), (band * self.stride[item]).tolist(), ((band + 2) * self.stride[item]).tolist()))


def align(item: np.ndarray, text: np.ndarray, limit: int) -> tuple[int, int] | None:
    """(edits, end) of the best placement of ``item`` in ``text`` in a band of diagonals.

    The band holds the diagonals 0 to len(text) - len(item) + limit of the region.
    """
    width = len(text) - len(item) + 2 * limit + 1
    if width < 1:
        return None
    far = np.int64(1 << 40)
    padded = np.concatenate([np.full(limit, -1), text, np.full(limit + 1, -1)])
    step = np.arange(width)
    cost = np.where((step >= limit) & (step <= limit + len(text)), 0, far)
    for i, c in enumerate(item, 1):
        take = cost + (padded[i - 1:i - 1 + width] != c)
        drop = np.append(cost[1:], far) + 1
        cost = np.minimum(take, drop)
        column = step + i - limit
        cost = np.where((column >= 0) & (column <= len(text)), cost, far)
        cost = np.minimum(np.minimum.accumulate(cost - step) + step, far)
        if cost.min() > limit:
            return None
    d = int(cost.argmin())
    return int(cost[d]), d + len(item) - limit


def _find(index: Index, code: np.ndarray, regions) -> list[tuple[int, int, int, int]]:
    """(item, start, end, edits) in the folded text, overlaps of one item resolved."""
    found = []
    text = None
    for j, low, high in regions:
        item, k = index.items[j], int(index.edits[j])
        a, b = max(0, low - k), min(len(code), high + len(item) + k)
        if text is None:
            text = code.astype("<i4").tobytes()
        exact = text.find(item.astype("<i4").tobytes(), 4 * a, 4 * b)
        if exact >= 0 and exact % 4 == 0:
            found.append((j, exact // 4, exact // 4 + len(item), 0))
            continue
        got = align(item, code[a:b], k)
        if got is None or got[0] > k:
            continue
        end = a + got[1]
        back = align(item[::-1], code[max(a, end - len(item) - k):end][::-1], k)
        start = end - (back[1] if back else len(item))
        found.append((j, max(0, start), end, got[0]))
    found.sort(key=lambda x: (x[0], x[3], x[1]))
    kept = []
    for f in found:
        if not any(k[0] == f[0] and f[1] < k[2] and k[1] < f[2] for k in kept):
            kept.append(f)
    return kept


def _scanner(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, folder = shared(), Folder()
        for batch in batches:
            for part in pieces(batch, "text"):
                doc, out = [], []
                texts = part.column("text").to_pylist()
                raw = np.frombuffer("\x00".join(texts).encode("utf-32-le"), np.uint32)
                size = np.array([len(t) for t in texts], np.int64)
                offs = np.cumsum(size + 1) - size - 1
                code, at = folder.fold(raw)
                code = np.where((raw[at] == 0) & np.isin(at, offs - 1), -2, code)  # no match runs over a text's end
                regions = index.regions(code)
                by_doc: dict[int, list] = {}
                place = np.searchsorted(at, np.append(offs, len(raw) + 1))
                for j, low, high in regions:
                    first = np.searchsorted(place, max(0, low - int(index.edits[j])), "right") - 1
                    last = np.searchsorted(place, min(len(code) - 1, high + int(index.size[j])), "right") - 1
                    for d in range(max(0, first), min(last, len(texts) - 1) + 1):
                        by_doc.setdefault(d, []).append((j, low - int(place[d]), high - int(place[d])))
                for d, own in by_doc.items():
                    mine = code[place[d]:place[d + 1]]
                    mine = mine[mine != -2]
                    for j, start, end, edits in _find(index, mine, own):
                        doc.append(d)
                        out.append((index.ids[j], int(at[place[d] + start] - offs[d]), int(at[place[d] + end - 1] - offs[d]) + 1, edits))
                if index.whole:
                    for d in range(len(texts)):
                        mine = code[place[d]:place[d + 1]]
                        mine = mine[mine != -2]
                        mine = mine[1 if len(mine) and mine[0] == 32 else 0:len(mine) - 1 if len(mine) and mine[-1] == 32 else len(mine)]
                        for j in index.whole.get(mine.tobytes(), ()):
                            doc.append(d)
                            out.append((index.ids[j], 0, len(texts[d]), 0))
                if out:
                    item, start, end, edits = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(item, pa.int64()),
                         pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(edits, pa.int32())],
                        names=["doc_id", "item_id", "start", "end", "edits"])
    return run


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end, edits: one row per place where an item occurs.

    Case and runs of white space do not count. An item of m characters occurs where a
    stretch of text is within ``BUDGET`` * m edits of it (fewer where the lemma would need
    it); items under ``Q`` characters occur only as whole texts. ``start`` and ``end`` are
    code points of the text.

    The benchmark is read in blocks of about ``BLOCK_BYTES``, each broadcast, so what a
    task holds is bounded; documents are never joined or shuffled. Null or empty texts and
    items give nothing; repeated documents give their rows again, repeated items with one
    id once; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = None
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        index = shared(spark, Index([r[0] for r in own], [r[1] for r in own]))
        found = texts.mapInArrow(_scanner(index), "doc_id long, item_id long, start int, end int, edits int")
        out = found if out is None else out.union(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item occurs, with their own columns."""
    at, = free_names(docs, "at")
    keyed = docs.withColumn(at, F.xxhash64("doc_id", "text"))
    bad = contaminated(keyed.select(F.col(at).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(at)).distinct()
    return keyed.join(bad, at, "left_anti").select(*docs.columns)
